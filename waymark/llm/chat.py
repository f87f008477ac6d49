"""Chat formatting: whole conversations rendered once, encoded once with offsets, loss masks aligned to token spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import ship

#: Characters after which a long conversation's text is cut at the end of a turn.
PART = 30_000
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks around turns. A role without marks of its own is written between those of ``other``: role, text, end.

    Control strings are the marks and what a vocabulary reserves. Inside a text the escape goes after a control string's
    first character, one more where some are there already, and comes out again on reading: so no text holds a bare control
    string, and every text comes back. This needs that no control string begins another, and that their first characters
    stand nowhere else in them; else ValueError.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    learned: str = "assistant"

    def controls(self, reserved: tuple[str, ...] = ()) -> list[str]:
        found = list(dict.fromkeys([*(m for pair in self.marks.values() for m in pair), *self.other, *reserved]))
        firsts = {c[0] for c in found}
        for c in found:
            if len(c) < 2 or ESCAPE in c or firsts & set(c[1:]) or any(d != c and d.startswith(c) for d in found):
                raise ValueError(f"control string {c!r} can't be told apart")
        return found


class Chat:
    """A template with the vocabulary's own control strings: rendering, escaping, reading back."""

    def __init__(self, template: Template, reserved: tuple[str, ...]):
        self.template = template
        self.controls = template.controls(reserved)
        slash = re.escape(ESCAPE)
        rests: dict[str, list[str]] = {}
        for c in self.controls:
            rests.setdefault(c[0], []).append(re.escape(c[1:]))
        ends = [(re.escape(c), f"(?={slash}*(?:{'|'.join(r)}))") for c, r in rests.items()]
        self.bare = re.compile("|".join(c + rest for c, rest in ends))
        self.escaped = re.compile("|".join(f"{c}{slash}{rest}" for c, rest in ends))
        self.control = re.compile("|".join(map(re.escape, self.controls)))

    def escape(self, text: str) -> str:
        return self.bare.sub(lambda m: m[0] + ESCAPE, text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[0][0], text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
        """The text of the turns, and where the learned ones' texts begin and end in it."""
        out, at, starts, ends = [], 0, [], []
        marks, (before, between, after) = self.template.marks, self.template.other
        for role, text in turns:
            opened, closed = marks.get(role) or (before + self.escape(role) + between, after)
            inside = self.escape(text)
            out += [opened, inside, closed]
            if role == self.template.learned:
                starts.append(at + len(opened))
                ends.append(at + len(opened) + len(inside))
            at += len(opened) + len(inside) + len(closed)
        return "".join(out), starts, ends

    def turns(self, text: str) -> Iterator[tuple[str, str]]:
        """Reads (role, text) back from a rendered text."""
        opened = {a: (role, b) for role, (a, b) in self.template.marks.items()}
        before, between, after = self.template.other
        role, since = None, 0
        for m in self.control.finditer(text):
            if m[0] in opened:
                role, since = opened[m[0]][0], m.end()
            elif m[0] == before:
                since = m.end()
            elif m[0] == between:
                role, since = self.unescape(text[since : m.start()]), m.end()
            else:
                yield role, self.unescape(text[since : m.start()])


def mask(starts: np.ndarray, ends: np.ndarray, span_starts: np.ndarray, span_ends: np.ndarray) -> np.ndarray:
    """Which tokens (from starts to ends) share a character with a span; spans are sorted and apart, empty ones count for
    nothing. Binary search gives the last span that begins before a token ends."""
    full = span_starts < span_ends
    span_starts, span_ends = span_starts[full], span_ends[full]
    if not len(span_starts):
        return np.zeros(len(starts), bool)
    k = np.searchsorted(span_starts, ends, "left") - 1
    return (k >= 0) & (span_ends[k] > starts)


def masked(text: str, starts: list[int], ends: list[int], loss: list[bool]) -> list[str]:
    """The stretches of text under tokens of the loss, one for each run of such tokens."""
    on = np.flatnonzero(np.diff(np.asarray(loss, np.int8), prepend=0, append=0))
    return [text[starts[a] : ends[b - 1]] for a, b in zip(on[::2], on[1::2], strict=True)]


FORMATTED = "conv_id long, part long, whole boolean, n_turns long, text string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def encoder(vocabulary: str, template: Template):
    """The tokenizer with the template's marks as special tokens after its own, and the chat for both."""
    from tokenizers import AddedToken, Tokenizer, processors

    tok = Tokenizer.from_str(vocabulary)
    reserved = tuple(t.content for t in tok.get_added_tokens_decoder().values())
    chat = Chat(template, reserved)
    tok.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in chat.controls if c not in reserved])
    tok.post_processor = processors.ByteLevel(trim_offsets=False)  # a token's span includes its leading space
    return tok, chat


def format_conversations(
    rows: DataFrame, vocabulary: str, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """Rows conv_id, part, whole, n_turns, text, ids, starts, ends, loss: a conversation's rendered text, its token ids with
    the code points that each covers, and which of them count in the loss (those of assistant texts).

    vocabulary: the text of a byte-level tokenizers .json file. Turns are dealt and sorted by ranges of (conversation, turn),
    so one conversation of any length spreads over tasks; a text is cut between turns after PART characters, where special
    tokens stand, so ids are those of the whole conversation. Parts in order of ``part`` make up a conversation; ``whole``
    says that this part surely is all of it. Null text or role: empty. Null turns come first; equal turns go by role, then by
    text, repeated rows stay; null conversation ids are one conversation. No rows give no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    ship(spark)
    shipped = spark.sparkContext.broadcast((vocabulary, template or Template()))
    role, text = (F.coalesce(rows[c], F.lit("")) for c in (role_col, text_col))
    plain = rows.select(rows[conv_col].cast("long").alias("conv_id"), rows[turn_col].cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.xxhash64(text).alias("mark"))
    keys = ["conv_id", "turn", "role", "mark"]
    dealt = plain.repartitionByRange(*keys).sortWithinPartitions(*keys, "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, chat = encoder(*shipped.value)
        number = TaskContext.get().partitionId() << 33
        out, size = [], 0

        def formatted(conv: int | None, turns: list, whole: bool) -> tuple:
            nonlocal number
            text, a, b = chat.render(turns)
            enc = tok.encode(text, add_special_tokens=False)
            starts, ends = np.array(enc.offsets, np.int32).reshape(-1, 2).T
            number += 1
            return conv, number - 1, whole, len(turns), text, np.array(enc.ids, np.int32), starts, ends, mask(starts, ends, np.array(a), np.array(b))

        def flushed() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in FORMATTED.split(", ")])
            out.clear()
            return batch

        now, turns, chars, first, cut = None, [], 0, True, False
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turns and (conv != now or chars > PART):
                    out.append(formatted(now, turns, conv != now and not first and not cut))
                    size += chars
                    first, cut = first and conv == now, conv == now
                    turns, chars = [], 0
                    if size > 1_000_000:
                        yield flushed()
                        size = 0
                now = conv
                turns.append((role, text))
                chars += len(text)
        if turns:
            out.append(formatted(now, turns, False))
        if out:
            yield flushed()

    return dealt.mapInArrow(run, FORMATTED)


def conversation_digests(formatted: DataFrame, vocabulary: str, template: Template | None = None) -> DataFrame:
    """Rows conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, n_loss_tokens of what
    format_conversations gave: turns are parsed from the rendered text, the learned text is cut out by the loss mask and the
    tokens' offsets.

    A part that is a whole conversation is digested where it is; parts of others go to one task in order, which hashes them as
    they stream by and holds one part at a time, whatever a conversation's length (a digest of a text needs it in order).
    """
    shipped = formatted.sparkSession.sparkContext.broadcast((vocabulary, template or Template()))
    read = "conv_id long, part long, n_turns long, turns_sha256 string, turns binary, loss_chars long, loss_sha256 string, learned binary, formatted_chars long, n_tokens long, n_loss_tokens long"
    final = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"

    def arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        fields = [f.split() for f in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, chat = encoder(*shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for conv, part, whole, n, text, starts, ends, loss in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    learned = "".join(chat.unescape(x) for x in masked(text, starts, ends, loss))
                    turns, learned_bytes = "".join(f"{r}\n{t}\n" for r, t in chat.turns(text)).encode(), learned.encode()
                    digests = [hashlib.sha256(x).hexdigest() if whole else None for x in (turns, learned_bytes)]
                    held = [None if whole else x for x in (turns, learned_bytes)]
                    out.append((conv, part, n, digests[0], held[0], len(learned), digests[1], held[1], len(text), len(loss), sum(loss)))
                yield arrow(out, read)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, hashes = (), None, None

        def done() -> tuple:
            return now[0], sums[0], hashes[0].hexdigest(), sums[1], hashes[1].hexdigest(), *sums[2:]

        for batch in batches:
            out = []
            for conv, _, n, turns_hex, turns, chars, loss_hex, learned, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now and now[0] != conv:
                    out.append(done())
                    now = ()
                if turns is None:
                    out.append((conv, n, turns_hex, chars, loss_hex, *rest))
                    continue
                if not now:
                    now, sums, hashes = (conv,), [0] * 5, [hashlib.sha256(), hashlib.sha256()]
                sums = [a + b for a, b in zip(sums, (n, chars, *rest), strict=True)]
                hashes[0].update(turns)
                hashes[1].update(learned)
            if out:
                yield arrow(out, final)
        if now:
            yield arrow([done()], final)

    columns = ["conv_id", "part", "whole", "n_turns", "text", "starts", "ends", "loss"]
    return formatted.select(*columns).mapInArrow(parse, read).repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(fold, final)
