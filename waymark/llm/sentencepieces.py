"""Encoding and decoding with a merge-type sentencepiece model."""

from __future__ import annotations

import hashlib
import re
from itertools import chain

from pyspark.sql import DataFrame

from waymark.llm.bpe import merge
from waymark.llm.common import id_and_text, per_text

SPACE = "▁"
#: Pieces never hold a space mark after another character, nor a line feed, so no merge crosses these chunks' ends.
CHUNK = re.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")

#: Chunks that a half of the cache holds, and characters beyond which a chunk isn't kept.
CACHED, LONG = 400_000, 64


class PieceEncoder:
    """Encodes by a score-ordered agenda of adjacent symbol pairs; the library checks every chunk that is new to the task.

    Chunks are kept by a bounded cache of two halves. A chunk on which agenda and library differ takes the library's ids and is counted.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib = self.library
        names = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        for p in names:
            if "\n" in p or SPACE in p.lstrip(SPACE):
                raise ValueError(f"the piece {p!r} crosses words")
        self.costs = {p: -lib.get_score(i) for i, p in enumerate(names) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))}
        self.ids = {p: i for i, p in enumerate(names) if p in self.costs}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(names) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        self.differ: set[str] = set()
        self.differing: list[int] = []
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def by_agenda(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        known = self.ids.get
        for piece in merge(chunk, self.costs):
            i = known(piece)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return tuple(out)

    def by_library(self, chunks: list[str]) -> list[list[int]]:
        """The library puts a space mark before any text; a chunk without one goes behind a line feed, which stays apart."""
        start = len(self.library.encode("\n"))
        found = self.library.encode([c[1:] if c[0] == SPACE else "\n" + c for c in chunks], num_threads=1)
        return [([self.ids[SPACE]] if c == SPACE else ids) if c[0] == SPACE else ids[start:] for c, ids in zip(chunks, found, strict=True)]

    def learn(self, chunks: set[str]) -> None:
        """Brings the chunks of a batch into the young half of the cache: from the old half, or by agenda and check."""
        if len(self.young) > CACHED:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = []
        for c in chunks:
            if c not in young:
                if c in old:
                    young[c] = old[c]
                else:
                    new.append(c)
        for c, theirs in zip(new, self.by_library(new) if new else (), strict=True):
            ours = self.by_agenda(c)
            if list(ours) != theirs:
                self.differ.add(c)
                ours = tuple(theirs)
            young[c] = ours

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [CHUNK.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        chunks = set(chain.from_iterable(cut))
        self.learn(chunks)
        get = self.young.__getitem__
        out = [list(chain.from_iterable(map(get, c))) for c in cut]
        self.differing = [len(self.differ.intersection(c)) for c in cut] if self.differ else [0] * len(cut)
        for c in [c for c in chunks if len(c) > LONG]:
            del self.young[c]
        return out


ENCODERS: dict[bytes, PieceEncoder] = {}


def encoder(model: bytes) -> PieceEncoder:
    """A Python worker's encoder, with what earlier tasks of the worker have learned."""
    key = hashlib.sha256(model).digest()
    if key not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[key] = PieceEncoder(model)
    return ENCODERS[key]


def encode_pieces(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, ids array<int>, decoded: the whole text's ids as the library gives them, and its decode(ids).

    Null text: as the empty text, with no ids. A null id stays null; repeated rows give repeated rows; other columns
    are ignored. The model's bytes travel in the closure: their size is the vocabulary's, not the data's.
    """

    def make():
        enc = encoder(model)

        def work(ids, texts):
            for i, tokens in zip(ids, enc.encode(texts), strict=True):
                yield i, tokens, enc.library.decode(tokens) if tokens else ""

        return work

    return per_text(id_and_text(docs, id_col, text_col), "doc_id long, ids array<int>, decoded string", make, 64)


def piece_digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_pieces, but with n_tokens and digests in place of the ids and the text.

    Rows doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256, n_disagreed (the
    text's different chunks on which agenda and library differ; 0 in every test).
    """

    def make():
        enc = encoder(model)
        sha, decimal = hashlib.sha256, [str(i) for i in range(enc.library.get_piece_size())].__getitem__

        def work(ids, texts):
            for i, tokens, differing in zip(ids, enc.encode(texts), enc.differing, strict=True):
                decoded = enc.library.decode(tokens) if tokens else ""
                yield i, len(tokens), sha(",".join(map(decimal, tokens)).encode()).hexdigest(), sha(decoded.encode()).hexdigest(), differing

        return work

    return per_text(id_and_text(docs, id_col, text_col), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_disagreed long", make)
