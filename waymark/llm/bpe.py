"""The merge agenda of pair-merging vocabularies, and pre-tokens of the byte-level ones."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from heapq import heapify, heappop, heappush

#: The pattern of the byte-level vocabularies' pre-tokens.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Code points whose classes the regex and tokenizers libraries may read from different Unicode versions.
UNSURE = "[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7f1\uab6c\uab6d\U000107bb-\U0001f2ff\U0001f650-\U0001ffff\U0002a6e0-\U0010ffff]"

SHORT = 24
NEVER = float("inf")


def merge_short(symbols: list[str], costs: dict[str, float], between: str) -> list[str]:
    """As merge, with the agenda as a list of the pairs' costs in order of place."""
    get = costs.get
    agenda = [get(a + between + b, NEVER) for a, b in zip(symbols, symbols[1:])]
    while agenda and (least := min(agenda)) != NEVER:
        i = agenda.index(least)
        symbols[i : i + 2] = [both := symbols[i] + symbols[i + 1]]
        del agenda[i]
        if i < len(agenda):
            agenda[i] = get(both + between + symbols[i + 1], NEVER)
        if i:
            agenda[i - 1] = get(symbols[i - 1] + between + both, NEVER)
    return symbols


def merge(symbols: list[str], costs: dict[str, float], between: str = "") -> list[str]:
    """Merges adjacent symbols, always the pair of least cost, of these the leftmost, until no pair has a cost.

    costs: by the pair's symbols with ``between`` in the middle. The agenda is a heap of (cost, left position); an entry is
    void if either symbol has changed since. O(n log n) for n symbols. Up to SHORT symbols a flat list is the faster agenda.
    """
    symbols = list(symbols)
    n = len(symbols)
    if n <= SHORT:
        return merge_short(symbols, costs, between)
    get = costs.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = [(c, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (c := get(a + between + b)) is not None]
    heapify(agenda)
    while agenda:
        _, i, a, b = heappop(agenda)
        j = after[i] if symbols[i] == a else n
        if j >= n or symbols[j] != b:
            continue
        both = symbols[i] = a + b
        symbols[j] = ""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (c := get(both + between + symbols[k])) is not None:
                heappush(agenda, (c, i, both, symbols[k]))
        h = before[i]
        if h >= 0 and (c := get(symbols[h] + between + both)) is not None:
            heappush(agenda, (c, h, symbols[h], both))
    return [s for s in symbols if s]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ByteLevel:
    """A byte-level pair-merging vocabulary, read from the text of a tokenizers .json file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {m if isinstance(m, str) else " ".join(m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()

    def splitter(self) -> Callable[[str], list[str]]:
        """A function from a text without special strings to its pre-tokens; the library splits texts with UNSURE characters."""
        import regex
        from tokenizers.pre_tokenizers import ByteLevel as Library

        find, unsure, library = regex.compile(PRE_TOKENS).findall, re.compile(UNSURE).search, Library(add_prefix_space=False)
        return lambda text: [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)] if unsure(text) else find(text)

    def tokens(self, pre_token: str) -> list[str]:
        letters = self.letters
        return merge([letters[b] for b in pre_token.encode()], self.ranks, " ")

    def whole(self) -> dict[str, int]:
        """The vocabulary's strings that are proved to encode alone as one token: each is merged from its bytes, and
        stays only if one token is left. Strings that aren't whole UTF-8 can't be pre-tokens and are left out."""
        back = {c: b for b, c in enumerate(self.letters)}
        found = {}
        for token, i in self.ids.items():
            try:
                text = bytes(back[c] for c in token).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if self.tokens(text) == [token]:
                found[text] = i
        return found
