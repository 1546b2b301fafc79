"""Bounded tables of distinct strings, and which texts the quick splitters treat exactly."""

from __future__ import annotations

import json
import re

#: Character classes of the quick splitters, valid for the code points `PLAIN` admits.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼½¾"
SPACE = " \t\n\x0b\x0c\r\x85\xa0"
#: Finds a character whose class or case could differ between regex engines; such texts go to the library.
UNPLAIN = re.compile("[^\x00-\x1b\x20-įı-ɏ‐-‧‰-⁞€]")

#: Entries of each half of a worker's table; two halves of short strings stay near 200 MB.
TABLE_ENTRIES = 500_000


class Table(dict):
    """A dict that computes what it misses and forgets the older half when full."""

    def __init__(self, compute, entries: int = TABLE_ENTRIES):
        super().__init__()
        self.compute, self.entries, self.old = compute, entries, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.compute(key)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte.

    Bytes that print in Latin-1 stand for themselves; the rest follow from U+0100 on.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


class Merges:
    """Merges one pre-token of a byte-level BPE file quickly, with ids as the library gives them.

    The merge list is run by rank over byte strings.  Where the vocabulary marks word ends by a
    suffix, the last byte of a pre-token is written as a byte that plain lower-case text never
    holds; a pre-token whose last byte has no such stand-in goes to the library's model.
    """

    def __init__(self, path: str, model):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        self.model = model
        self.letters = byte_alphabet()
        back = {c: b for b, c in self.letters.items()}
        self.suffix = spec.get("end_of_word_suffix") or ""
        used = {*range(0x21, 0x41), *range(0x5B, 0x7F), *range(0x80, 0xC0), *range(0xC2, 0xCA), 0xE2}
        free = iter(sorted(set(range(256)) - used))
        self.last = {b: next(free) for b in (*range(0x21, 0x41), *range(0x5B, 0x7F))} if self.suffix else {}
        ranks: dict[bytes, int] = {}
        for word, i in spec["vocab"].items():
            marked = bool(self.suffix) and word.endswith(self.suffix)
            raw = bytearray(back[c] for c in (word[: -len(self.suffix)] if marked else word))
            if marked:
                if raw[-1] not in self.last:
                    continue
                raw[-1] = self.last[raw[-1]]
            elif self.suffix and not used.issuperset(raw):
                continue
            ranks[bytes(raw)] = i
        taken = set(ranks.values())
        spare = iter(x for x in range(len(spec["vocab"]), len(spec["vocab"]) + 512) if x not in taken)
        for b in range(256):
            ranks.setdefault(bytes([b]), next(spare))
        self.merge = tiktoken.Encoding("own", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def ids(self, piece: str) -> list[int]:
        """The ids of a non-empty pre-token of plain text (lower case where the vocabulary has a suffix)."""
        raw = piece.encode()
        if self.suffix:
            end = self.last.get(raw[-1])
            if end is None:
                return [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, raw)))]
            raw = raw[:-1] + bytes([end])
        return self.merge(raw)
