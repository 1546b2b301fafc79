"""SentencePiece encoding and decoding over a distinct-chunk table.

`Pieces` first checks that no vocabulary piece holds a white-space marker after another character;
then no merge crosses from a word into the next marker, and a text is the sequence of its marked
words.  Each distinct marked word is segmented once per bounded table, and ids, counts and
surfaces are joined back by position.  A vocabulary without that property, or a text with code
points that need the library's own treatment, is encoded whole by the library.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .spark import id_text, slices
from .vocab import TABLE_ENTRIES

MARK = "▁"
#: Words that one call of the library segments.
GROUP = 256
#: The marker itself, NUL, code points without a character, and control or user-defined pieces' brackets stay with the library.
_ODD = re.compile("[\x00▁\ud800-\udfff�]")

_workers: dict[str, "Pieces"] = {}


class Pieces:
    """Encodes and decodes as `SentencePieceProcessor.encode` and `.decode` do, without begin or end ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(i) for i in range(n)]
        ordinary = [p for i, p in enumerate(pieces) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        probe = self.sp.encode("x  y", out_type=str)
        self.free = (
            all(MARK not in p.lstrip(MARK) for p in ordinary)
            and "".join(probe) == f"{MARK}x{MARK}{MARK}y"
            and all(self.sp.is_byte(self.sp.piece_to_id(f"<0x{b:02X}>")) for b in range(256))
            and self.sp.encode("ﬁＡ", out_type=str) != self.sp.encode("fiA", out_type=str)
        )
        self.heads = np.array([p.startswith(MARK) for p in pieces])
        self.decimal = list(map(str, range(n)))
        #: marked word -> the decimal text of its ids
        self.table: dict[str, str] = {}
        self.old: dict[str, str] = {}
        #: marked word -> its decoded surface, kept only where that is not the word again
        self.surface: dict[str, str] = {}
        #: marked words whose pieces the markers don't tell apart: texts with one go to the library
        self.odd: set[str] = set()

    def plain(self, text: str) -> bool:
        """Whether marked words of one blank each make up the text."""
        return self.free and not (_ODD.search(text) or "  " in text or text[0] == " " or text[-1] == " ")

    def segment(self, words: list[str]) -> None:
        """Put marked words into the table; they are given without their marker and hold no blank."""
        encode, decode, decimal = self.sp.encode, self.sp.decode, self.decimal.__getitem__
        for at in range(0, len(words), GROUP):
            part = words[at : at + GROUP]
            ids = encode(" ".join(part))
            cut = np.flatnonzero(self.heads[ids]).tolist()
            shown = decode(ids).split(" ")
            if not len(cut) == len(part) == len(shown):
                if len(part) == 1:
                    self.table[part[0]] = ""
                    self.odd.add(part[0])
                else:  # find the word
                    half = len(part) // 2
                    self.segment(part[:half])
                    self.segment(part[half:])
                continue
            text = list(map(decimal, ids))
            self.table.update((w, ",".join(text[i:j])) for w, i, j in zip(part, cut, [*cut[1:], None], strict=True))
            if shown != part:
                self.surface.update((w, x) for w, x in zip(part, shown, strict=True) if w != x)

    def learn(self, words: set[str]) -> None:
        """Segment each distinct marked word that the table misses, once."""
        if len(self.table) >= TABLE_ENTRIES:
            self.old, self.table = self.table, {}
            self.surface = {w: x for w, x in self.surface.items() if w in self.old}
            self.odd &= self.old.keys()
        missing = words - self.table.keys()
        if known := missing & self.old.keys():
            self.table.update((w, self.old[w]) for w in known)
            missing -= known
        self.segment(list(missing))

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of ids, their decimal text joined by commas, the decoded text."""
        split = [t.split(" ") if t and self.plain(t) else None for t in texts]
        self.learn(set().union(*filter(None, split)))
        get = self.table.__getitem__
        for text, words in zip(texts, split, strict=True):
            if words and (not self.odd or self.odd.isdisjoint(words)):
                ids = ",".join(map(get, words))
                yield ids.count(",") + 1, ids, " ".join(self.surface.get(w, w) for w in words) if self.surface else text
            else:
                found = self.sp.encode(text)
                yield len(found), ",".join(map(str, found)), self.sp.decode(found)


def pieces(path: str) -> Pieces:
    if path not in _workers:
        _workers[path] = Pieces(path)
    return _workers[path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, then ids (array) and decoded, or their sha256 with `digests`.

    Null and empty texts have no ids and decode to the empty text; repeated rows give repeated rows; a null
    id stays null; no rows give none; other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model_path)
        for part in slices(batches, "text"):
            rows = list(own.digests(part.column(1).to_pylist()))
            n = pa.array([r[0] for r in rows], pa.int64())
            if digests:
                sha = [pa.array([hashlib.sha256(r[k].encode()).hexdigest() for r in rows], pa.string()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0), n, *sha], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                ids = pa.array([[int(i) for i in r[1].split(",")] if r[1] else [] for r in rows], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), n, ids, pa.array([r[2] for r in rows], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    out = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_tokens long, {out}")
