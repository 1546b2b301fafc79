"""Token counts: whole-token shortcut over byte-level BPE.

Offline, once per worker, each vocabulary string is proved or disproved to encode alone as a
single token: it must be one pre-token and its merges must end in itself.  A pre-token among the
proved strings counts one without any merge; only the rest goes through the merges, each distinct
one once per bounded table.  Texts with code points whose class is not stable between regex
engines, or with an added special token's string, are encoded whole by the library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .spark import id_text, slices
from .vocab import LETTER, NUMBER, SPACE, UNPLAIN, Merges, Table

PRE_TOKEN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Two white-space characters of which one is a blank: there the blank does not surely start a pre-token.
_OTHER = re.compile("[\t\x0b\x0c\r\x85\xa0]")
_RUN = re.compile(f" [{SPACE}]|[{SPACE}] ")

_workers: dict[str, "TokenCounter"] = {}


class TokenCounter:
    """Counts tokens exactly as `Tokenizer.encode(text, add_special_tokens=False)` does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(path, self.tokenizer.model)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = self.prove()
        self.chunks = Table(self.chunk)

    def prove(self) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and one token when they stand alone."""
        back = {c: b for b, c in self.merges.letters.items()}
        proved = set()
        for word, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            try:
                text = bytes(back[c] for c in word).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if not UNPLAIN.search(text) and PRE_TOKEN.fullmatch(text) and self.merges.ids(text) == [i]:
                proved.add(text)
        return frozenset(proved)

    def chunk(self, text: str) -> int:
        whole, merge, n = self.whole, self.merges.merge, 0
        for piece in PRE_TOKEN.findall(text):
            n += 1 if piece in whole else len(merge(piece.encode()))
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if UNPLAIN.search(text) or any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if "  " in text or " \n" in text or "\n " in text or (_OTHER.search(text) and _RUN.search(text)):
            return self.chunk(text)
        # every blank starts a pre-token here, so the text splits there
        first, *others = text.split(" ")
        return self.chunks[first] + sum(map(self.chunks.__getitem__, map(" ".__add__, others)))


def counter(path: str) -> TokenCounter:
    if path not in _workers:
        _workers[path] = TokenCounter(path)
    return _workers[path]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 tokens; repeated rows give repeated rows; a null id stays null;
    no rows give none; other columns are not read, whatever their names.
    The plan is one narrow pass: no shuffle, no state beyond bounded tables in each worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path).count
        for part in slices(batches, "text"):
            texts = part.column(1).to_pylist()
            n = [count(t) for t in texts]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
