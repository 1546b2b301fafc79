"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens.  The round-robin is hierarchical: at each node of a balanced tree over
the queues the left half earns its target share of every token and is served when its deficit reaches a
half, the right half else.  So each source is within half a token for each level of the tree of its target
after any number of tokens, and the deficit left by one window is what the next one makes up.  That state
has a closed form (`Mixture.taken`), so that each document finds its own windows without any pass over the
windows before it: deficits carry across windows and across partitions alike.  Only the counts of tokens by
(partition, source) are gathered.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spark import id_text, slices, stored
from .vocab import LETTER, NUMBER, SPACE, UNPLAIN, Merges, Table

PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
#: Control characters whose bytes stand for word ends in the quick merges; texts with one go to the library.
CONTROL = re.compile("[\x00-\x08\x0e-\x1b\x7f]")
#: Queues of sources without a target of their own at most; more of them share queues by hash.
MAX_QUEUES = 4096
#: Numbers of a table of tokens taken, by row and queue, that is held at a time.
STATE_NUMBERS = 1 << 20
#: Rows of the table of queue starts up to which it is broadcast (about 50 bytes each); a shuffle join beyond.
BROADCAST_ROWS = 200_000

_workers: dict[str, "WordIds"] = {}


class WordIds:
    """Ids of whole texts, as bytes of little-endian integers, as the library encodes them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.merges = Merges(path, self.tokenizer.model)
        self.words = Table(self.word)

    def word(self, text: str) -> bytes:
        ids = self.merges.ids
        return np.array([i for p in PRE_TOKEN.findall(text) for i in ids(p)], self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        low = text.lower()  # a capital that is plain may have a lower case that is not
        if UNPLAIN.search(text) or UNPLAIN.search(low) or CONTROL.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join(map(self.words.__getitem__, low.split()))


def word_ids(path: str) -> WordIds:
    if path not in _workers:
        _workers[path] = WordIds(path)
    return _workers[path]


class Mixture:
    """How many tokens of each queue are among the first N packed ones.

    totals: tokens by queue.  weights: integer target proportions; by default the totals, so that all
    queues end together.  A queue that ends leaves its share to the others (a new phase).
    """

    def __init__(self, totals: list[int], weights: list[int] | None = None):
        self.totals = list(map(int, totals))
        weights = list(map(int, weights or totals))
        left, n = list(self.totals), 0
        #: (first N, tokens taken by then, weights of the queues that last)
        self.phases: list[tuple[int, list[int], list[int]]] = []
        while any(left):
            own = [w if rest else 0 for w, rest in zip(weights, left, strict=True)]
            if not any(own):  # only queues without a share are left
                own = list(left)
            self.phases.append((n, [t - rest for t, rest in zip(self.totals, left, strict=True)], own))
            if own == left:
                break
            lo, hi = 1, sum(left)
            while lo < hi:  # the first N at which a queue ends
                mid = (lo + hi) // 2
                got = self._split(np.array([mid], object), own)[0]
                if any(g >= rest for g, rest, w in zip(got, left, own, strict=True) if w):
                    hi = mid
                else:
                    lo = mid + 1
            got = self._split(np.array([lo], object), own)[0]
            left = [rest - min(int(g), rest) for g, rest in zip(got, left, strict=True)]
            n = sum(self.totals) - sum(left)

    @staticmethod
    def _split(n: np.ndarray, weights: list[int]) -> np.ndarray:
        """n tokens by queue: halves of the queues share by rounded proportion, down to single queues."""
        prefix = np.concatenate([[0], np.cumsum(np.array(weights, object))])
        top = int(n.max()) if len(n) else 0
        kind = np.int64 if 2 * top * int(prefix[-1]) < 1 << 62 else object
        out = np.zeros((len(n), len(weights)), kind)
        todo = [(0, len(weights), n.astype(kind))]
        while todo:
            a, b, have = todo.pop()
            if b - a == 1:
                out[:, a] = have
                continue
            mid, whole = (a + b) // 2, int(prefix[b] - prefix[a])
            part = int(prefix[mid] - prefix[a])
            first = (2 * have * part + whole) // (2 * whole) if whole else have * 0
            todo += [(a, mid, first), (mid, b, have - first)]
        return out

    def taken(self, n: np.ndarray) -> np.ndarray:
        """By row: tokens of each queue among the first n."""
        n = np.minimum(n, sum(self.totals))
        out = np.zeros((len(n), len(self.totals)), np.int64)
        starts = [p[0] for p in self.phases]
        which = np.searchsorted(starts, n, "right") - 1
        for k, (start, base, own) in enumerate(self.phases):
            rows = np.flatnonzero(which == k)
            if len(rows):
                out[rows] = np.minimum(self._split(n[rows] - start, own).astype(np.int64) + np.array(base, np.int64), np.array(self.totals, np.int64))
        return out

    @property
    def step(self) -> int:
        """Rows that are handled at a time: a row has a number for each queue."""
        return max(64, STATE_NUMBERS // max(1, len(self.totals)))

    def windows(self, queue: np.ndarray, at: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, window) of the windows that may hold one of the tokens [at, at + n) of each row's queue.

        Between its first and last window a row has them all, or only those of its tokens if these are fewer.
        """
        first, last = self.window(queue, at, length), self.window(queue, at + n - 1, length)
        each = np.where(last - first + 1 <= 2 * n, last - first + 1, 0)
        row = np.repeat(np.arange(len(at)), each)
        win = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + first[row]
        thin = np.flatnonzero(each == 0)  # a small queue: its tokens stand far apart
        if len(thin):
            of = np.repeat(thin, n[thin])
            token = np.arange(len(of)) - np.repeat(np.cumsum(n[thin]) - n[thin], n[thin]) + at[of]
            pairs = np.unique(np.stack([of, self.window(queue[of], token, length)], axis=1), axis=0)
            row, win = np.concatenate([row, pairs[:, 0]]), np.concatenate([win, pairs[:, 1]])
        return row, win

    def window(self, queue: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """The window that holds token `at` of `queue`."""
        if len(at) > self.step:
            return np.concatenate([self.window(queue[k : k + self.step], at[k : k + self.step], length) for k in range(0, len(at), self.step)])
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), (sum(self.totals) - 1) // length)
        rows = np.arange(len(at))
        if len(self.phases) == 1 and len(at):  # near the token's share of the whole
            share = np.array(self.totals, np.float64)[queue]
            guess = (at / np.maximum(share, 1) * sum(self.totals) / length).astype(np.int64)
            slack = (4 * sum(self.totals) / np.maximum(share, 1) / length * (1 + np.log2(len(self.totals) + 1))).astype(np.int64) + 2
            lo, hi = np.clip(guess - slack, 0, hi), np.clip(guess + slack, 0, hi)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            ends, back = np.unique((mid + 1) * length, return_inverse=True)
            over = self.taken(ends)[back, queue[rows]] > at
            hi, lo = np.where(over, mid, hi), np.where(over, lo, np.minimum(mid + 1, hi))
        return lo


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    length: int = 2048,
    end_id: int = 1,
    weights: Mapping[str, int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_ids: bool = False,
) -> DataFrame:
    """Pack all tokens, each document's followed by `end_id`, into sequences of `length`.

    One row per piece: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens,
    sequence_id, offset, and ids with `with_ids`.  Sequences are full but for the last.  `weights`
    are target proportions by source (default: the corpus' own token shares); sources without one follow
    when those with one have ended.  Of the sources without a target more than MAX_QUEUES share queues by
    hash; those with one never do.  A null source counts as the empty name; a null id is packed like any
    other; extra columns are ignored whatever their names.  Null or empty texts have the end id
    alone; repeated rows are packed as often as they occur; no
    rows give no pieces.
    """
    name = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    own = name.isin(list(weights)) if weights else F.lit(False)
    source = name.alias("queue")
    if docs.where(~own).select(F.count_distinct(name)).first()[0] > MAX_QUEUES:
        shared = F.concat(F.lit("\0"), F.pmod(F.xxhash64(name), F.lit(MAX_QUEUES)).cast("string"))
        source = F.when(own, name).otherwise(shared).alias("queue")
    base = id_text(docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), source), "i", "t", "queue")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, before = word_ids(tokenizer_path), TaskContext.get().partitionId(), {}
        end = np.array([end_id], own.kind).tobytes()
        for piece in slices(batches, "text"):
            ids = [own.encode(t) + end for t in piece.column(1).to_pylist()]
            n = [len(x) // own.kind.itemsize for x in ids]
            starts, queues = [], piece.column(2).to_pylist()
            for q, k in zip(queues, n, strict=True):
                starts.append(before.get(q, 0))
                before[q] = starts[-1] + k
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(2), pa.array([part] * len(n), pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "queue", "part", "before", "n", "ids"],
            )

    tokens = stored(base.mapInArrow(tokenise, "doc_id long, queue string, part int, before long, n long, ids binary"), "tokens")
    counts = stored(tokens.groupBy("part", "queue").agg(F.sum("n").alias("n")), "counts")
    totals = {r[0]: r[1] for r in counts.groupBy("queue").agg(F.sum("n")).collect()}  # MAX_QUEUES rows at most
    queues = sorted(totals)
    mix = Mixture([totals[q] for q in queues], [int(weights.get(q, 0)) for q in queues] if weights else None)
    number = {q: k for k, q in enumerate(queues)}
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    if counts.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, ["part", "queue"]).select("doc_id", "queue", (F.col("base") + F.col("before")).alias("at"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = word_ids(tokenizer_path).kind
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                rows = batch.slice(k, 512)
                ids = rows.column(4).to_pylist()
                queue = np.array([number[q] for q in rows.column(1).to_pylist()], np.int64)
                at, n = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
                doc, win = mix.windows(queue, at, n, length)
                lo, hi, ahead = (np.zeros(len(doc), np.int64) for _ in range(3))
                for j in range(0, len(doc), mix.step):
                    piece = slice(j, j + mix.step)
                    edges = np.unique(np.concatenate([win[piece], win[piece] + 1]))
                    taken = mix.taken(edges * length)
                    each = np.arange(len(win[piece])), queue[doc[piece]]
                    low, high = taken[np.searchsorted(edges, win[piece])], taken[np.searchsorted(edges, win[piece] + 1)]
                    lo[piece], hi[piece] = low[each], high[each]
                    ahead[piece] = (np.cumsum(high - low, axis=1) - (high - low))[each]
                a, b = np.maximum(lo, at[doc]), np.minimum(hi, at[doc] + n[doc])
                keep = np.flatnonzero(b > a)
                doc, win, a, b = doc[keep], win[keep], a[keep], b[keep]
                offset = (ahead - lo)[keep] + a
                a, b = a - at[doc], b - at[doc]
                wide = [np.frombuffer(x, kind).astype("<u4").tobytes() for x in ids]
                crc = [zlib.crc32(wide[d][4 * i : 4 * j]) for d, i, j in zip(doc.tolist(), a.tolist(), b.tolist(), strict=True)]
                cols = [rows.column(0).take(pa.array(doc)), pa.array(a), pa.array(b - a), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(win), pa.array(offset)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(wide[d][4 * i : 4 * j], "<u4").astype(np.int32) for d, i, j in zip(doc, a, b, strict=True)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(cut, out + ", ids array<int>" * with_ids)
