"""Benchmark decontamination with suffix arrays of the training text.

Every task cuts its documents into shards of bounded size, numbers the words that occur in the
benchmark at all, builds a suffix array over the stretches that are long enough to hold a window,
and binary-searches every suffix of the benchmark in it. Hits, items and the longest verbatim match
with its place follow per document, in one pass over the text without any shuffle.

The benchmark reaches the tasks in blocks of at most about ``block_bytes`` (checked by its summed
size). A larger benchmark makes more blocks, which the documents pass one after another, a few in one
stage (``BLOCKS_PER_STAGE``) and a written table between stages; no process holds more than one block.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is ``window`` consecutive words
of an item; a shorter item is one window; an item without words is none.

Defined cases: a null or empty text has no words and is never contaminated; null item ids count as
the item ""; repeated items count once; repeated documents are reported as often as they come; an
empty benchmark contaminates nothing; other columns are ignored by ``find_contamination`` and kept as
they are, whatever their names, by ``remove_contaminated``.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lonja.llm.common import word_bytes, written

BLOCKS_PER_STAGE = 4
#: What a scan knows of a document: hit stretches as start, end, start, end ..., items met, longest match.
STATE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())),
                      T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType()),
                      T.StructField("longest_item", T.StringType()), T.StructField("longest_start", T.LongType())])


class Benchmark:
    """Vocabulary, words and windows of one block of items.

    The items lie one after another in ``words``; a suffix is its first position there and its end.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        texts: dict[bytes, set[str]] = {}  # word numbers of an item -> ids of the items with these words
        self.window, self.depth, self.least = window, 1, window
        for item_id, text in items:
            words = word_bytes(text)
            if words:
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=">u4")
                texts.setdefault(ids.tobytes(), set()).add(item_id)
        self.words = np.frombuffer(b"".join(texts), dtype=">u4").astype(np.uint32)
        #: window -> the suffixes that start with it: position, end, ids of their items, word before (0: none)
        self.windows: dict[bytes, list[tuple[int, int, set[str], int]]] = defaultdict(list)
        start = 0
        for flat, owners in texts.items():
            end = start + len(flat) // 4
            size = min(window, end - start)
            self.depth, self.least = max(self.depth, size), min(self.least, size)
            for p in range(start, end - size + 1):
                at = 4 * (p - start)
                self.windows[flat[at:at + 4 * size]].append((p, end, owners, int(self.words[p - 1]) if p > start else 0))
            start = end
        for key, suffixes in self.windows.items():
            if len(suffixes) > 1:
                self.windows[key] = self._distinct(suffixes)

    def _distinct(self, suffixes: list[tuple[int, int, set[str], int]]) -> list[tuple[int, int, set[str], int]]:
        """Equal suffixes after the same word as one, with the ids of all."""
        out: dict[tuple, list] = defaultdict(list)
        for p, end, owners, before in suffixes:
            same = out[end - p, before, zlib.crc32(self.words[p:min(end, p + 64)]), zlib.crc32(self.words[max(p, end - 64):end])]
            for k, (q, last, others, _) in enumerate(same):
                if np.array_equal(self.words[p:end], self.words[q:last]):
                    same[k] = (q, last, others | owners, before)
                    break
            else:
                same.append((p, end, owners, before))
        return [x for same in out.values() for x in same]


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the ``depth`` words from there on, by doubling."""
    if len(words) == 0:
        return np.empty(0, np.int64)
    rank, step = words.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        following = np.zeros_like(rank)
        following[:-step] = rank[step:] + 1 if step < len(rank) else 0
        order = np.lexsort((following, rank))
        new = np.empty_like(rank)
        new[order] = np.cumsum(np.r_[0, (np.diff(rank[order]) != 0) | (np.diff(following[order]) != 0)])
        rank, step = new, step * 2
        if step >= depth or step >= len(rank) or rank[order[-1]] == len(rank) - 1:
            return order


def long_stretches(ids: np.ndarray, least: int) -> np.ndarray:
    """Positions inside stretches of at least ``least`` known words, each stretch followed by its end position."""
    edge = np.diff(np.r_[0, (ids > 0).astype(np.int8), 0])
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    keep = end - start >= least
    start, size = start[keep], end[keep] - start[keep] + 1
    if not len(size):
        return np.empty(0, np.int64)
    return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


class Shard:
    """Matches of a benchmark block in the concatenated words of some documents."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, bench: Benchmark):
        """``ids``: word numbers, 0 for unknown words and between documents; ``starts``: of the documents."""
        self.cover = np.zeros(len(ids) + 1, np.int32)
        self.items: dict[int, set[str]] = defaultdict(set)
        self.best: dict[int, tuple[int, str, int]] = {}
        place = long_stretches(ids, bench.least)
        words = np.where(place < len(ids), ids[np.minimum(place, len(ids) - 1)], 0) if len(place) else np.empty(0, ids.dtype)
        order = suffix_array(words, bench.depth)
        flat = words.astype(">u4").tobytes()
        for key, suffixes in bench.windows.items():
            n = len(key)
            prefix = lambda p, n=n: flat[4 * p:4 * p + n]
            low = bisect_left(order, key, key=prefix)
            high = bisect_right(order, key, lo=low, key=prefix)
            if low == high:
                continue
            at = order[low:high]
            where = place[at]
            np.add.at(self.cover, where, 1)
            np.add.at(self.cover, where + n // 4, -1)
            docs = np.searchsorted(starts, where, side="right") - 1
            hit = np.unique(docs).tolist()
            for p, end, owners, before in suffixes:
                for d in hit:
                    self.items[d] |= owners
                self._extend(words, at, where, docs, starts, bench.words[p:end], min(owners), before, n // 4)

    def _extend(self, words, at, where, docs, starts, suffix, owner, before, size) -> None:
        """Longest match of the suffix at each place where the match doesn't begin earlier."""
        fresh = np.ones(len(at), bool) if not before else (at == 0) | (words[np.maximum(at - 1, 0)] != before)
        at, where, docs = at[fresh], where[fresh], docs[fresh]
        length, alive = np.full(len(at), size), np.arange(len(at))
        for k in range(size, len(suffix)):
            alive = alive[at[alive] + k < len(words)]
            alive = alive[words[at[alive] + k] == suffix[k]]
            if not len(alive):
                break
            length[alive] = k + 1
        for d, n, w in zip(docs.tolist(), length.tolist(), (where - starts[docs]).tolist()):
            if d not in self.best or (-n, owner, w) < (-self.best[d][0], *self.best[d][1:]):
                self.best[d] = (n, owner, w)


def merged(a: list[int], b: list[int]) -> list[int]:
    out: list[list[int]] = []
    for s, e in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [x for pair in out for x in pair]


def scan_texts(texts: list[str | None], states: list[dict | None], bench: Benchmark, shard_words: int) -> list[dict]:
    """The state of every text after this block."""
    out, known, first = [], [], 0

    def flush() -> None:
        nonlocal first
        starts = np.cumsum([0, *(len(x) + 1 for x in known)])
        ids = np.zeros(starts[-1], np.uint32)
        for s, x in zip(starts, known):
            ids[s:s + len(x)] = x
        shard = Shard(ids, starts[:-1], bench)
        edge = np.diff(np.r_[0, (np.cumsum(shard.cover[:-1]) > 0).astype(np.int8), 0])
        start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        owner = np.searchsorted(starts, start, side="right") - 1
        spans: dict[int, list[int]] = defaultdict(list)
        for d, s, e in zip(owner.tolist(), start.tolist(), end.tolist()):
            spans[d] += [s - int(starts[d]), e - int(starts[d])]
        for d, x in enumerate(known):
            old = states[first + d] or {}
            n, item, at = shard.best.get(d, (0, None, None))
            if (old.get("longest") or 0) >= n:
                n, item, at = old.get("longest") or 0, old.get("longest_item"), old.get("longest_start")
            out.append({"n_words": len(x), "spans": merged(old.get("spans") or [], spans.get(d, [])),
                        "items": sorted(set(old.get("items") or []) | shard.items.get(d, set())),
                        "longest": n, "longest_item": item, "longest_start": at})
        first += len(known)
        known.clear()

    size, get = 0, bench.vocabulary.get
    for text in texts:
        words = word_bytes(text)
        known.append(np.fromiter(map(get, words, repeat(0)), np.uint32, len(words)))
        size += len(words)
        if size >= shard_words:
            flush()
            size = 0
    if known:
        flush()
    return out


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items, at most about ``block_bytes`` of text at once on the driver."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        yield [tuple(r) for r in items.filter(block == k).collect()]


def _scanned(df: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, shard_words: int, drop_text: bool, only_clean: bool) -> DataFrame:
    """``df`` (its text in column ``text``) with the state of each row in the last column ``state``."""
    spark, df = df.sparkSession, df.withColumn("state", F.lit(None).cast(STATE))
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string())),
                      ("longest", pa.int64()), ("longest_item", pa.string()), ("longest_start", pa.int64())])
    blocks = [spark.sparkContext.broadcast((items, window)) for items in benchmark_blocks(benchmark, block_bytes)]
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1

        def scan(batches: Iterator[pa.RecordBatch], block=block, last=last) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(*block.value)
            for batch in batches:
                texts, states = batch.column("text").to_pylist(), batch.column("state").to_pylist()
                states = scan_texts(texts, states, bench, shard_words)
                names = [n for n in batch.schema.names if n != "state" and not (last and drop_text and n == "text")]
                out = pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(states, kind)], names + ["state"])
                if last and only_clean:
                    out = out.filter(pa.array([not s["spans"] for s in states], pa.bool_()))
                yield out

        schema = T.StructType([f for f in df.schema.fields if not (last and drop_text and f.name == "text")])
        df = df.mapInArrow(scan, schema)
        if not last and k % BLOCKS_PER_STAGE == BLOCKS_PER_STAGE - 1:
            df = written(df, "scanned")
    return df


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 32 << 20, shard_words: int = 2_000_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans (word numbers:
    start, end, ...), longest_match (words), longest_item, longest_start (word number)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    s = lambda name: F.col(f"state.{name}")
    hit = F.aggregate(F.transform(s("spans"), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return _scanned(rows, benchmark, window, block_bytes, shard_words, True, False).select(
        "doc_id", s("n_words").alias("n_words"), hit.alias("n_hit"), F.size(s("items")).cast("long").alias("n_items"),
        F.sha2(F.array_join(s("items"), ","), 256).alias("items_sha256"), (F.size(s("spans")) > 0).alias("contaminated"),
        s("items").alias("items"), s("spans").alias("spans"), s("longest").alias("longest_match"),
        s("longest_item").alias("longest_item"), s("longest_start").alias("longest_start"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 32 << 20, shard_words: int = 2_000_000) -> DataFrame:
    """The documents without any hit, with all their columns."""
    names = docs.columns
    inner = ["text" if n == "text" else f"c{i}" for i, n in enumerate(names)]
    clean = _scanned(docs.toDF(*inner), benchmark, window, block_bytes, shard_words, False, True)
    return clean.select(*[F.col(a).alias(b) for a, b in zip(inner, names)])
