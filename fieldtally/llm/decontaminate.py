"""Benchmark decontamination by greedy string tiling.

Benchmark items are a stated query set: they go to the tasks in blocks of bounded size.
Documents that share a run of ``TILE`` tokens with the block (a seed) come back with their
tokens; Spark joins their seeds to the items' seeds, and only pairs that could reach the
threshold are tiled: running Karp-Rabin marks the longest common runs that do not overlap,
shorter and shorter ones, in any order. The share of an item's tokens under tiles decides,
so passages that were cut up and reordered are caught as well. Items too short for that are
their own only seed and tile: they are found where they stand as a whole.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, table, texts, written
from .shingles import hashed_words, windows

TILE = 5  # the least tokens of a tile
SHORT = 8  # items with fewer tokens are matched whole
PAIRS = 1 << 20  # pairs of equal windows looked at at once
BLOCK_BYTES = 16 << 20  # of benchmark texts that go to every task at once
# Tokens are runs of ASCII letters and digits and of non-ASCII characters; a character of a
# script without spaces (Thai, Lao, Burmese, Khmer, kana, ideographs) is a token of its own.
_SPACED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_UNSPACED = re.compile(
    rb"(?:\xe0[\xb8-\xbb]|\xe1[\x80-\x82\x9e\x9f]|\xe2[\xba-\xbf]|[\xe3-\xe9][\x80-\xbf]|\xef[\xa4-\xab])[\x80-\xbf]|\xf0[\xa0-\xaf][\x80-\xbf]{2}")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def tokens(text: bytes) -> np.ndarray:
    spaced = text.lower().translate(_SPACED)
    return hashed_words((spaced if text.isascii() else _UNSPACED.sub(rb" \g<0> ", spaced)).split())


def width(item_tokens: int) -> int:
    """Tokens of an item's seeds, and of its least tile."""
    return item_tokens if item_tokens < SHORT else TILE


class _Rolling:
    """Karp-Rabin hashes of windows of any length, from prefix sums modulo 2^64."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * np.cumprod(np.full(n, _BASE)), out=self.sums[1:])
        self.back = np.cumprod(np.full(n, _INVERSE))

    def windows(self, length: int) -> np.ndarray:
        return (self.sums[length:] - self.sums[:-length]) * self.back[:len(self.sums) - length]


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of windows without a marked token."""
    sums = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(sums[length:] == sums[:-length])


def _run_lengths(item, text, in_item, in_text, i: np.ndarray, t: np.ndarray) -> np.ndarray:
    """From each pair of places on, the equal unmarked tokens."""
    n, live = np.zeros(len(i), np.int64), np.arange(len(i))
    while len(live) > 64:
        a, b = i[live] + n[live], t[live] + n[live]
        inside = (a < len(item)) & (b < len(text))
        live, a, b = live[inside], a[inside], b[inside]
        live = live[(item[a] == text[b]) & ~in_item[a] & ~in_text[b]]
        n[live] += 1
    for x in live:
        a, b = i[x] + n[x], t[x] + n[x]
        most = min(len(item) - a, len(text) - b)
        stop = (item[a:a + most] != text[b:b + most]) | in_item[a:a + most] | in_text[b:b + most]
        n[x] += np.argmax(stop) if stop.any() else most
    return n


def _matches(item, text, in_item, in_text, rolling_item, rolling_text, length: int) -> list[tuple[int, int, int]]:
    """(-n, i, t) of the unmarked common runs of ``length`` or more that no longer one contains."""
    here, there = _free(in_item, length), _free(in_text, length)
    if not len(here) or not len(there):
        return []
    a, b = rolling_item.windows(length)[here], rolling_text.windows(length)[there]
    order = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    there, lo, n = there[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    found, before = [], np.concatenate([[0], np.cumsum(n)])
    cuts = np.unique(np.searchsorted(before, np.arange(0, before[-1], PAIRS), "right") - 1)
    for x, y in zip(cuts, [*cuts[1:], len(n)]):
        at = np.arange(before[x], before[y]) - np.repeat(before[x:y], n[x:y]) + np.repeat(lo[x:y], n[x:y])
        i, t = here[order[at]], np.repeat(there[x:y], n[x:y])
        inner = (i > 0) & (t > 0)
        inner &= (item[i - 1] == text[t - 1]) & ~in_item[i - 1] & ~in_text[t - 1]
        i, t = i[~inner], t[~inner]  # others are parts of longer runs that start earlier
        runs = _run_lengths(item, text, in_item, in_text, i, t)
        found += [(-k, p, q) for k, p, q in zip(runs.tolist(), i.tolist(), t.tolist()) if k >= length]
    return found


def tiles(item: np.ndarray, text: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length), always the longest common run of
    unmarked tokens next (the earliest of equals), until none of ``least`` tokens is left."""
    found: list[tuple[int, int, int]] = []
    if min(len(item), len(text)) < least or not least:
        return found
    in_item, in_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    rolling = _Rolling(item), _Rolling(text)
    length = max(least, min(len(item), len(text)))
    while True:
        heap = _matches(item, text, in_item, in_text, *rolling, length)
        heapq.heapify(heap)
        while heap:
            n, i, t = heapq.heappop(heap)
            marked = in_item[i:i - n] | in_text[t:t - n]
            if not marked.any():
                in_item[i:i - n] = in_text[t:t - n] = True
                found.append((i, t, -n))
                continue
            # What is left of a run that was cut short takes its turn again.
            edges = np.flatnonzero(np.diff(np.concatenate([[True], marked, [True]]).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if b - a >= length:
                    heapq.heappush(heap, (a - b, i + a, t + a))
        if length == least:
            return found
        length = max(least, length // 2)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` and benchmark item of which it holds at least
    ``coverage``: doc_id, item_id, item_tokens, covered_tokens, n_tiles, longest_tile,
    coverage, h (a hash of the row's id and text).

    Null or empty texts hold nothing, and nothing holds an item without tokens. Items of fewer
    than 8 tokens are held where they stand whole and in order. Null ids stay null; repeated rows and items each give their rows; either
    table empty gives no row; further columns are ignored.
    """
    spark = ready(docs.sparkSession)
    src = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[id_col], docs[text_col]).alias("h"), docs[text_col].alias("text")).where("text is not null")
    items = benchmark.select(benchmark[item_col].alias("item_id"), benchmark[item_text_col].alias("text")).where("text is not null")
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "benchmark-items")
    # An item weighs more than its text, so that very many short ones are blocks as well.
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    found = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        pairs = _tiled(spark, src, part, coverage)
        found = pairs if found is None else found.union(pairs)
    return found


def _tiled(spark: SparkSession, src: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    # A block's items, bounded by BLOCK_BYTES of text.
    of = {r["item"]: tokens(r["text"].encode()) for r in items.select("item", "text").collect()}
    of = {k: v for k, v in of.items() if len(v)}
    seed_rows = [(int(s), k, len(v), width(len(v))) for k, v in of.items() for s in np.unique(windows(v, width(len(v)))).view(np.int64)]
    widths = sorted({w for *_, w in seed_rows})
    seeds = np.unique(np.array([s for s, *_ in seed_rows], np.int64)) if seed_rows else np.empty(0, np.int64)
    shared, known = spark.sparkContext.broadcast(of), spark.sparkContext.broadcast(seeds)

    def seeded(batches):
        at_hand = known.value
        for batch in batches:
            rows, words, hits = [], [], []
            for i, text in enumerate(texts(batch) if len(at_hand) else ()):
                found = tokens(text)
                runs = np.concatenate([windows(found, w) for w in widths]).view(np.int64)
                at = np.minimum(np.searchsorted(at_hand, runs), len(at_hand) - 1)
                hit = np.unique(runs[at_hand[at] == runs])
                if len(hit):
                    rows.append(i)
                    words.append(found.view(np.int64))
                    hits.append(hit)
            take = pa.array(rows, pa.int32())
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(words, lists), pa.array(hits, lists)], ["doc_id", "h", "words", "seeds"])

    kind = src.schema["doc_id"].dataType.simpleString()
    near = src.mapInArrow(seeded, f"doc_id {kind}, h long, words array<long>, seeds array<long>")
    near = written(near.withColumn("row", F.monotonically_increasing_id()), "benchmark-near")
    of_items = spark.createDataFrame(seed_rows, "seed long, item long, item_tokens int, width int")
    pairs = near.select("row", F.explode("seeds").alias("seed")).join(F.broadcast(of_items), "seed")  # bounded with the block
    pairs = pairs.groupBy("row", "item", "item_tokens", "width").agg(F.count(F.lit(1)).alias("n"))
    # Each seed covers at most its width; repeated runs of an item count once.
    repeats = {k: len(v) - width(len(v)) + 1 - len(np.unique(windows(v, width(len(v))))) for k, v in of.items()}
    extra = spark.createDataFrame(list(repeats.items()), "item long, extra int")
    pairs = pairs.join(F.broadcast(extra), "item").where((F.col("n") + F.col("extra")) * F.col("width") >= F.lit(coverage) * F.col("item_tokens"))
    work = near.select("doc_id", "h", "row", "words").join(pairs.select("row", "item"), "row").select("doc_id", "h", "item", "words")

    def tile(batches):
        for batch in batches:
            items_here, words = batch.column(2).to_pylist(), batch.column(3)
            out = []
            for i, k in enumerate(items_here):
                item = shared.value[k]
                laid = tiles(item, words[i].values.to_numpy(zero_copy_only=False).view(np.uint64), width(len(item)))
                out.append((len(item), sum(n for *_, n in laid), len(laid), max((n for *_, n in laid), default=0)))
            numbers = [pa.array([r[c] for r in out], pa.int64()) for c in range(4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), *numbers], ["doc_id", "h", "item", "item_tokens", "covered_tokens", "n_tiles", "longest_tile"])

    laid = work.mapInArrow(tile, f"doc_id {kind}, h long, item long, item_tokens long, covered_tokens long, n_tiles long, longest_tile long")
    share = F.col("covered_tokens") / F.col("item_tokens")
    return laid.withColumn("coverage", share).where(F.col("coverage") >= coverage).join(F.broadcast(items.select("item", "item_id")), "item").select(
        "doc_id", "item_id", "item_tokens", "covered_tokens", "n_tiles", "longest_tile", "coverage", "h")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item. Null and
    empty texts hold none and stay; repeated rows stay or go together."""
    bad = contaminated(docs, benchmark, coverage, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("h").alias("_bad")).distinct()
    same = (F.xxhash64(docs[id_col], docs[text_col]) == F.col("_bad")) & docs[id_col].eqNullSafe(F.col("_id"))
    return docs.join(written(bad, "benchmark-bad"), same, "left_anti")


def op2_greedy_tiling(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("h")
