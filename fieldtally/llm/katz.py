"""Language-model scores by Katz backoff over bigrams.

Counts are Good-Turing discounted; what discounting frees goes to the shorter history,
with backoff weights that make every history's probabilities sum to one. The last step is
the unigram, whose freed mass is the unknown word's.

Scores come from ``bigrams``, where every word and every pair is counted as itself. Here
are the counts of words and the discounts that it uses.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, table, texts, written
from .shingles import hashed_words, mixed

VOCABULARY = 65_533  # words with codes
RARE, BEGIN = 65_533, 65_534  # codes of all other words, and of a text's start
END = np.uint64(xxhash.xxh3_64_intdigest(b""))  # no word is empty
DISCOUNTED = 5  # counts up to this are discounted
CHUNK = 300_000  # tokens that a task gathers before it packs them
PER_BUCKET = 1_000_000  # training tokens for each bucket


def discounts(times: dict[int, int]) -> np.ndarray:
    """Katz's factors d[r] for r up to DISCOUNTED (1 beyond, at index DISCOUNTED + 1), from how
    many types have each count. Where Good-Turing gives none in (0, 1), half a count goes."""
    n = [0, *(times.get(r, 0) for r in range(1, DISCOUNTED + 2))]
    d = np.ones(DISCOUNTED + 2)
    tail = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1] if n[1] else 1.0
    for r in range(1, DISCOUNTED + 1):
        turing = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        katz = (turing - tail) / (1 - tail) if tail < 1 else 0.0
        d[r] = katz if 0 < katz < 1 else (r - 0.5) / r
    return d


@dataclass
class Unigrams:
    """Counts of the vocabulary's words and the figures of the rest."""

    hashes: np.ndarray  # sorted
    codes: np.ndarray
    counts: np.ndarray  # by code
    total: int
    types: int
    d: np.ndarray
    scale: float
    unknown: float  # probability of all unseen words together

    def p(self, count: np.ndarray) -> np.ndarray:
        """Probability of a word seen ``count`` times; of the unknown word at 0."""
        seen = self.scale * self.d[np.minimum(count, DISCOUNTED + 1)] * count / max(1, self.total)
        return np.where(count > 0, seen, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1.0) / (self.total + self.types + 1))

    def code(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(words), RARE, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.codes[at], RARE)


def _unigrams(words: DataFrame) -> Unigrams:
    total, types = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    times = {r[0]: r[1] for r in words.where(F.col("c") <= DISCOUNTED + 1).groupBy("c").count().collect()}
    top = words.orderBy(F.col("c").desc(), "w").limit(VOCABULARY).collect()  # bounded by VOCABULARY
    hashes = np.array([r["w"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    d = discounts(times)
    freed = sum(times.get(r, 0) * r * (1 - d[r]) for r in range(1, DISCOUNTED + 1)) / max(1, total)
    unknown = max(freed, 1 / (total + 1))
    scale = (1 - unknown) / (1 - freed) if freed < 1 else 0.0
    return Unigrams(hashes[order], order.astype(np.int64), np.array([r["c"] for r in top], np.int64), total, types, d, scale, unknown)


def _chunks(batches, cut: bool = False) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches with their texts' word hashes (each ended by END), CHUNK tokens at a time;
    with ``cut``, large batches are cut between texts."""
    held, words, n = [], [], 0
    for batch in batches:
        start = 0
        for i, text in enumerate(texts(batch), 1):
            found = np.append(hashed_words(text.lower().split()), END)
            words.append(found)
            n += len(found)
            if n >= CHUNK and (cut or i == batch.num_rows):
                yield [*held, batch.slice(start, i - start)], words
                held, words, n, start = [], [], 0, i
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield held, words


def word_counts(docs: DataFrame) -> DataFrame:
    """(w: hash of the word, c) over the texts' words and ends."""

    def count(batches):
        for _, words in _chunks(batches):
            w, c = np.unique(np.concatenate(words), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c, pa.int64())], ["w", "c"])

    return docs.select("text").mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _last(values: pa.Array, before: int) -> pa.ListArray:
    """A list column that is null but for its last row, which holds ``values``."""
    return pa.ListArray.from_arrays(pa.array([0] * (before + 1) + [len(values)], pa.int32()), values)


def _looked_up(held: tuple[np.ndarray, np.ndarray] | None, asked: np.ndarray) -> np.ndarray:
    if held is None or not len(held[0]):
        return np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(held[0], asked), len(held[0]) - 1)
    return np.where(held[0][at] == asked, held[1][at], 0)


def score_held_out(docs: DataFrame, parts: int = 7, out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score. Rows whose crc32(id as text) mod ``parts`` is ``out`` are not learnt from.

    A null or empty text is its end alone. A null id is learnt from; repeated rows are
    learnt from and scored each; an empty table gives no row; further columns are ignored.
    """
    from . import bigrams  # it uses the counts above

    ready(docs.sparkSession)
    held = F.coalesce(F.pmod(F.crc32(docs[id_col].cast("string")), F.lit(parts)) == out, F.lit(False))
    src = docs.select(docs[id_col].alias("doc_id"), held.alias("held_out"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return bigrams.score(src, *bigrams.train(src.where("not held_out")))


def op3_katz_backoff(spark: SparkSession, folder: str) -> DataFrame:
    return score_held_out(table(spark, folder, "documents"))
