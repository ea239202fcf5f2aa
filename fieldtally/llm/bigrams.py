"""Katz's bigram model with every word and every pair as itself, keyed by 64-bit hashes.

The ``VOCABULARY`` most frequent words have short codes and figures that every task holds;
this only saves space and spreads hot keys, the scores do not depend on it. A pair whose
word has no code lies in the bucket of its word, where the word's count is the sum of its
pairs. A pair whose history has no code lies in the bucket of its history, with what the
backoff weight of that history needs. A pair with neither lies in both: its word's side
gives its count or the unigram, its history's side the factor or the weight, and the
logarithms add up. All other pairs are dealt by the pair, and their histories' figures are
held by every task. Pairs travel as packed arrays, a row for each task's part of a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .katz import BEGIN, DISCOUNTED, PER_BUCKET, RARE, Unigrams, _chunks, _last, _looked_up, _unigrams, discounts, word_counts
from .shingles import mixed

START = np.uint64(xxhash.xxh3_64_intdigest(b" "))  # before a text; no word holds a space
ODD = np.uint64(0x9E3779B97F4A7C15)
PACKED = "bucket int, kind int, chunk long, data binary"
WORD, HISTORY, COVER, WORD_TOKENS, HISTORY_TOKENS, ROWS = range(6)


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(h) * ODD + w)


def _blob(*arrays: np.ndarray) -> bytes:
    """The arrays with their kinds and lengths, packed; a few bytes more than what is in them."""
    head = [bytes([len(arrays)]), *(a.dtype.char.encode() + len(a).to_bytes(4, "little") for a in arrays)]
    raw = b"".join([*head, *(a.tobytes() for a in arrays)])
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _arrays(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = pa.decompress(blob[4:], int.from_bytes(blob[:4], "little"), codec="zstd", asbytes=True)
    out, at = [], 1 + 5 * raw[0]
    for i in range(1, at, 5):
        kind, n = np.dtype(chr(raw[i])), int.from_bytes(raw[i + 1:i + 5], "little")
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return tuple(out)


def _steps(rows: np.ndarray) -> np.ndarray:
    """Differences of ascending rows, which pack smaller."""
    steps = np.diff(rows, prepend=rows.dtype.type(0))
    return steps.astype(np.uint16) if not len(steps) or steps.max() < 1 << 16 else steps


def _from_steps(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.int64)


def _packed(rows: Iterable[tuple]) -> pa.RecordBatch:
    """rows: (bucket, kind, chunk, blob)"""
    rows = list(rows)
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["bucket", "kind", "chunk", "data"])


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("bucket", "kind", "data")))


@dataclass
class Pairs:
    """Pairs, or tokens with the one before; codes are RARE where a word has none."""

    h: np.ndarray
    w: np.ndarray
    h_code: np.ndarray
    w_code: np.ndarray
    n: np.ndarray  # counts, or the tokens' rows

    def take(self, at: np.ndarray) -> Pairs:
        return Pairs(self.h[at], self.w[at], self.h_code[at], self.w_code[at], self.n[at])

    def counted(self) -> Pairs:
        """Distinct pairs with the sums of ``n``, in the order of their codes, which packs best."""
        _, first, at = np.unique(pair_keys(self.h, self.w), return_index=True, return_inverse=True)
        n = np.bincount(at, self.n).astype(np.int32)
        del at
        order = np.argsort(self.h_code[first].astype(np.int32) << 16 | self.w_code[first], kind="stable")
        out = self.take(first[order])
        out.n = n[order]
        return out

    def blob(self) -> bytes:
        return _blob(self.h_code, self.h[self.h_code == RARE], self.w_code, self.w[self.w_code == RARE], self.n)

    def dealt(self, buckets: int, first: int = WORD) -> Iterator[tuple]:
        """(bucket, kind, pairs); kinds are ``first`` for words' sides and the next for histories'."""
        rare_h, rare_w = self.h_code == RARE, self.w_code == RARE
        by_word = np.where(rare_w, mixed(self.w), pair_keys(self.h, self.w))
        for kind, here, key in ((first, np.flatnonzero(rare_w | ~rare_h), by_word), (first + 1, np.flatnonzero(rare_h), mixed(self.h))):
            for bucket, at in _by_bucket(key[here], buckets):
                yield bucket, kind, self.take(here[at])


def _by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    of = (keys % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b]:edges[b + 1]]


@dataclass
class Codes:
    unigrams: Unigrams
    hashes: np.ndarray  # by code
    p: np.ndarray  # by code, of the unigram

    @classmethod
    def of(cls, u: Unigrams) -> Codes:
        hashes, p = np.zeros(BEGIN + 1, np.uint64), np.zeros(BEGIN + 1)
        hashes[u.codes], hashes[BEGIN] = u.hashes, START
        p[:len(u.counts)] = u.p(u.counts)
        return cls(u, hashes, p)

    def laid(self, words: list[np.ndarray]) -> Pairs:
        """The tokens of texts laid end to end; n is the text's place."""
        lengths = np.array([len(x) for x in words])
        w = np.concatenate(words)
        code = self.unigrams.code(w).astype(np.uint16)
        h, h_code = np.empty_like(w), np.empty_like(code)
        h[1:], h_code[1:] = w[:-1], code[:-1]
        starts = np.cumsum(lengths) - lengths
        h[starts], h_code[starts] = START, BEGIN
        return Pairs(h, w, h_code, code, np.repeat(np.arange(len(words), dtype=np.int32), lengths))

    def pairs(self, blobs: list[bytes]) -> Pairs:
        h_code, h_rest, w_code, w_rest, n = (np.concatenate(x) for x in zip(*map(_arrays, blobs)))
        h, w = self.hashes[h_code], self.hashes[w_code]
        h[h_code == RARE], w[w_code == RARE] = h_rest, w_rest
        return Pairs(h, w, h_code, w_code, n)

    def unigram(self, pairs: Pairs, rare: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """(unigram probability of each pair's word, count of each word without a code)."""
        at = pairs.w_code == RARE
        counts = _looked_up(rare, pairs.w[at])
        p = self.p[pairs.w_code]
        p[at] = self.unigrams.p(counts)
        return p, counts


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, n, len(found)).astype(np.int64)


def _rare_words(pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Words without a code and their counts; all of their pairs are in their bucket."""
    at = pairs.w_code == RARE
    return _summed(pairs.w[at], pairs.n[at])


def bigram_table(docs: DataFrame, codes, buckets: int) -> DataFrame:
    """A packed row for each bucket and side."""

    def gather(batches):
        for _, words in _chunks(batches):
            tokens = codes.value.laid(words)
            tokens.n = np.ones(len(tokens.n), np.int8)
            pairs = tokens.counted()
            del tokens
            yield _packed((b, kind, 0, p.blob()) for b, kind, p in pairs.dealt(buckets))

    def add_up(batches):
        now, blobs = None, []

        def one():
            return _packed([(*now, 0, codes.value.pairs(blobs).counted().blob())])

        for bucket, kind, data in _rows(batches):
            if (bucket, kind) != now and blobs:
                yield one()
                blobs = []
            now = bucket, kind
            blobs.append(data)
        if blobs:
            yield one()

    gathered = docs.select("text").mapInArrow(gather, PACKED)
    return gathered.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(add_up, PACKED)


def _kept(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    return d[np.minimum(n, DISCOUNTED + 1)] * n


def _factors(n: np.ndarray, kept: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By history, log10 of the factor of a seen pair's discounted count and of the backoff
    weight, from the history's count, what discounting keeps of it, and the unigram
    probability of all words seen after it. A history's probabilities sum to one."""
    free = 1 - covered
    left = np.where(free > 1e-12, np.maximum(1 - kept / n, 1 / (n + 1)), 0)
    weight = np.where(free > 1e-12, left / np.maximum(free, 1e-12), 1e-300)
    return np.log10((1 - left) / kept), np.log10(np.maximum(weight, 1e-300))


@dataclass
class Model:
    codes: Codes
    d: np.ndarray
    log_seen: np.ndarray  # by code of the history; 0 for one without a code
    log_backoff: np.ndarray

    def log_kept(self, counts: np.ndarray) -> np.ndarray:
        return np.log10(np.maximum(_kept(self.d, counts), 1e-300))


class Bucket:
    """One bucket's part of the tables, and what its tokens get from it."""

    def __init__(self, model: Model):
        self.model, self.table, self.rare, self.cover, self.histories = model, {}, None, [], None

    def add(self, kind: int, data: bytes) -> None:
        if kind == COVER:
            self.cover.append(_arrays(data))
            return
        pairs = self.model.codes.pairs([data])
        keys = pair_keys(pairs.h, pairs.w)
        order = np.argsort(keys)
        self.table[kind] = keys[order], pairs.n[order]
        if kind == WORD:
            self.rare = _rare_words(pairs)
        else:
            self.by_history = pairs

    def finish(self) -> None:
        """Factors and weights of the histories without a code."""
        pairs, m = self.by_history, self.model
        found, at = np.unique(pairs.h, return_inverse=True)
        covered = np.bincount(at, np.where(pairs.w_code == RARE, 0, m.codes.p[pairs.w_code]))
        for h, p in self.cover:  # what words without a code add
            np.add.at(covered, np.searchsorted(found, h), p)
        self.histories = found, *_factors(np.bincount(at, pairs.n), np.bincount(at, _kept(m.d, pairs.n)), covered)

    def by_words(self, tokens: Pairs) -> tuple[np.ndarray, np.ndarray]:
        """Points of each token, and the count of each word without a code. The history's
        figure is left out where the history has no code."""
        m = self.model
        counts = _looked_up(self.table.get(WORD), pair_keys(tokens.h, tokens.w))
        p, rare = m.codes.unigram(tokens, self.rare)
        seen = m.log_kept(counts) + m.log_seen[tokens.h_code]
        return np.where(counts > 0, seen, np.log10(np.maximum(p, 1e-300)) + m.log_backoff[tokens.h_code]), rare

    def by_histories(self, tokens: Pairs) -> np.ndarray:
        """The history's figure, and the word's where the word has a code."""
        m = self.model
        if self.histories is None and HISTORY in self.table:
            self.finish()
        counts = _looked_up(self.table.get(HISTORY), pair_keys(tokens.h, tokens.w))
        factor, weight = np.zeros(len(counts)), np.zeros(len(counts))  # a history never seen leaves the unigram
        if self.histories is not None:
            found, factors, weights = self.histories
            at = np.minimum(np.searchsorted(found, tokens.h), len(found) - 1)
            known = found[at] == tokens.h
            factor, weight = np.where(known, factors[at], 0), np.where(known, weights[at], 0)
        word = np.where(counts > 0, m.log_kept(counts), np.log10(np.maximum(m.codes.p[tokens.w_code], 1e-300)))
        return np.where(counts > 0, factor, weight) + np.where(tokens.w_code == RARE, 0, word)


def train(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame, int]:
    """The model of ``docs`` (text): its bounded part, the bigram table, what words without a
    code add to histories without one, and the number of buckets. The tables are written."""
    spark = docs.sparkSession
    codes = Codes.of(_unigrams(written(word_counts(docs), "lm-words")))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(codes.unigrams.total / PER_BUCKET))
    shared = spark.sparkContext.broadcast(codes)
    bigrams = written(bigram_table(docs, shared, buckets), "lm-bigrams")

    def low_counts(batches):
        total = np.zeros(DISCOUNTED + 2, np.int64)
        for _, kind, data in _rows(batches):
            _, _, w_code, _, n = _arrays(data)
            n = n if kind == WORD else n[w_code != RARE]  # the others are on both sides
            total += np.bincount(np.minimum(n, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[:DISCOUNTED + 2]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DISCOUNTED + 2)), pa.array(total)], ["r", "types"])

    d = discounts({r[0]: r[1] for r in bigrams.mapInArrow(low_counts, "r long, types long").groupBy("r").agg(F.sum("types")).collect()})

    def sums(batches):
        for _, _, data in _rows(batches):
            pairs = shared.value.pairs([data])
            p, _ = shared.value.unigram(pairs, _rare_words(pairs))
            coded = pairs.h_code != RARE
            h, at = np.unique(pairs.h_code[coded], return_inverse=True)
            columns = [np.bincount(at, x[coded], len(h)).astype(float) for x in (pairs.n, _kept(d, pairs.n), p)]
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), *map(pa.array, columns)], ["h", "n", "kept", "covered"])

    def cover(batches):
        for _, _, data in _rows(batches):
            pairs = shared.value.pairs([data])
            p, _ = shared.value.unigram(pairs, _rare_words(pairs))
            both = (pairs.h_code == RARE) & (pairs.w_code == RARE)
            h, p = pairs.h[both], p[both]
            yield _packed((b, COVER, 0, _blob(h[at], p[at])) for b, at in _by_bucket(mixed(h), buckets))

    by_word = bigrams.where(F.col("kind") == WORD)
    rows = by_word.mapInArrow(sums, "h long, n double, kept double, covered double").groupBy("h").agg(F.sum("n"), F.sum("kept"), F.sum("covered")).collect()
    # At most a row for each code.
    log_seen, log_backoff = np.zeros(BEGIN + 1), np.zeros(BEGIN + 1)
    if rows:
        h, n, kept, covered = (np.array(x) for x in zip(*rows))
        log_seen[h], log_backoff[h] = _factors(n, kept, covered)
    return Model(codes, d, log_seen, log_backoff), bigrams, by_word.mapInArrow(cover, PACKED), buckets


OWN = ("doc_id", "held_out", "known", "base")  # what a chunk's own row holds of its texts


def score(docs: DataFrame, model: Model, bigrams: DataFrame, cover: DataFrame, buckets: int) -> DataFrame:
    """Scores of (doc_id, held_out, text) rows, one for each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the codes
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = {"doc_id": f"array<{kind}>", "held_out": "array<boolean>", "known": "array<long>", "base": "array<double>"}
    own_schema = ", ".join(f"{c} {k}" for c, k in own.items())

    def spread(batches):
        task, made = TaskContext.get().partitionId(), 0
        codes = shared.value.codes
        for held, found in _chunks(batches, cut=True):
            tokens = codes.laid(found)
            coded = tokens.w_code != RARE
            row = tokens.n[coded]
            known = np.bincount(row, minlength=len(found))
            counts = codes.unigrams.counts[tokens.w_code[coded]] if len(row) else np.empty(0, np.int64)
            base = np.bincount(row, codes.unigrams.base(counts), len(found))
            chunk = task << 20 | made
            made += 1
            rows = []
            for b, k, p in tokens.dealt(buckets, WORD_TOKENS):
                p.n = _steps(p.n)
                rows.append((b, k, chunk, p.blob()))
            rows.append((chunk % buckets, ROWS, chunk, _blob(np.array([len(x) for x in found]))))
            one = _packed(rows)
            ids = pa.concat_arrays([b.column(0) for b in held])
            out = pa.concat_arrays([b.column(1) for b in held])
            extra = [_last(x, len(rows) - 1) for x in (ids, out, pa.array(known, pa.int64()), pa.array(base, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*one.columns, *extra], [*one.schema.names, *OWN])

    none = [F.lit(None).cast(k).alias(c) for c, k in own.items()]
    tables = bigrams.union(cover).select("*", *none)
    everything = tables.union(docs.select("doc_id", "held_out", "text").mapInArrow(spread, f"{PACKED}, {own_schema}"))
    dealt = everything.repartition("bucket").sortWithinPartitions("bucket", "kind")

    def look_up(batches):
        """Per packed row of tokens: the texts of its chunk that they are of, and sums."""
        codes = shared.value.codes
        now, here = None, None
        for batch in batches:
            out, places = [], []
            chunks = batch.column(batch.schema.names.index("chunk")).to_pylist()
            for i, (bucket, what, data) in enumerate(_rows([batch])):
                if bucket != now:
                    now, here = bucket, Bucket(shared.value)
                if what <= COVER:
                    here.add(what, data)
                    continue
                if what != ROWS:
                    tokens = codes.pairs([data])
                    tokens.n = _from_steps(tokens.n)
                    at, back = np.unique(tokens.n, return_inverse=True)
                    if what == WORD_TOKENS:
                        points, rare = here.by_words(tokens)
                        rare_at, rare_back = np.unique(tokens.n[tokens.w_code == RARE], return_inverse=True)
                        more = [np.bincount(rare_back, x, len(rare_at)) for x in (codes.unigrams.base(rare), rare > 0)]
                        data = _blob(_steps(at), np.bincount(back, points), _steps(rare_at), more[0], more[1].astype(np.int32))
                    else:
                        data = _blob(_steps(at), np.bincount(back, here.by_histories(tokens)))
                out.append((chunks[i], data))
                places.append(i if what == ROWS else None)
            take = pa.array(places, pa.int64())
            columns = [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(batch.schema.names.index(c)).take(take) for c in OWN)], ["chunk", "data", *OWN])

    def add_up(batches):
        """A row for each text of a chunk, from the chunk's sums."""
        sums = None
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        batch_of = lambda x: pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in x], names)
        for batch in batches:
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            array = lambda c, i: columns[c][i].values.to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                found = _arrays(columns["data"][i].as_py())
                if columns["held_out"][i].is_valid:  # the chunk's own row comes first
                    if sums is not None:
                        yield batch_of(sums)
                    ids, held = (columns[c][i].values for c in ("doc_id", "held_out"))
                    known, base = array("known", i).astype(np.int64), array("base", i).copy()
                    points = np.zeros(len(ids))
                    sums = [ids, held, pa.array(found[0].astype(np.int64)), known, base, points]
                    continue
                points[_from_steps(found[0])] += found[1]
                if len(found) > 2:
                    at = _from_steps(found[2])
                    base[at] += found[3]
                    known[at] += found[4]
        if sums is not None:
            yield batch_of(sums)

    by_chunk = dealt.mapInArrow(look_up, f"chunk long, data binary, {own_schema}").repartition("chunk").sortWithinPartitions("chunk", F.col("held_out").isNull())
    out = by_chunk.mapInArrow(add_up, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.codes.unigrams.total).cast("long").alias("train_tokens"), "base_score", "score")
