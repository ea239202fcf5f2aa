"""Fill-in-the-middle: documents cut at two token boundaries and put in another order.

A text's boundaries are a compressed set in the roaring manner: one container for each
65,536 offsets, held as an array, a bitmap or runs, whichever is smallest, with cumulative
cardinalities. The k-th boundary is found by a search over those and a select inside one
container; two selects give both cuts.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, ready, table, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
SPAN = 1 << 16  # offsets in a container
BITS_SET = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Array:
    """The offsets themselves, 2 bytes each."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, rank: int) -> int:
        return int(self.low[rank])


class Bitmap:
    """A bit per offset, 8 KB, with the number of bits before each byte."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, bool)
        bits[low] = True
        self.bytes = np.packbits(bits, bitorder="little")
        self.before = np.concatenate(([0], np.cumsum(BITS_SET[self.bytes], dtype=np.int64)))

    def select(self, rank: int) -> int:
        byte = int(np.searchsorted(self.before, rank, side="right")) - 1
        here = np.flatnonzero(np.unpackbits(self.bytes[byte:byte + 1], bitorder="little"))
        return byte * 8 + int(here[rank - self.before[byte]])


class Runs:
    """First offset of each stretch without holes, with the offsets before it, 4 bytes each."""

    def __init__(self, low: np.ndarray):
        at = np.concatenate(([0], np.flatnonzero(np.diff(low) != 1) + 1))
        self.first, self.before = low[at].astype(np.uint16), at.astype(np.uint16)

    def select(self, rank: int) -> int:
        run = int(np.searchsorted(self.before, rank, side="right")) - 1
        return int(self.first[run]) + rank - int(self.before[run])


def container(low: np.ndarray) -> Array | Bitmap | Runs:
    """The smallest form of the sorted offsets of one span."""
    runs = 1 + np.count_nonzero(np.diff(low) != 1)
    size, kind = min((4 * runs, 0), (2 * len(low), 1), (SPAN // 8, 2))
    return (Runs, Array, Bitmap)[kind](low)


class BoundarySet:
    """A sorted set of offsets without repeats; ``select(k)`` is the k-th from 0."""

    def __init__(self, offsets: np.ndarray):
        high = offsets // SPAN
        starts = np.concatenate(([0], np.flatnonzero(np.diff(high)) + 1)) if len(offsets) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(offsets))
        self.base = high[starts] * SPAN
        self.containers = [container(offsets[a:b] - base) for a, b, base in zip(starts, ends, self.base)]
        self.before, self.size = starts, len(offsets)

    def __len__(self) -> int:
        return self.size

    def select(self, rank: int) -> int:
        at = int(np.searchsorted(self.before, rank, side="right")) - 1
        return int(self.base[at]) + self.containers[at].select(rank - int(self.before[at]))


def boundaries(data: bytes) -> np.ndarray:
    """Byte offsets of a text's begin and of each token's end. A token is a word with the
    white space before it, or white space that ends the text. White space is ASCII, so
    these are borders of characters too."""
    if not data:
        return np.zeros(1, np.int64)
    blank = BLANK[np.frombuffer(data, np.uint8)]
    return np.concatenate(([0], np.flatnonzero(~blank[:-1] & blank[1:]) + 1, [len(data)]))


def characters(data: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


def draws(doc_id, seed: int) -> list[int]:
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(said[i:i + 8], 16) for i in range(0, 32, 8)]


def rearranged(doc_id, data: bytes, seed: int, percent: int, spm_percent: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output bytes) of one text."""
    found = BoundarySet(boundaries(data))
    n, (h1, h2, h3, h4) = len(found) - 1, draws(doc_id, seed)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not data or h3 % 100 >= percent or any(m in data for m in marks):
        return n, "plain", None, None, data
    a, b = sorted((found.select(h1 % (n + 1)), found.select(h2 % (n + 1))))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = marks
    if h4 % 100 < spm_percent:
        return n, "spm", characters(prefix), characters(middle), b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", characters(prefix), characters(middle), b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n (tokens), form, prefix_chars, middle_chars, output.

    The id decides form and cuts, so equal rows come out equal and reruns agree. A null or
    empty text and one that holds a mark stay plain, as do those beyond ``percent``. A null
    id draws as an empty one; an empty table gives no row; further columns are ignored.
    """
    ready(docs.sparkSession)

    def cut(batches):
        for batch in batches:
            out = defaultdict(list)
            for doc_id, data in zip(batch.column(0).to_pylist(), texts(batch)):
                for name, value in zip(("n", "form", "prefix", "middle", "output"), rearranged(doc_id, data, seed, percent, spm_percent)):
                    out[name].append(value)
            columns = [batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["form"], pa.string()),
                       pa.array(out["prefix"], pa.int64()), pa.array(out["middle"], pa.int64()), pa.array(out["output"], pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    src = only(docs, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from."""

    def until(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, 1)

    def after(mark: str) -> Column:
        return F.substring_index(output, mark, -1)

    prefix = F.when(form == "psm", until(after(PREFIX), SUFFIX)).otherwise(until(after(PREFIX), MIDDLE))
    suffix = F.when(form == "psm", until(after(SUFFIX), MIDDLE)).otherwise(until(after(SUFFIX), PREFIX))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, after(MIDDLE), suffix))


def op13_boundary_sets(spark: SparkSession, folder: str) -> DataFrame:
    done = fill_in_middle(table(spark, folder, "documents"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


# The same contract from lists of tokens; restored_sha256 is that of the text itself.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
e AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
f AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(u[greatest(c1, c2) + 1:], '') AS s
  FROM e)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""
