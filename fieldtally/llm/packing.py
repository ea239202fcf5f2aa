"""Best-fit packing of token sequences, bulk-synchronous.

Texts become token ids in Arrow batches; documents above the capacity are cut. Pieces are
range-sorted by length in Spark and ranked within their length. Pieces of one length are
interchangeable, and so are sequences with one gap, so the sweeps run over runs: at most
``capacity`` lengths of pieces, and gaps held as contiguous sequence numbers. In a round,
all pieces of a size band look for their successor gap (the smallest that holds them), one
piece to a gap, conflicts going by rank; gaps shrink and the round repeats. The rounds run
on the driver over those counts, which the capacity bounds and not the data; the matched
runs are joined back to the ranked pieces.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, ready, table, texts, written
from .tokens import tokenizer, vocabulary

# A space followed by more white space: there the tokenizer's pre-tokens may span words.
UNEVEN = re.compile(rb" (?:[\s]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2[\x80\x81]|\xe3\x80\x80)| \Z")
# Characters from U+0250 on, and what may begin a special string, go to the tokenizer itself.
BEYOND = re.compile(rb"[\xca-\xff]|\xc9[\x90-\xbf]|<\|")
SPACED = re.compile(rb"^[^ ]+| [^ ]*")


@functools.lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str | None):
    """text bytes -> ids as little-endian unsigned 32-bit bytes, equal to the tokenizer's.

    With ranks, texts of characters for which both libraries cut alike go to the faster one
    as they are. In other texts only the words with further characters go to the tokenizer:
    every pre-token of the byte-level pattern starts at the last space before a word, so the
    cut is exact where a space is followed by a word. Uneven ones go to it whole.
    """

    def library(data: bytes) -> bytes:
        ids = tokenizer(json_path).encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    if not ranks_path:
        return library
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(data: bytes) -> bytes:
        return np.array(fast.encode_ordinary(data.decode("utf-8", "replace")), dtype="<u4").tobytes()

    def encode(data: bytes) -> bytes:
        if not BEYOND.search(data):
            return plain(data)
        if UNEVEN.search(data):
            return library(data)
        runs = itertools.groupby(SPACED.findall(data), lambda word: BEYOND.search(word) is None)
        return b"".join((plain if even else library)(b"".join(words)) for even, words in runs)

    return encode


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str | None, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of every row's ids and ``end_id``: doc_id, piece, start, length, ids_crc32."""

    def cut(batches):
        encode = encoder(json_path, ranks_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out = defaultdict(list)
            for row, text in enumerate(texts(batch)):
                data = encode(text) + end
                n = len(data) // 4
                first = n % capacity or capacity
                bounds = [0, *range(min(first, n), n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    out["row"].append(row)
                    out["piece"].append(piece)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    part = data[4 * a:4 * b]
                    out["crc"].append(zlib.crc32(part))
                    if keep_ids:
                        out["ids"].append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(out["row"], pa.int32())), pa.array(out["piece"], pa.int32())]
            columns += [pa.array(out[c], pa.int64()) for c in ("start", "length", "crc")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.mapInArrow(cut, schema)


def ranked_by_length(pieces: DataFrame) -> DataFrame:
    """Adds ``rank``, 0-based within the length, by a range sort: a length that holds a
    third of all pieces is dealt over many partitions."""
    spark = pieces.sparkSession
    ties = [F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("piece")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("length").desc(), *ties]
    ranged = pieces.repartitionByRange(n, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    ranged = written(ranged.withColumn("part", F.shiftright(at, 33)).withColumn("at", at), "packing-sorted")
    # In a sorted partition a length is one stretch: about a row per partition and per length.
    stretches = ranged.groupBy("part", "length").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    stretches = stretches.withColumn("base", so_far - F.col("n")).select("part", "length", "first", "base")
    return ranged.join(stretches, ["part", "length"]).withColumn("rank", F.col("base") + F.col("at") - F.col("first")).drop("part", "at", "first", "base")


def match_rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset) from how many pieces each
    length has.

    Band by band from the longest (a band ends at half its longest), a round lets each
    open gap take one piece: gaps and pieces are walked from large to small with the gaps
    passed so far stacked, so a piece's successor is the smallest open gap that holds it,
    and among equals rank decides. When none fits, the longest of the band's rest open as
    many sequences as that rest needs by volume, and rounds go on.
    """
    rest = {length: n for length, n in counts.items() if n > 0}
    taken: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    runs, sequences = [], 0

    def put(length: int, n: int, sequence: int, gap: int) -> None:
        runs.append((length, taken[length], n, sequence, capacity - gap))
        taken[length] += n
        rest[length] -= n
        if not rest[length]:
            del rest[length]
        if gap > length:
            new[gap - length].append((sequence, n))

    while rest:
        floor = max(rest) // 2
        while band := sorted((x for x in rest if x > floor), reverse=True):
            new: dict[int, list[tuple[int, int]]] = defaultdict(list)
            stack: list[tuple[int, int, int]] = []
            open_gaps, matched = sorted(gaps, reverse=True), False
            at = 0
            for length in band:
                while at < len(open_gaps) and open_gaps[at] >= length:
                    stack += [(open_gaps[at], s, n) for s, n in gaps.pop(open_gaps[at])]
                    at += 1
                while stack and rest.get(length):
                    gap, s, n = stack.pop()
                    n_here = min(n, rest[length])
                    if n > n_here:
                        stack.append((gap, s + n_here, n - n_here))
                    put(length, n_here, s, gap)
                    matched = True
            for gap, s, n in stack:
                gaps[gap].append((s, n))
            if not matched:
                left = -(-sum(x * rest[x] for x in band) // capacity)
                for length in band:
                    n = min(left, rest[length])
                    if n:
                        put(length, n, sequences, capacity)
                        sequences, left = sequences + n, left - n
            for gap, more in new.items():
                gaps[gap] += more
    return runs


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, end_id: int = 2, capacity: int = 1024, keep_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ``ids`` if asked for).

    A null or empty text is its end id alone. Null ids, repeated rows and ties are packed
    like other rows; an empty table gives no row; further columns are ignored. A document
    longer than the capacity is cut so that only its first piece is shorter.
    ``ranks_path`` may name the same vocabulary as ranks; it only saves time.
    """
    spark = ready(docs.sparkSession)
    pieces = written(token_pieces(only(docs, id_col, text_col), json_path, ranks_path, end_id, capacity, keep_ids), "packing-pieces")
    # One number per length, at most ``capacity`` of them.
    counts = {int(r[0]): r[1] for r in pieces.groupBy("length").count().collect()}
    runs = spark.createDataFrame(
        match_rounds(counts, capacity) or [(0, 0, 0, 0, 0)], "length long, from_rank long, n long, sequence long, offset long")
    ranked = ranked_by_length(pieces)
    # The runs grow with the capacity only.
    joined = ranked.join(F.broadcast(runs), "length").where(F.col("rank").between(F.col("from_rank"), F.col("from_rank") + F.col("n") - 1))
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), "offset",
        *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from rows with ``ids``: sequence_id, input_ids and
    the lengths of their pieces. A sequence holds at most ``capacity`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("input_ids"), F.transform("parts.ids", lambda x: F.size(x)).alias("lengths"))


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
