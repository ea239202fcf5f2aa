"""Near-duplicates by MinHash with tensored banding.

Two small collections of m sub-keys are made, each sub-key from r minwise values; a table
key is a pair of one from either, so m * m tables cost only 2 * m * r minwise values. Two
texts meet if they share a sub-key of both collections. Sub-keys that one text alone has
are dropped before pairing, which loses nothing. With m = 10 and r = 2, a pair at
similarity 0.85 is missed with a chance of 6e-6 (0.8: 8e-5).

Texts with equal shingle sets are one class, so exact copies are never paired. Every link
is confirmed on full sets, in blocks of a bounded number of sets: first each class with the
leaders of its buckets, then, where a bucket still spans several components, all classes
of such a family block by block, leaving out blocks that are one component already. Tasks
return spanning links of their block, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, table, texts, written
from .components import components
from .shingles import minima, mixed, shingle_set

COLLECTION = 10  # sub-keys in each of the two collections
PER_KEY = 2  # minwise values in a sub-key
BLOCK = 256  # classes in a block, less if their sets are long
BLOCK_SHINGLES = 2_000_000


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    def sign(batches):
        salt = np.arange(2 * COLLECTION, dtype=np.uint64) << np.uint64(56)
        for batch in batches:
            n, content, keys = [], [], []
            for text in texts(batch):
                shingles = shingle_set(text, width)
                n.append(len(shingles))
                content.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                if len(shingles):
                    low = minima(shingles, 2 * COLLECTION * PER_KEY, 1).reshape(2 * COLLECTION, PER_KEY)
                    key = mixed(low[:, 0] + np.uint64(3) * mixed(low[:, 1]) + salt)
                    keys.append(key.view(np.int64))
                else:
                    keys.append(np.empty(0, np.int64))
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            offsets = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(content, pa.binary()), pa.ListArray.from_arrays(offsets, flat)],
                ["doc_id", "h", "n", "content", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"doc_id {kind}, h long, n long, content binary, keys array<long>").withColumn("row", F.monotonically_increasing_id())


def _table_keys(reps: DataFrame) -> DataFrame:
    """(cid, bucket) of every table key that two or more classes share."""
    sub = reps.select("cid", F.posexplode("keys").alias("at", "key"))
    shared = sub.groupBy("key").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("key")
    kept = sub.join(shared, "key")
    first = F.col("at") < COLLECTION
    sides = kept.groupBy("cid").agg(F.collect_list(F.when(first, F.col("key"))).alias("a"), F.collect_list(F.when(~first, F.col("key"))).alias("b"))
    pairs = sides.select("cid", "b", F.explode("a").alias("a")).select("cid", "a", F.explode("b").alias("b"))
    return pairs.select("cid", F.xxhash64("a", "b").alias("bucket"))


def links(sets: list[np.ndarray], groups: list[int], percent: int) -> Iterator[tuple[int, int]]:
    """Spanning links (positions) among sets of different groups with
    100 * intersection >= percent * union."""
    k = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if k == 2:
        common = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
    else:
        values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(k), sizes)
        shared = times > 1
        number = np.cumsum(shared) - 1
        inside = shared[column]
        row, column = row[inside], number[column[inside]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((k, k), np.float32)
        step = 4096
        for a in range(0, int(shared.sum()), step):
            lo, hi = np.searchsorted(column, (a, a + step))
            has = np.zeros((k, step), np.float32)
            has[row[lo:hi], column[lo:hi] - a] = 1
            common += has @ has.T
        common = common.astype(np.int64)
    parent = list(range(k))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    union = sizes[:, None] + sizes[None, :] - common
    where = np.array(groups)
    for i, j in zip(*np.nonzero(np.triu((100 * common >= percent * union) & (where[:, None] != where[None, :]), 1))):
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[max(a, b)] = min(a, b)
            yield int(i), int(j)


def _confirmed(work: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) inside each task's classes. ``work``: (task, cid, component)."""
    rows = work.join(sets, "cid").repartition("task").sortWithinPartitions("task")

    def compare(batches):
        task, members = None, {}

        def close():
            if len(members) > 1:
                cids = sorted(members)
                found = links([members[c][1] for c in cids], [members[c][0] for c in cids], percent)
                yield from ((cids[i], cids[j]) for i, j in found)

        def batch_of(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])

        for batch in batches:
            out = []
            names = batch.schema.names
            columns = [batch.column(names.index(c)) for c in ("task", "cid", "component")]
            shingles = batch.column(names.index("shingles"))
            for i, (t, cid, component) in enumerate(zip(*(c.to_pylist() for c in columns))):
                if t != task:
                    out += close()
                    task, members = t, {}
                members[cid] = (component, shingles[i].values.to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch_of(out)
        yield batch_of(list(close()))

    return rows.select("task", "cid", "component", "shingles").mapInArrow(compare, "u long, v long")


def _star_work(stars: DataFrame, weight: DataFrame) -> DataFrame:
    """Each class with the smallest leader of its buckets, a leader's classes in chunks."""
    first = stars.groupBy("cid").agg(F.min("lead").alias("lead"))
    first = first.join(weight, "cid")
    chunks = first.groupBy("lead").agg(F.count(F.lit(1)).alias("members"), F.max("n").alias("longest"))
    chunks = chunks.select("lead", _parts("members", "longest").alias("parts"))
    dealt = first.join(chunks, "lead").select("lead", F.pmod(F.xxhash64("cid"), "parts").alias("part"), "cid")
    leaders = chunks.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("lead").alias("cid"))
    return dealt.union(leaders).select(F.xxhash64("lead", "part").alias("task"), "cid", F.col("cid").alias("component"))


def _parts(members: str, longest: str):
    fit = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_SHINGLES) / F.greatest(F.lit(1), F.col(longest)))))
    return F.ceil(F.col(members) / fit).cast("long")


def _family_work(buckets: DataFrame, known: DataFrame, weight: DataFrame) -> DataFrame | None:
    """Block pairs over families that still span components. ``known``: (cid, component)."""
    placed = buckets.join(known, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    placed = written(placed.select("bucket", "cid", "component").distinct(), "near-placed")
    # A family is a set of components that buckets join: edges are between components only.
    parts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("classes"))
    open_buckets = parts.groupBy("bucket").agg(F.min("component").alias("lead"), F.max("component").alias("hi")).where("lead <> hi").select("bucket", "lead")
    edges = written(parts.join(open_buckets, "bucket").where("component <> lead").select(F.col("component").alias("u"), F.col("lead").alias("v")).distinct(), "near-open")
    if edges.isEmpty():
        return None
    family = components(edges).select(F.col("node").alias("component"), F.col("component").alias("family"))
    # Of a component all classes that share a bucket with another component's.
    met = placed.join(open_buckets.select("bucket"), "bucket").select("cid", "component").distinct()
    members = written(met.join(family, "component").join(weight, "cid").select("family", "cid", "component", "n"), "near-families")
    # A component that fills a block has blocks of its own; the others share blocks.
    sized = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("members"), F.max("n").alias("longest"))
    sized = sized.withColumn("own", F.when(F.col("members") >= BLOCK // 2, F.col("component")).otherwise(-1))
    kinds = sized.groupBy("family", "own").agg(F.sum("members").alias("members"), F.max("longest").alias("longest"))
    kinds = kinds.withColumn("parts", _parts("members", "longest")).select("family", "own", "parts")
    of = sized.select("family", "component", "own").join(kinds, ["family", "own"])
    dealt = members.join(of, ["family", "component"]).select("family", "cid", "component", "own", F.pmod(F.xxhash64("cid"), "parts").alias("part"))
    blocks = kinds.select("family", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    one, two = blocks.toDF("family", "own1", "part1"), blocks.toDF("family", "own2", "part2")
    pairs = one.join(two, "family").where("(own1 < own2 or own1 = own2 and part1 <= part2) and (own1 <> own2 or own1 = -1)")
    pairs = pairs.withColumn("task", F.xxhash64("family", "own1", "part1", "own2", "part2"))
    left = pairs.select("family", F.col("own1").alias("own"), F.col("part1").alias("part"), "task")
    right = pairs.where("own1 <> own2 or part1 <> part2").select("family", F.col("own2").alias("own"), F.col("part2").alias("part"), "task")
    return dealt.join(left.union(right), ["family", "own", "part"]).select("task", "cid", "component")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, first, h (a
    hash of the row's id and text).

    Links join texts whose sets of ``width``-word shingles have 100 * intersection >=
    percent * union; component_id is the smallest doc_id that links reach, kept tells
    whether that is the row's own, and first marks one row of each component (the smallest
    id's; null ids come last). Texts without words, null ones too, are linked with nothing:
    each is its own component. A null id takes part, but is never a component_id unless
    all of its component's are null; its kept is false then. Repeated rows share a
    component. An empty table gives no row; further columns are ignored.
    """
    ready(docs.sparkSession)
    src = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[id_col], docs[text_col]).alias("h"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    signed = written(_signatures(src, width), "near-signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = signed.where("n > 0").groupBy("content", "n").agg(first.alias("first"), F.min("row").alias("cid"))
    classes = written(classes.select("content", "n", "cid", "first"), "near-classes")
    reps = signed.join(classes.select(F.col("cid").alias("row"), "cid"), "row").select("cid", "n", "h", "keys")
    reps = written(reps, "near-representatives")
    weight = reps.select("cid", "n")

    buckets = written(_table_keys(reps), "near-buckets")
    leads = buckets.groupBy("bucket").agg(F.min("cid").alias("lead"), F.count(F.lit(1)).alias("members")).where("members > 1")
    stars = written(buckets.join(leads, "bucket").where("cid <> lead").select("cid", "lead").distinct(), "near-stars")

    # Full sets of the classes that met another, from their texts.
    met = stars.select("cid").union(stars.select(F.col("lead").alias("cid"))).distinct()
    wanted = reps.join(met, "cid").select("cid", "h")
    found = src.select("h", "text").join(wanted, "h").select("cid", "text")

    def full(batches):
        seen = set()  # rows that repeat id and text are one class: a set of it is enough for a task
        for batch in batches:
            cids = batch.column(0).to_pylist()
            new = [i for i, cid in enumerate(cids) if not (cid in seen or seen.add(cid))]
            batch = batch.take(pa.array(new, pa.int32()))
            sets = [shingle_set(text, width).view(np.int64) for text in texts(batch)]
            offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))], ["cid", "shingles"])

    sets = written(found.mapInArrow(full, "cid long, shingles array<long>"), "near-sets")
    confirmed = written(_confirmed(_star_work(stars, weight), sets, percent), "near-links")
    known = components(confirmed).select(F.col("node").alias("cid"), "component")
    work = _family_work(buckets, known, weight)
    if work is not None:
        more = written(_confirmed(work, sets, percent), "near-links")
        if not more.isEmpty():
            known = components(confirmed.union(more)).select(F.col("node").alias("cid"), "component")

    grouped = classes.join(known, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    best = grouped.groupBy("component").agg(F.min("first").alias("best"))
    grouped = written(grouped.join(best, "component").select("content", "n", "best"), "near-components")
    linked = signed.where("n > 0").select("doc_id", "row", "content", "n", "h").join(grouped, ["content", "n"]).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("best.doc_id").alias("component_id"), (F.col("row") == F.col("best.row")).alias("first"), "h")
    alone = signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first"), "h")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return linked.union(alone).select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "first", "h")


def first_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, with all its columns, of each component; rows without words all
    stay. Of rows that repeat both id and text one stays, whatever their other columns."""
    found = near_duplicates(docs, width, percent, id_col, text_col)
    # A hash may stand for a repeated row, of which one is first and the others are not.
    flags = found.groupBy("h").agg(F.max("first").alias("_first"), F.min("first").alias("_all"))
    gone = written(flags.where("not _all"), "near-gone").select(F.col("h").alias("_h"), "_first")
    joined = docs.join(gone, F.xxhash64(docs[id_col], docs[text_col]) == F.col("_h"), "left")
    whole = joined.where("_h is null").select(*docs.columns)
    partly = joined.where("_first").dropDuplicates(["_h"]).select(*docs.columns)
    return whole.union(partly)


def op10_tensored_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), percent=85).drop("first", "h")
