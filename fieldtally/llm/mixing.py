"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled (ordered by a hash) and laid end to end, again and
again up to ``cap`` times; the stretch that meets the source's target is cut into blocks of
equally many words. The blocks of all sources are numbered through: those numbers are the
cumulative weights. Van der Corput points fall on them, so a slot's point names a source;
slots are ranked within their source, and the k-th slot takes the source's k-th block.

Everything is DataFrame functions. Hot sources are cut into pieces of bounded rows, and
running totals go over pieces; only keys and sizes are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.codes import category_table
from ..operators.prefix import running_totals
from .common import ready, table, written

WORDS = r"[^\x20\x09-\x0D]+"
PIECE_ROWS = 4_000  # rows of a source that one task orders, about
CHUNK = 1 << 13  # slots that one task ranks
COPIES = 1_000  # equal rows that are laid as one
POINT_BITS = 52


def van_der_corput(i: Column) -> Column:
    """Point ``i`` in base 2, in [0, 1): the number's bits mirrored at the point."""
    mirrored = F.conv(F.rpad(F.reverse(F.bin(i)), POINT_BITS, "0"), 2, 10)
    return mirrored.cast("double") / F.lit(float(1 << POINT_BITS))


def _folded(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """One row per distinct (doc_id, source, text) with how often it is there. Equal rows
    meet on the map side, so a third of the table being one row travels as a few."""
    text = F.coalesce(docs[text_col], F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit(":"), text))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"),
                       F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"), key.alias("key"))
    return rows.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("copies"))


def source_targets(folded: DataFrame, weights, cap: int, block: int) -> DataFrame:
    """One row per source: its place in code-point order, size, weight, target, quota in
    whole words, blocks, and the number of the first of them.

    Targets share all words by weight and stop at ``cap`` times the source; what is above
    goes to the others by weight, until none is above.
    """
    sources = folded.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum(F.ceil(F.col("copies") / COPIES)).alias("parts"))
    sources = written(sources, "mix-sources")
    codes = category_table(sources, ["source"])
    place = codes.select(F.col("value").alias("_value"), F.col("code").cast("long").alias("_code"))
    last = codes.agg(F.count(F.lit(1))).first()[0]
    sources = sources.join(place, F.col("source") == F.col("_value"), "left").withColumn("number", F.coalesce("_code", F.lit(last)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = written(sources.select("source", "number", "source_size", "parts", weight.cast("double").alias("weight")), "mix-sources")

    limit = F.col("source_size") * F.lit(cap)
    total, free = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("weight")).first()
    rest, stopped = float(total), 0
    while True:
        share = F.lit(rest) * F.col("weight") / F.lit(free or 1.0)
        above = limit < share
        row = sources.agg(F.count_if(above), F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight")))).first()
        if row[0] == stopped:
            break
        stopped, rest, free = row[0], float(total - row[1]), row[2]
    target = F.when(above, limit.cast("double")).otherwise(share)
    sources = sources.withColumn("target", target).withColumn("quota", F.least(limit, F.floor(target + 0.5)))
    sources = sources.withColumn("blocks", F.ceil(F.col("quota") / block)).withColumn("_cell", F.floor(F.col("number") / PIECE_ROWS))
    run = running_totals(sources, ["blocks"], [F.col("number").asc()], cell="_cell")
    return written(run.withColumn("first_block", F.col("cum_blocks") - F.col("blocks")).drop("_cell", "cum_blocks"), "mix-targets")


def _laid(folded: DataFrame, sources: DataFrame) -> DataFrame:
    """Every row that has words with its place ``at`` in its source's shuffled stretch."""
    part = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))).alias("part")
    rows = folded.where("size > 0").select("*", part)
    rows = rows.withColumn("copies", F.least(F.lit(COPIES), F.col("copies") - F.col("part") * COPIES))
    # Parts of one row's copies are dealt over the source like other rows.
    deal = F.when(F.col("part") == 0, F.col("key")).otherwise(F.md5(F.concat("key", F.col("part").cast("string"))))
    mine = sources.select(F.col("source").alias("_source"), "number", "source_size", "target", "quota", "parts")
    rows = rows.withColumn("deal", deal).join(mine, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    pieces = F.ceil(F.col("parts") / PIECE_ROWS)
    rows = rows.withColumn("words", F.col("size") * F.col("copies")).withColumn(
        "piece", F.floor(F.conv(F.substring("deal", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * pieces))
    order = [F.col("deal").asc(), F.col("doc_id").asc_nulls_first(), F.col("size").asc()]
    run = running_totals(rows, ["words"], order, groups=["number"], cell="piece")
    start = F.col("cum_words") - F.col("words")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    laid = run.select("doc_id", "key", "source", "number", "source_size", "target", "quota", "size", start.alias("start"), copy)
    return laid.withColumn("at", F.col("start") + F.col("copy") * F.col("size")).drop("start", "copy")


def _schedule(sources: DataFrame) -> DataFrame:
    """(number, block, slot) for every block of every source.

    The few blocks that a source has beyond its slots (the points' discrepancy) follow
    after all slots; slots beyond a source's blocks stay empty.
    """
    spark = sources.sparkSession
    n = sources.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    long_from = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1, F.lit(CHUNK).cast("long"))).alias("_from")
    stretches = sources.where("blocks > 0").select("number", "blocks", "first_block", long_from)
    # A source with a third of all blocks is many stretches, dealt over the tasks.
    stretches = stretches.repartition("number", "_from")
    each = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + CHUNK, F.col("blocks")) - 1)).alias("block")
    blocks = stretches.select("number", "first_block", each).withColumn("place", F.col("first_block") + F.col("block")).drop("first_block")

    slots = spark.range(n).withColumn("place", F.least(F.floor(van_der_corput(F.col("id")) * n), F.lit(n - 1)))
    named = written(slots.join(blocks.select("place", "number"), "place").select(F.col("id").alias("slot"), "number"), "mix-slots")
    ranked = named.withColumn("one", F.lit(1).cast("long")).withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    ranked = running_totals(ranked, ["one"], [F.col("slot").asc()], groups=["number"], cell="chunk")
    ranked = ranked.select("number", (F.col("cum_one") - 1).alias("block"), "slot")
    return blocks.join(ranked, ["number", "block"], "left").select(
        "number", "block", F.coalesce("slot", F.col("place") + n).alias("slot"))


def _mixed(docs: DataFrame, weights, cap: int, block: int, seed: int, id_col: str, text_col: str, source_col: str):
    ready(docs.sparkSession)
    folded = written(_folded(docs, id_col, text_col, source_col, seed), "mix-rows")
    sources = source_targets(folded, weights, cap, block)
    laid = written(_laid(folded, sources), "mix-laid")
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1 - F.col("at")) / F.col("source_size")))).alias("turn")
    taken = laid.where("at < quota").select("*", turn).withColumn("begin", F.col("turn") * F.col("source_size") + F.col("at"))
    taken = taken.withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("quota")))
    held = F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))).alias("block")
    parts = taken.select("doc_id", "key", "source", "number", "at", "turn", "begin", "end", held)
    since = F.greatest(F.col("begin"), F.col("block") * block)
    parts = parts.withColumn("first_word", since - F.col("begin")).withColumn(
        "n_words", F.least(F.col("end"), (F.col("block") + 1) * block) - since).withColumn("place", since - F.col("block") * block)
    return folded, sources, laid, parts.drop("begin", "end").join(_schedule(sources), ["number", "block"])


def mix(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, block: int = 1024, seed: int = 42,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix: slot, place, source, doc_id, key, turn, first_word, n_words.

    A slot is a block of ``block`` words of one source (the last one of a source may have
    fewer); a row is a document's stretch of words in it, from ``place`` on. Reading slots
    in order gives the sources interleaved at their weights. Weights repeat over the
    sources in code-point order, the null source last. No document is used more than
    ``cap`` times. A null text has no words and, like an empty one, no row; null ids,
    repeated rows and ties are mixed like other rows; an empty table gives no row; further
    columns are ignored. The same rows give the same mix, however they are dealt.
    """
    return _mixed(docs, weights, cap, block, seed, id_col, text_col, source_col)[3].select(
        "slot", "place", "source", "doc_id", "key", "turn", "first_word", "n_words")


def mixed_texts(docs: DataFrame, mixed: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blocks themselves, from ``mix``'s rows: slot, n_words and the words as one text.
    A block has at most as many words as ``mix`` was told."""
    text = F.coalesce(docs[text_col], F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit(":"), text))
    whole = docs.select(key.alias("key"), text.alias("text")).dropDuplicates(["key"])
    piece = F.slice(F.regexp_extract_all("text", F.lit(WORDS), 0), (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int"))
    parts = mixed.join(whole, "key").select("slot", "place", "n_words", F.array_join(piece, " ").alias("text"))
    found = F.sort_array(F.collect_list(F.struct("place", "n_words", "text")))
    return parts.groupBy("slot").agg(F.sum("n_words").alias("n_words"), found.alias("parts")).select(
        "slot", "n_words", F.array_join("parts.text", " ").alias("text"))


def words_taken(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, block: int = 1024, seed: int = 42,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (its words in
    the mix, repeats counted). Rows without words take none."""
    folded, sources, laid, parts = _mixed(docs, weights, cap, block, seed, id_col, text_col, source_col)
    per_row = parts.groupBy("number", "at").agg(F.sum("n_words").alias("taken"))
    full = laid.join(per_row, ["number", "at"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    mine = sources.select(F.col("source").alias("_source"), "source_size", "target")
    bare = folded.where("size = 0").join(mine, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), copy).drop("copy")
    return full.unionAll(bare)


def op11_source_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return words_taken(table(spark, folder, "documents"))


# The same shuffle, targets and cuts in closed form, without slots or blocks.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS w
  FROM d GROUP BY source),
f AS (
  SELECT source_size, w, source_size / w AS ratio, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
         sum(w) OVER (ORDER BY source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM s),
r AS (SELECT (total - stopped)::DOUBLE AS rest, free FROM f WHERE (total - stopped) * w <= 3 * source_size * free ORDER BY ratio LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN 3 * source_size < rest * w / free THEN (3 * source_size)::DOUBLE ELSE rest * w / free END AS target
  FROM s CROSS JOIN r),
p AS (
  SELECT doc_id, size, source_size, target, least(3 * source_size, floor(target + 0.5))::BIGINT AS quota,
         (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT - size AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(a + size, quota) - a) + greatest(0, least(a + size, quota - source_size) - a)
        + greatest(0, least(a + size, quota - 2 * source_size) - a))::BIGINT AS taken
FROM p
"""
