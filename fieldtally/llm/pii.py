"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Four patterns find base entities. They seed a graph of lexical patterns (the words left of
an identifier, with its shape) and instances (the identifiers): in each round a pattern is
scored by the share of its instances that are trusted, and an instance by the patterns
that hold it. Patterns of high confidence then mark identifiers that no base pattern finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ready, table, written

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns, with possessive loops and starts fixed to the start of a run: the
# matches are the same, but neither long runs nor deep recursion can hold a task up.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # Only runs of 12 to 19 digits: others would be dropped afterwards, and none is tried twice.
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9]))[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a kind to be looked for at all.
NEEDED = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
BYTE_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# An identifier: a word (between white space) that holds a digit or an at sign, with the
# words of digits only that follow it, each after one space ("555 123 4567").
WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:\x20[0-9().-]*+(?<=[0-9().-])(?=[\x20\x09-\x0D]|$))*+"
CONTEXT = 200  # code points before an identifier in which its two words are looked for
ROUNDS = 3
SUPPORT = 3.0  # trusted instances that a pattern needs
TRUST = 0.6  # score from which a pattern, or an instance, is trusted


def _places(text: Column, pattern: str) -> tuple[Column, Column]:
    """Matches and the pieces between them (one more)."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern, -1)


def _starts(found: str, pieces: str) -> Column:
    """Structs (start, end, match, before) in code points; ``before`` is the end of all the
    text before the match, earlier matches too."""
    steps = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        before = F.right(F.concat(state["tail"], F.right(x["p"], F.lit(CONTEXT))), F.lit(CONTEXT))
        one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match"), before.alias("before"))
        tail = F.right(F.concat(before, F.right(x["m"], F.lit(CONTEXT))), F.lit(CONTEXT))
        return F.struct(end.alias("at"), tail.alias("tail"), F.concat(state["out"], F.array(one)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none.alias("out"))
    return F.aggregate(steps, start, step, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{BYTE_PART}(?:\.{BYTE_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _found(src: DataFrame) -> DataFrame:
    """The rows, without the text, with the base ``entities`` (start, rank, end, match,
    before; sorted), their spans as ``base`` and all identifiers as ``words`` (start, end,
    match, before)."""
    cut = src
    for kind, pattern in [*PATTERNS.items(), ("word", WORD)]:
        wanted = F.col("text").rlike(NEEDED.get(kind, "[0-9@]"))
        found, pieces = _places(F.col("text"), pattern)
        cut = cut.withColumn(f"{kind}_found", F.when(wanted, found)).withColumn(f"{kind}_pieces", F.when(wanted & (F.size(f"{kind}_found") > 0), pieces))
    whole = cut.select("row", "doc_id", "h", *(F.when(F.col(f"{k}_pieces").isNotNull(), _starts(f"{k}_found", f"{k}_pieces")).alias(k) for k in [*KINDS, "word"]))
    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string>>")

    def valid(rank: int, kind: str) -> Column:
        kept = F.filter(F.coalesce(F.col(kind), none), lambda x: _holds(kind, x["match"]))
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["match"].alias("match"), x["before"].alias("before")))

    entities = F.array_sort(F.concat(*(valid(i, k) for i, k in enumerate(KINDS))))
    whole = whole.select("row", "doc_id", "h", entities.alias("entities"), F.coalesce("word", none).alias("words"))
    base = F.transform("entities", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))
    return whole.withColumn("base", base)


def _occurrences(found: DataFrame) -> DataFrame:
    """(row, start, end, rank of the base entity or null, instance, pattern): each base
    entity, and each other identifier, with each of its two patterns."""
    entities = found.select("row", F.explode("entities").alias("e")).select("row", "e.start", "e.end", "e.rank", F.col("e.match").alias("instance"), "e.before")
    other = found.where(F.size("words") > 0).select("row", F.explode("words").alias("w"))
    edge = r"[^\p{L}\p{N}+@]"  # quotes, brackets and the like around an identifier
    inner = F.regexp_replace("w.match", rf"^{edge}++", "")
    other = other.select("row", (F.col("w.end") - F.length(inner)).alias("start"), F.regexp_replace(inner, rf"(?<!{edge}){edge}++$", "").alias("instance"), "w.before")
    other = other.withColumn("end", F.col("start") + F.length("instance"))
    other = other.where((F.length("instance") >= 5) & F.col("instance").rlike("[0-9].*[0-9]|@"))
    both = entities.union(other.select("row", "start", "end", F.lit(None).cast("int").alias("rank"), "instance", "before"))
    # A sweep along each text: no base entity reaches into the identifier or starts in it.
    along, is_base = Window.partitionBy("row").orderBy("start"), F.col("rank").isNotNull()
    reach = F.max(F.when(is_base, F.col("end"))).over(along.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.min(F.when(is_base, F.col("start"))).over(along.rangeBetween(1, Window.unboundedFollowing))
    both = both.withColumn("reach", reach).withColumn("following", following)
    both = both.where(is_base | (F.coalesce("reach", "start") <= F.col("start")) & (F.coalesce("following", "end") >= F.col("end"))).drop("reach", "following")

    left = F.split(F.trim(F.lower(F.regexp_replace("before", r"\s+", " "))), " ")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("instance", "[0-9]", "9"), r"\p{L}+", "a"), "9{3,}", "9+")
    one, two = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2))
    patterns = F.array(F.xxhash64(F.lit("word"), one, shape), F.xxhash64(F.lit("words"), two, one))
    return both.where(one != "").select("row", "start", "end", "rank", F.xxhash64("instance").alias("instance"), F.explode(patterns).alias("pattern"))


def trusted_patterns(occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, rank, score) of the patterns trusted after some rounds over the graph."""
    graph = written(occurrences.groupBy("pattern", "instance").agg(F.max("rank").alias("rank")), "pii-graph")
    totals = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"))
    seeds = graph.where("rank is not null").groupBy("instance", "rank").agg(F.lit(1.0).alias("trust"))
    known, trusted = seeds, None
    for _ in range(rounds):
        hits = graph.select("pattern", "instance").join(known, "instance").groupBy("pattern", "rank").agg(F.sum("trust").alias("hits"))
        score = F.col("hits") / (F.col("instances") + 1)
        trusted = written(hits.join(totals, "pattern").withColumn("score", score).where((F.col("hits") >= SUPPORT) & (score >= TRUST)).select("pattern", "rank", "score"), "pii-patterns")
        # An instance is wrong only if all its patterns are.
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))
        new = graph.where("rank is null").select("pattern", "instance").join(trusted, "pattern").groupBy("instance", "rank").agg((1 - doubt).alias("trust")).where(F.col("trust") >= TRUST)
        known = written(seeds.union(new), "pii-instances")
    return trusted


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256,
    spans, all (the spans as structs start, rank, end; rank is the place in KINDS), h (a
    hash of the row's id and text).

    A null or empty text has no spans (an empty string, and its hash). Null ids and
    repeated rows are searched each; an empty table gives no row; further columns are
    ignored. Spans of the method never overlap base ones. Out of its reach are identifiers of
    fewer than 5 characters, without a digit pair or an at sign, at a text's begin, and of
    words other than digits; a context word is cut where it is longer than ``CONTEXT``.
    """
    ready(docs.sparkSession)
    src = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), F.xxhash64(docs[id_col], docs[text_col]).alias("h"), F.monotonically_increasing_id().alias("row"))
    found = written(_found(src), "pii-found")
    occurrences = written(_occurrences(found), "pii-occurrences")
    trusted = trusted_patterns(occurrences)
    new = occurrences.where("rank is null").join(trusted.select("pattern", F.col("rank").alias("of"), "score"), "pattern")
    new = new.groupBy("row", "start", "end").agg(F.max_by("of", F.struct(F.col("score"), -F.col("of"))).alias("rank"))
    new = new.groupBy("row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("new"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    rows = found.select("row", "doc_id", "h", "base").join(new, "row", "left").withColumn("all", F.array_sort(F.concat("base", F.coalesce("new", none))))

    def text_of(spans: str) -> Column:
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(text_of("base"), 256).alias("base_sha256"), text_of("all").alias("spans"), "all", "h")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with all their columns; each span of the text gives way to its
    kind in brackets, overlapping spans to the first one's. ``length_col`` follows the text.
    Null and empty texts stay as they are; repeated rows are redacted alike."""
    spans = find_pii(docs, id_col, text_col).where(F.size("all") > 0).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("all").alias("_spans"))
    same = (F.xxhash64(docs[id_col], docs[text_col]) == F.col("_h")) & docs[id_col].eqNullSafe(F.col("_id"))
    joined = docs.join(written(spans.dropDuplicates(["_id", "_h"]), "pii-spans"), same, "left")
    text, names = F.col(text_col), F.array(*map(F.lit, KINDS))

    def step(state: Column, s: Column) -> Column:
        label = F.concat(F.lit("["), F.upper(F.get(names, s["rank"])), F.lit("]"))
        fresh = s["start"] >= state["at"]
        out = F.concat(state["out"], F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), label))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, out).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate("_spans", start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    new = F.when(F.col("_spans").isNotNull(), whole).otherwise(text)
    kinds = dict(docs.dtypes)
    columns = {text_col: new.alias(text_col)}
    if length_col in kinds:
        columns[length_col] = F.when(F.col("_spans").isNotNull(), F.length(new)).otherwise(F.col(length_col)).cast(kinds[length_col]).alias(length_col)
    return joined.select(*(columns.get(c, docs[c]) for c in docs.columns))


def op9_contextual_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find_pii(table(spark, folder, "documents")).drop("all", "h")
