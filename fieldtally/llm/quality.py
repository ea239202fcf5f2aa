"""Quality rules as a short-circuit cascade.

A rule is a test on measures of a text. On a sample each rule's cost and its rejections
are taken down; the cascade then runs the rules by rejections per cost, counting only
texts that the rules before it let through. A text leaves at the first rule that rejects
it, and measures that no later rule of a remaining text needs are not taken.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from itertools import count as numbers

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, ready, table, texts

SYMBOLS = b"#*$%&|<>"  # fixed values
WINDOW = 8


class Text:
    """One text with its measures, each taken once, when first asked for."""

    def __init__(self, data: bytes):
        self.data = data
        self.taken: dict[str, object] = {}

    def __getitem__(self, name: str):
        if name not in self.taken:
            self.taken[name] = MEASURES[name](self)
        return self.taken[name]


def _n_symbols(t: Text) -> int:
    return len(t.data) - len(t.data.translate(None, SYMBOLS))


def _word_chars(t: Text) -> int:
    # Code points are the bytes that do not continue one.
    solid = t.data.translate(None, b" \t\n\v\f\r")
    return len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))


def _n_dup_lines(t: Text) -> int:
    lines = [x for x in t.data.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def repeated_words(words: list[bytes]) -> int:
    """Words within windows of eight that stand twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    fresh = numbers()
    code = np.fromiter((ids.setdefault(w, i) for w, i in zip(words, fresh)), np.int64, len(words))
    # Numbers for windows of 2, 4 and 8 words, each from the pair of half windows: exact.
    for width in (1, 2, 4):
        pair = (code[:-width] << 32) | code[width:]
        found, code, times = np.unique(pair, return_inverse=True, return_counts=True)
        if len(found) == len(pair):
            return 0
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(times[code] > 1)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


MEASURES: dict[str, Callable[[Text], object]] = {
    "words": lambda t: t.data.split(),
    "n_words": lambda t: len(t["words"]),
    "word_chars": _word_chars,
    "n_symbols": _n_symbols,
    "n_lines": lambda t: sum(1 for x in t.data.split(b"\n") if x and not x.isspace()),
    "n_dup_lines": _n_dup_lines,
    "n_repeat_words": lambda t: repeated_words(t["words"]),
    "n_letters": lambda t: sum(map(str.isalpha, t.data.decode("utf-8", "replace"))),
    "n_upper": lambda t: sum(map(str.isupper, t.data.decode("utf-8", "replace"))),
    "n_distinct": lambda t: len(set(t["words"])),
}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


BASE_RULES = (
    Rule("too_few_words", lambda t: t["n_words"] < 20),
    Rule("repeated_windows", lambda t: 100 * t["n_repeat_words"] > 30 * t["n_words"]),
)
# The method's own rules. Their limits stand well off ordinary prose, tables and lists.
METHOD_RULES = (
    Rule("symbols", lambda t: 10 * t["n_symbols"] > 3 * t["n_words"]),
    Rule("duplicate_lines", lambda t: t["n_dup_lines"] >= 2 and 10 * t["n_dup_lines"] > 3 * t["n_lines"]),
    Rule("few_letters", lambda t: 2 * t["n_letters"] < t["word_chars"]),
    Rule("shouting", lambda t: 10 * t["n_upper"] > 7 * max(1, t["n_letters"])),
    Rule("long_words", lambda t: t["word_chars"] > 40 * t["n_words"]),
    Rule("few_distinct_words", lambda t: t["n_words"] >= 100 and 20 * t["n_distinct"] < t["n_words"] and t["n_distinct"] < 50),
)


def measured_order(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = 2000, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """The rules in cascade order, each with its rejection share (of what comes to it) and
    its seconds per text, both from a sample of about ``sample_rows`` texts.

    The order changes the time only: a text is kept if no rule rejects it. Ties go by the
    order given; with an empty sample the order given stays.
    """
    n = docs.count()
    sampled = docs if n <= sample_rows else docs.sample(min(1.0, sample_rows / n), seed)

    def measure(batches):
        spent = [0.0] * len(rules)
        seen: dict[int, int] = {}
        for batch in batches:
            for data in texts(batch):
                mask = 0
                for i, rule in enumerate(rules):
                    text = Text(data)
                    at = time.perf_counter()
                    mask |= bool(rule.rejects(text)) << i
                    spent[i] += time.perf_counter() - at
                seen[mask] = seen.get(mask, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([*seen, *[-1 - i for i in range(len(rules))]], pa.int64()), pa.array([*map(float, seen.values()), *spent], pa.float64())], ["mask", "v"])

    # A row for each set of rules that rejected a sampled text, and for each rule.
    rows = sampled.mapInArrow(measure, "mask long, v double").groupBy("mask").agg(F.sum("v")).collect()
    masks = {m: v for m, v in rows if m >= 0}
    sample = max(1.0, sum(masks.values()))
    cost = [max(next((v for m, v in rows if m == -1 - i), 0.0) / sample, 1e-9) for i in range(len(rules))]
    order, left = [], list(range(len(rules)))
    while left:
        alive = sum(masks.values()) or 1.0
        rejected = {i: sum(v for m, v in masks.items() if m >> i & 1) for i in left}
        best = max(left, key=lambda i: (rejected[i] / cost[i], -i))
        order.append((rules[best], rejected[best] / alive, cost[best]))
        masks = {m: v for m, v in masks.items() if not m >> best & 1}
        left.remove(best)
    return order


def _verdict(text: Text, rules: list[Rule]) -> str | None:
    return next((r.name for r in rules if r.rejects(text)), None)


def cascade(docs: DataFrame, measures: tuple[str, ...] = (), base: tuple[Rule, ...] = BASE_RULES, more: tuple[Rule, ...] = METHOD_RULES,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the measures asked for (of every text), then
    base_failed and kept.

    A null or empty text has no words and fails the base rules. Null ids, repeated rows
    and ties are judged like other rows; an empty table gives no row; further columns are
    ignored.
    """
    ready(docs.sparkSession)
    src = only(docs, id_col, text_col)
    first = [r for r, *_ in measured_order(src, base)]
    then = [r for r, *_ in measured_order(src, more)]

    def judge(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(len(measures) + 2)]
            for data in texts(batch):
                text = Text(data)
                failed = _verdict(text, first) is not None
                for column, name in zip(out, measures):
                    column.append(text[name])
                out[-2].append(failed)
                out[-1].append(not failed and _verdict(text, then) is None)
            kinds = [pa.int64()] * len(measures) + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", *measures, "base_failed", "kept"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(judge, f"doc_id {kind}, " + "".join(f"{m} long, " for m in measures) + "base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + METHOD_RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns. Here one cascade
    runs over all rules, and a rejected text is measured no further."""
    ready(docs.sparkSession)
    order = [r for r, *_ in measured_order(docs.select(text_col), rules)]

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array([_verdict(Text(data), order) is None for data in texts(batch, text_col)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op1_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return cascade(table(spark, folder, "documents"), ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
