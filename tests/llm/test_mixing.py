import hashlib
import math
from collections import Counter, defaultdict

import pytest

from fieldtally.llm import mixing
from fieldtally.llm.mixing import mix, mixed_texts, words_taken

from .brute import WORD
from .test_operators import CLASHING, awkward_rows, by_row, prose

SOURCES = ["b", "a", None, "ä", "hot"]


def rows_with_sources() -> list[tuple]:
    rows = [(d, t, SOURCES[i % 4]) for i, (d, t) in enumerate(awkward_rows())]
    return rows + [(500 + i, prose(500 + i, 30), "hot") for i in range(40)] + [(7, "equal rows", "hot")] * 25 + [(None, None, None)] * 5


def frame(spark, rows):
    full = [(*r, *["clash"] * 2, 1, "clash", "clash", 2, *["clash"] * 4) for r in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, source string, {CLASHING}").repartition(3)


def targets(sizes: dict, weights=(5, 2, 1), cap: int = 3) -> dict:
    """Water filled source by source: all that are above stop, the rest share again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in stopped]
        rest = total - sum(stopped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s: cap * sizes[s] for s in free if share[s] > cap * sizes[s]}
        if not above:
            return {**share, **stopped}
        stopped |= above


def taken(rows: list[tuple]) -> Counter:
    by_source = defaultdict(list)
    for d, t, s in rows:
        said = f"42:{'' if d is None else d}:{t or ''}"
        by_source[s].append((hashlib.md5(said.encode()).hexdigest(), len(WORD.findall(t or "")), d))
    sizes = {s: sum(n for _, n, _ in x) for s, x in by_source.items()}
    want, out = targets(sizes), Counter()
    for s, x in by_source.items():
        stretch = [i for i, (_, n, _) in enumerate(sorted(x, key=lambda r: r[:2])) for _ in range(n)] * 3
        used = Counter(stretch[:min(3 * sizes[s], math.floor(want[s] + 0.5))])
        for i, (_, n, d) in enumerate(sorted(x, key=lambda r: r[:2])):
            out[d, n, sizes[s], round(want[s], 6), used[i]] += 1
    return out


COLUMNS = ("doc_id", "size", "source_size", "target", "taken")


@pytest.mark.parametrize("small", [False, True])
def test_words_taken_against_brute_force(spark, monkeypatch, small):
    if small:  # hot sources and slots in many pieces
        monkeypatch.setattr(mixing, "PIECE_ROWS", 5)
        monkeypatch.setattr(mixing, "CHUNK", 4)
    df = frame(spark, rows_with_sources())
    got = Counter()
    for key, n in by_row(words_taken(df, block=64), COLUMNS).items():
        got[(*key[:3], round(key[3], 6), key[4])] += n
    assert got == taken(rows_with_sources())
    assert words_taken(df.where("false")).count() == 0


def test_equal_rows_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 4)
    monkeypatch.setattr(mixing, "PIECE_ROWS", 5)
    got = words_taken(frame(spark, rows_with_sources()), block=64).collect()
    whole = defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r["size"]
        whole[r.source_size, r.target] += r.taken
    assert len(got) == len(rows_with_sources()) and all(abs(t - n) <= 0.5 for (_, t), n in whole.items())


def test_mix_is_a_schedule_of_equal_blocks(spark):
    rows = rows_with_sources()
    df = frame(spark, rows)
    mixed = mix(df, block=64)
    got = mixed.collect()
    blocks = defaultdict(list)
    for r in got:
        blocks[r.slot].append(r)
    sources = {s: {r.source for r in b} for s, b in blocks.items()}
    assert all(len(x) == 1 for x in sources.values())
    lengths = {s: sum(r.n_words for r in b) for s, b in blocks.items()}
    for b in blocks.values():
        at = 0
        for r in sorted(b, key=lambda r: r.place):
            assert r.place == at
            at += r.n_words
    short = Counter(next(iter(sources[s])) for s, n in lengths.items() if n < 64)
    assert max(lengths.values()) == 64 and all(n == 1 for n in short.values())
    # Along the slots each source has its share at all times, but for the points' discrepancy.
    order = [next(iter(sources[s])) for s in sorted(blocks)]
    total = Counter(order)
    seen = Counter()
    for i, s in enumerate(order, 1):
        seen[s] += 1
        assert all(abs(seen[x] - i * total[x] / len(order)) <= 2 * math.log2(len(order)) for x in total)
    # Whoever deals the rows, the mix is the same; and the texts are those words.
    assert by_row(mix(df.repartition(7), block=64), mixed.columns) == by_row(mixed, mixed.columns)
    text = {(r.source, r.doc_id, r.key): t for r in got for d, t, s in rows
            if d == r.doc_id and s == r.source and hashlib.md5(f"42:{'' if d is None else d}:{t or ''}".encode()).hexdigest() == r.key}
    for r in mixed_texts(df, mixed).collect():
        parts = sorted(blocks[r.slot], key=lambda x: x.place)
        words = [w for p in parts for w in WORD.findall(text[p.source, p.doc_id, p.key])[p.first_word:p.first_word + p.n_words]]
        assert r.text == " ".join(words) and r.n_words == len(words) == lengths[r.slot]
    assert mix(df.where("false")).count() == 0


def test_points_are_van_der_corput(spark):
    got = [r[0] for r in spark.range(8).select(mixing.van_der_corput(mixing.F.col("id"))).collect()]
    assert got == [0, 0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875]
