import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldtally.llm import bigrams, decontaminate, katz, neardup, packing
from fieldtally.llm.decontaminate import contaminated, tiles, tokens, without_contaminated
from fieldtally.llm.katz import score_held_out
from fieldtally.llm.licences import scan_licences
from fieldtally.llm.neardup import first_of_each, near_duplicates
from fieldtally.llm.packing import encoder, match_rounds, pack, sequences
from fieldtally.llm.pii import find_pii, redacted
from fieldtally.llm.quality import BASE_RULES, METHOD_RULES, Text, cascade, keep_good, measured_order
from fieldtally.llm.sharding import shard_by_bytes
from fieldtally.llm.tokens import count_tokens, tokenizer, vocabulary
from fieldtally.llm.urls import judge_urls

from . import brute

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Names that the operators use inside.
CLASHING = "row string, h string, size long, kept string, label string, n int, component string, shard string, words string, spans string"
PASSAGE = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(["an", "ber", "cu", "de", "é", "fo", "gri"]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(w + r.choice(["", "", "", ",", ".\n"]) for w in words)


def awkward_rows() -> list[tuple]:
    long = prose(1, 20_000)
    base = prose(2, 120)
    edited = base.split(" ")
    edited[60] = "edited"
    contact = "Write to a.b@mail.example.com or 10.1.2.3, call +1 (555) 123-4567; card 4111 1111 1111 1111, not 4111 1111 1111 1112."
    rows = [
        (1, base), (2, " ".join(edited)), (3, base), (4, base), (4, base), (None, base), (5, None), (6, ""), (None, None), (7, " \n\t "),
        (8, long), (9, "x" * 60_000), (10, "1 " * 3000), (11, "+" * 500 + "1" * 5000 + "@" * 50), (12, contact), (13, f"é {contact} 300.1.1.1"),
        (14, "Licensed under CC BY-NC 4.0. All rights reserved."), (15, PASSAGE + " " + prose(3, 30)),
        (16, " ".join(reversed([PASSAGE[:60], PASSAGE[60:]])) + prose(4, 10)), (17, "a\nb\na\n" * 20), (18, "WE SHOUT! " * 3 + prose(5, 40).upper()),
        (19, "double  space \n and \u00a0 odd\u2003 white\u3000 \n\n space "), (20, "<|endoftext|> 's don't I'LL \u0130stanbul 12ab \u4e2d\u6587 \U0001f600 e\u0301"),
        (21, "one two three"), (22, "One two three"), (-3, "### *** $$$ " * 30), (23, "a.b@c.d_e@f.g 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4"),
    ]
    return rows + [(100 + i, prose(100 + i % 7, 40 + i)) for i in range(30)]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(*r, *["clash"] * 2, 1, "clash", "clash", 2, *["clash"] * 4) for r in awkward_rows()]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {CLASHING}").repartition(3).cache()
    df.count()
    return df


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")


def by_row(got, columns):
    return Counter(tuple(r[c] for c in columns) for r in got.collect())


def test_quality_against_brute_force(awkward, empty):
    columns = ("doc_id", *MEASURES, "base_failed")
    assert by_row(cascade(awkward, MEASURES), columns) == Counter((d, *brute.quality(t)) for d, t in awkward_rows())
    assert cascade(empty, MEASURES).count() == 0
    kept = {r.doc_id for r in cascade(awkward, MEASURES).where("kept").collect()}
    assert {1, 8, 102} <= kept and not kept & {5, 6, 10, 17, 18, -3}
    assert Counter(r.doc_id for r in keep_good(awkward).collect()) == Counter(r.doc_id for r in cascade(awkward).where("kept").collect())
    assert keep_good(awkward).columns == awkward.columns


def test_quality_order_goes_by_rejections_per_cost(awkward):
    order = measured_order(awkward.select("doc_id", "text"), BASE_RULES + METHOD_RULES)
    assert sorted(r.name for r, *_ in order) == sorted(r.name for r in BASE_RULES + METHOD_RULES)
    assert all(0 <= share <= 1 and cost > 0 for _, share, cost in order)
    assert order[0][1] > 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n#|é\x1c\x85", max_size=120))
def test_quality_measures(text):
    t = Text(text.encode())
    assert tuple(t[m] for m in MEASURES) == brute.quality(text)[:5]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_brute_force(awkward, empty, percent):
    want = Counter(brute.near(awkward_rows(), percent))
    assert by_row(near_duplicates(awkward, percent=percent), ("doc_id", "n_shingles", "component_id", "kept")) == want
    assert near_duplicates(empty).count() == 0
    stays = first_of_each(awkward, percent=percent)
    assert stays.columns == awkward.columns
    # The two rows without an id and without words are their own; the rest is a row a component.
    assert stays.count() == len({c for _, n, c, _ in want if n}) + sum(k for (_, n, _, _), k in want.items() if not n)
    assert {1, 8, 21} <= {r.doc_id for r in stays.collect()}


def test_near_duplicates_large_families(spark, monkeypatch):
    """Families of edits of edits, beyond the size of a block: links only between some."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    r, rows = random.Random(5), []
    for family in range(3):
        text = prose(500 + family, 130).split(" ")
        for i in range(30):
            text = list(r.choice([text, prose(500 + family, 130).split(" ")]))
            for _ in range(r.randint(0, 3)):
                text[r.randrange(len(text))] = f"new{r.random():.6f}"
            rows.append((family * 100 + i, " ".join(text)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85)
    assert by_row(got, ("doc_id", "n_shingles", "component_id", "kept")) == Counter(brute.near(rows, 85))


def test_repeated_rows_give_few_sets(spark, monkeypatch):
    kept = {}
    real = neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, name: kept.setdefault(name, real(df, name)))
    text = prose(8, 60)
    rows = [(1, text)] * 500 + [(2, text + " one more word")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert by_row(got, ("doc_id", "component_id")) == Counter({(1, 1): 500, (2, 1): 1})
    assert kept["near-sets"].count() <= 2 * 2


def test_tiling_catches_reordered_and_leaves_short(spark, awkward, empty):
    bench = spark.createDataFrame([(1, PASSAGE, "x"), (2, None, "x"), (3, "too short", "x"), (4, PASSAGE, "y"), (5, prose(77, 40), "z")], "item_id long, text string, row string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(awkward, bench).collect()}
    assert set(got) == {(15, 1), (15, 4), (16, 1), (16, 4)}
    assert got[15, 1].coverage == 1.0 and got[15, 1].n_tiles == 1
    assert got[16, 1].n_tiles == 2 and got[16, 1].coverage >= 0.8
    assert contaminated(empty, bench).count() == 0 and contaminated(awkward, bench.where("false")).count() == 0
    clean = without_contaminated(awkward, bench)
    assert clean.columns == awkward.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(d for d, _ in awkward_rows() if d not in (15, 16))


def test_benchmark_in_blocks_is_the_same(spark, awkward, monkeypatch):
    bench = spark.createDataFrame([(i, PASSAGE if i % 3 == 0 else prose(i, 30)) for i in range(12)], "item_id long, text string")
    whole = by_row(contaminated(awkward, bench), ("doc_id", "item_id", "covered_tokens"))
    monkeypatch.setattr("fieldtally.llm.decontaminate.BLOCK_BYTES", 500)
    assert by_row(contaminated(awkward, bench), ("doc_id", "item_id", "covered_tokens")) == whole


@pytest.mark.parametrize("pairs", [1, 1 << 20])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=60), st.integers(1, 5))
def test_tiles_against_brute_force(pairs, a, b, least):
    held, decontaminate.PAIRS = decontaminate.PAIRS, pairs
    try:
        got = tiles(tokens(" ".join(a).encode()), tokens(" ".join(b).encode()), least)
    finally:
        decontaminate.PAIRS = held
    assert got == brute.tiles(a, b, least)


def test_tiles_of_one_repeated_token():
    """A long text and item of one token: all places are equal, no pair of them is walked one by one."""
    item, text = tokens(b"na " * 2_000), tokens(b"na " * 100_000)
    got = tiles(item, text)
    assert got == [(0, 0, 2_000)]


def test_coverage_against_brute_force(spark):
    r = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choices(words, k=r.choice([0, 1, 3, 5, 7, 8, 12, 25])))) for i in range(40)] + [(90, None), (91, "..."), (92, "w1 w2 w3")]
    docs = []
    for i in range(60):
        parts = [" ".join(r.choices(words, k=r.randint(0, 40)))]
        for _, text in r.sample(items[:40], 3):
            cut = r.randint(0, len(text))
            parts += r.sample([text[:cut], text[cut:]], 2)
        docs.append((i, " ".join(parts)))
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    want = Counter()
    for d, text in docs:
        for k, item in items:
            said = [w for w in (item or "").replace(".", " ").split()]
            laid = brute.tiles(said, text.split(), len(said) if len(said) < 8 else 5) if said else []
            covered = sum(n for *_, n in laid)
            if said and 2 * covered >= len(said):
                want[d, k, len(said), covered, len(laid)] += 1
    assert by_row(got, ("doc_id", "item_id", "item_tokens", "covered_tokens", "n_tiles")) == want and want


def test_items_of_scripts_without_spaces(spark):
    item = "\u6771\u4eac\u306f\u65e5\u672c\u306e\u9996\u90fd\u3067\u3042\u308a\u4eba\u53e3\u306f\u591a\u3044"
    docs = [(1, f"\u524d\u6587{item}\u5f8c\u6587"), (2, item[8:] + "\u3000\u4ed6\u306e\u6587\u7ae0 " + item[:8]), (3, "\u6771\u4eac \u306f"), (4, "\u65e5\u672c\u306e\u6771\u4eac")]
    bench = spark.createDataFrame([(1, item), (2, "\u6771\u4eac")], "item_id long, text string")
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1), (1, 2), (2, 2), (3, 2), (4, 2)}


def test_scores_against_brute_force(awkward, empty):
    got = score_held_out(awkward).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    want = sorted(brute.base_scores(awkward_rows()), key=key)
    assert [x[:5] for x in have] == [x[:5] for x in want]
    assert [x[5] for x in have] == pytest.approx([x[5] for x in want])
    assert all(r.score < 0 for r in got)
    assert score_held_out(empty).count() == 0


@pytest.mark.parametrize("coded", [0, 60, 65_533])
def test_katz_sums_to_one(awkward, monkeypatch, coded):
    """The model's scores are those of the plain one, whose probabilities sum to one after every kind of history."""
    monkeypatch.setattr(katz, "VOCABULARY", coded)
    learnt = [r for r in awkward_rows() if r[0] is not None and 100 <= r[0] < 112]
    one, p = brute.katz_model([t for _, t in learnt])
    words = sorted(w for w in p if w)
    histories = ["<s>", words[0], words[len(words) // 2], words[-1], "neverseen"]
    for h in histories:
        assert sum(one(h, w) for w in p) + one(h, "neverseen") == pytest.approx(1, abs=1e-9)
    asked = [f"{h} {w}" for h in histories[1:] for w in [*words, "neverseen"]] + words
    new = awkward.sparkSession.createDataFrame([(i, False, t) for i, t in enumerate(asked)], "doc_id long, held_out boolean, text string")
    got = bigrams.score(new, *bigrams.train(awkward.where("doc_id >= 100 and doc_id < 112").select("text"))).collect()
    assert len(got) == len(asked)
    for r in got:
        steps = ["<s>", *asked[r.doc_id].split(), None]
        assert r.score == pytest.approx(sum(math.log10(one(*q)) for q in zip(steps, steps[1:])), rel=1e-9)


@pytest.mark.parametrize("coded", [0, 60, 65_533])
def test_bigrams_of_all_words_count_as_themselves(awkward, monkeypatch, coded):
    """Scores are Katz's over full counts, however many words have codes."""
    monkeypatch.setattr(katz, "VOCABULARY", coded)
    have = sorted((str(r.doc_id), r.n_tokens, r.score) for r in score_held_out(awkward).collect())
    want = sorted((str(d), n, s) for d, n, s in brute.katz_scores(awkward_rows()))
    assert [x[:2] for x in have] == [x[:2] for x in want]
    assert [x[2] for x in have] == pytest.approx([x[2] for x in want], rel=1e-9)


def test_scores_beat_the_base_on_unseen_text(spark):
    rows = [(i, " ".join(random.Random(i % 40).choices(["the cat sat", "on a mat", "and saw", "the dog", "a new rug"], k=30))) for i in range(200)]
    got = score_held_out(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert got and sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)


def test_licences_against_brute_force(awkward, empty):
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    got = scan_licences(awkward)
    assert by_row(got, columns) == Counter((d, *brute.licences(t)) for d, t in awkward_rows())
    row = next(r for r in got.collect() if r.doc_id == 14)
    assert row.labels == "cc-by,cc-by-nc,reserved" and row.score == 1.0
    assert all(0 <= r.score <= 1 for r in got.collect()) and scan_licences(empty).count() == 0


def test_licence_with_words_put_in_and_left_out(spark):
    mit = "Permission is hereby granted, free of charge, to any other person obtaining a copy of this software and documentation files"
    got = scan_licences(spark.createDataFrame([(1, prose(1, 50) + mit), (2, "free of charge to any person")], "doc_id long, text string"))
    assert {r.doc_id: r.labels for r in got.collect()} == {1: "mit", 2: ""}


def test_shards(awkward, empty):
    got = shard_by_bytes(awkward, 8).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in awkward_rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(8))
    assert shard_by_bytes(empty, 8).count() == 0


def test_shards_are_even_with_a_hot_text(spark):
    rows = [(i, "hot text " * 20 if i % 3 == 0 else prose(i, 25)) for i in range(1500)] + [(7, "same row")] * 300
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 8 + 2 * 300


def test_token_counts_against_the_library(awkward, empty):
    tok = tokenizer(vocabulary("word_bpe_49k.json"))
    want = Counter()
    for d, t in awkward_rows():
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want[d, len((t or "").encode()), n, n > 2048] += 1
    path = vocabulary("word_bpe_49k.json")
    assert by_row(count_tokens(awkward, path), ("doc_id", "n_bytes", "n_tokens", "over_limit")) == want
    assert count_tokens(empty, path).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"aZ'sté1 .\n\t\u00a0\u2003\u0085\u0130\u4e2d|<>", "<|endoftext|>", "  "]), max_size=40).map("".join))
def test_encoder_equals_the_library(text):
    path = vocabulary("byte_bpe_50k.json")
    got = np.frombuffer(encoder(path, vocabulary("byte_bpe_50k.tiktoken"))(text.encode()), "<u4").tolist()
    assert got == tokenizer(path).encode(text, add_special_tokens=False).ids


def test_packing(awkward, empty):
    path, ranks = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    tok, want = tokenizer(path), Counter()
    for d, t in awkward_rows():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        ends = [*range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [len(ids)]
        for piece, (a, b) in enumerate(zip([0, *ends], ends)):
            want[d, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = pack(awkward, path, ranks, keep_ids=True)
    assert by_row(got, ("doc_id", "piece", "start", "length", "ids_crc32")) == want
    assert by_row(pack(awkward, path), ("doc_id", "piece", "start", "length", "ids_crc32")) == want
    placed = defaultdict(list)
    for r in got.collect():
        placed[r.sequence_id].append((r.offset, r.length))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    whole = sequences(got).collect()
    assert len(whole) == len(placed) and all(sum(r.lengths) == len(r.input_ids) <= 1024 for r in whole)
    assert pack(empty, path, ranks).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=20))
def test_rounds_place_each_piece_once(counts):
    runs = match_rounds(counts, 64)
    for length, n in counts.items():
        ranks = sorted(r for x, first, k, _, _ in runs if x == length for r in range(first, first + k))
        assert ranks == list(range(n))
    used = defaultdict(list)
    for length, _, k, sequence, offset in runs:
        for s in range(sequence, sequence + k):
            used[s].append((offset, length))
    for parts in used.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0, *(x for _, x in sorted(parts))])[:-1])
        assert sum(x for _, x in parts) <= 64
    # Half or more of each sequence is used, but for one.
    assert sum(sum(x for _, x in p) <= 32 for p in used.values()) <= 1
    # About as few sequences as best fit, the longest first and one by one.
    assert len(used) <= 1.02 * brute.best_fit(counts, 64) + 2


def test_packing_ranks_hot_lengths(spark):
    pieces = spark.range(500).selectExpr("id as doc_id", "0 as piece", "0L as start", "if(id % 3 = 0, 7L, id % 5) as length", "id as ids_crc32")
    ranks = defaultdict(list)
    for r in packing.ranked_by_length(pieces).collect():
        ranks[r.length].append(r["rank"])
    assert all(sorted(x) == list(range(len(x))) for x in ranks.values()) and sum(map(len, ranks.values())) == 500


def test_urls(spark):
    urls = ["https://a.net/x", "https://b.example.net/en/1", "http://example.com/de/", "https://A.Example.ORG/fr/9?q#f", "https://x.org", "no scheme", None, "", "://",
            "ftp://x.net", "https://net/", "https://x.org/a?b://c", "https://k.example.com/a/" + "s/" * 3000]
    urls += [f"https://www.example.com/de/{i}" for i in range(40)] + [f"https://www.example.com/en/{i}" for i in range(5)] + [f"https://s.org/p/{c}" for c in "abcdefgh"]
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(None, urls[0], "c", "c"), (0, urls[0], "c", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, n string")
    got = judge_urls(df).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter((i, *brute.page(u)[:3]) for i, u, *_ in rows)
    for r in got:
        said = brute.page(dict(((i, u) for i, u, *_ in rows)).get(r.page_id))[3]
        assert r.verdict == said if said else r.verdict in ("allow", "block")
    # Nearly all of the merged template is labelled and blocked, so its few unlabelled pages are too.
    assert {r.verdict for r in got if r.host == "www.example.com" and r.path.startswith("/en/")} == {"block"}
    assert {r.verdict for r in got if r.host == "s.org"} == {"allow"} and {r.template for r in got if r.host == "s.org"} == {"/p/*"}
    assert judge_urls(df.where("false")).count() == 0


def test_pii_against_brute_force(awkward, empty):
    got = find_pii(awkward)
    columns = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert by_row(got, columns) == Counter((d, *brute.entities(t)[0]) for d, t in awkward_rows())
    for r in got.collect():
        assert set(brute.entities(dict(awkward_rows())[r.doc_id])[1].split(",")) <= set(r.spans.split(","))
    assert find_pii(empty).count() == 0


def test_pii_learns_contexts(spark):
    rows = [(i, f"please call me on +1 (555) 010-{1000 + i} soon") for i in range(12)]
    rows += [(100, "please call me on 555-0199 soon"), (101, "see chapter 555-0199 or 12345 pages")]
    spans = {r.doc_id: r.spans for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[100] == "phone:18:26" and spans[101] == ""


def test_pii_contexts_are_of_the_text_itself(spark):
    """Seeds and candidates after other identifiers, and numbers of several words."""
    rows = [(i, f"ticket {i}77 please call me on +1 (555) 010-{1000 + i} soon") for i in range(12)]
    rows += [(100, "ticket 9a1 please call me on 555 123 4567 soon"), (101, "call me on\n555-0199, room 12 34"), (102, "on 555 9")]
    spans = {r.doc_id: r.spans for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[100] == "phone:29:41" and spans[101] == "phone:11:19"


def test_pii_of_long_texts_with_many_matches(spark):
    rows = [(1, "a.b@mail.example.com 10.1.2.3 call +1 (555) 123-4567 " * 3000), (2, "12 34 x5 " * 4000)]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        want, _ = brute.entities(text)
        assert (got[d].n_email, got[d].n_ip, got[d].n_card, got[d].n_phone, got[d].base_sha256) == want


def test_redaction(awkward):
    got = redacted(awkward, length_col=None)
    assert got.columns == awkward.columns and got.count() == len(awkward_rows())
    text = next(r.text for r in got.collect() if r.doc_id == 12)
    assert text == "Write to [EMAIL] or [IP], call [PHONE]; card [CARD], not 4111 1111 1111 1112."
