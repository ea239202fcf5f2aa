import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldtally.llm.fim import Array, Bitmap, BoundarySet, Runs, boundaries, container, fill_in_middle, restored

from .test_operators import awkward, awkward_rows, by_row, empty  # noqa: F401

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text) -> tuple:
    text = text or ""
    units = TOKEN.findall(text)
    said = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(said[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), out, text


def test_fill_in_middle_against_brute_force(spark, awkward, empty):  # noqa: F811
    marks = [(900 + i, f"one {m} two three") for i, m in enumerate(["<P>", "<S>", "<M>", "<X>"] * 4)]
    rows = awkward_rows() + marks + [(950 + i, " lead é　x \n end \t") for i in range(30)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, output string")
    got = fill_in_middle(df)
    got = got.withColumn("text", restored(got.form, got.output))
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "text")
    assert by_row(got, columns) == Counter(plain_version(d, t) for d, t in rows)
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}
    assert fill_in_middle(awkward).count() == len(awkward_rows()) and fill_in_middle(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n\t 　", max_size=80))
def test_boundaries_are_ends_of_tokens(text):
    ends = np.cumsum([0, *(len(x.encode()) for x in TOKEN.findall(text))]).tolist()
    assert boundaries(text.encode()).tolist() == ends


@pytest.mark.parametrize("offsets, kinds", [
    ([0], [Runs, Array]), (range(0, 70_000), [Runs, Runs]), (range(0, 65_536 * 2, 3), [Bitmap, Bitmap]),
    (range(5, 400_000, 40), [Array] * 7), ([0, 65_535, 65_536, 200_000], [Array, Array, Array]),
    ([*range(100, 30_000), *range(70_000, 131_072, 2), *range(140_000, 190_000, 9_000)], [Runs, Bitmap, Array])])
def test_select_in_every_kind_of_container(offsets, kinds):
    offsets = np.array(list(offsets))
    found = BoundarySet(offsets)
    assert all(isinstance(c, (k, Array)) for c, k in zip(found.containers, kinds)) and len(found) == len(offsets)
    step = max(1, len(offsets) // 500)
    ranks = [*range(0, len(offsets), step), len(offsets) - 1]
    assert [found.select(k) for k in ranks] == offsets[ranks].tolist()


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 300_000), max_size=400), st.integers(0, 250_000), st.integers(0, 9_000))
def test_select_is_the_sorted_order(scattered, start, run):
    offsets = np.array(sorted(scattered | set(range(start, start + run))), np.int64)
    found = BoundarySet(offsets)
    assert [found.select(k) for k in range(0, len(offsets), 7)] == offsets[::7].tolist()


def test_smallest_container():
    assert type(container(np.arange(9_000))) is Runs
    assert type(container(np.arange(0, 9_000, 3))) is Array
    assert type(container(np.arange(0, 65_536, 3))) is Bitmap
