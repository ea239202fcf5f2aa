import random

import corpus_pipeline

from . import brute
from .test_operators import PASSAGE, prose


def folder(spark, tmp_path):
    base = prose(1, 150)
    edited = base.split(" ")
    edited[70] = "changed"
    rows = [(i, prose(1000 + i, 60 + i), "en", "s", 1) for i in range(40)]
    rows += [(100, base, "en", "s", 1), (101, " ".join(edited), "en", "s", 1), (102, base, "en", "s", 1), (103, None, "en", "s", 1), (104, "too short", "en", "s", 1)]
    rows += [(105, prose(9, 60) + PASSAGE, "en", "s", 1), (106, prose(10, 60) + " a.b@mail.example.com", "en", "s", 1)]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def test_each_stage(spark, tmp_path):
    sf_dir, rows = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert list(stages) == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "best_fit_packing"]
    docs = stages["quality_rules"](spark, docs, sf_dir)
    assert ids(docs) == {d for d, t, *_ in rows if not brute.quality(t)[5]} and docs.columns == columns
    docs = stages["near_duplicates"](spark, docs, sf_dir)
    assert ids(docs) == {*range(40), 100, 105, 106} and docs.columns == columns
    docs = stages["decontamination"](spark, docs, sf_dir)
    assert ids(docs) == {*range(40), 100, 106} and docs.columns == columns
    docs = stages["personal_data"](spark, docs, sf_dir)
    assert docs.columns == columns
    text = {r.doc_id: r for r in docs.collect()}[106]
    assert text.text.endswith(" [EMAIL]") and text.n_chars == len(text.text)
    packed = stages["best_fit_packing"](spark, docs, sf_dir)
    assert ids(packed) == {*range(40), 100, 106}


def test_run(spark, tmp_path):
    sf_dir, _ = folder(spark, tmp_path)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == {*range(40), 100, 106}


def test_empty_tables(spark, tmp_path):
    """No documents, or none that a stage keeps; no benchmark."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, empty, str(tmp_path))
        assert got.columns == empty.columns and got.count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    bare = spark.createDataFrame([(1, None, "en", "s", 0), (None, "", None, None, None), (1, None, "en", "s", 0)], schema)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, bare, str(tmp_path)).count() == 3, name
    assert corpus_pipeline.STAGES[-1][1](spark, bare, str(tmp_path)).count() == 3
