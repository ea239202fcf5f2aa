import uuid

from fieldtally.sources.layers import published, source_version, versioned


def test_a_rewritten_source_gives_a_new_layer(spark, tmp_path):
    source, built, name = f"{tmp_path}/source.parquet", [], f"test-{uuid.uuid4().hex}"

    def write(path):
        built.append(path)
        spark.read.parquet(source).write.parquet(path)

    def get(keep=2):
        return versioned(spark, name, source_version(spark, [source]), write, keep)

    for n in (3, 4, 5):
        spark.range(n).write.mode("overwrite").parquet(source)
        path = get()
        assert get() == path and spark.read.parquet(path).count() == n
    assert len(built) == 3 and [p for _, p in published(spark, name)] == built[1:]
    # The oldest version's data is gone, the one before is still there.
    assert spark.read.parquet(built[0]).count() == 0 and spark.read.parquet(built[1]).count() == 4


def test_a_layer_that_fails_is_not_published(spark, tmp_path):
    name = f"test-{uuid.uuid4().hex}"

    def fail(path):
        spark.range(3).write.parquet(path)
        raise RuntimeError("lost")

    try:
        versioned(spark, name, "v", fail)
    except RuntimeError:
        pass
    assert published(spark, name) == []
    assert versioned(spark, name, "v", lambda p: spark.range(2).write.parquet(p)) == published(spark, name)[0][1]
