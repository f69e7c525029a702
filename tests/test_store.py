"""The store of results: versions, failures, conflicts, repeated batches, what an update writes."""

import os

import pytest
from pyspark.sql import functions as F

from spanloom.sources.store import Conflict, ResultStore, work_folder

SPANS = "media_id long, category string, start double"
MODELS = "media_id long, category string, version double"


@pytest.fixture()
def store(spark, tmp_path):
    return ResultStore(spark, f"file://{tmp_path}/results", {"spans": SPANS, "models": MODELS}, buckets=8)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def media(spark, ids, start, category="c"):
    return spark.createDataFrame([(i, category, start) for i in ids], SPANS)


def folder_times(store):
    top = store.root.removeprefix("file://") + "/data"
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(top) for f in names if f.endswith(".parquet")}


def test_updates_replace_their_keys_alone(spark, store):
    both = lambda df, v: {"spans": df, "models": df.select("media_id", "category", F.lit(v).alias("version"))}
    first = media(spark, range(100), 1.0).unionAll(media(spark, range(100), 1.5, "d"))
    assert store.update(both(first, 1.0), first.select("media_id", "category")) == 1
    assert rows(store.read("spans")) == rows(first)
    before = folder_times(store)
    new = media(spark, [3, 200], 2.0).unionAll(media(spark, [4], 9.0))  # media 4 is not among the updated
    wanted = spark.createDataFrame([(3, "c"), (200, "c"), (5, "c")], "media_id long, category string")
    assert store.update(both(new, 2.0), wanted) == 2
    now = {(m, c): s for m, c, s in rows(store.read("spans"))}
    assert now[3, "c"] == 2.0 and now[3, "d"] == 1.5 and now[200, "c"] == 2.0 and now[4, "c"] == 1.0 and (5, "c") not in now and len(now) == 200
    assert {(m, c): v for m, c, v in rows(store.read("models"))}[3, "c"] == 2.0
    assert rows(store.read("spans", version=1)) == rows(first)
    after = folder_times(store)
    assert all(after[f] == t for f, t in before.items())  # nothing is written over
    one, two = store.manifest(1)["folders"]["spans"], store.manifest(2)["folders"]["spans"]
    assert 1 <= sum(one.get(b) != f for b, f in two.items()) <= 3  # only the updated media's buckets are new
    assert store.vacuum() > 0 and rows(store.read("spans")) == sorted(((m, c, s) for (m, c), s in now.items()), key=repr)
    assert store.versions() == [2]


def test_a_failed_update_changes_nothing(spark, store):
    first = media(spark, range(20), 1.0)
    store.update({"spans": first}, first.select("media_id"))
    broken = first.withColumn("start", F.when(F.col("media_id") == 7, F.raise_error("lost").cast("double")).otherwise(2.0))
    with pytest.raises(Exception, match="lost"):
        store.update({"spans": broken}, first.select("media_id"))
    assert store.versions() == [1] and rows(store.read("spans")) == rows(first)
    store.vacuum()
    assert len(store._names("data")) == 1 and rows(store.read("spans")) == rows(first)
    assert store.update({"spans": first.withColumn("start", F.lit(3.0))}, first.select("media_id")) == 2


def test_of_two_updates_at_once_one_fails(spark, store):
    first = media(spark, [1], 1.0)
    store.update({"spans": first}, first.select("media_id"))
    late = ResultStore(spark, store.root)
    seen = late.manifest()
    store.update({"spans": media(spark, [1], 2.0)}, first.select("media_id"))
    late.manifest = lambda version=None: seen  # what it read before the other's commit
    with pytest.raises(Conflict):
        late.update({"spans": media(spark, [1], 3.0)}, first.select("media_id"))
    assert rows(store.read("spans")) == [(1, "c", 2.0)] and store.versions() == [1, 2]


def test_batches_take_effect_once(spark, store, tmp_path):
    one = media(spark, [1], 1.0)
    for start, number, version in ((1.0, 0, 1), (2.0, 0, 1), (3.0, 1, 2), (4.0, 0, 2)):
        assert store.update({"spans": one.withColumn("start", F.lit(start))}, one.select("media_id"), batch=("job", number)) == version
    assert rows(store.read("spans")) == [(1, "c", 3.0)]
    # the same from a stream, restarted from its checkpoint and from none
    source = f"{tmp_path}/in"
    media(spark, range(10), 5.0).write.parquet(source)
    apply = lambda df, n: store.update({"spans": df}, df.select("media_id"), batch=("stream", n))
    for checkpoint in ("a", "a", "b"):
        stream = spark.readStream.schema(SPANS).parquet(source)
        stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
    assert store.versions()[-1] == 3 and len(rows(store.read("spans"))) == 10


def test_empty_nulls_and_mistakes(spark, store):
    none = spark.createDataFrame([], SPANS)
    assert rows(store.read("spans")) == []
    assert store.update({"spans": none}, none.select("media_id")) == 1 and rows(store.read("spans")) == []
    odd = spark.createDataFrame([(None, "c", 1.0), (1, None, 2.0), (1, "c", 3.0), (1, "c", 3.0)], SPANS)
    store.update({"spans": odd}, odd.select("media_id"))
    assert rows(store.read("spans")) == [(1, "c", 3.0), (1, "c", 3.0), (1, None, 2.0)]  # no media, nothing to keep it under
    for tables, keys in (({"other": odd}, odd.select("media_id")), ({"spans": odd}, odd.select("category"))):
        with pytest.raises(ValueError):
            store.update(tables, keys)
    with pytest.raises(ValueError):
        ResultStore(spark, store.root + "-none").manifest()
    assert work_folder(spark) != work_folder(spark)
