"""Stored documents as variants, and models scored together: odd documents and vectors, one parse, one scan."""

import json

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from spanloom.operators import documents as D
from spanloom.operators import results as R
from spanloom.operators import scoring as C
from spanloom.plans import api, dag
from spanloom.sources import files

MODEL = {"frame_interval": 2.0, "threshold": 0.5, "version": 1.0, "ai_model_id": 3, "file_name": "f"}
V1 = {"schema_version": 1, "metadata": {"duration": 5.5, "models": {"c": MODEL}, "by": {"who": [None, 1]}}, "timespans": {"c": {"t": [{"start": 1.0, "end": 2.5, "confidence": 0.5}, {"start": 7.0}]}, "e": {}}, "note": ["kept", {"x": 1}]}
SETTINGS = {"frame_interval": 2.0, "threshold": 0.3}
V0 = {"video_metadata": {"video_id": 2, "duration": 9.0, "phash": "p", "models": {n: {"version": v, "ai_model_config": SETTINGS} for n, v in (("actiondetection", 1.0), ("bodyparts", 7.0), ("other", 1.0))}}, "tags": {"t": {"ai_model_name": "m", "time_frames": [{"start": 0.0, "end": 3.0, "confidence": 0.5}]}, "u": {"ai_model_name": "m", "time_frames": []}}}
V3 = {"schema_version": 3, "duration": 1.5, "models": [{"name": "n", "identifier": 1, "version": 1.0, "categories": ["c"], "type": "tag"}], "frame_interval": 2.0, "timespans": {"c": {"t": [{"start": 1.0}]}}, "more": True}
ODD = ["{bad", "[1]", "3", "{}", '{"schema_version": 1}', '{"timespans": 5, "schema_version": 1}', '{"schema_version": 1, "timespans": {"c": {"t": [{"start": "x"}, null]}}}', '{"tags": null}', None]


def stored(spark, texts):
    return spark.createDataFrame([(i, t if t is None or isinstance(t, str) else json.dumps(t), "x", 1) for i, t in enumerate(texts)], "media_id long, json string, kind string, doc int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_formats_read_as_the_fixed_structs_do(spark):
    df = stored(spark, [V1, V0, V3])
    docs = D.parsed(df)
    assert rows(docs.select("media_id", "kind")) == [(0, "v1"), (1, "v0"), (2, "v3")]
    categories = spark.createDataFrame([("t", "a"), ("t", "b")], "tag string, category string")
    old = R.spans_of_v1(df.where("media_id <> 1")).unionByName(R.upgrade_v0(df.where("media_id = 1"), categories, D.legacy_models(spark))[0])
    assert rows(D.spans(docs, categories)) == rows(old.select("media_id", "category", "tag", "start", "end", "confidence"))
    models = R.models_of_v1(df.where("media_id = 0")).unionByName(R.upgrade_v0(df.where("media_id = 1"), categories, D.legacy_models(spark))[1])
    assert rows(D.models(docs)) == rows(models)
    assert rows(D.listed_models(docs)) == [(2, "n", 1, 1.0, ["c"], "tag")]


def test_what_is_not_known_stays(spark):
    docs = D.parsed(stored(spark, [V1, V0, V3]))
    written = {r.media_id: json.loads(r.json) for r in D.rewritten(docs, D.spans(docs), D.models(docs)).collect()}
    one = written[0]
    assert one["note"] == V1["note"] and one["metadata"]["by"] == V1["metadata"]["by"] and one["metadata"]["models"] == {"c": MODEL} and one["metadata"]["duration"] == 5.5
    assert one["timespans"]["c"]["t"] == [{"start": 1.0, "end": 2.5, "confidence": 0.5}, {"start": 7.0, "end": None, "confidence": None}]
    assert written[1]["metadata"]["duration"] == 9.0 and written[1]["video_metadata"]["phash"] == "p" and "tags" not in written[1]
    assert set(written[1]["metadata"]["models"]) == {"actions", "bodyparts"} and written[1]["metadata"]["models"]["actions"]["ai_model_id"] == 950
    assert written[2]["more"] is True and written[2]["schema_version"] == 1 and written[2]["metadata"]["duration"] == 1.5
    again = D.parsed(stored(spark, [written[i] for i in range(3)]))
    assert rows(D.spans(again)) == rows(D.spans(docs)) and rows(D.models(again)) == rows(D.models(docs))
    assert rows(again.select("kind").distinct()) == [("v1",)]


def test_damaged_and_missing_documents(spark):
    docs = D.parsed(stored(spark, ODD))
    assert [r.kind for r in docs.orderBy("media_id").collect()] == ["damaged", "damaged", "damaged", "v0", "v1", "v1", "v1", "v0", "none"]
    assert D.spans(docs).count() == 0 and D.models(docs).count() == 0 and D.listed_models(docs).count() == 0
    new = spark.createDataFrame([(3, "c", "t", 1.0, None, None), (99, "c", "t", 2.0, 3.0, 0.5)], "media_id long, category string, tag string, start double, end double, confidence double")
    again = D.parsed(D.rewritten(docs, new, D.models(docs)))
    assert rows(D.spans(again)) == rows(new) and again.count() == len(ODD) + 1
    none = D.parsed(stored(spark, []))
    assert D.rewritten(none, D.spans(none), D.models(none)).count() == 0


def test_one_parse_for_all_reads(spark):
    docs = D.parsed(stored(spark, [V1]))
    for df in (D.spans(docs), D.models(docs), D.listed_models(docs), docs.select("media_id", "kind")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1


# scoring -----------------------------------------------------------------------------------------------------


def heads(thresholds=(0.5, None), dims=3):
    r = np.random.default_rng(1)
    return [C.Head(f"m{k}", C.linear_scores(r.normal(size=(4, dims + k)), r.normal(size=4)), [f"t{k}{i}" for i in range(4)], [f"c{k}", None, "shared", f"c{k}"], dims + k, t) for k, t in enumerate(thresholds)]


def frames(spark, n=60):
    r = np.random.default_rng(2)
    data = [(i, float(i % 7), r.normal(size=3 + i % 2).astype(float).tolist(), i) for i in range(n)]
    data += [(900, 0.0, None, 0), (901, 0.0, [], 0), (902, 0.0, [1.0, None, 2.0], 0), (903, 0.0, [1.0] * 9, 0), (5, 5.0, data[5][2], 0)]
    return data, spark.createDataFrame(data, "media_id long, frame_index double, frame array<double>, score long").repartition(3)


def chain(data, hs, threshold, skip):
    out = []
    for m, f, x, _ in data:
        for h in hs:
            if x is None or None in x or len(x) != h.dims or {c for c in h.categories if c} <= set(skip):
                continue
            limit = threshold or h.threshold
            for s, tag, c in zip(h.scores(np.array([x]))[0], h.tags, h.categories):
                if c is not None and (not limit or s > limit):
                    out.append((m, c, tag, f, round(s, 2), h.name))
    return sorted(out)


@pytest.mark.parametrize("threshold,skip", [(None, ()), (0.7, ()), (0.0, ("c0", "shared")), (None, ("c0", "c1", "shared"))])
def test_all_models_in_one_pass(spark, threshold, skip):
    data, df = frames(spark)
    stats = Observation()
    found = C.score_all(df, heads(), threshold, skip, stats=stats)
    got = sorted(map(tuple, found.collect()))
    assert got == chain(data, heads(), threshold, skip)
    assert stats.get == {"frames": len(data), "models": {0: 2, 2: 1, 3: 0}[len(skip)]}
    assert C.score_all(df.limit(0), heads()).count() == 0


def test_models_with_heads_share_a_scan(spark, tmp_path):
    frames(spark)[1].drop("score").write.parquet(f"{tmp_path}/frames")
    df = spark.read.parquet(f"{tmp_path}/frames")
    models = [dag.Model(h.name, k, 1.0, [f"c{k}"], None, None, None, head=h) for k, h in enumerate(heads((0.5, 0.6)))]
    found = dag.score_frames(df, models, None, [], True)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert found.columns == ["media_id", "category", "tag", "frame_index", "confidence"] and found.count() > 0
    rules = spark.createDataFrame([("shared", "t02", "Shown", 0.5)], "category string, tag string, display string, tag_threshold double")
    assert set(r.tag for r in api.process_images(df, models, rules).collect()) == {"Shown"}


def test_existence_by_a_join(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "path string").withColumn("known", F.lit(5)).drop("known")
    listed = spark.createDataFrame([("a",), ("a",), (None,)], "path string")
    assert rows(files.with_existence(df, F.col("path"), listed)) == [("a", True), ("a", True), ("b", False), (None, False)]
