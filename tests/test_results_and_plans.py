"""Scoring, stored results, metrics, sources, streams and the request functions."""

import io
import json
import struct
import time
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import metrics as M
from spanloom.operators import results as R
from spanloom.operators import scoring as C
from spanloom.plans import api, dag
from spanloom.plans import fixtures as X
from spanloom.sources import files, pictures
from spanloom.streaming import runs as streams

MODEL = "media_id long, category string, frame_interval double, threshold double, version double, ai_model_id int, file_name string"
SPAN = "media_id long, category string, tag string, start double, end double, confidence double"


@pytest.mark.parametrize(
    "old, new, need",
    [
        ((2.0, 0.3, 1.0, 200, "f"), (2.0, 0.3, 1.0, 300, "f"), 0),
        ((2.0, 0.3, 1.0, 960, "g"), (2.0, 0.3, 1.0, 300, "f"), 2),
        ((2.0, 0.3, 1.0, 949, "g"), (2.0, 0.3, 1.0, 300, "f"), 1),
        ((2.0, 0.3, 1.0, 950, "g"), (2.0, 0.3, 1.0, 949, "f"), 2),
        ((2.0, 0.3, 1.0, 200, "g"), (2.0, 0.3, 1.0, 300, "f"), 0),
        ((2.0, 0.3, 1.0, 200, "g"), (2.0, 0.3, 2.0, 300, "f"), 2),
        ((2.0, 0.3, 1.0, 200, "f"), (3.0, 0.3, 1.0, 200, "f"), 2),
        ((2.0, 0.3, 1.0, 200, "f"), (4.0, 0.3, 1.0, 200, "f"), 0),
        ((2.0, 0.3, 1.0, 200, "f"), (2.0, 0.2, 1.0, 200, "f"), 2),
        ((2.0, 0.3, 1.0, 200, None), (2.0, 0.3, 1.0, 100, "f"), 1),
    ],
)
def test_reprocessing(spark, old, new, need):
    plan = R.plan_reuse(spark.createDataFrame([(1, "c", *new)], MODEL), spark.createDataFrame([(1, "c", *old)], MODEL))
    assert plan.first().need == need and plan.first().work == (need == 2)


def test_plan_upsert_and_skip_lists(spark):
    stored = spark.createDataFrame([(1, "a", 2.0, 0.3, 1.0, 300, "f"), (1, "b", 2.0, 0.3, 1.0, 300, "g")], MODEL)
    active = spark.createDataFrame([(1, c, 2.0, 0.3, 1.0, 200, "f") for c in "abn"], MODEL)
    plan = R.plan_reuse(active, stored)
    assert {r.category: r.work for r in plan.collect()} == {"a": False, "b": False, "n": True}
    assert R.skip_lists(plan).first().skip == ["a", "b"] and R.work_by_media(plan).first().work
    updated = R.updated_categories(stored, active)
    assert {r.category for r in updated.collect()} == {"b", "n"}
    old = spark.createDataFrame([(1, c, "old", 0.0, None, None) for c in "ab"], SPAN)
    new = spark.createDataFrame([(1, c, "new", 0.0, None, None) for c in "abn"], SPAN)
    assert {(r.category, r.tag) for r in R.upsert(old, new, updated).collect()} == {("a", "old"), ("b", "new"), ("n", "new")}


def test_json_round_trip_and_kinds(spark):
    spans = spark.createDataFrame([(1, "c", "t", 0.0, 4.0, 0.7), (1, "c", "t", 8.0, None, None), (1, "d", "u", 2.0, 6.0, 0.5)], SPAN)
    models = spark.createDataFrame([(1, "c", 2.0, 0.3, 1.0, 200, None)], MODEL)
    media = spark.createDataFrame([(1, 60.0)], "media_id long, duration double")
    text = R.to_json_v1(spans, models, media)
    parsed = json.loads(text.first().json)
    assert parsed["schema_version"] == 1 and parsed["timespans"]["c"]["t"][1] == {"start": 8.0}
    assert sorted(map(tuple, R.spans_of_v1(text).collect()), key=repr) == sorted(map(tuple, spans.collect()), key=repr)
    assert tuple(R.models_of_v1(text).first()) == tuple(models.first())
    rows = spark.createDataFrame([(None,), ("{}",), ('{"schema_version": 1}',), ('{"schema_version":3}',)], "j string")
    assert [r[0] for r in rows.select(R.json_kind(F.col("j"))).collect()] == ["none", "v0", "v1", "v3"]


def test_overlapping_categories_fail(spark):
    models = spark.createDataFrame([(1, "c", 2.0, 0.3, 1.0, 1, "f"), (1, "c", 2.0, 0.3, 1.0, 2, "g")], MODEL)
    assert R.overlapping_categories(models).count() == 1
    with pytest.raises(Exception, match="claimed by two models: c"):
        R.checked_models(models).collect()


def test_scoring_rules(spark):
    tags = spark.createDataFrame([("m", 0, "a"), ("m", 1, "b"), ("m", 2, "c")], "model string, idx int, name string")
    scores = spark.createDataFrame([(1, 0.0, "m", [0.5, 0.625, 0.9])], "media_id long, frame_index double, model string, scores array<double>")
    got = {r.tag: r.confidence for r in C.threshold_tags(scores, tags, 0.5).collect()}
    assert got == {"b": 0.62, "c": 0.9}  # strict, and half to even
    assert C.threshold_tags(scores, tags, 0.0, 0.7).count() == 1 and C.threshold_tags(scores, tags, None).count() == 3
    routed = C.route(C.threshold_tags(scores, tags, 0.5), spark.createDataFrame([("m", 1, "k")], "model string, idx int, category string"))
    assert [(r.category, r.tag) for r in routed.collect()] == [("k", "b")]
    rules = spark.createDataFrame([("k", "b", "B", 0.62)], "category string, tag string, display string, tag_threshold double")
    assert C.image_rules(routed, rules, True).first().tag == "B"
    assert C.image_rules(routed, rules.withColumn("tag_threshold", F.lit(0.63)), True).count() == 0
    assert C.image_rules(routed, rules.withColumn("tag_threshold", F.lit(0.63)), False).count() == 1


def test_linear_head_with_odd_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0])], "id int, v array<float>")
    got = {r.id: r.s for r in rows.select("id", C.linear_head([1.0, -0.5])(F.col("v")).alias("s")).collect()}
    assert got == {1: 0.5, 2: None, 3: None}


def test_metrics(spark):
    batches = spark.createDataFrame([("b", "x", 10.0, 1), ("b", "y", 10.0, 3)], "batch string, root string, elapsed double, items int")
    assert {r.root: r.seconds for r in M.apportion(batches).collect()} == {"x": 2.5, "y": 7.5}
    runs = spark.createDataFrame([(1, "cpu", 1.0, 1.0, 4), (1, "gpu", 0.0, 2.0, 4), (2, "cpu", 0.0, 0.0, 0)], "request int, backend string, preprocess_s double, inference_s double, frames int")
    got = {r.request: r for r in M.request_metrics(runs).collect()}
    assert got[1].backend == "mixed" and got[1].frames_per_s == 2.0 and got[2].frames_per_s is None and got[2].backend == "cpu"


def png(picture, kind):
    h, w = picture.shape[:2]
    k = picture.shape[2]
    body, before = b"", np.zeros(w * k, int)
    for y in range(h):
        row, f = picture[y].ravel().astype(int), y % 5
        left = np.concatenate([np.zeros(k, int), row[:-k]])
        corner = np.concatenate([np.zeros(k, int), before[:-k]])
        p = left + before - corner
        paeth = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        guess = [np.zeros(w * k, int), left, before, (left + before) // 2, paeth][f]
        body += bytes([f]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        before = row
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_pictures(spark, tmp_path):
    r = np.random.default_rng(1)
    colour, alpha, grey = (r.integers(0, 256, (11, 7, k)).astype(np.uint8) for k in (3, 4, 1))
    assert (pictures.decode(png(colour, 2)) == colour).all() and (pictures.decode(png(alpha, 6)) == alpha[..., :3]).all()
    assert (pictures.decode(png(grey, 0)) == np.repeat(grey, 3, 2)).all()
    pnm = b"P6\n# x\n7 11\n255\n" + colour.tobytes()
    assert (pictures.decode(pnm) == colour).all()
    flat = np.full((9, 13, 3), 77, np.uint8)
    assert np.allclose(pictures.resize(flat, 5), 77) and np.allclose(pictures.resize(colour, 7)[0].shape, (7, 3))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png(colour, 2))
    (tmp_path / "in" / "bad.png").write_bytes(b"no picture")
    with zipfile.ZipFile(tmp_path / "in" / "set.zip", "w") as z:
        z.writestr("d/b.pnm", pnm)
    listed = files.listing(spark, str(tmp_path / "in"))
    wanted = spark.createDataFrame([("a.png",), ("set.zip/d/b.pnm",), ("set.zip/none",), ("gone.png",), ("bad.png",)], "path string")
    got = {x.path: x for x in pictures.prepared_pictures(pictures.picture_bytes(wanted, listed), 4, 0).collect()}
    assert len(got["a.png"].tensor) == 48 and got["a.png"].tensor == got["set.zip/d/b.pnm"].tensor
    assert all(got[p].tensor is None and got[p].error for p in ("set.zip/none", "gone.png", "bad.png"))


def test_frames(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "1.y4m").write_bytes(b"YUV4MPEG2 W2 H2 F25:1 Cmono\n" + b"".join(b"FRAME\n" + bytes([k] * 4) for k in range(40)))
    listed = files.listing(spark, str(tmp_path / "m"))
    got = sorted(map(tuple, pictures.frame_scan(listed, 0.5).select("n", "frame_index", "luma").collect()))
    assert got == [(n, 0.5 * k, bytes([n] * 4)) for k, n in enumerate(range(0, 40, 12))]
    assert [x.frame_index for x in pictures.frame_scan(listed, 0.0).orderBy("n").limit(3).collect()] == [0.0, 0.04, 0.08]
    assert [x.frame_index for x in pictures.frame_scan(listed, 0.5, False).orderBy("n").collect()] == [0.0, 12.0, 24.0, 36.0]
    assert pictures.media_probe(listed).first().duration == 1.6


def test_rule_files_vocabulary_and_config(spark, tmp_path):
    (tmp_path / "r" / "deep").mkdir(parents=True)
    head = ",".join(files.RULE_COLUMNS)
    (tmp_path / "r" / "one.csv").write_text(f"{head}\nview,Viewing,12,,20,\n")
    (tmp_path / "r" / "deep" / "two x.csv").write_text(f"{head}\nclick,Clicking,5%,12s,10%,0.4\n")
    (tmp_path / "r" / "note.txt").write_text("no rule")
    got = {x.category: x for x in X.resolved(files.rule_files(spark, str(tmp_path / "r"))).collect()}
    assert set(got) == {"one", "two x"} and got["one"].max_gap == 6.0 and got["two x"].min_marker_duration == 36.0 and got["one"].tag_threshold == 0.5
    (tmp_path / "tags.txt").write_text("a\n b \n\nc\n")
    assert [(x.idx, x.name) for x in files.tag_vocabulary(spark, str(tmp_path / "tags.txt"), "m").collect()] == [(0, "a"), (1, "b"), (2, ""), (3, "c")]
    assert files.load_config(str(tmp_path / "none.yaml"), {"a": 1}) == {"a": 1}
    (tmp_path / "c.yaml").write_text('{"a": 2, "b": {"c": 3}}')
    assert files.load_config(str(tmp_path / "c.yaml"), {"a": 1, "z": 0}) == {"a": 2, "z": 0, "b": {"c": 3}}
    (tmp_path / "bad.yaml").write_text("{a: [")
    assert files.load_config(str(tmp_path / "bad.yaml"), {"a": 1}) == {"a": 1}
    results = spark.createDataFrame([(7, '{"x":1}')], "media_id long, json string")
    files.write_results(results, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value) == {"media_id": 7, "result": {"x": 1}}


def model(spark, name, tags, category, score, **more):
    rows = [(name, k, t) for k, t in enumerate(tags)]
    return dag.Model(
        name, more.pop("identifier", 200), 1.0, [category], score, spark.createDataFrame(rows, "model string, idx int, name string"),
        spark.createDataFrame([(name, k, category) for k in range(len(tags))], "model string, idx int, category string"), **more,
    )


def constant(name, values):
    return lambda frames: frames.select("media_id", "frame_index", F.lit(name).alias("model"), F.array(*map(F.lit, values)).alias("scores"))


def test_requests_end_to_end(spark):
    frames = spark.createDataFrame([(m, 2.0 * k) for m in (1, 2) for k in range(12)], "media_id long, frame_index double")
    media = spark.createDataFrame([(1, 24.0), (2, 24.0)], "media_id long, duration double")
    a = model(spark, "ma", ["run", "jump"], "motion", constant("ma", [0.9, 0.2]))
    b = model(spark, "mb", ["tree"], "place", constant("mb", [0.8]))
    rules = spark.createDataFrame([("motion", "run", "Running", 12.0, 6.0, 20.0, 0.5), ("place", "tree", "Tree", 12.0, 6.0, 30.0, 0.5)], "category string, tag string, display string, min_marker_duration double, max_gap double, required_duration double, tag_threshold double")
    out = api.process_media(frames, media, [a], rules)
    assert [(r.media_id, r.tag, r.start, r.end) for r in out.markers.orderBy("media_id").collect()] == [(1, "run", 0.0, 22.0), (2, "run", 0.0, 22.0)]
    assert {tuple(r) for r in out.tags.collect()} == {(1, "motion", "Running"), (2, "motion", "Running")}
    stored = R.to_json_v1(out.spans, out.models, media)

    def refuse(batches):
        for b in batches:
            assert not len(b), "scored again"
            yield b.assign(model="ma", scores=[])

    broken = model(spark, "ma", ["run"], "motion", lambda f: f.mapInPandas(refuse, "media_id long, frame_index double, model string, scores array<double>"))
    again = api.process_media(frames, media, [broken], rules, existing=stored)
    assert again.markers.count() == 2  # nothing is scored where a stored result serves
    both = api.process_media(frames, media, [a, b], rules, existing=stored)
    assert {(r.category, r.tag) for r in both.spans.collect()} == {("motion", "run"), ("place", "tree")}
    v3 = json.loads(api.process_media_v3(frames, media, [a, b], skip=["place"]).orderBy("media_id").first().json)
    assert v3["schema_version"] == 3 and v3["timespans"] == {"motion": {"run": [{"start": 0.0, "end": 22.0}]}} and [m["name"] for m in v3["models"]] == ["ma"]
    images = api.process_images(frames, [a, b], rules, with_confidence=True)
    assert {(r.tag, r.confidence) for r in images.collect()} == {("Running", 0.9), ("Tree", 0.8)}
    assert api.process_images(frames, [a], None).first().confidence is None
    wanted = spark.createDataFrame([(1, "Running", ['{"start": 0, "end": 10}', '{"start": 8.0, "end": 22.0}'])], "media_id long, display string, intervals array<string>")
    from spanloom.operators.overlap import parameter_grid

    best = api.optimise_markers(stored, wanted, rules, parameter_grid(spark, density_weight=[0.04], gap_factor=[0.85], average_factor=[0.25], min_gap=[0.0, 2.0]), interval=2.0, least=12.0)
    assert best.first().loss == 2.0  # the other media's marker is one more than wanted
    for name in api.METHODS:
        assert api.tag_info(out.spans, out.models, rules, media, 2.0, name).markers.count() == 2
    with pytest.raises(ValueError, match="no method"):
        api.tag_info(out.spans, out.models, rules, media, 2.0, "guess")


def test_pipelines_and_registry(spark):
    frames = spark.createDataFrame([(1, 0.0)], "media_id long, frame_index double")
    a, b = (model(spark, n, [n], c, constant(n, [0.9])) for n, c in (("x", "cx"), ("y", "cy")))

    @dag.step("count_rows")
    def count_rows(detections):
        return detections.groupBy("category").agg(F.count("*").alias("n"))

    spec = {
        "inputs": ["frames", "threshold", "confident", "skip"], "output": "counts", "short_name": "s", "version": 1.0,
        "models": [{"name": "count_rows", "inputs": ["found"], "outputs": ["counts"]}, {"name": "score_media", "inputs": ["frames", "threshold", "confident", "skip"], "outputs": ["found"]}],
    }
    p = dag.Pipeline(spec, [a, b])
    assert {r.category for r in p.run(frames, None, True, ["cy"]).collect()} == {"cx"}
    assert p.run(frames, None, True, ["cx", "cy"]).count() == 0
    registry = dag.Registry()
    assert not api.ready(registry)
    registry.add("main", p)
    assert api.ready(registry) and api.health(registry) == {"pipelines": {"main": 2}, "models": 2}
    assert [m["name"] for m in api.current_models(registry, "main")] == ["x", "y"]
    with pytest.raises(ValueError, match="no pipeline"):
        registry.get("other")
    for change, message in (({"inputs": []}, "inputs"), ({"output": ""}, "output"), ({"models": "x"}, "models"), ({"models": [{"name": "nope", "inputs": ["frames"]}]}, "no step")):
        with pytest.raises(ValueError, match=message):
            dag.Pipeline(spec | change)
    with pytest.raises(ValueError, match="two models claim"):
        dag.Pipeline(spec, [a, a])
    with pytest.raises(ValueError, match="agree"):
        dag.Pipeline(spec, [a, model(spark, "z", ["z"], "cz", constant("z", [0.9]), image_size=9)])
    with pytest.raises(ValueError, match="nothing produces"):
        dag.Pipeline(spec | {"models": spec["models"][:1]}).run(frames, None, True, [])


def replay(spark, tmp_path, make, chunks):
    source = tmp_path / "source"
    source.mkdir()
    kinds = "media_id long, category string, tag string, ts timestamp, confidence double"
    name = f"runs_{int(time.time() * 1000)}"
    stream = make(spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(source)))
    query = None
    try:
        for k, rows in enumerate(chunks):
            frame = spark.createDataFrame([(1, "c", "t", s, c) for s, c in rows], "media_id long, category string, tag string, s long, confidence double")
            frame.select("media_id", "category", "tag", F.timestamp_seconds("s").alias("ts"), "confidence").coalesce(1).write.mode("append").parquet(str(source))
            query = query or stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).start()
            query.processAllAvailable()
        return sorted((int(r.start.timestamp()), int(r.end.timestamp()) if r.end is not None else None) for r in spark.table(name).collect())
    finally:
        if query:
            query.stop()


def test_stream_of_sessions(spark, tmp_path):
    chunks = [[(0, None), (2, None), (12, None)], [(8, None), (40, None)], [(1000, None)], [(1001, None)]]
    got = replay(spark, tmp_path, lambda s: streams.stream_runs(s, 2, 4, "10 seconds"), chunks)
    assert got == [(0, 12), (40, None)]


def test_stream_with_confidence(spark, tmp_path):
    # the first watermark is the epoch, and what is not after a watermark is late: so the rows begin later
    chunks = [[(100, 0.5), (102, 0.5), (106, 0.7)], [(104, 0.5), (108, 0.7)], [(1000, 0.5)], [(1001, 0.5)]]
    got = replay(spark, tmp_path, lambda s: streams.stream_runs_by_confidence(s, 2, 0, "10 seconds"), chunks)
    assert got == [(100, 104), (106, 108)]


def plain_unfilter(kinds, rows):
    """Sample by sample, by the format's definition."""
    h, w, k = rows.shape
    out = np.zeros((h, w, k), int)
    for y in range(h):
        for x in range(w):
            for c in range(k):
                a, b = (out[y, x - 1, c] if x else 0), (out[y - 1, x, c] if y else 0)
                d = out[y - 1, x - 1, c] if x and y else 0
                p = a + b - d
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                out[y, x, c] = (int(rows[y, x, c]) + (0, a, b, (a + b) // 2, near)[kinds[y]]) % 256
    return out


def test_png_filters_equal_their_definition():
    r = np.random.default_rng(6)
    for h, w, k in ((1, 1, 3), (7, 5, 4), (9, 12, 1), (3, 20, 2)):
        for kinds in (r.integers(0, 5, h), r.integers(0, 3, h), np.full(h, 4)):
            rows = r.integers(0, 256, (h, w, k)).astype(np.uint8)
            assert (pictures._unfilter(kinds, rows) == plain_unfilter(kinds, rows)).all()


@pytest.mark.parametrize(
    "data",
    [b"P6 2", b"P6", b"P5 2 2 255", b"P6 9 9 255\n123", b"P5 #x", b"\x89PNG\r\n\x1a\n", b""],
)
def test_truncated_pictures_are_errors(data):
    with pytest.raises(ValueError):
        pictures.decode(data)


def test_damaged_png_and_streams_are_item_errors(spark):
    good = png(np.zeros((4, 4, 1), np.uint8), 0)
    indexed = png(np.full((4, 4, 1), 3, np.uint8), 0).replace(struct.pack(">IIBBBBB", 4, 4, 8, 0, 0, 0, 0), struct.pack(">IIBBBBB", 4, 4, 8, 3, 0, 0, 0))
    huge = good.replace(struct.pack(">IIBBBBB", 4, 4, 8, 0, 0, 0, 0), struct.pack(">IIBBBBB", 2**31, 2**31, 8, 0, 0, 0, 0))
    rows = [("good", good), ("indexed", indexed), ("huge", huge), ("cut", good[:45])]
    got = {x.path: x for x in pictures.prepared_pictures(spark.createDataFrame([(p, bytearray(c), None) for p, c in rows], "path string, content binary, error string"), 4, 0).collect()}
    assert got["good"].error is None and all(got[p].error and got[p].tensor is None for p in ("indexed", "huge", "cut"))
    streams = [("a", b"YUV4MPEG2 W4 H2 F25:1 Cmono\n" + b"FRAME\n12345678" * 3), ("b", b"junk"), ("c", b""), ("d", None), ("e", b"YUV4MPEG2 W0 H2 F25:1\n"), ("f", b"YUV4MPEG2 W2 H2 F1:0\n")]
    files = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in streams], "path string, content binary")
    frames = pictures.frame_scan(files, 0.0)
    assert {x.path: (x.n, bool(x.error)) for x in frames.where("n is null").collect()} == {p: (None, True) for p in "bcdef"}
    assert frames.where("path = 'a'").count() == 3 and {x.path for x in pictures.media_probe(files).where("error is not null").collect()} == set("bcdef")
    tensors = pictures.scan_tensors(frames, 4, 0).collect()
    assert {len(x.tensor) for x in tensors if x.path == "a"} == {48} and all(x.tensor is None for x in tensors if x.path != "a")


def test_bounded_batches_and_gauge(spark, tmp_path):
    for k in range(5):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    gauge, seen = streams.Gauge(), []
    spark.streams.addListener(gauge)
    try:
        rows = streams.bounded_stream(spark, str(tmp_path / "in"), "id long", 2)
        query = streams.batched_writer(rows, lambda batch, n: seen.append((n, batch.count())), str(tmp_path / "c")).start()
        assert query.awaitTermination(60)
        for _ in range(50):
            if gauge.rows == 50 and not gauge.running:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(gauge)
    assert sorted(n for _, n in seen) == [10, 20, 20] and gauge.rows == 50 and not gauge.running and gauge.batches >= 3


def test_missing_interval_is_an_error(spark):
    spans = spark.createDataFrame([(1, "a", "t", 0.0, 4.0), (1, "b", "t", 0.0, 4.0)], "media_id long, category string, tag string, start double, end double")
    known = spark.createDataFrame([(1, "a", 2.0)], "media_id long, category string, frame_interval double")
    from spanloom.operators import intervals as I

    assert I.with_interval(spans.where("category = 'a'"), known).first().frame_interval == 2.0
    with pytest.raises(Exception, match="category b"):
        I.with_interval(spans, known).collect()
