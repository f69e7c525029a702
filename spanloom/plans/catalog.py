"""All registered interval-analytics queries; outputs are flat, with doubles rounded to six decimals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import documents as D
from ..operators import intervals as I
from ..operators import metrics as M
from ..operators import overlap as O
from ..operators import results as R
from ..operators import scoring as C
from ..operators import segments as G
from ..operators.sizes import small
from ..sources import files
from ..sources.store import ResultStore, work_folder
from ..streaming import complete as W
from . import api, dag, sql
from . import fixtures as X

_registered: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    _registered[f.__name__] = f
    return f


def _six(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(n, 6).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


def _spans(s, d, **kw):
    return I.run_lengths(X.detections(s, d, **kw), F.lit(X.INTERVAL))


def _cluster_spans(s, d):
    return _spans(s, d).where(F.col("confidence") >= X.THRESHOLD)


def _markers(s, d, merge=G.merge_buckets_segmented):
    return I.keep_long(merge(I.adjacency_buckets(_cluster_spans(s, d), F.lit(X.INTERVAL))), F.lit(X.LEAST))


def _wanted(s, d):
    return I.merge_gaps(I.with_rules(_spans(s, d), X.rules(s)), F.lit(X.INTERVAL))


# intervals ---------------------------------------------------------------------------------------------------


@query
def o51_rle_v1(s, d):
    return _six(_spans(s, d, decimals=1))


@query
def o51_rle_v3(s, d):
    det = X.detections(s, d).withColumn("confidence", F.lit(None).cast("double"))
    return _six(I.run_lengths(det, F.lit(X.INTERVAL), 4.0).drop("confidence"))


@query
def o47_rule_filter(s, d):
    return _six(I.with_rules(_spans(s, d), X.rules(s)).select(*I.KEY, "display", "start", "end", "confidence", "max_gap"))


@query
def o52_merge_gap(s, d):
    return _six(_wanted(s, d))


@query
def o53_buckets(s, d):
    return _six(I.adjacency_buckets(_cluster_spans(s, d), F.lit(X.INTERVAL)).drop("fi"))


@query
def o53_cluster(s, d):
    return _six(_markers(s, d, I.merge_buckets))


@query
def o53_cluster_windowed(s, d):
    return _six(_markers(s, d, I.merge_buckets_windowed))


@query
def o53_cluster_segmented(s, d):
    """Keys cut at gaps that nothing bridges; segments dealt over tasks."""
    return _six(_markers(s, d, lambda b: G.merge_buckets_segmented(b, tasks=int(s.conf.get("spark.sql.shuffle.partitions")))))


@query
def o54_merge_prop(s, d):
    return _six(I.merge_proportional(I.with_rules(_spans(s, d), X.rules(s)), str(X.INTERVAL)))


@query
def o54_merge_prop_streamed(s, d):
    return _six(G.merge_proportional_streamed(I.with_rules(_spans(s, d), X.rules(s)), str(X.INTERVAL)))


@query
def o55_totals(s, d):
    return _six(I.totals(_spans(s, d), X.rules(s), F.lit(X.INTERVAL), X.media(s, d)).drop("required_duration"))


@query
def o55_tags(s, d):
    return I.assigned_tags(I.totals(_spans(s, d), X.rules(s), F.lit(X.INTERVAL), X.media(s, d)))


@query
def o56_measure(s, d):
    return _six(O.measure(_markers(s, d), I.KEY))


@query
def o57_overlap(s, d):
    return _six(O.overlap(_markers(s, d), _wanted(s, d), I.KEY))


@query
def o57_overlap_stretches(s, d):
    """Ends dealt by key and stretch of five days."""
    return _six(O.overlap(_markers(s, d), _wanted(s, d), I.KEY, span=120.0))


@query
def o58_loss(s, d):
    return _six(O.loss(_markers(s, d), _wanted(s, d)))


@query
def o59_count_mismatch(s, d):
    return O.count_mismatch(_markers(s, d), _wanted(s, d))


@query
def o60_grid(s, d):
    buckets = I.adjacency_buckets(_cluster_spans(s, d), F.lit(X.INTERVAL))
    return _six(O.grid_search(buckets, _wanted(s, d), O.parameter_grid(s, **O.DEFAULT_SWEEP), X.LEAST))


@query
def o61_desired_lookup(s, d):
    shown = F.when(F.col("event_type") == "view", "Viewing").when(F.col("event_type") == "click", "Clicking").otherwise(F.col("event_type"))
    span = F.to_json(F.struct(F.col("event_id").cast("double").alias("start"), (F.col("event_id") + 12).cast("double").alias("end")))
    wanted = X.table(s, d, "events").select(F.col("user_id").alias("media_id"), shown.alias("display"), F.array(span).alias("intervals"))
    return O.desired_lookup(wanted, X.rules(s))


@query
def o65_interval(s, d):
    stored = X.stored_models(s, d)
    spans = _model_spans(s, d, "x").join(stored.select("media_id", "category"), ["media_id", "category"], "left_semi")
    return _six(I.with_interval(spans, stored).select("media_id", "category", "start", "frame_interval"))


@query
def o62_methods(s, d):
    spans, parts = I.with_rules(_spans(s, d), X.rules(s)), None
    for name in sorted(api.METHODS):
        found = api.METHODS[name](spans, X.INTERVAL).groupBy("media_id", "category", "tag").agg(F.count("*").alias("markers")).withColumn("method", F.lit(name))
        parts = found if parts is None else parts.unionByName(found)
    return parts


@query
def o63_tag_info(s, d):
    none = s.createDataFrame([], "media_id long, category string")
    return api.tag_info(_spans(s, d), none, X.rules(s), X.media(s, d), X.INTERVAL, "gap").tags


@query
def o114_pipeline(s, d):
    """A spec whose steps stand in reverse order; they run in order of their inputs."""
    dag.step("catalog_spans")(lambda found: I.run_lengths(found, F.lit(X.INTERVAL)))
    dag.step("catalog_markers")(lambda spans, rules: I.merge_gaps(I.with_rules(spans, rules), F.lit(X.INTERVAL)))
    spec = {
        "inputs": ["found", "rules"], "output": "markers", "short_name": "catalog", "version": 1.0,
        "models": [{"name": "catalog_markers", "inputs": ["spans", "rules"], "outputs": ["markers"]}, {"name": "catalog_spans", "inputs": ["found"], "outputs": ["spans"]}],
    }
    return _six(dag.Pipeline(spec).run(X.detections(s, d), X.rules(s)))


# rules and scalars -------------------------------------------------------------------------------------------


@query
def o37_duration_literal(s, d):
    cells = F.array(*(F.lit(x) for x in ("12", "12s", "5%", "abc", "", "0", "-1", "5d", "1e2", ".5", " 7 ", "10 %", "5% ", "12ss", None)))
    rows = X.table(s, d, "nation").select("n_nationkey", F.explode(cells).alias("cell"))
    return _six(rows.select("n_nationkey", "cell", S.duration_literal(F.col("cell"), F.col("n_nationkey") * 100.0).alias("seconds")))


@query
def o38_defaults(s, d):
    """Nations as rule rows with empty, missing, absolute and relative cells, under a configured default."""
    return _six(X.resolved(X.nation_rules(s, d), 500.0, {"max_gap": "9", "tag_threshold": None}))


@query
def o39_rename(s, d):
    return X.detections(s, d).join(small(X.rules(s)), ["category", "tag"]).groupBy("display").agg(F.count("*").alias("n"))


@query
def o22_sample(s, d):
    rate, interval = F.col("media_id") % 5 * 12.5 + 12.5, F.lit(0.5)
    rows = X.frames(s, d).withColumn("step", S.frame_step(rate, interval))
    return rows.where("n % step = 0").select("media_id", "n", "step")


@query
def o24_timestamps(s, d):
    rate = F.col("media_id") % 5 * 12.5 + 12.5
    interval = F.when(F.col("media_id") % 3 == 0, 0.0).otherwise(0.5)
    rows = X.frames(s, d).withColumn("step", S.frame_step(rate, interval)).where("n % step = 0").withColumn("k", F.expr("n div step"))
    return _six(rows.select("media_id", "n", S.frame_time(F.col("k"), F.col("n"), rate, interval).alias("seconds")))


@query
def o25_ordinals(s, d):
    backend = F.element_at(F.array(F.lit("frame"), F.lit("sequence"), F.lit("gpu")), (F.col("media_id") % 3 + 1).cast("int"))
    rows = X.frames(s, d).where("n % 12 = 0").withColumn("k", F.expr("n div 12"))
    return rows.select("media_id", "n", S.frame_label(backend, F.col("n"), F.col("k"), F.lit(12)).cast("long").alias("label"))


@query
def o26_target_rate(s, d):
    i = F.col("l_discount") * 40 - 0.4
    return _six(X.table(s, d, "lineitem").select(F.round(i, 6).alias("i")).distinct().select("i", S.target_rate(F.col("i")).alias("rate")))


@query
def o27_plain_decimal(s, d):
    return X.table(s, d, "part").select("p_partkey", S.plain_decimal(F.col("p_retailprice") / 8).alias("shown"))


@query
def o28_vr_crop(s, d):
    return X.table(s, d, "part").select("p_partkey", S.crop(F.col("p_size") * 10 + 1, F.col("p_partkey") % 900 + 1).alias("c")).select("p_partkey", "c.*")


@query
def o29_middle(s, d):
    frames = F.sequence(F.lit(0), F.col("p_size"))
    return X.table(s, d, "part").select("p_partkey", S.middle(frames).alias("middle"))


@query
def o30_channels(s, d):
    e = X.table(s, d, "embeddings").select("vec_id", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.slice("embedding", 1, n).alias("c")) for n in (1, 2, 3, 4)))).alias("x"))
    c = S.three_channels(F.col("x.c"))
    return _six(e.select("vec_id", "x.n", c[0].cast("double").alias("r"), c[1].cast("double").alias("g"), c[2].cast("double").alias("b")))


@query
def o33_normalise(s, d):
    """Whole vectors as pixels of three channels; the last one's missing channels are 0."""
    three = lambda k: F.transform(F.array(*map(F.lit, range(3))), lambda c: F.abs(F.coalesce(F.get("embedding", k * 3 + c).cast("double"), F.lit(0.0))) * 255.0)
    rows = X.table(s, d, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("embedding") - 1) / 3).cast("int")), three)).alias("pixel", "values"))
    rows = rows.select("vec_id", "pixel", *(S.normalised(S.scaled(F.col("values")), p).alias(f"p{p}") for p in (0, 1)))
    return _six(rows.select("vec_id", "pixel", *(F.col(f"p{p}")[i].alias(f"p{p}_{i}") for p in (0, 1) for i in range(3))))


@query
def o34_shape(s, d):
    p = X.table(s, d, "part").select("p_partkey", (F.col("p_size") % 5).alias("c"), F.when(F.col("p_partkey") % 2 == 0, 224).otherwise(384).alias("h"), F.lit(224).alias("w"))
    return p.select("p_partkey", S.shape_error(F.col("c"), F.col("h"), F.col("w"), 224).alias("error"))


@query
def o40_batches(s, d):
    p = X.table(s, d, "part")
    return p.select("p_partkey", S.batch_size(F.col("p_retailprice") / 7, F.col("p_size") % 10).alias("batch"))


@query
def o02_zip_split(s, d):
    path = F.concat(F.col("url"), F.when(F.col("page_id") % 3 == 0, "/Set.ZIP\\a\\b.png").when(F.col("page_id") % 3 == 1, "/x.zip.zip//c.png").otherwise("/x.zipper/d.png"))
    return X.table(s, d, "pages").select("page_id", S.archive_path(path).alias("archive"), S.archive_member(path).alias("member"))


@query
def o03_member_name(s, d):
    path = F.concat(F.lit("//"), F.replace(F.col("url"), F.lit("/"), F.lit("\\")))
    return X.table(s, d, "pages").select("page_id", S.member_name(path).alias("member"))


@query
def o14_backend(s, d):
    wanted = F.element_at(F.array(F.lit("auto"), F.lit("gpu"), F.lit("frame"), F.lit(None).cast("string")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return X.table(s, d, "part").select("p_partkey", S.active_backend(wanted, True).alias("with_gpu"), S.active_backend(wanted, False).alias("without"))


@query
def o05_normalise_path(s, d):
    """Paths with backslashes, of which every other url is listed with forward ones."""
    pages = X.table(s, d, "pages")
    listed = pages.where("page_id % 2 = 0").select(F.trim("url").alias("path"))
    rows = pages.select("page_id", F.concat(F.lit("  "), F.replace(F.col("url"), F.lit("/"), F.lit("\\")), F.lit(" ")).alias("path"))
    rows = files.with_existence(rows, F.replace(F.trim("path"), F.lit("\\"), F.lit("/")), listed)
    return rows.select("page_id", S.normal_source(F.col("path"), F.col("known")).alias("source"))


@query
def o06_url_scheme(s, d):
    path = F.when(F.col("page_id") % 5 == 0, "  ").when(F.col("page_id") % 5 == 1, F.col("url")).when(F.col("page_id") % 5 == 2, F.expr("substring(url, 9)")).when(F.col("page_id") % 5 == 3, "1x://y")
    pages = X.table(s, d, "pages")
    listed = pages.where("page_id % 2 = 0").select(F.expr("substring(url, 9)").alias("path"))
    rows = files.with_existence(pages.select("page_id", path.alias("path")), F.trim("path"), listed)
    return rows.select("page_id", S.path_error(F.col("path"), F.col("known")).alias("error"))


@query
def o07_duration(s, d):
    p = X.table(s, d, "part")
    seconds = F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice"))
    rate = F.when(F.col("p_partkey") % 5 != 0, F.col("p_size").cast("double"))
    frames = F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey"))
    return _six(p.select("p_partkey", S.duration(seconds, frames, rate).alias("seconds")))


@query
def o09_frame_rate(s, d):
    p = X.table(s, d, "part")
    text = F.element_at(F.array(F.col("p_size").cast("string"), F.concat_ws("/", F.col("p_partkey"), F.lit("1001")), F.lit("30/0"), F.col("p_brand"), F.lit(None).cast("string")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return _six(p.select("p_partkey", S.frame_rate(text).alias("rate")))


@query
def o12_decoder(s, d):
    p = X.table(s, d, "part")
    codec = F.element_at(F.array(F.lit("H264 (High)"), F.lit("HEVC-main"), F.lit("gif"), F.lit("vp9")), (F.col("p_partkey") % 4 + 1).cast("int"))
    pixel = F.when(F.col("p_size") % 6 == 0, "yuv444p").otherwise("yuv420p")
    return p.select("p_partkey", S.hardware_decoder(codec, pixel).alias("decoder"), S.decode_backend(F.col("p_size") * 100, F.col("p_retailprice")).alias("backend"))


# scoring -----------------------------------------------------------------------------------------------------


@query
def o41_linear_head(s, d):
    return _six(X.table(s, d, "embeddings").select("vec_id", C.linear_head(X.WEIGHTS)(F.col("embedding")).alias("score")))


def _tagged(s, d):
    return C.threshold_tags(X.scores(s, d), X.tags(s), 0.55)


@query
def o43_threshold(s, d):
    return _six(_tagged(s, d).drop("model"))


@query
def o43_all_models(s, d):
    """Three models of eight tags in one pass over whole vectors."""
    frames = X.table(s, d, "embeddings").select(F.col("vec_id").alias("media_id"), F.col("label").cast("double").alias("frame_index"), "embedding")
    return _six(C.score_all(frames, X.heads(), vector="embedding"))


@query
def o80_run_metrics(s, d):
    """Metrics that the scoring job takes of itself, with models that ran and tags by model."""
    stats = Observation("o80")
    frames = X.table(s, d, "embeddings").select(F.col("vec_id").alias("media_id"), F.col("label").cast("double").alias("frame_index"), "embedding")
    by_model = C.score_all(frames, X.heads(), skip=("c0", "c1", "c2"), vector="embedding", stats=stats).groupBy("model").agg(F.count("*").alias("tags")).collect()
    seen = stats.get
    return s.createDataFrame([(seen["frames"], seen["models"], r["model"], r["tags"]) for r in by_model], "frames long, models int, model string, tags long")


@query
def o44_route(s, d):
    return _six(C.route(_tagged(s, d), X.mappings(s)))


@query
def o45_image_rules(s, d):
    return _six(C.image_rules(C.route(_tagged(s, d), X.mappings(s)), X.image_rule_rows(s), True))


@query
def o46_passthrough(s, d):
    tags = F.when(F.col("page_id") % 2 == 0, F.array(F.lit("t"), F.col("page_id").cast("string")))
    return X.table(s, d, "pages").select("page_id", F.array_join(C.image_passthrough(tags), ",").alias("tags"))


@query
def o48_skip(s, d):
    skip = F.array(*(F.lit(x) for x in ("c0", "c1", "c2", "d0", "d1")))
    return X.nation_models(s, d).select("name", C.skipped(F.col("categories"), skip).alias("skipped"))


@query
def o49_used_models(s, d):
    skip = F.array(*(F.lit(x) for x in ("c0", "c1", "c2", "d0", "d1")))
    return X.nation_models(s, d).where(~C.skipped(F.col("categories"), skip)).select("name", "identifier", "version")


@query
def o72_coalesce(s, d):
    det = X.detections(s, d)
    parts = [det.where(F.col("category") == c) for c in ("engagement", "conversion", "system")]
    return C.combine_models(*parts).groupBy("media_id", "frame_index").agg(F.count("*").alias("tags"), F.count_distinct("category").alias("categories"))


@query
def o73_complete(s, d):
    """Expected, received and missing outputs of each media: what the stream of the same rows emits."""
    return W.complete_media(*X.outputs(s, d))


@query
def o73_await(s, d):
    return C.await_frames(X.detections(s, d))


# stored results ----------------------------------------------------------------------------------------------


@query
def o98_reprocess(s, d):
    return R.plan_reuse(X.active_models(s, d), X.stored_models(s, d)).select("media_id", "category", "need")


@query
def o99_plan(s, d):
    return R.work_by_media(R.plan_reuse(X.active_models(s, d), X.stored_models(s, d)))


def _model_spans(s, d, which):
    k = F.col("c_custkey")
    rows = X.table(s, d, "customer").select(k.alias("media_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("category"))
    return rows.select("media_id", "category", F.lit(which).alias("tag"), (F.col("media_id") % 10).cast("double").alias("start"), (F.col("media_id") % 10 + 4).cast("double").alias("end"))


@query
def o104_short_circuit(s, d):
    return R.work_by_media(R.plan_reuse(X.active_models(s, d), X.stored_models(s, d))).where("not work").select("media_id", "skipped")


@query
def o99_skip_lists(s, d):
    return R.skip_lists(R.plan_reuse(X.active_models(s, d), X.stored_models(s, d))).select("media_id", F.array_join("skip", ",").alias("skip"))


@query
def o101_upsert(s, d):
    updated = R.updated_categories(X.stored_models(s, d), X.active_models(s, d))
    return _six(R.upsert(_model_spans(s, d, "old"), _model_spans(s, d, "new"), updated))


@query
def o101_store(s, d):
    """Stored spans and models in a versioned store, updated twice; the second batch of the same number has no effect."""
    kinds = {"spans": "media_id long, category string, tag string, start double, end double", "models": "media_id long, category string, frame_interval double, threshold double, version double, ai_model_id int, file_name string"}
    store, old = ResultStore(s, work_folder(s), kinds, buckets=16), X.stored_models(s, d)
    every = _model_spans(s, d, "old")
    store.update({"spans": every, "models": old}, every.select("media_id", "category"), batch=("first", 0))
    updated = R.updated_categories(store.read("models"), X.active_models(s, d))
    for tag in ("new", "repeated"):
        store.update({"spans": _model_spans(s, d, tag), "models": X.active_models(s, d)}, updated, batch=("stream", 0))
    stored = store.read("models").select("media_id", "category", F.col("ai_model_id").alias("stored_model"))
    return _six(store.read("spans").join(stored, ["media_id", "category"], "left"))


@query
def o50_upgrade(s, d):
    spans, _ = R.upgrade_v0(X.v0_json(s, d), X.rules(s).select("tag", "category"), X.v0_model_map(s))
    return _six(spans)


@query
def o50_upgrade_models(s, d):
    _, models = R.upgrade_v0(X.v0_json(s, d), X.rules(s).select("tag", "category"), X.v0_model_map(s))
    return _six(models)


def _legacy_docs(s, d):
    return D.parsed(X.v0_json(s, d))


@query
def o50_upgrade_document(s, d):
    """The oldest format as variants, written in the newer one, parsed and read again."""
    docs = _legacy_docs(s, d)
    found = D.spans(docs, X.rules(s).select("tag", "category"))
    return _six(D.spans(D.parsed(D.rewritten(docs, found, D.models(docs, X.v0_model_map(s))))))


@query
def o50_document_models(s, d):
    docs = _legacy_docs(s, d)
    written = D.rewritten(docs, D.spans(docs), D.models(docs, X.v0_model_map(s)))
    return _six(D.models(D.parsed(written)))


@query
def o18_documents(s, d):
    """Built results of two formats, the newer with a field that nothing here knows: kinds, spans and that field after rewriting."""
    models = X.media(s, d).select("media_id", F.lit("m").alias("name"), F.lit(1).alias("identifier"), F.lit(1.0).alias("version"), F.array(F.lit("system")).alias("categories"), F.lit("tag").alias("type"))
    text = R.build_v3(X.detections(s, d), models, X.media(s, d), X.INTERVAL, 4.0).withColumn("json", F.regexp_replace("json", r"\}$", ',"label":{"of":[1,2]}}'))
    docs = D.parsed(text)
    again = D.parsed(D.rewritten(docs, D.spans(docs), D.listed_models(docs).select("media_id", F.explode("categories").alias("category"), F.lit(6.0).alias("frame_interval"), F.lit(0.3).alias("threshold"), "version", F.col("identifier").alias("ai_model_id"), F.col("name").alias("file_name"))))
    spans = D.spans(again).groupBy("media_id").agg(F.count("*").alias("spans"), F.sum("start").alias("starts"))
    label = F.to_json(F.try_variant_get("doc", "$.label", "variant")).alias("label")
    kinds = docs.select("media_id", F.col("kind").alias("was")).join(again.select("media_id", "kind", label), "media_id")
    return _six(kinds.join(spans, "media_id").join(D.models(again).select("media_id", "category", "frame_interval", "file_name"), "media_id"))


@query
def o18_dispatch(s, d):
    text = F.when(F.col("event_id") % 4 == 0, '{"schema_version": 1, "timespans": {}}').when(F.col("event_id") % 4 == 1, '{"schema_version": 3}').when(F.col("event_id") % 4 == 2, F.col("props"))
    return X.table(s, d, "events").select("event_id", R.json_kind(text).alias("kind"))


@query
def o100_build_v1(s, d):
    # the stored model of one category stands for two, that of the other for the third; media without it have two
    each = F.explode(F.when(F.col("category") == "a", F.array(F.lit("engagement"), F.lit("conversion"))).otherwise(F.array(F.lit("system")))).alias("category")
    models = X.stored_models(s, d).select("media_id", each, "frame_interval", "threshold", "version", "ai_model_id", "file_name")
    spans, checked = R.build_v1(X.detections(s, d), models, F.lit(X.INTERVAL))
    text = R.to_json_v1(spans, checked, X.media(s, d))
    return _six(R.spans_of_v1(text))


@query
def o102_build_v3(s, d):
    models = X.media(s, d).select("media_id", F.lit("m").alias("name"), F.lit(1).alias("identifier"), F.lit(1.0).alias("version"), F.array(F.lit("system")).alias("categories"), F.lit("tag").alias("type"))
    text = R.build_v3(X.detections(s, d), models, X.media(s, d), X.INTERVAL, 4.0)
    return _six(R.spans_of_v1(text).drop("confidence"))


# metrics, checks, picking ------------------------------------------------------------------------------------


@query
def o81_apportion(s, d):
    rows = X.table(s, d, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("batch"), F.col("l_suppkey").alias("root")).agg(F.count("*").alias("items"))
    return _six(M.apportion(rows.withColumn("elapsed", (F.col("batch") + 1) * 0.25)))


@query
def o82_metrics(s, d):
    runs = X.table(s, d, "orders").select(
        F.col("o_custkey").alias("request"), F.when(F.col("o_orderkey") % 9 == 0, "gpu").otherwise("cpu").alias("backend"),
        (F.col("o_totalprice") / 3141593.0).alias("preprocess_s"), (F.col("o_totalprice") / 713467.0).alias("inference_s"), (F.col("o_orderkey") % 50).alias("frames"),
    )
    return _six(M.request_metrics(runs))


@query
def o84_health(s, d):
    return M.health(X.nation_models(s, d))


@query
def o85_overlap_check(s, d):
    models = X.table(s, d, "supplier").select(F.col("s_nationkey").alias("media_id"), F.concat(F.lit("c"), F.col("s_suppkey") % 20).alias("category"))
    return R.overlapping_categories(models)


@query
def o86_uniform(s, d):
    return M.uniform(X.nation_models(s, d), "pipeline", "image_size", "norm")


@query
def o92_model_order(s, d):
    return M.pick_order(X.nation_models(s, d)).select("first_category", "identifier", "name")


@query
def o94_union(s, d):
    a, b = (X.detections(s, d).where(c).select("media_id", "tag") for c in ("confidence >= 0.5", "frame_index < 100"))
    return a.union(b).distinct()


@query
def o95_available(s, d):
    models = X.nation_models(s, d)
    return M.available(models, models.where("identifier % 3 = 0")).select("name")


@query
def o96_compatible(s, d):
    models = X.nation_models(s, d)
    return M.compatible(models, models.where("identifier in (2, 5)")).select("name", "image_size")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_registered)


def oracle_sql() -> dict[str, str]:
    return sql.queries(O.DEFAULT_SWEEP)
