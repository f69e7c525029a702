"""Overlap of interval sets, its loss, and the search for cluster parameters that lower it."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import KEY
from .segments import searched
from .sizes import small


def coalesced(spans: DataFrame) -> DataFrame:
    """Overlapping or touching intervals of a key as one, so that they measure as a set."""
    w = Window.partitionBy(*KEY).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_n", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("_g", F.sum("_n").over(w))
    return rows.groupBy(*KEY, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def measure(spans: DataFrame, keys: list[str]) -> DataFrame:
    """O-56: seconds covered."""
    return spans.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def _ends(spans: DataFrame, keys: list[str], side: int) -> DataFrame:
    """Both ends of every interval from one pass over it: (keys, t, a, d, la, ld, desired), for side 0 in a and la, 1 in d and ld.

    a, d: open intervals gained at t (empty intervals open nothing); la, ld: the interval's length, at its start.
    """
    none, length = F.lit(0), F.col("end") - F.col("start")
    step = lambda sign: F.when(F.col("start") < F.col("end"), sign).otherwise(0)
    end = lambda t, sign, l: F.struct(t.alias("t"), *((v if side == i else z).alias(n) for n, i, v, z in (("a", 0, step(sign), none), ("d", 1, step(sign), none), ("la", 0, l, F.lit(0.0)), ("ld", 1, l, F.lit(0.0)))))
    both = F.explode(F.array(end(F.col("start"), 1, length), end(F.col("end"), -1, F.lit(0.0))))
    return spans.select(*keys, both.alias("x")).select(*keys, "x.*", F.lit(side).alias("desired"))


def sweep(actual: DataFrame, desired: DataFrame, keys: list[str], span: float | None = None) -> DataFrame:
    """covered, wanted and shared seconds of each key, and n_desired (1 where a key has desired intervals, 0 elsewhere), from one pass over both inputs.

    Between two neighbouring ends the pairs in force are (open actual) x (open desired) intervals, so a key costs a sort
    of its ends.  With ``span``, ends are dealt by (key, stretch of span seconds), so that one key may have many tasks:
    each stretch's sums are carried to the next ones, and the stretches are swept by themselves.
    """
    rows = _ends(actual, keys, 0).unionAll(_ends(desired, keys, 1))
    if span is None:
        w = Window.partitionBy(*keys).orderBy("t")
        a0 = d0 = F.lit(0)
        after = F.lit(None).cast("double")
    else:
        rows = rows.withColumn("part", F.floor(F.col("t") / span))
        over = Window.partitionBy(*keys).orderBy("part")
        earlier = over.rowsBetween(Window.unboundedPreceding, -1)
        sums = rows.groupBy(*keys, "part").agg(F.sum("a").alias("a"), F.sum("d").alias("d"), F.min("t").alias("t"))
        carried = sums.select(*keys, "part", F.sum("a").over(earlier).alias("a0"), F.sum("d").over(earlier).alias("d0"), F.lead("t").over(over).alias("after"))
        mine = rows.alias("r").join(carried.alias("c"), [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "part")])
        rows = mine.select("r.*", "a0", "d0", "after")
        w = Window.partitionBy(*keys, "part").orderBy("t")
        a0, d0, after = F.coalesce("a0", F.lit(0)), F.coalesce("d0", F.lit(0)), F.col("after")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    until = F.coalesce(F.lead("t").over(w), after) - F.col("t")
    both = (a0 + F.sum("a").over(so_far)) * (d0 + F.sum("d").over(so_far)) * until
    rows = rows.select(*keys, both.alias("both"), "la", "ld", "desired")
    return rows.groupBy(*keys).agg(
        F.sum("la").alias("covered"), F.sum("ld").alias("wanted"), F.coalesce(F.sum("both"), F.lit(0.0)).alias("shared"), F.max("desired").alias("n_desired")
    )


def overlap(actual: DataFrame, desired: DataFrame, keys: list[str], span: float | None = None) -> DataFrame:
    """O-57, O-70: seconds in both, summed over all pairs, for keys with any; ``span`` as in ``sweep``."""
    return sweep(actual, desired, keys, span).where("shared > 0").select(*keys, "shared")


def loss(actual: DataFrame, desired: DataFrame, span: float | None = None) -> DataFrame:
    """O-58, O-71: |A| + |D| - 2 |A and D| for each desired key; other actual keys do not count."""
    known = sweep(actual, desired, KEY, span).where("n_desired > 0")
    return known.select(*KEY, (F.col("covered") + F.col("wanted") - 2 * F.col("shared")).alias("loss"))


def count_mismatch(actual: DataFrame, desired: DataFrame) -> DataFrame:
    """O-59: difference of the interval counts of each media."""
    a = actual.groupBy("media_id").agg(F.count("*").alias("a"))
    d = desired.groupBy("media_id").agg(F.count("*").alias("d"))
    return a.join(d, "media_id", "full").select("media_id", F.abs(F.coalesce("a", F.lit(0)) - F.coalesce("d", F.lit(0))).alias("mismatch"))


def parameter_grid(spark, **choices: list[float]) -> DataFrame:
    """O-75: all combinations of a few parameter lists, distinct; sized by the lists, not by data."""
    names = list(choices)
    rows = sorted(set(product(*choices.values())))
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{n} double" for n in names))


#: The clustering parameters that are tried where a request names none, 3,200 combinations.
DEFAULT_SWEEP = {
    "density_weight": [0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.1, 0.2],
    "gap_factor": [0.7, 0.8, 0.85, 0.87, 0.9, 0.93, 0.95, 1.0],
    "average_factor": [0.0, 0.1, 0.15, 0.17, 0.2, 0.225, 0.25, 0.275, 0.3, 0.4],
    "min_gap": [0.0, 1.0, 2.0, 4.0, 6.0],
}


def with_cover(buckets: DataFrame, desired: DataFrame) -> DataFrame:
    """``buckets`` (KEY, s, e, ...) with cover_s, cover_e, wanted: what the key's desired intervals cover before s and e, and whether there are any.

    At time t that is t * (begun - ended) - sum of begun starts + sum of ends: running sums over one sort of all ends.
    """
    zero = F.lit(0.0)
    more = F.struct(*(F.col(c) for c in buckets.columns if c not in KEY))
    place = lambda t, kind: F.struct(F.col(t).alias("t"), F.lit(0).alias("n"), zero.alias("m"), F.lit(kind).alias("kind"))
    real = lambda v: F.when(F.col("start") < F.col("end"), v)
    edge = lambda t, sign: F.struct(F.col(t).alias("t"), real(F.lit(sign)).otherwise(0).alias("n"), real(-sign * F.col(t)).otherwise(0.0).alias("m"), F.lit(0).alias("kind"))
    points = buckets.select(*KEY, more.alias("b"), F.explode(F.array(place("s", 1), place("e", 2))).alias("x"))
    edges = desired.select(*KEY, F.lit(None).cast(points.schema["b"].dataType).alias("b"), F.explode(F.array(edge("start", 1), edge("end", -1))).alias("x"))
    rows = points.unionAll(edges).select(*KEY, "b", "x.*")
    key = Window.partitionBy(*KEY)
    w = key.orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    cover = F.col("t") * F.sum("n").over(w) + F.sum("m").over(w)
    rows = rows.withColumns({"cover": cover, "wanted": F.max((F.col("kind") == 0).cast("int")).over(key) == 1}).where("kind > 0")
    found = rows.groupBy(*KEY, "b").agg(*(F.max(F.when(F.col("kind") == k, F.col("cover"))).alias(n) for k, n in ((1, "cover_s"), (2, "cover_e"))), F.first("wanted").alias("wanted"))
    return found.select(*KEY, "b.*", "cover_s", "cover_e", "wanted")


def grid_search(buckets: DataFrame, desired: DataFrame, grid: DataFrame, least: float, top: int = 10, tasks: int | None = None) -> DataFrame:
    """O-60, O-91: parameters by loss + 2 * count mismatch over all media, ascending; ties by the parameters.

    Buckets are read, swept against the desired intervals and cut into segments once, whatever the number of combinations; each
    task then evaluates every combination on its segments and hands on three sums for each.  The grid's rows, whose
    number is that of the parameter lists, go to the tasks with the code.
    """
    spark, p = buckets.sparkSession, grid.columns
    combos = [r.asDict() for r in grid.collect()]
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = searched(with_cover(buckets, desired), combos, least, tasks)
    total = desired.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0.0)).alias("wanted"), F.count("*").alias("n_wanted")).first()
    rows = spark.createDataFrame([(k, *(float(c[n]) for n in p)) for k, c in enumerate(combos)], "combo int, " + ", ".join(f"{n} double" for n in p))
    scored = rows.join(F.broadcast(sums), "combo", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mismatch = F.abs(F.coalesce("n", F.lit(0)) - total["n_wanted"])
    scored = scored.select(*p, (zero("covered") + total["wanted"] - 2 * zero("shared") + 2 * mismatch).alias("loss"), mismatch.alias("mismatch"))
    return scored.orderBy(F.round("loss", 6), *p).limit(top)


def desired_lookup(wanted: DataFrame, rules: DataFrame) -> DataFrame:
    """O-61: (media_id, display, intervals: JSON texts) to spans with the display tag's category, else "Unknown".

    Where several rules share a display tag, the last by (category, tag) wins.
    """
    last = rules.groupBy("display").agg(F.max_by("category", F.struct("category", "tag")).alias("category"))
    spans = wanted.select("media_id", "display", F.explode("intervals").alias("j")).select(
        "media_id", "display", F.from_json("j", "start double, end double").alias("x")
    )
    return spans.join(small(last), "display", "left").select("media_id", F.coalesce("category", F.lit("Unknown")).alias("category"), F.col("display").alias("tag"), "x.start", "x.end")
