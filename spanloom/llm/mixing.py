"""Mixing sources to target weights by Poisson replication, in built-in functions only.

A document of group g is repeated Poisson(rate_g) times, rate_g = budget * weight_g / size_g.  The draw inverts
the Poisson distribution at a uniform number hashed from the seed and doc_id, so a run can be repeated, a lost
task recomputed, and no state is shared.  Copies are dealt into a global order by a hash of (seed, doc_id, copy).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Group of every source that no weight names, null included.
REST = "*"


def _uniform(*parts):
    """53 bits of an MD5 digest as a number in [0, 1); the same in other SQL engines."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def group_rates(docs: DataFrame, weights: dict[str, float], *, budget: float = 1.0, size: str | None = None) -> dict[str, float]:
    """Each group's repetition rate; ``budget`` is the result's size as a multiple of the input's.

    size: a numeric column to measure by (null counts 0), or None to count documents.  At most one row for each
    weight comes to the driver.
    """
    measure = F.sum(F.coalesce(F.col(size), F.lit(0)).cast("double")) if size else F.count(F.lit(1)).cast("double")
    found = {r.g: float(r.n or 0) for r in docs.groupBy(_group(weights).alias("g")).agg(measure.alias("n")).collect()}
    weights = {g: w for g, w in weights.items() if w > 0 and found.get(g, 0) > 0}
    total, parts = sum(found.values()), sum(weights.values())
    return {g: budget * total * w / parts / found[g] for g, w in sorted(weights.items())}


def _group(weights: dict[str, float]):
    named = [s for s in weights if s != REST]
    return F.when(F.col("source").isin(named), F.col("source")).otherwise(REST) if named else F.lit(REST)


def distribution(rate: float) -> tuple[int, list[float]]:
    """(k, Poisson probabilities of at most k, k + 1, ...); what lies below k, and remains at the end, is below 2**-54.

    Weights are relative to the likeliest count, so no rate is too large; the list is about 17 * sqrt(rate) long.
    """
    mode = int(rate)
    below, k, w = [], mode, 1.0
    while k > 0 and w > 2.0**-60:
        w *= k / rate
        k -= 1
        below.append(w)
    above, j, w = [], mode, 1.0
    while w > 2.0**-62:
        j += 1
        w *= rate / j
        above.append(w)
    weights = [*reversed(below), 1.0, *above]
    whole, total, steps = math.fsum(weights), 0.0, []
    for x in weights:
        total += x
        steps.append(total / whole)
    return k, steps


def _free(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until it is none of the columns."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def poisson_mix(docs: DataFrame, weights: dict[str, float], *, budget: float = 1.0, size: str | None = None, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """``docs`` rows repeated by their Poisson counts, in a global shuffle, with a ``copy`` number from 1.

    Sources without a weight share that of ``REST``; groups without one (or with weight 0) are left out, since
    their target is none.  Rows with one doc_id have one count and, for each copy number, one place in the order, in
    which they may stand in any sequence; a null doc_id hashes as the empty string.  A column named ``copy`` is
    replaced; all others, whatever their names, and texts of any length, null or empty, pass through.
    """
    rates = group_rates(docs, weights, budget=budget, size=size)
    drawn = {g: distribution(r) for g, r in rates.items()}
    by_group = lambda f, kind: F.create_map(*(x for g, d in drawn.items() for x in (F.lit(g), f(d)))) if drawn else F.lit(None).cast(f"map<string,{kind}>")
    steps = by_group(lambda d: F.array(*map(F.lit, d[1])), "array<double>")
    least = by_group(lambda d: F.lit(d[0]), "int")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    u = _uniform(F.lit(seed), key)
    group = _group(weights)
    # the draw is an array element, so that it is hashed once and not for each step of the distribution
    below = F.transform(F.array(u), lambda v: F.size(F.filter(F.element_at(steps, group), lambda c: c <= v)))
    count = F.coalesce(F.element_at(below, 1) + F.element_at(least, group), F.lit(0))
    docs = docs.drop("copy")
    n, place = _free(docs, "_n"), _free(docs, "_place")
    copies = docs.withColumn(n, count).where(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n)
    order = F.md5(F.concat_ws(":", F.lit(seed), key, F.col("copy").cast("string")))
    out = copies.withColumn(place, order).orderBy(place).drop(place)
    return out.select(*keep) if keep else out
