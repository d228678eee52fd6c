"""Exact quantiles of groups of any size.

Spark's own `percentile` keeps every distinct value of a group in one task. Here each wanted order statistic has a
value band that holds it. One aggregate per round counts the rows below and inside each band and sketches what lies
strictly between its ends at a fixed grid of ranks, from which the next, narrower band is read; all of it collapses
before the shuffle. Rows that tie with an end of a band are only counted: they are one value, whatever their number.
When no band has more than BAND_ROWS rows between its ends, or a band is a single value, the distinct values inside, at
most BAND_ROWS + 2, are counted and picked. A band that a round does not narrow is finished in that way too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.ranks import group_key
from sievework.session import cut_lineage

LINEAR = "linear"
ORDER = "order"
BAND_ROWS = 10_000
GRID = 128
ACCURACY = 4000
# a sketch is off by 1/ACCURACY of the ranks at most; twice that on either side is left as a margin
MARGIN = 2.0 / ACCURACY


def exact_quantiles(df: DataFrame, groups: Sequence[str], wanted: Mapping[str, Sequence[float]],
                    how: str = LINEAR, band_rows: int = BAND_ROWS) -> DataFrame:
    """One row per group, value column and probability: (groups…, column, prob, value, n).

    `wanted` lists the probabilities per value column; all of them share the same passes over `df`. NULL values
    are left out; NULL is a group value like any other. LINEAR interpolates at p·(n−1); ORDER takes the element
    with zero-based index floor(n·p).
    """
    columns = list(wanted)
    specs = [(j, float(p)) for j, c in enumerate(columns) for p in wanted[c]]
    data = df.select(group_key(groups).alias("_g"), *[F.col(c).cast("double").alias(f"_v{j}") for j, c in enumerate(columns)])
    bands = narrowed_bands(data, specs, how, band_rows)
    inside = []
    for i, (j, _) in enumerate(specs):
        v, b = F.col(f"_v{j}"), F.col("_b")[i]
        inside.append(F.when((b["low"] < b["high"]) & (v >= b["low"]) & (v <= b["high"]), F.struct(F.lit(i).alias("i"), v.alias("v"))))
    counted = (
        _beside(data, bands, groups).select("_g", F.explode(F.array_compact(F.array(*inside))).alias("_s"))
        .groupBy("_g", F.col("_s.i").alias("_i"), F.col("_s.v").alias("_v")).agg(F.count("*").alias("_c")))
    upto = F.sum("_c").over(Window.partitionBy("_g", "_i").orderBy("_v"))
    steps = counted.withColumn("_upto", upto)
    flat = bands.select("_g", F.posexplode("_b").alias("_i", "_w"))
    hits = steps.join(flat, ["_g", "_i"]).groupBy("_g", "_i").agg(*[
        F.max(F.when((F.col("_w.below") + F.col("_upto") > F.col(k)) & (F.col("_w.below") + F.col("_upto") - F.col("_c") <= F.col(k)),
                     F.col("_v"))).alias(name) for k, name in (("_w.first", "_low"), ("_w.last", "_high"))])
    found = flat.filter("_w.n > 0").join(hits, ["_g", "_i"], "left")
    single = F.col("_w.low") == F.col("_w.high")
    low, high = (F.when(single, F.col("_w.low")).otherwise(F.col(c)) for c in ("_low", "_high"))
    stop = F.raise_error(F.lit("an order statistic fell outside its band")).cast("double")
    value = F.when(low == high, low).otherwise(low + (high - low) * F.col("_w.part"))
    name = F.element_at(F.array(*[F.lit(columns[j]) for j, _ in specs]), F.col("_i") + 1)
    prob = F.element_at(F.array(*[F.lit(p) for _, p in specs]), F.col("_i") + 1)
    keys = [F.col(f"_g.{g}").alias(g) for g in groups]
    return found.select(*keys, name.alias("column"), prob.alias("prob"),
                        F.when(low.isNull() | high.isNull(), stop).otherwise(value).alias("value"), F.col("_w.n").alias("n"))


def _beside(data: DataFrame, bands: DataFrame, groups: Sequence[str]) -> DataFrame:
    # one row for an ungrouped call; else the planner broadcasts it only if the written size is small
    return data.join(bands if groups else F.broadcast(bands), "_g")


def _ranks(n: Column, p: float, how: str) -> tuple[Column, Column, Column]:
    """First and last wanted rank and the part of the way between them."""
    last = (n - 1).cast("double")
    place = F.lit(p) * last if how == LINEAR else F.least(F.floor(F.lit(p) * n).cast("double"), last)
    return F.floor(place), F.ceil(place), place - F.floor(place)


def narrowed_bands(data: DataFrame, specs: Sequence[tuple[int, float]], how: str, band_rows: int) -> DataFrame:
    """(_g, _b): per group an array with, for each spec, low, high, below, inside, n, first, last, part."""
    grid = [i / GRID for i in range(GRID + 1)]
    used = sorted({j for j, _ in specs})
    first_pass = [f for j in used for f in (
        F.count(f"_v{j}").alias(f"_n{j}"), F.min(f"_v{j}").alias(f"_min{j}"), F.max(f"_v{j}").alias(f"_max{j}"),
        F.percentile_approx(f"_v{j}", grid, ACCURACY).alias(f"_q{j}"))]
    start = cut_lineage(data.groupBy("_g").agg(*first_pass))
    whole = []
    for j, p in specs:
        n = F.col(f"_n{j}")
        first, last, part = _ranks(n, p, how)
        end = F.when(F.lit(p == 0.0), F.col(f"_min{j}")).when(F.lit(p == 1.0) & F.lit(how == LINEAR), F.col(f"_max{j}"))
        whole.append(_band(F.coalesce(end, F.col(f"_min{j}")), F.coalesce(end, F.col(f"_max{j}")), F.lit(0).cast("bigint"), n,
                           F.lit(0).cast("bigint"), n, F.lit(False), n, first, last, part, F.col(f"_q{j}")))
    bands = cut_lineage(start.select("_g", F.array(*whole).alias("_b")))
    while _widest(bands) > band_rows:
        edges = F.transform("_b", lambda b: F.when(_open(b) > band_rows, _cut(b)).otherwise(_kept(b)))
        bands = cut_lineage(_counted(data, bands.select("_g", edges.alias("_b")), specs, band_rows))
    return bands


FIELDS = ("low", "high", "below", "inside", "ties", "between", "stuck", "n", "first", "last", "part", "grid")


def _band(*values: Column) -> Column:
    """low and high; the rows below, inside, equal to low and strictly between (of which `grid` is a sketch); ranks."""
    return F.struct(*[v.alias(k) for k, v in zip(FIELDS, values, strict=True)])


def _kept(b: Column) -> Column:
    return _band(*[b[k] for k in FIELDS])


def _open(b: Column) -> Column:
    """The rows between the ends of a band that can still be narrowed."""
    return F.when((b["low"] < b["high"]) & ~b["stuck"], b["between"]).otherwise(0)


def _cut(b: Column) -> Column:
    """The band between the grid values on either side of the wanted ranks; an end stays where a rank ties with it."""
    before = b["below"] + b["ties"]

    def at(rank: Column, slack: float) -> Column:
        return ((rank - before) / b["between"] + slack) * GRID

    low = F.greatest(F.floor(at(b["first"], -MARGIN)) - 1, F.lit(0)).cast("int")
    high = F.least(F.ceil(at(b["last"] + 1, MARGIN)) + 1, F.lit(GRID)).cast("int")
    return _band(F.greatest(b["low"], F.when(low == 0, b["low"]).otherwise(F.get(b["grid"], low))),
                 F.least(b["high"], F.when(high == GRID, b["high"]).otherwise(F.get(b["grid"], high))),
                 *[b[k] for k in FIELDS[2:]])


def _counted(data: DataFrame, bands: DataFrame, specs: Sequence[tuple[int, float]], band_rows: int) -> DataFrame:
    """The bands with their counts and grids taken anew: one aggregate, nothing is exploded."""
    grid = [i / GRID for i in range(GRID + 1)]
    joined = data.join(bands, "_g")
    takes = [F.first("_b").alias("_b")]
    for i, (j, _) in enumerate(specs):
        v, b = F.col(f"_v{j}"), F.col("_b")[i]
        between = (v > b["low"]) & (v < b["high"])
        takes += [F.count_if(v < b["low"]).alias(f"_below{i}"), F.count_if((v >= b["low"]) & (v <= b["high"])).alias(f"_in{i}"),
                  F.count_if(v == b["low"]).alias(f"_ties{i}"), F.count_if(between).alias(f"_between{i}"),
                  F.percentile_approx(F.when(between, v), grid, ACCURACY).alias(f"_q{i}")]
    fresh = joined.groupBy("_g").agg(*takes)
    out = []
    for i in range(len(specs)):
        b, (below, inside, ties, between, sketch) = F.col("_b")[i], (F.col(f"_{k}{i}") for k in ("below", "in", "ties", "between", "q"))
        # all wanted ranks tie with one end: the band is that value
        at_low = (b["first"] >= below) & (b["last"] < below + ties)
        at_high = (b["first"] >= below + ties + between) & (b["last"] < below + inside)
        stuck = b["stuck"] | ((b["between"] > band_rows) & (between >= b["between"]))
        out.append(_band(F.when(at_high, b["high"]).otherwise(b["low"]), F.when(at_low, b["low"]).otherwise(b["high"]),
                         below, inside, ties, between, stuck, *[b[k] for k in FIELDS[7:11]], sketch))
    return fresh.select("_g", F.array(*out).alias("_b"))


def _widest(bands: DataFrame) -> int:
    """The most rows between the ends of a band that can still be narrowed."""
    return bands.agg(F.max(F.array_max(F.transform("_b", _open)))).first()[0] or 0
