"""Exact quantiles of any number of columns in two scans, one where sketches are stored.

The first scan makes a mergeable KLL sketch of every column. A sketch brackets each wanted rank between two values
a few thousandths of the rows apart. The second scan counts, for all columns at once, the rows below each
bracket and groups the values inside it; the value at the rank follows from the counts. A bracket that does not hold
its rank (sketches are right with high probability only) is opened on that side and scanned again. Sketches can be kept
per day and merged, so that only new days are sketched. Nothing but bounds and counts reaches the driver.
"""

from __future__ import annotations

import math

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cardwarden.session import delete_path, scratch_path

#: Size of a sketch: ranks are off by an eighth of a percent of the rows at most, nearly always.
SKETCH_SIZE = 4096
#: How far from a rank its bracket reaches, as a share of the rows.
SLACK = 0.004
#: Slices of a bracket's width; only the slice that holds the rank is sorted.
SLICES = 1024


def _numeric(column: str) -> Column:
    return F.col(column).cast("double")


def column_sketches(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``(*by, column_name, n, nans, sketch)`` per column, in one scan: non-null rows, NaNs and a sketch of the rest."""
    entries = [F.struct(
        F.lit(c).alias("column_name"), F.count(c).alias("n"), F.count_if(F.isnan(_numeric(c))).alias("nans"),
        F.kll_sketch_agg_double(F.when(~F.isnan(_numeric(c)), _numeric(c)), F.lit(SKETCH_SIZE)).alias("sketch")) for c in columns]
    return df.groupBy(*(by or [])).agg(F.array(*entries).alias("e")).select(*(by or []), F.inline("e"))


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]],
                    stored: DataFrame | None = None) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, ignoring nulls; ``None`` for an empty column.

    NaN is above all numbers. ``stored`` are ``column_sketches`` of exactly these rows, per day or otherwise.
    """
    if not wanted:
        return {}
    sketches = column_sketches(df, list(wanted)) if stored is None else stored.filter(F.col("column_name").isin(list(wanted)))
    merged = sketches.groupBy("column_name").agg(
        F.sum("n").alias("n"), F.sum("nans").alias("nans"), F.kll_merge_agg_double("sketch").alias("sketch"))
    # every rank that is wanted, as a share of the rows, asked of the sketches once
    shares = {c: sorted({s for p in ps for s in _reach(p, SLACK)}) for c, ps in wanted.items()}
    alike: dict[tuple[float, ...], list[str]] = {}
    for c, own in shares.items():
        alike.setdefault(tuple(own), []).append(c)
    asked = F.coalesce(*[F.when(F.col("column_name").isin(columns), F.kll_sketch_get_quantile_double(
        "sketch", F.array(*map(F.lit, own)))) for own, columns in alike.items()])
    rows = merged.select("column_name", "n", "nans", F.when(F.col("n") > F.col("nans"), asked).alias("q")).collect()
    sizes = {r["column_name"]: (r["n"], r["nans"]) for r in rows}
    bounds = {r["column_name"]: dict(zip(shares[r["column_name"]], r["q"] or [])) for r in rows}
    found: dict[tuple[str, int], float] = {}
    brackets: dict[tuple[str, float | None, float | None], list[int]] = {}
    for c, ps in wanted.items():
        n, nans = sizes.get(c, (0, 0))
        for p in ps if n else []:
            for r in {math.floor((n - 1) * p), math.ceil((n - 1) * p)}:
                if r >= n - nans:
                    found[c, r] = math.nan
                    continue
                low, high = _reach(p, SLACK)
                bracket = (c, bounds[c][low], bounds[c][high])
                brackets.setdefault(bracket, []).append(r)
    while brackets:
        at_rank, missed = _values_at_ranks(df, brackets)
        found |= at_rank
        brackets = {}
        for c, low, high, r, is_below in missed:  # the side that missed is opened
            brackets.setdefault((c, None if is_below else low, high if is_below else None), []).append(r)
    return {c: [_interpolated({r: v for (k, r), v in found.items() if k == c}, (sizes[c][0] - 1) * p)
                if sizes.get(c, (0, 0))[0] else None for p in ps] for c, ps in wanted.items()}


def _reach(share: float, slack: float) -> tuple[float, float]:
    return max(0.0, share - slack), min(1.0, share + slack)


def _interpolated(at_rank: dict[int, float], place: float) -> float:
    low, high = at_rank[math.floor(place)], at_rank[math.ceil(place)]
    return low + (high - low) * (place - math.floor(place)) if low != high else low


def _values_at_ranks(df: DataFrame, brackets: dict[tuple[str, float | None, float | None], list[int]]):
    """Values at the ranks that lie in their brackets, ``{(column, rank): value}``, and those that do not."""
    spark, keys = df.sparkSession, list(brackets)
    below, inside = Observation(), []
    counts = []
    for j, (c, low, high) in enumerate(keys):
        v = _numeric(c)
        counts.append((F.count_if(v < F.lit(low)) if low is not None else F.lit(0).cast("bigint")).alias(f"below_{j}"))
        within = v.isNotNull() & ~F.isnan(v)
        within = within & (v >= F.lit(low)) if low is not None else within
        within = within & (v <= F.lit(high)) if high is not None else within
        inside.append(F.when(within, F.struct(F.lit(j).alias("j"), (v + F.lit(0.0)).alias("v"))))
    # a bracket of two equal bounds, as ties give, is one group per task
    values = df.select(*dict.fromkeys(c for c, _, _ in keys)).observe(below, *counts).select(
        F.explode(F.array_compact(F.array(*inside))).alias("e")).groupBy("e.j", "e.v").agg(F.count("*").alias("n"))
    path = scratch_path(spark, "brackets")
    values.write.parquet(path)
    held = spark.read.schema("j int, v double, n bigint").parquet(path)
    try:
        counted = below.get
    except Py4JJavaError:  # Spark drops the counts with the plan where no bracket holds a row
        counted = df.agg(*counts).first().asDict()
    under = [counted[f"below_{j}"] for j in range(len(keys))]
    ranks = spark.createDataFrame([(j, r, r - under[j]) for j, key in enumerate(keys) for r in sorted(set(brackets[key]))],
                                  "j int, rank bigint, place bigint")
    spans = held.groupBy("j").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("total"))
    sliced = held.join(F.broadcast(spans), "j").withColumn("slice", F.coalesce(F.try_divide(
        (F.col("v") - F.col("low")) * SLICES, F.col("high") - F.col("low")).cast("int"), F.lit(0)))
    per_slice = sliced.groupBy("j", "slice").agg(F.sum("n").alias("n"))
    running = Window.partitionBy("j").orderBy("slice")
    starts = per_slice.withColumn("before", F.sum("n").over(running) - F.col("n"))
    # at most one slice per rank: 1,024 counts per bracket, and as many ranks as are asked for
    chosen = starts.join(F.broadcast(ranks), "j").filter("before <= place and place < before + n").select("j", "slice", "before", "rank", "place")
    in_slice = sliced.join(F.broadcast(chosen.select("j", "slice", "before").distinct()), ["j", "slice"])
    order = Window.partitionBy("j", "slice").orderBy("v")
    reached = in_slice.withColumn("upto", F.col("before") + F.sum("n").over(order))
    picked = reached.select("j", "v", "upto", (F.col("upto") - F.col("n")).alias("from"))
    hits = picked.join(F.broadcast(ranks), "j").filter("from <= place and place < upto").select("j", "rank", "v").collect()
    delete_path(spark, path)
    found = {(keys[r["j"]][0], r["rank"]): r["v"] for r in hits}
    missed = [(*key, r, r < under[j]) for j, key in enumerate(keys) for r in set(brackets[key]) if (key[0], r) not in found]
    return found, missed
