"""Exact order statistics of groups of any size: no buffer holds a group's values.

Values are counted first. A group of at most ``most`` values has its quantiles from Spark's own exact ``percentile``. In a larger group, the
value at a rank is enclosed: one pass counts what is below, at and between two bounds, and takes a grid of approximate
quantiles, of bounded memory, of what is between; the two grid points around the rank are the next bounds. Values between them get fewer by the
number of grid points each time; at most ``most`` of them are sorted in the end. A bound that turns out to
be beyond the rank is given up, so the result doesn't rest on the approximation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.ranking import same
from tickerloom.sources.shared import written

#: Values that may meet in one buffer; grid points of a pass, and the accuracy of their ranks.
MOST, GRID, ACCURACY = 10_000, 64, 1_000


def quantiles(df: DataFrame, columns: list[str], fractions: list[float], keys: tuple[str, ...], most: int = MOST, grid: int = GRID, accuracy: int = ACCURACY) -> DataFrame:
    """keys, and for each column ``<column>__n`` (its values) and ``<column>__q<k>`` for each fraction: interpolated between the two values
    around it, null if there is none. Nulls are no values."""
    rows = written(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]), "quantile-rows")
    counts = written(rows.groupBy(*keys).agg(*[F.count(c).alias(f"{c}__n") for c in columns]), "quantile-counts")
    large = [c for c, n in counts.agg(*[F.max(f"{c}__n").alias(c) for c in columns]).first().asDict().items() if (n or 0) > most]
    few = lambda c: F.col(f"{c}__n") <= most
    small = same(rows, counts, keys) if large else rows
    kept = {c: F.when(few(c), F.col(c)) if c in large else F.col(c) for c in columns}
    own = small.groupBy(*keys).agg(*[F.percentile(kept[c], F.array(*map(F.lit, fractions))).alias(f"{c}__all") for c in columns])
    out = same(counts, own, keys)
    for c in large:
        found = _enclosed(rows.select(*keys, F.col(c).alias("__v")).where(F.col(c).isNotNull()), counts.where(~few(c)).select(*keys, F.col(f"{c}__n").alias("__n")), fractions, keys, most, grid, accuracy)
        out = same(out, found, keys, "left").withColumn(f"{c}__all", F.coalesce("__found", f"{c}__all")).drop("__found")
    return out.select(*keys, *[x for c in columns for x in (F.col(f"{c}__n"), *[F.col(f"{c}__all")[k].alias(f"{c}__q{k}") for k in range(len(fractions))])])


def _enclosed(rows: DataFrame, groups: DataFrame, fractions: list[float], keys: tuple[str, ...], most: int, grid: int, accuracy: int) -> DataFrame:
    """keys, __found: the fractions' values of ``groups`` (keys, __n), whose ``rows`` are keys and __v."""
    pos = [(F.col("__n") - 1) * F.lit(float(f)) for f in fractions]
    ranks = F.array(*[F.struct(F.lit(2 * k + up).alias("t"), (F.ceil(p) if up else F.floor(p)).cast("long").alias("r")) for k, p in enumerate(pos) for up in (0, 1)])
    none = F.lit(None).cast("double")
    wanted = groups.select(*keys, F.explode(ranks).alias("x")).select(*keys, F.col("x.t").alias("__t"), F.col("x.r").alias("__r"), none.alias("__low"), none.alias("__high"))
    wanted, solved, v = written(wanted, "quantile-wanted"), [], F.col("__v")
    own = (*keys, "__t", "__r", "__low", "__high")
    points = [k / grid for k in range(1, grid)]
    while True:
        met = same(rows, wanted, keys)
        between = (F.col("__low").isNull() | (v > F.col("__low"))) & (F.col("__high").isNull() | (v < F.col("__high")))
        inner = F.when(between, v)
        found = met.groupBy(*own).agg(
            F.count_if(v < F.col("__low")).alias("__below"), F.count_if(v == F.col("__low")).alias("__at_low"), F.count(inner).alias("__m"), F.count_if(v == F.col("__high")).alias("__at_high"),
            F.percentile_approx(inner, F.array(*map(F.lit, points)), accuracy).alias("__grid"),
        )
        rest = F.col("__r") - F.col("__below")  # the rank from the lower bound on
        inside = rest - F.col("__at_low")  # and behind it
        found = found.withColumns({"__rest": rest, "__inside": inside})
        case = F.when(rest < 0, "low").when(inside < 0, "at_low").when(inside < F.col("__m"), "between").when(inside < F.col("__m") + F.col("__at_high"), "at_high").otherwise("high")
        found = written(found.withColumn("__case", case), "quantile-found")
        solved.append(found.where("__case in ('at_low', 'at_high')").select(*keys, "__t", F.when(F.col("__case") == "at_low", F.col("__low")).otherwise(F.col("__high")).alias("__value")))
        # a grid point stands for a rank up to a share of 1 / accuracy beside its own
        slack = F.col("__m") / accuracy + 1
        low_at = F.floor((F.col("__inside") - slack) * grid / F.col("__m")).cast("int")
        high_at = F.ceil((F.col("__inside") + slack) * grid / F.col("__m")).cast("int")
        low = F.when(low_at >= 1, F.get("__grid", low_at - 1)).otherwise(F.col("__low"))
        high = F.when(high_at <= grid - 1, F.get("__grid", high_at - 1)).otherwise(F.col("__high"))
        ready = written(found.where((F.col("__case") == "between") & (F.col("__m") <= most)).select(*own, "__inside"), "quantile-ready")
        inner_rows = same(rows, ready, keys).where(between)
        last = inner_rows.groupBy(*own, "__inside").agg(F.sort_array(F.collect_list("__v")).alias("__all"))  # at most ``most`` values
        solved.append(last.select(*keys, "__t", F.get("__all", F.col("__inside").cast("int")).alias("__value")))
        open_ = found.where(~F.col("__case").isin("at_low", "at_high") & ~((F.col("__case") == "between") & (F.col("__m") <= most)))
        lows = F.when(F.col("__case") == "low", none).when(F.col("__case") == "high", F.col("__high")).otherwise(low)
        highs = F.when(F.col("__case") == "high", none).when(F.col("__case") == "low", F.col("__low")).otherwise(high)
        wanted = written(open_.select(*keys, "__t", "__r", lows.alias("__low"), highs.alias("__high")), "quantile-wanted")
        if wanted.isEmpty():
            break
    values = solved[0]
    for more in solved[1:]:
        values = values.unionByName(more)
    by_group = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__t", "__value"))).alias("__values"))
    parts = [F.col("__values")[2 * k] + (F.col("__values")[2 * k + 1] - F.col("__values")[2 * k]) * (p - F.floor(p)) for k, p in enumerate(pos)]
    return same(groups, by_group, keys).select(*keys, F.array(*parts).alias("__found"))
