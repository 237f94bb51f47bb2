"""Choosing targets: capped top-N with ranked backups, equal weights, signals.

The capped selection walks rows by value, skips one whose theme is full, and stops at N rows
or at the gross cap. As every pick has the same weight, that is two limits: within the theme, then among those within
capacity. Days are keys, so one plan serves all; neither a day nor a table without days has its rows in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.functions import scalars as X
from tickerloom.operators.ranking import down, first_of, number_rows, same, tie_breaker


@dataclass(frozen=True)
class Caps:
    topn: int = 10
    w_max: float = 0.12
    theme_cap: float = 0.35
    gross_cap: float = 1.0

    @property
    def weight(self) -> float:
        return min(min(self.gross_cap, 1.0) / self.topn, self.w_max)

    def __post_init__(self) -> None:
        if self.topn <= 0:  # no sensible number: the default
            object.__setattr__(self, "topn", Caps.topn)

    def theme_room(self) -> int:
        """Picks that fit a theme, by adding as a running sum does (division rounds otherwise)."""
        return _additions(self.weight, self.theme_cap, self.topn)

    def gross_room(self) -> int:
        return min(self.topn, _additions(self.weight, self.gross_cap + 1e-9, self.topn))


def _additions(step: float, most: float, limit: int) -> int:
    n, used = 0, 0.0
    while n < limit and used + step <= most:
        used += step
        n += 1
    return n


#: Where a theme's name is looked for, in this order.
THEME_COLUMNS = ("theme", "Theme", "board", "industry", "sector")


def pick_theme(df: DataFrame, into: str = "theme") -> DataFrame:
    texts = {n for n, t in df.dtypes if t == "string"}
    found = [c for c in THEME_COLUMNS if c in texts]
    return df.withColumn(into, X.first_text(found) if found else F.lit(None).cast("string"))


def _blank(theme: str) -> Column:
    return F.col(theme).isNull() | (F.trim(F.col(theme)) == "")


def _chosen(df: DataFrame, order: list[Column], caps: Caps, theme: str, keys: tuple[str, ...]) -> DataFrame:
    """The targets: the first rows of each theme that fit it, and of these and the themeless ones the first that fit at all.

    Each task first cuts a theme (or what has none) to so many rows as can be targets, so a theme may be of any size.
    """
    room = caps.gross_room()
    themed = df.withColumn("__theme", F.when(~_blank(theme), F.col(theme)))
    within = F.row_number().over(W.partitionBy(*keys, "__theme").orderBy(*order))
    fit = themed.withColumn("__in_theme", within).where((F.col("__in_theme") <= room) & (F.col("__theme").isNull() | (F.col("__in_theme") <= caps.theme_room())))
    fit = fit.drop("__theme", "__in_theme")
    return first_of(fit, order, room, keys) if keys else fit.orderBy(*order).limit(room)


def _order(df: DataFrame, value: str, tie: str) -> list[Column]:
    return [down(df, value), F.col(tie).asc_nulls_last()]


def targets(df: DataFrame, caps: Caps = Caps(), value: str = "ev_pred", tie: str = "ts_code", theme: str = "theme") -> DataFrame:
    """The targets alone, with weight and target_rank: no row is numbered but those that are chosen."""
    order = [*_order(df, value, tie), tie_breaker(df)]
    few = _chosen(df, order, caps, theme, ())
    return few.withColumns({"target_rank": F.row_number().over(W.orderBy(*order)), "weight": X.double(caps.weight)})  # topn rows at most


def capped_top_n(df: DataFrame, caps: Caps = Caps(), value: str = "ev_pred", tie: str = "ts_code", theme: str = "theme", keys: tuple[str, ...] = ()) -> DataFrame:
    """All rows with weight, target_rank and backup_rank; nulls of ``value`` come last. With ``keys``, each key's rows are a selection
    of their own. With no room at all every row is a backup of weight 0.

    All rows are numbered once, by ranges; a key's targets are an array of at most ``topn`` numbers, and a backup's rank is its number less
    the targets before it.
    """
    placed = number_rows(df, _order(df, value, tie), "__place", keys)
    chosen = _chosen(placed, [F.col("__place")], caps, theme, keys).select(*keys, "__place")
    if keys:
        out = same(placed, chosen.groupBy(*keys).agg(F.collect_list("__place").alias("__targets")), keys, "left")
        out = out.withColumn("__targets", F.coalesce("__targets", F.array().cast("array<long>")))
    else:
        out = placed.withColumn("__targets", F.array(*[F.lit(r[0]) for r in chosen.collect()]).cast("array<long>"))
    out = out.withColumn("__before", F.size(F.filter("__targets", lambda t: t < F.col("__place"))))
    hit = F.array_contains("__targets", F.col("__place"))
    return out.withColumns(
        {
            "weight": F.when(hit, X.double(caps.weight)).otherwise(X.double(0)),
            "target_rank": F.when(hit, F.col("__before") + 1),
            "backup_rank": F.when(~hit, (F.col("__place") - F.col("__before")).cast("int")),
        }
    ).drop("__targets", "__before", "__place")


def equal_weight(df: DataFrame, budget: float = 1.0, keys: tuple[str, ...] = (), into: str = "target_weight") -> DataFrame:
    """Budget over the number of rows of each day."""
    return df.withColumn(into, X.double(budget) / F.count("*").over(W.partitionBy(*keys)))


def signals(weights: DataFrame, trade_date: Column, target_trade_date: Column, regime: str = "RISK_ON", budget: float = 1.0, reason: str = "P0_EV_weight") -> DataFrame:
    """The rows with weight, in the form that goes out."""
    return weights.where(F.col("weight") > 0).select(
        trade_date.alias("trade_date"), target_trade_date.alias("target_trade_date"), X.exchange_code(F.col("ts_code")).alias("jq_code"), F.col("weight").alias("target_weight"), X.double(budget).alias("risk_budget"), F.lit(regime).alias("regime"), F.lit(reason).alias("reason")
    )


def equal_weight_signals(df: DataFrame, order: str, topn: int = 10, budget: float = 1.0) -> DataFrame:
    """The first rows, equally weighted."""
    first = df.orderBy(F.col(order).asc_nulls_last()).limit(topn)
    return equal_weight(first, budget, into="weight")


def rank_desc(df: DataFrame, value: str, tie: str, keys: tuple[str, ...], into: str) -> DataFrame:
    """Each row's place within its keys; a key may have any number of rows."""
    return number_rows(df, _order(df, value, tie), into, keys)
