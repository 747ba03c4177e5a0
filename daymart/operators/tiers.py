"""Three tiers of entities by their largest yearly value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymart.functions.fixed_values import TIERS
from daymart.operators.quantiles import exact_quantiles
from daymart.session import stage


def entity_maximum(mart: DataFrame, value: str = "gdp_ppp_per_capita", entity: str = "country") -> DataFrame:
    """Largest known value per entity, null where it has none."""
    return mart.groupBy(entity).agg(F.max(value).alias(f"max_{value}"))


def tiers(mart: DataFrame, value: str = "gdp_ppp_per_capita", entity: str = "country") -> DataFrame:
    """(entity, max, tier, tier_ord): terciles of the entities' maxima.

    Where tercile edges coincide the range is cut into three equal widths instead; where all
    maxima are equal everyone is in the middle tier. Maxima are staged, so the mart is read once;
    of them only the four edges come to the driver.
    """
    top = f"max_{value}"
    maxima = stage(entity_maximum(mart, value, entity))
    edge = exact_quantiles(maxima, top, [1 / 3, 2 / 3]).first()
    if edge is None:
        unknown = {"gdp_tier": F.lit(None).cast("string"), "tier_ord": F.lit(None).cast("int")}
        return maxima.withColumns(unknown)
    low, high, cut1, cut2 = edge["min_value"], edge["max_value"], edge["q0"], edge["q1"]
    if not low < cut1 < cut2 < high:
        cut1, cut2 = low + (high - low) / 3, low + (high - low) * 2 / 3
    position = F.when(F.col(top) <= cut1, 0).when(F.col(top) <= cut2, 1).when(F.col(top).isNotNull(), 2)
    if low == high:
        position = F.when(F.col(top).isNotNull(), 1)
    names = F.array(*[F.lit(name) for name in TIERS])
    return maxima.withColumn("tier_ord", position.cast("int")).select(
        entity, top, F.get(names, F.col("tier_ord")).alias("gdp_tier"), "tier_ord"
    )


def tier_order(tiered: DataFrame, value: str = "gdp_ppp_per_capita") -> DataFrame:
    """Sorted by tier, then by maximum; for output only."""
    return tiered.orderBy("tier_ord", f"max_{value}", "country")


def tier_roster(tiered: DataFrame, entity: str = "country") -> DataFrame:
    """Members of each tier, one row each, beside the tier's size.

    A tier holds about a third of all entities, so its members are rows and not one array. Sizes
    are at most four rows. Sort by (tier_ord, entity) on output for the printed form.
    """
    placed = tiered.where(F.col("tier_ord").isNotNull())
    sizes = placed.groupBy("tier_ord").agg(F.count(F.lit(1)).alias("n_members"))
    return placed.join(F.broadcast(sizes), "tier_ord").select("tier_ord", "gdp_tier", "n_members", entity)


def tier_series(
    mart: DataFrame,
    tiered: DataFrame,
    value: str,
    entity: str = "country",
    day: str = "d",
    every_tier: bool = True,
) -> DataFrame:
    """Mean of ``value`` per day and tier over its known points.

    With ``every_tier`` each day shows all three tiers, those without points as null.
    Means are formed map-side first, so a large tier costs no more than a small one.
    """
    points = mart.where(F.col(value).isNotNull()).select(entity, day, value)
    joined = points.join(tiered.select(entity, "gdp_tier", "tier_ord"), entity).where(
        F.col("tier_ord").isNotNull()
    )
    means = joined.groupBy(day, "tier_ord", "gdp_tier").agg(F.avg(value).alias(value))
    if not every_tier:
        return means
    # Three rows per day: spread the day's means over the fixed tier list.
    per_day = means.groupBy(day).agg(
        *[F.max(F.when(F.col("tier_ord") == i, F.col(value))).alias(f"_t{i}") for i in range(len(TIERS))]
    )
    slots = F.array(
        *[
            F.struct(F.lit(i).alias("tier_ord"), F.lit(name).alias("gdp_tier"), F.col(f"_t{i}").alias(value))
            for i, name in enumerate(TIERS)
        ]
    )
    return per_day.select(day, F.inline(slots))
