"""Nightly job: enriched mart, tiers, profile, series, snapshots, each a distributed write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from daymart.operators.asof import enrich_mart
from daymart.operators.frequent import frequent_values
from daymart.operators.profile import column_profile, correlation_matrix, infinities_to_null
from daymart.operators.snapshots import entity_series, latest_snapshot, yearly_snapshot
from daymart.operators.tiers import tier_roster, tier_series, tiers
from daymart.sources.sinks import by_year, write_csv
from daymart.sources.tables import mart_rows
from daymart.sources.versions import read_table, replace_table

GDP = "gdp_ppp_per_capita"


def run(
    spark: SparkSession,
    mart: DataFrame,
    yearly: DataFrame,
    alias: DataFrame,
    out: str,
    metrics: Sequence[str] = ("new_cases_per_100k",),
    entities: Sequence[str] = (),
) -> dict[str, int]:
    """Write every output under ``out``; returns row counts of the two tables.

    Tables are replaced by a commit, so whoever reads them meanwhile, or after a job that failed, reads the last whole ones.

    The enriched mart is written first and read back: all other outputs start from a stored table, so
    a lost executor costs a re-read and never a new join.
    """
    counts = {
        "yearly": replace_table(yearly, f"{out}/yearly"),
        "enriched": replace_table(by_year(enrich_mart(mart, yearly, alias)), f"{out}/enriched", "year"),
    }
    enriched = mart_rows(read_table(spark, f"{out}/enriched"))
    write_csv(enriched, f"{out}/enriched_csv", ["country", "d"])

    replace_table(tiers(enriched), f"{out}/tiers")
    tiered = read_table(spark, f"{out}/tiers")
    write_csv(tiered, f"{out}/tiers_csv", ["tier_ord", f"max_{GDP}"])
    write_csv(tier_roster(tiered), f"{out}/tier_roster", ["tier_ord", "country"])

    clean = infinities_to_null(enriched)
    write_csv(column_profile(clean), f"{out}/profile", ["column_name"])
    write_csv(correlation_matrix(clean), f"{out}/correlations")
    write_csv(frequent_values(clean), f"{out}/top_values", ["column_name", "position"])

    for metric in metrics:
        if entities:
            write_csv(entity_series(enriched, entities, metric), f"{out}/series_{metric}", ["country", "d"])
        write_csv(latest_snapshot(enriched, [GDP, metric]), f"{out}/latest_{metric}")
        write_csv(yearly_snapshot(enriched, [GDP, metric]), f"{out}/by_year_{metric}")
        write_csv(tier_series(enriched, tiered, metric), f"{out}/by_tier_{metric}", ["d", "tier_ord"])
    return counts
