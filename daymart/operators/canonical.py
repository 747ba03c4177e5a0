"""Entity names: aliases, distinct lists, eligibility and coverage.

Joins to name tables carry no broadcast hint. Spark broadcasts such a table when its
measured size allows it and otherwise shuffles both sides, splitting skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymart.functions.fixed_values import GDP_METRICS, METRIC_CHOICES
from daymart.functions.scalars import filled, match_key


def clean_alias(alias: DataFrame) -> DataFrame:
    """One row per upper-cased alias; of several canonical names the smallest wins.

    A table already in that form is returned as it is, so it can be prepared once and used often.
    """
    if alias.columns == ["alias_key", "canonical"]:
        return alias
    return (
        alias.where(F.col("alias").isNotNull() & F.col("canonical").isNotNull())
        .groupBy(match_key(F.col("alias")).alias("alias_key"))
        .agg(F.min("canonical").alias("canonical"))
    )


def canonicalize(
    df: DataFrame, alias: DataFrame, entity: str = "country", out: str | None = None, trimmed: bool = False
) -> DataFrame:
    """Replace entity names by their canonical form; unknown names stay as they are.

    ``trimmed`` is the lookup for typed-in names: blanks around the name are ignored and removed.
    Aliases are made unique first, so no row is ever multiplied.
    """
    lookup = clean_alias(alias)
    own = F.trim(F.col(entity)) if trimmed else F.col(entity)
    joined = df.join(lookup, match_key(F.col(entity), trimmed) == F.col("alias_key"), "left")
    return joined.withColumn(out or entity, F.coalesce("canonical", own)).drop("alias_key", "canonical")


def distinct_entities(df: DataFrame, alias: DataFrame | None = None, entity: str = "country") -> DataFrame:
    """Distinct non-empty names, canonical when an alias table is given.

    Names are made distinct before the alias join, so only the short list is joined.
    """
    names = df.select(entity).where(F.col(entity).isNotNull()).distinct()
    if alias is not None:
        names = canonicalize(names, alias, entity).distinct()
    return names.where(filled(F.col(entity)).isNotNull())


def trimmed_entities(df: DataFrame, entity: str = "country") -> DataFrame:
    """Distinct raw names with surrounding blanks removed."""
    return df.select(F.trim(entity).alias(entity)).where(filled(F.col(entity)).isNotNull()).distinct()


def gdp_eligibility(
    entities: DataFrame, yearly: DataFrame, alias: DataFrame, entity: str = "country"
) -> DataFrame:
    """Add ``gdp_allowed``: whether the canonical name occurs in the yearly table."""
    known = distinct_entities(yearly, alias).select(
        F.col("country").alias("known"), F.lit(True).alias("found")
    )
    named = canonicalize(entities, alias, entity, out="canonical_name", trimmed=True)
    return (
        named.join(known, F.col("canonical_name") == F.col("known"), "left")
        .withColumn("gdp_allowed", F.coalesce("found", F.lit(False)))
        .drop("known", "found", "canonical_name")
    )


def metric_catalogue() -> Column:
    """The metric list as one array column, ready to explode beside each entity."""
    return F.array(
        *[
            F.struct(
                F.lit(position).alias("position"),
                F.lit(label).alias("label"),
                F.lit(metric).alias("metric"),
                F.lit(metric in GDP_METRICS).alias("is_gdp"),
                F.lit(metric not in GDP_METRICS).alias("forecastable"),
            )
            for position, (label, metric) in enumerate(METRIC_CHOICES, start=1)
        ]
    )


def metric_choices(eligible: DataFrame, entity: str = "country") -> DataFrame:
    """The metrics each entity may use, in display order, from its ``gdp_allowed`` flag."""
    listed = eligible.select(entity, "gdp_allowed", F.inline(metric_catalogue()))
    return listed.where(F.col("gdp_allowed") | ~F.col("is_gdp"))


def coverage_gaps(left: DataFrame, right: DataFrame, entity: str = "country") -> DataFrame:
    """Names found on one side only: (country, missing_in), from one full outer join."""
    a = trimmed_entities(left, entity).withColumn("in_left", F.lit(True))
    b = trimmed_entities(right, entity).withColumn("in_right", F.lit(True))
    return (
        a.join(b, entity, "full_outer")
        .where(F.col("in_left").isNull() | F.col("in_right").isNull())
        .select(entity, F.when(F.col("in_left").isNull(), "left").otherwise("right").alias("missing_in"))
    )


def gap_counts(gaps: DataFrame) -> DataFrame:
    """How many names each side lacks."""
    return gaps.groupBy("missing_in").agg(F.count(F.lit(1)).alias("n_missing"))
