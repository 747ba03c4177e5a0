"""Mart, yearly table, aliases and comments derived from the star-schema tables, over all of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Given layouts save a job per table that would read file footers for them.
LAYOUTS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(LAYOUTS[name]).parquet(f"{folder}/{name}.parquet")


def nation_day(spark: SparkSession, folder: str) -> DataFrame:
    """Mart: orders per customer nation and day. Days without a filled order have a null ``new_deaths``."""
    orders = table(spark, folder, "orders").select(
        "o_custkey", F.to_date("o_orderdate").alias("d"), "o_totalprice", "o_orderstatus"
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    # Grouped by the nation's number first: names are added to the few grouped rows.
    grouped = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "d")
        .agg(
            F.count(F.lit(1)).cast("double").alias("new_cases"),
            F.nullif(F.count(F.when(F.col("o_orderstatus") == "F", 1)), F.lit(0)).cast("double").alias("new_deaths"),
            F.round(F.sum("o_totalprice"), 2).alias("daily_vaccinations"),
            F.round(F.sum("o_totalprice") / 100000, 7).alias("new_cases_per_100k"),
        )
    )
    return grouped.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("country"), "d", "new_cases", "new_deaths", "daily_vaccinations", "new_cases_per_100k"
    )


def _event_mart(spark: SparkSession, folder: str, entity: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        F.col(entity).cast("string").alias("country"), F.to_date("ts").alias("d"), "event_type", "value"
    )
    return events.groupBy("country", "d").agg(
        F.count(F.lit(1)).cast("double").alias("new_cases"),
        F.nullif(F.count(F.when(F.col("event_type") == "error", 1)), F.lit(0)).cast("double").alias("new_deaths"),
        F.round(F.sum("value"), 2).alias("daily_vaccinations"),
    )


def user_day(spark: SparkSession, folder: str) -> DataFrame:
    """Mart of sparse series: events per user and day; ``new_deaths`` is null on days without an error."""
    return _event_mart(spark, folder, "user_id")


def event_day(spark: SparkSession, folder: str) -> DataFrame:
    """Mart of dense series: events per type and day."""
    return _event_mart(spark, folder, "event_type")


def nation_year(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly table: supplied value per nation and ship year, plus one row per region and year.

    Nations without a supplier are absent; regions occur in no mart.
    """
    lines = table(spark, folder, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), "l_extendedprice")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    per_nation = (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", "year")
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
    )
    nations = table(spark, folder, "nation")
    published = (
        per_nation.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("country"), "year", F.col("total").alias("gdp_ppp_per_capita"))
    )
    regions = (
        per_nation.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("country"), "year")
        .agg(F.round(F.sum("total"), 2).alias("gdp_ppp_per_capita"))
    )
    return published.unionByName(regions)


def alias(spark: SparkSession, folder: str) -> DataFrame:
    """Alias table: the last nation of each region counts as the first one, in two spellings.

    Rows without alias or without canonical name are there to be ignored.
    """
    folded = (
        table(spark, folder, "nation")
        .groupBy("n_regionkey")
        .agg(F.max_by("n_name", "n_nationkey").alias("name"), F.min_by("n_name", "n_nationkey").alias("canonical"))
    )
    both = folded.select(F.explode(F.array(F.lower("name"), F.upper("name"))).alias("alias"), "canonical")
    empty = table(spark, folder, "region").select(
        F.inline(
            F.array(
                F.struct(F.lit(None).cast("string").alias("alias"), F.col("r_name").alias("canonical")),
                F.struct(F.lower("r_name").alias("alias"), F.lit(None).cast("string").alias("canonical")),
            )
        )
    )
    return both.unionByName(empty)


def yearly_text(spark: SparkSession, folder: str) -> DataFrame:
    """The yearly table as a raw file would hold it: all text, a serial column, and unreadable cells."""
    text = nation_year(spark, folder).select(
        F.col("country").alias("Country"),
        F.col("year").cast("string").alias("Year"),
        F.col("gdp_ppp_per_capita").cast("decimal(20,2)").cast("string").alias("GDP_PPP_Per_Capita"),
    )
    unreadable = table(spark, folder, "region").select(
        F.col("r_name").alias("Country"),
        F.explode(F.array(F.lit("n/a"), F.lit(""), F.lit(None).cast("string"), F.lit("1999"))).alias("Year"),
        F.lit("n/a").alias("GDP_PPP_Per_Capita"),
    )
    return text.unionByName(unreadable).select(F.lit("7").alias("Sr.No"), "*")


def yearly_wide(spark: SparkSession, folder: str) -> DataFrame:
    """The yearly table with a column for each of its years."""
    return (
        nation_year(spark, folder)
        .groupBy("country")
        .pivot("year")
        .agg(F.max("gdp_ppp_per_capita"))
    )


def topic_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Comment log with few busy keys: every event is a comment on its type and day."""
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("comment_id"),
        F.col("event_type").alias("country"),
        F.to_date("ts").alias("date"),
        F.lit("NEW_CASES").alias("metric"),
        F.col("user_id").cast("string").alias("user"),
        F.col("props").alias("text"),
        "ts",
    )


def user_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Comment log with many small keys: every event is a comment on its user's day, errors on another metric."""
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("comment_id"),
        F.col("user_id").cast("string").alias("country"),
        F.to_date("ts").alias("date"),
        F.when(F.col("event_type") == "error", "NEW_DEATHS").otherwise("NEW_CASES").alias("metric"),
        F.col("event_type").alias("user"),
        F.col("props").alias("text"),
        "ts",
    )


def comment_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Submitted comments: every order names its customer's nation in two spellings."""
    return (
        table(spark, folder, "orders")
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.array("n_name", F.concat(F.lit(" "), F.lower("n_name"), F.lit(" "))).alias("countries"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
            F.lit("NEW_CASES").alias("metric"),
            F.concat(F.lit(" "), F.col("c_name")).alias("user"),
            # A low priority is written as a blank text and has to be refused.
            F.when(F.col("o_orderpriority") == "5-LOW", "  ").otherwise(F.col("o_orderpriority")).alias("comment"),
        )
    )
