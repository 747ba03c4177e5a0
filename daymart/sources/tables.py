"""Reading the mart, the yearly table and the alias table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daymart.functions.fixed_values import SERIAL_COLUMNS
from daymart.functions.scalars import lenient_double, lenient_int


def read_mart(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    entities: Sequence[str] | None = None,
) -> DataFrame:
    """The entity-day mart. Only the named columns are read, and every filter reaches the scan.

    On a mart written by :func:`daymart.sources.sinks.write_mart` the range also prunes year folders.
    """
    return mart_rows(spark.read.parquet(path), columns, start, end, entities)


def mart_rows(
    mart: DataFrame,
    columns: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    entities: Sequence[str] | None = None,
) -> DataFrame:
    """``read_mart`` of a table that was opened in another way."""
    partitioned = "year" in mart.columns
    if partitioned and start:
        mart = mart.where(F.col("year") >= int(start[:4]))
    if partitioned and end:
        mart = mart.where(F.col("year") <= int(end[:4]))
    if entities is not None:
        mart = mart.where(F.col("country").isin(list(entities)))
    mart = mart.select("country", "d", *columns) if columns is not None else mart.drop("year")
    # Compare before any cast so that the condition can be pushed down when d is stored as a date.
    if dict(mart.dtypes)["d"] != "date":
        mart = mart.withColumn("d", F.to_date("d"))
    if start:
        mart = mart.where(F.col("d") >= F.lit(start).cast("date"))
    if end:
        mart = mart.where(F.col("d") <= F.lit(end).cast("date"))
    return mart


def read_alias(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("alias", "canonical")


def read_csv_trimmed(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns text, blanks around headings removed. A missing file is an error."""
    raw = spark.read.option("header", True).csv(path)
    return raw.toDF(*[c.strip() for c in raw.columns])


def csv_rows(lines: DataFrame, header: str, column: str = "value") -> DataFrame:
    """Rows of CSV lines that are already in a column, all text, blanks around headings removed."""
    names = [name.strip() for name in header.split(",")]
    parsed = F.from_csv(column, ", ".join(f"`{name}` STRING" for name in names))
    return lines.select(parsed.alias("row")).select("row.*")


def drop_serial(df: DataFrame) -> DataFrame:
    """Without the first serial-number column that is present, under any of its spellings."""
    for name in SERIAL_COLUMNS:
        if name in df.columns:
            # A dot in a heading would otherwise be read as a field access.
            return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name])
    return df


def clean_yearly(raw: DataFrame) -> DataFrame:
    """(country, year, gdp_ppp_per_capita) from text columns; rows without year or value are dropped."""
    plain = drop_serial(raw).withColumnsRenamed(
        {"Country": "country", "Year": "year", "GDP_PPP_Per_Capita": "gdp_ppp_per_capita"}
    )
    return plain.select(
        "country",
        lenient_int(F.col("year")).alias("year"),
        lenient_double(F.col("gdp_ppp_per_capita")).alias("gdp_ppp_per_capita"),
    ).na.drop(subset=["year", "gdp_ppp_per_capita"])


def read_yearly_csv(spark: SparkSession, path: str) -> DataFrame:
    """The yearly table from a file with a row per country and year."""
    return clean_yearly(read_csv_trimmed(spark, path))


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """The yearly table from a file with a column per year, as it stands: (country, <year>, ...)."""
    return wide_numbers(read_csv_trimmed(spark, path))


def wide_numbers(raw: DataFrame) -> DataFrame:
    """(country, <year>, ...) from text columns."""
    wide = drop_serial(raw).withColumnRenamed("Country", "country")
    years = [c for c in wide.columns if c != "country"]
    return wide.select("country", *[lenient_double(F.col(f"`{c}`")).alias(c) for c in years])
