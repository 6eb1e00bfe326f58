"""Readers and writers. Text sources are declared as strings and cast, so that one bad value is one NULL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import columns as c


def read_csv(spark: SparkSession, path: str, numbers: Iterable[str] = (), dates: Iterable[str] = ()) -> DataFrame:
    """CSV with a header; names are stripped and lowered, the named columns cast, absent ones added as NULL."""
    raw = spark.read.option("header", True).csv(path)
    df = raw.toDF(*(n.strip().lower() for n in raw.columns))
    casts = {n: c.to_number(n) if n in df.columns else F.lit(None).cast("double") for n in numbers}
    casts |= {n: c.to_date(n) if n in df.columns else F.lit(None).cast("date") for n in dates}
    return df.withColumns(casts) if casts else df


def read_factors(spark: SparkSession, path: str, names: tuple[str, ...] = ("mkt_rf", "smb", "hml", "rmw", "cma", "rf"), first: int = 190001) -> DataFrame:
    """Monthly factors from a CSV with preamble, annual and footer lines; percent become decimals.

    Only lines whose first field is a six-digit month from `first` on are data.
    """
    fields = ", ".join(f"{n} string" for n in ("code", *names))
    raw = spark.read.schema(fields).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    code = F.trim("code")
    kept = raw.filter(F.rlike(code, F.lit("^[0-9]{6}$")) & (code.try_cast("int") >= first))
    return kept.select(c.month_of(code.cast("int")).alias("month"), *((c.to_number(n) / 100).alias(n) for n in names))


def date_column(df: DataFrame, choices: tuple[str, ...] = ("date", "mthcaldt")) -> Column:
    """The first of the date columns that the table has; an error if it has none."""
    for name in choices:
        if name in df.columns:
            return c.to_date(name)
    raise ValueError(f"none of the date columns {choices} is there")


def resolve_columns(df: DataFrame, keep: Iterable[str], drop: Iterable[str] = ()) -> dict[str, str]:
    """Wanted name -> the table's own spelling, without regard to case; names to drop win."""
    own = {n.lower(): n for n in df.columns}
    gone = {n.lower() for n in drop}
    return {k: own[k.lower()] for k in keep if k.lower() in own and k.lower() not in gone}


def scan_wide(df: DataFrame, keep: Iterable[str], drop: Iterable[str] = ()) -> DataFrame:
    """The wanted columns of a wide table under their wanted names; the scan reads no others."""
    return df.select(*(F.col(f"`{own}`").alias(name) for name, own in resolve_columns(df, keep, drop).items()))


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renamed columns; where two would get one name the first stays."""
    seen, out = set(), []
    for n in df.columns:
        new = names.get(n, n)
        if new not in seen:
            seen.add(new)
            out.append(F.col(f"`{n}`").alias(new))
    return df.select(*out)


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """permno, month, mu of stored forecasts (permno, year, month, expected_ret)."""
    return spark.read.parquet(path).select("permno", F.make_date("year", "month", F.lit(1)).alias("month"), F.col("expected_ret").cast("double").alias("mu"))


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Parquet sink of panels and diagnostics; with a partition column (such as year) only the partitions in df are replaced.

    Spark stages the files of such a write and moves whole partitions when all tasks are done, so
    a run that is broken off leaves the old ones, and one that is repeated replaces just its own.
    """
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic") if partition else writer).parquet(path)


def write_forecasts(forecasts: DataFrame, path: str) -> None:
    """Stored forecasts (permno, month, expected_ret single) by year from permno, month, expected_ret; other years stay."""
    rows = forecasts.select(F.col("permno").cast("long").alias("permno"), F.year("month").alias("year"), F.month("month").alias("month"), F.col("expected_ret").cast("float").alias("expected_ret"))
    write_table(rows, path, "year")


def write_report(df: DataFrame, path: str) -> None:
    """CSV sink for tables of report size: one file, written by one task."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_recession(spark: SparkSession, path: str) -> DataFrame:
    """month and usrec (0 or 1) of a series of dates and flags."""
    df = read_csv(spark, path, numbers=("usrec",), dates=("observation_date",))
    return df.select(c.month_start("observation_date").alias("month"), F.col("usrec").cast("int").alias("usrec"))
