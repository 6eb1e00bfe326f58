"""Queries of sources and sinks: stand-in tables are written in the outer formats and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import windows as w
from tessera.plans.catalog import Tables, query
from tessera.plans.reports import adjusted
from tessera.plans.standins import folder
from tessera.sources import readers


@query("s1_s3_csv_source", """
SELECT permno, month, CASE WHEN permno % 4 = 0 THEN NULL ELSE prc END AS prc, vol, ret, CAST(NULL AS DOUBLE) AS spread FROM stock""", "prc vol ret")
def _(t):
    """A text file with padded upper-case names, a letter where a number should be and a column that is missing."""
    path = folder(t.spark)
    bad = F.when(F.col("permno") % 4 == 0, F.lit("C")).otherwise(F.col("prc").cast("string"))
    t.stock.select(F.col("permno").alias(" PERMNO "), F.col("month").alias("MthCalDt"), bad.alias("PRC"), F.col("vol").alias("Vol"), F.col("ret").alias("RET ")).write.option("header", True).csv(path)
    df = readers.read_csv(t.spark, path, numbers=("prc", "vol", "ret", "spread"), dates=("mthcaldt",))
    return df.select(F.col("permno").cast("long").alias("permno"), readers.date_column(df).alias("month"), "prc", "vol", "ret", "spread")


@query("s2_factor_source", "SELECT month, mkt_rf, smb, hml, rmw, cma, rf FROM factors WHERE mkt_rf IS NOT NULL", "mkt_rf smb hml rmw cma rf")
def _(t):
    """A file in percent with a preamble, annual figures and a footer around the months."""
    path = folder(t.spark)
    names = ("mkt_rf", "smb", "hml", "rmw", "cma", "rf")
    months = t.factors.filter("mkt_rf IS NOT NULL").select(F.concat_ws(", ", F.date_format("month", "yyyyMM"), *((F.col(n) * 100).cast("string") for n in names)).alias("value"))
    years = t.factors.filter("mkt_rf IS NOT NULL").select(F.concat_ws(", ", F.date_format("month", "yyyy"), *(F.lit("1.0") for _ in names)).alias("value")).distinct()
    around = t.spark.createDataFrame([("This file has monthly returns",), (",Mkt-RF,SMB,HML,RMW,CMA,RF",), (" Annual Factors: January-December ",), ("Copyright",)], "value string")
    around.unionByName(months).unionByName(years).write.text(path)
    return readers.read_factors(t.spark, path, names)


def trailing_means(t: Tables) -> DataFrame:
    at = adjusted(t).select("permno", "month", w.rolling(F.avg, "ret_adjusted", 36, 24, calendar=True).alias("expected_ret"))
    return at.filter("expected_ret IS NOT NULL")


@query("s7_stored_forecasts", """
WITH x AS (SELECT permno, month, avg((1 + ret) * (1 + coalesce(dlret, 0)) - 1) OVER o AS mu, count(ret) OVER o AS n FROM stock
    WINDOW o AS (PARTITION BY permno ORDER BY year(month) * 12 + month(month) RANGE BETWEEN 35 PRECEDING AND CURRENT ROW))
SELECT permno, month, CAST(CAST(mu AS FLOAT) AS DOUBLE) AS mu FROM x WHERE n >= 24""", "mu")
def _(t):
    """All years are stored, one of them wrong; that year is written again and replaces only itself."""
    path = folder(t.spark)
    means = trailing_means(t)
    wrong = F.when(F.year("month") == 2000, F.col("expected_ret") + 1).otherwise(F.col("expected_ret"))
    readers.write_forecasts(means.withColumn("expected_ret", wrong), path)
    readers.write_forecasts(means.filter(F.year("month") == 2000), path)
    return readers.read_forecasts(t.spark, path)


@query("s8_report_sink", "SELECT year(month) AS year, CAST(count(*) AS DOUBLE) AS n, sum(vol) AS vol FROM stock GROUP BY 1", "vol")
def _(t):
    path = folder(t.spark)
    readers.write_report(t.stock.groupBy(F.year("month").alias("year")).agg(F.count("*").alias("n"), F.sum("vol").alias("vol")), path)
    return readers.read_csv(t.spark, path, numbers=("n", "vol")).select(F.col("year").cast("int").alias("year"), "n", "vol")


@query("s9_recession_source", "SELECT month, usrec FROM recession")
def _(t):
    path = folder(t.spark)
    t.recession.select(F.col("month").alias("observation_date"), F.col("usrec").alias("USREC")).write.option("header", True).csv(path)
    return readers.read_recession(t.spark, path)


@query("l1_sorted_panel", "SELECT permno, month, row_number() OVER (ORDER BY permno, month) AS place FROM stock")
def _(t):
    """The panel in order: ranges of entities, each sorted, numbered on from the number of rows in the ranges before."""
    path = folder(t.spark)
    n = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    readers.write_table(t.stock.select("permno", "month").repartitionByRange(n, "permno", "month").sortWithinPartitions("permno", "month").withColumn("_at", F.monotonically_increasing_id()), path)
    at = t.spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    before = at.groupBy("_part").agg(F.count("*").alias("_n"))
    # a row a range
    starts = before.select("_part", (F.sum("_n").over(w.Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return at.join(F.broadcast(starts), "_part").select("permno", "month", (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"))


@query("w17_lead_target", """
WITH e AS (SELECT s.permno, s.month, (1 + ret) * (1 + coalesce(dlret, 0)) - 1 - f.rf AS x FROM stock s JOIN factors f ON s.month = f.month),
l AS (SELECT permno, month, lead(x) OVER (PARTITION BY permno ORDER BY month) AS y FROM e) SELECT * FROM l WHERE y IS NOT NULL""", "y")
def _(t):
    from tessera.operators import joins as j
    from tessera.operators import learn as m

    return m.with_target(j.with_series(adjusted(t), t.factors.select("month", "rf")), target_lead=1).select("permno", "month", "y")
