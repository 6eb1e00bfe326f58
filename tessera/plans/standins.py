"""Panel tables derived from the driver's star schema, as SQL that Spark and DuckDB both run.

Definitions follow FIXTURES.md: suppliers are entities, ship months the calendar.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

BASE = ("lineitem", "supplier", "nation")

VIEWS = {
    "stock": """
SELECT m.permno, m.month, m.prc, m.vol, m.market_cap, m.market_cap / m.prc AS shrout,
       m.prc / lag(m.prc) OVER (PARTITION BY m.permno ORDER BY m.month) - 1 AS ret,
       CASE WHEN m.permno % 7 = 0 AND month(m.month) = 12 THEN CAST(-0.05 AS DOUBLE) END AS dlret,
       n.n_regionkey AS exchcd, s.s_nationkey AS siccd
FROM (SELECT l_suppkey AS permno, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS prc,
             CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS vol,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS market_cap
      FROM lineitem GROUP BY 1, 2) m
JOIN supplier s ON s.s_suppkey = m.permno JOIN nation n ON n.n_nationkey = s.s_nationkey""",
    "accounting": """
SELECT CAST(y.permno AS STRING) AS gvkey, make_date(y.fyear, 12, 31) AS datadate, y.fyear,
       CASE WHEN y.permno % 9 = 0 THEN 'CAD' WHEN y.permno % 11 = 0 THEN NULL ELSE 'USD' END AS curcd,
       y.sale, y.cogs, 2 * y.sale AS at_total, y.sale - y.cogs - y.tax AS ni, y.sale + s.s_acctbal AS ceq,
       CASE WHEN y.permno % 3 = 0 THEN NULL ELSE 0.02 * y.sale END AS txditc, 0.01 * y.sale AS pstk,
       0.2 * y.sale AS che, 0.9 * y.sale AS lt, 0.4 * y.cogs AS dltt, 0.1 * y.cogs AS capx
FROM (SELECT l_suppkey AS permno, CAST(year(l_shipdate) AS INT) AS fyear,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS sale,
             0.6 * CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS cogs,
             CAST(sum(CAST(l_extendedprice * l_tax AS DECIMAL(18, 4))) AS DOUBLE) AS tax
      FROM lineitem GROUP BY 1, 2) y JOIN supplier s ON s.s_suppkey = y.permno""",
    "links": """
SELECT CAST(s_suppkey AS STRING) AS gvkey, s_suppkey AS lpermno, DATE '1990-01-01' AS linkdt,
       CASE WHEN s_suppkey % 5 = 0 THEN DATE '1998-06-30' END AS linkenddt, CASE WHEN s_suppkey % 13 = 0 THEN 'N' ELSE 'P' END AS linkprim
FROM supplier
UNION ALL
SELECT CAST(s_suppkey AS STRING), s_suppkey, DATE '1998-07-01', NULL, 'C' FROM supplier WHERE s_suppkey % 5 = 0""",
    "factors": """
SELECT month, 0.05 * (f1 / lag(f1) OVER (ORDER BY month) - 1) AS mkt_rf, 0.05 * (f2 / lag(f2) OVER (ORDER BY month) - 1) AS smb,
       0.05 * (f3 / lag(f3) OVER (ORDER BY month) - 1) AS hml, 0.05 * (f4 / lag(f4) OVER (ORDER BY month) - 1) AS rmw,
       0.05 * (f5 / lag(f5) OVER (ORDER BY month) - 1) AS cma, CAST(0.002 AS DOUBLE) AS rf
FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
             CAST(sum(CASE WHEN l_linenumber = 1 THEN CAST(l_extendedprice AS DECIMAL(18, 2)) END) AS DOUBLE) AS f1,
             CAST(sum(CASE WHEN l_linenumber = 2 THEN CAST(l_extendedprice AS DECIMAL(18, 2)) END) AS DOUBLE) AS f2,
             CAST(sum(CASE WHEN l_linenumber = 3 THEN CAST(l_extendedprice AS DECIMAL(18, 2)) END) AS DOUBLE) AS f3,
             CAST(sum(CASE WHEN l_linenumber = 4 THEN CAST(l_extendedprice AS DECIMAL(18, 2)) END) AS DOUBLE) AS f4,
             CAST(sum(CASE WHEN l_linenumber = 5 THEN CAST(l_extendedprice AS DECIMAL(18, 2)) END) AS DOUBLE) AS f5
      FROM lineitem GROUP BY 1) f""",
    "monthly": """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS n_rows,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS total,
       CAST(sum(CAST(l_discount AS DECIMAL(18, 4))) AS DOUBLE) / count(*) AS discount,
       CAST(sum(CAST(l_tax AS DECIMAL(18, 4))) AS DOUBLE) / count(*) AS tax,
       CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS quantity,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS returned
FROM lineitem GROUP BY 1""",
    "macro": """
SELECT month, discount AS dp_ratio, tax AS term_spread, quantity / 100 AS real_short_rate, ln(n_rows) / 10 AS default_spread,
       returned AS indpro_growth, total / lag(total) OVER (ORDER BY month) - 1 AS volatility FROM monthly""",
    "recession": """
SELECT month, CASE WHEN total < avg(total) OVER (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS usrec FROM monthly""",
}


def needed(sql: str) -> list[str]:
    """The stand-ins that a statement uses, those used by others first."""
    out: list[str] = []

    def add(text: str) -> None:
        for name, body in VIEWS.items():
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) and name not in out:
                add(body)
                out.append(name)

    add(sql)
    return out


def with_views(sql: str) -> str:
    """The statement behind the stand-ins it uses, as common table expressions; it may begin with its own WITH."""
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in needed(sql)]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*ctes, body[5:]])
    return ("WITH " + ", ".join(ctes) + "\n" if ctes else "") + body


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in as a DataFrame over the Parquet tables."""
    sql = with_views(f"SELECT * FROM {name}")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE}
    return spark.sql(re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(BASE) + r")\b", r"\1 {\2}", sql), **tables)


def _shared(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; unset, a folder is made in local mode (tests), else it is an error."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, which also keeps the plans above it short."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession) -> str:
    """A new place for files in the shared checkpoint folder."""
    return f"{_shared(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared checkpoint folder: for large tables, of which later passes read some columns."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
