"""Registered queries of the panel operators, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions import columns as c
from tessera.operators import aggregates as a
from tessera.operators import joins as j
from tessera.operators import panel as p
from tessera.operators import windows as w
from tessera.plans import standins

FLAGSHIP = "r1_size_breakpoint_universe"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


#: Stand-ins of a row a month: computed once for a query.
SERIES = ("factors", "monthly", "macro", "recession")


class Tables:
    """The stand-in tables of one directory as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._settled: dict[str, DataFrame] = {}

    def settled(self, name: str) -> DataFrame:
        """A stand-in that a query uses many times over, computed once for it."""
        if name not in self._settled:
            self._settled[name] = standins.settled(standins.load(self.spark, self.sf_dir, name))
        return self._settled[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in standins.VIEWS:
            raise AttributeError(name)
        if name in self._settled or name in SERIES:
            return self.settled(name)
        return standins.load(self.spark, self.sf_dir, name)

    @property
    def june(self) -> DataFrame:
        return p.snapshots(self.stock)

    @property
    def universe(self) -> DataFrame:
        return p.size_breakpoint_universe(self.stock, cap=50)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum's terms does not show; -0 becomes 0."""
    return df.select(*((F.round(f"`{f.name}`", digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f"`{f.name}`") for f in df.schema))


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register fn(tables). `doubles` names the columns of the SQL that are rounded as rounded() does."""

    def add(fn: Callable[[Tables], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: rounded(fn(Tables(spark, sf_dir)))
        if sql is not None:
            body = sql.strip()
            if doubles:
                each = ", ".join(f"round({d}, 6) + 0.0 AS {d}" for d in doubles.split())
                body = f"WITH answer AS (\n{standins.with_views(body)}\n) SELECT * REPLACE ({each}) FROM answer"
            else:
                body = standins.with_views(body)
            _ORACLES[name] = body
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tessera.plans import models, reports, storage  # noqa: F401  they register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLES)


# --- columns and filters -------------------------------------------------------------------------


@query("p_columns", """
SELECT permno, month, abs(-prc) AS price, (1 + ret) * (1 + coalesce(dlret, 0)) - 1 AS ret_adjusted, prc * shrout AS cap,
       year(month) * 100 + month(month) AS yyyymm, last_day(month) AS month_end, CAST(month + INTERVAL 1 MONTH AS DATE) AS next_month,
       abs(ret) / (prc * vol) AS illiq, coalesce(substr(CAST(siccd AS STRING), 1, 2), 'unknown') AS ind2, coalesce(CAST(siccd // 10 AS STRING), 'unknown') AS ind3,
       CASE WHEN prc > 4000 THEN 'HIGH' WHEN prc < 2000 THEN 'LOW' ELSE 'OK' END AS price_band, month BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AS in_window
FROM stock WHERE year(month) BETWEEN 1995 AND 2000 AND exchcd IN (0, 1, 2)""", "price ret_adjusted cap illiq")
def _(t):
    s = t.stock.filter(F.year("month").between(1995, 2000) & F.col("exchcd").isin(0, 1, 2))
    return s.select("permno", "month", c.absolute_price(-F.col("prc")).alias("price"), c.adjusted_return().alias("ret_adjusted"), c.market_cap().alias("cap"), c.yyyymm().alias("yyyymm"),
                    c.month_end("month").alias("month_end"), c.shift_month("month", 1).alias("next_month"), c.illiquidity().alias("illiq"), c.industry().alias("ind2"), c.industry(divide=True).alias("ind3"),
                    c.band("prc", 2000, 4000).alias("price_band"), F.col("month").between("1996-01-01", "1999-12-31").alias("in_window"))


@query("p_text_to_values", """
SELECT l_orderkey, l_linenumber, TRY_CAST(CASE WHEN l_returnflag = 'R' THEN 'C' ELSE CAST(l_quantity AS STRING) END AS DOUBLE) AS number,
       TRY_CAST(nullif(CASE WHEN l_returnflag = 'A' THEN 'E' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END, 'E') AS DATE) AS day
FROM lineitem""")
def _(t):
    x = t.spark.read.parquet(f"{t.sf_dir}/lineitem.parquet")
    number = F.when(F.col("l_returnflag") == "R", "C").otherwise(F.col("l_quantity").cast("string"))
    day = F.when(F.col("l_returnflag") == "A", "E").otherwise(F.col("l_shipdate").cast("date").cast("string"))
    return x.select("l_orderkey", "l_linenumber", c.to_number(number).alias("number"), c.to_date(day, "E").alias("day"))


@query("p_decimal_month", """
SELECT month, last_day(month) AS decoded FROM monthly""")
def _(t):
    return t.monthly.select("month", c.decimal_month(F.year("month") + F.month("month") / 100).alias("decoded"))


@query("p_accounting_ratios", """
SELECT gvkey, fyear, CAST(datadate + INTERVAL 6 MONTH AS DATE) AS available, ceq + coalesce(txditc, 0) - coalesce(pstk, 0) AS be, (at_total - che) - (lt - dltt) AS noa,
       (sale - cogs) / at_total AS gp, ni / at_total AS roa, capx / at_total AS capinv, dltt / at_total AS leverage, ni / nullif(sale, 0) AS margin
FROM accounting WHERE curcd IS DISTINCT FROM 'CAD'""", "be noa gp roa capinv leverage margin")
def _(t):
    return t.accounting.filter(c.not_currency("curcd")).select("gvkey", "fyear", c.available_from("datadate").alias("available"), c.book_equity().alias("be"), c.net_operating_assets().alias("noa"),
        c.ratio(F.col("sale") - F.col("cogs"), "at_total").alias("gp"), c.ratio("ni", "at_total").alias("roa"), c.ratio("capx", "at_total").alias("capinv"), c.ratio("dltt", "at_total").alias("leverage"), c.ratio("ni", F.nullif("sale", F.lit(0.0))).alias("margin"))


@query("p23_entity_sample", """
SELECT permno, count(*) AS n FROM stock SEMI JOIN (SELECT permno AS chosen FROM (SELECT DISTINCT permno FROM stock) ORDER BY md5(permno || ':42'), permno LIMIT 50) c ON c.chosen = permno GROUP BY 1""")
def _(t):
    return a.entity_sample(t.stock, 50).groupBy("permno").agg(F.count("*").alias("n"))


# --- joins ---------------------------------------------------------------------------------------


@query("j1_members_only", """
SELECT s.permno, s.month, s.ret FROM stock s SEMI JOIN (SELECT permno, month FROM stock WHERE month(month) = 6 AND market_cap > 100000) m ON s.permno = m.permno AND s.month = m.month""", "ret")
def _(t):
    return j.members_only(t.stock, t.stock.filter((F.month("month") == 6) & (F.col("market_cap") > 100000))).select("permno", "month", "ret")


@query("j3_with_series", "SELECT s.permno, s.month, s.ret - f.rf AS excess, f.mkt_rf FROM stock s LEFT JOIN factors f ON s.month = f.month", "excess mkt_rf")
def _(t):
    return j.with_series(t.stock, t.factors).select("permno", "month", (F.col("ret") - F.col("rf")).alias("excess"), "mkt_rf")


@query("j4_link_join", """
SELECT a.gvkey, a.fyear, l.lpermno AS permno, a.sale FROM accounting a JOIN links l ON a.gvkey = l.gvkey
WHERE l.linkprim IN ('P', 'C') AND l.linkdt <= a.datadate + INTERVAL 6 MONTH AND (l.linkenddt IS NULL OR a.datadate + INTERVAL 6 MONTH <= l.linkenddt)""", "sale")
def _(t):
    return j.link_join(t.accounting.withColumn("available", c.available_from("datadate")), t.links).select("gvkey", "fyear", "permno", "sale")


@query("j5_link_join_by_year", """
SELECT DISTINCT a.gvkey, a.fyear, l.lpermno AS permno, s.month FROM accounting a JOIN links l ON a.gvkey = l.gvkey JOIN stock s ON s.permno = l.lpermno AND year(s.month) = a.fyear WHERE l.linkprim IN ('P', 'C')""")
def _(t):
    return j.link_join_by_year(t.accounting.select("gvkey", "fyear"), t.links, t.stock.select("permno", "month")).select("gvkey", "fyear", "permno", "month")


@query("j6_asof_backward", """
SELECT s.permno, s.month, r.fyear, r.sale FROM stock s ASOF LEFT JOIN (SELECT CAST(gvkey AS BIGINT) AS permno, CAST(datadate + INTERVAL 6 MONTH AS DATE) AS available, fyear, sale FROM accounting) r
ON s.permno = r.permno AND s.month >= r.available""", "sale")
def _(t):
    right = t.accounting.select(F.col("gvkey").cast("long").alias("permno"), c.available_from("datadate").alias("available"), "fyear", "sale")
    return j.asof_backward(t.stock, right, order="fyear").select("permno", "month", "fyear", "sale")


@query("j7_fill_forward", """
SELECT m.month, q.total FROM monthly m ASOF LEFT JOIN (SELECT month, total FROM monthly WHERE month(month) IN (3, 6, 9, 12)) q ON m.month >= q.month""", "total")
def _(t):
    return j.fill_forward(t.monthly.select("month"), t.monthly.filter(F.month("month").isin(3, 6, 9, 12)).select("month", "total"), ["total"])


@query("j8_aligned", """
WITH x AS (SELECT permno, ret AS w FROM stock WHERE month = DATE '1997-06-01' AND ret > 0), y AS (SELECT permno, ret AS w FROM stock WHERE month = DATE '1997-07-01' AND ret > 0)
SELECT coalesce(x.permno, y.permno) AS permno, coalesce(x.w, 0) AS a, coalesce(y.w, 0) AS b FROM x FULL JOIN y ON x.permno = y.permno""", "a b")
def _(t):
    at = lambda m: t.stock.filter((F.col("month") == m) & (F.col("ret") > 0)).select("permno", F.col("ret").alias("weight"))
    return j.aligned(at("1997-06-01"), at("1997-07-01"), ["permno"])


@query("j10_lagged_pairs", "SELECT f.month, f.mkt_rf, m.dp_ratio FROM factors f JOIN macro m ON m.month = f.month - INTERVAL 1 MONTH", "mkt_rf dp_ratio")
def _(t):
    return j.lagged_pairs(t.factors, t.macro).select("month", "mkt_rf", "dp_ratio")


@query("j11_splice", """
WITH x AS (SELECT month, total AS v FROM monthly WHERE month >= DATE '1997-01-01'), y AS (SELECT month, quantity AS v FROM monthly WHERE month < DATE '2000-01-01'),
k AS (SELECT avg(x.v) / avg(y.v) AS scale FROM x JOIN y ON x.month = y.month)
SELECT coalesce(x.month, y.month) AS month, coalesce(x.v, y.v * k.scale) AS v FROM x FULL JOIN y ON x.month = y.month CROSS JOIN k""", "v")
def _(t):
    m = t.monthly
    return j.splice(m.filter("month >= DATE '1997-01-01'").select("month", F.col("total").alias("v")), m.filter("month < DATE '2000-01-01'").select("month", F.col("quantity").alias("v")), "v")


@query("j12_trailing_window", """
SELECT f.form_month, s.permno, count(*) AS n, sum(s.market_cap) AS total FROM (SELECT DISTINCT month AS form_month FROM stock WHERE month(month) IN (6, 12)) f
JOIN stock s ON s.month > f.form_month - INTERVAL 12 MONTH AND s.month <= f.form_month GROUP BY 1, 2""", "total")
def _(t):
    forms = t.stock.filter(F.month("month").isin(6, 12)).select(F.col("month").alias("form_month")).distinct()
    return j.trailing_window(t.stock, forms, 12).groupBy("form_month", "permno").agg(F.count("*").alias("n"), F.sum("market_cap").alias("total"))


# --- aggregations --------------------------------------------------------------------------------


@query("a1_group_quantile", """
SELECT year(month) AS year, quantile_cont(market_cap, 0.35) AS threshold, count(DISTINCT permno) AS n FROM stock WHERE month(month) = 6 AND exchcd = 0 GROUP BY 1""", "threshold")
def _(t):
    return a.group_quantile(t.june, "market_cap", 0.35, "year", F.col("exchcd") == 0)


@query("a2_yearly_summary", """
SELECT year(month) AS year, count(*) AS n, count(DISTINCT permno) AS members, avg(ret) AS mean_ret, min(prc) AS low, max(prc) AS high FROM stock GROUP BY 1""", "mean_ret low high")
def _(t):
    return t.stock.groupBy(F.year("month").alias("year")).agg(F.count("*").alias("n"), F.count_distinct("permno").alias("members"), F.avg("ret").alias("mean_ret"), F.min("prc").alias("low"), F.max("prc").alias("high"))


@query("a4_coverage", """
WITH s AS (SELECT avg(CASE WHEN ret IS NOT NULL THEN 1 ELSE 0 END) AS ret, avg(CASE WHEN dlret IS NOT NULL THEN 1 ELSE 0 END) AS dlret, 1.0::DOUBLE AS prc FROM stock)
UNPIVOT s ON ret, dlret, prc INTO NAME name VALUE coverage""", "coverage")
def _(t):
    return a.coverage(t.stock, ["ret", "dlret", "prc"])


@query("a5_compound", "SELECT permno, year(month) AS year, product(1 + ret) - 1 AS r FROM stock WHERE ret IS NOT NULL GROUP BY 1, 2", "r")
def _(t):
    return t.stock.filter("ret IS NOT NULL").groupBy("permno", F.year("month").alias("year")).agg(a.compound().alias("r"))


@query("a6_collapse", "SELECT exchcd, month, avg(ret) AS ret, avg(prc) AS prc FROM stock GROUP BY 1, 2", "ret prc")
def _(t):
    return a.collapse(t.stock, ["exchcd", "month"], "ret", "prc")


@query("a7_medians", """
SELECT siccd, CASE WHEN count(ret) >= 5 THEN quantile_cont(ret, 0.5) END AS ret, CASE WHEN count(prc) >= 5 THEN quantile_cont(prc, 0.5) END AS prc FROM stock GROUP BY 1""", "ret prc")
def _(t):
    return a.medians(t.stock, ["ret", "prc"], "siccd")


@query("a9_scaler", """
SELECT 'ret' AS name, avg(ret) AS mean, stddev_samp(ret) AS std FROM stock UNION ALL SELECT 'vol', avg(vol), stddev_samp(vol) FROM stock""", "mean std")
def _(t):
    return a.scaler(t.stock, ["ret", "vol"])


@query("a10_zero_r2", """
SELECT month, count(*) AS n, 1 - sum((ret - mkt_rf) * (ret - mkt_rf)) / nullif(sum(ret * ret), 0) AS r2 FROM stock JOIN factors USING (month) WHERE ret IS NOT NULL AND mkt_rf IS NOT NULL GROUP BY month HAVING count(*) >= 5""", "r2")
def _(t):
    return a.zero_r2(j.with_series(t.stock, t.factors), "ret", "mkt_rf", "month")


@query("a11_rank_correlation", """
WITH m AS (SELECT permno, year(month) AS year, avg(prc) AS m FROM stock GROUP BY 1, 2), b AS (SELECT x.permno, x.year, x.m, y.m AS before FROM m x JOIN m y ON x.permno = y.permno AND x.year = y.year + 1),
r AS (SELECT year, rank() OVER (PARTITION BY year ORDER BY m) + (count(*) OVER (PARTITION BY year, m) - 1) / 2.0 AS rm, rank() OVER (PARTITION BY year ORDER BY before) + (count(*) OVER (PARTITION BY year, before) - 1) / 2.0 AS rb FROM b)
SELECT year, count(*) AS n, corr(rm, rb) AS rank_corr FROM r GROUP BY year HAVING count(*) >= 20""", "rank_corr")
def _(t):
    return a.rank_correlation(t.stock.withColumn("year", F.year("month")), "prc")


@query("a12_describe", """
WITH n AS (SELECT exchcd, siccd, count(*) AS k FROM stock GROUP BY 1, 2), o AS (SELECT exchcd, siccd, row_number() OVER (PARTITION BY exchcd ORDER BY k DESC, siccd) AS i FROM n)
SELECT exchcd, avg(siccd) AS mean, quantile_cont(siccd, 0.5) AS median, min(siccd) AS low, max(siccd) AS high, any_value(o.siccd_mode) AS mode
FROM stock JOIN (SELECT exchcd, siccd AS siccd_mode FROM o WHERE i = 1) o USING (exchcd) GROUP BY exchcd""", "mean median")
def _(t):
    return a.describe(t.stock, "siccd", "exchcd")


@query("a13_mean_missing", "SELECT (avg(CASE WHEN ret IS NULL THEN 1 ELSE 0 END) + avg(CASE WHEN dlret IS NULL THEN 1 ELSE 0 END)) / 2 AS mean_missing FROM stock", "mean_missing")
def _(t):
    return a.mean_missing(t.stock, ["ret", "dlret"])


@query("a14_last_of_month", """
WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, max(l_extendedprice) AS price FROM lineitem GROUP BY 1) SELECT last_day(day) AS month_end, arg_max(price, day) AS price FROM d GROUP BY 1""")
def _(t):
    d = t.spark.read.parquet(f"{t.sf_dir}/lineitem.parquet").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.max("l_extendedprice").alias("price"))
    return a.last_of_month(d, "price", "day")


@query("a15_dispersion", "SELECT year(month) AS year, stddev_samp(ret) AS std FROM stock GROUP BY 1", "std")
def _(t):
    return a.dispersion(t.stock.withColumn("year", F.year("month")), "ret")


# --- windows -------------------------------------------------------------------------------------


@query("w1_w2_w14_market_characteristics", """
WITH x AS (SELECT *, (1 + ret) * (1 + coalesce(dlret, 0)) - 1 AS ra, lag(ret) OVER e AS reversal_st, lag(abs(ret) / (prc * vol)) OVER e AS illiquidity FROM stock WINDOW e AS (PARTITION BY permno ORDER BY month)),
l AS (SELECT *, ln(1 + ra) AS lr, lag(ln(1 + ra)) OVER (PARTITION BY permno ORDER BY month) AS l1 FROM x),
s AS (SELECT *, CASE WHEN count(l1) OVER y >= 11 THEN sum(l1) OVER y END AS c12, CASE WHEN count(lr) OVER y >= 11 THEN sum(lr) OVER y END AS l12, CASE WHEN count(lr) OVER z >= 48 THEN sum(lr) OVER z END AS l60
      FROM l WINDOW y AS (PARTITION BY permno ORDER BY month ROWS 11 PRECEDING), z AS (PARTITION BY permno ORDER BY month ROWS 59 PRECEDING))
SELECT permno, month, reversal_st, illiquidity, exp(c12 - l1) - 1 AS momentum, exp(l60 - l12) - 1 AS reversal_lt FROM s""", "reversal_st illiquidity momentum reversal_lt")
def _(t):
    return p.market_characteristics(t.stock).select("permno", "month", "reversal_st", "illiquidity", "momentum", "reversal_lt")


@query("w3_rolling_deviation", """
SELECT permno, month, CASE WHEN count(ret) OVER y >= 6 THEN stddev_samp(ret) OVER y END AS sd FROM stock WINDOW y AS (PARTITION BY permno ORDER BY month ROWS 11 PRECEDING)""", "sd")
def _(t):
    return t.stock.select("permno", "month", w.rolling(F.stddev_samp, "ret", 12, 6).alias("sd"))


@query("w3_rolling_calendar", """
SELECT permno, month, CASE WHEN count(ret) OVER y >= 6 THEN avg(ret) OVER y END AS mean FROM stock
WINDOW y AS (PARTITION BY permno ORDER BY year(month) * 12 + month(month) RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)""", "mean")
def _(t):
    return t.stock.select("permno", "month", w.rolling(F.avg, "ret", 12, 6, calendar=True).alias("mean"))


_RANK = """
SELECT permno, month, CASE WHEN {x} IS NOT NULL THEN 2 * (rank() OVER (PARTITION BY month, {x} IS NULL ORDER BY {x}) + (count({x}) OVER (PARTITION BY month, {x}) - 1) / 2.0) / (count({x}) OVER (PARTITION BY month) + 1) - 1 END AS {x}"""


@query("w4_rank_to_unit", _RANK.format(x="ret") + " FROM stock", "ret")
def _(t):
    return w.rank_to_unit(t.stock.select("permno", "month", "ret"), ["ret"])


@query("w4_rank_long", f"""
WITH r AS ({_RANK.format(x='ret')} FROM stock), v AS ({_RANK.format(x='vol')} FROM stock)
SELECT permno, month, 'ret' AS name, ret AS score FROM r WHERE ret IS NOT NULL UNION ALL SELECT permno, month, 'vol', vol FROM v""", "score")
def _(t):
    return w.rank_long(t.stock, ["ret", "vol"], ["permno"])


@query("w5_topn_universe", """
WITH d AS (SELECT year(month) + 1 AS year, permno, row_number() OVER (PARTITION BY month ORDER BY market_cap DESC, permno) AS i FROM stock WHERE month(month) = 12),
f AS (SELECT year(month) AS year, permno, row_number() OVER (ORDER BY market_cap DESC, permno) AS i FROM stock WHERE month = (SELECT min(month) FROM stock)),
u AS (SELECT year, permno FROM d WHERE i <= 40 UNION SELECT year, permno FROM f WHERE i <= 40)
SELECT permno, CAST(make_date(year, 1, 1) + to_months(CAST(k AS INT)) AS DATE) AS month FROM u, (SELECT unnest(range(12)) AS k) m""")
def _(t):
    return p.topn_universe(t.stock, 40)


@query("w6_prior_count", "SELECT permno, month, count(ret) OVER (PARTITION BY permno ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM stock")
def _(t):
    return t.stock.select("permno", "month", w.prior_count("ret").alias("n"))


@query("w7_industry_demean", "SELECT permno, month, ret - avg(ret) OVER (PARTITION BY substr(CAST(siccd AS STRING), 1, 2), month) AS ret_ia FROM stock", "ret_ia")
def _(t):
    return t.stock.withColumn("ind", c.industry()).select("permno", "month", w.demean("ret", "ind", "month").alias("ret_ia"))


@query("w9_percent_change", "SELECT month, total / lag(total, 12) OVER (ORDER BY month) - 1 AS growth, ln(total) - ln(lag(total, 12) OVER (ORDER BY month)) AS log_growth FROM monthly", "growth log_growth")
def _(t):
    return t.monthly.select("month", w.percent_change("total", 12).alias("growth"), (F.ln("total") - F.ln(F.lag("total", 12).over(Window.orderBy("month")))).alias("log_growth"))


@query("w14_winsorise", """
WITH q AS (SELECT month, quantile_cont(ret, 0.05) AS lo, quantile_cont(ret, 0.95) AS hi FROM stock GROUP BY month)
SELECT permno, month, CASE WHEN ret IS NOT NULL THEN least(greatest(ret, lo), hi) END AS ret FROM stock JOIN q USING (month)""", "ret")
def _(t):
    return w.winsorise(t.stock, "ret", 0.05).select("permno", "month", "ret")


@query("w15_trailing_rank_mean", f"""
WITH r AS ({_RANK.format(x='ret')} FROM stock), g AS (SELECT permno, CAST(month + to_months(CAST(k AS INT)) AS DATE) AS month, ret FROM r, (SELECT unnest(range(3)) AS k) m WHERE ret IS NOT NULL)
SELECT permno, month, avg(ret) AS smooth FROM g WHERE month IN (SELECT month FROM stock) GROUP BY 1, 2""", "smooth")
def _(t):
    return w.trailing_rank_mean(t.stock, "ret")


@query("w16_spans", """
WITH x AS (SELECT month, usrec, CASE WHEN usrec IS NOT DISTINCT FROM lag(usrec) OVER (ORDER BY month) THEN 0 ELSE 1 END AS turn FROM recession), y AS (SELECT *, sum(turn) OVER (ORDER BY month) AS run FROM x)
SELECT usrec AS state, min(month) AS first, max(month) AS last, count(*) AS n FROM y GROUP BY run, usrec""")
def _(t):
    return w.spans(t.recession, "usrec")


@query("w16_recession_spans", """
WITH x AS (SELECT month, usrec, lead(month) OVER (ORDER BY month) AS nx, CASE WHEN usrec IS NOT DISTINCT FROM lag(usrec) OVER (ORDER BY month) THEN 0 ELSE 1 END AS turn FROM recession), y AS (SELECT *, sum(turn) OVER (ORDER BY month) AS run FROM x)
SELECT min(month) AS start, CASE WHEN count(nx) = count(*) THEN max(nx) ELSE last_day(max(month)) END AS "end" FROM y WHERE usrec = 1 GROUP BY run""")
def _(t):
    return w.closed_spans(t.recession, "usrec")


# --- top-k, dedup, sets, reshape -----------------------------------------------------------------


@query("l2_top_k", "SELECT permno, month, market_cap, top_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY month ORDER BY market_cap DESC, permno) AS INT) AS top_rank FROM stock) WHERE top_rank <= 5", "market_cap")
def _(t):
    return w.top_k(t.stock, "market_cap", 5, "month").select("permno", "month", "market_cap", "top_rank")


@query("u1_keep_last", "SELECT siccd, month, permno FROM (SELECT *, row_number() OVER (PARTITION BY siccd, month ORDER BY vol DESC, permno) AS i FROM stock) WHERE i = 1")
def _(t):
    return a.keep_one(t.stock, ["siccd", "month"], [F.desc("vol"), F.col("permno")]).select("siccd", "month", "permno")


@query("u6_pivot", "SELECT year(month) AS year, sum(CASE WHEN exchcd = 0 THEN vol END) AS e0, sum(CASE WHEN exchcd = 1 THEN vol END) AS e1, sum(CASE WHEN exchcd = 2 THEN vol END) AS e2 FROM stock GROUP BY 1", "e0 e1 e2")
def _(t):
    wide = t.stock.withColumn("e", F.concat(F.lit("e"), "exchcd")).groupBy(F.year("month").alias("year")).pivot("e", ["e0", "e1", "e2"]).agg(F.sum("vol"))
    return wide


# --- universes and panel recipes -----------------------------------------------------------------

_JUNE = """
n AS (SELECT *, count(ret) OVER (PARTITION BY permno ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_prior FROM stock),
j AS (SELECT *, year(month) AS year FROM n WHERE month(month) = 6),
b AS (SELECT year, quantile_cont(market_cap, 0.35) AS threshold FROM j WHERE exchcd = 0 GROUP BY year),
s AS (SELECT j.*, threshold, coalesce(market_cap >= threshold, false) AS c1, prc >= 1 AS c2, n_prior >= 24 AS c3 FROM j LEFT JOIN b USING (year)),
y AS (SELECT year, permno, market_cap FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY market_cap DESC, permno) AS i FROM s WHERE c1 AND c2 AND c3) WHERE i <= {cap})"""


# before the first June: January's rows above its threshold, from January to June of the first year
_SEED = """
jn AS (SELECT * FROM stock WHERE month(month) = 1 AND year(month) = (SELECT min(year(month)) FROM stock)),
seed AS (SELECT permno, CAST(month + to_months(CAST(k AS INT)) AS DATE) AS month FROM jn, (SELECT unnest(range(6)) AS k) m
         WHERE market_cap >= (SELECT quantile_cont(market_cap, 0.35) FROM jn WHERE exchcd = 0) AND prc >= 1)"""


@query("r1_size_breakpoint_universe", f"""
WITH {_JUNE.format(cap=1500)}, {_SEED} SELECT permno, CAST(make_date(year, 7, 1) + to_months(CAST(k AS INT)) AS DATE) AS month FROM y, (SELECT unnest(range(12)) AS k) m UNION SELECT permno, month FROM seed""")
def _(t):
    return p.size_breakpoint_universe(t.stock)


@query("r3_funnel", f"""
WITH {_JUNE.format(cap=1500)} SELECT year, count(*) AS n_all, count(*) FILTER (c1) AS n_size, count(*) FILTER (c1 AND c2) AS n_price, count(*) FILTER (c1 AND c2 AND c3) AS n_history, least(count(*) FILTER (c1 AND c2 AND c3), 40) AS n_final, max(threshold) AS threshold FROM s WHERE threshold IS NOT NULL GROUP BY year""", "threshold")
def _(t):
    return p.universe_funnel(t.stock, 40)


@query("r3_membership_turnover", f"""
WITH {_JUNE.format(cap=50)}, n2 AS (SELECT year, count(*) AS n FROM y GROUP BY year),
x AS (SELECT o.year + 1 AS year, count(*) AS n_exits FROM y o WHERE NOT EXISTS (SELECT 1 FROM y z WHERE z.year = o.year + 1 AND z.permno = o.permno) GROUP BY 1)
SELECT a.year, a.n, coalesce(x.n_exits, 0) AS n_exits, coalesce(x.n_exits, 0) / b.n AS turnover, CASE WHEN coalesce(x.n_exits, 0) / b.n > 0.25 THEN 'HIGH' ELSE 'OK' END AS flag
FROM n2 a JOIN n2 b ON a.year = b.year + 1 LEFT JOIN x ON x.year = a.year""", "turnover")
def _(t):
    return p.membership_turnover(p.yearly_members(t.stock, 50))


@query("r3_universe_summary", f"""
WITH {_JUNE.format(cap=50)}, {_SEED}, u AS (SELECT permno, CAST(make_date(year, 7, 1) + to_months(CAST(k AS INT)) AS DATE) AS month FROM y, (SELECT unnest(range(12)) AS k) m UNION SELECT permno, month FROM seed),
g AS (SELECT year(t.month) AS year, count(*) AS n_rows, count(DISTINCT t.permno) AS n_members, avg(market_cap) AS mean_cap, min(market_cap) AS low_cap, max(market_cap) AS high_cap, count(*) / count(DISTINCT t.month) AS avg_members FROM stock t JOIN u ON t.permno = u.permno AND t.month = u.month GROUP BY 1)
SELECT *, CASE WHEN avg_members > 49.5 THEN 'HIGH' WHEN avg_members < 40 THEN 'LOW' ELSE 'OK' END AS flag FROM g""", "mean_cap low_cap high_cap avg_members")
def _(t):
    return p.universe_summary(t.stock, t.universe, 40, 49.5)


_ACCOUNT = """
a1 AS (SELECT *, ceq + coalesce(txditc, 0) - coalesce(pstk, 0) AS be, (at_total - che) - (lt - dltt) AS noa, (sale - cogs) / at_total AS gp FROM accounting WHERE curcd IS DISTINCT FROM 'CAD'),
a2 AS (SELECT *, at_total / lag(at_total) OVER e - 1 AS asset_growth, (noa - lag(noa) OVER e) / lag(noa) OVER e AS accruals FROM a1 WINDOW e AS (PARTITION BY gvkey ORDER BY fyear))"""


@query("r5_accounting_characteristics", f"WITH {_ACCOUNT} SELECT gvkey, fyear, be, noa, gp, asset_growth, accruals FROM a2", "be noa gp asset_growth accruals")
def _(t):
    return p.accounting_characteristics(t.accounting).select("gvkey", "fyear", "be", "noa", "gp", "asset_growth", "accruals")


_PANEL = f"""
{_ACCOUNT},
k AS (SELECT a2.*, l.lpermno, CAST(a2.datadate + INTERVAL 6 MONTH AS DATE) AS available FROM a2 JOIN links l ON a2.gvkey = l.gvkey
      WHERE l.linkprim IN ('P', 'C') AND l.linkdt <= a2.datadate + INTERVAL 6 MONTH AND (l.linkenddt IS NULL OR a2.datadate + INTERVAL 6 MONTH <= l.linkenddt)),
pt AS (SELECT s.*, k.gvkey, k.fyear, k.be, k.sale, k.ni, k.accruals, k.gvkey IS NOT NULL AS has_accounting, k.be / (s.market_cap + 1e-8) AS bm FROM stock s ASOF LEFT JOIN k ON s.permno = k.lpermno AND s.month >= k.available)"""


def _panel(t: Tables) -> DataFrame:
    return p.point_in_time_join(t.stock, p.accounting_characteristics(t.accounting), t.links)


@query("r6_point_in_time_join", f"WITH {_PANEL} SELECT permno, month, gvkey, fyear, be, bm, has_accounting FROM pt", "be bm")
def _(t):
    return a.assert_unique(_panel(t), ["permno", "month"]).select("permno", "month", "gvkey", "fyear", "be", "bm", "has_accounting")


@query("r7_w8_derived_signals", f"""
WITH {_PANEL}, d AS (SELECT *, CASE WHEN gvkey IS NOT NULL THEN sale / lag(sale) OVER g - 1 END AS sgr, CASE WHEN gvkey IS NOT NULL THEN ni / nullif(sale, 0) - lag(ni / nullif(sale, 0)) OVER g END AS dpm,
  CASE WHEN count(accruals) OVER z >= 24 THEN stddev_samp(accruals) OVER z END AS stdacc FROM pt WINDOW g AS (PARTITION BY gvkey, month(month) ORDER BY month), z AS (PARTITION BY permno ORDER BY month ROWS 35 PRECEDING))
SELECT permno, month, sgr, stdacc, bm - avg(bm) OVER i AS bm_ia, dpm - avg(dpm) OVER i AS chpmia FROM d WINDOW i AS (PARTITION BY substr(CAST(siccd AS STRING), 1, 2), month)""", "sgr stdacc bm_ia chpmia")
def _(t):
    return p.derived_signals(_panel(t)).select("permno", "month", "sgr", "stdacc", "bm_ia", "chpmia")


@query("r8_macro_series", """
WITH x AS (SELECT *, quantity / lag(quantity, 12) OVER o - 1 AS inflation, total / lag(total) OVER o - 1 AS mr FROM monthly WINDOW o AS (ORDER BY month))
SELECT month, ln(discount) AS dp_ratio, tax - returned AS term_spread, returned - inflation AS real_short_rate, discount - tax AS default_spread, ln(total) - ln(lag(total, 12) OVER (ORDER BY month)) AS indpro_growth,
       CASE WHEN count(mr) OVER y >= 12 THEN stddev_samp(mr) OVER y * sqrt(12) * 100 END AS volatility FROM x WINDOW y AS (ORDER BY month ROWS 11 PRECEDING)""", "dp_ratio term_spread real_short_rate default_spread indpro_growth volatility")
def _(t):
    m = t.monthly
    series = m.select("month", F.col("discount").alias("dp"), F.col("tax").alias("gs10"), F.col("returned").alias("tb3ms"), F.col("quantity").alias("cpi"), F.col("discount").alias("baa"), F.col("tax").alias("aaa"), F.col("total").alias("indpro"), w.percent_change("total", 1).alias("market_ret"))
    return p.macro_series(series)


@query("r8_spliced_volatility", """
WITH x AS (SELECT *, total / lag(total) OVER (ORDER BY month) - 1 AS mr FROM monthly),
r AS (SELECT month, quantity * 4 AS level, CASE WHEN count(mr) OVER y >= 12 THEN stddev_samp(mr) OVER y * sqrt(12) * 100 END AS realised FROM x WINDOW y AS (ORDER BY month ROWS 11 PRECEDING)),
k AS (SELECT CASE WHEN count(*) >= 13 THEN avg(level) / avg(realised) ELSE 1 END AS scale FROM r WHERE month >= DATE '1998-01-01' AND realised IS NOT NULL)
SELECT month, CASE WHEN month >= DATE '1998-01-01' THEN level ELSE realised * scale END AS volatility FROM r, k""", "volatility")
def _(t):
    """A volatility index from 1998 on, realised volatility at its level before."""
    m = t.monthly
    series = m.select("month", F.col("discount").alias("dp"), F.col("tax").alias("gs10"), F.col("returned").alias("tb3ms"), F.col("quantity").alias("cpi"), F.col("discount").alias("baa"), F.col("tax").alias("aaa"), F.col("total").alias("indpro"), w.percent_change("total", 1).alias("market_ret"))
    index = m.filter("month >= DATE '1998-01-01'").select("month", (F.col("quantity") * 4).alias("volatility"))
    return p.macro_series(series, index).select("month", "volatility")


@query("r7_market_signals", """
WITH m AS (SELECT s.permno, s.month, s.siccd, s.ret * 2 AS beta, ln(s.prc * s.vol) AS dolvol, a.ni / s.market_cap AS cfp, ln(s.market_cap) AS mvel1 FROM stock s LEFT JOIN accounting a ON a.gvkey = CAST(s.permno AS STRING) AND a.fyear = year(s.month) - 1)
SELECT permno, month, beta * beta AS betasq, CASE WHEN count(dolvol) OVER z >= 6 THEN stddev_samp(dolvol) OVER z END AS std_dolvol, cfp - avg(cfp) OVER i AS cfp_ia, mvel1 - avg(mvel1) OVER i AS mve_ia FROM m
WINDOW i AS (PARTITION BY substr(CAST(siccd AS STRING), 1, 2), month), z AS (PARTITION BY permno ORDER BY month ROWS 11 PRECEDING)""", "betasq std_dolvol cfp_ia mve_ia")
def _(t):
    figures = t.accounting.select(F.col("gvkey").cast("long").alias("permno"), (F.col("fyear") + 1).alias("year"), "ni")
    at = t.stock.withColumn("year", F.year("month")).join(figures, ["permno", "year"], "left")
    at = at.select("permno", "month", "siccd", (F.col("ret") * 2).alias("beta"), F.ln(F.col("prc") * F.col("vol")).alias("dolvol"), (F.col("ni") / F.col("market_cap")).alias("cfp"), F.ln("market_cap").alias("mvel1"))
    return p.derived_signals(at).select("permno", "month", "betasq", "std_dolvol", "cfp_ia", "mve_ia")


@query("r9_s5_s6_signal_panel", f"""
WITH {_JUNE.format(cap=50)}, {_SEED}, u AS (SELECT permno, CAST(make_date(year, 7, 1) + to_months(CAST(k AS INT)) AS DATE) AS month FROM y, (SELECT unnest(range(12)) AS k) m UNION SELECT permno, month FROM seed)
SELECT t.permno, t.vol AS turnover_signal, t.ret AS reversal_signal, t.month FROM stock t SEMI JOIN u ON t.permno = u.permno AND t.month = u.month""", "turnover_signal reversal_signal")
def _(t):
    wide = t.stock.select("permno", c.yyyymm().alias("YYYYMM"), F.col("vol").alias("Vol"), F.col("ret").alias("STreversal"), F.col("prc").alias("Price"))
    return p.signal_panel(wide, t.universe, ["vol", "streversal", "price"], ["PRICE"], {"vol": "turnover_signal", "streversal": "reversal_signal"})


@query("r10_panel_summary", f"""
WITH {_PANEL} SELECT 'bm' AS name, count(bm) AS n, avg(CASE WHEN bm IS NULL THEN 0 ELSE 1 END) AS coverage, min(month) FILTER (bm IS NOT NULL) AS first, max(month) FILTER (bm IS NOT NULL) AS last FROM pt
UNION ALL SELECT 'ret', count(ret), avg(CASE WHEN ret IS NULL THEN 0 ELSE 1 END), min(month) FILTER (ret IS NOT NULL), max(month) FILTER (ret IS NOT NULL) FROM pt""", "coverage")
def _(t):
    return p.panel_summary(_panel(t), ["bm", "ret"])


@query("r10_coverage_by_year", f"WITH {_PANEL} SELECT year(month) AS year, count(*) AS n_rows, count(*) FILTER (has_accounting) AS n_with, 100 * count(*) FILTER (has_accounting) / count(*) AS percent FROM pt GROUP BY 1", "percent")
def _(t):
    return p.coverage_by_year(_panel(t))
