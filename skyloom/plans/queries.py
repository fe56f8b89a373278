"""Registered queries of the gridded engine over the driver tables, with DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import cube as C
from ..functions import attributes, rules, timeaxis, transforms
from ..operators import axes, catalog, layout, regrid, select, validate
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CUBE = """cube AS (SELECT CAST(ts AS DATE) AS t, CAST(floor((event_id % 60) / 10.0) AS INTEGER) AS y, CAST(event_id % 10 AS INTEGER) AS x,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS v FROM events GROUP BY 1, 2, 3)"""
DENSE = CUBE + """, dense AS (SELECT a.t, b.y, c.x, d.v FROM (SELECT DISTINCT t FROM cube) a, (SELECT DISTINCT y FROM cube) b, (SELECT DISTINCT x FROM cube) c
  LEFT JOIN cube d ON d.t = a.t AND d.y = b.y AND d.x = c.x)"""
#: The dense cube with every value below the marker's bound missing, so that missing cells occur at any scale.
HOLES = DENSE + ", holes AS (SELECT t, y, x, CASE WHEN v >= 1500 THEN v END AS v FROM dense)"


def _plain_dates(out: DataFrame) -> DataFrame:
    """Dates as ISO text, which every client reads alike."""
    return out.select(*[F.col(c).cast("string").alias(c) if kind == "date" else F.col(c) for c, kind in out.dtypes])


def query(name: str, sql: str | None, dates: str = ""):
    """Register a query and its oracle; ``dates`` names the oracle's date columns."""

    def keep(f: Query) -> Query:
        QUERIES[name] = lambda spark, d: _plain_dates(f(spark, d))
        if sql is not None:
            plain = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split())
            ORACLES[name] = f"SELECT * REPLACE ({plain}) FROM ({sql})" if plain else sql
        return f

    return keep


def _dense(spark: SparkSession, d: str) -> DataFrame:
    cells = C.event_cube(spark, d)
    return C.densify(cells, list(C.distinct_axes(cells).values()))


def _holes(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).withColumn("v", F.when(F.col("v") >= 1500, F.col("v")))


def _axis(n: int, low: float = 0.0, step: float = 1.0) -> axes.Axis:
    return axes.inspect_axis([low + (i + 0.5) * step for i in range(n)])


SOURCE = (_axis(6), _axis(10))


def _targets(step: float, low: float = 0.0) -> tuple[axes.Axis, axes.Axis]:
    return tuple(axes.target_axis(step, False, extent="custom", bounds=(low, low + step * np.ceil((a.high - low) / step - 1e-9))) for a in SOURCE)


# --- data model, selection, transforms ------------------------------------------------


@query("cube", f"WITH {CUBE} SELECT * FROM cube", "t")
def _(spark, d):
    return C.event_cube(spark, d)


@query("densify", f"WITH {DENSE} SELECT * FROM dense", "t")
def _(spark, d):
    return _dense(spark, d)


@query("window_select", f"WITH {CUBE} SELECT * FROM cube WHERE t BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND y BETWEEN 1 AND 4 AND x BETWEEN 2 AND 7", "t")
def _(spark, d):
    y = select.index_window(SOURCE[0], 1.2, 4.9)
    x = select.index_window(SOURCE[1], 7.9, 2.1)
    return C.event_cube(spark, d).where(select.time_window("2024-01-05", "2024-01-20") & select.cell_window(y, x))


@query("range_list_window", f"WITH {CUBE} SELECT * FROM cube WHERE t BETWEEN DATE '2024-01-03' AND DATE '2024-01-09' AND x BETWEEN 3 AND 8", "t")
def _(spark, d):
    times = select.pair(select.parse_range_list("[2024-01-03, 2024-01-09]"), "time")
    lon = select.pair(select.parse_range_list("(8.6, 3.4)"), "lon")
    return C.event_cube(spark, d).where(select.time_window(*times) & select.cell_window(x=select.index_window(SOURCE[1], *lon)))


@query("month_window", f"WITH {CUBE} SELECT * FROM cube WHERE t BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AND y = 0", "t")
def _(spark, d):
    return C.event_cube(spark, d).where(select.time_window("2024-01", "2024-01") & select.cell_window((0, 1)))


@query("variable_select", "SELECT CAST(l_shipdate AS DATE) AS t, l_quantity, l_discount AS rebate FROM lineitem", "t")
def _(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    names = select.choose_variables(lines.columns, ["l_quantity", "l_discount", "l_quantity"])
    renames = select.check_renames({"l_discount": "rebate"})
    return lines.select(F.to_date("l_shipdate").alias("t"), *names).withColumnsRenamed(renames)


@query("fill_scale", f"WITH {CUBE} SELECT t, y, x, CASE WHEN v IN (2000, 3500) THEN NULL ELSE CAST(v AS DOUBLE) * CAST(0.01 AS DOUBLE) END AS value FROM cube", "t")
def _(spark, d):
    rule = transforms.Transform((2000.0, 3500.0), 0.01)
    return C.event_cube(spark, d).select("t", "y", "x", transforms.decode(F.col("v"), rule, "int64").alias("value"))


@query("encode_marker", f"WITH {HOLES} SELECT t, y, x, CAST(coalesce(v, -9999) AS BIGINT) AS v FROM holes", "t")
def _(spark, d):
    marker = transforms.output_marker("int64", transforms.Transform((-9999.0,)), {})
    return _holes(spark, d).withColumn("v", transforms.encode(F.col("v"), "int64", marker))


@query("float32_scale", "SELECT event_id, CAST(CAST(CAST(floor(value) AS INTEGER) AS FLOAT) * CAST(0.1 AS FLOAT) AS FLOAT) AS value FROM events")
def _(spark, d):
    raw = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.floor("value").cast("int").alias("value"))
    return raw.withColumn("value", transforms.decode(F.col("value"), transforms.Transform(scale=0.1), "int32"))


@query("axis_flip", f"WITH {CUBE} SELECT t, CAST(5 - y AS INTEGER) AS y, x, v FROM cube", "t")
def _(spark, d):
    return C.flip(C.event_cube(spark, d), "y", 6)


@query("melt_variables", "SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_linenumber AS INTEGER) AS n, u.var, u.value FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('l_tax', l_tax)) u(var, value)")
def _(spark, d):
    wide = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("n"), "l_quantity", "l_tax")
    return C.melt(wide, ["l_quantity", "l_tax"], ["k", "n"])


@query("widen_variables", "SELECT CAST(ts AS DATE) AS t, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'view' THEN value END) AS \"view\" FROM events WHERE event_type IN ('click', 'view') GROUP BY 1", "t")
def _(spark, d):
    daily = spark.read.parquet(f"{d}/events.parquet").where(F.col("event_type").isin("click", "view")).groupBy(F.to_date("ts").alias("t"), F.col("event_type").alias("var")).agg(F.max("value").alias("value"))
    return C.widen(daily, ["click", "view"], ["t"])


@query("union_time", f"WITH {CUBE} SELECT * FROM cube WHERE t < DATE '2024-01-11' UNION ALL SELECT * FROM cube WHERE t > DATE '2024-01-20'", "t")
def _(spark, d):
    cells = C.event_cube(spark, d)
    return C.concat_time([cells.where("t < date'2024-01-11'"), cells.where("t > date'2024-01-20'")])


@query("stride_sample", f"WITH {CUBE} SELECT * FROM cube WHERE y % 2 = 0 AND x % 4 = 0", "t")
def _(spark, d):
    return select.strided(C.event_cube(spark, d), {"y": 2, "x": 4})


@query("contiguity", f"WITH {CUBE} SELECT CAST(min(x) AS INTEGER) AS first_index, CAST(max(x) AS INTEGER) AS last_index, count(DISTINCT x) AS n, max(x) - min(x) + 1 = count(DISTINCT x) AS contiguous FROM cube WHERE x <> 4")
def _(spark, d):
    return select.contiguous(C.event_cube(spark, d).where("x <> 4"), "x")


@query("nan_to_null", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events")
def _(spark, d):
    raw = spark.read.parquet(f"{d}/events.parquet")
    return raw.select("event_id", C.nan_to_null(F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))).alias("value"))


# --- rules and statistics ----------------------------------------------------------------


@query("replace_rules", f"WITH {CUBE}, s AS (SELECT CAST(min(v) AS DOUBLE) AS mn, CAST(max(v) AS DOUBLE) AS mx FROM cube) SELECT t, y, x, CASE WHEN v <= mn + 1000 THEN mn WHEN v >= mx - 1000 THEN mx ELSE CAST(v AS DOUBLE) END AS v FROM cube, s", "t")
def _(spark, d):
    cells = C.event_cube(spark, d)
    parsed = rules.parse_rules("<= min + 1000, >= max - 1000", "min, max")
    known = rules.statistics(cells, "v")  # one pass; the plan below holds its numbers
    return cells.withColumn("v", rules.apply_rules(F.col("v"), T.LongType(), parsed, known))


@query("replace_literal", f"WITH {HOLES} SELECT t, y, x, CASE WHEN v < 2000 THEN 0.0 WHEN v >= 5000 THEN 2.0 * 5000 WHEN v = 3000 THEN -1.0 ELSE CAST(v AS DOUBLE) END AS v FROM holes", "t")
def _(spark, d):
    parsed = rules.parse_rules("<2000, >=10**3*5, ==3000", "0, 2*5000, -1")
    return _holes(spark, d).withColumn("v", rules.apply_rules(F.col("v"), T.LongType(), parsed))


@query("axis_stats", f"WITH {CUBE} SELECT y, CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, quantile_cont(v, 0.5) AS p50, round(quantile_cont(v, 0.95), 6) AS p95 FROM cube GROUP BY y")
def _(spark, d):
    stats = C.event_cube(spark, d).groupBy("y").agg(*rules.statistics_columns(F.col("v")))
    return stats.select("y", "min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "p50", F.round("p95", 6).alias("p95"))


@query("semantic_check", f"WITH {HOLES} SELECT count(*) AS n_cells, count(v) AS n_finite, count(*) FILTER (v < 2000) AS n_below, count(*) FILTER (v > 90000) AS n_above, min(v) AS least, max(v) AS most FROM holes")
def _(spark, d):
    return validate.domain_report(_holes(spark, d), "v", 2000, 90000)


@query("python_modulo", "SELECT event_id, CAST(event_id - 500 AS BIGINT) - 7 * CAST(floor((event_id - 500) / 7.0) AS BIGINT) AS m FROM events")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", transforms.python_modulo(F.col("event_id") - 500, F.lit(7)).cast("bigint").alias("m"))


# --- time axes -----------------------------------------------------------------------------

DAYS = "days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS t FROM orders)"


def _order_days(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.to_date("o_orderdate").alias("t")).distinct()


#: Every order's day as the first day of its eight-day composite, which restarts every year.
EIGHT_DAYS = "days AS (SELECT DISTINCT CAST(make_date(CAST(year(o_orderdate) AS INTEGER), 1, 1) + CAST((dayofyear(o_orderdate) - 1) // 8 * 8 AS INTEGER) AS DATE) AS t FROM orders)"


def _eight_days(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    start = F.date_add(F.make_date(F.year(day), F.lit(1), F.lit(1)), (F.floor((F.dayofyear(day) - 1) / 8) * 8).cast("int"))
    return spark.read.parquet(f"{d}/orders.parquet").select(start.alias("t"))


@query("calendar_gaps", f"WITH {DAYS}, cal AS (SELECT CAST(unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS DATE) AS t FROM days) SELECT cal.t, days.t IS NULL AS missing FROM cal LEFT JOIN days USING (t)", "t")
def _(spark, d):
    days = _order_days(spark, d)
    calendar = timeaxis.daily_calendar(days)
    return calendar.join(days.withColumn("seen", F.lit(True)), "t", "left").select("t", F.col("seen").isNull().alias("missing"))


@query("missing_dates", f"WITH {DAYS}, cal AS (SELECT CAST(unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS DATE) AS t FROM days) SELECT t FROM cal WHERE t NOT IN (SELECT t FROM days)", "t")
def _(spark, d):
    days = _order_days(spark, d)
    return timeaxis.missing_dates(timeaxis.daily_calendar(days), days)


@query("gap_report", f"WITH {DAYS}, l AS (SELECT lag(t) OVER (ORDER BY t) AS before, t AS after FROM days) SELECT before, after, CAST(date_diff('day', before, after) - 1 AS INTEGER) AS missing FROM l WHERE date_diff('day', before, after) > 1", "before after")
def _(spark, d):
    return timeaxis.gaps(_order_days(spark, d))


@query("cadence", f"WITH {DAYS}, l AS (SELECT date_diff('day', lag(t) OVER (ORDER BY t), t) AS s FROM days), m AS (SELECT min(s) AS least FROM l) SELECT CAST(min(least) AS INTEGER) AS step_days, count(*) FILTER (s * 1.0 / least > 1.5 AND s % least = 0) AS n_gaps, CAST(coalesce(sum(CASE WHEN s * 1.0 / least > 1.5 AND s % least = 0 THEN s // least - 1 END), 0) AS BIGINT) AS n_missing FROM l, m WHERE s IS NOT NULL")
def _(spark, d):
    return timeaxis.cadence(_order_days(spark, d))


@query("islands", f"WITH {DAYS}, n AS (SELECT t, t - CAST(row_number() OVER (ORDER BY t) AS INTEGER) AS g FROM days) SELECT min(t) AS first_day, max(t) AS last_day, count(*) AS n FROM n GROUP BY g", "first_day last_day")
def _(spark, d):
    return timeaxis.date_islands(_order_days(spark, d))


@query("index_islands", "WITH n AS (SELECT l_orderkey AS k, CAST(l_linenumber AS INTEGER) AS i, CAST(l_linenumber AS INTEGER) - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10)) SELECT k, min(i) AS first_index, max(i) AS last_index, count(*) AS n FROM n GROUP BY k, g")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 10").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("i")).distinct()
    return timeaxis.islands(rows, ["k"], "i")


@query("doy_parse", "SELECT DISTINCT strftime(o_orderdate, 'A%Y%j') AS name, CAST(o_orderdate AS DATE) AS t FROM orders", "t")
def _(spark, d):
    names = spark.read.parquet(f"{d}/orders.parquet").select(F.date_format("o_orderdate", "'A'yyyyDDD").alias("name")).distinct()
    return names.withColumn("t", timeaxis.named_date(F.col("name"), timeaxis.NameRule("doy", 1, 7)))


@query("ymd_parse", "SELECT DISTINCT strftime(o_orderdate, 'f_%Y%m%d.nc') AS name, CAST(o_orderdate AS DATE) AS t FROM orders", "t")
def _(spark, d):
    names = spark.read.parquet(f"{d}/orders.parquet").select(F.date_format("o_orderdate", "'f_'yyyyMMdd'.nc'").alias("name")).distinct()
    return names.withColumn("t", timeaxis.named_date(F.col("name"), timeaxis.NameRule("ymd", 2, 8)))


@query("hybrid_time", "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(o_orderdate AS DATE) AS t FROM orders", "t")
def _(spark, d):
    day = F.to_date("o_orderdate")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.year(day).alias("y"), F.dayofyear(day).alias("doy")).distinct()
    rule = timeaxis.TimeRule({"year": "name:4:4", "doy": "time"})
    return rows.withColumn("t", rule.column(F.concat(F.lit("lai_"), F.col("y").cast("string")), F.col("doy")))


@query("cf_time_decode", "SELECT event_id, CAST(DATE '2000-01-01' + CAST(event_id % 9000 AS INTEGER) AS DATE) AS t FROM events", "t")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    return rows.withColumn("t", timeaxis.decoded_time(F.col("event_id") % 9000, "days since 2000-01-01"))


@query("annual_steps", f"WITH {EIGHT_DAYS} SELECT CAST(year(t) AS INTEGER) AS year, CAST(min(dayofyear(t)) AS INTEGER) AS first_doy, CAST(max(dayofyear(t)) AS INTEGER) AS last_doy, CAST(count(*) AS INTEGER) AS n, 8 AS step FROM days GROUP BY 1")
def _(spark, d):
    return timeaxis.annual_steps(_eight_days(spark, d))


@query("annual_calendar", f"WITH {EIGHT_DAYS}, y AS (SELECT year(t) AS y, min(dayofyear(t)) AS a, max(dayofyear(t)) AS b FROM days GROUP BY 1), s AS (SELECT min(y) AS y0, max(y) AS y1 FROM y), e AS (SELECT y, a, CASE WHEN y IN (y0, y1) THEN b ELSE dayofyear(make_date(y, 12, 31)) END AS b FROM y, s) SELECT CAST(make_date(y, 1, 1) + CAST(unnest(generate_series(a, b, 8)) - 1 AS INTEGER) AS DATE) AS t FROM e", "t")
def _(spark, d):
    return timeaxis.annual_calendar(_eight_days(spark, d))


@query("duplicate_times", "SELECT CAST(ts AS DATE) AS t, count(*) AS n, list_sort(list(CAST(event_id AS VARCHAR))) AS paths FROM events GROUP BY 1 HAVING count(*) > 1", "t")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.to_date("ts").alias("t"), F.col("event_id").cast("string").alias("path"))
    return timeaxis.duplicate_dates(rows)


@query("sub_daily", "SELECT event_type AS path, CAST(ts AS DATE) AS t, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1", "t")
def _(spark, d):
    return timeaxis.sub_daily(spark.read.parquet(f"{d}/events.parquet"), "ts", "event_type").withColumnRenamed("event_type", "path")


def _day_names(spark: SparkSession, d: str, pattern: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.date_format("o_orderdate", pattern).alias("name")).distinct()


@query("filename_fields", "SELECT 1 AS start, 2 AS length, '12' AS sample, FALSE AS changes UNION ALL SELECT 4, 8, strftime(min(o_orderdate), '%Y%m%d'), count(DISTINCT CAST(o_orderdate AS DATE)) > 1 FROM orders")
def _(spark, d):
    names = [r.name for r in _day_names(spark, d, "'p12_'yyyyMMdd'.nc'").orderBy("name").collect()]  # as many as the product has dates
    return spark.createDataFrame([(f.start, f.length, f.sample, f.changes) for f in timeaxis.name_fields(names)], "start int, length int, sample string, changes boolean")


@query("automatic_dates", "SELECT DISTINCT strftime(o_orderdate, 'p12_%Y%m%d.nc') AS name, CAST(o_orderdate AS DATE) AS t FROM orders", "t")
def _(spark, d):
    names = _day_names(spark, d, "'p12_'yyyyMMdd'.nc'")
    rule = timeaxis.automatic_rule([r.name for r in names.orderBy("name").collect()])
    return names.withColumn("t", timeaxis.named_date(F.col("name"), rule))


@query("manual_dates", "SELECT DISTINCT strftime(o_orderdate, 'v2001_%Y%j.tif') AS name, CAST(o_orderdate AS DATE) AS t FROM orders", "t")
def _(spark, d):
    names = _day_names(spark, d, "'v2001_'yyyyDDD'.tif'")
    sample = names.agg(F.min("name")).first()[0]
    return names.withColumn("t", timeaxis.named_date(F.col("name"), timeaxis.manual_rule(sample, sample[6:13])))


@query("suggested_dates", "SELECT DISTINCT 'lai_' || CAST(year(o_orderdate) AS VARCHAR) || '.nc' AS name, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(o_orderdate AS DATE) AS t FROM orders", "t")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.date_format("o_orderdate", "'lai_'yyyy'.nc'").alias("name"), F.dayofyear("o_orderdate").alias("doy")).distinct()
    names = [r.name for r in rows.select("name").distinct().orderBy("name").collect()]  # one for each year
    rule = timeaxis.suggest_rule(timeaxis.name_fields(names), timeaxis.time_kind("day", (1, 366)))
    return rows.withColumn("t", rule.column(F.col("name"), F.col("doy")))


@query("locate_times", f"WITH {DAYS}, cal AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS t), f AS (SELECT CAST(ts AS DATE) AS t, min(event_id) AS path FROM events WHERE event_type = 'view' GROUP BY 1) SELECT t, path FROM cal LEFT JOIN f USING (t)", "t")
def _(spark, d):
    files = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'view'").groupBy(F.to_date("ts").alias("t")).agg(F.min("event_id").alias("path"))
    wanted = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))).alias("t"))
    return catalog.locate_times(wanted, files)


# --- regridding -------------------------------------------------------------------------------


def _axis_sql(name: str, n: int, step: float, low: float) -> str:
    return f"{name} AS (SELECT CAST(i AS INTEGER) AS j, {low} + i * {step} AS a, {low} + (i + 1) * {step} AS b, {low} + (i + 0.5) * {step} AS c FROM generate_series(0, {n - 1}) s(i))"


def _overlap_sql(step: float, cells: str, low: float = 0.0) -> str:
    ty, tx = _targets(step, low)
    return f"""{_axis_sql('ay', len(ty), step, low)}, {_axis_sql('ax', len(tx), step, low)},
  wy AS (SELECT j, CAST(i AS INTEGER) AS y, least(b, i + 1) - greatest(a, i) AS w FROM ay, generate_series(0, 5) s(i) WHERE least(b, i + 1) > greatest(a, i)),
  wx AS (SELECT j, CAST(i AS INTEGER) AS x, least(b, i + 1) - greatest(a, i) AS w FROM ax, generate_series(0, 9) s(i) WHERE least(b, i + 1) > greatest(a, i)),
  sums AS (SELECT t, wy.j AS y, wx.j AS x, sum(wy.w * wx.w * v) AS num, coalesce(sum(CASE WHEN v IS NOT NULL THEN wy.w * wx.w END), 0) AS den, count(*) AS n, count(v) AS k
           FROM {cells} JOIN wy USING (y) JOIN wx USING (x) GROUP BY 1, 2, 3),
  grid AS (SELECT t, ay.j AS y, ax.j AS x FROM (SELECT DISTINCT t FROM {cells}), ay, ax)"""


def _regridded(name: str, method: str, step: float, sql: str, *, holes: bool = True, low: float = 0.0, **options) -> None:
    @query(name, sql, "t")
    def _(spark, d):
        cells = _holes(spark, d) if holes else _dense(spark, d)
        out = regrid.regrid(cells, SOURCE, _targets(step, low), method, **options)
        return out.withColumn("value", F.round("value", 6))


_regridded("regrid_conservative_normed", "conservative_normed", 2.5, f"WITH {HOLES}, {_overlap_sql(2.5, 'holes')}, cover AS (SELECT ay.j AS y, ax.j AS x, (least(ay.b, 6) - ay.a) * (least(ax.b, 10) - ax.a) AS c FROM ay, ax) SELECT g.t, g.y, g.x, CASE WHEN den / c >= 1e-6 THEN round(num / den, 6) END AS value FROM grid g JOIN cover USING (y, x) LEFT JOIN sums s ON s.t = g.t AND s.y = g.y AND s.x = g.x")
_regridded("skipna_threshold", "conservative", 2.5, f"WITH {HOLES}, {_overlap_sql(2.5, 'holes')} SELECT g.t, g.y, g.x, CASE WHEN den / 6.25 >= 0.75 THEN round(num / den, 6) END AS value FROM grid g LEFT JOIN sums s ON s.t = g.t AND s.y = g.y AND s.x = g.x", na_thres=0.25)
_regridded("regrid_conservative", "conservative", 2.5, f"WITH {HOLES}, {_overlap_sql(2.5, 'holes')} SELECT g.t, g.y, g.x, CASE WHEN n = k THEN round(num / 6.25, 6) END AS value FROM grid g LEFT JOIN sums s ON s.t = g.t AND s.y = g.y AND s.x = g.x", skipna=False)
_regridded("regrid_uncovered", "conservative_normed", 4.0, f"WITH {DENSE}, {_overlap_sql(4.0, 'dense', -8.0)} SELECT g.t, g.y, g.x, round(num / den, 6) AS value FROM grid g LEFT JOIN sums s ON s.t = g.t AND s.y = g.y AND s.x = g.x", holes=False, low=-8.0)
BILINEAR_SQL = f"""WITH {HOLES}, {_axis_sql('ay', 5, 1.25, 0.0)}, {_axis_sql('ax', 8, 1.25, 0.0)},
 wy AS (SELECT j, CAST(i AS INTEGER) AS y, 1 - abs(i + 0.5 - c) AS w FROM ay, generate_series(0, 5) s(i) WHERE abs(i + 0.5 - c) < 1 AND c BETWEEN 0.5 AND 5.5),
 wx AS (SELECT j, CAST(i AS INTEGER) AS x, 1 - abs(i + 0.5 - c) AS w FROM ax, generate_series(0, 9) s(i) WHERE abs(i + 0.5 - c) < 1 AND c BETWEEN 0.5 AND 9.5),
 sums AS (SELECT t, wy.j AS y, wx.j AS x, sum(wy.w * wx.w * v) AS num, sum(CASE WHEN v IS NOT NULL THEN wy.w * wx.w END) AS den FROM holes JOIN wy USING (y) JOIN wx USING (x) GROUP BY 1, 2, 3),
 grid AS (SELECT t, ay.j AS y, ax.j AS x FROM (SELECT DISTINCT t FROM holes), ay, ax)
 SELECT g.t, g.y, g.x, CASE WHEN den >= 1e-6 THEN round(num / den, 6) END AS value FROM grid g LEFT JOIN sums s ON s.t = g.t AND s.y = g.y AND s.x = g.x"""
_regridded("regrid_bilinear", "bilinear", 1.25, BILINEAR_SQL)
NEAREST_SQL = f"""WITH {HOLES}, {_axis_sql('ay', 4, 1.6, 0.0)}, {_axis_sql('ax', 7, 1.6, 0.0)},
 wy AS (SELECT j, y FROM (SELECT j, CAST(i AS INTEGER) AS y, row_number() OVER (PARTITION BY j ORDER BY abs(i + 0.5 - c), i) AS r FROM ay, generate_series(0, 5) s(i)) WHERE r = 1),
 wx AS (SELECT j, x FROM (SELECT j, CAST(i AS INTEGER) AS x, row_number() OVER (PARTITION BY j ORDER BY abs(i + 0.5 - c), i) AS r FROM ax, generate_series(0, 9) s(i)) WHERE r = 1)
 SELECT t, wy.j AS y, wx.j AS x, CAST(v AS DOUBLE) AS value FROM holes JOIN wy USING (y) JOIN wx USING (x)"""
_regridded("regrid_nearest_s2d", "nearest_s2d", 1.6, NEAREST_SQL)
_regridded("regrid_nearest_d2s", "nearest_d2s", 2.0, f"WITH {HOLES} SELECT t, CAST(floor(y / 2.0) AS INTEGER) AS y, CAST(floor(x / 2.0) AS INTEGER) AS x, round(avg(v), 6) AS value FROM holes GROUP BY 1, 2, 3")
_regridded("regrid_nearest_d2s_sum", "nearest_d2s", 2.0, f"WITH {HOLES} SELECT t, CAST(floor(y / 2.0) AS INTEGER) AS y, CAST(floor(x / 2.0) AS INTEGER) AS x, CASE WHEN count(*) = count(v) THEN CAST(sum(v) AS DOUBLE) END AS value FROM holes GROUP BY 1, 2, 3", skipna=False)


def _patch_sql(name: str, n: int, target: str) -> str:
    """Weights of quadratic recovery along an axis of unit cells: two parabolas through three centres, blended."""
    return f"""{name}b AS (SELECT j, c - 0.5 AS u, least(CAST(floor(c - 0.5) AS INTEGER), {n - 2}) AS k FROM {target} WHERE c BETWEEN 0.5 AND {n - 0.5}),
  {name}f AS (SELECT j, u, k AS centre, 1 - (u - k) AS blend FROM {name}b UNION ALL SELECT j, u, k + 1, u - k FROM {name}b),
  {name}p AS (SELECT j, blend, least(greatest(centre - 1, 0), {n - 3}) AS low, u - least(greatest(centre - 1, 0), {n - 3}) AS d FROM {name}f),
  {name} AS (SELECT j, CAST(low + i AS INTEGER) AS {name[1]}, sum(blend * CASE i WHEN 0 THEN (d - 1) * (d - 2) / 2 WHEN 1 THEN -d * (d - 2) ELSE d * (d - 1) / 2 END) AS w
             FROM {name}p, generate_series(0, 2) s(i) GROUP BY 1, 2)"""


PATCH_SQL = f"""WITH {DENSE}, {_axis_sql('ay', 5, 1.25, 0.0)}, {_axis_sql('ax', 8, 1.25, 0.0)}, {_patch_sql('wy', 6, 'ay')}, {_patch_sql('wx', 10, 'ax')},
 sums AS (SELECT t, wy.j AS y, wx.j AS x, sum(wy.w * wx.w * v) AS num, sum(CASE WHEN v IS NOT NULL THEN wy.w * wx.w END) AS den FROM dense JOIN wy USING (y) JOIN wx USING (x) GROUP BY 1, 2, 3),
 grid AS (SELECT t, ay.j AS y, ax.j AS x FROM (SELECT DISTINCT t FROM dense), ay, ax)
 SELECT g.t, g.y, g.x, CASE WHEN den >= 1e-6 THEN round(num / den, 6) END AS value FROM grid g LEFT JOIN sums s ON s.t = g.t AND s.y = g.y AND s.x = g.x"""
_regridded("regrid_patch", "patch", 1.25, PATCH_SQL, holes=False)


@query("dense_check", f"WITH r AS ({BILINEAR_SQL}) SELECT y, x, value FROM r WHERE t = (SELECT min(t) FROM r)")
def _(spark, d):
    cells = _holes(spark, d)
    first = cells.where(F.col("t") == cells.agg(F.min("t")).first()[0]).collect()  # one map of 60 cells
    values = np.full((6, 10), np.nan)
    for r in first:
        values[r.y, r.x] = np.nan if r.v is None else r.v
    out = validate.dense_regrid(values, SOURCE, _targets(1.25), "bilinear")
    rows = [(y, x, None if np.isnan(out[y, x]) else round(float(out[y, x]), 6)) for y, x in np.ndindex(*out.shape)]
    return spark.createDataFrame(rows, "y int, x int, value double")


@query("product_barrier", f"WITH {HOLES}, w AS (SELECT t, y, x, CASE WHEN v < 2000 THEN 0 ELSE v END AS v FROM holes WHERE t BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'), r AS (SELECT t, CAST(2 - y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, avg(v) AS v FROM w GROUP BY 1, 2, 3), s AS (SELECT min(v) AS mn, max(v) AS mx FROM r) SELECT t, y, x, round(CASE WHEN v >= mx - 1000 THEN mn ELSE v END, 6) AS v FROM r, s", "t")
def _(spark, d):
    config = pipeline.Config(time=("2024-01-05", "2024-01-20"), resample=True, resolution=2.0, method="conservative_normed", before=("<2000", "0"), after=(">= max - 1000", "min"))
    plan = pipeline.build_plan(SOURCE[0].centres, SOURCE[1].centres, 16, config)
    return pipeline.product(_holes(spark, d), plan).withColumn("v", F.round("v", 6))


@query("product_turned", f"WITH {HOLES} SELECT t, CAST(5 - y AS INTEGER) AS y, x, CAST(v AS DOUBLE) AS v FROM holes", "t")
def _(spark, d):
    plan = pipeline.build_plan(SOURCE[0].centres, SOURCE[1].centres, 30, pipeline.Config(resample=True, resolution=1.0))
    return pipeline.product(_holes(spark, d), plan)


@query("target_cells", f"WITH {CUBE}, e AS (SELECT min(x) AS a, max(x) + 1 AS b FROM cube) SELECT CAST(i AS INTEGER) AS i, a + (n - 1 - i) * 2.5 + 1.25 AS center, a + (n - 1 - i) * 2.5 AS lo, a + (n - i) * 2.5 AS hi FROM (SELECT a, CAST(ceil((b - a) / 2.5) AS BIGINT) AS n FROM e), generate_series(0, 3) g(i) WHERE i < n")
def _(spark, d):
    centres = [r.x + 0.5 for r in C.event_cube(spark, d).select("x").distinct().orderBy("x").collect()]
    target = axes.target_axis(2.5, True, source=axes.inspect_axis(centres, "lon"))
    return spark.createDataFrame(target.rows(), "i int, center double, lo double, hi double")


def _nations(spark: SparkSession, d: str) -> list[int]:
    """The 25 keys, as parameters of axis operators."""
    return [r[0] for r in spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("int")).collect()]


@query("grid_equality", "SELECT CAST(n_nationkey AS INTEGER) AS k, CASE WHEN n_nationkey % 4 = 0 AND n_nationkey <= 24 THEN CAST(n_nationkey // 4 AS INTEGER) END AS first_index, CASE WHEN n_nationkey % 4 = 0 AND n_nationkey <= 24 THEN CAST(n_nationkey // 4 + 4 AS INTEGER) END AS end_index FROM nation")
def _(spark, d):
    rows = [(k, *(axes.matching_slice(SOURCE[1], _axis(4, k * 0.25)) or (None, None))) for k in _nations(spark, d)]
    return spark.createDataFrame(rows, "k int, first_index int, end_index int")


@query("read_windows", """WITH k AS (SELECT CAST(n_nationkey AS INTEGER) AS k, n_nationkey * 0.25 AS a, n_nationkey * 0.25 + 3 AS b FROM nation), i AS (SELECT CAST(i AS INTEGER) AS i FROM generate_series(0, 9) g(i))
 SELECT k, 'conservative' AS method, min(i) AS first_index, max(i) + 1 AS end_index FROM k, i WHERE i + 1 > a AND i < b GROUP BY k
 UNION ALL SELECT k, 'bilinear', CAST(greatest(count(*) FILTER (i + 0.5 < a) - 1, 0) AS INTEGER), CAST(least(count(*) FILTER (i + 0.5 <= b) + 1, 10) AS INTEGER) FROM k, i GROUP BY k""")
def _(spark, d):
    rows = [(k, m, *axes.read_window(SOURCE[1], k * 0.25, k * 0.25 + 3, m)) for k in _nations(spark, d) for m in ("conservative", "bilinear")]
    return spark.createDataFrame(rows, "k int, method string, first_index int, end_index int")


@query("uncovered_sides", "SELECT CAST(n_nationkey AS INTEGER) AS k, concat_ws(',', CASE WHEN n_nationkey * 0.5 - 4 < 0 THEN 'low' END, CASE WHEN n_nationkey * 0.5 + 4 > 10 THEN 'high' END) AS sides FROM nation")
def _(spark, d):
    rows = [(k, ",".join(axes.uncovered_sides(SOURCE[1], _axis(8, k * 0.5 - 4)))) for k in _nations(spark, d)]
    return spark.createDataFrame(rows, "k int, sides string")


@query("conserved_total", f"WITH {DENSE} SELECT t, CAST(sum(v) AS DOUBLE) AS total FROM dense GROUP BY t", "t")
def _(spark, d):
    out = regrid.regrid(_dense(spark, d), SOURCE, _targets(0.5), "conservative", skipna=True)
    return out.groupBy("t").agg(F.round(F.sum(F.col("value") * 0.25), 6).alias("total"))


@query("periodic_shift", f"WITH {CUBE}, s AS (SELECT x, x * 36.0 + k * 360 AS a, x * 36.0 + 36 + k * 360 AS b FROM generate_series(0, 9) g(x), generate_series(-1, 1) h(k)), tg AS (SELECT j, j * 90.0 - 180 AS a, j * 90.0 - 90 AS b FROM generate_series(0, 3) g(j)), w AS (SELECT CAST(j AS INTEGER) AS j, CAST(x AS INTEGER) AS x, sum(least(s.b, tg.b) - greatest(s.a, tg.a)) / 90 AS w FROM s, tg WHERE least(s.b, tg.b) > greatest(s.a, tg.a) GROUP BY 1, 2) SELECT t, y, j AS x, round(sum(w * v) / sum(w), 6) AS value FROM cube JOIN w USING (x) GROUP BY 1, 2, 3", "t")
def _(spark, d):
    source = axes.inspect_axis([18.0 + 36 * i for i in range(10)])
    target = axes.target_axis(90.0, False, extent="global", bounds=axes.global_bounds("lon"))
    wx = regrid.weight_table(spark, regrid.overlap_weights(source, target, normed=True, periodic=source.periodic), "tx", "x", "wx")
    wy = regrid.weight_table(spark, [(i, i, 1.0) for i in range(6)], "ty", "y", "wy")
    out = regrid.combine(C.event_cube(spark, d), wy, wx, F.col("v"))
    return out.select("t", F.col("ty").alias("y"), F.col("tx").alias("x"), F.round("value", 6).alias("value"))


@query("axis_cells", "SELECT CAST(i AS INTEGER) AS i, CAST(i + 0.5 AS DOUBLE) AS center, CAST(i AS DOUBLE) AS lo, CAST(i + 1 AS DOUBLE) AS hi FROM generate_series(0, 5) s(i)")
def _(spark, d):
    return spark.createDataFrame(SOURCE[0].rows(), "i int, center double, lo double, hi double")


@query("flagship", f"WITH {HOLES}, w AS (SELECT t, y, x, CAST(v AS DOUBLE) * CAST(0.01 AS DOUBLE) AS v FROM holes WHERE t BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'), {_overlap_sql(2.5, 'w')}, cover AS (SELECT ay.j AS y, ax.j AS x, (least(ay.b, 6) - ay.a) * (least(ax.b, 10) - ax.a) AS c FROM ay, ax), r AS (SELECT g.t, g.y, g.x, CASE WHEN den / c >= 1e-6 THEN num / den END AS value FROM grid g JOIN cover USING (y, x) LEFT JOIN sums s ON s.t = g.t AND s.y = g.y AND s.x = g.x) SELECT t, y, x, round(CASE WHEN value < 60 THEN 0 ELSE value END, 6) AS value FROM r", "t")
def _(spark, d):
    window = _holes(spark, d).where(select.time_window("2024-01-05", "2024-01-20"))
    scaled = window.withColumn("v", transforms.decode(F.col("v"), transforms.Transform(scale=0.01), "int64"))
    out = regrid.regrid(scaled, SOURCE, _targets(2.5), "conservative_normed")
    return out.withColumn("value", F.round(rules.apply_rules(F.col("value"), T.DoubleType(), rules.parse_rules("<60", "0")), 6))


# --- layout, catalogue, tuning ------------------------------------------------------------------


def _indexed(cells: DataFrame) -> DataFrame:
    return cells.withColumn("ti", F.datediff("t", F.lit("2024-01-01").cast("date")))


@query("rechunk_summary", f"WITH {CUBE} SELECT CAST(date_diff('day', DATE '2024-01-01', t) // 8 AS INTEGER) AS ct, CAST(y // 4 AS INTEGER) AS cy, CAST(x // 4 AS INTEGER) AS cx, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM cube GROUP BY 1, 2, 3")
def _(spark, d):
    plan = layout.plan_chunks((30, 6, 10), 8, "custom", custom=(8, 4, 4))
    return layout.laid_out(_indexed(C.event_cube(spark, d)), plan).groupBy("ct", "cy", "cx").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("chunk_pack", f"WITH {DENSE}, k AS (SELECT CAST(date_diff('day', DATE '2024-01-01', t) AS INTEGER) AS ti, y, x, v FROM dense) SELECT CAST(ti // 7 AS INTEGER) AS ct, CAST(y // 4 AS INTEGER) AS cy, CAST(x // 3 AS INTEGER) AS cx, [CAST(least(7, 30 - min(ti) // 7 * 7) AS INTEGER), CAST(least(4, 6 - min(y) // 4 * 4) AS INTEGER), CAST(least(3, 10 - min(x) // 3 * 3) AS INTEGER)] AS shape, list(v ORDER BY ti, y, x) AS data FROM k GROUP BY 1, 2, 3")
def _(spark, d):
    plan = layout.plan_chunks((30, 6, 10), 8, "custom", custom=(7, 4, 3))
    return layout.pack(_indexed(_dense(spark, d)), plan, (30, 6, 10))


@query("chunk_round_trip", f"WITH {CUBE} SELECT CAST(date_diff('day', DATE '2024-01-01', t) AS INTEGER) AS ti, y, x, v FROM cube")
def _(spark, d):
    shape = (30, 6, 10)
    first, second = (layout.plan_chunks(shape, 8, "custom", custom=c) for c in ((7, 4, 3), (30, 2, 5)))
    packed = layout.pack(_indexed(C.event_cube(spark, d)), first, shape)
    return layout.unpack(layout.rechunk(packed, first, second, shape), second).where("v is not null")


@query("pareto_front", "WITH b AS (SELECT p_brand AS brand, avg(p_retailprice) AS price, avg(p_size) AS size FROM part GROUP BY 1) SELECT brand, round(price, 6) AS price, round(size, 6) AS size FROM b a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.brand <> a.brand AND b.price <= a.price AND b.size >= a.size AND (b.price < a.price OR b.size > a.size))")
def _(spark, d):
    brands = spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_brand").alias("brand")).agg(F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size"))
    return layout.pareto_front(brands, "brand", ["size"], ["price"]).select("brand", F.round("price", 6).alias("price"), F.round("size", 6).alias("size"))


TRIALS = """trials AS (SELECT n_nationkey AS candidate, 100.0 + n_nationkey * 7 AS write, 90.0 + n_nationkey * 5 AS durable, 300.0 - n_nationkey * 3 AS read,
  1000.0 + (n_nationkey * 37) % 400 AS bytes, 1.0 + (n_nationkey * 11) % 5 AS cpu, 50.0 + (n_nationkey * 13) % 17 AS rss, n_nationkey % 6 <> 0 AS verified, n_nationkey < 20 AS feasible FROM nation)"""


def _trials(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return spark.read.parquet(f"{d}/nation.parquet").select(
        k.cast("int").alias("candidate"),
        (100.0 + k * 7).alias("write"),
        (90.0 + k * 5).alias("durable"),
        (300.0 - k * 3).alias("read"),
        (1000.0 + (k * 37) % 400).alias("bytes"),
        (1.0 + (k * 11) % 5).alias("cpu"),
        (50.0 + (k * 13) % 17).alias("rss"),
        (k % 6 != 0).alias("verified"),
        (k < 20).alias("feasible"),
    )


@query("log_score", f"WITH {TRIALS}, b AS (SELECT * FROM trials WHERE candidate = 1) SELECT t.candidate, round(0.18 * ln(t.write / b.write) + 0.17 * ln(t.durable / b.durable) + 0.25 * ln(t.read / b.read) + 0.30 * ln(b.bytes / t.bytes) + 0.06 * ln(b.cpu / t.cpu) + 0.04 * ln(b.rss / t.rss), 6) AS score FROM trials t, b")
def _(spark, d):
    trials = _trials(spark, d)
    return layout.log_score(trials, trials.where("candidate = 1"), layout.OBJECTIVES["balanced"]).select("candidate", F.round("score", 6).alias("score"))


@query("codec_choice", f"WITH {TRIALS}, v AS (SELECT * FROM trials WHERE verified AND feasible), b AS (SELECT * FROM trials WHERE candidate = 1), f AS (SELECT * FROM v a WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.candidate <> a.candidate AND o.write >= a.write AND o.durable >= a.durable AND o.read >= a.read AND o.bytes <= a.bytes AND o.cpu <= a.cpu AND o.rss <= a.rss AND (o.write > a.write OR o.durable > a.durable OR o.read > a.read OR o.bytes < a.bytes OR o.cpu < a.cpu OR o.rss < a.rss))) SELECT f.candidate FROM f, b ORDER BY 0.08 * ln(f.write / b.write) + 0.07 * ln(f.durable / b.durable) + 0.15 * ln(f.read / b.read) + 0.58 * ln(b.bytes / f.bytes) + 0.07 * ln(b.cpu / f.cpu) + 0.05 * ln(b.rss / f.rss) DESC, f.bytes, f.candidate LIMIT 1")
def _(spark, d):
    trials = _trials(spark, d)
    return layout.select_trial(trials, trials.where("candidate = 1"), "compact").select("candidate")


@query("first_common", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, min(event_id) LIMIT 1")
def _(spark, d):
    return layout.first_common(spark.read.parquet(f"{d}/events.parquet").withColumnRenamed("event_type", "kind"), "kind", "event_id")


@query("incremental_scan", "SELECT event_id AS path, CAST(length(props) AS BIGINT) AS size FROM events WHERE event_id % 10 = 3 OR ts >= TIMESTAMP '2024-01-20'")
def _(spark, d):
    listing = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("path"), F.length("props").cast("bigint").alias("size"), F.col("ts").alias("mtime"))
    known = listing.where("mtime < timestamp'2024-01-20'").withColumn("size", F.when(F.col("path") % 10 == 3, F.col("size") + 1).otherwise(F.col("size")))
    return catalog.split_changes(listing, known)[0].select("path", "size")


@query("refreshed_catalogue", "SELECT event_id AS path, CAST(length(props) AS BIGINT) AS size, event_id % 10 = 3 OR ts >= TIMESTAMP '2024-01-20' AS scanned FROM events")
def _(spark, d):
    listing = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("path"), F.length("props").cast("bigint").alias("size"), F.col("ts").alias("mtime"))
    known = listing.where("mtime < timestamp'2024-01-20'").withColumn("size", F.when(F.col("path") % 10 == 3, F.col("size") + 1).otherwise(F.col("size")))
    new, reused = catalog.split_changes(listing, known)
    return catalog.refreshed(new.withColumn("scanned", F.lit(True)), reused.withColumn("scanned", F.lit(False))).drop("mtime")


@query("workload_class", "SELECT count(*) AS n_files, CAST(sum(length(text)) AS BIGINT) AS total_bytes, quantile_cont(length(text), 0.5) AS median_bytes, quantile_cont(length(text), 0.9) AS p90_bytes, CASE WHEN count(*) >= 1000 AND quantile_cont(length(text), 0.5) < 16777216 THEN 'many-small' ELSE 'balanced' END AS kind FROM documents")
def _(spark, d):
    return catalog.workload(spark.read.parquet(f"{d}/documents.parquet").select(F.length("text").alias("size")))


@query("times_per_file", "SELECT n_times, count(*) AS n_files FROM (SELECT user_id, count(*) AS n_times FROM events GROUP BY 1) GROUP BY 1")
def _(spark, d):
    return catalog.times_per_file(spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("path")))


@query("signature_check", "SELECT l_linestatus || l_returnflag AS path, 'l' || l_linenumber AS name, '{\"kind\":\"' || CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'int' ELSE 'float' END || '\"}' AS signature, '{\"kind\":\"float\"}' AS expected FROM (SELECT DISTINCT l_linestatus, l_returnflag, l_linenumber FROM lineitem) WHERE l_linenumber = 7 AND l_returnflag = 'R'")
def _(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_linestatus", "l_returnflag", "l_linenumber").distinct()
    odd = (F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R")
    variables = lines.select(F.concat("l_linestatus", "l_returnflag").alias("path"), F.concat(F.lit("l"), F.col("l_linenumber")).alias("name"), F.when(odd, "int").otherwise("float").alias("kind"))
    return catalog.signature_mismatches(variables)


@query("validate_sample", f"WITH {CUBE} SELECT t, y, x, CAST(v + 1 AS BIGINT) AS left_value, v AS right_value FROM cube WHERE y = 3 AND x = 3", "t")
def _(spark, d):
    cells = C.event_cube(spark, d)
    damaged = cells.withColumn("v", F.when((F.col("y") == 3) & (F.col("x") == 3), F.col("v") + 1).otherwise(F.col("v")))
    return validate.mismatches(damaged, cells, ["t", "y", "x"], "v")


@query("cf_references", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'area: cells' ELSE NULL END AS cell_measures, CASE WHEN event_id % 2 = 0 THEN 'lat lon' ELSE 'lon' END AS coordinates FROM events")
def _(spark, d):
    k = F.col("event_id")
    attrs = F.create_map(
        F.lit("cell_measures"), F.when(k % 3 == 0, "area: areacella volume: gone").otherwise("area areacella"),
        F.lit("coordinates"), F.when(k % 2 == 0, "lat lon lat height").otherwise("height longitude"),
        F.lit("grid_mapping"), F.lit("crs extra"),
    )
    out = spark.read.parquet(f"{d}/events.parquet").select("event_id", attributes.sanitised(attrs, ["lat", "lon", "cells"], {"areacella": "cells", "longitude": "lon"}).alias("a"))
    return out.select("event_id", F.element_at("a", F.lit("cell_measures")).alias("cell_measures"), F.element_at("a", F.lit("coordinates")).alias("coordinates"))


@query("swath_bounds", "SELECT n_nationkey, CAST(-180 + n_nationkey AS DOUBLE) AS west, CAST(90 - n_nationkey AS DOUBLE) AS north FROM nation")
def _(spark, d):
    k = F.col("n_nationkey")
    text = F.format_string("XDim=10\nUpperLeftPointMtrs=(%d.000000,%d.000000)\nLowerRightMtrs=(180.0,-90.0)", (k - 180) * F.when(k % 2 == 0, 1000000).otherwise(1).cast("bigint"), (90 - k) * F.when(k % 2 == 0, 1000000).otherwise(1).cast("bigint"))
    corner = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", attributes.swath_corner(text, "UpperLeftPointMtrs").alias("c"))
    return corner.select("n_nationkey", F.get("c", F.lit(0)).alias("west"), F.get("c", F.lit(1)).alias("north"))


@query("probe_cells", f"WITH {DENSE}, n AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS ti, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM dense)), p AS (SELECT DISTINCT CAST(round_even(k * (n - 1) / 2.0, 0) AS BIGINT) AS ti FROM n, generate_series(0, 2) g(k)) SELECT CAST(ti AS INTEGER) AS ti, y, x, v FROM p JOIN n USING (ti) JOIN dense d ON d.t = n.t AND d.y = (ti * 104729 + 1) % 6 AND d.x = (ti * 130363 + 3) % 10")
def _(spark, d):
    cells = pipeline.with_time_index(_dense(spark, d))
    probes = validate.probe_cells(spark, (cells.select("ti").distinct().count(), 6, 10)).withColumnRenamed("t", "ti")
    return cells.join(F.broadcast(probes), ["ti", "y", "x"]).select("ti", "y", "x", "v")


@query("chunk_plan_maps", "SELECT CAST(k AS INTEGER) AS k, CAST(max(s) AS INTEGER) AS ct FROM (SELECT n_nationkey AS k FROM nation), generate_series(1, 365) g(s) WHERE (s < 8 OR s % 4 = 0 OR s = 365) AND s * (100 + 20 * k) * (200 + 40 * k) * 8 <= 134217728 GROUP BY k")
def _(spark, d):
    rows = [(k, layout.plan_chunks((365, 100 + 20 * k, 200 + 40 * k), 8, "space").chunks[0]) for k in _nations(spark, d)]
    return spark.createDataFrame(rows, "k int, ct int")


@query("gcd_chunk", "SELECT CAST(max(g) AS INTEGER) AS chunk FROM generate_series(1, 1000) s(g) WHERE NOT EXISTS (SELECT 1 FROM part WHERE (p_size * 6) % g <> 0)")
def _(spark, d):
    sizes = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_size") * 6).alias("n")).distinct().collect()  # as many as there are variables' chunk sizes
    return spark.createDataFrame([(layout.gcd_chunk(r.n for r in sizes),)], "chunk int")


@query("even_pick", f"WITH {CUBE}, r AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS p FROM (SELECT DISTINCT t FROM cube)) SELECT t FROM r, (SELECT count(*) AS n FROM r) WHERE p IN (SELECT CAST(round_even(k * (n - 1) / 4.0, 0) AS BIGINT) FROM generate_series(0, 4) g(k))", "t")
def _(spark, d):
    times = C.event_cube(spark, d).select("t").distinct().withColumn("p", F.row_number().over(Window.orderBy("t")) - 1)
    return times.where(F.col("p").isin(*[p for p in axes.spread_positions(times.count(), 5)])).select("t")


@query("newest_manifest", "SELECT user_id, arg_max(event_id, struct_pack(ts := ts, e := event_id)) AS event_id FROM events GROUP BY 1")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("event_log_json", "SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.page").alias("page"))


@query("throughput", f"WITH {CUBE} SELECT t, count(*) * 8 AS logical_bytes, round(count(*) * 8 / 1048576.0, 9) AS mib FROM cube GROUP BY t", "t")
def _(spark, d):
    daily = C.event_cube(spark, d).groupBy("t").agg((F.count("*") * 8).alias("logical_bytes"))
    return daily.withColumn("mib", F.round(F.col("logical_bytes") / 1048576.0, 9))
