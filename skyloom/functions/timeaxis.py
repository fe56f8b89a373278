"""Time axes from file names and coordinates: fields, rules, cadence, calendars, gaps.

File names and dates are rows; parsing, checking and completing them are plans.
Only the handful of character positions that a name template has is handled on
the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class TimeAxisError(ValueError):
    """Names or coordinates that do not give one daily axis."""


@dataclass(frozen=True)
class NameField:
    """A run of digits at the same place of every name."""

    start: int
    length: int
    sample: str
    changes: bool


def name_fields(names: Sequence[str]) -> list[NameField]:
    """Digit runs of the first name that are digits in all names."""
    out = []
    for run in re.finditer(r"\d+", names[0]) if names else ():
        parts = [n[run.start() : run.end()] for n in names]
        if all(len(p) == run.end() - run.start() and p.isdigit() for p in parts):
            out.append(NameField(run.start(), run.end() - run.start(), run[0], len(set(parts)) > 1))
    return out


def field_parts(text: str) -> tuple[str, ...]:
    """What a digit run can stand for."""
    if len(text) == 7 and _date_of("doy", text):
        return ("full", "year", "doy")
    if len(text) == 8 and _date_of("ymd", text):
        return ("full", "year", "month", "day")
    if len(text) == 4:
        return ("year",)
    if len(text) == 3 and 1 <= int(text) <= 366:
        return ("doy",)
    return ()


def _date_of(template: str, text: str) -> date | None:
    try:
        if template == "ymd":
            return date(int(text[:4]), int(text[4:6]), int(text[6:]))
        day = date.fromordinal(date(int(text[:4]), 1, 1).toordinal() + int(text[4:]) - 1)
        return day if day.year == int(text[:4]) and int(text[4:]) > 0 else None
    except ValueError:
        return None


@dataclass(frozen=True)
class NameRule:
    """Place and template of the date in every name."""

    template: str
    start: int
    length: int


def automatic_rule(names: Sequence[str]) -> NameRule:
    """The one digit run that is a date in every name and explains all differences.

    The names must have one length and one suffix; the run must not occur twice in
    a name, and its dates must differ.
    """
    if not names or len({len(n) for n in names}) > 1 or len({n.rpartition(".")[2].lower() for n in names}) > 1:
        raise TimeAxisError("names must have one length and one suffix")
    differing = [i for i, letters in enumerate(zip(*names, strict=True)) if len(set(letters)) > 1]
    found = []
    for f in name_fields(names):
        template = {7: "doy", 8: "ymd"}.get(f.length)
        if template is None or not differing or differing[0] < f.start or differing[-1] >= f.start + f.length:
            continue
        texts = [n[f.start : f.start + f.length] for n in names]
        dates = [_date_of(template, t) for t in texts]
        if None not in dates and len(set(dates)) == len(names) and all(n.count(t) == 1 for n, t in zip(names, texts, strict=True)):
            found.append(NameRule(template, f.start, f.length))
    if len(found) != 1:
        raise TimeAxisError(f"{len(found)} digit runs could be the date")
    return found[0]


def manual_rule(sample: str, target: str) -> NameRule:
    """The place of a text that occurs once in the sample."""
    if sample.count(target) != 1 or len(target) not in (7, 8) or not target.isdigit():
        raise TimeAxisError("the date must be 7 or 8 digits that occur once in the sample")
    return NameRule("doy" if len(target) == 7 else "ymd", sample.index(target), len(target))


def named_date(name: Column, rule: NameRule) -> Column:
    """Date of each name under a rule; NULL where it is none."""
    return F.try_to_date(F.substring(name, rule.start + 1, rule.length), "yyyyDDD" if rule.template == "doy" else "yyyyMMdd")


@dataclass(frozen=True)
class TimeRule:
    """Where year, month, day, day of year or the whole date come from: ``name:<start>:<length>`` or ``time``."""

    sources: dict[str, str] = field(default_factory=dict)

    def check(self) -> None:
        parts = set(self.sources)
        if unknown := parts - {"full", "year", "month", "day", "doy"}:
            raise TimeAxisError(f"unknown parts: {sorted(unknown)}")
        if "full" in parts:
            if len(parts) > 1:
                raise TimeAxisError("a whole date excludes parts")
        elif "year" not in parts or ("doy" in parts) == ({"month", "day"} <= parts) or ("doy" in parts and parts & {"month", "day"}) or len(parts & {"month", "day"}) == 1:
            raise TimeAxisError("a year needs either a day of year or a month and a day")

    def column(self, name: Column, coordinate: Column | None = None) -> Column:
        """Date from the name and the file's own time coordinate (a date or a number)."""
        self.check()

        def part(source: str) -> Column:
            if source == "time":
                return coordinate
            start, length = map(int, source.split(":")[1:])
            return F.substring(name, start + 1, length)

        if "full" in self.sources:
            text = part(self.sources["full"])
            if self.sources["full"] == "time":
                return text.cast("date")
            return F.coalesce(F.try_to_date(text, "yyyyMMdd"), F.try_to_date(text, "yyyyDDD"))
        number = {k: part(v).cast("int") for k, v in self.sources.items()}
        if "doy" in number:
            day = F.date_add(F.make_date(number["year"], F.lit(1), F.lit(1)), number["doy"] - 1)
            return F.when((number["doy"] >= 1) & (F.year(day) == number["year"]), day)
        return F.try_to_date(F.concat(F.lpad(number["year"].cast("string"), 4, "0"), F.lpad(number["month"].cast("string"), 2, "0"), F.lpad(number["day"].cast("string"), 2, "0")), "yyyyMMdd")


def suggest_rule(fields: Sequence[NameField], time_kind: str | None) -> TimeRule | None:
    """A whole date from the coordinate, else the only one in the name, else a year and the coordinate's day of year."""
    if time_kind == "full":
        return TimeRule({"full": "time"})
    place = lambda f: f"name:{f.start}:{f.length}"
    whole = [f for f in fields if "full" in field_parts(f.sample)]
    if time_kind is None:
        return TimeRule({"full": place(whole[0])}) if len(whole) == 1 else None
    years = [f for f in fields if field_parts(f.sample) == ("year",)]
    if time_kind == "doy" and len(years) == 1:
        return TimeRule({"year": place(years[0]), "doy": "time"})
    return None


STANDARD_CALENDARS = ("standard", "gregorian", "proleptic_gregorian")


def decoded_time(value: Column, units: str, calendar: str = "standard") -> Column:
    """Date from a number and ``<unit> since <origin>`` in the standard calendar, whatever the session's time zone."""
    found = re.fullmatch(r"\s*(day|hour|minute|second)s?\s+since\s+(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.\d*)?)?)?\s*(?:Z|UTC)?\s*", units)
    if found is None:
        raise TimeAxisError(f"{units!r} is not a unit since an origin")
    if calendar not in STANDARD_CALENDARS:
        raise TimeAxisError(f"dates of the calendar {calendar!r} are not decoded")
    seconds = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[found[1]]
    clock = sum(int(part or 0) * unit for part, unit in zip(found.groups()[4:], (3600, 60, 1), strict=True))
    origin = F.make_date(*[F.lit(int(part)) for part in found.groups()[1:4]])
    return F.date_add(origin, F.floor((value * seconds + clock) / 86400).cast("int"))


def time_kind(units: str | None, values: Sequence[float] = ()) -> str | None:
    """What a file's own time coordinate tells: ``full`` dates, a day of year (``doy``), a bare ``number``, or nothing."""
    if units is None and not len(values):
        return None
    text = (units or "").strip().lower()
    if " since " in text:
        return "full"
    if text in ("doy", "day", "days", "day of year") and all(1 <= v <= 366 for v in values):
        return "doy"
    return "number"


def duplicate_dates(files: DataFrame, time: str = "t", path: str = "path") -> DataFrame:
    """Dates that several files claim, with the files."""
    grouped = files.groupBy(time).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(path)).alias("paths"))
    return grouped.where(F.col("n") > 1)


def _step(days: list[int]) -> int:
    """Greatest common divisor of the differences if over 1, else the most common, first seen first."""
    gaps = [b - a for a, b in zip(days, days[1:], strict=False) if b > a]
    if not gaps:
        return 1
    common = math.gcd(*gaps)
    return common if common > 1 else max(dict.fromkeys(gaps), key=gaps.count)


def annual_steps(dates: DataFrame, time: str = "t") -> DataFrame:
    """``year, first_doy, last_doy, n, step`` of each observed year.

    A year with a single date takes the step most years have.
    """
    by_year = dates.select(F.year(time).alias("year"), F.dayofyear(time).alias("doy")).distinct().groupBy("year").agg(F.sort_array(F.collect_list("doy")).alias("doys"))
    gaps = F.transform(F.slice("doys", 2, F.greatest(F.size("doys") - 1, F.lit(0))), lambda d, i: d - F.get("doys", i))
    rows = by_year.withColumn("gaps", gaps)
    divisor = F.aggregate("gaps", F.lit(0), _gcd_step)
    often = F.aggregate(F.array_distinct("gaps"), F.struct(F.lit(0).alias("n"), F.lit(1).alias("g")), lambda best, g: F.when(F.size(F.filter("gaps", lambda x: x == g)) > best["n"], F.struct(F.size(F.filter("gaps", lambda x: x == g)).alias("n"), g.alias("g"))).otherwise(best))
    rows = rows.withColumn("divisor", divisor).withColumn("often", often["g"])
    own = F.when(F.size("gaps") > 0, F.when(F.col("divisor") > 1, F.col("divisor")).otherwise(F.col("often")))
    steps = rows.select("year", F.get("doys", F.lit(0)).alias("first_doy"), F.element_at("doys", -1).alias("last_doy"), F.size("doys").alias("n"), own.alias("own"))
    usual = steps.where(F.col("own").isNotNull()).groupBy("own").agg(F.count("*").alias("k"), F.min("year").alias("y")).agg(F.max_by("own", F.struct("k", -F.col("y"))).alias("usual"))
    return steps.crossJoin(F.broadcast(usual)).select("year", "first_doy", "last_doy", "n", F.coalesce("own", "usual", F.lit(1)).cast("int").alias("step"))


def _gcd_step(a: Column, b: Column) -> Column:
    """Greatest common divisor of two numbers up to 366: Euclid's steps as a fold."""
    state = F.struct(a.alias("a"), b.alias("b"))
    rounds = F.sequence(F.lit(1), F.lit(14))  # enough below 377 * 610
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.greatest(s["b"], F.lit(1))).alias("b")))
    return F.aggregate(rounds, state, step)["a"]


def annual_calendar(dates: DataFrame, time: str = "t") -> DataFrame:
    """Expected dates of a schedule that restarts every year.

    Years between the first and the last are complete from their first observed
    day (or the earliest day of any year); the outer years keep to what was seen.
    """
    observed = annual_steps(dates, time)
    span = observed.agg(F.min("year").alias("y0"), F.max("year").alias("y1"), F.min("first_doy").alias("d0"))
    usual = observed.groupBy("step").agg(F.count("*").alias("k"), F.min("year").alias("y")).agg(F.max_by("step", F.struct("k", -F.col("y"))).alias("usual"))
    years = span.crossJoin(usual).select("*", F.explode(F.sequence("y0", "y1")).alias("year"))
    joined = years.join(F.broadcast(observed), "year", "left")
    january = F.make_date("year", F.lit(1), F.lit(1))
    start = F.date_add(january, F.coalesce("first_doy", "d0") - 1)
    full = F.make_date("year", F.lit(12), F.lit(31))
    outer = (F.col("year") == F.col("y0")) | (F.col("year") == F.col("y1"))
    end = F.when(outer, F.date_add(january, F.col("last_doy") - 1)).otherwise(full)
    days = F.make_interval(days=F.coalesce("step", "usual"))
    return joined.where(start <= end).select(F.explode(F.sequence(start, end, days)).alias(time))


def daily_calendar(dates: DataFrame, step: int = 1, time: str = "t") -> DataFrame:
    """Every ``step`` days from the first to the last date."""
    if step < 1:
        raise TimeAxisError("the step is a positive number of days")
    ends = dates.agg(F.min(time).alias("a"), F.max(time).alias("b")).where(F.col("a").isNotNull())
    return ends.select(F.explode(F.sequence("a", "b", F.make_interval(days=F.lit(step)))).alias(time))


def missing_dates(expected: DataFrame, dates: DataFrame, time: str = "t") -> DataFrame:
    """Expected dates that no file has."""
    return expected.join(dates.select(time).distinct(), time, "left_anti")


def gaps(dates: DataFrame, time: str = "t") -> DataFrame:
    """Places where the axis skips days: last date before, first after, days missing.

    An axis is as long as the product has dates, so one ordered pass suffices.
    """
    lagged = dates.select(time).distinct().withColumn("before", F.lag(time).over(Window.orderBy(time)))
    return lagged.where(F.datediff(time, "before") > 1).select("before", F.col(time).alias("after"), (F.datediff(time, "before") - 1).alias("missing"))


def cadence(dates: DataFrame, time: str = "t") -> DataFrame:
    """Smallest step, how many steps exceed half again of it by whole multiples, and dates missing there."""
    lagged = dates.select(time).distinct().withColumn("step", F.datediff(time, F.lag(time).over(Window.orderBy(time)))).where("step is not null")
    least = lagged.agg(F.min("step").alias("least"))
    ratio = F.col("step") / F.col("least")
    long = (ratio > 1.5) & (ratio == F.round(ratio))
    return lagged.crossJoin(F.broadcast(least)).agg(F.min("least").cast("int").alias("step_days"), F.count_if(long).alias("n_gaps"), F.coalesce(F.sum(F.when(long, F.round(ratio) - 1)), F.lit(0)).cast("bigint").alias("n_missing"))


def islands(rows: DataFrame, key: Sequence[str], index: str) -> DataFrame:
    """Runs of consecutive indices within a key: first, last and length."""
    numbered = rows.withColumn("x_run", F.col(index) - F.row_number().over(Window.partitionBy(*key).orderBy(index)))
    return numbered.groupBy(*key, "x_run").agg(F.min(index).alias("first_index"), F.max(index).alias("last_index"), F.count("*").alias("n")).drop("x_run")


def date_islands(dates: DataFrame, time: str = "t") -> DataFrame:
    """Runs of consecutive days: first, last and length."""
    numbered = dates.select(time).distinct().withColumn("x_run", F.date_sub(time, F.row_number().over(Window.orderBy(time))))
    return numbered.groupBy("x_run").agg(F.min(time).alias("first_day"), F.max(time).alias("last_day"), F.count("*").alias("n")).drop("x_run")


def sub_daily(stamps: DataFrame, stamp: str = "ts", path: str = "path") -> DataFrame:
    """Files with two stamps on one date, which daily axes refuse."""
    return stamps.groupBy(path, F.to_date(stamp).alias("t")).agg(F.count("*").alias("n")).where("n > 1")


def calendar_frame(spark: SparkSession, dates: Sequence[date], time: str = "t") -> DataFrame:
    """A time axis from known dates."""
    return spark.createDataFrame([(d,) for d in dates], f"{time} date")
