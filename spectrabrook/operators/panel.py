"""Intraday panels: changes, runs, calibration, profiles, windows and rolling plans.

A panel is long: day_index, phase, second, spread, where a missing spread is
null. Phases never overlap and no change crosses from one into the other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Phase:
    name: str
    start: int
    stop: int


# The trading day as one-second positions.
DAY = (Phase("am", 0, 7200), Phase("pm", 7200, 14220))

# Event, clock label, phase and seconds since the phase began.
ORIGINS = (
    ("opening", "09:31", "am", 60),
    ("opening", "09:35", "am", 300),
    ("pre_lunch", "11:25", "am", 6900),
    ("pre_lunch", "11:29", "am", 7140),
    ("reopening", "13:01", "pm", 60),
    ("reopening", "13:05", "pm", 300),
    ("end_of_grid", "14:52", "pm", 6720),
    ("end_of_grid", "14:56", "pm", 6960),
)


def phase_of(second: Column, phases: Sequence[Phase] = DAY) -> Column:
    out = F.lit(None).cast("string")
    for p in phases:
        out = F.when((second >= p.start) & (second < p.stop), p.name).otherwise(out)
    return out


def null_missing(panel: DataFrame, value: str = "spread") -> DataFrame:
    """NaN as null, for aggregates skip nulls and take NaN for a value."""
    return panel.withColumn(value, F.when(~F.isnan(value), F.col(value)))


def changes(panel: DataFrame, value: str = "spread") -> DataFrame:
    """One-second log changes within day and phase; null where either end is missing or a second is absent."""
    w = Window.partitionBy("day_index", "phase").orderBy("second")
    step = F.when(F.lag("second").over(w) == F.col("second") - 1, F.log(value) - F.log(F.lag(value).over(w)))
    return panel.withColumn("change", step)


def observed_changes(panel: DataFrame, value: str = "spread", keep: Sequence[str] | None = None) -> DataFrame:
    """Changes between observed points, across gaps, with what each crosses: none, gap, lunch or date.

    keep names the crossings to keep, the rest are excluded; by default all stay,
    the first point of the table too, which has no change.

    The last point of every phase and day is found by aggregates, so that days
    are ordered among themselves only by their one row each.
    """
    seen = panel.filter(F.col(value).isNotNull())
    inside = Window.partitionBy("day_index", "phase").orderBy("second")
    ends = seen.groupBy("day_index", "phase").agg(F.max_by(value, "second").alias("last_value"), F.min("second").alias("first_second"))
    across = Window.orderBy("day_index", "first_second")
    before = ends.select("day_index", "phase", F.lag("last_value").over(across).alias("prior_value"), F.lag("day_index").over(across).alias("prior_day"))
    rows = seen.withColumn("prev", F.lag(value).over(inside)).withColumn("prev_second", F.lag("second").over(inside)).join(before, ["day_index", "phase"])
    kind = (
        F.when(F.col("prev").isNotNull(), F.when(F.col("second") - F.col("prev_second") == 1, "none").otherwise("gap"))
        .when(F.col("prior_day").isNull(), "start")
        .when(F.col("prior_day") != F.col("day_index"), "date")
        .otherwise("lunch")
    )
    change = F.log(value) - F.log(F.coalesce("prev", "prior_value"))
    found = rows.select("day_index", "phase", "second", change.alias("change"), kind.alias("boundary"))
    return found if keep is None else found.filter(F.col("boundary").isin(list(keep)))


def runs(panel: DataFrame, value: str = "spread") -> DataFrame:
    """Contiguous runs of observed seconds: day_index, phase, start, stop (exclusive), n."""
    w = Window.partitionBy("day_index", "phase").orderBy("second")
    island = F.col("second") - F.row_number().over(w)
    seen = panel.filter(F.col(value).isNotNull()).withColumn("island", island)
    return seen.groupBy("day_index", "phase", "island").agg(F.min("second").alias("start"), (F.max("second") + 1).alias("stop"), F.count(F.lit(1)).alias("n")).drop("island")


def daily_changes(run_rows: DataFrame, days: int) -> DataFrame:
    """Changes of each of days 0 to days - 1, the sum of n - 1 over its runs; days without runs have 0, runs of other days are refused."""
    n = run_rows.groupBy("day_index").agg(F.sum(F.col("n") - 1).alias("changes"))
    inside = (F.col("day_index") >= 0) & (F.col("day_index") < days)
    n = n.filter(F.when(inside, True).otherwise(F.raise_error(F.concat(F.lit(f"a run outside the calendar of {days} days: day "), F.col("day_index"))).cast("boolean")))
    grid = run_rows.sparkSession.range(days).select(F.col("id").cast("int").alias("day_index"))
    return grid.join(n, "day_index", "left").fillna(0, ["changes"])


def training_counts(daily: DataFrame) -> DataFrame:
    """Changes of strictly earlier days, and the same made even. One row a day: the single window is as long as the calendar."""
    w = Window.orderBy("day_index").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.coalesce(F.sum("changes").over(w), F.lit(0))
    return daily.withColumn("train_changes", prior).withColumn("train_fft_observations", F.col("train_changes") - F.pmod("train_changes", F.lit(2)))


def calibration(panel: DataFrame, least_pairs: int = 3, value: str = "spread") -> DataFrame:
    """Mean and population sd of changes at each clock second, the sd floored at 5% of its phase's median.

    phase, second, pairs, mean, sd, scale, ok (pairs reach least_pairs).
    """
    stats = changes(panel, value).filter(F.col("change").isNotNull()).groupBy("phase", "second").agg(F.count("change").alias("pairs"), F.avg("change").alias("mean"), F.stddev_pop("change").alias("sd"))
    floor = stats.groupBy("phase").agg(F.greatest(F.lit(1e-6), 0.05 * F.percentile("sd", F.lit(0.5))).alias("floor"))
    return stats.join(F.broadcast(floor), "phase").select("phase", "second", "pairs", "mean", "sd", F.greatest("sd", "floor").alias("scale"), (F.col("pairs") >= least_pairs).alias("ok"))


def clock_profile(panel: DataFrame, value: str = "spread") -> DataFrame:
    """Log level by clock second: the mean first level of a phase plus the running sum of mean changes."""
    mean = changes(panel, value).groupBy("phase", "second").agg(F.avg("change").alias("mean"), F.avg(F.log(value)).alias("level"))
    w = Window.partitionBy("phase").orderBy("second")
    base = F.first("level").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return mean.select("phase", "second", (base + F.sum(F.coalesce("mean", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("profile"))


def standardised(panel: DataFrame, table: DataFrame, value: str = "spread") -> DataFrame:
    """Changes less their clock mean, divided by their clock scale; table is calibration()'s, one row a second."""
    rows = changes(panel, value).filter(F.col("change").isNotNull())
    return rows.join(F.broadcast(table.select("phase", "second", "mean", "scale")), ["phase", "second"]).withColumn("z", (F.col("change") - F.col("mean")) / F.col("scale"))


def folded_profile(panel: DataFrame, period: int = 60, phases: Sequence[Phase] = DAY, value: str = "spread") -> DataFrame:
    """Mean change at each position of a period since the phase began, less the mean over positions."""
    start = F.lit(0)
    for p in phases:
        start = F.when(F.col("phase") == p.name, p.start).otherwise(start)
    at = F.pmod(F.col("second") - start, F.lit(period)).cast("int")
    mean = changes(panel, value).filter(F.col("change").isNotNull()).groupBy("phase", at.alias("position")).agg(F.avg("change").alias("mean"))
    return mean.withColumn("mean", F.col("mean") - F.avg("mean").over(Window.partitionBy("phase")))


def intraday_profile(panel: DataFrame, bin_seconds: int = 60, least_coverage: float = 0.95, day_seconds: int = 14_220, value: str = "spread") -> DataFrame:
    """Quartiles over days of bin means divided by the day's mean, for days with enough observed seconds."""
    day = Window.partitionBy("day_index")
    rows = panel.filter(F.col(value).isNotNull()).withColumn("day_mean", F.avg(value).over(day)).withColumn("held", F.count(value).over(day))
    good = rows.filter(F.col("held") >= least_coverage * day_seconds)
    bins = good.groupBy("day_index", F.floor(F.col("second") / bin_seconds).cast("int").alias("bin")).agg((F.avg(value) / F.first("day_mean")).alias("level"))
    return bins.groupBy("bin").agg(F.count(F.lit(1)).alias("days"), *[F.percentile("level", F.lit(p)).alias(n) for p, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))])


def boundary_windows(panel: DataFrame, windows: dict[str, tuple[int, int]], least_coverage: float = 0.95, value: str = "spread") -> DataFrame:
    """A day's mean in each named window, null below the coverage; one pass for all windows."""
    parts = []
    for name, (lo, hi) in windows.items():
        inside = (F.col("second") >= lo) & (F.col("second") < hi)
        held = F.count(F.when(inside, F.col(value)))
        parts.append(F.when(held >= least_coverage * (hi - lo), F.avg(F.when(inside, F.col(value)))).alias(name))
    return panel.groupBy("day_index").agg(*parts)


def boundary_ratios(windows: DataFrame, opening: str = "opening", closing: str = "closing") -> DataFrame:
    """day_index, within (log of a day's closing over its opening window) and overnight (log of its opening over the closing of the day before).

    windows is boundary_windows()'s, one row a day; a ratio without both its
    windows is null, and overnight pairs days that follow each other in the table.
    """
    prior = F.lag(closing).over(Window.orderBy("day_index"))
    return windows.select("day_index", F.log(F.col(closing) / F.col(opening)).alias("within"), F.log(F.col(opening) / prior).alias("overnight"))


def binned_level(panel: DataFrame, width: int = 300, phases: Sequence[Phase] = DAY, value: str = "spread") -> DataFrame:
    """Clock profile from bin means of logs, linear between bin centres and flat beyond the outer ones.

    phase, second, profile. Each second meets the two bins next to it by equi-joins on small tables.
    """
    spark = panel.sparkSession
    bounds = spark.createDataFrame([(p.name, p.start, p.stop) for p in phases], "phase string, lo int, hi int")
    rows = panel.join(F.broadcast(bounds), "phase").withColumn("bin", F.floor((F.col("second") - F.col("lo")) / width).cast("int"))
    means = rows.groupBy("phase", "bin").agg(F.avg(F.log(value)).alias("level"))
    means = means.join(F.broadcast(bounds), "phase").withColumn("centre", (F.col("lo") + F.col("bin") * width + F.least(F.col("lo") + (F.col("bin") + 1) * width, "hi") - 1) / 2)
    w = Window.partitionBy("phase").orderBy("centre")
    spans = means.select("phase", "lo", "hi", F.col("centre").alias("c0"), F.col("level").alias("l0"), F.lead("centre").over(w).alias("c1"), F.lead("level").over(w).alias("l1"), F.row_number().over(w).alias("i"))
    first = F.when(F.col("i") == 1, F.col("lo")).otherwise(F.ceil("c0"))
    last = F.when(F.col("c1").isNull(), F.col("hi") - 1).otherwise(F.ceil("c1") - 1)
    seconds = spans.withColumn("second", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    at = F.when(F.col("second") <= F.col("c0"), F.col("l0")).when(F.col("c1").isNull(), F.col("l0")).otherwise(F.col("l0") + (F.col("l1") - F.col("l0")) * (F.col("second") - F.col("c0")) / (F.col("c1") - F.col("c0")))
    return seconds.select("phase", "second", at.alias("profile"))


def rolling_plan(panel: DataFrame, daily: DataFrame, least_training: int, origins: Sequence[tuple] = ORIGINS, horizons: Sequence[int] = (60, 300), most_context: int = 600, phases: Sequence[Phase] = DAY, value: str = "spread") -> DataFrame:
    """A task for each day, origin and horizon that ends inside its phase.

    Issuing looks at training and history alone, never at the target. A second
    of the panel meets only the origins whose windows hold it: the windows'
    seconds are a table bounded by the origins, joined by equality.
    """
    spark = panel.sparkSession
    of = {p.name: p for p in phases}
    tasks, spans = [], []
    for event, clock, phase, elapsed in origins:
        end, context = of[phase].start + elapsed, min(most_context, elapsed)
        spans += [(clock, s, True, 0) for s in range(end - context, end)]
        for h in horizons:
            if end + h <= of[phase].stop:
                tasks.append((event, clock, phase, elapsed, h, context))
                spans += [(clock, s, False, h) for s in range(end, end + h)]
    wanted = spark.createDataFrame(tasks, "event string, origin string, phase string, elapsed int, horizon int, context_levels int")
    seconds = spark.createDataFrame(spans, "origin string, second int, past boolean, horizon int")
    good = panel.filter((F.col(value) > 0) & ~F.isnan(value)).join(F.broadcast(seconds), "second").groupBy("day_index", "origin", "past", "horizon").agg(F.count(F.lit(1)).alias("held"))
    past = good.filter("past").select("day_index", "origin", F.col("held").alias("held_past"))
    future = good.filter("not past").select("day_index", "origin", "horizon", F.col("held").alias("held_future"))
    days = training_counts(daily)
    slots = days.select("*", F.explode(F.array(*[F.lit(i) for i in range(len(tasks))])).alias("slot"))
    numbered = spark.createDataFrame([(i, *t) for i, t in enumerate(tasks)], "slot int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema))
    out = slots.join(F.broadcast(numbered), "slot").drop("slot").join(past, ["day_index", "origin"], "left").join(future, ["day_index", "origin", "horizon"], "left")
    trained = F.col("train_fft_observations") >= least_training
    history = F.coalesce(F.col("held_past") == F.col("context_levels"), F.lit(False))
    target = F.coalesce(F.col("held_future") == F.col("horizon"), F.lit(False))
    status = F.when(~trained, "short_training").when(~history, "missing_history").when(~target, "missing_target").otherwise("scorable")
    return out.select("day_index", "event", "origin", "phase", "elapsed", "horizon", "context_levels", (F.col("context_levels") - 1).alias("context_changes"), "train_changes", "train_fft_observations", trained.alias("minimum_training_met"), history.alias("history_ok"), target.alias("target_ok"), (trained & history).alias("issued"), (trained & history & target).alias("scorable"), status.alias("status"))


def plan_summary(tasks: DataFrame, *keys: str) -> DataFrame:
    """Scheduled, issued and scorable tasks by keys."""
    return tasks.groupBy(*keys).agg(F.count(F.lit(1)).alias("scheduled"), F.sum(F.col("issued").cast("long")).alias("issued"), F.sum(F.col("scorable").cast("long")).alias("scorable"))


def last_days(tasks: DataFrame, count: int, policy: str = "usable", day: str = "day_index") -> DataFrame:
    """The tasks of the last count days that have an issued task ("usable") or any ("archived")."""
    if count < 1 or policy not in ("usable", "archived"):
        raise ValueError("count must be positive, and policy usable or archived")
    pool = tasks.groupBy(day).agg(F.bool_or("issued").alias("ok"))
    pool = pool.filter("ok") if policy == "usable" else pool
    chosen = pool.orderBy(F.desc(day)).limit(count).select(day)
    if chosen.count() < count:
        raise ValueError(f"fewer than {count} {policy} days")
    return tasks.join(F.broadcast(chosen), day, "left_semi")
