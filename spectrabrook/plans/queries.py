"""Queries over the driver's tables, each with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectrabrook.functions.columns import arma11_sums, spectral_density, whittle_term
from spectrabrook.functions.model import Settings, Spec
from spectrabrook.operators import combine, diagnose, panel, scores, spectrum, timeindex
from spectrabrook.plans import experiment, forecast, inference, production
from spectrabrook.sources import series

HOURS, SHARDS, SLOTS = 720, 8, 288
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The phases of the panel made from events: five-minute slots of a day.
PHASES = (panel.Phase("am", 0, 144), panel.Phase("pm", 144, 288))
#: Event, label, phase and slots since the phase began.
ORIGINS = (("early", "00:30", "am", 6), ("noon", "11:00", "am", 132), ("late", "23:40", "pm", 140))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.hourly(table(spark, sf_dir, "events"), HOURS)


def power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.periodogram(spectrum.fft(hourly(spark, sf_dir), HOURS, 16), HOURS)


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.event_panel(table(spark, sf_dir, "events"), SLOTS)


def event_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.event_draws(table(spark, sf_dir, "events"))


GRID = """
grid as (
  select g.t as t, coalesce(e.y, 0)::double as y, coalesce(e.x1, 0)::double as x1
  from (select unnest(range(720)) as t) g
  left join (select cast(floor(epoch(ts) / 3600) as bigint) - 473352 as t, count(*) as y, sum(value) as x1 from events group by 1) e on e.t = g.t
)"""
DFT = (
    GRID
    + """,
dft as (
  select k, sum(y * cos(2 * pi() * ((k * t) % 720) / 720)) as re_y, -sum(y * sin(2 * pi() * ((k * t) % 720) / 720)) as im_y,
         sum(x1 * cos(2 * pi() * ((k * t) % 720) / 720)) as re_x1, -sum(x1 * sin(2 * pi() * ((k * t) % 720) / 720)) as im_x1
  from grid, (select unnest(range(1, 360)) as k) group by k
),
pg as (
  select k, 2 * pi() * k / 720 as omega, 4 * pow(sin(pi() * k / 720), 2) as q, (re_y * re_y + im_y * im_y) / (2 * pi() * 720) as i, re_y, im_y, re_x1, im_x1,
         (k - 1) % 8 as shard_id
  from dft
)"""
)
PANEL = """
panel as (
  select day_index, case when second < 144 then 'am' else 'pm' end as phase, second, spread from (
    select cast(floor((epoch(ts) - 1704067200) / 86400) as integer) as day_index,
           cast(floor((cast(floor(epoch(ts)) as bigint) % 86400) / 300) as integer) as second, avg(value) as spread
    from events group by 1, 2)
),
changes as (
  select *, case when lag(second) over w = second - 1 then ln(spread) - ln(lag(spread) over w) end as change
  from panel window w as (partition by day_index, phase order by second)
)"""
DRAWS = """
draws as (
  select dense_rank() over (order by event_type) - 1 as shard_id, row_number() over (partition by event_type order by event_id) - 1 as draw, value as a, ln(value) as b
  from events
),
long as (select shard_id, draw, 0 as parameter, a as value from draws union all select shard_id, draw, 1, b from draws)"""
FORECASTS = """
base as (
  select cast(floor(epoch(l_shipdate) / 86400) as integer) % 200 as day_index, l_returnflag as origin, case when l_linenumber % 2 = 0 then 60 else 300 end as horizon,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 1000 as actual, l_discount, l_tax
  from lineitem
),
f as (
  select day_index, origin, horizon, l_orderkey, l_linenumber, l_partkey, l_suppkey, 'A' as model, actual, actual * (1 - l_discount) as prediction from base
  union all
  select day_index, origin, horizon, l_orderkey, l_linenumber, l_partkey, l_suppkey, 'B', actual, actual * (1 + l_tax) from base
)"""


# Series and time indices


@query(f"with {GRID} select t, y, round(x1, 6) as x1 from grid")
def series_hourly_grid(spark, sf_dir):
    return hourly(spark, sf_dir).select("t", "y", r6("x1").alias("x1"))


@query("""
with d as (select cast(o_orderdate as date) as day, sum(o_totalprice) as y from orders group by 1),
g as (select unnest(generate_series((select min(day) from d), (select max(day) from d), interval 1 day))::date as day)
select date_diff('day', (select min(day) from d), g.day) as t, round(coalesce(y, 0), 4) as y from g left join d on d.day = g.day
""")
def series_daily_grid(spark, sf_dir):
    return series.daily(table(spark, sf_dir, "orders")).select("t", F.round("y", 4).alias("y"))


@query(f"with {GRID} select count(t) as n, count(distinct t) as \"distinct\", min(t)::double as first, max(t)::double as last, (max(t) - min(t))::double / (count(t) - 1) as step from grid")
def time_index_stats(spark, sf_dir):
    return timeindex.time_stats(hourly(spark, sf_dir), "t")


@query(f"with {GRID} select t - 16 as t, y from grid where t >= 16")
def trim_oldest(spark, sf_dir):
    return timeindex.trim(hourly(spark, sf_dir), HOURS, 32)[0].select("t", "y")


@query(f"with {GRID} select t - 700 as t, y from grid where t >= 700")
def window_tail(spark, sf_dir):
    return timeindex.window_rows(hourly(spark, sf_dir), HOURS, 20, "tail").select("t", "y")


@query("select i as t, round(((i * 48271) % 2147483647) / 2147483647.0::double - 0.5, 9) as y from (select unnest(range(4096)) as i)")
def congruential_blocks(spark, sf_dir):
    return series.congruential(spark, 4096).select("t", F.round("y", 9).alias("y"))


@query("select i as t, round(sin(i * 0.01) + 0.5 * cos(i * 0.037) + 0.25 * sin(i * 0.11), 9) as y from (select unnest(range(4096))::double as i)")
def sinusoid_series(spark, sf_dir):
    return series.sinusoids(spark, 4096).select(F.col("t").cast("double").alias("t"), F.round("y", 9).alias("y"))


@query(f"""with {GRID}, c as (select t, y - avg(y) over () as v from grid), s as (select sum(v * v) as s from c)
select l.lag as lag, round(sum(a.v * b.v) / any_value(s.s), 6) as acf from c a, (select unnest(range(25)) as lag) l, c b, s where b.t = a.t + l.lag group by l.lag""")
def autocorrelation(spark, sf_dir):
    return spectrum.autocorrelation(hourly(spark, sf_dir), 24).select(F.col("lag").cast("long").alias("lag"), r6("acf").alias("acf"))


# Spectra


@query(f"with {DFT} select k, round(re_y, 6) as re, round(im_y, 6) as im from pg")
def dft_direct(spark, sf_dir):
    return spectrum.direct_dft(hourly(spark, sf_dir), HOURS).select("k", r6("re_y").alias("re"), r6("im_y").alias("im"))


@query(f"with {DFT} select k, round(omega, 6) as omega, round(q, 6) as q, round(i, 6) as periodogram from pg")
def periodogram_fft(spark, sf_dir):
    return power(spark, sf_dir).select("k", r6("omega").alias("omega"), r6("q").alias("q"), r6("periodogram").alias("periodogram"))


@query(f"with {DFT} select k, round(re_y, 5) as re_y, round(im_y, 5) as im_y, round(re_x1, 5) as re_x1, round(im_x1, 5) as im_x1 from pg")
def fft_columns(spark, sf_dir):
    found = spectrum.fft(hourly(spark, sf_dir), HOURS, 6, ["y", "x1"])
    return found.select("k", *[F.round(c, 5).alias(c) for c in found.columns[1:]])


@query(f"with {DFT} select k, cast(shard_id as integer) as shard_id from pg")
def shard_systematic(spark, sf_dir):
    return spectrum.systematic(power(spark, sf_dir), SHARDS).select("k", "shard_id")


@query("select k, cast(ntile(7) over (order by k) - 1 as integer) as shard_id from (select unnest(range(1, 360)) as k)")
def shard_sequential(spark, sf_dir):
    return spectrum.sequential(power(spark, sf_dir), 7, 359).select("k", "shard_id")


@query("select cast(t % 8 as integer) as shard_id, count(*) as held, count(*) as due, true as complete from (select unnest(range(359)) as t) group by 1")
def shard_completeness(spark, sf_dir):
    return spectrum.shard_completeness(spectrum.systematic(power(spark, sf_dir), SHARDS), SHARDS, 359).select("shard_id", "held", "due", "complete")


@query(f"with {DFT} select cast(shard_id as integer) as shard_id, count(*) as n, round(sum(i), 6) as energy from pg group by 1")
def parseval_by_shard(spark, sf_dir):
    return spectrum.systematic(power(spark, sf_dir), SHARDS).groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("periodogram")).alias("energy"))


@query(f"with {DFT} select count(*) as n, round(sum(i), 6) as sum_power, round(sum(q * i), 6) as sum_q_power from pg")
def ar1_spectral_stats(spark, sf_dir):
    return power(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("periodogram")).alias("sum_power"), r6(F.sum(F.col("q") * F.col("periodogram"))).alias("sum_q_power"))


@query(f"""with {DFT}, s as (select shard_id, i, 20.0 / (2 * pi()) / ((1 - 0.4) ** 2 + 0.4 * q) as f from pg)
select cast(shard_id as integer) as shard_id, count(*) as n, round(-sum(ln(f) + i / f), 6) as log_likelihood from s group by 1""")
def whittle_ar1_by_shard(spark, sf_dir):
    """The flagship: hourly counts, exact transform, shards, and the AR(1) Whittle log-likelihood of each."""
    f = spectral_density(F.col("omega"), phi=[0.4], sigma2=20.0)
    return spectrum.systematic(power(spark, sf_dir), SHARDS).groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(whittle_term(F.col("periodogram"), f))).alias("log_likelihood"))


@query(f"""with {DFT}, s as (select shard_id, i, 15.0 / (2 * pi()) * (1 + 0.3 * 0.3 + 2 * 0.3 * cos(omega)) / (1 + 0.25 - 2 * 0.5 * cos(omega)) * pow(pow(1 - exp(-0.2), 2) + exp(-0.2) * q, -0.3) as f from pg)
select cast(shard_id as integer) as shard_id, round(-sum(ln(f) + i / f), 6) as log_likelihood from s group by 1""")
def whittle_artfima_by_shard(spark, sf_dir):
    f = spectral_density(F.col("omega"), phi=[0.5], theta=[0.3], sigma2=15.0, d=0.3, lam=0.2)
    return spectrum.systematic(power(spark, sf_dir), SHARDS).groupBy("shard_id").agg(r6(F.sum(whittle_term(F.col("periodogram"), f))).alias("log_likelihood"))


@query(f"""with {DFT}, p as (select p::double / 10 as phi, s::double as sigma2 from (select unnest(range(-9, 10, 3)) as p), (select unnest([5, 10, 20]) as s)),
v as (select phi, sigma2, i, sigma2 / (2 * pi()) / (1 + phi * phi - 2 * phi * cos(omega)) as f from pg, p)
select round(phi, 3) as phi, sigma2, round(-sum(ln(f) + i / f), 5) as log_likelihood from v group by 1, 2""")
def whittle_grid(spark, sf_dir):
    grid = [(p / 10, float(s)) for p in range(-9, 10, 3) for s in (5, 10, 20)]
    sums = [F.sum(whittle_term(F.col("periodogram"), spectral_density(F.col("omega"), phi=[p], sigma2=s))) for p, s in grid]
    cells = F.array(*[F.struct(F.lit(p).alias("phi"), F.lit(s).alias("sigma2"), x.alias("v")) for (p, s), x in zip(grid, sums, strict=True)])
    return power(spark, sf_dir).agg(cells.alias("cells")).select(F.explode("cells").alias("c")).select(F.round("c.phi", 3).alias("phi"), "c.sigma2", F.round("c.v", 5).alias("log_likelihood"))


@query(f"""with {DFT}, s as (select i, q, (1 + 0.3) ** 2 - 0.3 * q as ma, (1 - 0.4) ** 2 + 0.4 * q as ar from pg)
select round(sum(i * ar / ma), 5) as energy, round(sum(i * (q - 2 * (1 - 0.4)) / ma), 5) as d_phi, round(sum(-i * ar * (2 * (1 + 0.3) - q) / (ma * ma)), 5) as d_theta, round(sum(2 * i / ma), 5) as d_phi_phi,
round(sum(-i * (q - 2 * (1 - 0.4)) * (2 * (1 + 0.3) - q) / (ma * ma)), 5) as d_phi_theta, round(sum(i * ar * (2 * pow(2 * (1 + 0.3) - q, 2) / pow(ma, 3) - 2 / (ma * ma))), 5) as d_theta_theta from s""")
def arma11_energy_sums(spark, sf_dir):
    """Energy of ARMA(1,1) at (0.4, 0.3) and its derivatives: what a Newton step needs, in one aggregate."""
    parts = arma11_sums(F.col("q"), F.col("periodogram"), 0.4, 0.3)
    return power(spark, sf_dir).agg(*[F.round(F.sum(v), 5).alias(k) for k, v in parts.items()])


@query(f"with {DFT} select k, round((pow(re_y - 0.05 * re_x1, 2) + pow(im_y - 0.05 * im_x1, 2)) / (2 * pi() * 720), 6) as periodogram from pg")
def residual_periodogram(spark, sf_dir):
    joint = spectrum.fft(hourly(spark, sf_dir), HOURS, 16, ["y", "x1"])
    return spectrum.residual_periodogram(joint, HOURS, [0.05], ["x1"]).select("k", r6("periodogram").alias("periodogram"))


@query(f"""with {DFT}, s as (select shard_id, (pow(re_y - 0.05 * re_x1, 2) + pow(im_y - 0.05 * im_x1, 2)) / (2 * pi() * 720) as i, 9.0 / (2 * pi()) / (pow(1 - 0.3 * cos(omega) - 0.1 * cos(2 * omega), 2) + pow(0.3 * sin(omega) + 0.1 * sin(2 * omega), 2)) as f from pg)
select cast(shard_id as integer) as shard_id, round(-sum(ln(f) + i / f), 6) as log_likelihood from s group by 1""")
def regression_whittle(spark, sf_dir):
    joint = spectrum.fft(hourly(spark, sf_dir), HOURS, 16, ["y", "x1"])
    rest = spectrum.systematic(spectrum.residual_periodogram(joint, HOURS, [0.05], ["x1"]), SHARDS)
    f = spectral_density(F.col("omega"), phi=[0.3, 0.1], sigma2=9.0)
    return rest.groupBy("shard_id").agg(r6(F.sum(whittle_term(F.col("periodogram"), f))).alias("log_likelihood"))


@query(f"""with {GRID}, e as (select t, y - 0.05 * x1 as e, lag(y - 0.05 * x1, 1) over (order by t) as e1, lag(y - 0.05 * x1, 2) over (order by t) as e2 from grid)
select count(*) as n, round(-0.5 * sum(ln(2 * pi() * 9.0) + pow(e - 0.3 * e1 - 0.1 * e2, 2) / 9.0), 6) as log_likelihood from e where e2 is not null""")
def cond_ar2_loglik(spark, sf_dir):
    rows = hourly(spark, sf_dir).withColumn("e", F.col("y") - 0.05 * F.col("x1"))
    # Lags by shifting the index: rows meet their two successors in one shuffle, not in one window.
    near = rows.select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("lag"), "t", "e").select((F.col("t") + F.col("lag")).alias("t"), F.when(F.col("lag") == 0, F.col("e")).alias("e0"), F.when(F.col("lag") == 1, F.col("e")).alias("e1"), F.when(F.col("lag") == 2, F.col("e")).alias("e2"))
    one = near.groupBy("t").agg(F.max("e0").alias("e"), F.max("e1").alias("e1"), F.max("e2").alias("e2")).filter("e is not null and e2 is not null")
    u = F.col("e") - 0.3 * F.col("e1") - 0.1 * F.col("e2")
    return one.agg(F.count(F.lit(1)).alias("n"), r6(-0.5 * F.sum(F.log(F.lit(2 * np.pi * 9.0)) + u * u / 9.0)).alias("log_likelihood"))


@query(f"""with {GRID}, g as (select least(t // 103, 6) as shard_id, t - 103 * least(t // 103, 6) as u, case when t < 618 then 103 else 102 end as n, y from grid),
d as (select shard_id, n, k, sum(y * cos(2 * pi() * ((k * u) % n) / n)) as re, sum(y * sin(2 * pi() * ((k * u) % n) / n)) as im from g, (select unnest(range(1, 52)) as k) where k <= (n - 1) // 2 group by 1, 2, 3)
select cast(shard_id as integer) as shard_id, k, round(2 * pi() * k / n, 6) as omega, round(4 * pow(sin(pi() * k / n), 2), 6) as q, round((re * re + im * im) / (2 * pi() * n), 6) as periodogram, cast(n as bigint) as n from d""")
def time_segment_periodograms(spark, sf_dir):
    s = spectrum.time_segments(hourly(spark, sf_dir), HOURS, 7)
    return s.select("shard_id", "k", r6("omega").alias("omega"), r6("q").alias("q"), r6("periodogram").alias("periodogram"), "n")


# Panels


@query(f"with {PANEL} select day_index, phase, second, round(change, 6) as change from changes where change is not null")
def changes_within_phase(spark, sf_dir):
    return panel.changes(event_panel(spark, sf_dir)).filter("change is not null").select("day_index", "phase", "second", r6("change").alias("change"))


@query(f"""with {PANEL}, o as (select *, lag(spread) over g as p, lag(second) over g as ps, lag(day_index) over g as pd, lag(phase) over g as pp from panel window g as (order by day_index, second))
select day_index, phase, second, round(ln(spread) - ln(p), 6) as change,
case when p is null then 'start' when pd <> day_index then 'date' when pp <> phase then 'lunch' when second - ps = 1 then 'none' else 'gap' end as boundary from o""")
def changes_observed(spark, sf_dir):
    return panel.observed_changes(event_panel(spark, sf_dir)).withColumn("change", r6("change"))


@query(f"""with {PANEL}, i as (select *, second - row_number() over (partition by day_index, phase order by second) as island from panel)
select day_index, phase, min(second) as start, max(second) + 1 as stop, count(*) as n from i group by day_index, phase, island""")
def runs_islands(spark, sf_dir):
    return panel.runs(event_panel(spark, sf_dir))


COUNTS = """
islands as (select day_index, phase, second - row_number() over (partition by day_index, phase order by second) as island from panel),
daily as (select g.day_index, coalesce(c.changes, 0) as changes from (select cast(unnest(range(30)) as integer) as day_index) g
  left join (select day_index, sum(n - 1) as changes from (select day_index, phase, island, count(*) as n from islands group by 1, 2, 3) group by 1) c on c.day_index = g.day_index),
trained as (select day_index, changes, coalesce(sum(changes) over (order by day_index rows between unbounded preceding and 1 preceding), 0) as train_changes from daily)"""


@query(f"with {PANEL}, {COUNTS} select day_index, cast(changes as bigint) as changes, cast(train_changes as bigint) as train_changes, cast(train_changes - train_changes % 2 as bigint) as train_fft_observations from trained")
def exclusive_training_counts(spark, sf_dir):
    return panel.training_counts(panel.daily_changes(panel.runs(event_panel(spark, sf_dir)), 30))


CLOCK = """
s as (select phase, second, count(change) as pairs, avg(change) as mean, stddev_pop(change) as sd from changes where change is not null group by 1, 2),
fl as (select phase, greatest(1e-6, 0.05 * quantile_cont(sd, 0.5)) as floor from s group by 1)"""


@query(f"with {PANEL}, {CLOCK} select phase, second, pairs, round(mean, 6) as mean, round(sd, 6) as sd, round(greatest(sd, floor), 6) as scale, pairs >= 3 as ok from s join fl using (phase)")
def clock_calibration(spark, sf_dir):
    c = panel.calibration(event_panel(spark, sf_dir))
    return c.select("phase", "second", "pairs", r6("mean").alias("mean"), r6("sd").alias("sd"), r6("scale").alias("scale"), "ok")


@query(f"with {PANEL}, {CLOCK} select day_index, phase, second, round((change - mean) / greatest(sd, floor), 4) as z from changes join s using (phase, second) join fl using (phase) where change is not null and pairs >= 3")
def standardised_changes(spark, sf_dir):
    p = event_panel(spark, sf_dir)
    return panel.standardised(p, panel.calibration(p).filter("ok")).select("day_index", "phase", "second", F.round("z", 4).alias("z"))


@query(f"""with {PANEL}, m as (select phase, second, avg(change) as mean, avg(ln(spread)) as level from changes group by 1, 2)
select phase, second, round(first_value(level) over w + sum(coalesce(mean, 0)) over w, 6) as profile from m window w as (partition by phase order by second rows between unbounded preceding and current row)""")
def clock_profile(spark, sf_dir):
    return panel.clock_profile(event_panel(spark, sf_dir)).select("phase", "second", r6("profile").alias("profile"))


@query(f"""with {PANEL}, m as (select phase, cast((second - case phase when 'am' then 0 else 144 end) % 12 as integer) as position, avg(change) as mean from changes where change is not null group by 1, 2)
select phase, position, round(mean - avg(mean) over (partition by phase), 6) as mean from m""")
def folded_profile(spark, sf_dir):
    return panel.folded_profile(event_panel(spark, sf_dir), 12, PHASES).select("phase", "position", r6("mean").alias("mean"))


@query(f"""with {PANEL}, d as (select *, avg(spread) over (partition by day_index) as m, count(spread) over (partition by day_index) as held from panel),
b as (select day_index, cast(floor(second / 12) as integer) as bin, avg(spread) / any_value(m) as level from d where held >= 0.3 * 288 group by 1, 2)
select bin, count(*) as days, round(quantile_cont(level, 0.25), 6) as q25, round(quantile_cont(level, 0.5), 6) as median, round(quantile_cont(level, 0.75), 6) as q75 from b group by 1""")
def intraday_profile(spark, sf_dir):
    p = panel.intraday_profile(event_panel(spark, sf_dir), 12, 0.3, SLOTS)
    return p.select("bin", "days", r6("q25").alias("q25"), r6("median").alias("median"), r6("q75").alias("q75"))


@query(f"""with {PANEL} select day_index, round(case when count(case when second < 24 then spread end) >= 0.5 * 24 then avg(case when second < 24 then spread end) end, 9) as opening,
round(case when count(case when second >= 264 then spread end) >= 0.5 * 24 then avg(case when second >= 264 then spread end) end, 9) as closing from panel group by 1""")
def boundary_windows(spark, sf_dir):
    w = panel.boundary_windows(event_panel(spark, sf_dir), {"opening": (0, 24), "closing": (264, 288)}, 0.5)
    return w.select("day_index", F.round("opening", 9).alias("opening"), F.round("closing", 9).alias("closing"))


@query(f"""with {PANEL}, w as (select day_index, avg(case when second < 24 then spread end) as o, count(case when second < 24 then spread end) as no, avg(case when second >= 264 then spread end) as c, count(case when second >= 264 then spread end) as nc from panel group by 1),
r as (select day_index, case when no >= 2.4 then o end as o, case when nc >= 2.4 then c end as c from w)
select day_index, round(ln(c / o), 9) as within, round(ln(o / lag(c) over (order by day_index)), 9) as overnight from r""")
def boundary_ratios(spark, sf_dir):
    w = panel.boundary_windows(event_panel(spark, sf_dir), {"opening": (0, 24), "closing": (264, 288)}, 0.1)
    return panel.boundary_ratios(w).select("day_index", F.round("within", 9).alias("within"), F.round("overnight", 9).alias("overnight"))


@query(f"""with {PANEL}, o as (select *, lag(spread) over g as p, lag(second) over g as ps, lag(day_index) over g as pd, lag(phase) over g as pp from panel window g as (order by day_index, second)),
k as (select change, case when p is null then 'start' when pd <> day_index then 'date' when pp <> phase then 'lunch' when second - ps = 1 then 'none' else 'gap' end as boundary from (select *, ln(spread) - ln(p) as change from o))
select boundary, count(*) as n, round(avg(change), 6) as mean, round(stddev_pop(change), 6) as sd from k where boundary in ('none', 'gap') group by 1""")
def changes_policy(spark, sf_dir):
    """Changes that cross no phase and no date, the policy that excludes boundaries."""
    c = panel.observed_changes(event_panel(spark, sf_dir), keep=("none", "gap"))
    return c.groupBy("boundary").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("change")).alias("mean"), r6(F.stddev_pop("change")).alias("sd"))


@query(f"""with {PANEL}, m as (select phase, case phase when 'am' then 0 else 144 end as lo, cast(floor((second - case phase when 'am' then 0 else 144 end) / 12) as integer) as bin, avg(ln(spread)) as level from panel group by 1, 2, 3),
c as (select phase, level, (lo + bin * 12 + lo + (bin + 1) * 12 - 1) / 2.0 as centre from m),
n as (select phase, centre, level, lead(centre) over w as c1, lead(level) over w as l1, min(centre) over (partition by phase) as first from c window w as (partition by phase order by centre)),
s as (select case when t < 144 then 'am' else 'pm' end as phase, t as second from (select cast(unnest(range(288)) as integer) as t))
select s.phase, s.second, round(case when n.c1 is null or s.second <= n.centre then n.level else n.level + (n.l1 - n.level) * (s.second - n.centre) / (n.c1 - n.centre) end, 6) as profile
from s join n on n.phase = s.phase and ((s.second >= n.centre and (n.c1 is null or s.second < n.c1)) or (s.second < n.centre and n.centre = n.first))""")
def binned_level(spark, sf_dir):
    return panel.binned_level(event_panel(spark, sf_dir), 12, PHASES).select("phase", "second", r6("profile").alias("profile"))


PLAN = f"""with {PANEL}, {COUNTS},
o as (select * from (values ('early', '00:30', 'am', 0, 144, 6), ('noon', '11:00', 'am', 0, 144, 132), ('late', '23:40', 'pm', 144, 288, 140)) v(event, origin, phase, lo, hi, elapsed)),
task as (select *, lo + elapsed as stop, least(6, elapsed) as context from o, (select unnest([2, 6]) as horizon) where lo + elapsed + horizon <= hi),
plan as (
  select t.day_index, event, origin, k.phase, elapsed, horizon, context, t.train_changes - t.train_changes % 2 as fft,
    (select count(*) from panel p where p.day_index = t.day_index and p.second >= k.stop - context and p.second < k.stop and p.spread > 0) = context as history_ok,
    (select count(*) from panel p where p.day_index = t.day_index and p.second >= k.stop and p.second < k.stop + horizon and p.spread > 0) = horizon as target_ok
  from trained t, task k)"""


def plan_tasks(spark, sf_dir) -> DataFrame:
    p = event_panel(spark, sf_dir)
    return panel.rolling_plan(p, panel.daily_changes(panel.runs(p), 30), 200, ORIGINS, (2, 6), 6, PHASES)


@query(PLAN + " select day_index, event, origin, cast(horizon as integer) as horizon, cast(fft as bigint) as train_fft_observations, history_ok, target_ok, fft >= 200 and history_ok as issued, case when fft < 200 then 'short_training' when not history_ok then 'missing_history' when not target_ok then 'missing_target' else 'scorable' end as status from plan")
def rolling_plan(spark, sf_dir):
    return plan_tasks(spark, sf_dir).select("day_index", "event", "origin", "horizon", "train_fft_observations", "history_ok", "target_ok", "issued", "status")


@query(PLAN + " select event, origin, cast(horizon as integer) as horizon, count(*) as scheduled, cast(sum(case when fft >= 200 and history_ok then 1 else 0 end) as bigint) as issued, cast(sum(case when fft >= 200 and history_ok and target_ok then 1 else 0 end) as bigint) as scorable from plan group by 1, 2, 3")
def plan_summary(spark, sf_dir):
    return panel.plan_summary(plan_tasks(spark, sf_dir), "event", "origin", "horizon")


@query(PLAN + ", d as (select day_index from plan order by day_index desc limit 1) select day_index, event, origin, cast(horizon as integer) as horizon from plan where day_index in (select distinct day_index from plan order by day_index desc limit 5)")
def last_days(spark, sf_dir):
    return panel.last_days(plan_tasks(spark, sf_dir), 5, "archived").select("day_index", "event", "origin", "horizon")


# Posteriors


@query(f"with {DRAWS} select cast(shard_id as integer) as shard_id, parameter, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(quantile_cont(value, 0.025), 6) as q0, round(quantile_cont(value, 0.5), 6) as q1, round(quantile_cont(value, 0.975), 6) as q2 from long group by 1, 2")
def draw_summary(spark, sf_dir):
    s = diagnose.summary(diagnose.long_draws(event_draws(spark, sf_dir), 2), "shard_id", "parameter")
    return s.select("shard_id", "parameter", "n", *[r6(c).alias(c) for c in ("mean", "sd", "q0", "q1", "q2")])


ALIGNED = "al as (select * from draws where draw <= (select min(m) from (select max(draw) as m from draws group by shard_id)))"


@query(f"with {DRAWS}, {ALIGNED} select draw, round(avg(a), 6) as a, round(avg(b), 6) as b from al group by 1")
def simple_average(spark, sf_dir):
    out = combine.simple_average(event_draws(spark, sf_dir), 2)
    return out.select("draw", r6(F.col("theta")[0]).alias("a"), r6(F.col("theta")[1]).alias("b"))


@query(f"with {DRAWS} select cast(shard_id as integer) as shard_id, count(*) as n, round(avg(a), 6) as mean_a, round(avg(b), 6) as mean_b, round(covar_samp(a, a), 6) as c00, round(covar_samp(a, b), 6) as c01, round(covar_samp(b, b), 6) as c11 from draws group by 1")
def shard_covariances(spark, sf_dir):
    c = combine.covariances(event_draws(spark, sf_dir), 2)
    return c.select("shard_id", "n", r6(F.col("means")[0]).alias("mean_a"), r6(F.col("means")[1]).alias("mean_b"), r6(F.col("cov")[0]).alias("c00"), r6(F.col("cov")[1]).alias("c01"), r6(F.col("cov")[3]).alias("c11"))


@query(f"""with {DRAWS}, {ALIGNED}, v as (select shard_id, covar_samp(a, a) + 1e-8 as v00, covar_samp(a, b) as v01, covar_samp(b, b) + 1e-8 as v11 from draws group by 1),
w as (select shard_id, v11 / (v00 * v11 - v01 * v01) as w00, -v01 / (v00 * v11 - v01 * v01) as w01, v00 / (v00 * v11 - v01 * v01) as w11 from v),
t as (select sum(w00) as t00, sum(w01) as t01, sum(w11) as t11 from w),
s as (select draw, sum(w00 * a + w01 * b) as x, sum(w01 * a + w11 * b) as y from al join w using (shard_id) group by 1)
select draw, round((t11 * x - t01 * y) / (t00 * t11 - t01 * t01), 6) as a, round((t00 * y - t01 * x) / (t00 * t11 - t01 * t01), 6) as b from s, t""")
def consensus(spark, sf_dir):
    out = combine.consensus(event_draws(spark, sf_dir), 2, undefined="nan")
    return out.select("draw", r6(F.col("theta")[0]).alias("a"), r6(F.col("theta")[1]).alias("b"))


@query(f"""with {DRAWS}, q as (select shard_id, parameter, quantile_cont(value, 0.025) as q0, quantile_cont(value, 0.5) as q1, quantile_cont(value, 0.975) as q2 from long group by 1, 2)
select parameter, round(avg(q0), 6) as q0, round(avg(q1), 6) as q1, round(avg(q2), 6) as q2 from q group by 1""")
def shard_ci_average(spark, sf_dir):
    out = combine.interval_average(event_draws(spark, sf_dir), 2)
    return out.select("parameter", *[r6(c).alias(c) for c in ("q0", "q1", "q2")])


@query(f"""with {DRAWS}, q as (select shard_id, parameter, unnest(range(50)) as point, unnest(quantile_cont(value, [{", ".join(repr((i + 0.5) / 50) for i in range(50))}])) as value from long group by 1, 2)
select parameter, cast(point as integer) as point, round(avg(value), 6) as value from q group by 1, 2""")
def barycenter_quantiles(spark, sf_dir):
    out = combine.barycenter(event_draws(spark, sf_dir), 2, 50)
    return out.select("parameter", "point", r6("value").alias("value"))


@query(f"""with {DRAWS}, x as (select parameter, quantile_cont(value, [{", ".join(repr((i + 0.5) / 200) for i in range(200))}]) as q from long where shard_id = 0 group by 1),
y as (select parameter, quantile_cont(value, [{", ".join(repr((i + 0.5) / 200) for i in range(200))}]) as q, stddev_samp(value) as sd from long where shard_id = 1 group by 1)
select x.parameter, round(list_sum(list_transform(range(1, 201), lambda i: abs(x.q[i] - y.q[i]))) / 200 / y.sd, 6) as w1 from x join y using (parameter)""")
def wasserstein_quantile(spark, sf_dir):
    long = diagnose.long_draws(event_draws(spark, sf_dir), 2)
    return diagnose.quantile_distance(long.filter("shard_id = 0"), long.filter("shard_id = 1")).select("parameter", r6("w1").alias("w1"))


@query(f"""with {DRAWS}, s as (select shard_id, parameter, avg(value) as m, stddev_samp(value) as s from long where shard_id < 2 group by 1, 2)
select x.parameter, round(abs(x.m - y.m) / y.s, 6) as mean_shift, round(x.s / y.s, 6) as sd_ratio, abs(x.m - y.m) / y.s < 0.1 and x.s / y.s between 0.9 and 1.1 as passed from s x join s y on x.parameter = y.parameter and x.shard_id = 0 and y.shard_id = 1""")
def accuracy_gate(spark, sf_dir):
    s = diagnose.summary(diagnose.long_draws(event_draws(spark, sf_dir), 2), "shard_id", "parameter")
    g = diagnose.accuracy_gate(s.filter("shard_id = 0"), s.filter("shard_id = 1"))
    return g.select("parameter", r6("mean_shift").alias("mean_shift"), r6("sd_ratio").alias("sd_ratio"), "passed")


@query("select value, count(*) as copies, round(count(*)::double / (select count(*) from events), 9) as weight from events group by 1")
def draw_atoms(spark, sf_dir):
    return diagnose.atoms(event_draws(spark, sf_dir), 1).select(F.col("theta")[0].alias("value"), "copies", F.round("weight", 9).alias("weight"))


@query(f"""with {DRAWS}, n as (select shard_id, count(*) as n from draws group by 1), k as (select min(n) as keep from n)
select cast(shard_id as integer) as shard_id, count(*) as kept, max(i) as last from (select shard_id, unnest(range(keep)) as i from n, k) group by 1""")
def thinned_draws(spark, sf_dir):
    return combine.thinned(event_draws(spark, sf_dir)).groupBy("shard_id").agg(F.countDistinct("draw").alias("kept"), F.max("draw").alias("last"))


# Forecasts and scores


def forecasts(spark, sf_dir) -> DataFrame:
    base = table(spark, sf_dir, "lineitem").select(
        F.pmod(F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")), F.lit(200)).alias("day_index"),
        F.col("l_returnflag").alias("origin"),
        F.when(F.col("l_linenumber") % 2 == 0, 60).otherwise(300).alias("horizon"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        (F.col("l_extendedprice") / 1000).alias("actual"),
        "l_discount",
        "l_tax",
    )
    both = F.explode(F.array(F.struct(F.lit("A").alias("model"), (F.col("actual") * (1 - F.col("l_discount"))).alias("prediction")), F.struct(F.lit("B").alias("model"), (F.col("actual") * (1 + F.col("l_tax"))).alias("prediction"))))
    rows = base.withColumn("m", both).select("day_index", "origin", "horizon", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "m.model", "actual", "m.prediction")
    return rows.withColumn("error", F.col("prediction") - F.col("actual")).withColumn("se", F.pow("error", F.lit(2)))


@query(f"with {FORECASTS} select model, horizon, origin, count(*) as n, round(avg(prediction - actual), 6) as bias, round(avg(abs(prediction - actual)), 6) as mae, round(sqrt(avg(pow(prediction - actual, 2))), 6) as rmse from f group by 1, 2, 3 union all select m, h, 'missing', 0, null, null, null from (select unnest(['A', 'B']) as m), (select unnest([60, 300]) as h)")
def errors_by_origin(spark, sf_dir):
    grid = spark.createDataFrame([(m, h, o) for m in "AB" for h in (60, 300) for o in ("A", "N", "R", "missing")], "model string, horizon int, origin string")
    out = scores.origin_errors(forecasts(spark, sf_dir), grid)
    return out.select("model", "horizon", "origin", "n", *[r6(c).alias(c) for c in ("bias", "mae", "rmse")])


@query(f"""with {FORECASTS} select model, coalesce(cast(horizon as varchar), 'all') as horizon, coalesce(origin, 'all') as origin, case when grouping(origin) = 1 and grouping(horizon) = 1 then 2 when grouping(origin) = 1 then 1 else 0 end as level, count(*) as n, count(distinct day_index) as days, round(sqrt(avg(pow(prediction - actual, 2))), 6) as rmse
from f group by grouping sets ((model, horizon, origin), (model, horizon), (model))""")
def score_grouping_sets(spark, sf_dir):
    f = forecasts(spark, sf_dir).withColumns({c: F.lit(None).cast("double") for c in ("ae", "crps", "cover80", "cover95", "interval80", "interval95")})
    out = scores.score_grouping_sets(f, [("model", "horizon", "origin"), ("model", "horizon"), ("model",)])
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c)
    return out.select("model", whole("horizon"), whole("origin"), "level", "n", "days", r6("rmse").alias("rmse"))


@query(f"""with {FORECASTS}, x as (select *, prediction - actual as e, 0.9 * prediction as lo80, 1.1 * prediction as hi80, 0.8 * prediction as lo95, 1.2 * prediction as hi95 from f)
select model, origin, count(*) as n, count(distinct day_index) as days, round(sqrt(avg(e * e)), 6) as rmse, round(avg(abs(e)), 6) as mae, round(avg(abs(e)), 6) as crps,
round(avg(case when actual between lo80 and hi80 then 1.0 else 0.0 end), 6) as cover80, round(avg(case when actual between lo95 and hi95 then 1.0 else 0.0 end), 6) as cover95,
round(avg(hi80 - lo80 + 10 * (greatest(lo80 - actual, 0) + greatest(actual - hi80, 0))), 6) as interval80, round(avg(hi95 - lo95 + 40 * (greatest(lo95 - actual, 0) + greatest(actual - hi95, 0))), 6) as interval95
from x group by 1, 2""")
def score_measures(spark, sf_dir):
    """Every measure of a score table, for point forecasts with intervals of ten and twenty percent."""
    f, p, a = forecasts(spark, sf_dir), F.col("prediction"), F.col("actual")
    miss = lambda w: F.greatest((1 - w) * p - a, F.lit(0.0)) + F.greatest(a - (1 + w) * p, F.lit(0.0))
    inside = lambda w: F.when(a.between((1 - w) * p, (1 + w) * p), 1.0).otherwise(0.0)
    rows = f.withColumns({"ae": F.abs("error"), "crps": F.abs("error"), "cover80": inside(0.1), "cover95": inside(0.2), "interval80": (1.1 - 0.9) * p + 10 * miss(0.1), "interval95": (1.2 - 0.8) * p + 40 * miss(0.2)})
    out = scores.score_table(rows, "model", "origin")
    return out.select("model", "origin", "n", "days", *[r6(c).alias(c) for c in ("rmse", "mae", "crps", "cover80", "cover95", "interval80", "interval95")])


@query(f"""with {FORECASTS}, x as (select *, prediction - actual as e from f),
s as (select horizon, model, count(*) as n, avg(e) as bias, sqrt(avg(e * e)) as rmse, avg(abs(e)) as mae, avg(0.4 * prediction) as width95, avg(0.4 * prediction + 40 * (greatest(0.8 * prediction - actual, 0) + greatest(actual - 1.2 * prediction, 0))) as interval95 from x group by 1, 2)
select s.horizon, s.model, s.n, round(s.bias, 6) as bias, round(s.rmse, 6) as rmse, round(s.mae, 6) as mae, round(s.width95, 6) as width95, round(s.interval95, 6) as interval95, round(100 * (1 - s.rmse / b.rmse), 6) as gain_pct from s join s b on b.horizon = s.horizon and b.model = 'B'""")
def comparison_table(spark, sf_dir):
    """Models beside a benchmark: bias, errors, width and score of the 95% interval, and the gain in RMSE."""
    p = F.col("prediction")
    rows = forecasts(spark, sf_dir).withColumns({"lower95": (1 - 0.2) * p, "upper95": (1 + 0.2) * p})
    out = scores.comparison(rows, "B", ["horizon"])
    return out.select("horizon", "model", "n", *[r6(c).alias(c) for c in ("bias", "rmse", "mae", "width95", "interval95", "gain_pct")])


CLUSTERS = """
w as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, day_index, origin, horizon, max(case when model = 'A' then pow(prediction - actual, 2) end) as a, max(case when model = 'B' then pow(prediction - actual, 2) end) as b from f group by 1, 2, 3, 4, 5, 6, 7),
cl as (select horizon, origin, cast(floor(day_index / 20) as integer) as cluster, sum(a) as candidate, sum(b) as benchmark, count(*) as n from w group by 1, 2, 3)"""


def clusters(spark, sf_dir) -> DataFrame:
    wide = scores.paired(forecasts(spark, sf_dir), ["A", "B"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "day_index", "origin", "horizon"])
    return scores.cluster_sums(wide, "A", "B")


@query(f"with {FORECASTS}, {CLUSTERS} select l_orderkey, l_linenumber, l_partkey, l_suppkey, origin, horizon, round(a, 5) as a, round(b, 5) as b from w")
def paired_pivot(spark, sf_dir):
    wide = scores.paired(forecasts(spark, sf_dir), ["A", "B"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "day_index", "origin", "horizon"])
    return wide.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "origin", "horizon", F.round("A", 5).alias("a"), F.round("B", 5).alias("b"))


@query(f"with {FORECASTS}, {CLUSTERS} select horizon, origin, cluster, round(candidate, 4) as candidate, round(benchmark, 4) as benchmark, n from cl")
def cluster_sums(spark, sf_dir):
    return clusters(spark, sf_dir).select("horizon", "origin", "cluster", F.round("candidate", 4).alias("candidate"), F.round("benchmark", 4).alias("benchmark"), "n")


@query(f"""with {FORECASTS}, {CLUSTERS}, p as (select horizon, origin, candidate, benchmark, n, cluster from cl union all select horizon, 'Pooled', sum(candidate), sum(benchmark), sum(n), cluster from cl group by horizon, cluster)
select horizon, origin, cast(sum(n) as bigint) as n, round(100 * (1 - sqrt(sum(candidate) / sum(benchmark))), 6) as rmse_reduction_pct from p group by 1, 2""")
def rmse_reduction(spark, sf_dir):
    out = scores.paired_gains(clusters(spark, sf_dir), 200)
    return out.select("horizon", "origin", "n", r6("rmse_reduction_pct").alias("rmse_reduction_pct"))


def scattered_sql(replicate: str, slot: str, seed: int, n: str) -> str:
    """scores.scattered as SQL; all numbers are bigint."""
    x = f"((({replicate}) * 48271 + ({slot}) * 69621 + {seed}) % 2147483647)"
    x = f"(({x} * {x} + ({slot})) % 2147483647)"
    x = f"(({x} * 16807 + ({replicate})) % 2147483647)"
    return f"((({x} * {x}) % 2147483647) % ({n}))"


@query(f"""with {FORECASTS}, {CLUSTERS}, p as (select horizon, origin, candidate, benchmark, n, cluster from cl union all select horizon, 'Pooled', sum(candidate), sum(benchmark), sum(n), cluster from cl group by horizon, cluster),
pl as (select cluster, row_number() over (order by cluster) - 1 as place from (select distinct cluster from cl)), k as (select count(*) as k from pl),
dr as (select r as replicate, {scattered_sql("r", "i", 20261014, "k")} as place from (select unnest(range(2000)) as r), k, lateral (select unnest(range(k)) as i)),
mu as (select replicate, cluster, count(*) as m from dr join pl using (place) group by 1, 2),
g as (select horizon, origin, replicate, 100 * (1 - sqrt(sum(m * candidate) / sum(m * benchmark))) as gain from p join mu using (cluster) group by 1, 2, 3),
q as (select horizon, origin, quantile_cont(gain, 0.025) as lo, quantile_cont(gain, 0.975) as hi, count(gain) as valid from g group by 1, 2)
select p.horizon, p.origin, cast(sum(n) as bigint) as n, count(distinct cluster) as clusters, round(sqrt(sum(candidate) / sum(n)), 6) as rmse_candidate, round(sqrt(sum(benchmark) / sum(n)), 6) as rmse_benchmark,
round(100 * (1 - sqrt(sum(candidate) / sum(benchmark))), 6) as rmse_reduction_pct, round(any_value(lo), 6) as lower_pct, round(any_value(hi), 6) as upper_pct, any_value(valid) as bootstrap_valid, any_value(lo) > 0 or any_value(hi) < 0 as excludes_zero
from p join q on p.horizon = q.horizon and p.origin = q.origin group by 1, 2""")
def paired_bootstrap(spark, sf_dir):
    out = scores.paired_gains(clusters(spark, sf_dir), 2000)
    return out.withColumns({c: r6(c) for c in ("rmse_candidate", "rmse_benchmark", "rmse_reduction_pct", "lower_pct", "upper_pct")})


@query(f"with {FORECASTS} select day_index, origin, horizon, count(distinct model) as models, count(*) as rows, count(distinct actual) as actuals from f group by 1, 2, 3 having count(distinct model) <> 2 or count(*) <> 2 or count(distinct actual) > 1")
def forecast_integrity(spark, sf_dir):
    return scores.integrity(forecasts(spark, sf_dir), 2)


@query("select o_orderkey, round(o_totalprice * 0.9, 6) as prediction, round(o_totalprice * 1.1, 6) as old_prediction from orders")
def one_to_one_join(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("actual"))
    out = scores.one_to_one(f.withColumn("prediction", F.col("actual") * 0.9), f.withColumn("prediction", F.col("actual") * 1.1), ["o_orderkey"])
    return out.select("o_orderkey", r6("prediction").alias("prediction"), r6("old_prediction").alias("old_prediction"))


@query("""
with d as (select user_id, list_sort(list(value)) as x, count(*) as n, max_by(value, event_id) as actual, avg(value) as point from events group by 1),
s as (select user_id, n, actual, point, quantile_cont(value, 0.1) as lo80, quantile_cont(value, 0.9) as hi80, quantile_cont(value, 0.025) as lo95, quantile_cont(value, 0.975) as hi95 from events join d using (user_id) group by 1, 2, 3, 4),
r as (select user_id, value, row_number() over (partition by user_id order by value) as i from events),
c as (select r.user_id, sum(abs(r.value - d.actual)) / any_value(d.n) - sum((2 * r.i - d.n - 1) * r.value) / any_value(d.n * d.n) as crps from r join d on d.user_id = r.user_id group by 1)
select user_id, round(abs(point - actual), 5) as ae, round(c.crps, 5) as crps, round(lo80, 5) as lower80, round(hi95, 5) as upper95, case when actual between lo80 and hi80 then 1.0 else 0.0 end::double as cover80,
round(hi80 - lo80 + 10 * (case when actual < lo80 then lo80 - actual else 0 end + case when actual > hi80 then actual - hi80 else 0 end), 5) as interval80,
round(hi95 - lo95 + 40 * (case when actual < lo95 then lo95 - actual else 0 end + case when actual > hi95 then actual - hi95 else 0 end), 5) as interval95
from s join c using (user_id)""")
def crps_scores(spark, sf_dir):
    of_user = Window.partitionBy("user_id")
    f = table(spark, sf_dir, "events").select("user_id", "value", F.max_by("value", "event_id").over(of_user).alias("actual"), F.avg("value").over(of_user).alias("prediction"))
    s = scores.score_rows(f, ["user_id"])
    return s.select("user_id", *[F.round(c, 5).alias(c) for c in ("ae", "crps", "lower80", "upper95")], "cover80", *[F.round(c, 5).alias(c) for c in ("interval80", "interval95")])


@query("select event_type as method, count(value) as runs, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.75), 6) as q75, min(value) as fastest, max(value) as slowest from events group by 1")
def timing_table(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.col("value").alias("seconds"))
    return scores.timing_table(t, "method").select("method", "runs", *[r6(c).alias(c) for c in ("median", "q25", "q75")], "fastest", "slowest")


@query("""with t as (select user_id % 8 + 1 as slots, quantile_cont(value, 0.5) as median from events group by 1), b as (select min_by(median, slots) as base, min(slots) as base_slots from t)
select slots, round(base / median, 6) as speedup, round(base / median * base_slots / slots, 6) as efficiency from t, b""")
def scaling_table(spark, sf_dir):
    t = table(spark, sf_dir, "events").select((F.pmod("user_id", F.lit(8)) + 1).alias("slots"), F.col("value").alias("seconds"))
    return scores.scaling(scores.timing_table(t, "slots")).select("slots", r6("speedup").alias("speedup"), r6("efficiency").alias("efficiency"))


@query("""with d as (select cast(floor((epoch(ts) - 1704067200) / 86400) as integer) as day_index, avg(value) as m from events group by 1)
select day_index, round(m - lag(m) over (order by day_index), 6) as difference from d""")
def daily_differences(spark, sf_dir):
    d = event_panel_days(spark, sf_dir)
    return d.select("day_index", r6(F.col("m") - F.lag("m").over(Window.orderBy("day_index"))).alias("difference"))


def event_panel_days(spark, sf_dir) -> DataFrame:
    s = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").groupBy(F.floor(s / 86_400).cast("int").alias("day_index")).agg(F.avg("value").alias("m"))


@query(f"""with d as (select cast(floor((epoch(ts) - 1704067200) / 86400) as integer) as day_index, avg(value) - 100.0 as difference from events group by 1),
n as (select row_number() over (order by day_index) - 1 as day, difference from d), k as (select count(*) as k from n),
st as (select r as replicate, j, k, {scattered_sql("r", "j", 0, "k")} as start from (select unnest(range(1000)) as r), k, lateral (select unnest(range(cast(ceil(k / 5.0) as bigint))) as j)),
e as (select replicate, (start + s) % k as day from st, (select unnest(range(5)) as s) where j * 5 + s < k),
m as (select replicate, avg(difference) as m from e join n using (day) group by 1)
select round((select avg(difference) from d), 6) as mean_difference, round(quantile_cont(m, 0.025), 6) as lower, round(quantile_cont(m, 0.975), 6) as upper from m""")
def block_bootstrap(spark, sf_dir):
    d = event_panel_days(spark, sf_dir).select(F.col("day_index").alias("day"), (F.col("m") - 100.0).alias("difference"))
    out = scores.block_differences(timeindex.dense_index(d, "day", "day"), 5, 1000)
    return out.select(*[r6(c).alias(c) for c in out.columns])


# Folds, benchmark models and set operations


@query("""with d as (select distinct cast(o_orderdate as date) as day from orders), n as (select cast(date_diff('day', (select min(day) from d), day) as bigint) as day_index, day from d),
q as (select date_trunc('quarter', day) as quarter, min(day_index) as first_test, max(day_index) as last_test, count(*) as test_days from n group by 1)
select concat(year(quarter), 'Q', quarter(quarter)) as fold, first_test, last_test, test_days, first_test - 1 as last_train from q where first_test >= 1""")
def quarterly_folds(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    first = days.agg(F.min("date").alias("a"))
    return experiment.quarterly_folds(days.join(F.broadcast(first)).select("date", F.datediff("date", "a").cast("long").alias("day_index")))


@query(f"""with {GRID}, l as (select y as y0, lag(y, 1) over (order by t) as y1, lag(y, 2) over (order by t) as y2 from grid), r as (select * from l where y2 is not null),
a as (select sum(y0 * y1) / sum(y1 * y1) as phi, sum((y0 - y1) * (y1 - y2)) / sum((y1 - y2) * (y1 - y2)) as psi from r)
select 'ar1' as model, round(any_value(phi), 6) as phi, round(avg(pow(y0 - phi * y1, 2)), 5) as sigma2 from r, a union all
select 'arima110', round(any_value(psi), 6), round(avg(pow(y0 - y1 - psi * (y1 - y2), 2)), 5) from r, a union all select 'last_value', null, round(avg(pow(y0 - y1, 2)), 5) from r""")
def benchmark_models(spark, sf_dir):
    fits = experiment.train_benchmarks(hourly(spark, sf_dir))
    rows = [(m, f.get("phi"), f["sigma2"]) for m, f in fits.items()]
    return spark.createDataFrame(rows, "model string, phi double, sigma2 double").select("model", r6("phi").alias("phi"), F.round("sigma2", 5).alias("sigma2"))


@query(f"""with {DRAWS}, {ALIGNED}, v as (select shard_id, var_samp(a) as v, avg(a) as m from draws group by 1)
select round(sum(m / v) / sum(1 / v), 6) as mean, round(1 / sum(1 / v), 6) as variance from v""")
def parametric_product(spark, sf_dir):
    mean, cov, _ = combine.parametric_product(event_draws(spark, sf_dir), 1, 1)
    return spark.createDataFrame([(float(mean[0]), float(cov[0, 0]))], "mean double, variance double").select(r6("mean").alias("mean"), r6("variance").alias("variance"))


@query(f"""with {DRAWS}, v as (select shard_id, covar_samp(a, a) as v00, covar_samp(a, b) as v01, covar_samp(b, b) as v11, avg(a) as ma, avg(b) as mb from draws where a > 0 group by 1),
w as (select v11 / (v00 * v11 - v01 * v01) as w00, -v01 / (v00 * v11 - v01 * v01) as w01, v00 / (v00 * v11 - v01 * v01) as w11, ma, mb from v),
t as (select sum(w00) as t00, sum(w01) as t01, sum(w11) as t11, sum(w00 * ma + w01 * mb) as x, sum(w01 * ma + w11 * mb) as y from w)
select round((t11 * x - t01 * y) / (t00 * t11 - t01 * t01), 6) as mean_a, round((t00 * y - t01 * x) / (t00 * t11 - t01 * t01), 6) as mean_b, round(t11 / (t00 * t11 - t01 * t01), 6) as c00, round(-t01 / (t00 * t11 - t01 * t01), 6) as c01, round(t00 / (t00 * t11 - t01 * t01), 6) as c11 from t""")
def parametric_product_joint(spark, sf_dir):
    """The product of the shards' joint Gaussian fits, both parameters, over draws whose logarithm is finite."""
    draws = event_draws(spark, sf_dir).filter(F.col("theta")[0] > 0)
    mean, cov, _ = combine.parametric_product(draws, 2, 1)
    row = [float(x) for x in (*mean, cov[0, 0], cov[0, 1], cov[1, 1])]
    return spark.createDataFrame([row], "mean_a double, mean_b double, c00 double, c01 double, c11 double").select(*[r6(c).alias(c) for c in ("mean_a", "mean_b", "c00", "c01", "c11")])


@query(f"""with {DRAWS}, p as (select list_transform(range(1, 100), lambda i: i / 100.0::double) as p),
x as (select parameter, [{", ".join(f"quantile_cont(value, {i / 100!r})" for i in range(1, 100))}] as q from long where shard_id = 0 group by 1),
y as (select parameter, [{", ".join(f"quantile_cont(value, {i / 100!r})" for i in range(1, 100))}] as q from long where shard_id = 1 group by 1),
m as (select parameter, median(value) as mid from long where shard_id = 1 group by 1),
d as (select l.parameter, avg(abs(value - mid)) as mad from long l join m using (parameter) where shard_id = 1 group by 1),
g as (select x.parameter, (list_sum(list_transform(range(1, 100), lambda i: abs(x.q[i] - y.q[i]))) - (abs(x.q[1] - y.q[1]) + abs(x.q[99] - y.q[99])) / 2) / 100 as w1 from x join y using (parameter))
select g.parameter, round(w1, 6) as w1, round(w1 / mad, 6) as relative_w1 from g join d using (parameter)""")
def wasserstein_percentile(spark, sf_dir):
    long = diagnose.long_draws(event_draws(spark, sf_dir), 2)
    return diagnose.percentile_distance(long.filter("shard_id = 0"), long.filter("shard_id = 1")).select("parameter", r6("w1").alias("w1"), r6("relative_w1").alias("relative_w1"))


@query(f"with {FORECASTS} select origin, horizon, model, count(*) as n from f where day_index in (select day_index from f group by 1 having count(*) >= 600) group by 1, 2, 3")
def semi_join_days(spark, sf_dir):
    f = forecasts(spark, sf_dir)
    days = f.groupBy("day_index").count().filter("count >= 600").select("day_index")
    return f.join(days, "day_index", "left_semi").groupBy("origin", "horizon", "model").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {FORECASTS} select origin, horizon, count(*) as n from (select origin, horizon, actual from f where model = 'A' union all select origin, horizon, actual from f where model = 'B') group by 1, 2")
def union_forecasts(spark, sf_dir):
    f = forecasts(spark, sf_dir).select("model", "origin", "horizon", "actual")
    return f.filter("model = 'A'").unionByName(f.filter("model = 'B'")).groupBy("origin", "horizon").agg(F.count(F.lit(1)).alias("n"))


@query("select distinct user_id from events where event_type = 'error' except select user_id from events where value > 150")
def except_users(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.filter("event_type = 'error'").select("user_id").subtract(e.filter("value > 150").select("user_id"))


@query(f"with {FORECASTS} select distinct origin, horizon from f")
def distinct_origins(spark, sf_dir):
    return forecasts(spark, sf_dir).select("origin", "horizon").dropDuplicates()


@query()
def audited_maps(spark, sf_dir):
    rows = spectrum.systematic(power(spark, sf_dir), 4)
    return experiment.audit_maps(inference.shard_summary(inference.sample_shards(rows, Spec(ar=1, ma=1), 4, Settings(draws=50, burn=0))))


@query()
def surrogate_draws(spark, sf_dir):
    rows = spectrum.systematic(power(spark, sf_dir), 4)
    draws = inference.sample_shards(rows, Spec(ar=1), 4, Settings(draws=300, burn=100, seed=3))
    return combine.surrogate_importance(draws, 2, 300)


# Inference: results are random draws and optima, so rows alone can be compared.

SETTINGS = Settings(draws=200, burn=100, chains=2, seed=3)


@query()
def dc_map_shards(spark, sf_dir):
    rows = spectrum.systematic(power(spark, sf_dir), 4)
    return inference.shard_summary(inference.sample_shards(rows, Spec(ar=1), 4, SETTINGS))


@query()
def dc_consensus_draws(spark, sf_dir):
    return inference.fit_frequency_shards(hourly(spark, sf_dir), HOURS, Spec(ar=1, ma=1), 4, SETTINGS, blocks=16).consensus


@query()
def dc_regression_draws(spark, sf_dir):
    return inference.fit_regression_shards(hourly(spark, sf_dir), HOURS, Spec(ar=2, covariates=1), ["x1"], 4, SETTINGS, blocks=16).consensus


@query()
def dc_time_segments(spark, sf_dir):
    return inference.fit_time_segments(hourly(spark, sf_dir), HOURS, Spec(ar=1), 4, SETTINGS).average


@query()
def split_rhat_ess(spark, sf_dir):
    rows = spectrum.systematic(power(spark, sf_dir), 4)
    return diagnose.convergence(inference.sample_shards(rows, Spec(ar=1), 4, SETTINGS), 2, "shard_id")


@query()
def block_sampling(spark, sf_dir):
    rows = spectrum.systematic(power(spark, sf_dir), 4).withColumn("history_id", F.lit(0))
    return inference.sample_blocks(rows, Spec(ar=1), 4, SETTINGS, goal=100, block=300, most=900)


@query()
def kernel_product_draws(spark, sf_dir):
    return combine.kernel_product(event_draws(spark, sf_dir), 2, 200, semi=True)


#: The production path's model and sampler on the panel of events, whose history is short.
PRODUCTION = (Spec(ma=1), Settings(draws=2000, burn=200, chains=2, seed=3))


@query()
def production_gates(spark, sf_dir):
    """What the gates say of the history before day 25, fitted in four shards."""
    return production.fitted_posterior(event_panel(spark, sf_dir), 25, 4, PRODUCTION[1], PRODUCTION[0])[1]


@query()
def forecast_paths(spark, sf_dir):
    """Forecasts of the days after a fitted history, from its consensus draws; none if the gates refuse it."""
    p = event_panel(spark, sf_dir)
    posterior, _ = production.fitted_posterior(p, 25, 4, PRODUCTION[1], PRODUCTION[0])
    past = p.filter("day_index < 25")
    tasks = panel.rolling_plan(p, panel.daily_changes(panel.runs(p), 30), 20, ORIGINS, (2, 4), 6, PHASES).filter("day_index >= 25")
    ends = spark.createDataFrame([(o, (0 if ph == "am" else 144) + e) for _, o, ph, e in ORIGINS], "origin string, end int")
    clock = panel.clock_profile(past).join(panel.calibration(past), ["phase", "second"], "left").select("second", "profile", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("scale", F.lit(1.0)).alias("scale"))
    days = tasks.select("day_index").distinct()
    # A day takes 16 draws of each chain, spread evenly over the chain.
    spread = posterior.filter(F.pmod("draw", F.lit(PRODUCTION[1].draws // 16)) == 0).select("chain", "draw", "theta")
    found = forecast.forecast_days(tasks.join(F.broadcast(ends), "origin"), p, clock, days.join(F.broadcast(spread)), draws=8, paths_per_draw=8)  # 32 rows for each day
    return scores.score_samples(found).drop("draws")


@query(f"""with {PANEL}, ch as (select * from changes where day_index < 25 and change is not null), s as (select phase, second, avg(change) as mean, stddev_pop(change) as sd from ch group by 1, 2),
fl as (select phase, greatest(1e-6, 0.05 * quantile_cont(sd, 0.5)) as floor from s group by 1),
z as (select day_index, phase, second, (change - mean) / greatest(sd, floor) as z from ch join s using (phase, second) join fl using (phase)),
o as (select row_number() over (order by day_index, phase, second) - 1 as i, count(*) over () as n, z / stddev_pop(z) over () as y from z),
e as (select i - n % 2 as t, n - n % 2 as n, y from o where i >= n % 2), f as (select unnest(range(1, (select (max(n) - 1) // 2 + 1 from e))) as k),
d as (select k, n, sum(y * cos(2 * pi() * ((k * t) % n) / n)) as re, -sum(y * sin(2 * pi() * ((k * t) % n) / n)) as im from e, f group by 1, 2)
select k, round(2 * pi() * k / n, 6) as omega, round(4 * pow(sin(pi() * k / n), 2), 6) as q, round((re * re + im * im) / (2 * pi() * n), 6) as periodogram, round(re, 5) as re, round(im, 5) as im from d""")
def history_spectrum(spark, sf_dir):
    found = forecast.history_spectrum(event_panel(spark, sf_dir), 25)[0]
    return found.select("k", r6("omega").alias("omega"), r6("q").alias("q"), r6("periodogram").alias("periodogram"), F.round("re", 5).alias("re"), F.round("im", 5).alias("im"))


@query()
def arma11_map(spark, sf_dir):
    found = power(spark, sf_dir).persist()  # half as many rows as the series has, read at each step
    theta, cov, decrement = inference.fit_arma11(found, HOURS)
    row = [float(theta[0]), float(theta[1]), float(np.exp(theta[2])), float(cov[0, 0] ** 0.5), float(cov[1, 1] ** 0.5), float(decrement)]
    return spark.createDataFrame([row], "phi double, theta double, sigma2 double, phi_sd double, theta_sd double, newton_decrement double")


@query()
def ar1_map(spark, sf_dir):
    theta, cov, decrement = inference.full_grid_start(power(spark, sf_dir), HOURS)
    return spark.createDataFrame([(float(theta[0]), float(np.exp(theta[1])), float(cov[0, 0] ** 0.5), float(decrement))], "phi double, sigma2 double, phi_sd double, newton_decrement double")
