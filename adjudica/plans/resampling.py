"""Bootstrap intervals of means, adjusted scores and differences of the derived runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.functions.answers import rounded
from adjudica.operators.resampling import percentile_interval, replicate_sums, resampled
from adjudica.operators.scoring import case_means
from adjudica.plans.decisions import decisions
from adjudica.plans.scoring import PHASES, universe
from adjudica.operators import scoring
from adjudica.registry import query
from adjudica.sources import tables
from adjudica.sources.tables import VIEWS

#: Replicates of case draws and of cluster draws.
REPLICATES, CLUSTER_REPLICATES = 2000, 10_000
_U = "CAST(floor(('0x' || substr(md5({seed} || ':' || {s} || ':' || rep || ':' || pos), 1, 13))::BIGINT / 4503599627370496.0 * m) AS BIGINT)"


def _draws(units: str, stratum: str, unit: str, seed: int, reps: int = REPLICATES) -> str:
    """SQL of the drawn units, as :func:`resampled` draws them."""
    at = _U.format(seed=f"'{seed}'", s=stratum)
    return f""", r_placed AS (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY {unit}) - 1 AS spot, count(*) OVER (PARTITION BY {stratum}) AS m FROM {units}),
r_idx AS (SELECT {stratum}, rep, {at} AS spot FROM (SELECT DISTINCT {stratum}, m FROM r_placed), (SELECT unnest(range(0, {reps})) AS rep), LATERAL (SELECT unnest(range(0, m)) AS pos)),
r_drawn AS (SELECT i.rep, p.* FROM r_idx i JOIN r_placed p USING ({stratum}, spot))"""


def _interval(value: str, by: str, source: str, reps: int = REPLICATES) -> str:
    low, high = int(reps * 0.025), int(reps * 0.975) - 1
    head = f"{by}, " if by else ""
    return f"""SELECT {head}round(avg({value}), 6) AS mean, round(max(CASE WHEN k = {low} THEN {value} END), 6) AS low, round(max(CASE WHEN k = {high} THEN {value} END), 6) AS high
FROM (SELECT *, row_number() OVER ({f"PARTITION BY {by} " if by else ""}ORDER BY {value} NULLS LAST, rep) - 1 AS k FROM {source}) {f"GROUP BY {by}" if by else ""}"""


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c)) for c in ("mean", "low", "high")})


def case_units(spark: SparkSession, sf_dir: str, question: str | None = None) -> DataFrame:
    """(phase, case_id, cluster_id, p0, p1, p2): each case's mean credit in the three runs; null where it failed."""
    rows = decisions(spark, sf_dir)
    rows = rows.where(F.col("qid") == question) if question else rows
    mean = lambda run: F.avg(F.when(F.col("run") == run, F.col("point"))).alias(f"p{run}")
    return rows.groupBy("phase", "case_id", "cluster_id").agg(*[mean(r) for r in tables.RUNS])


_UNITS = ", units AS (SELECT phase, case_id, cluster_id, avg(CASE WHEN run = 0 THEN point END) AS p0, avg(CASE WHEN run = 1 THEN point END) AS p1, avg(CASE WHEN run = 2 THEN point END) AS p2 FROM v_points {where} GROUP BY ALL)"


@query(VIEWS + ", v_means AS (SELECT run, case_id, avg(point) * 100 AS points FROM v_points WHERE NOT err GROUP BY ALL)" + _draws("v_means", "run", "case_id", 0) + ", reps AS (SELECT run, rep, avg(points) AS v FROM r_drawn GROUP BY ALL) " + _interval("v", "run", "reps"))
def bootstrap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = case_means(decisions(spark, sf_dir).where("NOT err")).select("run", "case_id", (F.col("points") * 100).alias("points"))
    reps = replicate_sums(units, "run", "case_id", ["points"], REPLICATES, 0).select("run", "rep", F.try_divide("sum_points", "count_points").alias("v"))
    return _shown(percentile_interval(reps, ["run"], "v", REPLICATES))


def _gains(spark: SparkSession, sf_dir: str, seed: int) -> DataFrame:
    """(rep, g0, g1, g2): each replicate's adjusted score of each run, cases drawn within phases, all runs alike."""
    base = scoring.majority_baseline(universe(spark, sf_dir))
    points = [f"p{r}" for r in tables.RUNS]
    drawn = replicate_sums(case_units(spark, sf_dir), "phase", "case_id", points, REPLICATES, seed)
    by_phase = drawn.select("rep", "phase", *[(F.try_divide(f"sum_{p}", f"count_{p}") * 100).alias(p) for p in points]).join(F.broadcast(base), "phase").where("base < 100")
    return by_phase.groupBy("rep").agg(*[F.avg((F.col(f"p{r}") - F.col("base")) / (100 - F.col("base")) * 100).alias(f"g{r}") for r in tables.RUNS])


def _gain_sql(seed: int) -> str:
    parts = ", ".join(f"avg((p{r} - base) / (100 - base) * 100) AS g{r}" for r in tables.RUNS)
    means = ", ".join(f"avg(p{r}) * 100 AS p{r}" for r in tables.RUNS)
    return PHASES + _UNITS.format(where="") + _draws("units", "phase", "case_id", seed) + f", by_phase AS (SELECT rep, phase, {means} FROM r_drawn GROUP BY ALL), gains AS (SELECT rep, {parts} FROM by_phase JOIN v_base USING (phase) WHERE base < 100 GROUP BY rep) "


@query(_gain_sql(1) + ", long AS (SELECT rep, 0 AS run, g0 AS v FROM gains UNION ALL SELECT rep, 1, g1 FROM gains UNION ALL SELECT rep, 2, g2 FROM gains) " + _interval("v", "run", "long"))
def adjusted_boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.array(*[F.struct(F.lit(r).alias("run"), F.col(f"g{r}").alias("v")) for r in tables.RUNS])
    long = _gains(spark, sf_dir, 1).select("rep", F.explode(runs).alias("x")).select("rep", "x.run", "x.v")
    return _shown(percentile_interval(long, ["run"], "v", REPLICATES))


@query(_gain_sql(2) + ", long AS (SELECT rep, 'range' AS stat, greatest(g0, g1, g2) - least(g0, g1, g2) AS v FROM gains UNION ALL SELECT rep, 'mean', (g0 + g1 + g2) / 3 FROM gains) " + _interval("v", "stat", "long"))
def range_boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range and mean of the runs' adjusted scores over the same draws."""
    g = [F.col(f"g{r}") for r in tables.RUNS]
    return joint_stats(_gains(spark, sf_dir, 2), {"range": F.greatest(*g) - F.least(*g), "mean": (g[0] + g[1] + g[2]) / 3})


def joint_stats(gains: DataFrame, stats: dict[str, Column]) -> DataFrame:
    """(stat, mean, low, high) of any expressions over the runs' scores of a replicate."""
    listed = F.array(*[F.struct(F.lit(n).alias("stat"), x.alias("v")) for n, x in stats.items()])
    long = gains.select("rep", F.explode(listed).alias("x")).select("rep", "x.stat", "x.v")
    return _shown(percentile_interval(long, ["stat"], "v", REPLICATES))


@query(_gain_sql(3) + ", long AS (SELECT rep, 'interaction' AS stat, (g0 - g1) - (g1 - g2) AS v FROM gains) " + _interval("v", "stat", "long"))
def interaction_boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    g0, g1, g2 = (F.col(f"g{r}") for r in tables.RUNS)
    return joint_stats(_gains(spark, sf_dir, 3), {"interaction": (g0 - g1) - (g1 - g2)})


def cluster_deltas(units: DataFrame, seed: int) -> DataFrame:
    """(rep, v): phase-weighted difference of run 1 from run 0 when clusters are drawn.

    Cases are folded to one row a cluster and phase first.  A replicate in which a phase is empty has no value.
    """
    both = units.where("p0 IS NOT NULL AND p1 IS NOT NULL").groupBy("cluster_id", "phase").agg(F.sum(F.col("p1") - F.col("p0")).alias("d"), F.count("*").alias("n"))
    n_phases = units.select("phase").distinct().count()
    drawn = resampled(units.select("cluster_id", F.lit("all").alias("stratum")).distinct(), "stratum", "cluster_id", CLUSTER_REPLICATES, seed)
    by_phase = drawn.join(both, "cluster_id").groupBy("rep", "phase").agg((F.sum("d") / F.sum("n") * 100).alias("d"))
    return by_phase.groupBy("rep").agg(F.when(F.count("*") == n_phases, F.avg("d")).alias("v"))


def _cluster_sql(seed: int, where: str = "") -> str:
    return VIEWS + _UNITS.format(where=where) + ", folded AS (SELECT cluster_id, phase, sum(p1 - p0) AS d, count(*) AS n FROM units WHERE p0 IS NOT NULL AND p1 IS NOT NULL GROUP BY ALL), cl AS (SELECT DISTINCT cluster_id, 'all' AS stratum FROM units)" + _draws("cl", "stratum", "cluster_id", seed, CLUSTER_REPLICATES) + ", by_phase AS (SELECT rep, phase, sum(d) / sum(n) * 100 AS d FROM r_drawn JOIN folded USING (cluster_id) GROUP BY ALL), deltas AS (SELECT rep, CASE WHEN count(*) = (SELECT count(DISTINCT phase) FROM units) THEN avg(d) END AS v FROM by_phase GROUP BY rep) "


@query(_cluster_sql(271828) + _interval("v", "", "deltas", CLUSTER_REPLICATES))
def cluster_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(percentile_interval(cluster_deltas(case_units(spark, sf_dir), 271828), [], "v", CLUSTER_REPLICATES))


@query(_cluster_sql(5, "WHERE qid = 'quality'") + _interval("v", "", "deltas", CLUSTER_REPLICATES))
def question_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for one question."""
    return _shown(percentile_interval(cluster_deltas(case_units(spark, sf_dir, "quality"), 5), [], "v", CLUSTER_REPLICATES))


@query(VIEWS + ", cl AS (SELECT run, cluster_id, sum(CASE WHEN gt = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN gt = 1 AND value >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END) AS tp FROM v_binary WHERE qid = 'quality' AND NOT err GROUP BY ALL)" + _draws("cl", "run", "cluster_id", 9, CLUSTER_REPLICATES) + ", reps AS (SELECT run, rep, CAST(sum(tp) AS DOUBLE) / nullif(sum(pos), 0) AS v FROM r_drawn GROUP BY ALL) " + _interval("v", "run", "reps", CLUSTER_REPLICATES))
def cluster_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the sensitivity when clusters are drawn."""
    truth, alert = F.col("gt") == 1, F.col("value") >= 0.5
    units = tables.binary(spark, sf_dir).where("qid = 'quality' AND NOT err").groupBy("run", "cluster_id").agg(F.count_if(truth).alias("pos"), F.count_if(truth & alert).alias("tp"))
    reps = resampled(units, "run", "cluster_id", CLUSTER_REPLICATES, 9).groupBy("run", "rep").agg(F.try_divide(F.sum("tp").cast("double"), F.sum("pos").cast("double")).alias("v"))
    return _shown(percentile_interval(reps, ["run"], "v", CLUSTER_REPLICATES))
