"""Comparison of runs: paired joins, agreement, discordance, kappa, probability shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjudica.functions.answers import decision_label
from adjudica.functions.intervals import mcnemar_p

KEYS = ["phase", "case_id", "qid"]


def said(decisions: DataFrame, run: int, suffix: str) -> DataFrame:
    """One run's usable decisions, refused and failed ones left out, with suffixed columns."""
    rows = decisions.where((F.col("run") == run) & ~F.col("err") & ~F.col("refused"))
    label = decision_label(F.col("qtype"), F.col("label"), F.col("value"))
    return rows.select(*KEYS, label.alias(f"said_{suffix}"), "gt" if suffix == "a" else F.col("gt").alias("gt_b"), (F.col("point") == 1.0).alias(f"hit_{suffix}"))


def paired(decisions: DataFrame, a: int, b: int) -> DataFrame:
    """Decisions that both runs made, one row each."""
    return said(decisions, a, "a").join(said(decisions, b, "b"), KEYS)


def discordance(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, only_ref, only_run, p): right in one run only, and the exact two-sided p."""
    a, b = F.col("hit_a"), F.col("hit_b")
    counts = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(a & ~b).alias("only_ref"), F.count_if(b & ~a).alias("only_run"))
    return counts.withColumn("p", mcnemar_p("only_ref", "only_run"))


def kappa(rows: DataFrame, by: list[str], a: str, b: str, ordinal: bool = False) -> DataFrame:
    """(by, n, kappa) of two labels a row: unweighted, or with linear weights over the sorted numeric categories.

    Null for fewer than two categories; 1 where no disagreement is expected.  Works on counts of label pairs, so rows are
    folded before anything is joined.
    """
    table = rows.groupBy(*by, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("c"))
    ends = table.select(*by, F.explode(F.array("x", "y")).alias("v")).distinct()
    key = F.col("v").try_cast("double") if ordinal else F.col("v")
    listed = ends.groupBy(*by).agg(F.array_sort(F.collect_set(key)).alias("cats"))
    place = lambda v: F.array_position("cats", v.try_cast("double") if ordinal else v)
    gap = (F.abs(place(F.col("x")) - place(F.col("y"))) / (F.size("cats") - 1)) if ordinal else (F.col("x") != F.col("y")).cast("double")
    totals = table.groupBy(*by).agg(F.sum("c").alias("n"))
    observed = table.join(listed, by).where(F.size("cats") > 1).groupBy(*by).agg(F.sum(gap * F.col("c")).alias("o"))
    rows_of, columns_of = table.groupBy(*by, "x").agg(F.sum("c").alias("cx")), table.groupBy(*by, "y").agg(F.sum("c").alias("cy"))
    expected = rows_of.join(columns_of, by).join(listed, by).where(F.size("cats") > 1).groupBy(*by).agg(F.sum(gap * F.col("cx") * F.col("cy")).alias("e"))
    rate = F.when(F.col("e") == 0, F.lit(1.0)).otherwise(1 - F.col("o") * F.col("n") / F.col("e"))
    return totals.join(observed, by, "left").join(expected, by, "left").select(*by, "n", F.when(F.col("e").isNotNull(), rate).alias("kappa"))


def option_shift(options: DataFrame, a: int, b: int, by: list[str]) -> DataFrame:
    """(by, n, mean_abs, max_abs, n_moved): change of the probabilities that both runs give an option."""
    ok = options.where(~F.col("err"))
    left = ok.where(F.col("run") == a).select("phase", "case_id", "opt", F.col("p").alias("pa"))
    right = ok.where(F.col("run") == b).select("phase", "case_id", "opt", F.col("p").alias("pb"))
    move = F.abs(F.col("pa") - F.col("pb"))
    return left.join(right, ["phase", "case_id", "opt"]).groupBy(*by).agg(F.count("*").alias("n"), F.avg(move).alias("mean_abs"), F.max(move).alias("max_abs"), F.count_if(move > 1e-3).alias("n_moved"))


def votes(decisions: DataFrame) -> DataFrame:
    """(phase, case_id, qid, gt, modal, share): the label that most runs give; of equal counts, that of the first run."""
    made = decisions.where(~F.col("err") & ~F.col("refused")).withColumn("said", decision_label(F.col("qtype"), F.col("label"), F.col("value")))
    counts = made.groupBy(*KEYS, "gt", "said").agg(F.count("*").alias("c"), F.min("run").alias("first"))
    return counts.groupBy(*KEYS, "gt").agg(F.max_by("said", F.struct("c", -F.col("first"))).alias("modal"), (F.max("c") / F.sum("c")).alias("share"))


def presence(a: Column, b: Column) -> Column:
    """Where an id of a full outer join stands."""
    return F.when(a.isNotNull() & b.isNotNull(), "both").when(a.isNotNull(), "only_a").otherwise("only_b")


def lowest(rows: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """The ``k`` rows of each ``by`` that come first in ``order``.

    Each of 64 parts of a group, dealt by a hash of the row's place in the order, keeps its own ``k``; only those meet.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(64))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    few = rows.withColumn("_part", part).withColumn("_rank", rank(by, "_part")).where(F.col("_rank") <= k).drop("_part")
    return few.withColumn("_rank", rank(by)).where(F.col("_rank") <= k).drop("_rank")
