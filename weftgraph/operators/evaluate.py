"""Evaluation of alignments against gold standards, all pairs of sources at once.

``gold`` and ``system`` have columns ``pair, source, target, relation, confidence``; ``'null'`` means "no
counterpart".  A partial gold standard judges only what it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def precision(tp: Column, fp: Column) -> Column:
    return F.when(tp + fp == 0, 1.0).otherwise(tp / (tp + fp))


def recall(tp: Column, fn: Column) -> Column:
    return F.when(tp + fn == 0, 1.0).otherwise(tp / (tp + fn))


def f_measure(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def by_kind(alignment: DataFrame) -> DataFrame:
    return alignment.withColumn("kind", S.kind_of(F.col("source"), F.col("target")))


def at_least(alignment: DataFrame, threshold: float) -> DataFrame:
    return alignment.where(F.col("confidence") >= threshold)


def target_in_domain(alignment: DataFrame, domain: Column) -> DataFrame:
    return alignment.where(S.resource_domain(F.col("target")) == domain)


def counts(system: DataFrame, gold: DataFrame, by: list[str], unique_source: bool = True, unique_target: bool = True) -> DataFrame:
    """tp, fp, fn per group of ``by`` (which holds ``pair``).

    A gold cell without target counts the system's targets of its source as false; one without source, the sources
    of its target; a missed cell both, as far as the sides are assumed to be free of duplicates.
    """
    links = system.where("relation = '='").select(*by, "source", "target").distinct()
    by_source = links.groupBy(*by, "source").agg(F.count("*").alias("n_s"))
    by_target = links.groupBy(*by, "target").agg(F.count("*").alias("n_t"))
    cells = gold.select(*by, "source", "target")
    met = (
        cells.join(links.withColumn("hit", F.lit(1)), [*by, "source", "target"], "left")
        .join(by_source, [*by, "source"], "left")
        .join(by_target, [*by, "target"], "left")
        .fillna(0, ["hit", "n_s", "n_t"])
    )
    no_target, no_source = F.col("target") == "null", F.col("source") == "null"
    full = ~no_target & ~no_source
    missed = (F.col("n_t") if unique_source else F.lit(0)) + (F.col("n_s") if unique_target else F.lit(0))
    false = F.when(no_target, F.col("n_s")).when(no_source, F.col("n_t")).when(F.col("hit") == 0, missed).otherwise(0)
    return met.groupBy(*by).agg(
        F.sum(F.when(full & (F.col("hit") == 1), 1).otherwise(0)).alias("tp"),
        F.sum(false).cast("long").alias("fp"),
        F.sum(F.when(full & (F.col("hit") == 0), 1).otherwise(0)).alias("fn"),
    )


def scores(found: DataFrame) -> DataFrame:
    p, r = precision(F.col("tp"), F.col("fp")), recall(F.col("tp"), F.col("fn"))
    return found.withColumn("precision", p).withColumn("recall", r).withColumn("f", f_measure(F.col("precision"), F.col("recall")))


def full_gold(system: DataFrame, gold: DataFrame) -> DataFrame:
    """Per pair, against a gold standard that is complete: every system row counts as predicted."""
    want = gold.select("pair", "source", "target").distinct().withColumn("hit", F.lit(1))
    made = system.select("pair", "source", "target").join(want, ["pair", "source", "target"], "left").groupBy("pair")
    made = made.agg(F.count("*").alias("predicted"), F.sum(F.coalesce("hit", F.lit(0))).alias("tp"))
    wanted = gold.groupBy("pair").agg(F.count("*").alias("actual"))
    out = wanted.join(made, "pair", "left").fillna(0, ["predicted", "tp"])
    return scores(out.select("pair", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("actual") - F.col("tp")).alias("fn")))


def micro_macro(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Micro averages from summed counts; macro F is the harmonic mean of macro precision and macro recall."""
    out = scored.groupBy(*(by or [])).agg(
        F.avg("precision").alias("macro_p"), F.avg("recall").alias("macro_r"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")
    )
    out = out.withColumn("macro_f", f_measure(F.col("macro_p"), F.col("macro_r")))
    out = out.withColumn("micro_p", precision(F.col("tp"), F.col("fp"))).withColumn("micro_r", recall(F.col("tp"), F.col("fn")))
    return out.withColumn("micro_f", f_measure(F.col("micro_p"), F.col("micro_r"))).drop("tp", "fp", "fn")


def thresholds(system: DataFrame) -> DataFrame:
    return system.select(F.round("confidence", 2).alias("threshold")).distinct()


def _cents(confidence: Column) -> Column:
    """The largest threshold of two decimals, in hundredths, that a confidence reaches."""
    near = F.round(confidence, 2)
    return F.round(near * 100).cast("long") - F.when(confidence < near, 1).otherwise(0)


def counts_by_threshold(system: DataFrame, gold: DataFrame) -> DataFrame:
    """(pair, threshold, tp, fp, fn): ``counts`` of every pair in ``gold`` at every threshold of ``system``.

    Each link is counted once, at the confidence it has; figures at a threshold are sums over that and what lies above.
    A missed cell's false links are those above its own link's confidence, so a hit takes them back from there down.
    """
    links = system.where("relation = '=' AND confidence IS NOT NULL").groupBy("pair", "source", "target").agg(_cents(F.max("confidence")).alias("at"))
    cells = gold.select("pair", "source", "target").join(links.withColumnRenamed("at", "hit"), ["pair", "source", "target"], "left")
    no_target, no_source = F.col("target") == "null", F.col("source") == "null"
    full = cells.where(~no_target & ~no_source)
    hits = full.where("hit IS NOT NULL").select("pair", F.col("hit").alias("at"), F.lit(1).alias("tp"), F.lit(0).alias("fp"))
    parts = [hits]
    for end, alone in (("source", no_target), ("target", ~no_target & no_source)):
        met = links.groupBy("pair", end, "at").agg(F.count("*").alias("n"))
        plain = cells.where(alone).groupBy("pair", end).agg(F.count("*").alias("k")).join(met, ["pair", end])
        parts.append(plain.select("pair", "at", F.lit(0).alias("tp"), (F.col("k") * F.col("n")).alias("fp")))
        missed = full.groupBy("pair", end, "hit").agg(F.count("*").alias("k")).join(met, ["pair", end]).where("hit IS NULL OR at > hit")
        wrong = (F.col("k") * F.col("n")).alias("fp")
        parts.append(missed.select("pair", "at", F.lit(0).alias("tp"), wrong))
        parts.append(missed.where("hit IS NOT NULL").select("pair", F.col("hit").alias("at"), F.lit(0).alias("tp"), (-wrong).alias("fp")))
    events = parts[0]
    for part in parts[1:]:
        events = events.unionByName(part)
    events = events.groupBy("pair", "at").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    # one row of all thresholds, two decimals each: every pair gets a mark at each
    grid = thresholds(system).where("threshold IS NOT NULL").agg(F.collect_list("threshold").alias("all"))
    sizes = gold.groupBy("pair").agg(F.sum(F.when(~no_target & ~no_source, 1).otherwise(0)).alias("cells"))
    marks = sizes.join(grid).select("pair", "cells", F.explode("all").alias("threshold"))
    marks = marks.select("pair", F.round(F.col("threshold") * 100).cast("long").alias("at"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), "cells", "threshold")
    none = [F.lit(None).cast("long").alias("cells"), F.lit(None).cast("double").alias("threshold")]
    above = Window.partitionBy("pair").orderBy(F.desc("at"))  # of equal values all
    summed = marks.unionByName(events.select("*", *none)).withColumns({"tp": F.sum("tp").over(above), "fp": F.sum("fp").over(above)})
    return summed.where("threshold IS NOT NULL").select("pair", "threshold", "tp", F.col("fp").cast("long").alias("fp"), (F.col("cells") - F.col("tp")).alias("fn"))


def leave_one_out(system: DataFrame, gold: DataFrame) -> DataFrame:
    """(pair, threshold, tp, fp, fn, precision, recall, f): each pair judged at the threshold that gives the others the
    best macro F (ties: the smallest; none to choose from: 0, which keeps all).

    One aggregation scores every (pair, threshold); a fold's training figures are then its totals over all pairs
    less the fold's own.
    """
    pairs = gold.select("pair").distinct()
    scored = scores(counts_by_threshold(system, gold)).select("pair", "threshold", "tp", "fp", "fn", "precision", "recall", "f")
    own = system.select("pair", F.round("confidence", 2).alias("threshold")).distinct()  # a fold's candidates come from the others
    own = own.withColumn("mine", F.lit(1))
    holders = own.groupBy("threshold").agg(F.count("*").alias("holders"))
    totals = scored.groupBy("threshold").agg(F.sum("precision").alias("sp"), F.sum("recall").alias("sr"), F.count("*").alias("k"))
    folds = scored.join(totals, "threshold").join(holders, "threshold").join(own, ["pair", "threshold"], "left")
    others = F.col("k") - 1
    p, r = F.try_divide(F.col("sp") - F.col("precision"), others), F.try_divide(F.col("sr") - F.col("recall"), others)
    folds = folds.where((F.col("holders") - F.coalesce("mine", F.lit(0)) > 0) & (others > 0)).withColumn("train_f", F.round(f_measure(p, r), 9))
    chosen = folds.groupBy("pair").agg(F.max_by("threshold", F.struct("train_f", -F.col("threshold"))).alias("threshold"))
    picked = chosen.join(scored, ["pair", "threshold"])
    rest = pairs.join(chosen, "pair", "left_anti")
    whole = scores(counts(system, gold, ["pair"])).join(rest, "pair").withColumn("threshold", F.lit(0.0))
    return picked.unionByName(whole.select(*picked.columns))
