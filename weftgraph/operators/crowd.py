"""Crowd answers: pivots for questions, votes, agreement, and alignments made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def question_rows(titles: DataFrame, per_hit: int = 10) -> DataFrame:
    """(domain, hit, raw_0..): each source's titles, in order of their hash, cut into hits and pivoted to columns."""
    order = Window.partitionBy("domain").orderBy("h", "title")
    numbered = titles.select("domain", "title", F.md5(F.concat_ws("|", "domain", "title")).alias("h")).distinct()
    placed = numbered.withColumn("i", F.row_number().over(order) - 1)
    placed = placed.select("domain", F.floor(F.col("i") / per_hit).alias("hit"), (F.col("i") % per_hit).alias("item"), "title")
    return placed.groupBy("domain", "hit").pivot("item", list(range(per_hit))).agg(F.first("title")).select("domain", "hit", *[F.col(str(i)).alias(f"raw_{i}") for i in range(per_hit)])


def title_sample(titles: DataFrame, redirects: DataFrame, k: int, reject: str = "disambiguation") -> DataFrame:
    """(domain, title): ``k`` titles of each source by the hash of their name, redirects replaced by their targets,
    without titles that contain ``reject``.

    A source's candidates are cut to their ``k`` smallest hashes by a window; Spark limits ranks before its shuffle.
    """
    to = redirects.groupBy("domain", "title").agg(F.max("target").alias("target"))
    moved = titles.join(to, ["domain", "title"], "left").select("domain", F.coalesce("target", "title").alias("title")).distinct()
    named = moved.where(~F.contains(F.lower("title"), F.lit(reject))).withColumn("h", F.md5(F.concat_ws("|", "domain", "title")))
    order = Window.partitionBy("domain").orderBy("h", "title")
    return named.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).select("domain", "title")


def answers(batch: DataFrame, items: int = 10, targets: int = 2) -> DataFrame:
    """``Answer.{i}_mapping_dst{n}`` columns as rows (hit, worker, item, dst, answer)."""
    cells = [F.struct(F.lit(i).alias("item"), F.lit(n).alias("dst"), F.col(f"`Answer.{i}_mapping_dst{n}`").alias("answer")) for i in range(items) for n in range(1, targets + 1)]
    return batch.select(F.col("HITId").alias("hit"), F.col("WorkerId").alias("worker"), F.explode(F.array(*cells)).alias("x")).select("hit", "worker", "x.*")


def complete_hits(votes: DataFrame, assignments: int = 5) -> DataFrame:
    full = votes.groupBy("hit").agg(F.count_distinct("worker").alias("n")).where(F.col("n") == assignments)
    return votes.join(full.select("hit"), "hit", "left_semi")


def valid_answers(votes: DataFrame, domain: str = "domain") -> DataFrame:
    """Answers that are ``no match`` or within the expected domain."""
    return votes.where((F.col("answer") == "no match") | F.col("answer").startswith(F.col(domain)))


def rejected_answers(votes: DataFrame, domain: str = "domain") -> DataFrame:
    """What ``valid_answers`` leaves out, for a report."""
    return votes.where(~F.coalesce((F.col("answer") == "no match") | F.col("answer").startswith(F.col(domain)), F.lit(False)))


def majority(votes: DataFrame, by: list[str]) -> DataFrame:
    """(by..., answer, n): the most frequent answer; ties by the smaller answer."""
    n = votes.groupBy(*by, "answer").agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.min_by("answer", F.struct(-F.col("n"), "answer")).alias("answer"), F.max("n").alias("n"))


def transitive_links(decided: DataFrame) -> DataFrame:
    """(hit, item, source, target, relation) between the answers for two targets of one item: a link where both were
    found, a "no counterpart" where one was."""
    one = decided.where("dst = 1").select("hit", "item", F.col("answer").alias("a"))
    two = decided.where("dst = 2").select("hit", "item", F.col("answer").alias("b"))
    none = "no match"
    met = one.join(two, ["hit", "item"]).where(f"NOT (a = '{none}' AND b = '{none}')")
    end = lambda c: F.when(F.col(c) == none, "null").otherwise(F.col(c))
    relation = F.when((F.col("a") == none) | (F.col("b") == none), "%").otherwise("=")
    return met.select("hit", "item", end("a").alias("source"), end("b").alias("target"), relation.alias("relation"))


def oriented(alignment: DataFrame) -> DataFrame:
    """(domain_a, source) <-> (domain_b, target) with the smaller domain first, ends swapped where needed, as distinct
    rows."""
    swap = F.col("domain_a") > F.col("domain_b")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return alignment.select(
        pick("domain_a", "domain_b").alias("domain_a"),
        pick("domain_b", "domain_a").alias("domain_b"),
        pick("source", "target").alias("source"),
        pick("target", "source").alias("target"),
        "relation",
    ).distinct()


def agreement(votes: DataFrame) -> DataFrame:
    """(kappa, multi_kappa, scott_pi, alpha) of coders who label items: ``votes`` has item, coder, label.

    Means over pairs of coders; chance agreement by each coder's own labels (kappa, multi-kappa) or by all labels
    (pi); Krippendorff's alpha for nominal labels.
    """
    v = votes.select("item", "coder", "label")
    w = v.select("item", F.col("coder").alias("c2"), F.col("label").alias("l2"))
    same = v.join(w, "item").where("coder < c2").groupBy("coder", "c2").agg(F.avg((F.col("label") == F.col("l2")).cast("double")).alias("ao"))
    total = v.groupBy("coder").agg(F.count("*").alias("n"))
    share = v.groupBy("coder", "label").agg(F.count("*").alias("k")).join(total, "coder").select("coder", "label", (F.col("k") / F.col("n")).alias("p"))
    other = share.select(F.col("coder").alias("c2"), "label", F.col("p").alias("p2"))
    chance = share.join(other, "label").where("coder < c2").groupBy("coder", "c2").agg(F.sum(F.col("p") * F.col("p2")).alias("ae"))
    pairs = same.join(chance, ["coder", "c2"], "left").fillna(0.0, ["ae"])
    ratio = lambda a, e: F.try_divide(a - e, 1 - e)
    means = pairs.agg(F.avg(ratio(F.col("ao"), F.col("ae"))).alias("kappa"), F.avg("ao").alias("o"), F.avg("ae").alias("e"))
    labels = v.groupBy("label").agg(F.count("*").alias("k"))
    everything = labels.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.sum(F.col("k") * (F.col("k") - 1)).alias("pairs"))
    per_item = v.groupBy("item", "label").agg(F.count("*").alias("k")).groupBy("item").agg(F.sum("k").alias("m"), F.sum(F.col("k") * (F.col("k") - 1)).alias("agree"))
    observed = per_item.where("m > 1").agg(F.sum(F.col("agree") / (F.col("m") - 1)).alias("agree"), F.sum("m").alias("pairable"))
    one = means.join(everything).join(observed)  # one row each
    n = F.col("n").cast("double")
    return one.select(
        F.round("kappa", 6).alias("kappa"),
        F.round(ratio(F.col("o"), F.col("e")), 6).alias("multi_kappa"),
        F.round(ratio(F.col("o"), F.col("squares") / (n * n)), 6).alias("scott_pi"),
        F.round(1 - F.try_divide(1 - F.col("agree") / F.col("pairable"), 1 - F.col("pairs") / (n * (n - 1))), 6).alias("alpha"),
    )
