"""Graph statistics, profiles of metadata tables, and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .storage import cut


def statements_and_subjects(triples: DataFrame, by: list[str] | None = None) -> DataFrame:
    return triples.groupBy(*(by or [])).agg(F.count("*").alias("statements"), F.count_distinct("s").alias("subjects"))


def degrees(facts: DataFrame, others: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """(node, in_degree, out_degree): all statements lead out of their subject; IRI objects of ``facts`` are led into."""
    by = by or []
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    parts = facts.where("o_kind = 'iri'").select(*by, F.col("o").alias("node"), one.alias("i"), zero.alias("u"))
    for df in [facts] + ([others] if others is not None else []):
        parts = parts.unionByName(df.select(*by, F.col("s").alias("node"), zero.alias("i"), one.alias("u")))
    return parts.groupBy(*by, "node").agg(F.sum("i").alias("in_degree"), F.sum("u").alias("out_degree"))


def degree_averages(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    n = F.count("*")
    return found.groupBy(*(by or [])).agg(
        n.alias("nodes"),
        F.sum("in_degree").alias("in_total"),
        F.sum("out_degree").alias("out_total"),
        F.round(F.sum("in_degree") / n, 6).alias("in_average"),
        F.round(F.sum("out_degree") / n, 6).alias("out_average"),
    )


def type_statements(types: DataFrame) -> DataFrame:
    return types.select("s", "o").distinct().agg(F.count("*").alias("pairs"), F.count_distinct("s").alias("instances"), F.count_distinct("o").alias("classes"))


def type_histogram(types: list[DataFrame], labels: DataFrame) -> DataFrame:
    """(type, n, label) over all parts together, with a default where a type has no label."""
    every = types[0].select("o")
    for df in types[1:]:
        every = every.unionByName(df.select("o"))
    counted = every.groupBy(F.col("o").alias("type")).agg(F.count("*").alias("n"))
    one = labels.groupBy(F.col("s").alias("type")).agg(F.max("label").alias("label"))
    return counted.join(one, "type", "left").withColumn("label", F.coalesce("label", F.lit("No label"))).orderBy(F.desc("n"), "type")


def frequency(df: DataFrame, column: str | Column, missing: str | None = None, top: int | None = None) -> DataFrame:
    """(value, n), most frequent first."""
    value = F.col(column) if isinstance(column, str) else column
    if missing is not None:
        value = F.coalesce(value.cast("string"), F.lit(missing))
    out = df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out if top is None else out.limit(top)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: count, mean, standard deviation, minimum, exact quartiles, maximum."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v"))
    x = F.col("v.x")
    return stacked.groupBy(F.col("v.name").alias("name")).agg(
        F.count(x).alias("n"),
        F.round(F.avg(x), 4).alias("mean"),
        F.round(F.stddev(x), 4).alias("std"),
        F.min(x).alias("min"),
        *[F.round(F.percentile(x, p), 4).alias(f"q{int(100 * p)}") for p in (0.25, 0.5, 0.75)],
        F.max(x).alias("max"),
    )


def sums(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.round(F.sum(c), 2).alias(f"sum_{c}") for c in columns])


def monthly(df: DataFrame, ts: Column) -> DataFrame:
    """(month, n) by last day of the month, months without rows included."""
    counted = df.select(F.last_day(ts).alias("month")).groupBy("month").agg(F.count("*").alias("n"))
    ends = counted.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a IS NOT NULL")
    every = ends.select(F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("INTERVAL 1 MONTH"))).alias("m"))
    return every.select(F.last_day("m").alias("month")).join(counted, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def rank_series(df: DataFrame, value: str, key: str) -> DataFrame:
    """(key, value, rank) from the largest value on; equal values by key.

    Rows are sorted into ranges and numbered within each; what lies before a range is a sum over ranges, a row each.
    """
    order = [F.desc(value), F.asc(key)]
    ranged = cut(df.select(key, value).repartitionByRange(*order).select(key, value, F.spark_partition_id().alias("_range")))
    listed = ranged.groupBy("_range").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("_range", "n"))).alias("all"))
    sums = F.aggregate("all", F.array(F.lit(0).cast("long")), lambda s, x: F.array_append(s, F.element_at(s, -1) + x["n"]))
    before = listed.select(F.explode(F.arrays_zip(F.col("all._range").alias("_range"), F.slice(sums, 1, F.size("all")).alias("_base"))).alias("x")).select("x.*")
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_nth", nth).join(before, "_range").select(key, value, (F.col("_base") + F.col("_nth")).alias("rank"))


def functional_dependence(df: DataFrame, a: str, b: str) -> DataFrame:
    """(side, value, others): how many values of the other column go with each value, both ways."""
    one = df.groupBy(F.col(a).alias("value")).agg(F.count_distinct(b).alias("others")).withColumn("side", F.lit(a))
    two = df.groupBy(F.col(b).alias("value")).agg(F.count_distinct(a).alias("others")).withColumn("side", F.lit(b))
    return one.unionByName(two).select("side", "value", "others")


def duplicate_contents(df: DataFrame, key: str, content: str) -> DataFrame:
    """(digest, members, first) of contents that several rows share."""
    counted = df.groupBy(F.md5(content).alias("digest")).agg(F.count("*").alias("members"), F.min(key).alias("first"))
    return counted.where("members > 1")


def same_files(files: DataFrame) -> DataFrame:
    """(digest, path) of files (path, content) whose contents several have.  Contents are compared by their first bytes
    first, so most are never digested."""
    near = files.groupBy(S.first_bytes(F.col("content")).alias("_start")).agg(F.count("*").alias("n")).where("n > 1").select("_start")
    some = files.withColumn("_start", S.first_bytes(F.col("content"))).join(near, "_start").select(S.content_digest(F.col("content")).alias("digest"), "path")
    return some.join(some.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "digest")


def linked_duplicates(same: DataFrame, crawl: DataFrame) -> DataFrame:
    """(digest, names): of each group (digest, wiki_id, name) of equal dumps, those whose site still links a dump (id,
    url), where more than one does."""
    linked = crawl.where("url <> ''").select(F.col("id").alias("wiki_id")).distinct()
    named = same.join(linked, "wiki_id", "left_semi").groupBy("digest").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"), F.count("*").alias("n"))
    return named.where("n > 1").select("digest", "names")


def last_standing(probes: DataFrame) -> DataFrame:
    """(group, candidate, hits) of the candidates that are left when, round by round, those short of the most hits so far
    drop out; ``probes`` has group, candidate, round, hit (0 or 1).

    Among equals so far, most hits so far means a hit in this round: the survivors are those whose row of hits, in
    order of rounds, is the largest of their group.
    """
    rows = probes.groupBy("group", "candidate").agg(F.transform(F.array_sort(F.collect_list(F.struct("round", "hit"))), lambda x: x["hit"]).alias("row"))
    best = rows.groupBy("group").agg(F.max("row").alias("row"))
    return rows.join(best, ["group", "row"]).select("group", "candidate", F.aggregate("row", F.lit(0).cast("long"), lambda a, x: a + x).alias("hits"))
