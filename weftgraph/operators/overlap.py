"""Overlap between sources: shared titles, similar names, shared values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .components import connected_components
from .storage import cut

BOUNDING_NAMES = 256
STOP_TITLES = ("Main Page", "Sandbox", "Hauptseite")


def without_stop_titles(titles: DataFrame, stop: tuple[str, ...] = STOP_TITLES) -> DataFrame:
    return titles.where(~F.col("title").isin(*stop))


def shared_titles(titles: DataFrame, least: int = 0, most_sources: int | None = None) -> DataFrame:
    """(src, dst, n, jaccard) for pairs src < dst of sources that share more than ``least`` titles.

    An equi-join on the title.  ``most_sources`` is for explicit use: it drops titles of more sources than that.
    """
    t = titles.select("domain", "title").distinct()
    if most_sources is not None:
        t = t.join(t.groupBy("title").agg(F.count("*").alias("_n")).where(F.col("_n") <= most_sources).select("title"), "title", "left_semi")
    a, b = t.select(F.col("domain").alias("src"), "title"), t.select(F.col("domain").alias("dst"), "title")
    both = a.join(b, "title").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("n")).where(F.col("n") > least)
    size = t.groupBy("domain").agg(F.count("*").alias("size"))
    out = both.join(size.select(F.col("domain").alias("src"), F.col("size").alias("n_src")), "src")
    out = out.join(size.select(F.col("domain").alias("dst"), F.col("size").alias("n_dst")), "dst")
    return out.select("src", "dst", "n", S.jaccard(F.col("n"), F.col("n_src"), F.col("n_dst")).alias("jaccard"))


def different_names(pairs: DataFrame, least: int = 100) -> DataFrame:
    """Pairs (src, dst, n, ...) that share more than ``least`` titles and whose names aren't the same but for dashes."""
    return pairs.where((F.col("n") > least) & (S.without_dashes(F.col("src")) != S.without_dashes(F.col("dst"))))


def overlap_graph(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (domain, degree, weight) and edges (src, dst, weight)."""
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("domain"), "n")
    return ends.groupBy("domain").agg(F.count("*").alias("degree"), F.sum("n").alias("weight")), pairs.select("src", "dst", F.col("n").alias("weight"))


def near_names(names: DataFrame, column: str, most: int = 1) -> DataFrame:
    """(a, b, distance) of distinct names within an edit distance, a < b.

    Names are compared only where a deletion of up to ``most`` characters can make them equal: both sides emit
    their deletion variants and join on them, so no cross product arises.
    """
    n = names.select(F.col(column).alias("name")).where("name IS NOT NULL").distinct()
    variants = n.select("name", F.array("name").alias("v"))
    for _ in range(most):
        cut = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1, F.length(x))))
        variants = variants.select("name", F.array_distinct(F.concat("v", F.flatten(F.transform("v", cut)))).alias("v"))
    v = variants.select("name", F.explode("v").alias("v"))
    met = v.select(F.col("name").alias("a"), "v").join(v.select(F.col("name").alias("b"), "v"), "v").where("a < b").select("a", "b").distinct()
    return met.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= most)


def name_clusters(names: DataFrame, column: str, most: int = 1, least_points: int = 1) -> DataFrame:
    """(name, cluster): density clusters of names by edit distance; names without enough neighbours stand alone."""
    near = near_names(names, column, most)
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    core = both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= least_points).select("a")
    links = near.join(core, "a", "left_semi").join(core.select(F.col("a").alias("b")), "b", "left_semi")
    own = names.select(F.col(column).alias("a")).where("a IS NOT NULL").distinct().select("a", F.col("a").alias("b"))
    return connected_components(links.select("a", "b").unionByName(own), "a", "b").select(F.col("node").alias("name"), F.col("component").alias("cluster"))


def best_value_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, other, n): for each key of ``left`` the keys of ``right`` that share most values, all ties; both have
    columns key, value."""
    a = left.select("key", "value").distinct()
    b = right.select(F.col("key").alias("other"), "value").distinct()
    n = a.join(b, "value").groupBy("key", "other").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("key").agg(F.max("n").alias("n")), ["key", "n"]).select("key", "other", "n")


def _nearest_in_blocks(a: DataFrame, b: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """As ``nearest_strings``, exactly: a few names bound each name's distance, and no nearer one differs more in length."""
    a = a.where("key IS NOT NULL").select("key", S.local_name(F.col("key")).alias("x"))
    b = b.where("other IS NOT NULL").select("other", S.local_name(F.col("other")).alias("y"))
    names, others = a.select("x").distinct(), b.select("y").distinct()
    few = others.orderBy(F.xxhash64("y"), "y").limit(BOUNDING_NAMES)
    parts = 1 if n_b < 100_000 else -(-n_a // 10_000)

    def within(bounds: DataFrame) -> DataFrame:
        lengths = F.sequence(F.greatest(F.length("x") - F.col("most"), F.lit(0)), F.length("x") + F.col("most"))
        probe = bounds.select("x", "most", F.explode(lengths).alias("n"), F.pmod(F.xxhash64("x"), F.lit(parts).cast("long")).alias("k"))
        build = others.select("y", F.length("y").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("k"))
        met = probe.join(F.broadcast(build) if n_b < 100_000 else build, ["n", "k"])
        return met.select("x", "y", F.expr("levenshtein(x, y, most)").alias("distance")).where("distance >= 0")

    first = names.join(F.broadcast(few)).groupBy("x").agg(F.min(F.levenshtein("x", "y")).alias("most"))
    best = cut(within(first).groupBy("x").agg(F.min("distance").alias("most")))
    return a.join(within(best), "x").join(b, "y").select("key", "other", "distance")


def nearest_strings(left: DataFrame, right: DataFrame, most_pairs: int = 50_000_000) -> DataFrame:
    """(key, other, distance): the closest local names by edit distance, all ties.

    The keys are names of a schema's properties or classes.  Up to ``most_pairs`` all are compared, beyond that in
    blocks of near lengths, with the same result.
    """
    a = left.select("key").distinct()
    b = right.select(F.col("key").alias("other")).distinct()
    n_a, n_b = a.count(), b.count()
    if n_a * n_b > most_pairs:
        return _nearest_in_blocks(a, b, n_a, n_b)
    met = a.join(F.broadcast(b) if n_b < 100_000 else b).select("key", "other", F.levenshtein(S.local_name(F.col("key")), S.local_name(F.col("other"))).alias("distance"))
    best = met.groupBy("key").agg(F.min("distance").alias("distance"))
    return met.join(best, ["key", "distance"]).select("key", "other", "distance")


def values_by_key(triples: DataFrame) -> DataFrame:
    """(key, value, n): the local names of the objects of each property; the multimap as rows, however large."""
    return triples.groupBy(F.col("p").alias("key"), S.local_name(F.col("o")).alias("value")).agg(F.count("*").alias("n"))


def schema_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, other, how): counterparts of each key by shared values and by name, and always the empty one."""
    by_value = best_value_overlap(left, right).select("key", "other", F.lit("value").alias("how"))
    by_name = nearest_strings(left, right).select("key", "other", F.lit("name").alias("how"))
    none = left.select("key", F.lit("null").alias("other"), F.lit("none").alias("how")).distinct()
    return by_value.unionByName(by_name).unionByName(none)


def sampled(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """The ``k`` rows of the smallest digest of their key: the same sample each time."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(k)
