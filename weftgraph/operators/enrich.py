"""Enrichment: domains, ranges, types and subclass relations induced from statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import triple_line
from ..schemas import DOMAIN_P, LITERAL, RANGE_P, SUBCLASS_P, THING, TYPE_P
from .storage import cut


def one_type(types: DataFrame) -> DataFrame:
    """(s, type): the largest asserted type of each instance."""
    return types.groupBy("s").agg(F.max("o").alias("type"))


def votes(facts: DataFrame, types: DataFrame) -> DataFrame:
    """(p, side, type, n): how often a property's subjects (``domain``) and objects (``range``) have a type."""
    t = one_type(types)
    # statements are counted by property and end first: ends that recur meet their type once
    ends = facts.groupBy("p", F.col("s").alias("end")).agg(F.count("*").alias("n"))
    domain = ends.join(t, ends["end"] == t["s"], "left").select("p", F.lit("domain").alias("side"), F.coalesce("type", F.lit(THING)).alias("type"), "n")
    iri = F.col("o_kind").eqNullSafe("iri")
    ends = facts.select("p", iri.alias("iri"), F.when(iri, F.col("o")).alias("end")).groupBy("p", "iri", "end").agg(F.count("*").alias("n"))
    named = ends.where("iri").join(t, F.col("end") == t["s"], "left").select("p", F.lit("range").alias("side"), F.coalesce("type", F.lit(THING)).alias("type"), "n")
    literal = ends.where("NOT iri").select("p", F.lit("range").alias("side"), F.lit(LITERAL).alias("type"), "n")
    return domain.unionByName(named).unionByName(literal).groupBy("p", "side", "type").agg(F.sum("n").alias("n"))


def winners(counted: DataFrame) -> DataFrame:
    return counted.groupBy("p", "side").agg(F.min_by("type", F.struct(-F.col("n"), "type")).alias("type"), F.max("n").alias("n"))


def domains_and_ranges(facts: DataFrame, types: DataFrame) -> DataFrame:
    """(p, side, type, n) by most votes; the root class competes, and properties that it wins get none."""
    return winners(votes(facts, types)).where(F.col("type") != THING)


def object_types(facts: DataFrame, types: DataFrame, only_untyped: bool = False) -> DataFrame:
    """(s, o): for typed objects (or untyped ones, on request), the class that most of the ranges of their incoming
    properties name."""
    ranges = winners(votes(facts, types)).where((F.col("side") == "range") & ~F.col("type").isin(THING, LITERAL)).select("p", "type")
    incoming = facts.where("o_kind = 'iri'").select("o", "p").distinct()
    known = types.where(F.col("o") != THING).select(F.col("s").alias("o")).distinct()
    incoming = incoming.join(known, "o", "left_anti" if only_untyped else "left_semi")
    told = incoming.join(ranges, "p").groupBy("o", "type").agg(F.count("*").alias("n"))
    return told.groupBy(F.col("o").alias("s")).agg(F.min_by("type", F.struct(-F.col("n"), "type")).alias("o"))


def subclasses(types: DataFrame, min_types: int = 3, above: float = 0.95) -> DataFrame:
    """(sub, super, ratio) from co-occurrence: n(ab) / n(a) beyond ``above`` makes a below b (for a < b; at least
    ``above`` the other way round).

    n(x) counts statements; pairs come from instances with ``min_types`` types or more.
    """
    single = types.groupBy("o").agg(F.count("*").alias("n"))
    distinct = types.select("s", "o").distinct()
    rich = distinct.groupBy("s").agg(F.array_sort(F.collect_set("o")).alias("all")).where(F.size("all") >= min_types)  # an instance's types are few
    pairs = rich.select(F.posexplode("all").alias("i", "a"), "all").select("a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))
    both = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    out = both.join(single.select(F.col("o").alias("a"), F.col("n").alias("na")), "a").join(single.select(F.col("o").alias("b"), F.col("n").alias("nb")), "b")
    up = out.select(F.col("a").alias("sub"), F.col("b").alias("super"), (F.col("n") / F.col("na")).alias("ratio")).where(F.col("ratio") > above)
    down = out.select(F.col("b").alias("sub"), F.col("a").alias("super"), (F.col("n") / F.col("nb")).alias("ratio")).where(F.col("ratio") >= above)
    return up.unionByName(down)


def with_labels(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of both ends, null where there is none; of several the largest."""
    one = labels.groupBy("s").agg(F.max("label").alias("label"))
    for end in ("sub", "super"):
        side = one.select(F.col("s").alias(end), F.col("label").alias(f"label_{end}"))
        found = found.join(side, end, "left")
    return found


def materialize(types: DataFrame, found: DataFrame) -> DataFrame:
    """(s, o): types that follow in one step from mined subclasses and aren't asserted yet."""
    up = types.join(found.select(F.col("sub").alias("o"), F.col("super").alias("_up")), "o").select("s", F.col("_up").alias("o"))
    return up.distinct().join(types.select("s", "o").distinct(), ["s", "o"], "left_anti")


def transitive_closure(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """All (sub, super) that follow from ``edges``; paths double in each round, and cycles end by themselves."""
    now = cut(edges.select("sub", "super").distinct())
    n = now.count()
    for _ in range(most_rounds):
        ahead = now.select(F.col("sub").alias("super"), F.col("super").alias("_far"))
        now = cut(now.unionByName(now.join(ahead, "super").select("sub", F.col("_far").alias("super"))).distinct())
        more = now.count()
        if more == n:
            return now
        n = more
    raise RuntimeError("the closure did not settle")


def supported(found: DataFrame, mapping: DataFrame, closure: DataFrame) -> DataFrame:
    """Mined pairs whose ends map to classes that the target's closure relates."""
    a = mapping.select(F.col("s").alias("sub"), F.col("o").alias("_a"))
    b = mapping.select(F.col("s").alias("super"), F.col("o").alias("_b"))
    met = found.join(a, "sub").join(b, "super")
    related = closure.select(F.col("sub").alias("_a"), F.col("super").alias("_b"))
    return met.join(related, ["_a", "_b"], "left_semi").select(*found.columns).distinct()


def _statements(s, p, o) -> list:
    return [s.alias("s"), p.alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), F.lit("").alias("ext")]


def restriction_triples(found: DataFrame) -> DataFrame:
    """Domain and range statements, as triples, from (p, side, type)."""
    side = F.when(F.col("side") == "domain", F.lit(DOMAIN_P)).otherwise(F.lit(RANGE_P))
    return found.select(*_statements(F.col("p"), side, F.col("type")))


def type_triples(found: DataFrame) -> DataFrame:
    """Type statements, as triples, from (s, o)."""
    return found.select(*_statements(F.col("s"), F.lit(TYPE_P), F.col("o")))


def subclass_triples(found: DataFrame) -> DataFrame:
    """Subclass statements, as triples, from (sub, super)."""
    return found.select(*_statements(F.col("sub"), F.lit(SUBCLASS_P), F.col("super")))


def subclass_lines(found: DataFrame) -> DataFrame:
    """Lines of N-Triples from (sub, super, ratio, label_sub, label_super), each with its evidence as a comment behind."""
    line = triple_line(F.col("sub"), F.lit(SUBCLASS_P), F.col("super"), F.lit("iri"), F.lit(""))
    name = lambda c: F.concat(F.lit("<<"), F.coalesce(c, F.lit("")), F.lit(">>"))
    return found.select(F.concat_ws(" ", line, F.lit("#"), F.round("ratio", 6).cast("string"), F.lit(":"), name(F.col("label_sub")), F.lit("subclass of"), name(F.col("label_super"))).alias("value"))
