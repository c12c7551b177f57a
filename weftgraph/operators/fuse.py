"""Fusion: equivalence classes of URIs, their canonical names, and triples rewritten by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .bits import split_by_bitmap
from .components import components_by_blocks
from .storage import cut

# which positions of a data set's triples are rewritten (fixed values)
SUBJECT = ("anchor-text", "category-labels", "homepages", "infobox-property-definitions", "labels", "long-abstracts", "short-abstracts", "template-type-definitions")
SUBJECT_OBJECT = ("article-categories", "article-templates", "article-templates-nested", "disambiguations", "template-type")
ALL_POSITIONS = ("infobox-properties",)


def members(links: DataFrame) -> DataFrame:
    """(uri, component) of all ends of links (s, o), stored."""
    return components_by_blocks(links, "s", "o").select(F.col("node").alias("uri"), "component")


def equivalence_classes(links: DataFrame, largest: int | None = None) -> DataFrame:
    """(uri, component, size, canonical) from links (s, o); classes beyond ``largest`` are left out.

    The canonical name is the digest of the members' URIs, sorted and joined: it doesn't depend on link order.  A class
    without a bound on its size is one string in one task, of 2 GB at most.
    """
    named = members(links)
    if largest is not None:  # before any class is put in a string
        small = named.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") <= largest)
        named = named.join(small, "component", "left_semi")
    # members go out with their class's name: the class is gathered for that anyway, and nothing is joined
    whole = named.groupBy("component").agg(F.array_sort(F.collect_list("uri")).alias("all"))
    whole = whole.select("component", F.size("all").cast("long").alias("size"), S.uri_digest(F.array_join("all", "")).alias("canonical"), "all")
    return whole.select(F.explode("all").alias("uri"), "component", "size", "canonical")


def class_sizes(classes: DataFrame, top: int = 5000) -> DataFrame:
    return classes.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(top)


#: Values of a position whose new names are sent to all tasks.
FEW_VALUES = 10_000


def rewrite(triples: DataFrame, classes: DataFrame, prefix: str, positions: tuple[str, ...]) -> DataFrame:
    """IRIs in ``positions`` replaced by ``prefix`` + canonical name (of a URI without links: its own digest).

    Each position is one left join on the URI, objects only where a bitmap says that they may have a class; literals and
    other positions stay.
    """
    return _rewritten(triples, cut(classes.select("uri", "canonical")), prefix, positions)


def _rewritten(triples: DataFrame, names: DataFrame, prefix: str, positions: tuple[str, ...]) -> DataFrame:
    out = triples
    if "p" in positions:  # first: properties are few as a rule, and named once each
        out = _properties_rewritten(out, names, prefix)

    def others_rewritten(df: DataFrame) -> DataFrame:
        for c in (c for c in positions if c not in ("p", "o")):
            df = _position_rewritten(df, names, prefix, c)
        return df

    if "o" not in positions:
        return others_rewritten(out)
    # literals and objects without a class aren't shuffled by object; their digests come last, as they are longer
    iri = F.col("o_kind").eqNullSafe("iri")
    near, far = split_by_bitmap(out, "o", names.select("uri"), iri)
    near = others_rewritten(_position_rewritten(near, names, prefix, "o"))
    far = others_rewritten(far).withColumn("o", F.when(iri, F.concat(F.lit(prefix), S.uri_digest(F.col("o")))).otherwise(F.col("o")))
    return near.unionByName(far)


def _position_rewritten(triples: DataFrame, names: DataFrame, prefix: str, c: str) -> DataFrame:
    side = names.select(F.col("uri").alias("_uri"), F.col("canonical").alias("_name"))
    new = F.concat(F.lit(prefix), F.coalesce("_name", S.uri_digest(F.col(c))))
    return triples.join(side, triples[c] == side["_uri"], "left").withColumn(c, new).drop("_uri", "_name")


def _properties_rewritten(triples: DataFrame, names: DataFrame, prefix: str) -> DataFrame:
    few = cut(triples.select("p").distinct().limit(FEW_VALUES + 1))
    if few.count() > FEW_VALUES:
        return _position_rewritten(triples, names, prefix, "p")
    new = cut(_position_rewritten(few.withColumn("_p", F.col("p")), names, prefix, "p")).select("_p", F.col("p").alias("_new"))
    return triples.join(F.broadcast(new), triples["p"].eqNullSafe(new["_p"]), "left").withColumn("p", F.col("_new")).drop("_p", "_new")


def rewrite_datasets(triples: DataFrame, classes: DataFrame, prefix: str) -> DataFrame:
    """Each data set by its pattern; data sets of no pattern are left out."""
    names = cut(classes.select("uri", "canonical"))
    first = triples.where(F.col("dataset").isin(*SUBJECT, *SUBJECT_OBJECT, *ALL_POSITIONS))
    subject = _rewritten(first.where(F.col("dataset").isin(*SUBJECT)), names, prefix, ("s",))
    both = _rewritten(first.where(F.col("dataset").isin(*SUBJECT_OBJECT)), names, prefix, ("s", "o"))
    every = _rewritten(first.where(F.col("dataset").isin(*ALL_POSITIONS)), names, prefix, ("s", "p", "o"))
    return subject.unionByName(both).unionByName(every)


def unique_statements(triples: DataFrame) -> DataFrame:
    return triples.dropDuplicates()
