"""From statements to what matchers look up: labels, types, redirects, and label indexes of classes, properties and
instances.

``dump`` is a table of dump triples (columns s, p, o, o_kind, ext, domain, dataset); all sources are indexed together,
each row with its ``domain``.  A data set that a source lacks gives no rows.  Indexes have ``label_index``'s columns:
domain, key, label, resource.  Null labels are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as K
from ..functions import scalar as S
from .match import drop_redirecting, label_index, resolve_redirects, with_disambiguations

# data sets of a source's dump (fixed values)
CLASSES, PROPERTIES, INSTANCES = "template-type-definitions", "infobox-property-definitions", "labels"
TYPES, REDIRECTS, DISAMBIGUATIONS, ABSTRACTS = "template-type", "transitive-redirects", "disambiguations", "short-abstracts"
KINDS = ("class", "property", "instance", "instance with disambiguations")


def dataset(dump: DataFrame, name: str) -> DataFrame:
    return dump.where(F.col("dataset") == name)


def labels(triples: DataFrame, lang: str | None = None) -> DataFrame:
    """(domain, s, label) of label statements, in one language only if asked for."""
    found = triples.where((F.col("p") == K.LABEL_P) & (F.col("o_kind") == "literal"))
    if lang is not None:
        found = found.where(F.col("ext") == f"@{lang}")
    return found.select("domain", "s", F.col("o").alias("label"))


def types(triples: DataFrame) -> DataFrame:
    """(s, o) of type statements."""
    return triples.where(F.col("p") == K.TYPE_P).select("s", "o")


def links(triples: DataFrame) -> DataFrame:
    """(s, o) of a data set of links, such as redirects and disambiguations."""
    return triples.where("o_kind = 'iri'").select("s", "o")


def source_index(dump: DataFrame, kind: str) -> DataFrame:
    """The index of one kind over all sources: labels of classes and of properties; of instances, without those that
    redirect, and on request with each disambiguation page's label for the page's targets too."""
    if kind not in KINDS:
        raise ValueError(kind)
    if kind == "class":
        return label_index(labels(dataset(dump, CLASSES)))
    if kind == "property":
        return label_index(labels(dataset(dump, PROPERTIES)))
    named = dataset(dump, INSTANCES).where("o_kind = 'literal'").select("domain", "s", S.strip(F.col("o")).alias("label"))
    index = label_index(drop_redirecting(named, links(dataset(dump, REDIRECTS))).select("domain", "s", "label"))
    return index if kind == "instance" else with_disambiguations(index, links(dataset(dump, DISAMBIGUATIONS)))


def ontology_names(ontology: DataFrame, kinds: list[str], lang: str = "en") -> DataFrame:
    """(s, label): each subject of the kinds asked for, under its label in ``lang`` or else any, and its local name."""
    subjects = ontology.where((F.col("p") == K.TYPE_P) & F.col("o").isin(*kinds)).select("s").distinct()
    known = ontology.where((F.col("p") == K.LABEL_P) & (F.col("o_kind") == "literal")).groupBy("s").agg(S.preferred_label(F.col("o"), F.col("ext"), f"@{lang}").alias("label"))
    named = subjects.join(known, "s").select("s", "label")
    return named.unionByName(subjects.select("s", S.local_name(F.col("s")).alias("label")))


def _index(named: DataFrame, redirects: DataFrame, domain: str) -> DataFrame:
    moved = resolve_redirects(named, redirects, "s")
    return label_index(moved.where("label IS NOT NULL").select(F.lit(domain).alias("domain"), "s", S.strip(F.col("label")).alias("label")))


def class_index(ontology: DataFrame, redirects: DataFrame, domain: str, lang: str = "en") -> DataFrame:
    """Classes of a reference ontology by label and by the local name of what they redirect to."""
    subjects = ontology.where((F.col("p") == K.TYPE_P) & (F.col("o") == K.CLASS)).select("s").distinct()
    known = ontology.where((F.col("p") == K.LABEL_P) & (F.col("o_kind") == "literal")).groupBy("s").agg(S.preferred_label(F.col("o"), F.col("ext"), f"@{lang}").alias("label"))
    moved = resolve_redirects(subjects, redirects, "s").select(F.col("s").alias("r"), S.local_name(F.col("s")).alias("label"))
    by_label = resolve_redirects(subjects.join(known, "s"), redirects, "s").select(F.col("s").alias("r"), "label")
    return label_index(moved.unionByName(by_label).select(F.lit(domain).alias("domain"), F.col("r").alias("s"), "label"))


def property_index(ontology: DataFrame, redirects: DataFrame, domain: str, lang: str = "en") -> DataFrame:
    """Data and object properties of a reference ontology by label and local name."""
    return _index(ontology_names(ontology, [K.DATATYPE_PROPERTY, K.OBJECT_PROPERTY], lang), redirects, domain)


def instance_index(named: DataFrame, redirects: DataFrame, domain: str, follow: bool = True) -> DataFrame:
    """Labelled resources (s, label); those that redirect count for their targets, or not at all."""
    if follow:
        return _index(named, redirects, domain)
    return _index(drop_redirecting(named, redirects).select("s", "label"), redirects.limit(0), domain)


def subjects(dump: DataFrame) -> DataFrame:
    """(domain, s): whatever a source says something about in its definitions, labels and abstracts."""
    return dump.where(F.col("dataset").isin(CLASSES, PROPERTIES, INSTANCES, ABSTRACTS)).select("domain", "s").distinct()


def gold_faults(gold: DataFrame, redirects: DataFrame, known: DataFrame) -> DataFrame:
    """(domain, source, resource, fault) of gold sources (domain, source) that redirect, or that lead nowhere.

    The fault is ``redirect`` or ``not found``; a source can have both.
    """
    moved = resolve_redirects(gold.select("domain", "source", F.col("source").alias("resource")).distinct(), redirects, "resource")
    redirected = moved.where("source <> resource").withColumn("fault", F.lit("redirect"))
    lost = moved.join(known.select("domain", F.col("s").alias("resource")).distinct(), ["domain", "resource"], "left_anti").withColumn("fault", F.lit("not found"))
    columns = ["domain", "source", "resource", "fault"]
    return redirected.select(*columns).unionByName(lost.select(*columns))


def subclass_links(ontology: DataFrame, prefix: str) -> DataFrame:
    """(sub, super): the subclass statements whose both ends lie in one name space."""
    found = ontology.where((F.col("p") == K.SUBCLASS_P) & F.col("s").startswith(prefix) & F.col("o").startswith(prefix))
    return found.select(F.col("s").alias("sub"), F.col("o").alias("super")).distinct()


def multimap(triples: DataFrame) -> DataFrame:
    """(s, targets): the distinct objects of each subject of a mapping, in order."""
    return triples.groupBy("s").agg(F.array_sort(F.collect_set("o")).alias("targets"))
