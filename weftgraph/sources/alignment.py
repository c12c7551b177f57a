"""Alignment XML files: ontology pair, extension fields, and cells (source, target, relation, measure)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import xml_escaped, xml_unescaped

# the format's header and footer (fixed values)
HEAD = """<?xml version="1.0" encoding="utf-8"?>
<rdf:RDF xmlns="http://knowledgeweb.semanticweb.org/heterogeneity/alignment" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:xsd="http://www.w3.org/2001/XMLSchema#" xmlns:align="http://knowledgeweb.semanticweb.org/heterogeneity/alignment">
<Alignment>
<xml>yes</xml>
<level>0</level>
<type>??</type>
"""
FOOT = "</Alignment>\n</rdf:RDF>\n"


def _pair(rows: DataFrame):
    """The pair that a row is of: its folder ``pair=...`` if there is one, else the first two parts of its file's name."""
    if "pair" in rows.columns:
        return F.col("pair").cast("string")
    return F.array_join(F.slice(F.split(F.element_at(F.split("_metadata.file_path", "/"), -1), "~"), 1, 2), "~")


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """(pair, source, target, relation, confidence), from files named ``a~b~...`` or from what ``write_alignments`` made."""
    schema = "entity1 struct<`_rdf:resource`: string>, entity2 struct<`_rdf:resource`: string>, relation string, measure struct<_VALUE: string>"
    rows = spark.read.format("xml").option("rowTag", "Cell").schema(schema).load(path)
    return rows.select(
        _pair(rows).alias("pair"),
        F.col("entity1.`_rdf:resource`").alias("source"),
        F.col("entity2.`_rdf:resource`").alias("target"),
        F.trim("relation").alias("relation"),
        F.trim("measure._VALUE").cast("double").alias("confidence"),
    )


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(pair, onto1, onto2): the ontologies' identifiers."""
    schema = "onto1 struct<Ontology: struct<`_rdf:about`: string>>, onto2 struct<Ontology: struct<`_rdf:about`: string>>"
    rows = spark.read.format("xml").option("rowTag", "Alignment").schema(schema).load(path)
    return rows.select(
        _pair(rows).alias("pair"), F.col("onto1.Ontology.`_rdf:about`").alias("onto1"), F.col("onto2.Ontology.`_rdf:about`").alias("onto2")
    )


# element names that the format itself uses; others are extension fields (fixed values)
FORMAT_TAGS = ("entity1", "entity2", "relation", "measure", "Cell", "map", "Alignment", "xml", "level", "type", "onto1", "onto2", "Ontology", "location", "formalism", "Formalism")


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """(pair, onto1, onto2, extension): of each ontology about, location, formalism and its URI; the extension fields as
    a map.  Files are read from cell to cell, so their size doesn't matter."""
    rows = spark.read.option("lineSep", "<map>").text(path)
    field = r"<(?:[\w.-]+:)?([\w.-]+)>([^<]*)</(?:[\w.-]+:)?\1>"
    found = F.arrays_zip(*[F.regexp_extract_all("value", F.lit(field), F.lit(i)).alias(n) for i, n in ((1, "k"), (2, "v"))])
    own = F.transform(F.filter(found, lambda x: ~x["k"].isin(*FORMAT_TAGS)), lambda x: F.struct(x["k"].alias("key"), xml_unescaped(x["v"]).alias("value")))

    def ontology(i: int):
        body = F.regexp_extract("value", rf"(?s)<onto{i}>(.*?)</onto{i}>", 1)
        part = lambda pattern: xml_unescaped(F.trim(F.regexp_extract(body, pattern, 1)))
        about = F.when(body.contains("<Ontology"), part(r'<Ontology[^>]*rdf:about="([^"]*)"')).otherwise(xml_unescaped(F.regexp_replace(body, r"^\s+|\s+$", "")))
        return F.struct(
            about.alias("about"),
            part("<location>([^<]*)</location>").alias("location"),
            part(r'<Formalism[^>]*align:name="([^"]*)"').alias("formalism"),
            part(r'<Formalism[^>]*align:uri="([^"]*)"').alias("formalism_uri"),
        )

    head = F.col("value").contains("<Alignment")
    return (
        rows.select(_pair(rows).alias("pair"), *[F.when(head, ontology(i)).alias(f"onto{i}") for i in (1, 2)], own.alias("own"))
        .groupBy("pair")
        .agg(F.first("onto1", True).alias("onto1"), F.first("onto2", True).alias("onto2"), F.flatten(F.collect_list("own")).alias("own"))
        .select("pair", "onto1", "onto2", F.map_from_entries("own").alias("extension"))
    )


def cells(alignment: DataFrame) -> DataFrame:
    """(pair, cell) as XML text."""
    text = F.concat(
        F.lit('<map><Cell><entity1 rdf:resource="'),
        xml_escaped(F.col("source")),
        F.lit('"/><entity2 rdf:resource="'),
        xml_escaped(F.col("target")),
        F.lit('"/><relation>'),
        xml_escaped(F.col("relation")),
        F.lit('</relation><measure rdf:datatype="xsd:float">'),
        F.col("confidence").cast("string"),
        F.lit("</measure></Cell></map>"),
    )
    return alignment.select("pair", text.alias("cell"))


def documents(alignment: DataFrame, extension: dict[str, str] | None = None, ontologies: DataFrame | None = None) -> DataFrame:
    """(pair, xml): one document per pair, cells in order.  An alignment between two schemas is small.

    ``ontologies`` has ``onto1`` and ``onto2`` per pair, as ``read_details`` gives them; for others the name's parts stand.
    """
    if ontologies is None:
        ontologies = alignment.select("pair").distinct().select("pair", *[F.lit(None).cast("struct<about:string,location:string,formalism:string,formalism_uri:string>").alias(f"onto{i}") for i in (1, 2)])

    def ontology(i: int):
        x = F.col(f"onto{i}")
        about = F.coalesce(x["about"], F.concat(F.lit("http://"), F.split("pair", "~")[i - 1]))
        formalism = F.concat(F.lit('<formalism><Formalism align:name="'), xml_escaped(x["formalism"]), F.lit('" align:uri="'), xml_escaped(x["formalism_uri"]), F.lit('"/></formalism>'))
        inner = F.concat(
            F.when(F.coalesce(x["location"], F.lit("")) != "", F.concat(F.lit("<location>"), xml_escaped(x["location"]), F.lit("</location>"))).otherwise(""),
            F.when(F.coalesce(x["formalism"], F.lit("")) != "", formalism).otherwise(""),
        )
        end = F.when(inner == "", F.lit('"/>')).otherwise(F.concat(F.lit('">'), inner, F.lit("</Ontology>")))
        return F.concat(F.lit(f'<onto{i}><Ontology rdf:about="'), xml_escaped(about), end, F.lit(f"</onto{i}>\n"))

    fields = "".join(f"<{k}>{v}</{k}>\n" for k, v in ((k, v.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")) for k, v in (extension or {}).items()))
    body = cells(alignment).groupBy("pair").agg(F.array_join(F.array_sort(F.collect_list("cell")), "\n").alias("body"))
    body = body.join(ontologies.select("pair", "onto1", "onto2"), "pair", "left")
    return body.select("pair", F.concat(F.lit(HEAD), ontology(1), ontology(2), F.lit(fields), "body", F.lit("\n" + FOOT)).alias("xml"))


def write_alignments(alignment: DataFrame, path: str, extension: dict[str, str] | None = None, ontologies: DataFrame | None = None) -> None:
    """A folder per pair with one XML document each."""
    documents(alignment, extension, ontologies).select("pair", F.col("xml").alias("value")).write.partitionBy("pair").text(path)


def read_hand_written(spark: SparkSession, path: str) -> DataFrame:
    """(source, target): the first and the last ``<...>`` of each line that isn't a comment."""
    lines = spark.read.text(path).where("NOT startswith(value, '#')")
    ends = F.regexp_extract_all("value", F.lit("<([^>]*)>"), 1)
    found = lines.select(ends.alias("e")).where(F.size("e") >= 2)
    return found.select(F.replace(F.element_at("e", 1), F.lit("/ontology/"), F.lit("/class/")).alias("source"), F.element_at("e", -1).alias("target"))
