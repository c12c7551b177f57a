"""Column functions, all in the JVM; those over arrays (``same_case``, ``dot``) interpret a lambda per element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fresh(columns: list[str], name: str) -> str:
    """``name``, or one like it, that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def label_key(c: Column) -> Column:
    """What labels are matched by."""
    return F.lower(strip(c))


def same_case(a: Column, b: Column) -> Column:
    """Positions, over the common length, at which both strings are lower or both are upper case."""
    upper = lambda x: x != F.lower(x)
    lower = lambda x: x != F.upper(x)
    n = F.least(F.length(a), F.length(b))
    pairs = F.arrays_zip(F.slice(F.split(a, ""), F.lit(1), n).alias("x"), F.slice(F.split(b, ""), F.lit(1), n).alias("y"))
    agree = F.filter(pairs, lambda p: (upper(p["x"]) & upper(p["y"])) | (lower(p["x"]) & lower(p["y"])))
    return F.when((n == 0) | a.isNull() | b.isNull(), F.lit(0)).otherwise(F.size(agree))


def local_name(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


def after_prefix(uri: Column, length: int) -> Column:
    return F.substr(uri, F.lit(length + 1), F.length(uri))


def wiki_domain(url: Column) -> Column:
    """``http://NAME.wikia.com...`` -> NAME; empty where the url has another form."""
    return F.regexp_extract(url, r"^http://(.*?)\.wikia\.com", 1)


def resource_domain(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^[a-z]+://([^/]+)/", 1)


def resource_of_page(url: Column, base: str) -> Column:
    """The resource URI of a wiki page's url."""
    return F.concat(F.lit(base), wiki_domain(url), F.lit("/resource/"), F.substring_index(url, "wikia.com/wiki/", -1))


def name_part(name: Column, i: int) -> Column:
    """The ``i``-th part, from 0, of a file name cut at ``~``."""
    return F.split_part(name, F.lit("~"), F.lit(i + 1))


def extension(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def dataset_of_member(name: Column) -> Column:
    """``enwiki-20170801-labels.ttl`` -> ``labels.ttl``."""
    return F.regexp_replace(name, "^[^-]*-[^-]*-", "")


def plain_title(title: Column) -> Column:
    """Lower case, letters, digits and spaces only, without the word for the site, single spaces."""
    t = F.regexp_replace(F.lower(title), "[^a-z0-9 ]+", "")
    return F.trim(F.replace(F.regexp_replace(t, "wiki[a]?", ""), F.lit("  "), F.lit(" ")))


def one_line(text: Column) -> Column:
    return F.coalesce(F.replace(F.replace(text, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit(""))


def spaces_to(text: Column, sign: str) -> Column:
    return F.replace(text, F.lit(" "), F.lit(sign))


def without_dashes(text: Column) -> Column:
    return F.replace(text, F.lit("-"), F.lit(""))


def ontology_to_class(uri: Column) -> Column:
    return F.replace(uri, F.lit("/ontology/"), F.lit("/class/"))


def uri_digest(text: Column) -> Column:
    """URL-safe Base64 of the MD5."""
    return F.translate(F.base64(F.unhex(F.md5(text))), "+/", "-_")


def content_digest(content: Column) -> Column:
    return F.md5(content)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is missing or zero."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def jaccard(both: Column, n_a: Column, n_b: Column) -> Column:
    return F.round(F.try_divide(both.cast("double"), (n_a + n_b - both).cast("double")), 6)


def kind_of(source: Column, target: Column) -> Column:
    """``class``, ``prop`` or ``inst`` by the URIs of an alignment cell; ``null`` ends don't count."""
    uri = F.when(source == "null", target).otherwise(source)
    return F.when(uri.contains("/class/") | uri.contains("/ontology/"), "class").when(uri.contains("/property/"), "prop").when(uri.contains("/resource/"), "inst")


def xml_escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def xml_unescaped(text: Column) -> Column:
    for sign, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def first_bytes(content: Column, n: int = 500) -> Column:
    """The key by which contents are compared first."""
    return F.substring(content, 1, n)


def tokens(text: Column) -> Column:
    return F.split(strip(text), r"\s+")


def annotation(text: Column) -> Column:
    """``k:v;k:v`` as a map."""
    return F.str_to_map(text, F.lit(";"), F.lit(":"))


def date_time(date: Column, time: Column) -> Column:
    return F.to_timestamp(F.concat_ws(" ", date, time))


def or_default(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def preferred_label(label: Column, ext: Column, wanted: str = "@en") -> Column:
    """Aggregate: the label in the wanted language, else any (the smallest of either)."""
    return F.coalesce(F.min(F.when(ext == wanted, label)), F.min(label))


def triple_line(s: Column, p: Column, o: Column, o_kind: Column, ext: Column) -> Column:
    """One N-Triples line, lexical forms as they are."""
    iri = lambda x: F.concat(F.lit("<"), x, F.lit(">"))
    node = F.when(o_kind == "iri", iri(o)).otherwise(F.concat(F.lit('"'), o, F.lit('"'), F.coalesce(ext, F.lit(""))))
    return F.concat_ws(" ", iri(s), iri(p), node, F.lit("."))
