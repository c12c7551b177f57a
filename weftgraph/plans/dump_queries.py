"""Registered queries from dumps to indexes, of files written and read back, and of the functions and filters that the
matchers don't reach, each with its SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as K
from ..functions import scalar as S
from ..operators import corpus, crowd, enrich, evaluate, indexes, match, overlap, stats
from ..operators.storage import shared_path
from ..sources import alignment as A
from ..sources import dumps, ntriples
from ..streaming import ingest
from .adapter import cte, view
from .queries import query, table, titles_shared

LABEL = f"'{K.LABEL_P}'"
INDEX = "SELECT domain, lower(trim(label)) AS key, label, s AS resource"


def dump(spark, d) -> DataFrame:
    return view(spark, d, "kg_dump")


# --- indexes ----------------------------------------------------------------------------------------------------


@query(f"{cte('kg_dump')} SELECT domain, s, o AS label FROM kg_dump WHERE dataset = 'template-type-definitions' AND p = {LABEL} AND ext = '@en'")
def class_labels_in_english(spark, d):
    return indexes.labels(indexes.dataset(dump(spark, d), indexes.CLASSES), "en")


@query(f"{cte('kg_dump')} {INDEX} FROM (SELECT domain, s, o AS label FROM kg_dump WHERE dataset = 'template-type-definitions' AND p = {LABEL})")
def wiki_class_index(spark, d):
    return indexes.source_index(dump(spark, d), "class")


@query(f"{cte('kg_dump')} {INDEX} FROM (SELECT domain, s, o AS label FROM kg_dump WHERE dataset = 'infobox-property-definitions' AND p = {LABEL})")
def wiki_property_index(spark, d):
    return indexes.source_index(dump(spark, d), "property")


NAMED = "named AS (SELECT domain, s, trim(o) AS label FROM kg_dump WHERE dataset = 'labels' AND s NOT IN (SELECT s FROM kg_dump WHERE dataset = 'transitive-redirects'))"


@query(f"{cte('kg_dump')}, {NAMED} {INDEX} FROM named")
def wiki_instance_index(spark, d):
    return indexes.source_index(dump(spark, d), "instance")


@query(f"""{cte("kg_dump")}, {NAMED}, i AS ({INDEX} FROM named)
SELECT * FROM i UNION ALL SELECT domain, key, label, o FROM i JOIN (SELECT DISTINCT s, o FROM kg_dump WHERE dataset = 'disambiguations') g ON g.s = resource""")
def wiki_disambiguation_index(spark, d):
    return indexes.source_index(dump(spark, d), "instance with disambiguations")


ONTOLOGY = f"""pref AS (SELECT s, coalesce(min(o) FILTER (ext = '@en'), min(o)) AS label FROM kg_ontology WHERE p = {LABEL} GROUP BY s),
sub AS (SELECT DISTINCT s FROM kg_ontology WHERE p = '{K.TYPE_P}' AND o IN ({{kinds}})), moved AS (SELECT sub.s, coalesce(r.o, sub.s) AS r FROM sub LEFT JOIN kg_ontology_redirects r ON r.s = sub.s)"""
LOCAL = "split_part({0}, '/', len(string_split({0}, '/'))::INT)"


@query(f"""{cte("kg_ontology", "kg_ontology_redirects")}, {ONTOLOGY.format(kinds=f"'{K.CLASS}'")}
SELECT 'onto' AS domain, lower(trim(label)) AS key, label, r AS resource FROM (SELECT r, {LOCAL.format("r")} AS label FROM moved UNION ALL SELECT r, label FROM moved JOIN pref ON pref.s = moved.s)""")
def ontology_class_index(spark, d):
    return indexes.class_index(view(spark, d, "kg_ontology"), view(spark, d, "kg_ontology_redirects"), "onto")


@query(f"""{cte("kg_ontology", "kg_ontology_redirects")}, {ONTOLOGY.format(kinds=f"'{K.DATATYPE_PROPERTY}', '{K.OBJECT_PROPERTY}'")}
SELECT 'onto' AS domain, lower(label) AS key, label, r AS resource FROM (SELECT r, {LOCAL.format("s")} AS label FROM moved UNION ALL SELECT r, trim(label) FROM moved JOIN pref ON pref.s = moved.s)""")
def ontology_property_index(spark, d):
    return indexes.property_index(view(spark, d, "kg_ontology"), view(spark, d, "kg_ontology_redirects"), "onto")


@query(f"""{cte("kg_labels", "kg_redirects")}, m AS (SELECT coalesce(r.o, l.s) AS s, trim(label) AS label FROM kg_labels l LEFT JOIN kg_redirects r ON r.s = l.s)
SELECT 'kg' AS domain, lower(label) AS key, label, s AS resource FROM m""")
def instance_index_with_redirects(spark, d):
    return indexes.instance_index(view(spark, d, "kg_labels").select("s", "label"), view(spark, d, "kg_redirects"), "kg")


@query(f"{cte('kg_labels', 'kg_redirects')} SELECT 'kg' AS domain, lower(trim(label)) AS key, trim(label) AS label, s AS resource FROM kg_labels WHERE s NOT IN (SELECT s FROM kg_redirects)")
def instance_index_without_redirects(spark, d):
    return indexes.instance_index(view(spark, d, "kg_labels").select("s", "label"), view(spark, d, "kg_redirects"), "kg", follow=False)


GOLD_SOURCE = "replace(p_brand, '#', '') AS domain, concat('http://kg.example.org/', replace(p_brand, '#', ''), '/resource/', CAST(p_partkey + (p_partkey % 4) * 3 AS STRING)) AS source"


@query(f"""{cte("kg_dump")}, g AS (SELECT DISTINCT {GOLD_SOURCE} FROM part), red AS (SELECT s, max(o) AS o FROM kg_dump WHERE dataset = 'transitive-redirects' GROUP BY s),
m AS (SELECT g.domain, g.source, coalesce(red.o, g.source) AS resource FROM g LEFT JOIN red ON red.s = g.source),
known AS (SELECT DISTINCT domain, s FROM kg_dump WHERE dataset IN ('template-type-definitions', 'infobox-property-definitions', 'labels', 'short-abstracts'))
SELECT *, 'redirect' AS fault FROM m WHERE source <> resource UNION ALL SELECT *, 'not found' FROM m WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.domain = m.domain AND k.s = m.resource)""")
def gold_faults(spark, d):
    gold = spark.sql(f"SELECT {GOLD_SOURCE} FROM {{part}}", part=table(spark, d, "part"))
    everything = dump(spark, d)
    return indexes.gold_faults(gold, indexes.links(indexes.dataset(everything, indexes.REDIRECTS)), indexes.subjects(everything))


@query(f"""{cte("kg_dump")}, l AS (SELECT DISTINCT domain, lower(trim(o)) AS key FROM kg_dump WHERE dataset = 'template-type-definitions' AND p = {LABEL})
SELECT a.domain, b.domain AS target_domain, CAST(count(*) AS BIGINT) AS shared FROM l a JOIN l b ON a.key = b.key AND a.domain <> b.domain GROUP BY ALL""")
def class_matches_between_wikis(spark, d):
    """From the dumps to the classes that wikis share, through the same index and matcher as a real run."""
    index = indexes.source_index(dump(spark, d), "class")
    found = match.all_match(index.select("domain", F.col("resource").alias("s"), "label"), index)
    keys = found.select("domain", "target_domain", S.label_key(F.col("label")).alias("key")).distinct()
    return keys.groupBy("domain", "target_domain").agg(F.count("*").alias("shared"))


# --- ontology and enrichment ------------------------------------------------------------------------------------

BASE = "http://kg.example.org/ontology/"
SUBS = f"sub AS (SELECT DISTINCT s AS sub, o AS super FROM kg_ontology WHERE p = '{K.SUBCLASS_P}' AND starts_with(s, '{BASE}') AND starts_with(o, '{BASE}'))"


@query(f"{cte('kg_ontology')}, {SUBS}, up(sub, super) AS (SELECT sub, super FROM sub UNION SELECT up.sub, s.super FROM up JOIN sub s ON up.super = s.sub) SELECT sub, super FROM up")
def ontology_superclasses(spark, d):
    return enrich.transitive_closure(indexes.subclass_links(view(spark, d, "kg_ontology"), BASE))


MAPPING = "SELECT DISTINCT concat('class/', p_type) AS s, concat('http://kg.example.org/ontology/S', CAST(p_size AS STRING)) AS o FROM {part}"


@query(f"WITH m AS ({MAPPING.replace('{part}', 'part')}) SELECT s, string_agg(o, '|' ORDER BY o) AS targets FROM m GROUP BY s")
def mapping_targets(spark, d):
    found = indexes.multimap(spark.sql(MAPPING, part=table(spark, d, "part")))
    return found.select("s", F.array_join("targets", "|").alias("targets"))


FOUND = "SELECT DISTINCT concat('class/', p_type) AS sub, concat('class/', p_brand) AS super FROM {part}"
LINKED = "SELECT DISTINCT concat('class/', {0}) AS s, concat('http://kg.example.org/ontology/S', CAST({1} AS STRING)) AS o FROM {{part}}"


@query(f"""{cte("kg_ontology")}, {SUBS}, up(sub, super) AS (SELECT sub, super FROM sub UNION SELECT up.sub, s.super FROM up JOIN sub s ON up.super = s.sub),
f AS ({FOUND.replace("{part}", "part")}), m AS ({LINKED.format("p_type", "length(p_type)").replace("{part}", "part")} UNION {LINKED.format("p_brand", "length(p_brand) + 1").replace("{part}", "part")})
SELECT DISTINCT f.sub, f.super FROM f JOIN m a ON a.s = f.sub JOIN m b ON b.s = f.super JOIN up ON up.sub = a.o AND up.super = b.o""")
def supported_subclasses(spark, d):
    part = table(spark, d, "part")
    mapping = spark.sql(LINKED.format("p_type", "length(p_type)"), part=part).union(spark.sql(LINKED.format("p_brand", "length(p_brand) + 1"), part=part)).distinct()
    return enrich.supported(spark.sql(FOUND, part=part), mapping, ontology_superclasses(spark, d))


VOTES = """ty AS (SELECT s, max(o) AS t FROM kg_all_types GROUP BY s),
sides AS (SELECT p, 'domain' AS side, coalesce(t, 'http://www.w3.org/2002/07/owl#Thing') AS type FROM kg_facts f LEFT JOIN ty ON ty.s = f.s
  UNION ALL SELECT p, 'range', CASE WHEN o_kind = 'iri' THEN coalesce(t, 'http://www.w3.org/2002/07/owl#Thing') ELSE 'http://www.w3.org/2000/01/rdf-schema#Literal' END FROM kg_facts f LEFT JOIN ty ON ty.s = f.o AND o_kind = 'iri'),
win AS (SELECT p, side, type FROM (SELECT *, row_number() OVER (PARTITION BY p, side ORDER BY n DESC, type) AS rn FROM (SELECT p, side, type, count(*) AS n FROM sides GROUP BY ALL)) WHERE rn = 1)"""


@query(f"""{cte("kg_facts", "kg_all_types")}, {VOTES} SELECT '<' || p || '> <http://www.w3.org/2000/01/rdf-schema#' || side || '> <' || type || '> .' AS value FROM win WHERE type <> 'http://www.w3.org/2002/07/owl#Thing'""")
def restriction_lines(spark, d):
    found = enrich.domains_and_ranges(view(spark, d, "kg_facts"), view(spark, d, "kg_all_types"))
    return written_lines(spark, enrich.restriction_triples(found), "restrictions")


@query(f"""{cte("kg_types")}, one AS (SELECT o, count(*) AS n FROM kg_types GROUP BY o), dis AS (SELECT DISTINCT s, o FROM kg_types), rich AS (SELECT s FROM dis GROUP BY s HAVING count(*) >= 3),
bo AS (SELECT a.o AS a, b.o AS b, count(*) AS n FROM dis a JOIN dis b ON a.s = b.s AND a.o < b.o WHERE a.s IN (SELECT s FROM rich) GROUP BY ALL),
m AS (SELECT a AS sub, b AS super FROM bo JOIN one x ON x.o = a WHERE bo.n::DOUBLE / x.n > 0.3 UNION ALL SELECT b, a FROM bo JOIN one y ON y.o = b WHERE bo.n::DOUBLE / y.n >= 0.3),
new AS (SELECT DISTINCT t.s, m.super AS o FROM kg_types t JOIN m ON t.o = m.sub WHERE NOT EXISTS (SELECT 1 FROM kg_types x WHERE x.s = t.s AND x.o = m.super))
SELECT '<' || s || '> <{K.TYPE_P}> <' || o || '> .' AS value FROM new""")
def materialized_type_lines(spark, d):
    types = view(spark, d, "kg_types")
    return written_lines(spark, enrich.type_triples(enrich.materialize(types, enrich.subclasses(types, above=0.3))), "types")


@query(f"""{cte("kg_types")}, one AS (SELECT o, count(*) AS n FROM kg_types GROUP BY o), dis AS (SELECT DISTINCT s, o FROM kg_types), rich AS (SELECT s FROM dis GROUP BY s HAVING count(*) >= 3),
bo AS (SELECT a.o AS a, b.o AS b, count(*) AS n FROM dis a JOIN dis b ON a.s = b.s AND a.o < b.o WHERE a.s IN (SELECT s FROM rich) GROUP BY ALL),
m AS (SELECT a AS sub, b AS super FROM bo JOIN one x ON x.o = a WHERE bo.n::DOUBLE / x.n > 0.3 UNION ALL SELECT b, a FROM bo JOIN one y ON y.o = b WHERE bo.n::DOUBLE / y.n >= 0.3)
SELECT sub AS s, '{K.SUBCLASS_P}' AS p, super AS o, 'iri' AS o_kind, '' AS ext, CASE WHEN starts_with(sub, 'class/size') THEN upper(sub) END AS label_sub FROM m""")
def subclass_statements(spark, d):
    """Written with their evidence as comments, and read back; the comments are no part of the statements."""
    types = view(spark, d, "kg_types")
    names = types.where("o LIKE 'class/size%'").select(F.col("o").alias("s"), F.upper("o").alias("label")).distinct()
    found = enrich.with_labels(enrich.subclasses(types, above=0.3), names)
    path = shared_path(spark, "subclass")
    enrich.subclass_lines(found).write.text(path)
    back = ntriples.read_ntriples(spark, path)
    return back.join(found.select(F.col("sub").alias("s"), F.col("super").alias("o"), "label_sub"), ["s", "o"]).select("s", "p", "o", "o_kind", "ext", "label_sub")


def written_lines(spark, triples: DataFrame, name: str) -> DataFrame:
    path = shared_path(spark, name)
    ntriples.write_ntriples(triples, path)
    return spark.read.text(path)


# --- files written and read back --------------------------------------------------------------------------------


@query(f"{cte('kg_facts')} SELECT s, p, o, o_kind, ext FROM kg_facts UNION ALL SELECT s, p, o, o_kind, ext FROM kg_facts UNION ALL SELECT s, p, o, o_kind, ext FROM kg_facts")
def ntriples_files(spark, d):
    """Plain, gzip and bzip2 files."""
    paths = {codec: shared_path(spark, f"triples-{codec}") for codec in ("bzip2", "gzip", "none")}
    with ThreadPoolExecutor(len(paths)) as pool:  # the last tasks of one leave cores to the others
        list(pool.map(lambda codec: ntriples.write_ntriples(view(spark, d, "kg_facts"), paths[codec], compression=codec), paths))
    back = [ntriples.read_ntriples(spark, path) for path in paths.values()]
    return back[0].unionByName(back[1]).unionByName(back[2])


@query(r"""SELECT 'doc/' || doc_id AS s, md5(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r')) AS digest, CAST(length(text) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL""")
def literal_round_trip(spark, d):
    """Every document's whole text as an escaped literal, written and read back."""
    o = F.col("text")
    for sign, name in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        o = F.replace(o, F.lit(sign), F.lit(name))
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    triples = docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("s"), F.length("text").cast("string").alias("p"), o.alias("o"), F.lit("literal").alias("o_kind"), F.lit("@x").alias("ext"))
    path = shared_path(spark, "literals")
    ntriples.write_ntriples(triples, path, compression="gzip")
    return ntriples.read_ntriples(spark, path).select("s", F.md5("o").alias("digest"), F.col("p").cast("long").alias("n"))


@query(f"{cte('kg_dump')} SELECT wiki_id, lang, domain, dataset, s, p, o, o_kind, ext FROM kg_dump")
def wiki_tar_round_trip(spark, d):
    """All sources as tar archives of data sets, and back."""
    path = shared_path(spark, "wiki-tars")
    ntriples.write_wiki_tars(dump(spark, d), path).count()
    return ntriples.read_wiki_tars(spark, f"{path}/*.tar.gz").select("wiki_id", "lang", "domain", "dataset", "s", "p", "o", "o_kind", "ext")


@query(f"""{cte("kg_dump")} SELECT CAST(wiki_id AS BIGINT) AS wiki_id, lang, domain, wiki_id || '~en~' || domain || '~' || domain || '.example.org.tar.gz' AS file, CAST(row_number() OVER (ORDER BY wiki_id) AS BIGINT) AS place
FROM (SELECT DISTINCT wiki_id, lang, domain FROM kg_dump)""")
def wiki_listing(spark, d):
    """Files of a folder as a relation, in natural order."""
    path = shared_path(spark, "wiki-files")
    ntriples.write_wiki_tars(dump(spark, d), path).count()
    files = dumps.natural_order(dumps.read_listing(spark, f"{path}/*.tar.gz"), "file")
    places = files.agg(F.collect_list("wiki_id").alias("all"))  # one row of file numbers
    return files.join(places).select("wiki_id", "lang", "domain", "file", F.array_position("all", F.col("wiki_id")).alias("place"))


META = """SELECT c_custkey AS id, c_name AS title, concat('http://', lower(c_mktsegment), CAST(c_custkey AS STRING), '.wikia.com/') AS url, 'w' AS wordmark, 'u' AS topUsers, 'h' AS headline, c_name AS name,
  concat(lower(c_mktsegment), CAST(c_custkey AS STRING)) AS domain, c_mktsegment AS hub, CASE c_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS lang, 't' AS topic, 'f' AS flags,
  concat('a "quoted", comma', chr(10), 'and line of ', c_name) AS `desc`, 'i' AS image, c_acctbal AS wam_score, CAST(1 AS BIGINT) AS stats_edits, CAST(c_custkey % 500 AS BIGINT) AS stats_articles, CAST(3 AS BIGINT) AS stats_pages,
  CAST(4 AS BIGINT) AS stats_users, CAST(5 AS BIGINT) AS stats_activeUsers, CAST(6 AS BIGINT) AS stats_images, CAST(7 AS BIGINT) AS stats_videos, CAST(8 AS BIGINT) AS stats_admins, CAST(9 AS BIGINT) AS stats_discussions,
  CASE WHEN c_custkey % 4 > 0 THEN concat('http://dump/', CAST(c_custkey AS STRING)) END AS current_dump_url, 'gz' AS current_compression, '2017-08-01' AS current_date, concat('10:0', CAST(c_custkey % 10 AS STRING), ':00') AS current_time,
  CAST(NULL AS STRING) AS full_dump_url, CAST(NULL AS STRING) AS full_compression, CAST(NULL AS STRING) AS full_date, CAST(NULL AS STRING) AS full_time FROM {customer}"""
META_SQL = "meta AS (" + META.replace("{customer}", "customer").replace("`desc`", '"desc"').replace("AS current_date", 'AS "current_date"').replace("AS current_time", 'AS "current_time"') + ")"


def metadata(spark, d) -> DataFrame:
    """The metadata table, through its CSV file."""
    made = spark.sql(META.replace("AS current_date", "AS `current_date`").replace("AS current_time", "AS `current_time`"), customer=table(spark, d, "customer"))
    path = shared_path(spark, "metadata")
    dumps.write_csv(made.select(*K.WIKI_META.names), path)
    return dumps.read_metadata(spark, path)


@query(f"""WITH {META_SQL} SELECT id, title, url, hub, coalesce(lang, 'none') AS lang, md5("desc") AS description, wam_score, stats_articles, stats_discussions, coalesce(current_dump_url, 'none') AS dump, "current_time" AS at FROM meta""")
def metadata_csv_round_trip(spark, d):
    return metadata(spark, d).select(
        "id", "title", "url", "hub", F.coalesce("lang", F.lit("none")).alias("lang"), F.md5("desc").alias("description"), "wam_score", "stats_articles", "stats_discussions",
        F.coalesce("current_dump_url", F.lit("none")).alias("dump"), F.col("current_time").alias("at"),
    )


@query(f"""WITH {META_SQL} SELECT id, title, 'dumps/' || id || '.tar.gz' AS path, strftime(CAST("current_date" || ' ' || "current_time" AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS dumped
FROM meta WHERE coalesce(nullif(lang, ''), 'en') = 'en' AND stats_articles > 100 AND current_dump_url IS NOT NULL AND id % 2 = 1""")
def sites_with_dumps(spark, d):
    """English sites of more than 100 articles with a dump link and a dump at hand (here: of odd ids), with that dump."""
    held = table(spark, d, "customer").where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("wiki_id"), F.concat(F.lit("dumps/"), F.col("c_custkey").cast("string"), F.lit(".tar.gz")).alias("path"), F.lit("f").alias("file"))
    sites = dumps.with_dump_url(dumps.usable(metadata(spark, d)))
    at = F.date_format(S.date_time(F.col("current_date"), F.col("current_time")), "yyyy-MM-dd HH:mm:ss")
    return dumps.with_dumps(sites, held).select("id", "title", "path", at.alias("dumped"))


@query(f"""WITH {META_SQL} SELECT id, current_dump_url AS old, CASE WHEN id % 3 = 0 THEN 'http://new/' || id ELSE current_dump_url END AS new FROM meta WHERE (id % 3 = 0 OR current_dump_url IS NOT NULL) AND (current_dump_url IS NULL OR id % 3 = 0)""")
def changed_dump_urls(spark, d):
    before = metadata(spark, d)
    after = before.withColumn("current_dump_url", F.when(F.col("id") % 3 == 0, F.concat(F.lit("http://new/"), F.col("id").cast("string"))).otherwise(F.col("current_dump_url")))
    return dumps.changed_urls(before, after)


@query(f"""WITH {META_SQL}, n AS (SELECT id, replace(domain, '-', '') AS n FROM meta)
SELECT id, 'http://d/' || n[1:1] || '/' || n[1:2] || '/' || n || '/' || n || '_pages_' || k || '.xml.' || e AS url FROM n, (VALUES ('current'), ('full')) a(k), (VALUES ('7z'), ('gz'), ('bz2')) b(e)""")
def guessed_dump_urls(spark, d):
    return dumps.guessed_dump_urls(metadata(spark, d), "http://d")


STATISTICS = """SELECT c_custkey AS id, concat('<p>', c_name, '</p><a href="http://h/a', CAST(c_custkey AS STRING), '_pages_current.xml.7z">2017-01-02 03:04:05</a> <A HREF="http://h/b', CAST(c_custkey AS STRING), '_pages_CURRENT.xml.gz">2017-08-01 10:00:0',
  CAST(c_custkey % 10 AS STRING), '</A>', CASE WHEN c_custkey % 2 = 0 THEN concat('<a href="http://h/c', CAST(c_custkey AS STRING), '_pages_full.xml.bz2">2016-05-06 07:08:09</a>') ELSE '<a href="http://h/d_pages_full.xml.gz">undated</a>' END) AS html FROM {customer}"""


@query("""SELECT c_custkey AS id, 'http://h/b' || c_custkey || '_pages_CURRENT.xml.gz' AS current_dump_url, 'gz' AS current_compression, '2017-08-01' AS current_on, '10:00:0' || (c_custkey % 10) AS current_at,
CASE WHEN c_custkey % 2 = 0 THEN 'http://h/c' || c_custkey || '_pages_full.xml.bz2' ELSE '' END AS full_dump_url, CASE WHEN c_custkey % 2 = 0 THEN '2016-05-06' ELSE '' END AS full_on FROM customer""")
def dump_link_table(spark, d):
    found = dumps.last_dump_links(spark.sql(STATISTICS, customer=table(spark, d, "customer")), "html")
    return found.select("id", "current_dump_url", "current_compression", F.col("current_date").alias("current_on"), F.col("current_time").alias("current_at"), "full_dump_url", F.col("full_date").alias("full_on"))


@query("""SELECT c_custkey AS id, c_name || ' x' AS title, '' AS topic, c_acctbal AS wam_score, CAST(c_custkey * 2 AS BIGINT) AS stats_articles, CAST(0 AS BIGINT) AS stats_edits FROM customer""")
def crawl_records(spark, d):
    """Items of a crawl, as JSON lines in a file, flattened to the metadata table."""
    item = F.struct(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("\r\nx")).alias("title"), F.col("c_acctbal").alias("wam_score"), F.struct((F.col("c_custkey") * 2).alias("articles")).alias("stats"))
    path = shared_path(spark, "crawl")
    table(spark, d, "customer").select(F.to_json(item).alias("value")).write.text(path)
    return dumps.flatten_crawl(spark.read.text(path)).select("id", "title", "topic", "wam_score", "stats_articles", "stats_edits")


PAGES = """concat(CASE WHEN p_partkey % 50 = 0 THEN '<siteinfo>\\n <sitename>Site ' || p_partkey || '</sitename>\\n</siteinfo>\\n' ELSE '' END, '<page>\\n  <title>', p_name, ' ', p_partkey, '</title>\\n  <ns>', p_partkey % 3, '</ns>\\n <text>the &lt;ns>0&lt;/ns> of ', p_type, '</text>\\n</page>')"""


def wiki_dump(spark, d) -> str:
    """A page dump as one file, of pages in the main name space and in two others, with site information now and then."""
    path = shared_path(spark, "pages")
    line = lambda text: spark.range(1).select(F.lit(text).alias("value"))
    pages = table(spark, d, "part").select(F.expr(PAGES).alias("value"))
    line("<mediawiki>").union(pages).union(line("</mediawiki>")).coalesce(1).write.text(path)
    return path


MAIN_PAGES = "SELECT p_name || ' ' || p_partkey AS title FROM part WHERE p_partkey % 3 = 0"


@query(MAIN_PAGES)
def page_titles_by_line(spark, d):
    return dumps.page_titles(spark, wiki_dump(spark, d)).select("title")


@query(MAIN_PAGES)
def page_titles_by_element(spark, d):
    return dumps.page_titles_xml(spark, wiki_dump(spark, d)).select("title")


@query(MAIN_PAGES)
def page_titles_kept(spark, d):
    """Extracted once, read from the kept table the second time."""
    path, dump_path = shared_path(spark, "titles"), wiki_dump(spark, d)
    dumps.cached_titles(spark, path, lambda: dumps.page_titles(spark, dump_path))
    return dumps.cached_titles(spark, path, lambda: None).select("title")


@query("SELECT 'Site ' || min(p_partkey::VARCHAR) AS site FROM part WHERE p_partkey % 50 = 0")
def site_name(spark, d):
    path = shared_path(spark, "site")
    table(spark, d, "part").select(F.expr(PAGES).alias("value")).coalesce(1).write.text(path)
    return dumps.site_names(spark, path).select("site")


@query(f"{cte('kg_gold')} SELECT pair, source, target, relation, confidence FROM kg_gold")
def alignment_files(spark, d):
    path = shared_path(spark, "alignments")
    A.write_alignments(view(spark, d, "kg_gold"), path)
    return A.read_alignments(spark, path)


@query(f"""{cte("kg_gold")} SELECT DISTINCT pair, 'http://' || pair || '/1' AS about, 'file:' || pair AS location, 'OWL' AS formalism, 'http://' || split_part(pair, '~', 2) AS second, 'by hand & eye' AS method FROM kg_gold""")
def alignment_headers(spark, d):
    gold = view(spark, d, "kg_gold")
    text = lambda c: c.cast("string")
    none = F.lit("")
    pairs = gold.select("pair").distinct()
    onto1 = F.struct(F.concat(F.lit("http://"), "pair", F.lit("/1")).alias("about"), F.concat(F.lit("file:"), "pair").alias("location"), F.lit("OWL").alias("formalism"), F.lit("http://owl").alias("formalism_uri"))
    onto2 = F.struct(text(F.lit(None)).alias("about"), none.alias("location"), none.alias("formalism"), none.alias("formalism_uri"))
    path = shared_path(spark, "alignment-headers")
    A.write_alignments(gold, path, {"method": "by hand & eye"}, pairs.select("pair", onto1.alias("onto1"), onto2.alias("onto2")))
    found = A.read_details(spark, path)
    return found.select("pair", "onto1.about", "onto1.location", "onto1.formalism", F.col("onto2.about").alias("second"), F.col("extension")["method"].alias("method"))


@query("SELECT DISTINCT 'http://x/class/' || replace(p_type, ' ', '_') AS source, 'http://y/' || p_brand AS target FROM part")
def hand_written_mapping(spark, d):
    path = shared_path(spark, "hand-written")
    rows = table(spark, d, "part").select("p_type", "p_brand").distinct()
    line = F.concat(F.lit("<http://x/ontology/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("> has <mid> = <http://y/"), "p_brand", F.lit(">"))
    rows.select(line.alias("value")).unionByName(spark.sql("SELECT '# <no> <no>' AS value UNION ALL SELECT 'nothing'")).write.text(path)
    return A.read_hand_written(spark, path)


@query(f"{cte('kg_facts')} SELECT s, p, o, o_kind, ext, 'one' AS domain_a, 'two' AS domain_b FROM kg_facts")
def gold_schema_statements(spark, d):
    """Schema files, whose names hold the two domains."""
    path = shared_path(spark, "schema")
    ntriples.write_ntriples(view(spark, d, "kg_facts").withColumn("file", F.lit("one~two~x")), path, by="file")
    lines = spark.read.text(path).select("value", "file")
    return ntriples.parse_lines(lines).select("s", "p", "o", "o_kind", "ext", S.name_part(F.col("file"), 0).alias("domain_a"), S.name_part(F.col("file"), 1).alias("domain_b"))


@query(f"{cte('kg_corpus')} SELECT tag, md5(text) AS digest FROM kg_corpus")
def corpus_files(spark, d):
    path = shared_path(spark, "corpus")
    dumps.write_corpus(view(spark, d, "kg_corpus"), path)
    return dumps.read_corpus(spark, path).select("tag", F.md5("text").alias("digest"))


@query(f"""{cte("kg_votes")} SELECT hit, worker, 'q' || item AS question, answer FROM kg_votes WHERE CAST(substr(hit, 4) AS BIGINT) % 3 = 1""")
def crowd_task_answers(spark, d):
    """Tasks of one batch, their assignments and answer documents, from JSON files."""
    votes = view(spark, d, "kg_votes")
    hits = votes.select("hit").distinct().select(F.col("hit").alias("HITId"), F.lit("t").alias("HITTypeId"), F.concat(F.lit("BatchId:b"), (F.substring("hit", 4, 20).cast("long") % 3).cast("string"), F.lit(";OriginalHitTemplateId:5")).alias("RequesterAnnotation"))
    answer = F.concat(F.lit('<QuestionFormAnswers xmlns="http://x"><Answer><QuestionIdentifier>q'), F.col("item").cast("string"), F.lit("</QuestionIdentifier><FreeText>"), S.xml_escaped(F.col("answer")), F.lit("</FreeText></Answer></QuestionFormAnswers>"))
    made = votes.select(F.col("hit").alias("HITId"), F.col("worker").alias("WorkerId"), F.lit("a").alias("AssignmentId"), answer.alias("Answer"))
    one, two = shared_path(spark, "hits"), shared_path(spark, "assignments")
    hits.write.json(one)
    made.write.json(two)
    return dumps.task_answers(dumps.read_hits(spark, one, type_id="t", batch_id="b1"), spark.read.schema(dumps.ASSIGNMENT).json(two))


@query(f"""{cte("kg_votes")}, v AS (SELECT hit, worker, 0 AS item, 1 AS dst, answer FROM kg_votes UNION ALL SELECT hit, worker, 0, 2, 'no match' FROM kg_votes)
SELECT *, CASE WHEN answer = 'no match' OR starts_with(answer, 'p') THEN 'valid' ELSE 'rejected' END AS verdict FROM v""")
def checked_answers(spark, d):
    """A batch's answer columns as rows (from its CSV file), parted into valid and rejected ones."""
    batch = view(spark, d, "kg_votes").select(F.col("hit").alias("HITId"), F.col("worker").alias("WorkerId"), F.col("answer").alias("Answer.0_mapping_dst1"), F.lit("no match").alias("Answer.0_mapping_dst2"))
    path = shared_path(spark, "batch")
    dumps.write_csv(batch, path)
    rows = crowd.answers(dumps.read_crowd(spark, path), items=1).withColumn("domain", F.lit("p"))
    out = crowd.valid_answers(rows).withColumn("verdict", F.lit("valid")).unionByName(crowd.rejected_answers(rows).withColumn("verdict", F.lit("rejected")))
    return out.select("hit", "worker", "item", "dst", "answer", "verdict")


SHARED = """t AS (SELECT DISTINCT domain, title FROM kg_titles WHERE title NOT IN ('Main Page', 'Sandbox', 'Hauptseite')),
ov AS (SELECT a.domain AS src, b.domain AS dst, count(*) AS n FROM t a JOIN t b ON a.title = b.title AND a.domain < b.domain GROUP BY ALL HAVING count(*) > 1)"""


@query(f"""{cte("kg_titles")}, {SHARED}, w AS (SELECT domain, count(*) AS degree FROM (SELECT src AS domain FROM ov UNION ALL SELECT dst FROM ov) GROUP BY domain)
SELECT '<node id="' || domain || '"><data key="degree">' || degree || '</data></node>' AS value, 1 AS part FROM w
UNION ALL SELECT '<edge source="' || src || '" target="' || dst || '"><data key="weight">' || n || '</data></edge>', 2 FROM ov UNION ALL SELECT '</graph>', 3 UNION ALL SELECT '</graphml>', 3""")
def graphml_document(spark, d):
    """The lines of the document behind its head, from its file."""
    nodes, edges = overlap.overlap_graph(titles_shared(spark, d))
    path = shared_path(spark, "graphml")
    dumps.write_graphml(nodes, edges, path)
    lines = spark.read.text(path)
    part = F.when(F.col("value").startswith("<node"), 1).when(F.col("value").startswith("<edge"), 2).when(F.col("value").startswith("</graph"), 3)
    return lines.select("value", part.alias("part")).where("part IS NOT NULL")


@query(f"{cte('kg_facts')} SELECT p, CAST(count(*) AS BIGINT) AS statements FROM kg_facts GROUP BY p")
def streamed_statements(spark, d):
    """Statement files as a stream, appended by property, and counted."""
    source, out, state = shared_path(spark, "stream-in"), shared_path(spark, "stream-out"), shared_path(spark, "stream-state")
    ntriples.write_ntriples(view(spark, d, "kg_facts"), source)
    ingest.append(ingest.statement_stream(spark, source, files_per_trigger=4), out, state).awaitTermination()
    return spark.read.parquet(out).groupBy("p").agg(F.count("*").alias("statements"))


# --- filters, functions and samples -----------------------------------------------------------------------------


@query(f"""{cte("kg_titles")}, t AS (SELECT DISTINCT domain, title FROM kg_titles), sz AS (SELECT domain, count(*) AS n FROM t GROUP BY domain),
ov AS (SELECT a.domain AS src, b.domain AS dst, count(*) AS n FROM t a JOIN t b ON a.title = b.title AND a.domain < b.domain GROUP BY ALL)
SELECT src, dst, CAST(ov.n AS BIGINT) AS n, round(ov.n::DOUBLE / (x.n + y.n - ov.n), 6) AS jaccard FROM ov JOIN sz x ON x.domain = src JOIN sz y ON y.domain = dst WHERE ov.n > 2 AND replace(src, '-', '') <> replace(dst, '-', '')""")
def differently_named_overlaps(spark, d):
    return overlap.different_names(overlap.shared_titles(view(spark, d, "kg_titles")), least=2)


@query(f"""{cte("kg_system")} SELECT pair, source, target FROM kg_system WHERE regexp_extract(target, '^[a-z]+://([^/]+)/', 1) = 'kg.example.org'""")
def links_into_domain(spark, d):
    return evaluate.target_in_domain(view(spark, d, "kg_system"), F.lit("kg.example.org")).select("pair", "source", "target")


@query("""SELECT md5(text) AS digest, doc_id AS path FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)""")
def same_files(spark, d):
    return stats.same_files(table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")))


@query("""WITH s AS (SELECT md5(text) AS digest, doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)), l AS (SELECT * FROM s WHERE doc_id % 3 > 0)
SELECT digest, string_agg('d' || doc_id, ',' ORDER BY 'd' || doc_id) AS names FROM l GROUP BY digest HAVING count(*) > 1""")
def linked_duplicates(spark, d):
    docs = table(spark, d, "documents")
    same = stats.same_files(docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content")))
    crawl = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 > 0, "u").otherwise("").alias("url"))
    return stats.linked_duplicates(same.select("digest", F.col("path").alias("wiki_id"), F.concat(F.lit("d"), F.col("path").cast("string")).alias("name")), crawl)


@query("""WITH p AS (SELECT l_orderkey % 100 AS g, l_suppkey % 10 AS c, l_linenumber AS r, max(l_partkey % 2) AS hit FROM lineitem GROUP BY ALL),
v AS (SELECT g, c, list(hit ORDER BY r) AS row, CAST(sum(hit) AS BIGINT) AS hits FROM p GROUP BY g, c)
SELECT v.g AS "group", v.c AS candidate, v.hits FROM v JOIN (SELECT g, max(row) AS row FROM v GROUP BY g) b ON b.g = v.g AND b.row = v.row""")
def last_standing(spark, d):
    probes = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("group"), (F.col("l_suppkey") % 10).alias("candidate"), F.col("l_linenumber").alias("round")).agg(F.max(F.col("l_partkey") % 2).alias("hit"))
    return stats.last_standing(probes)


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5('0|' || c_custkey), c_custkey LIMIT 25")
def sampled_rows(spark, d):
    return overlap.sampled(table(spark, d, "customer"), "c_custkey", 25).select("c_custkey", "c_name")


@query("SELECT DISTINCT p_brand FROM part")
def distinct_brands(spark, d):
    return table(spark, d, "part").select("p_brand").distinct()


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 3, 5, 8, 13)")
def rows_by_id(spark, d):
    return table(spark, d, "customer").where(F.col("c_custkey").isin(1, 3, 5, 8, 13)).select("c_custkey", "c_name")


URI = "'http://' || replace(p_name, ' ', '-') || '.wikia.com/wiki/' || replace(p_type, ' ', '_')"


@query(f"""SELECT p_partkey, substr({URI}, 8) AS behind, 'http://kg.example.org/' || replace(p_name, ' ', '-') || '/resource/' || replace(p_type, ' ', '_') AS resource, replace(p_name, ' ', '-') || '.wikia.com' AS host,
p_name || ' ' || p_type AS line, 'x/class/' || p_type AS class, substr(p_name, 1, 5) AS start, starts_with(p_name, 'red') AS red, CAST(p_size AS VARCHAR) AS size, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'none' END AS brand, 'gz' AS ending, 'labels.ttl' AS data FROM part""")
def more_scalar_functions(spark, d):
    name = F.col("p_name")
    url = F.concat(F.lit("http://"), F.replace(name, F.lit(" "), F.lit("-")), F.lit(".wikia.com/wiki/"), F.replace("p_type", F.lit(" "), F.lit("_")))
    notes = F.concat(F.lit("a:1;size:"), F.col("p_size").cast("string"), F.lit(";b:2"))
    return table(spark, d, "part").select(
        "p_partkey",
        S.after_prefix(url, 7).alias("behind"),
        S.resource_of_page(url, "http://kg.example.org/").alias("resource"),
        S.resource_domain(url).alias("host"),
        S.one_line(F.concat(name, F.lit("\r\n"), "p_type")).alias("line"),
        S.ontology_to_class(F.concat(F.lit("x/ontology/"), "p_type")).alias("class"),
        S.first_bytes(name, 5).alias("start"),
        F.startswith(name, F.lit("red")).alias("red"),
        S.annotation(notes)["size"].alias("size"),
        S.or_default(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(""), "none").alias("brand"),
        S.extension(F.concat("p_brand", F.lit(".tar.gz"))).alias("ending"),
        S.dataset_of_member(F.concat(F.lit("enwiki-"), F.col("p_partkey").cast("string"), F.lit("-labels.ttl"))).alias("data"),
    )


@query(f"{cte('kg_ontology')} SELECT s, coalesce(min(o) FILTER (ext = '@en'), min(o)) AS label FROM kg_ontology WHERE p = {LABEL} GROUP BY s")
def preferred_labels(spark, d):
    named = view(spark, d, "kg_ontology").where(F.col("p") == K.LABEL_P)
    return named.groupBy("s").agg(S.preferred_label(F.col("o"), F.col("ext")).alias("label"))


@query("SELECT p_partkey, 'Dear ' || p_brand || ': ' || p_name || '.' AS text FROM part")
def filled_templates(spark, d):
    return dumps.filled_rows(table(spark, d, "part"), "Dear ${p_brand}: ${p_name}.").select("p_partkey", "text")


WEIGHTS = r"""WITH tok AS (SELECT 'doc/' || doc_id AS uri, unnest(regexp_split_to_array(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+')) AS token FROM documents WHERE text IS NOT NULL),
tf AS (SELECT uri, CAST(('0x' || substr(md5(token), 1, 7))::BIGINT % 64 AS INTEGER) AS bucket, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT bucket, count(*) AS df FROM tf GROUP BY bucket),
w AS (SELECT uri, tf.bucket, tf * ln((SELECT count(*) + 1 FROM documents)::DOUBLE / (df + 1)) AS w FROM tf JOIN df ON df.bucket = tf.bucket)
SELECT uri, bucket, round(w / l, 5) AS weight FROM w JOIN (SELECT uri, sqrt(sum(w * w)) AS l FROM w GROUP BY uri) n USING (uri) WHERE l > 0"""


@query(WEIGHTS)
def document_term_weights(spark, d):
    return corpus.term_weights(view(spark, d, "kg_corpus"), 64).withColumn("weight", F.round("weight", 5))
