"""Wiki dumps, metadata tables, crowd batches and the writers beside N-Triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..schemas import WIKI_META


def _records(spark: SparkSession, path: str | list[str], mark: str) -> DataFrame:
    """(file, value): the texts between one ``mark`` and the next, however long the file; a plain file is split."""
    return spark.read.option("lineSep", mark).text(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "value")


def page_titles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, title) of pages of the main name space: a title whose next line holds ``<ns>0</ns>``."""
    title = F.regexp_extract("value", r"^([^\n]*?)</title>[^\n]*\n[^\n]*<ns>0</ns>", 1)
    return _records(spark, path, "<title>").select("file", title.alias("title")).where("title <> ''")


def page_titles_xml(spark: SparkSession, path: str) -> DataFrame:
    """The same through the XML reader, which splits large files."""
    rows = spark.read.format("xml").option("rowTag", "page").schema("title string, ns string").load(path)
    return rows.where("ns = '0'").select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "title")


def site_names(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, site): the ``<sitename>`` of each file; of several the smallest."""
    found = _records(spark, path, "<sitename>").select("file", F.regexp_extract("value", r"^([^\n]*?)</sitename>", 1).alias("site"))
    return found.where("site <> ''").groupBy("file").agg(F.min("site").alias("site"))


def listing(paths: Column) -> Column:
    """The parts of a dump's path ``.../id~lang~name~host.tar.gz``: (wiki_id, lang, domain, file)."""
    file = F.element_at(F.split(paths, "/"), -1)
    part = lambda i: S.name_part(file, i)
    return F.struct(part(0).try_cast("long").alias("wiki_id"), part(1).alias("lang"), part(2).alias("domain"), file.alias("file"))


def read_listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length, wiki_id, lang, domain, file) of files; their contents aren't read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", listing(F.col("path")).alias("x")).select("path", "length", "x.*")


def natural_order(df: DataFrame, name: str) -> DataFrame:
    """By the number that a file's name begins with, then by name."""
    return df.orderBy(S.name_part(F.col(name), 0).try_cast("long"), name)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=WIKI_META, multiLine=True, escape='"')


def metadata_record(item: Column) -> list[Column]:
    """A crawled JSON item, parsed with ``ITEM``, as the metadata table's first 24 columns; statistics default to 0."""
    plain = ["title", "url", "wordmark", "topUsers", "headline", "name", "domain", "hub", "lang", "topic", "flags", "desc", "image"]
    stats = ["edits", "articles", "pages", "users", "activeUsers", "images", "videos", "admins", "discussions"]
    return [
        item["id"].alias("id"),
        *[S.one_line(item[c].cast("string")).alias(c) for c in plain],
        item["wam_score"].alias("wam_score"),
        *[F.coalesce(item["stats"][c], F.lit(0).cast("long")).alias(f"stats_{c}") for c in stats],
    ]


ITEM = (
    "id long, title string, url string, wordmark string, topUsers string, headline string, name string, domain string, hub string, lang string, "
    "topic string, flags string, `desc` string, image string, wam_score double, stats struct<edits: long, articles: long, pages: long, users: long, "
    "activeUsers: long, images: long, videos: long, admins: long, discussions: long>"
)


def flatten_crawl(lines: DataFrame, column: str = "value") -> DataFrame:
    """Metadata rows from JSON lines; a line that can't be parsed gives a row of blanks."""
    return lines.select(F.from_json(column, ITEM).alias("x")).select(*metadata_record(F.col("x")))


# the pattern of a statistics page's link to a dump, with its date and time behind (fixed value)
DUMP_LINK = r'(?i)<a href="(http://[^<>"]+pages_(current|full)\.xml\.([^<>"]+))">(?:(\d{4}-\d{2}-\d{2}) (\d\d:\d\d:\d\d))?'


def dump_links(html: Column) -> Column:
    """All dump links of a page, in order, as an array of (type, url, compression, date, time)."""
    names = ("url", "type", "compression", "date", "time")
    found = F.arrays_zip(*[F.regexp_extract_all(html, F.lit(DUMP_LINK), F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    return F.transform(found, lambda x: F.struct(F.lower(x["type"]).alias("type"), *[x[n].alias(n) for n in ("url", "compression", "date", "time")]))


def last_dump_links(pages: DataFrame, html: str) -> DataFrame:
    """Columns ``current_*`` and ``full_*`` (dump_url, compression, date, time) beside the page: of each type the last
    link with a date, empty where there is none."""
    out = pages.withColumn("_links", dump_links(F.col(html)))
    for kind in ("current", "full"):
        last = F.try_element_at(F.filter("_links", lambda x: (x["type"] == kind) & (x["date"] != "")), F.lit(-1))
        names = {"dump_url": "url", "compression": "compression", "date": "date", "time": "time"}
        out = out.withColumns({f"{kind}_{n}": F.coalesce(last[x], F.lit("")) for n, x in names.items()})
    return out.drop("_links")


def guessed_dump_urls(metadata: DataFrame, base: str) -> DataFrame:
    """(id, url) of every place where a site's dump may lie: kinds by compressions, from the site's name alone."""
    name = F.translate(S.wiki_domain(F.col("url")), "-.", "")
    kinds = F.array(F.lit("current"), F.lit("full"))
    ends = F.array(F.lit("7z"), F.lit("gz"), F.lit("bz2"))
    rows = metadata.select("id", name.alias("n"), F.explode(kinds).alias("k")).select("id", "n", "k", F.explode(ends).alias("e"))
    path = F.concat_ws("/", F.lit(base), F.substring("n", 1, 1), F.substring("n", 1, 2), "n")
    return rows.where("n <> ''").select("id", F.concat(path, F.lit("/"), "n", F.lit("_pages_"), "k", F.lit(".xml."), "e").alias("url"))


def usable(metadata: DataFrame, dump_ids: DataFrame | None = None, lang: str = "en", articles: int = 100) -> DataFrame:
    """Sites in a language, with more than so many articles and, if given, a dump at hand."""
    out = metadata.where((S.or_default(F.col("lang"), "en") == lang) & (F.col("stats_articles") > articles))
    return out if dump_ids is None else out.join(dump_ids.select("id").distinct(), "id", "left_semi")


def with_dumps(metadata: DataFrame, dumps: DataFrame) -> DataFrame:
    """Metadata joined with the dump (path, file) of its id; sites without a dump are left out."""
    return metadata.join(dumps.select(F.col("wiki_id").alias("id"), "path", "file"), "id")


def with_dump_url(metadata: DataFrame) -> DataFrame:
    return metadata.where("current_dump_url IS NOT NULL AND current_dump_url <> ''")


def changed_urls(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = (x.select("id", F.col("current_dump_url").alias(n)) for x, n in ((before, "old"), (after, "new")))
    return a.join(b, "id").where("new <> '' AND NOT old <=> new")


def read_crowd(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


# an answer document as services write it: no declaration, comments, CDATA or other elements, and the five named entities;
# repeats are possessive, as others would recurse
_TEXT = r"(?:[^<>&\x00-\x08\x0B-\x1F\uFFFE\uFFFF]++|&(?:amp|lt|gt|quot|apos);)++"
PLAIN_ANSWERS = rf'^<QuestionFormAnswers(?: xmlns="[^"<&]*+")?>(?:\s*+<Answer>\s*+<QuestionIdentifier>{_TEXT}</QuestionIdentifier>\s*+<FreeText>{_TEXT}</FreeText>\s*+</Answer>)*+\s*+</QuestionFormAnswers>\z'


def crowd_answers_xml(df: DataFrame, column: str) -> DataFrame:
    """(…, question, answer) from answer documents.

    Documents of the plain form are read by regular expressions, all others by XPath, which builds two trees for each.
    """
    rest = [c for c in df.columns if c != column]
    free = F.expr(f"regexp_replace({column}, 'xmlns=\"[^\"]*\"', '')")
    parsed = F.arrays_zip(F.xpath(free, F.lit("//Answer/QuestionIdentifier/text()")).alias("q"), F.xpath(free, F.lit("//Answer/FreeText/text()")).alias("a"))
    texts = lambda name: F.transform(F.regexp_extract_all(column, F.lit(f"<{name}>([^<]*+)</{name}>"), F.lit(1)), S.xml_unescaped)
    plain = F.arrays_zip(texts("QuestionIdentifier").alias("q"), texts("FreeText").alias("a"))
    pairs = df.select(*rest, F.when(F.col(column).rlike(PLAIN_ANSWERS), plain).otherwise(parsed).alias("x"))
    return pairs.select(*rest, F.explode("x").alias("x")).select(*rest, F.col("x.q").alias("question"), F.col("x.a").alias("answer"))


#: What a list of crowd tasks and of their assignments holds, as JSON lines.
HIT = "HITId string, HITTypeId string, RequesterAnnotation string, Title string"
ASSIGNMENT = "AssignmentId string, HITId string, WorkerId string, AssignmentStatus string, Answer string"


def read_hits(spark: SparkSession, path: str, type_id: str | None = None, batch_id: str | None = None) -> DataFrame:
    """Task records, of one type or one batch if asked for; the batch is named in the requester's annotation."""
    hits = spark.read.schema(HIT).json(path)
    if type_id is not None:
        hits = hits.where(F.col("HITTypeId") == type_id)
    if batch_id is not None:
        hits = hits.where(F.element_at(S.annotation(F.col("RequesterAnnotation")), "BatchId") == batch_id)
    return hits


def task_answers(hits: DataFrame, assignments: DataFrame) -> DataFrame:
    """(hit, worker, question, answer) of the tasks' assignments."""
    own = assignments.join(hits.select("HITId").distinct(), "HITId", "left_semi")
    return crowd_answers_xml(own.select(F.col("HITId").alias("hit"), F.col("WorkerId").alias("worker"), "Answer"), "Answer")


def cached_titles(spark: SparkSession, path: str, make) -> DataFrame:
    """(file, title) kept as Parquet at ``path``: made once by ``make()``, read from then on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.schema("file string, title string").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(tag, text) from JSON lines ``[tag, text]``."""
    x = F.from_json("value", "array<string>")
    return spark.read.text(path).select(x[0].alias("tag"), x[1].alias("text"))


def write_corpus(corpus: DataFrame, path: str, compression: str = "gzip") -> None:
    corpus.select(F.to_json(F.array("tag", "text")).alias("value")).write.option("compression", compression).text(path)


#: Rows of a CSV file: one with line breaks in its fields can't be split, and is one task's work.
ROWS_PER_FILE = 50_000


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("maxRecordsPerFile", ROWS_PER_FILE).csv(path, header=True, escape='"')


# the parts of a GraphML document (fixed values)
GRAPHML_HEAD = """<?xml version="1.0" encoding="utf-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<key attr.name="degree" attr.type="long" for="node" id="degree"/>
<key attr.name="weight" attr.type="long" for="edge" id="weight"/>
<graph edgedefault="undirected">"""
GRAPHML_FOOT = "</graph>\n</graphml>"


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): the document's head, nodes, edges and foot, to be put in order of ``part``."""
    spark = nodes.sparkSession
    line = lambda part, text: spark.range(1).select(F.lit(part).alias("part"), F.lit(text).alias("value"))
    node = F.format_string('<node id="%s"><data key="degree">%d</data></node>', S.xml_escaped(F.col("domain")), "degree")
    edge = F.format_string('<edge source="%s" target="%s"><data key="weight">%d</data></edge>', S.xml_escaped(F.col("src")), S.xml_escaped(F.col("dst")), "weight")
    body = nodes.select(F.lit(1).alias("part"), node.alias("value")).unionByName(edges.select(F.lit(2).alias("part"), edge.alias("value")))
    return line(0, GRAPHML_HEAD).unionByName(body).unionByName(line(3, GRAPHML_FOOT))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One GraphML document: the text files of the folder, in order of their names."""
    graphml_lines(nodes, edges).repartitionByRange("part").sortWithinPartitions("part").select("value").write.text(path)


def filled(template: str, row: dict[str, str]) -> str:
    """``${column}`` replaced by a row's values."""
    for k, v in row.items():
        template = template.replace("${" + k + "}", v)
    return template


def filled_rows(df: DataFrame, template: str, column: str = "text") -> DataFrame:
    """Each row's columns put into a template's ``${column}`` places; names without a column stay as they are."""
    pieces, rest = [], template
    names = {c: df[c].cast("string") for c in df.columns}
    while "${" in rest:
        before, _, rest = rest.partition("${")
        name, end, behind = rest.partition("}")
        if end and name in names:
            pieces += [F.lit(before), F.coalesce(names[name], F.lit(""))]
            rest = behind
        else:
            pieces.append(F.lit(before + "${"))
    return df.withColumn(column, F.concat(*pieces, F.lit(rest)))
