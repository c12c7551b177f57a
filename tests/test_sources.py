import io
import tarfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftgraph.operators import overlap
from weftgraph.sources import alignment, dumps, ntriples
from weftgraph.streaming import ingest

A = "http://kg.example.org/a/resource/X"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
GOOD = [
    (f"<{A}> <{LABEL}> <http://o> .", (A, LABEL, "http://o", "iri", "")),
    (f'<{A}> <{LABEL}> "plain" .', (A, LABEL, "plain", "literal", "")),
    (f'<{A}> <{LABEL}> "X \\"q\\""@en .', (A, LABEL, 'X \\"q\\"', "literal", "@en")),
    (f'<{A}> <{LABEL}> "1"^^<http://dt> .', (A, LABEL, "1", "literal", "^^<http://dt>")),
    (f'<{A}> <{LABEL}> "back\\\\" .', (A, LABEL, "back\\\\", "literal", "")),
    (f'<{A}> <{LABEL}> "" .', (A, LABEL, "", "literal", "")),
    (f'<{A}> <{LABEL}> "a . b" .', (A, LABEL, "a . b", "literal", "")),
    (f"<{A}> <{LABEL}> <http://o>.", (A, LABEL, "http://o", "iri", "")),
    (f"<{A}> <{LABEL}> <http://o>.# note", (A, LABEL, "http://o", "iri", "")),
    (f'\t<{A}>\t<{LABEL}>\t"t"@en.', (A, LABEL, "t", "literal", "@en")),
    (f'<{A}> <{LABEL}> "\\u00e9 é" . # "quoted" <x>', (A, LABEL, "\\u00e9 é", "literal", "")),
    (f'<{A}> <{LABEL}> "e\\\\\\"f"@pt-BR .\r', (A, LABEL, 'e\\\\\\"f', "literal", "@pt-BR")),
]
BAD = [f"<{A}> <{LABEL}> <http://o>", f"<{A} <{LABEL}> .", f'<{A}> <{LABEL}> "open .', "_:b <p> <o> .", " ."]


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_statements(spark):
    got = ntriples.parse_lines(lines(spark, [x for x, _ in GOOD] + ["", "  ", "# comment", "\t# more"])).collect()
    assert sorted(map(tuple, got)) == sorted(t for _, t in GOOD)
    kinds = ntriples.parse_lines(lines(spark, [GOOD[2][0], GOOD[3][0]])).select(ntriples.lang(F.col("ext")), ntriples.datatype(F.col("ext"))).collect()
    assert sorted(map(tuple, kinds)) == [("", "http://dt"), ("en", "")]


def test_malformed_lines(spark):
    df = lines(spark, [GOOD[0][0], *BAD])
    assert ntriples.parse_lines(df, mode="DROPMALFORMED").count() == 1
    kept = ntriples.parse_lines(df, mode="PERMISSIVE").collect()
    assert sorted(r._corrupt for r in kept if r._corrupt) == sorted(BAD) and sum(r.s is not None for r in kept) == 1
    for line in BAD:
        with pytest.raises(PySparkException):
            ntriples.parse_lines(lines(spark, [line])).collect()
    with pytest.raises(ValueError):
        ntriples.parse_lines(df, mode="OTHER")


def test_long_literals(spark):
    rows = [("a" * n, "literal") for n in (10**4, 10**6)] + [('\\\\\\"' * n, "literal") for n in (10**4, 10**5)] + [("http://" + "x" * 10**6, "iri")]
    df = spark.createDataFrame([(A, LABEL, o, k, "" if k == "iri" else "@en") for o, k in rows], "s string, p string, o string, o_kind string, ext string")
    text = ntriples.lines_of(df)
    for mode in ntriples.MODES:
        assert sorted(ntriples.parse_lines(text, mode=mode).select("o", "o_kind").collect()) == sorted(rows)
    open_ = text.select(F.expr("substr(value, 1, length(value) - 8)").alias("value"))
    assert ntriples.parse_lines(open_, mode="DROPMALFORMED").count() == 0
    assert ntriples.parse_lines(open_, mode="PERMISSIVE").where("_corrupt IS NOT NULL").count() == len(rows)
    odd = lines(spark, [f'<{A}> <{LABEL}> "a\x01b>c\x85d\u2028e" . # \x85', f'<{A}> <{LABEL}> "a>b"^^<http://d> .', f"<{A}> <{LABEL}> <> .", None])
    assert sorted((r.o, r.o_kind, r.ext) for r in ntriples.parse_lines(odd.withColumn("_parts", F.lit(1))).collect()) == [
        ("", "iri", ""),
        ("a\x01b>c\x85d\u2028e", "literal", ""),
        ("a>b", "literal", "^^<http://d>"),
    ]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.nt").write_text("\n".join(x for x, _ in GOOD))  # no final newline
    df = ntriples.read_ntriples(spark, str(tmp_path / "a.nt"))
    assert df.count() == len(GOOD)
    ntriples.write_ntriples(df.withColumn("dataset", F.lit("labels")), str(tmp_path / "out"), by="dataset", compression="bzip2")
    again = ntriples.read_ntriples(spark, str(tmp_path / "out/dataset=labels"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))


def test_wiki_tars(spark, tmp_path):
    def pack(name, members):
        with tarfile.open(tmp_path / name, "w:gz") as tar:
            for n, text in members.items():
                raw = text.encode()
                info = tarfile.TarInfo(n)
                info.size = len(raw)
                tar.addfile(info, io.BytesIO(raw))

    pack("7~en~dc~dc.wikia.com.tar.gz", {"enwiki-20170801-labels.ttl": GOOD[1][0] + "\n", "enwiki-20170801-infobox-properties.ttl": GOOD[0][0] + "\n# c\n", "readme.txt": "x"})
    pack("8~de~mx~mx.wikia.com.tar.gz", {"dewiki-20170801-labels.ttl": GOOD[2][0]})
    got = ntriples.read_wiki_tars(spark, str(tmp_path / "*.tar.gz"))
    assert sorted((r.wiki_id, r.lang, r.domain, r.dataset, r.o) for r in got.collect()) == [
        (7, "en", "dc", "infobox-properties", "http://o"),
        (7, "en", "dc", "labels", "plain"),
        (8, "de", "mx", "labels", 'X \\"q\\"'),
    ]
    assert ntriples.read_wiki_tars(spark, str(tmp_path / "*.tar.gz"), ["homepages"]).count() == 0


def test_tar_streams(spark, tmp_path):
    """Members of many sizes, with long names, without a final newline, beside members that aren't wanted."""
    want = []
    for file, shape in (("1~en~a~a.host.tar.gz", tarfile.PAX_FORMAT), ("2~en~b~b.host.tar.gz", tarfile.GNU_FORMAT), ("3~en~c~c.host.tar.gz", tarfile.USTAR_FORMAT)):
        with tarfile.open(tmp_path / file, "w:gz", format=shape) as tar:
            for i, n in enumerate((0, 1, 3, 40, 700)):
                folder = "d" * (60 if shape == tarfile.USTAR_FORMAT else 120)
                name = f"{folder}/enwiki-20170801-labels{i}" + "x" * 30 + ".ttl"
                text = "".join(f"line é {i} {k}\r{'y' * (k * 7 % 600)}\n" for k in range(n))[: None if i % 2 else -1]
                for m, body in ((name, text), (f"other{i}.txt", "z\n" * 300)):
                    info = tarfile.TarInfo(m)
                    info.size = len(body.encode())
                    tar.addfile(info, io.BytesIO(body.encode()))
                want += [(file, name, x) for x in text.removesuffix("\n").split("\n") if text]
    got = ntriples.member_lines(spark, str(tmp_path / "*.tar.gz")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_alignment_details(spark, tmp_path):
    df = spark.createDataFrame([("a~b", "http://a/1", "http://b/1", "=", 1.0), ("a~c", "http://a/1", "null", "%", 1.0)], "pair string, source string, target string, relation string, confidence double")
    onto = "struct<about:string,location:string,formalism:string,formalism_uri:string>"
    details = spark.createDataFrame([("a~b", ("http://a&b", "file:a<b", "OWL", "http://owl"), ("http://b", "", "", ""))], f"pair string, onto1 {onto}, onto2 {onto}")
    for r in alignment.documents(df, {"method": "by <hand> & eye"}, details).collect():
        (tmp_path / f"{r.pair}~evaluation.xml").write_text(r.xml)
    got = {r.pair: r for r in alignment.read_details(spark, str(tmp_path / "*.xml")).collect()}
    assert got["a~b"].onto1.asDict() == {"about": "http://a&b", "location": "file:a<b", "formalism": "OWL", "formalism_uri": "http://owl"}
    assert got["a~b"].onto2.asDict() == {"about": "http://b", "location": "", "formalism": "", "formalism_uri": ""}
    assert got["a~c"].onto1.about == "http://a" and got["a~c"].extension == got["a~b"].extension == {"method": "by <hand> & eye"}
    assert alignment.read_alignments(spark, str(tmp_path / "*.xml")).count() == 2


def test_alignment_round_trip(spark, tmp_path):
    rows = [("a~b", "http://a/resource/X&Y", "http://b/resource/<Z>", "=", 1.0), ("a~b", "http://a/resource/Q", "null", "%", 0.25), ("a~c", "null", "http://c/class/K", "%", 1.0)]
    df = spark.createDataFrame(rows, "pair string, source string, target string, relation string, confidence double")
    docs = alignment.documents(df, {"note": "made here"}).collect()
    for r in docs:
        (tmp_path / f"{r.pair}~evaluation.xml").write_text(r.xml)
    got = alignment.read_alignments(spark, str(tmp_path / "*.xml"))
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert sorted(map(tuple, alignment.read_headers(spark, str(tmp_path / "*.xml")).collect())) == [("a~b", "http://a", "http://b"), ("a~c", "http://a", "http://c")]
    alignment.write_alignments(df, str(tmp_path / "out"))
    (tmp_path / "hand.txt").write_text("# <no> <no>\n<http://x/ontology/A> has <mid> = <http://y/B>\nnothing\n")
    assert [tuple(r) for r in alignment.read_hand_written(spark, str(tmp_path / "hand.txt")).collect()] == [("http://x/class/A", "http://y/B")]


def test_dumps(spark, tmp_path):
    text = "<mediawiki>\n<siteinfo><sitename>Demo</sitename></siteinfo>\n<page>\n<title>Main Page</title>\n<ns>0</ns>\n</page>\n<page>\n<title>Talk:X</title>\n<ns>1</ns>\n</page>\n<page>\n<title>Real</title>\n<ns>0</ns>\n</page>\n</mediawiki>\n"
    (tmp_path / "d.xml").write_text(text)
    assert sorted(r.title for r in dumps.page_titles(spark, str(tmp_path / "d.xml")).collect()) == ["Main Page", "Real"]
    assert sorted(r.title for r in dumps.page_titles_xml(spark, str(tmp_path / "d.xml")).collect()) == ["Main Page", "Real"]
    assert [r.site for r in dumps.site_names(spark, str(tmp_path / "d.xml")).collect()] == ["Demo"]
    titles = dumps.page_titles(spark, str(tmp_path / "d.xml")).select(F.col("file").alias("domain"), "title")
    assert [r.title for r in overlap.without_stop_titles(titles).collect()] == ["Real"]


def test_metadata(spark, tmp_path):
    raw = '{"id": 5, "title": "A\\r\\nB", "url": "http://my-site.wikia.com/", "lang": "en", "wam_score": 1.5, "stats": {"articles": 200}}'
    df = dumps.flatten_crawl(lines(spark, [raw, "broken {"]))
    got = df.where("id = 5").first()
    assert (got.title, got.stats_articles, got.stats_edits, got.desc) == ("A B", 200, 0, "")
    assert df.count() == 2
    urls = [r.url for r in dumps.guessed_dump_urls(df, "http://d").collect()]
    assert len(urls) == 6 and "http://d/m/my/mysite/mysite_pages_current.xml.7z" in urls
    page = 'x <a href="http://h/m/my/mysite_pages_current.xml.7z">d</a> <a href="http://h/m/my/mysite_pages_full.xml.gz">f</a>'
    links = lines(spark, [page]).select(F.explode(dumps.dump_links(F.col("value"))).alias("x")).select("x.*").collect()
    assert [(r.type, r.compression) for r in links] == [("current", "7z"), ("full", "gz")]
    full = df.withColumn("current_dump_url", F.when(F.col("id") == 5, "u"))
    assert dumps.with_dump_url(full).count() == 1 and dumps.usable(full).count() == 1
    other = full.withColumn("current_dump_url", F.lit("v"))
    assert [tuple(r) for r in dumps.changed_urls(full.where("id = 5"), other.where("id = 5")).collect()] == [(5, "u", "v")]


def test_corpus_and_crowd(spark, tmp_path):
    c = spark.createDataFrame([("t", 'say "hi"'), ("u", "")], "tag string, text string")
    dumps.write_corpus(c, str(tmp_path / "c"))
    assert sorted(map(tuple, dumps.read_corpus(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, c.collect()))
    xml = '<QuestionFormAnswers xmlns="http://x"><Answer><QuestionIdentifier>q1</QuestionIdentifier><FreeText>a1</FreeText></Answer><Answer><QuestionIdentifier>q2</QuestionIdentifier><FreeText>a2</FreeText></Answer></QuestionFormAnswers>'
    got = dumps.crowd_answers_xml(spark.createDataFrame([("w", xml)], "worker string, answer_xml string"), "answer_xml").collect()
    assert [(r.question, r.answer) for r in got] == [("q1", "a1"), ("q2", "a2")]
    assert dumps.filled("a ${x} ${y}", {"x": "1", "y": "2"}) == "a 1 2"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.nt").write_text(GOOD[1][0] + "\n" + GOOD[0][0] + "\n")
    stream = ingest.statement_stream(spark, str(tmp_path / "in"))
    index = spark.createDataFrame([("b", "plain", "Plain", "http://b/1"), ("a", "plain", "Plain", "http://a/1")], "domain string, key string, label string, resource string")
    for _ in range(2):
        ingest.append(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2  # the second run finds nothing new
    q = ingest.matched(stream, index, "a").writeStream.format("memory").queryName("met").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.source, r.target) for r in spark.table("met").collect()] == [(A, "http://b/1")]
    q = ingest.statement_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counted").agg(F.sum("statements")).first()[0] == 2
