"""From archives of dumps to a fused and enriched graph, and the parts on the way."""

import gzip
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from weftgraph import schemas as K
from weftgraph.operators import enrich, fuse, indexes, match, stats
from weftgraph.sources import dumps, ntriples

A, B = "http://kg.example.org/a", "http://kg.example.org/b"


def archive(folder, name, members):
    with tarfile.open(folder / name, "w:gz") as tar:
        for n, lines in members.items():
            raw = "".join(x + "\n" for x in lines).encode()
            info = tarfile.TarInfo(n)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))


def iri(s, p, o):
    return f"<{s}> <{p}> <{o}> ."


def text(s, o, lang="en", p=K.LABEL_P):
    return f'<{s}> <{p}> "{o}"@{lang} .'


@pytest.fixture(scope="module")
def dump(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dumps")
    for n, (wiki, base, other) in enumerate((("a", A, "Hero"), ("b", B, "hero"))):
        r = lambda x: f"{base}/resource/{x}"
        prefix = "enwiki-20170801-"
        archive(folder, f"{n + 1}~en~{wiki}~{wiki}.example.org.tar.gz", {
            prefix + "labels.ttl": [text(r("Batman"), "Batman"), text(r("Bats"), "Bats"), text(r("Robin"), f" Robin {n}"), text(r("City"), "Gotham")],
            prefix + "transitive-redirects.ttl": [iri(r("Bats"), "http://r", r("Batman"))],
            prefix + "disambiguations.ttl": [iri(r("City"), "http://d", r("Batman")), iri(r("City"), "http://d", r("Robin"))],
            prefix + "template-type.ttl": [iri(r(x), K.TYPE_P, f"{base}/class/{other}") for x in ("Batman", "Robin")],
            prefix + "template-type-definitions.ttl": [text(f"{base}/class/{other}", other), text(f"{base}/class/{other}", "Held", "de"), iri(f"{base}/class/{other}", K.TYPE_P, K.CLASS)],
            prefix + "infobox-property-definitions.ttl": [text(f"{base}/property/partner", "partner")],
            prefix + "infobox-properties.ttl": [iri(r("Batman"), f"{base}/property/partner", r("Robin")), iri(r("Robin"), f"{base}/property/partner", r("Batman")), text(r("Batman"), "dark", p=f"{base}/property/mood")],
        })
    return ntriples.read_wiki_tars(spark, str(folder / "*.tar.gz")).cache()


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_wiki_indexes(dump):
    assert rows(indexes.source_index(dump, "class"), "domain", "key", "label") == [("a", "held", "Held"), ("a", "hero", "Hero"), ("b", "held", "Held"), ("b", "hero", "hero")]
    assert rows(indexes.labels(indexes.dataset(dump, indexes.CLASSES), "en"), "domain", "label") == [("a", "Hero"), ("b", "hero")]
    assert rows(indexes.source_index(dump, "property"), "domain", "key") == [("a", "partner"), ("b", "partner")]
    plain = indexes.source_index(dump, "instance")
    assert rows(plain.where("domain = 'a'"), "key", "resource") == [("batman", f"{A}/resource/Batman"), ("gotham", f"{A}/resource/City"), ("robin 0", f"{A}/resource/Robin")]
    spread = indexes.source_index(dump, "instance with disambiguations")
    assert rows(spread.where("domain = 'b' AND key = 'gotham'"), "resource") == [(f"{B}/resource/{x}",) for x in ("Batman", "City", "Robin")]
    with pytest.raises(ValueError):
        indexes.source_index(dump, "other")
    assert indexes.source_index(dump.limit(0), "instance").count() == 0


def test_reference_indexes(spark):
    onto = spark.createDataFrame(
        [("o/A", K.TYPE_P, K.CLASS, "iri", ""), ("o/A", K.LABEL_P, "Alpha", "literal", "@en"), ("o/A", K.LABEL_P, "Aleph", "literal", "@he"), ("o/B", K.TYPE_P, K.CLASS, "iri", ""),
         ("o/B", K.LABEL_P, "Bet", "literal", "@he"), ("o/p", K.TYPE_P, K.OBJECT_PROPERTY, "iri", ""), ("o/p", K.TYPE_P, K.DATATYPE_PROPERTY, "iri", ""), ("o/p", K.LABEL_P, " pee ", "literal", "@en"),
         ("o/A", K.SUBCLASS_P, "o/B", "iri", ""), ("o/B", K.SUBCLASS_P, "o/C", "iri", ""), ("o/C", K.SUBCLASS_P, "z/D", "iri", "")],
        "s string, p string, o string, o_kind string, ext string",
    )
    moved = spark.createDataFrame([("o/B", "o/Bet2"), ("o/p", "o/q")], "s string, o string")
    assert rows(indexes.class_index(onto, moved, "o"), "key", "resource") == [("a", "o/A"), ("alpha", "o/A"), ("bet", "o/Bet2"), ("bet2", "o/Bet2")]
    assert rows(indexes.property_index(onto, moved, "o"), "key", "label", "resource") == [("p", "p", "o/q"), ("pee", "pee", "o/q")]
    closure = enrich.transitive_closure(indexes.subclass_links(onto, "o/"))
    assert rows(closure, "sub", "super") == [("o/A", "o/B"), ("o/A", "o/C"), ("o/B", "o/C")]
    assert [(r.s, r.targets) for r in indexes.multimap(spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "a")], "s string, o string")).collect()] == [("x", ["a", "b"])]


def test_gold_faults(spark, dump):
    gold = spark.createDataFrame([("a", f"{A}/resource/{x}") for x in ("Batman", "Bats", "Joker", "Joker")] + [("b", f"{A}/resource/Batman")], "domain string, source string")
    found = indexes.gold_faults(gold, indexes.links(indexes.dataset(dump, indexes.REDIRECTS)), indexes.subjects(dump))
    assert rows(found, "domain", "source", "resource", "fault") == [
        ("a", f"{A}/resource/Bats", f"{A}/resource/Batman", "redirect"),
        ("a", f"{A}/resource/Joker", f"{A}/resource/Joker", "not found"),
        ("b", f"{A}/resource/Batman", f"{A}/resource/Batman", "not found"),
    ]


def test_from_archives_to_the_fused_graph(spark, dump, tmp_path):
    """Read, index, match, link, fuse, drop repeats, enrich, write, and read again."""
    links = None
    for kind in ("class", "property", "instance"):
        index = indexes.source_index(dump, kind)
        labels = index.select("domain", F.col("resource").alias("s"), "label")
        found = match.all_match(labels, index).where("domain < target_domain").select("source", "target")
        part = match.link_triples(found)
        links = part if links is None else links.unionByName(part)
    assert rows(links.distinct(), "s", "o") == sorted(
        [(f"{A}/class/Hero", f"{B}/class/hero"), (f"{A}/property/partner", f"{B}/property/partner"), (f"{A}/resource/Batman", f"{B}/resource/Batman"), (f"{A}/resource/City", f"{B}/resource/City")]
    )
    classes = fuse.equivalence_classes(links.select("s", "o"))
    fused = fuse.unique_statements(fuse.rewrite_datasets(dump, classes, "http://kg/").select("dataset", "s", "p", "o", "o_kind", "ext"))
    name = {r.uri: "http://kg/" + r.canonical for r in classes.collect()}
    batman, hero = name[f"{A}/resource/Batman"], name[f"{A}/class/Hero"]
    assert batman == name[f"{B}/resource/Batman"]
    types = fused.where("dataset = 'template-type'")
    assert rows(types.where(F.col("s") == batman), "p", "o") == [(K.TYPE_P, hero)]
    facts = fused.where("dataset = 'infobox-properties'")
    found = enrich.domains_and_ranges(facts, types.select("s", "o"))
    path = str(tmp_path / "out")
    ntriples.write_ntriples(enrich.restriction_triples(found), path, compression="gzip")
    back = ntriples.read_ntriples(spark, path)
    partner = name[f"{A}/property/partner"]
    assert {(r.p, r.o) for r in back.where(F.col("s") == partner).collect()} == {(K.DOMAIN_P, types.first().o), (K.RANGE_P, types.first().o)}
    assert back.where(F.col("o") == K.LITERAL).count() == 2  # the mood of each source's own property
    again = ntriples.read_ntriples(spark, path)
    assert again.count() == back.count()


def test_dump_links_and_listing(spark, tmp_path):
    html = '<a href="http://h/x_pages_current.xml.7z">2017-01-01 00:00:00</a><a href="http://h/y_pages_current.xml.gz">2017-02-02 00:00:00</a><a href="http://h/z_pages_full.xml.gz">soon</a>'
    r = dumps.last_dump_links(spark.createDataFrame([(html,), (None,)], "html string"), "html").orderBy(F.desc("current_dump_url")).collect()
    assert (r[0].current_dump_url, r[0].current_compression, r[0].current_date, r[0].full_dump_url, r[1].current_dump_url) == ("http://h/y_pages_current.xml.gz", "gz", "2017-02-02", "", "")
    for n in (10, 9, 100):
        (tmp_path / f"{n}~en~w{n}~h.tar.gz").write_bytes(gzip.compress(b"x" * n))
    (tmp_path / "readme").write_text("x")
    got = dumps.natural_order(dumps.read_listing(spark, str(tmp_path)), "file").collect()
    assert [x.wiki_id for x in got] == [None, 9, 10, 100] and [x.domain for x in got if x.wiki_id] == ["w9", "w10", "w100"]


def test_last_standing(spark):
    """Against the rounds played one by one."""
    import random

    rng = random.Random(1)
    probes = [(g, c, i, int(rng.random() < 0.6)) for g in range(30) for c in range(rng.randrange(1, 6)) for i in range(6)]
    want = set()
    for g in {p[0] for p in probes}:
        alive = {c: 0 for k, c, *_ in probes if k == g}
        for i in range(6):
            for c in alive:
                alive[c] += next(h for k, d, j, h in probes if (k, d, j) == (g, c, i))
            most = max(alive.values())
            alive = {c: n for c, n in alive.items() if n == most}
        want |= {(g, c) for c in alive}
    got = stats.last_standing(spark.createDataFrame(probes, "group int, candidate int, round int, hit int"))
    assert {(r.group, r.candidate) for r in got.collect()} == want


def test_written_archives(spark, dump, tmp_path):
    made = ntriples.write_wiki_tars(dump, str(tmp_path)).collect()
    assert sorted((r.file, r.members) for r in made) == [("1~en~a~a.example.org.tar.gz", 7), ("2~en~b~b.example.org.tar.gz", 7)]
    columns = ["wiki_id", "dataset", "s", "p", "o", "ext"]
    assert rows(ntriples.read_wiki_tars(spark, str(tmp_path / "*.tar.gz")), *columns) == rows(dump, *columns)


def test_filled_rows(spark):
    df = spark.createDataFrame([(1, "x${b}", None)], "a int, b string, c string")
    assert dumps.filled_rows(df, "${a}-${b}-${c}-${d} ${").first().text == "1-x${b}--${d} ${"
