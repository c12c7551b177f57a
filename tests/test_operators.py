import itertools
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import scalar as S
from weftgraph.operators import corpus, crowd, enrich, evaluate, fuse, match, overlap, stats
from weftgraph.operators.components import connected_components


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(300, 301), (301, 302), (302, 300), (9, 9)]
    edges += [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(40)] + [(1, 500), (500, 160)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges + [(None, 5), (6, None)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == union_find(edges)
    assert connected_components(df.limit(0)).count() == 0


def test_components_in_a_store(spark, tmp_path):
    df = spark.createDataFrame([("b", "a"), ("b", "c")], "src string, dst string")
    assert {r.component for r in connected_components(df, store=str(tmp_path)).collect()} == {"a"}


def test_classes_and_rewriting(spark):
    links = spark.createDataFrame([("u1", "u2"), ("u2", "u3"), ("x", "x")], "s string, o string")
    classes = fuse.equivalence_classes(links)
    got = {r.uri: r for r in classes.collect()}
    assert got["u1"].canonical == got["u3"].canonical != got["x"].canonical and got["u1"].size == 3 and got["x"].size == 1
    assert {r.uri for r in fuse.equivalence_classes(links, largest=2).collect()} == {"x"}
    t = spark.createDataFrame(
        [("u1", "p", "u2", "iri", "", "infobox-properties"), ("u3", "p", "u2", "literal", "@en", "infobox-properties"), ("u1", "p", "u2", "iri", "", "labels"), ("u1", "p", "zz", "iri", "", "disambiguations"), ("u1", "p", "u2", "iri", "", "other")],
        "s string, p string, o string, o_kind string, ext string, dataset string",
    )
    out = {(r.dataset, r.o_kind): r for r in fuse.rewrite_datasets(t, classes, "k/").collect()}
    one = "k/" + got["u1"].canonical
    assert out["infobox-properties", "iri"].s == out["infobox-properties", "iri"].o == one and out["infobox-properties", "iri"].p.startswith("k/")
    assert out["infobox-properties", "literal"].o == "u2"
    assert out["labels", "iri"].s == one and out["labels", "iri"].o == "u2" and out["labels", "iri"].p == "p"
    assert out["disambiguations", "iri"].o == "k/" + spark.range(1).select(S.uri_digest(F.lit("zz"))).first()[0]
    assert len(out) == 4
    assert [r.size for r in fuse.class_sizes(classes, 1).collect()] == [3]


def loop_counts(system, gold, kb1, kb2):
    links = {(s, t) for s, t, r in system if r == "="}
    tp = fp = fn = 0
    for s, t in gold:
        n_s, n_t = len({b for a, b in links if a == s}), len({a for a, b in links if b == t})
        if t == "null":
            fp += n_s
        elif s == "null":
            fp += n_t
        elif (s, t) in links:
            tp += 1
        else:
            fn += 1
            fp += (n_t if kb1 else 0) + (n_s if kb2 else 0)
    return tp, fp, fn


@pytest.mark.parametrize("kb1,kb2", itertools.product((True, False), repeat=2))
def test_partial_gold(spark, kb1, kb2):
    rng = random.Random(1)
    names = [f"http://x/resource/{i}" for i in range(8)]
    system = [(rng.choice(names), rng.choice(names), rng.choice("==%")) for _ in range(30)]
    gold = [(rng.choice([*names, "null"]), rng.choice(names)) for _ in range(12)] + [(rng.choice(names), "null") for _ in range(4)]
    s = spark.createDataFrame([("p", a, b, r, 1.0) for a, b, r in system], "pair string, source string, target string, relation string, confidence double")
    g = spark.createDataFrame([("p", a, b) for a, b in gold] + [("q", "http://x/resource/1", "http://x/resource/2")], "pair string, source string, target string")
    got = {r.pair: (r.tp, r.fp, r.fn) for r in evaluate.counts(s, g, ["pair"], kb1, kb2).collect()}
    assert got == {"p": loop_counts(system, gold, kb1, kb2), "q": (0, 0, 1)}
    q = [r for r in evaluate.scores(evaluate.counts(s, g, ["pair"])).collect() if r.pair == "q"][0]
    assert (q.precision, q.recall, q.f) == (1.0, 0.0, 0.0)


def test_leave_one_out_without_other_systems(spark):
    s = spark.createDataFrame([("p", "a", "b", "=", 0.3)], "pair string, source string, target string, relation string, confidence double")
    g = spark.createDataFrame([("p", "a", "b"), ("q", "c", "d")], "pair string, source string, target string")
    got = {r.pair: r for r in evaluate.leave_one_out(s, g).collect()}
    assert got["p"].threshold == 0.0 and got["p"].tp == 1 and got["q"].threshold == 0.3
    assert {r.kind for r in evaluate.by_kind(s.withColumn("source", F.lit("http://x/class/nullary"))).collect()} == {"class"}
    t = s.withColumn("target", F.lit("http://dcX/resource/1"))
    assert evaluate.target_in_domain(t, F.lit("dc")).count() == 0 and evaluate.target_in_domain(t, F.lit("dcX")).count() == 1


def test_redirect_chains_and_cycles(spark):
    r = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)] + [("a", "b"), ("b", "a"), ("z", "z"), ("m", "k1"), ("m", "k2")], "s string, o string")
    got = {x.s: (x.o, x.hops) for x in match.terminal_redirects(r).collect()}
    assert got["n0"] == ("n9", 9) and got["n8"] == ("n9", 1) and got["m"] == ("k2", 1)
    assert got["a"] == ("b", None) and "z" not in got


def test_scalar_functions(spark):
    df = spark.createDataFrame([("aBCd", "abcd"), ("X", "x"), ("", ""), (None, "x"), ("AbcdE", "AB")], "a string, b string")
    assert [r[0] for r in df.select(S.same_case(F.col("a"), F.col("b"))).collect()] == [2, 0, 0, 0, 1]
    v = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "x array<float>, y array<float>")
    assert [None if r[0] is None else round(r[0], 6) for r in v.select(S.cosine(F.col("x"), F.col("y"))).collect()] == [0.6, None, None]
    one = spark.createDataFrame([("  A\tb \n", "a:1;b:2", "2017-01-02", "03:04:05", "http://www.x.org/y/Z", "f.tar.gz", "http://q.wikia.com/wiki/A_B")], "t string, m string, d string, h string, u string, n string, w string")
    r = one.select(
        S.label_key(F.col("t")), S.annotation(F.col("m"))["b"], S.date_time(F.col("d"), F.col("h")).cast("string"), S.local_name(F.col("u")), S.resource_domain(F.col("u")),
        S.extension(F.col("n")), S.resource_of_page(F.col("w"), "http://kg/"), S.after_prefix(F.col("u"), 17), S.ontology_to_class(F.lit("a/ontology/b")), S.or_default(F.lit(""), "en"),
        F.size(S.tokens(F.col("t"))), S.dataset_of_member(F.lit("enwiki-2017-long-abstracts.ttl")),
    ).first()
    assert tuple(r) == ("a\tb", "2", "2017-01-02 03:04:05", "Z", "www.x.org", "gz", "http://kg/q/resource/A_B", "y/Z", "a/class/b", "en", 2, "long-abstracts.ttl")
    labels = spark.createDataFrame([("s", "b", "@de"), ("s", "a", "@en"), ("t", "c", "@fr")], "s string, label string, ext string")
    assert {x.s: x.l for x in labels.groupBy("s").agg(S.preferred_label(F.col("label"), F.col("ext")).alias("l")).collect()} == {"s": "a", "t": "c"}


def test_closure_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "sub string, super string")
    assert {(r.sub, r["super"]) for r in enrich.transitive_closure(e).collect()} == {(x, y) for x in "abc" for y in "abcd"}
    mapping = spark.createDataFrame([("k", "a"), ("l", "d")], "s string, o string")
    found = spark.createDataFrame([("k", "l"), ("l", "k")], "sub string, super string")
    assert [tuple(r) for r in enrich.supported(found, mapping, e).collect()] == []
    assert [tuple(r) for r in enrich.supported(found, mapping, enrich.transitive_closure(e)).collect()] == [("k", "l")]
    named = enrich.with_labels(found, spark.createDataFrame([("k", "K")], "s string, label string")).collect()
    assert {(r.sub, r.label_sub, r.label_super) for r in named} == {("k", "K", None), ("l", None, "K")}


def test_near_names(spark):
    rng = random.Random(2)
    names = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(60)} | {"", "a"}
    df = spark.createDataFrame([(n,) for n in sorted(names)] + [(None,)], "n string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    for most in (1, 2):
        got = {(r.a, r.b): r.distance for r in overlap.near_names(df, "n", most).collect()}
        assert got == {(a, b): distance(a, b) for a in names for b in names if a < b and distance(a, b) <= most}
    assert overlap.sampled(df, "n", 5, 3).collect() == overlap.sampled(df, "n", 5, 3).collect()


def test_crowd(spark):
    batch = spark.createDataFrame([("h", f"w{i}", "u1" if i < 3 else "u2", "no match") for i in range(5)] + [("g", "w0", "u1", "u1")], ["HITId", "WorkerId", "Answer.0_mapping_dst1", "Answer.0_mapping_dst2"])
    votes = crowd.complete_hits(crowd.answers(batch, items=1))
    decided = crowd.majority(votes, ["hit", "item", "dst"])
    assert {(r.dst, r.answer, r.n) for r in decided.collect()} == {(1, "u1", 3), (2, "no match", 5)}
    assert [tuple(r) for r in crowd.transitive_links(decided).collect()] == [("h", 0, "u1", "null", "%")]
    assert crowd.valid_answers(votes.withColumn("domain", F.lit("u1"))).count() == 8


def test_agreement_of_a_published_example(spark):
    # two coders, ten items: observed 0.7; both label 6 yes / 4 no and 5 yes / 5 no
    a, b = "YYYYYYNNNN", "YYYYNNYNNN"
    rows = [(str(i), "a", x) for i, x in enumerate(a)] + [(str(i), "b", x) for i, x in enumerate(b)]
    r = crowd.agreement(spark.createDataFrame(rows, "item string, coder string, label string")).first()
    po, pe = 0.7, 0.6 * 0.5 + 0.4 * 0.5
    assert r.kappa == r.multi_kappa == round((po - pe) / (1 - pe), 6)
    pi = (11 / 20) ** 2 + (9 / 20) ** 2
    assert r.scott_pi == round((po - pi) / (1 - pi), 6)
    de = 1 - (11 * 10 + 9 * 8) / (20 * 19)
    assert r.alpha == round(1 - 0.3 / de, 6)


def test_statistics(spark):
    df = spark.createDataFrame([("a", 3), ("b", 3), ("c", None), ("d", 9)], "k string, v int")
    assert {r.k: r["rank"] for r in stats.rank_series(df, "v", "k").collect()} == {"d": 1, "a": 2, "b": 3, "c": 4}
    assert [(r.value, r.n) for r in stats.frequency(df, "v", missing="Missing").collect()] == [("3", 2), ("9", 1), ("Missing", 1)]
    assert stats.monthly(spark.createDataFrame([], "t timestamp"), F.col("t")).count() == 0


def test_word_vectors(spark):
    c = spark.createDataFrame([(f"t{i}", "red green blue " * 5) for i in range(6)], "tag string, text string")
    rows = corpus.document_vectors(c, size=8, least=1).collect()
    assert len(rows) == 6 and all(len(r.vector) == 8 for r in rows)
