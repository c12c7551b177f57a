"""Queries over their whole tables, on small tables of which a filtered query would lose a part."""

import random

from weftgraph.operators import match, overlap
from weftgraph.plans import queries


def stored(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_values_of_every_property(spark, tmp_path):
    d = stored(
        spark,
        tmp_path,
        orders=([(1, 7, "1-URGENT"), (2, 7, "5-LOW")], "o_orderkey long, o_custkey long, o_orderpriority string"),
        lineitem=([(1, 4), (2, 4), (2, 5)], "l_orderkey long, l_partkey long"),
        customer=([(7, 3)], "c_custkey long, c_nationkey int"),
    )
    got = {tuple(r) for r in queries.QUERIES["values_by_property_all"](spark, d).select("key", "value", "n").collect()}
    assert got == {
        ("prop/part", "4", 2), ("prop/part", "5", 1), ("prop/customer", "7", 2), ("prop/nation", "3", 1),
        ("prop/priority", "1-URGENT", 1), ("prop/priority", "5-LOW", 1),
    }


def test_candidates_of_every_brand(spark, tmp_path):
    part = [(i, f"Brand#{1 + i % 4}", f"name {i % 3}") for i in range(1, 25)]
    d = stored(spark, tmp_path, part=(part, "p_partkey long, p_brand string, p_name string"))
    got = [tuple(r) for r in queries.QUERIES["interwiki_candidates_all"](spark, d).select("source", "target_domain", "target", "n").collect()]
    n = {(b, x): sum(1 for _, c, y in part if (b, x) == (c, y)) for _, b, x in part}
    want = [(f"part/{i}", c, f"part/{j}", n[c, y]) for i, b, x in part for j, c, y in part if x == y and b != c]
    assert sorted(got) == sorted(want)
    assert {b for _, b, _ in part} == {r.domain for r in queries.QUERIES["interwiki_candidates_all"](spark, d).select("domain").distinct().collect()}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def nearest(left, right):
    best = {a: min(distance(a, b) for b in right) for a in left}
    return {(f"x/{a}", f"y/{b}", best[a]) for a in left for b in right if distance(a, b) == best[a]}


def test_nearest_of_every_name(spark, tmp_path):
    part = [(1, "red anvil", "red awl"), (2, "old bolt", "bold"), (3, "cold cog", "bold"), (5, "zinc", "old")]
    d = stored(spark, tmp_path, part=(part, "p_partkey long, p_name string, p_type string"))
    got = {tuple(r) for r in queries.QUERIES["nearest_names_all"](spark, d).collect()}
    assert got == nearest({p[1] for p in part}, {p[2] for p in part})


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BOUNDING_NAMES", 2)
    rng = random.Random(5)
    word = lambda most: "".join(rng.choice("abcé") for _ in range(rng.randrange(most)))
    left, right = {word(12) for _ in range(70)} | {""}, {word(9) for _ in range(50)} | {"abc"}
    a = spark.createDataFrame([(f"x/{n}",) for n in left] + [(None,)], "key string")
    b = spark.createDataFrame([(f"y/{n}",) for n in right] + [(None,)], "key string")
    got = [tuple(r) for r in overlap.nearest_strings(a, b, most_pairs=0).collect()]
    assert len(got) == len(set(got)) and set(got) == nearest(left, right)
    assert overlap.nearest_strings(a, b.where("key IS NULL"), most_pairs=0).count() == 0
    salted = overlap._nearest_in_blocks(a, b.withColumnRenamed("key", "other"), 25_000, 100_000)
    assert {tuple(r) for r in salted.collect()} == set(got)


def test_schema_candidates_of_every_brand(spark, tmp_path):
    part = [("Brand#1", "bran", "a"), ("Brand#1", "bran", "b"), ("Brand#3", "Brand", "a"), ("Brand#9", "brand#9", "c"), ("Brand#9", "bran", "c")]
    d = stored(spark, tmp_path, part=(part, "p_brand string, p_type string, p_name string"))
    got = {tuple(r) for r in queries.QUERIES["schema_candidates_all"](spark, d).collect()}
    brands, types = {p[0] for p in part}, {p[1] for p in part}
    values = lambda i, k: {p[2] for p in part if p[i] == k}
    shared = {(b, t): len(values(0, b) & values(1, t)) for b in brands for t in types}
    most = {b: max(shared[b, t] for t in types) for b in brands}
    want = {(f"x/{b}", f"y/{t}", "value") for b, t in shared if shared[b, t] == most[b] > 0}
    want |= {(a, b, "name") for a, b, _ in nearest(brands, types)} | {(f"x/{b}", "null", "none") for b in brands}
    assert got == want


def test_tokens_of_every_document(spark, tmp_path):
    documents = [(1, "one two", "en"), (2, " un  deux\ttrois ", "fr"), (3, "eins", "de"), (4, "a b c d", None)]
    d = stored(spark, tmp_path, documents=(documents, "doc_id long, text string, lang string"))
    got = {tuple(r) for r in queries.QUERIES["corpus_tokens_all"](spark, d).collect()}
    assert got == {(i, len(text.split())) for i, text, _ in documents}


def test_long_redirect_chains(spark):
    links = [(f"n{i}", f"n{i + 1}") for i in range(100)] + [("a", "b"), ("b", "a"), ("c", "a")]
    got = {r.s: (r.o, r.hops) for r in match.terminal_redirects(spark.createDataFrame(links, "s string, o string")).collect()}
    assert got == {f"n{i}": ("n100", 100 - i) for i in range(100)} | {"a": ("b", None), "b": ("a", None), "c": ("a", None)}


def test_every_month_and_a_gap(spark, tmp_path):
    spark.sql("SELECT explode(array(DATE'2020-03-31', DATE'2020-05-01', DATE'2020-05-31', DATE'2020-07-02')) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in queries.QUERIES["rows_by_month_all"](spark, str(tmp_path)).collect()}
    assert got == {("2020-03-31", 1), ("2020-04-30", 0), ("2020-05-31", 2), ("2020-06-30", 0), ("2020-07-31", 1)}


def test_clusters_of_near_names(spark, tmp_path):
    names = ["cold cog", "old cog", "old cot", "bolt", "bold", "anvil", "anvil"]
    d = stored(spark, tmp_path, part=([(n,) for n in names], "p_name string"))
    got = {tuple(r) for r in queries.QUERIES["name_clusters_all"](spark, d).collect()}
    assert got == {("cold cog", "cold cog"), ("old cog", "cold cog"), ("old cot", "cold cog"), ("bolt", "bold"), ("bold", "bold"), ("anvil", "anvil")}
