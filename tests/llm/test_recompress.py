import hashlib
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import m10_recompress as m


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window=13):
    first = {}
    for k, t in rows:
        w = split(t)
        for i in range(len(w) - window + 1 if k is not None else 0):
            x = tuple(w[i : i + window])
            first[x] = min(first.get(x, k), k)
    out = []
    for k, t in rows:
        w = split(t)
        gone = set()
        for i in range(len(w) - window + 1 if k is not None else 0):
            if first[tuple(w[i : i + window])] < k:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((k, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, parts=3, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS starts", "1 AS n", "2 AS _doc").repartition(parts)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in m.digest_removals(df, **options).collect()), key=str)
    assert got == brute(rows)


def test_removals(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "a"] + [f"w{i}" for i in range(400)])
    passages = [[word() for _ in range(rng.choice([12, 13, 14, 25, 80]))] for _ in range(12)] + [["the"] * 40, ["a", "b"] * 20]
    rows = []
    for k in range(160):
        w = []
        for _ in range(rng.randrange(1, 7)):
            w += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(30))]
        rows.append((1000 - k, (rng.choice([" ", "\n", " \t "])).join(w)))
    rows += [(3, rows[0][1]), (4, rows[0][1]), (5, None), (6, ""), (7, " \n "), (8, "short text"), (9, "short text"), (None, rows[0][1]), (None, None)]
    rows += [(20, "z " * 30_000), (21, "z " * 12), (22, "z " * 13), (30, rows[4][1]), (30, rows[4][1]), (-5, rows[9][1])]
    check(spark, rows)
    check(spark, rows, 1)
    check(spark, rows, 2, most_bits=64)  # more symbols than a bitmap tells apart


def test_empty(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string").limit(0)
    assert m.digest_removals(df).count() == 0 and m.strip_repeats(df).count() == 0


def test_stripped_texts(spark):
    long = " ".join(f"w{i}" for i in range(20))
    rows = [(1, "A\n" + long + "\nB  c.", "en", 5), (2, "x\ty " + long + "\n\nThe  end", "de", 6), (3, "Nothing  here\n", "fr", 7), (4, None, None, None), (5, long, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: r for r in m.strip_repeats(df).collect()}
    assert [got[k].text for k in range(1, 6)] == [rows[0][1], "x\ty The  end", rows[2][1], None, ""]
    assert [got[k].lang for k in range(1, 6)] == ["en", "de", "fr", None, "x"]


def test_first_windows_elect_like_later_ones():
    """A symbol whose context reaches before the first window's end, at a batch's very beginning."""
    passage = [0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1, 0, 0]

    def key(words, at):
        names = np.asarray(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return m.elected(names, np.zeros(len(words), np.int64), 1 + np.asarray(words) % 3, 13, 1)[at]

    assert key([1, *passage], 1) == key([*passage, 1], 0)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=13, max_size=25), st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12), st.integers(1, 3))
def test_equal_windows_elect_alike(passage, before, after, rounds):
    """Whatever stands around a passage, its windows elect the same symbol, where any."""

    def keys(words, at):
        names = np.asarray([hash((7, w)) & (1 << 62) for w in words], np.uint64) + np.asarray(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return m.elected(names, np.zeros(len(words), np.int64), 1 + np.asarray(words) % 3, 13, rounds)[at : at + len(passage) - 12].tolist()

    assert keys(before + passage + after, len(before)) == keys(after + passage + before, len(after))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_driver_table(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()])


def test_two_lanes_share_nothing(spark):
    """Windows that agree in one lane alone aren't taken for each other."""
    met = m.Met()
    met.add(np.array([5, 9]), np.array([1, 1]), np.array([10, 10]))
    assert met.smaller(np.array([5, 5, 9, 4]), np.array([1, 2, 1, 1]), np.array([11, 11, 10, 11])).tolist() == [True, False, False, False]
    import pyarrow as pa

    lanes = m.Reader(2)(pa.array(["a b", "a c"]))[0]
    assert lanes[0][0] == lanes[0][2] and lanes[1][0] == lanes[1][2] and (lanes[0] != lanes[1]).all()


def test_extra_columns_of_any_name(spark):
    long = " ".join(f"w{i}" for i in range(20))
    rows = [(1, "a " + long, 5, b"\xff\x00", {"k": [1, None]}), (2, "x\ty " + long + " end", 6, None, None), (3, "alone", 7, b"", {})]
    df = spark.createDataFrame(rows, "doc_id int, text string, _n int, _doc binary, _runs map<string, array<int>>").selectExpr("*", "'q' AS _starts", "struct(1 AS a) AS n", "1 AS id")
    got = {r.doc_id: r for r in m.strip_repeats(df).collect()}
    assert m.strip_repeats(df).schema.names == df.columns
    assert {k: (r.text, r._n, r._doc and bytes(r._doc), r._runs, r._starts, r.n.a, r.id) for k, r in got.items()} == {
        k: ("x\ty end" if k == 2 else t, n, b, x, "q", 1, 1) for k, t, n, b, x in rows
    }
    with pytest.raises(TypeError):
        m.digest_removals(df.selectExpr("CAST(doc_id AS string) AS doc_id", "text"))
