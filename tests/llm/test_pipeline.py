import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.test_minhash import varied
from weftgraph.llm import m01_lines, m09_ordinal, queries
from weftgraph.llm.common import staged

pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def plain_near(rows, n=5):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c.group().lower(), t or ""))
        sets.append({tuple(w[i : i + min(n, len(w))]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return {k for k, _ in rows if find(k) == k}


def plain_cut(rows, window=13):
    word = r"[^\x20\x09-\x0D]+"
    first, out = {}, {}
    for k, t in rows:
        w = re.findall(word, t or "")
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            first[x] = min(first.get(x, k), k)
    for k, t in rows:
        w = re.findall(word, t or "")
        gone = {i + j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < k for j in range(window)}
        pieces = re.findall(word + r"[\x20\x09-\x0D]*", t or "")
        out[k] = "".join(p for i, p in enumerate(pieces) if i not in gone) if gone else t
    return out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = queries.quality_model(spark, DATA)
    scored = {r.doc_id: r.kept for r in m09_ordinal.score(docs, model, queries.CLEAN, queries.CLEAN_PROBABILITY).collect()}
    assert 0.5 < sum(scored.values()) / len(scored) < 1
    want = {k: t for k, t in rows if scored[k]}
    for name, stage in pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        got = {r.doc_id: r for r in docs.collect()}
        if name == "line_quality":
            judged = {k: m01_lines.judge(t.encode(), m01_lines.LineRules()) for k, t in want.items()}
            want = {k: v[-1] for k, v in judged.items() if v[6]}
        elif name == "minhash_groups":
            keep = plain_near(sorted(want.items()))
            want = {k: t for k, t in want.items() if k in keep}
        elif name == "recompress":
            want = plain_cut(sorted(want.items()))
        assert {k: r.text for k, r in got.items()} == want, name
        assert all(r.n_chars == len(r.text) for r in got.values())
    tokens = Tokenizer.from_file(queries.WORD_BPE)
    pieces = {}
    for r in pipeline.STAGES[-1][1](spark, docs, DATA).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(want)
    for k, t in want.items():
        ids, at = tokens.encode(t, add_special_tokens=False).ids + [1], 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    rerun = pipeline.run(spark, DATA).collect()
    digest = lambda rs: hashlib.sha256(repr(sorted((r.doc_id, r.start, r.ids_crc32) for r in rs)).encode()).hexdigest()
    assert digest(rerun) == digest([r for p in pieces.values() for r in p])


def test_stages_take_odd_rows(spark):
    texts = [None, "", "x" * 20_000, *varied(3, 12, 6, 90), *varied(4, 4, 0, 90)]
    rows = [(i, t and t + ".", "en", "s", None, "clash") for i, t in enumerate(texts)] + [(None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, starts string")
    for _, stage in pipeline.STAGES[1:]:
        assert stage(spark, df.limit(0), "").count() == 0
        assert stage(spark, df, "").count() >= 0
    kept = pipeline.distinct_documents(spark, df, "")
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert None in ids and {r for r in range(len(texts))} & ids == plain_near([(i, t and t + ".") for i, t in enumerate(texts)])


EXTRA = """CAST(doc_id % 7 AS int) AS _n, CAST(text AS binary) AS _doc, array(doc_id, null) AS _starts, map('k', named_struct('b', X'FF00')) AS _runs,
  'q' AS _id, 1 AS id, 2Y AS n, DATE'2020-01-01' AS grade, 1.5BD AS run, TIMESTAMP'2020-01-01 00:00:00' AS starts, 'z' AS key, true AS kept"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_stages_leave_other_columns_alone(spark):
    """Columns named as inner ones, binary and nested: unchanged in every row that is kept, through all five stages."""
    docs = spark.sql(f"SELECT *, {EXTRA} FROM parquet.`{DATA}/documents.parquet`")
    columns = docs.columns
    others = [c for c in columns if c not in ("text", "n_chars")]
    want = {r.doc_id: tuple(r[c] for c in others) for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, DATA), name)
        assert docs.columns == columns, name
        got = {r.doc_id: tuple(r[c] for c in others) for r in docs.collect()}
        assert got and all(want[k] == v for k, v in got.items()), name
    assert {r.doc_id for r in pipeline.STAGES[-1][1](spark, docs, DATA).collect()} == set(got)
