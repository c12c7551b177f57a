import base64
import hashlib
import zlib
from functools import cache

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftgraph.llm import m02_bpe, m03_packing, m07_orc, queries
from weftgraph.llm.word_tokens import WordIds

TEXTS = [
    None,
    "",
    " ",
    "It's  a test,\n\n naïve — 日本語 test 123456 !!! \x85 é́  x",
    "<|endoftext|> and <|startoftext|>",
    "a" * 5000,
    " \t\n" * 700 + "end",
    "word " * 9000,
    "It's  a test,\n\n naïve — 日本語 test 123456 !!! \x85 é́  x",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.BYTE_BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return m02_bpe.Coder(queries.BYTE_BPE, P.PATTERN, memo=50)


def test_bpe_documents(docs, tik):
    got = {r.doc_id: r for r in m02_bpe.digest_documents(docs, queries.BYTE_BPE, P.PATTERN).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = tik.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    full = m02_bpe.encode_documents(docs, queries.BYTE_BPE, P.PATTERN).collect()
    assert all(bytes(r.decoded) == (TEXTS[r.doc_id] or "").encode() for r in full)
    assert m02_bpe.digest_documents(docs.limit(0), queries.BYTE_BPE, P.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abehnorst  '’s\n\tÉé日1!?*"), max_size=60))
def test_bpe_any_text(tik, coder, text):
    assert coder.encode(text) == tik.encode_ordinary(text)


def test_bpe_edit_makes_a_contraction(tik, coder):
    e = m02_bpe.TextEncoder(coder.v, P.PATTERN, "11'r1").replace(4, 4, "e")
    assert e.tokens() == tik.encode_ordinary("11're1")


@settings(max_examples=2000, deadline=None)
@given(st.data())
def test_bpe_edits(tik, coder, data):
    alphabet = st.sampled_from("abehnorst   '\n1!é")
    text = data.draw(st.text(alphabet=alphabet, max_size=40))
    e = m02_bpe.TextEncoder(coder.v, P.PATTERN, text)
    for _ in range(3):
        a = data.draw(st.integers(0, len(e.text)))
        b = data.draw(st.integers(a, len(e.text)))
        e.replace(a, b, data.draw(st.text(alphabet=alphabet, max_size=6)))
        assert e.tokens() == tik.encode_ordinary(e.text)
    e.append(data.draw(st.text(alphabet=alphabet, max_size=6)))
    assert e.tokens() == tik.encode_ordinary(e.text)


@cache
def word_tokenizer():
    return Tokenizer.from_file(queries.WORD_BPE)


def word_ids(text):
    return word_tokenizer().encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=50) | st.text(alphabet=st.sampled_from("abcÅÅ ΣσΑ'’s\n\t\x0b\x1c\x85\xa0 ́İ1<|>"), max_size=50))
def test_word_ids(text):
    got = WordIds.of(queries.WORD_BPE).ids_many(pa.array([text, None, "", "a b", text + " x"]))
    assert [x.tolist() for x in got] == [word_ids(t) for t in (text, "", "", "a b", text + " x")]
    assert WordIds.of(queries.WORD_BPE).by_word


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_orc(spark, docs, tmp_path):
    got = m07_orc.store_documents(docs, queries.WORD_BPE, 2, rows_per_block=2).orderBy("doc_id").collect()
    at = 0
    for r, t in zip(got, TEXTS, strict=True):
        ids = word_ids(t) + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    path = str(tmp_path / "orc")
    m07_orc.write_orc(docs, path, queries.WORD_BPE, 2)
    assert m07_orc.lookup(spark, path, [3]).first().ids == word_ids(TEXTS[3]) + [2]
    assert m07_orc.store_documents(docs.limit(0), queries.WORD_BPE, 2).count() == 0
    odd = spark.createDataFrame([(None, "a"), (5, "b c"), (5, "b c"), (-1, None)], "doc_id long, text string")
    rows = m07_orc.store_documents(odd, queries.WORD_BPE, 2).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in rows] == [(None, 0), (-1, 2), (5, 3), (5, 6)]


def test_orc_starts_of_sparse_ids(spark):
    """Random 64-bit ids, a third of all rows under one id, several files and groups of files; no window over all rows."""
    rng = np.random.default_rng(3)
    ids = [int(i) for i in rng.integers(-(1 << 62), 1 << 62, 400)] + [7] * 200
    rows = [(k, "w " * int(n)) for k, n in zip(ids, rng.integers(0, 9, 600))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = m07_orc.store_documents(df, queries.WORD_BPE, 2, rows_per_block=16)
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    windows = [line for line in plan.splitlines() if line.startswith("Arguments: [") and "windowspecdefinition" in line]
    assert windows and all(not line.rstrip().endswith("ROWS)") and line.count("], [") >= 1 for line in windows)
    got = sorted(got.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(ids)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    sizes = spark.createDataFrame([(i, i % 5 + 1) for i in range(40)], "file int, size long")
    bases = {r.file: r.base for r in m07_orc.file_bases(sizes, group=7).collect()}
    assert bases == {i: sum(j % 5 + 1 for j in range(i)) for i in range(40)}


def test_orc_layout(spark, tmp_path):
    """Stripes, run-length ids, row index and Bloom filter are in the files, and ids outside are pruned."""
    from pyarrow import orc

    rows = [(i, f"word{i % 50} and more " * 3) for i in range(30_000)]
    path = str(tmp_path / "orc")
    m07_orc.write_orc(spark.createDataFrame(rows, "doc_id long, text string"), path, queries.WORD_BPE, 2, bytes_per_file=1 << 20, stripe_bytes=1 << 16)
    files = sorted(tmp_path.glob("orc/*.orc"))
    assert len(files) > 1 and all(orc.ORCFile(f).nstripes > 1 for f in files)
    spans = [orc.ORCFile(f).read(columns=["doc_id"]).column(0).to_numpy() for f in files]
    assert all((np.diff(x) > 0).all() for x in spans) and all(a[-1] < b[0] for a, b in zip(spans, spans[1:]))
    reader = spark._jvm.org.apache.orc.OrcFile.createReader(
        spark._jvm.org.apache.hadoop.fs.Path(str(files[0])), spark._jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration())
    )
    assert reader.getRowIndexStride() == 10_000
    stripe = reader.getStripes().get(0)
    kinds, encodings = set(), set()
    footer = reader.rows().readStripeFooter(stripe) if hasattr(reader.rows(), "readStripeFooter") else None
    if footer is not None:
        kinds = {str(footer.getStreams(i).getKind()) for i in range(footer.getStreamsCount())}
        encodings = {str(footer.getColumns(i).getKind()) for i in range(footer.getColumnsCount())}
        assert "BLOOM_FILTER_UTF8" in kinds and "ROW_INDEX" in kinds and "DIRECT_V2" in encodings
    found = m07_orc.lookup(spark, path, [17, 29_999, 99_999_999])
    assert sorted(r.doc_id for r in found.collect()) == [17, 29_999]
    assert "PushedFilters: [In(doc_id" in found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("per_partition", [4_000_000, 3000])
def test_packing(docs, per_partition):
    rows = m03_packing.pack(docs, queries.WORD_BPE, 1, 64, per_partition).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(len(TEXTS)))
    for k, pieces in by_doc.items():
        ids, at = word_ids(TEXTS[k]) + [1], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and bytes(r.ids) == np.asarray(ids[at : at + r.length], "<u4").tobytes()
            assert r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    short = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 64
        short += at < 64
    assert short <= (1 if per_partition > 3000 else 10)
    assert m03_packing.pack(docs.limit(0), queries.WORD_BPE, 1).count() == 0


def plain_hilbert(point, bits):
    """The curve's definition cell by cell, one point and one bit at a time."""
    x, n = list(point), len(point)
    for q in [1 << b for b in range(bits - 1, 0, -1)]:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ t, x[i] ^ t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for q in [1 << b for b in range(bits - 1, 0, -1)]:
        t ^= q - 1 if x[n - 1] & q else 0
    return int("".join(str((v ^ t) >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_hilbert_curve_is_continuous():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        grid = np.array(np.meshgrid(*[range(side)] * n)).reshape(n, -1).T
        keys = m03_packing.hilbert_keys(grid, bits)
        assert keys.tolist() == [plain_hilbert(p, bits) for p in grid.tolist()]
        points = dict(zip(keys.tolist(), grid.tolist()))
        assert sorted(points) == list(range(side**n))
        for k in range(side**n - 1):
            assert sum(abs(a - b) for a, b in zip(points[k], points[k + 1])) == 1


def test_packing_follows_the_curve(spark):
    """Documents of a topic, dealt at random, end up next to each other; the pieces' order is that of the plain keys."""
    rng = np.random.default_rng(8)
    topics = [[f"{c}{i}" for i in range(30)] for c in ("alpha", "beta", "gamma", "delta", "mu", "nu")]
    rows = [(i, " ".join(rng.choice(topics[i % 6], 60))) for i in rng.permutation(240).tolist()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = m03_packing.pack(df, queries.WORD_BPE, 1, 512).collect()
    order = list(dict.fromkeys(r.doc_id for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset))))
    projector = m03_packing.Projector(WordIds.of(queries.WORD_BPE).size)
    texts = dict(rows)
    keys = {}
    for k, t in texts.items():
        y = projector.place(np.asarray(word_ids(t) + [1]))
        cell = np.clip((1 / (1 + np.exp(-1.702 * y)) * (1 << projector.bits)).astype(int), 0, (1 << projector.bits) - 1)
        keys[k] = plain_hilbert(cell.tolist(), projector.bits)
    assert order == sorted(texts, key=lambda k: (keys[k], k))
    alike = sum(a % 6 == b % 6 for a, b in zip(order, order[1:])) / (len(order) - 1)
    assert alike > 0.5  # 0.17 by chance
