import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import m05_chunks as m
from weftgraph.llm.common import bits_of

R = random.Random(5)
PASSAGE = "".join(R.choice("abcdefgh ij") for _ in range(9000))
TEXTS = [None, "", "é", "short", PASSAGE, PASSAGE, "prefix " + PASSAGE, PASSAGE[:3000] + "cut" + PASSAGE[3000:], "z" * 60_000, "x" * 576, "short"]


def test_gear_hash_is_the_rolling_one():
    data = PASSAGE.encode()[:6000]
    h, marks = 0, []
    for i, b in enumerate(data):
        h = (2 * h + int(m.GEAR[b])) & 0xFFFFFFFF
        if h < 1 << 32 - m.USUAL_BITS:
            marks.append(i + 1)
    out, begin = [], 0
    while begin < len(data):
        at = min(next((x for x in marks if x >= begin + m.LEAST), len(data)), begin + m.MOST, len(data))
        out.append(data[begin:at])
        begin = at
    assert m.cut(data) == out and b"".join(out) == data


def test_cuts_follow_content():
    a, b = set(m.cut(PASSAGE.encode())), set(m.cut(b"something before it " + PASSAGE.encode()))
    assert len(a & b) >= len(a) - 2


@pytest.mark.parametrize("parts", [1, 5])
def test_round_trip(spark, tmp_path, parts):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "short"), (4, PASSAGE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("payload", F.lit("clash")).repartition(parts)
    path = str(tmp_path / "store")
    m.write_store(docs, path)
    got = m.read_store(spark, path).collect()
    assert sorted((str(r.key), bytes(r.payload)) for r in got) == sorted((str(k), m.payload_of(t and t.encode())) for k, t in rows)
    chunks = spark.read.parquet(f"{path}/chunks").collect()
    assert len(chunks) == len({bytes(r.digest) for r in chunks}) > 0
    held = sum(len(r.body) for r in chunks) + sum(len(r.media) for r in spark.read.parquet(f"{path}/objects").collect())
    assert held < 0.6 * sum(len(r.payload) for r in got)
    out = m.store_documents(docs).collect()
    stored = {}  # what the table of containers holds for each text
    for r in spark.read.parquet(f"{path}/objects").collect():
        media = bytes(r.media)
        stored.setdefault(TEXTS[r.key] if r.key is not None else "short", set()).add((len(media), hashlib.sha256(media).hexdigest()))
    by_text = {}
    for r in out:
        t = TEXTS[r.doc_id] if r.doc_id is not None else "short"
        p = m.payload_of(t and t.encode())
        assert r.n_bytes == len((t or "").encode()) and r.payload_bytes == len(p) and r.payload_sha256 == hashlib.sha256(p).hexdigest()
        assert r.tail_crc32 == zlib.crc32(p[-32:]) and p[: r.n_bytes] == (t or "").encode() and len(p) % 576 == 0
        assert (r.media_bytes, r.media_sha256) in stored[t]
        by_text.setdefault(t, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values()) and len(out) == len(rows)
    assert m.store_documents(docs.limit(0)).count() == 0


def test_bits(spark):
    numbers = [0, 1, 7, 8, 32767, 32768, 99_999_999_999, (1 << 62) + 5]
    bits = bits_of(spark.createDataFrame([(n,) for n in numbers], "x long"), "x")
    assert bits.perhaps(np.asarray(numbers)).all()
    assert not bits.perhaps(np.asarray([2, 9, 40_000])).any()


def test_broken_containers_are_refused():
    chunks = m.cut(PASSAGE.encode())
    names = [hashlib.sha256(c).digest() for c in chunks]
    media = m.container(chunks, names, [i % 2 == 0 for i in range(len(chunks))])
    bodies = dict(zip(names, chunks))
    assert m.opened(media, bodies) == chunks
    for broken in (media[:-1], media[:50] + b"?" + media[51:], b"CDC2" + media[4:]):
        with pytest.raises((ValueError, KeyError)):
            m.opened(broken, bodies)
    with pytest.raises(ValueError):
        m.opened(media, {d: c + b"x" for d, c in bodies.items()})
