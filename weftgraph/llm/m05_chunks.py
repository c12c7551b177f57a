"""Media payloads as content-defined chunks.

A rolling gear hash cuts each payload where the hash's leading bits are zero, so that equal passages are cut alike
wherever they stand.  Chunks are known by their SHA-256.  A payload is stored as a container: the ordered list of its
chunks, each with length and digest, and the bytes of those that no other payload has.  A chunk that several payloads
share is kept once, in a table of its own, found by counting digests in Spark; containers only name it.  Reading joins
containers with that table, rebuilds each payload and verifies every digest.

The store has two Parquet tables, ``objects`` (one row per payload: its container, and the digests that it only names)
and ``chunks`` (one row per shared digest).  Payloads without a shared chunk are read without a shuffle.

A null or empty text gives the padding alone.  Repeated rows are stored as often as they occur, sharing all
chunks; null keys are kept; an empty table gives empty tables.  Columns beside the key and the text aren't read.  A
payload is held by one task, which takes about 30 times its bytes for the gear hash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bits_of, discard, map_rows, shared_dir, staged

UNIT, FILL = 576, b"\xff"
LEAST, USUAL_BITS, MOST = 256, 10, 4096


def gear_table(seed: int = 2_016) -> np.ndarray:
    """256 fixed random numbers, from the splitmix64 sequence."""
    out, x, mask = [], seed, (1 << 64) - 1
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) & mask
        z = x
        z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & mask
        out.append((z ^ z >> 31) >> 32)
    return np.asarray(out, np.uint32)


GEAR = gear_table()


def payload_of(raw: bytes | None) -> bytes:
    raw = raw or b""
    return raw + FILL * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def cut(payload: bytes) -> list[bytes]:
    """Chunks of ``LEAST`` to ``MOST`` bytes (the last may be shorter).

    The 32-bit gear hash ``h = 2 h + gear[byte]`` forgets a byte after 32 steps, so all its values are had from five
    doublings of a sum over windows.
    """
    h = GEAR[np.frombuffer(payload, np.uint8)]
    width = 1
    while width < 32:
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h, width = more, 2 * width
    marks = (np.flatnonzero(h < np.uint32(1 << 32 - USUAL_BITS)) + 1).tolist()
    out, begin, end, i = [], 0, len(payload), 0
    while begin < end:
        while i < len(marks) and marks[i] < begin + LEAST:
            i += 1
        at = min(marks[i] if i < len(marks) else end, begin + MOST, end)
        out.append(payload[begin:at])
        begin = at
    return out


def slot(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little") >> 1


def digests(df: DataFrame, text: str) -> DataFrame:
    """(slot, digest) of every chunk; a digest that a row repeats comes twice at most."""

    def make():
        def one(raw):
            seen: dict[bytes, int] = {}
            for c in cut(payload_of(raw)):
                d = hashlib.sha256(c).digest()
                if seen.setdefault(d, 0) < 2:
                    seen[d] += 1
                    yield slot(d), d

        return one

    return map_rows(df, [text], "slot long, digest binary", make)


OBJECTS = "row long, key {}, n_bytes long, media binary, refs array<binary>"
MAGIC, ELSEWHERE = b"CDC1", 1 << 31


def container(chunks: list[bytes], names: list[bytes], shared: list[bool]) -> bytes:
    """The stored form of a payload: per chunk its length (with the top bit for a chunk kept elsewhere), its digest, and
    its bytes unless kept elsewhere."""
    out = [MAGIC]
    for c, d, s in zip(chunks, names, shared):
        out += [struct.pack("<I", len(c) | ELSEWHERE * s), d] if s else [struct.pack("<I", len(c)), d, c]
    return b"".join(out)


def opened(media: bytes, bodies: dict[bytes, bytes]) -> list[bytes]:
    """The verified chunks of a container; ``bodies`` has those kept elsewhere."""
    if media[:4] != MAGIC:
        raise ValueError("not a container")
    out, at = [], 4
    while at < len(media):
        (size,) = struct.unpack_from("<I", media, at)
        d, at = media[at + 4 : at + 36], at + 36
        if size & ELSEWHERE:
            c = bodies[d]
            size ^= ELSEWHERE
        else:
            c = media[at : at + size]
            at += size
        if len(c) != size or hashlib.sha256(c).digest() != d:
            raise ValueError("a chunk doesn't match its digest")
        out.append(c)
    return out


def write_store(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    spark = df.sparkSession
    repeated = digests(df, text).groupBy("slot", "digest").agg(F.count("*").alias("n")).where("n > 1").select("slot")
    repeated = staged(repeated, "chunk-slots", rows=df.count())
    bits = spark.sparkContext.broadcast(bits_of(repeated, "slot"))  # perhaps shared: sure for all that are
    discard(repeated)

    def make():
        task, count = TaskContext.get().partitionId() << 40, 0
        perhaps = bits.value.perhaps

        def one(k, raw):
            nonlocal count
            chunks = cut(payload_of(raw))
            names = [hashlib.sha256(c).digest() for c in chunks]
            shared = perhaps(np.fromiter(map(slot, names), np.int64, len(names))).tolist()
            yield task + count, k, len(raw or b""), container(chunks, names, shared), list(dict.fromkeys(d for d, s in zip(names, shared) if s))
            count += 1

        return one

    def make_shared():
        perhaps = bits.value.perhaps
        sent: set[bytes] = set()

        def one(raw):
            chunks = cut(payload_of(raw))
            names = [hashlib.sha256(c).digest() for c in chunks]
            for c, d, s in zip(chunks, names, perhaps(np.fromiter(map(slot, names), np.int64, len(names))).tolist()):
                if s and d not in sent:  # copies within a task leave it once
                    if len(sent) > 100_000:
                        sent.clear()
                    sent.add(d)
                    yield d, c

        return one

    kind = df.schema[key].dataType.simpleString()
    map_rows(df, [key, text], OBJECTS.format(kind), make).write.option("compression", "zstd").parquet(f"{path}/objects")
    bodies = map_rows(df, [text], "digest binary, body binary", make_shared)
    bodies.groupBy("digest").agg(F.first("body").alias("body")).write.option("compression", "zstd").parquet(f"{path}/chunks")


def read_with(spark: SparkSession, path: str, schema: str, finish: Callable[..., tuple]) -> DataFrame:
    """``finish(key, n_bytes, chunks, media)`` of every payload, as rows of ``schema``; every chunk is verified."""
    objects = spark.read.parquet(f"{path}/objects")
    chunks = spark.read.parquet(f"{path}/chunks")

    def rebuild():
        def one(k, n, media, bodies):
            yield finish(k, n, opened(media, {bytes(x["digest"]): bytes(x["body"]) for x in bodies or []}), media)

        return one

    refs = objects.where(F.size("refs") > 0).select("row", F.explode("refs").alias("digest"))
    bodies = refs.join(chunks, "digest").groupBy("row").agg(F.collect_list(F.struct("digest", "body")).alias("bodies"))  # a payload's own
    columns = ["key", "n_bytes", "media", "bodies"]
    none = F.lit(None).cast("array<struct<digest:binary,body:binary>>").alias("bodies")
    mixed = objects.where(F.size("refs") > 0).join(bodies, "row").select(*columns)
    single = objects.where(F.size("refs") == 0).select(*columns[:-1], none)
    return map_rows(single, columns, schema, rebuild).unionByName(map_rows(mixed, columns, schema, rebuild))


def key_type(spark: SparkSession, path: str) -> str:
    return spark.read.parquet(f"{path}/objects").schema["key"].dataType.simpleString()


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(key, n_bytes, lengths, payload, media)."""
    schema = f"key {key_type(spark, path)}, n_bytes long, lengths array<int>, payload binary, media binary"
    return read_with(spark, path, schema, lambda k, n, chunks, media: (k, n, [*map(len, chunks)], b"".join(chunks), media))


def features(k, n: int, chunks: list[bytes], media: bytes) -> tuple:
    """Digests of what was read back, and a feature string: chunks, their mean size, and the bytes' mean and spread."""
    payload = b"".join(chunks)
    values = np.frombuffer(payload, np.uint8).astype(np.int64)
    mean = int(values.sum()) // values.size
    spread = int((values * values).sum()) // values.size - mean**2
    feature = f"chunks={len(chunks)};chunk_bytes={len(payload) // len(chunks)};mean={mean};spread={spread}"
    return k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def store_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the store into shared storage, read it back, and report on the bytes read."""
    spark = df.sparkSession
    path = shared_dir(spark, "chunks")
    write_store(df, path, key, text)
    schema = f"key {key_type(spark, path)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return read_with(spark, path, schema, features).withColumnRenamed("key", key)
