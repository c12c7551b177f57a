"""Near-duplicate groups by MinHash, with sequential Bayesian verification.

A document's set holds the hashes of its distinct word shingles.  Equal sets, confirmed by a 128-bit cryptographic
digest of the whole set, form classes, represented by their smallest id; only representatives go on.  Their signatures are cut into bands, and documents that agree in a band
meet in a bucket.  Candidate pairs are compared by batches of signature values: after each batch, a pair is dropped
once the posterior probability (uniform prior) that its similarity reaches the threshold falls below ``miss``;
survivors are confirmed on their full sets.

No bucket emits its pairs.  First, each document meets the smallest document of most of its buckets; these links
give components.  Buckets that hold several components tie these into clusters.  In each cluster, the documents
outside the largest component meet all others, in blocks bounded by documents and by bytes: a block finds the pairs that share a
bucket and lie in different components, tests them in place, and yields one link per document and component.
Pairs inside a component are never compared: they can't change the result.

Null and empty texts have an empty set, and are linked with nothing.  A text with fewer words than a shingle has its
whole word sequence as its one shingle.  Ids are integers.  Rows without an id are linked with nothing, keep a null
component, and are kept.  Repeated ids count as one document.  An empty table gives an empty result.  Columns beside
the key and the text aren't read.  A text is held by one task, which takes some 100 bytes per word.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import Memo, bits_of, discard, map_arrays, map_columns, map_rows, members_of, shared_dir, spread_id, staged, where_number, whole_ids

BANDS, ROWS, SEED, BLOCK, BATCH = 60, 8, 8_128, 1000, 40
BLOCK_BYTES = 8 << 20
SIGNED = 1000  # bytes that a document's keys and signature take, about
COMPARED = 240  # values of a signature that pairs are compared by
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers (the splitmix64 finish)."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self, words: int = 2):
        self.words = words
        self.memo = Memo(xxhash.xxh64_intdigest, 60_000)
        rng = np.random.default_rng(SEED)
        self.factors = rng.integers(1, 1 << 63, words, np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, raw: bytes | None) -> np.ndarray:
        """Sorted distinct 64-bit shingle hashes; A-Z count as a-z."""
        words = (raw or b"").lower().split()
        h = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(words))
        if not n:
            return h
        x = np.full(len(words) - n + 1, n, np.uint64)
        for j in range(n):
            x += mixed(h[j : len(words) - n + 1 + j]) * self.factors[j]
        return np.unique(mixed(x))


class Signer:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(SEED + 1)
        self.bands, self.rows = bands, rows
        self.factors = rng.integers(0, 1 << 31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
        self.fold = rng.integers(1, 1 << 63, rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys (non-negative 63-bit), and the low 16 bits of the signature's first ``COMPARED`` values."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 512):
            np.minimum(least, np.multiply.outer(self.factors, x[at : at + 512]).min(axis=1), out=least)
        keys = (mixed(least.reshape(self.bands, self.rows).astype(np.uint64)) * self.fold).sum(axis=1, dtype=np.uint64)
        keys = mixed(keys + np.arange(self.bands, dtype=np.uint64) * MIX[0])
        return (keys >> np.uint64(1)).astype(np.int64), least[:COMPARED].astype(np.uint16)


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The smallest number of agreeing values of ``n`` at which the posterior of reaching ``threshold`` exceeds
    ``miss``.  With a uniform prior the posterior is a beta distribution, whose tail is a binomial sum."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total > miss:
            return m
    return n


def signed(df: DataFrame, shingle: int, bands: int, rows: int, key: str, text: str) -> DataFrame:
    def make():
        shingles, sign = Shingler(shingle), Signer(bands, rows)

        def one(k, raw):
            s = shingles(raw)
            if len(s):
                yield k, len(s), hashlib.blake2b(s, digest_size=16).digest(), sign(s)[0]
            else:
                yield k, 0, None, None

        return one

    return map_rows(df, [key, text], "doc_id long, n_shingles long, digest binary, keys array<long>", make)


def bucket_rows(signed_rows: DataFrame, copied, shared=None) -> DataFrame:
    """(key, doc_id) of the bands' keys, without documents that are surely copies, and without keys that aren't in the
    bitmap ``shared``, if given."""

    def make():
        def some(ids, numbers, keys):
            others = pa.array(~copied.value.surely(numbers.to_numpy()))
            ids, keys = ids.filter(others), keys.filter(others)
            doc = np.repeat(ids.to_numpy(), pc.list_value_length(keys).to_numpy(zero_copy_only=False))
            key = keys.flatten().to_numpy()
            use = slice(None) if shared is None else shared.value.perhaps(key)
            yield key[use], doc[use]

        return some

    return map_arrays(signed_rows.withColumn("n", spread_id("doc_id")), ["doc_id", "n", "keys"], "key long, doc_id long", make)


def full_sets(df: DataFrame, chosen: DataFrame, shingle: int, bands: int, rows: int, key: str, text: str) -> DataFrame:
    """(doc_id, keys, signature, shingles, bytes that these take) of the ``chosen`` ids, and of a few that a bitmap can't tell from them."""
    bits = df.sparkSession.sparkContext.broadcast(bits_of(chosen.select(spread_id("doc_id").alias("n")), "n"))

    def make():
        shingles, sign = Shingler(shingle), Signer(bands, rows)
        perhaps = bits.value.perhaps

        def some(ids, numbers, raws):
            for k, raw, yes in zip(ids, raws, perhaps(np.asarray(numbers, np.int64)).tolist()):
                if yes and len(s := shingles(raw)):
                    keys, signature = sign(s)
                    yield k, keys.tobytes(), signature.tobytes(), s.tobytes(), SIGNED + s.nbytes

        return some

    texts = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL").withColumn("n", spread_id("doc_id"))
    return map_columns(texts, ["doc_id", "n", "text"], "doc_id long, keys binary, signature binary, shingles binary, bytes long", make)


class Test:
    """The sequential test of pairs, and the exact one of what it leaves."""

    def __init__(self, percent: int, miss: float, values: int):
        self.percent, self.values = percent, values
        self.limits = [least_matches(n, percent / 100, miss) for n in range(BATCH, values + 1, BATCH)]

    def plausible(self, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs ``x[a], y[b]`` of signatures stay; ``nx``, ``ny`` are the sets' sizes."""
        small, large = np.minimum(nx[a], ny[b]), np.maximum(nx[a], ny[b])
        live = np.flatnonzero(100 * small >= self.percent * large)
        matches = np.zeros(len(a), np.int64)
        for at, least in zip(range(0, self.values, BATCH), self.limits):
            matches[live] += (x[a[live], at : at + BATCH] == y[b[live], at : at + BATCH]).sum(axis=1)
            live = live[matches[live] >= least]
        return live

    def linked(self, one: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Whether each of ``others`` reaches the threshold with the set ``one``; and the intersection sizes."""
        sizes = np.fromiter(map(len, others), np.int64, len(others))
        flat = np.concatenate(others)
        at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
        both = np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
        return 100 * both >= self.percent * (len(one) + sizes - both), both


def plausible(pairs: DataFrame, percent: int, miss: float, values: int) -> DataFrame:
    """The pairs (a, b, sa, sb, na, nb) of ids, signatures and set sizes that the sequential test leaves, as (a, b)."""

    def make():
        test = Test(percent, miss, values)

        def some(a, b, sa, sb, na, nb):
            x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(a), -1) for s in (sa, sb))
            i = np.arange(len(a))
            return [(a[k], b[k]) for k in test.plausible(x, y, np.asarray(na), np.asarray(nb), i, i).tolist()]

        return some

    return map_columns(pairs, ["a", "b", "sa", "sb", "na", "nb"], "a long, b long", make)


def confirmed(pairs: DataFrame, percent: int, miss: float, values: int) -> DataFrame:
    """The pairs (a, b, xa, xb) of ids and whole sets that reach the threshold, as (a, b)."""

    def make():
        test = Test(percent, miss, values)

        def one(a, b, xa, xb):
            if test.linked(np.frombuffer(xa, np.uint64), [np.frombuffer(xb, np.uint64)])[0][0]:
                yield a, b

        return one

    return map_rows(pairs, ["a", "b", "xa", "xb"], "a long, b long", make)


def block_links(table: pa.Table, percent: int, miss: float) -> pa.Table:
    """Links between a block's outer documents and its members of other components: the closest per document and
    component."""
    outer = table.column("outer").to_numpy()
    component, doc = table.column("component").to_numpy(), table.column("doc_id").to_numpy()
    keys, signatures, raw = (table.column(c).to_pylist() for c in ("keys", "signature", "shingles"))
    keys = np.frombuffer(b"".join(keys), np.int64).reshape(len(doc), -1)
    signatures = np.frombuffer(b"".join(signatures), np.uint16).reshape(len(doc), -1)
    sets = [np.frombuffer(x, np.uint64) for x in raw]
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    test = Test(percent, miss, signatures.shape[1])
    out, members = np.flatnonzero(outer), np.flatnonzero(~outer)
    order = [members[np.argsort(keys[members, k], kind="stable")] for k in range(keys.shape[1])]
    columns = [keys[o, k] for k, o in enumerate(order)]
    a, b = [], []
    for o in out.tolist():  # one outer document at a time: at most a block's members are held
        met = [order[k][np.searchsorted(c, keys[o, k], "left") : np.searchsorted(c, keys[o, k], "right")] for k, c in enumerate(columns)]
        met = np.unique(np.concatenate(met)) if met else members[:0]
        met = met[component[met] != component[o]]
        met = met[test.plausible(signatures, signatures, n, n, np.full(len(met), o), met)]
        if len(met):
            yes, both = test.linked(sets[o], [sets[m] for m in met.tolist()])
            met, both = met[yes], both[yes]
            closest = np.lexsort((met, -both / (n[o] + n[met] - both), component[met]))
            met = met[closest]
            first = np.append(True, component[met][1:] != component[met][:-1]) if len(met) else np.zeros(0, bool)
            for m in met[first].tolist():
                a.append(doc[o])
                b.append(doc[m])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(
    df: DataFrame, percent: int = 80, shingle: int = 2, bands: int = BANDS, rows: int = ROWS, miss: float = 1e-7, block: int = BLOCK, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    spark = df.sparkSession

    def components(edges: DataFrame, a: str, b: str) -> DataFrame:
        return staged(connected_components(edges, a, b, shared_dir(spark, "minhash-stars")), "minhash-components", rows=size)

    df = whole_ids(df, key)
    docs = staged(signed(df, shingle, bands, rows, key, text), "minhash", "none")
    size = docs.count()
    sizes_of = staged(docs.select("doc_id", "n_shingles"), "minhash-sizes")
    full = docs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # what is grouped by a key is written before it is joined by it: a join of two plain reads can be split at hot keys
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")).where("rep < most").select("digest", "rep")
    classes = staged(classes, "minhash-digests", rows=size)
    copies = full.select("doc_id", "digest").join(classes, "digest").where("doc_id <> rep").select("doc_id", "rep")
    copies = staged(copies.groupBy("doc_id").agg(F.min("rep").alias("rep")), "minhash-classes", rows=size)
    copied = members_of(copies.select("doc_id"), full)
    buckets = bucket_rows(full, copied).groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    buckets = staged(buckets.where("least < most").select("key", "least"), "minhash-keys", rows=size)
    # the keys of several documents, as a bitmap: most keys are of one alone, and needn't be shuffled again
    shared = spark.sparkContext.broadcast(bits_of(buckets, "key"))
    inside = staged(bucket_rows(full, copied, shared).join(buckets.hint("merge"), "key").select("key", "doc_id", "least").distinct(), "minhash-buckets", rows=size)
    sets = staged(full_sets(df, inside.select("doc_id").distinct(), shingle, bands, rows, key, text), "minhash-sets", "none")
    discard(classes, buckets, docs)  # the largest table, of all documents' band keys, has served

    # each document with the smallest of most of its buckets
    centres = inside.where("doc_id <> least").groupBy("doc_id", "least").agg(F.count("*").alias("n"))
    stars = centres.groupBy(F.col("doc_id").alias("b")).agg(F.max_by("least", F.struct("n", -F.col("least"))).alias("a"))
    for end in ("a", "b"):  # the same plan at every size: signatures and sets are shuffled, never broadcast
        side = sets.select(F.col("doc_id").alias(end), F.col("signature").alias("s" + end), ((F.col("bytes") - SIGNED) / 8).cast("long").alias("n" + end))
        stars = stars.join(side.hint("merge"), end)
    values = min(COMPARED, bands * rows)
    stars = staged(plausible(stars, percent, miss, values), "minhash-plausible", rows=size)
    # whole sets travel for what the test left alone
    ends = stars.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    left = spark.sparkContext.broadcast(bits_of(ends.select(spread_id("doc_id").alias("n")), "n"))
    chosen = where_number(sets.select("doc_id", "shingles", spread_id("doc_id").alias("n")), "n", lambda n: left.value.perhaps(n))
    pairs = stars
    for end in ("a", "b"):
        pairs = pairs.join(chosen.select(F.col("doc_id").alias(end), F.col("shingles").alias("x" + end)).hint("merge"), end)
    links = staged(confirmed(pairs, percent, miss, values), "minhash-links", rows=size)
    first = components(links, "a", "b")

    # clusters: components that share a bucket
    named = inside.join(first, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed_keys = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key", "low")
    mixed_keys = staged(mixed_keys, "minhash-mixed", rows=size)
    open_ = staged(named.join(mixed_keys, "key").select("doc_id", "component", "low").distinct(), "minhash-open", rows=size)
    discard(inside)
    clusters = components(open_.where("component <> low").select("component", "low").distinct(), "component", "low")
    clusters = clusters.select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    held = open_.select("doc_id", "component").distinct().join(clusters, "component")
    held = held.join(sets.groupBy("doc_id").agg(F.max("bytes").alias("bytes")), "doc_id")
    held = staged(held, "minhash-weighed", rows=size)
    parts = held.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    main = F.struct("n", "component")
    sizes = parts.groupBy("cluster").agg(
        F.max_by("component", main).alias("main"),
        F.sum("n").alias("all"),
        F.max("n").alias("most"),
        F.sum("bytes").alias("all_bytes"),
        F.max_by("bytes", main).alias("most_bytes"),
    )
    parts_of = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / BLOCK_BYTES))
    sizes = sizes.select(
        "cluster",
        "main",
        parts_of(F.col("all"), F.col("all_bytes")).alias("columns"),
        parts_of(F.col("all") - F.col("most"), F.col("all_bytes") - F.col("most_bytes")).alias("rows"),
    )
    placed = held.join(sizes, "cluster").select(
        "doc_id", "component", "cluster", "rows", "columns", (F.col("component") != F.col("main")).alias("outlier"), F.xxhash64("doc_id").alias("h")
    )
    number = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    grid = ["doc_id", "component", "cluster"]
    as_member = placed.select(*grid, F.explode(number("rows")).alias("i"), F.pmod("h", "columns").alias("j"), F.lit(False).alias("outer"))
    as_outer = placed.where("outlier").select(*grid, F.pmod("h", "rows").alias("i"), F.explode(number("columns")).alias("j"), F.lit(True).alias("outer"))
    blocks = as_member.unionByName(as_outer).join(sets, "doc_id")
    later = blocks.groupBy("cluster", "i", "j").applyInArrow(lambda t: block_links(t, percent, miss), "a long, b long")
    links = links.unionByName(staged(later, "minhash-links", rows=size))
    last = components(links, "a", "b")

    discard(sets)
    of_copies = copies.join(last, copies["rep"] == last["node"], "left").select(F.col("doc_id").alias("_doc"), F.coalesce("component", "rep").alias("_component"))
    of_others = last.select(F.col("node").alias("_doc"), F.col("component").alias("_component")).join(copies.select(F.col("doc_id").alias("_doc")), "_doc", "left_anti")
    names = staged(of_copies.unionByName(of_others), "minhash-names", rows=size)
    out = sizes_of.join(names, F.col("doc_id") == F.col("_doc"), "left")
    component = F.coalesce("_component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
