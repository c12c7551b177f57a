"""Document corpora and vectors for the vector matchers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .match import resolve_redirects
from .storage import cut


def abstracts_corpus(reference: DataFrame, redirects: DataFrame, own: DataFrame) -> DataFrame:
    """(tag, text): a reference graph's abstracts under their redirects' targets, and the sources' own."""
    moved = resolve_redirects(reference.select("s", "o"), redirects, "s")
    return moved.select(F.col("s").alias("tag"), F.col("o").alias("text")).unionByName(own.select(F.col("s").alias("tag"), F.col("o").alias("text")))


def tokenized(corpus: DataFrame) -> DataFrame:
    return corpus.select("tag", S.tokens(F.lower("text")).alias("tokens"))


#: Words whose buckets a task remembers.
KNOWN_WORDS = 500_000


def _bucket_counts(corpus: DataFrame, size: int) -> DataFrame:
    """(uri, buckets, counts): the words of each text by bucket; texts of one uri are added up within a batch.

    Words are cut at the white space that ``tokenized`` cuts at; a blank text has one word, the empty one.
    """
    import pyarrow as pa

    def run(batches):
        import hashlib
        from collections import Counter

        known: dict = {}
        for batch in batches:
            found: dict = {}
            for uri, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = found.setdefault(uri, {})
                for word, n in Counter(text.split() or [b""]).items():
                    i = known.get(word)
                    if i is None:
                        if len(known) >= KNOWN_WORDS:
                            known.clear()
                        i = known[word] = int(hashlib.md5(word).hexdigest()[:7], 16) % size
                    own[i] = own.get(i, 0) + n
            columns = [list(found), [list(x) for x in found.values()], [list(x.values()) for x in found.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.list_(pa.int32()), pa.list_(pa.int64())))], ["uri", "buckets", "counts"])

    lowered = corpus.where("text IS NOT NULL").select(F.col("tag").alias("uri"), F.lower("text").cast("binary").alias("text"))
    return lowered.mapInArrow(run, f"uri {lowered.schema['uri'].dataType.simpleString()}, buckets array<int>, counts array<long>")


def _weights_by_uri(corpus: DataFrame, size: int) -> DataFrame:
    """(uri, weights) with an array of (bucket, weight), ``size`` entries at most, or null without any weight; texts are
    read once."""
    pieces = _bucket_counts(corpus, size).repartition("uri")  # one row of a uri and batch: all that is shuffled
    added = pieces.select("uri", F.inline(F.arrays_zip("buckets", "counts")).alias("bucket", "n")).groupBy("uri", "bucket").agg(F.sum("n").alias("tf"))
    rows = cut(added.groupBy("uri").agg(F.collect_list(F.struct("bucket", "tf")).alias("entries")))
    df = rows.select(F.explode("entries.bucket").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("df"))  # ``size`` rows
    n = corpus.agg(F.count("*").alias("n"))  # one row
    idf = df.join(n).agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("x")))).alias("m"))
    idf = idf.select(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at("m", i)).alias("idf"))  # one row
    w = lambda e: e["tf"] * F.get("idf", e["bucket"])
    # one expression: projections that share an array's aggregate would be merged, and computed once an entry
    unit = lambda s: F.when(s > 0, F.transform("entries", lambda e: F.struct(e["bucket"].alias("bucket"), (w(e) / F.sqrt(s)).alias("weight"))))
    return rows.where("uri IS NOT NULL").join(F.broadcast(idf)).select("uri", F.aggregate("entries", F.lit(0.0), lambda s, e: s + w(e) * w(e), unit).alias("weights"))


def term_weights(corpus: DataFrame, size: int) -> DataFrame:
    """(uri, bucket, weight): term frequencies, terms hashed to ``size`` buckets by the first 28 bits of their MD5, times
    log((documents + 1) / (documents with the bucket + 1)), scaled to unit length per document."""
    return _weights_by_uri(corpus, size).select("uri", F.inline("weights"))


def tfidf_vectors(corpus: DataFrame, size: int = 256) -> DataFrame:
    """(uri, vector) of ``term_weights``; all zero for a document without any."""
    own = _weights_by_uri(corpus, size).select("uri", F.map_from_entries("weights").alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float"))
    return corpus.select(F.col("tag").alias("uri")).join(own, "uri", "left").select("uri", dense.alias("vector"))


def document_vectors(corpus: DataFrame, size: int = 64, window: int = 5, least: int = 5, iterations: int = 1, seed: int = 7) -> DataFrame:
    """(uri, vector): means of trained word vectors.  Any encoder that yields this schema serves the matchers."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    t = tokenized(corpus)
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxIter=iterations, seed=seed, inputCol="tokens", outputCol="mean").fit(t)
    return model.transform(t).select(F.col("tag").alias("uri"), vector_to_array("mean", "float32").alias("vector"))
