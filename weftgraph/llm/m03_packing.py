"""Packing along a space-filling curve.

Each document's token counts are hashed into a vector, projected to a few dimensions by a fixed random matrix,
and mapped to its place on a Hilbert curve.  The curve is cut into ranges of about equally many tokens, by the tokens
in each of its 65,536 coarse cells; a cell of more tokens than a range, as thousands of copies make it, is dealt over
several by the documents' ids.  Each range is sorted by place and packed into sequences of a fixed length: neighbours
on the curve, which are alike, share sequences.  Documents are cut where a sequence ends, so only the last sequence of
a range has padding: half a sequence in ``tokens_per_partition`` on average, where there are that many tokens.

Ids are integers.  A null text is an empty document: its end id alone.  Repeated rows are packed as often as they
occur.  An empty table gives no piece.  Null ids sort first.  Columns beside the key and the text aren't read.  A text
is tokenized by one task and travels as one row of two bytes per token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, ship, staged, to_batch, whole_ids
from .word_tokens import WordIds

DIMENSIONS, BITS, BUCKETS, SEED = 4, 8, 4096, 20_210_917
COARSE = 16  # of the key's bits
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions of integer points (one per row, coordinates below ``2**bits``) on the Hilbert curve, after Skilling
    (2004); all points go through each step together."""
    x = [c.astype(np.int64) for c in np.asarray(points).T]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the coarsest cell down
        low = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(high, low, swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] = x[i] ^ x[i - 1]
    flip, q = np.zeros(len(x[0]), np.int64), 1 << (bits - 1)
    while q > 1:
        flip = flip ^ np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    key = np.zeros(len(x[0]), np.int64)
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | (v ^ flip) >> b & 1
    return key


class Projector:
    """Token ids -> hashed count vector -> a few dimensions -> curve position."""

    def __init__(self, vocabulary: int, dimensions: int = DIMENSIONS, bits: int = BITS, buckets: int = BUCKETS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bits, self.buckets = bits, buckets
        self.bucket = rng.integers(0, buckets, vocabulary)
        self.matrix = rng.standard_normal((buckets, dimensions))

    def place(self, ids: np.ndarray) -> np.ndarray:
        """A document's point before it is cut into cells."""
        counts = np.bincount(self.bucket[ids], minlength=self.buckets)
        return counts @ self.matrix / (float(np.sqrt((counts * counts).sum())) or 1.0)

    def keys(self, places: list[np.ndarray]) -> np.ndarray:
        cells = (1 / (1 + np.exp(-1.702 * np.asarray(places))) * (1 << self.bits)).astype(np.int64)  # near the normal distribution's quantile
        return hilbert_keys(np.clip(cells, 0, (1 << self.bits) - 1), self.bits)


def curve_documents(df: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, curve position, token count and ids (16 bits each where the vocabulary allows)."""

    def make():
        words = WordIds.of(tokenizer_path)
        projector = Projector(words.size)
        kind = "<u2" if words.size <= 1 << 16 else "<u4"
        end = np.uint32(end_id)

        def some(keys, texts):
            documents, places = [], []
            for ids in words.ids_many(texts):
                ids = np.append(ids, end)
                places.append(projector.place(ids))
                documents.append((ids.size, ids.astype(kind).tobytes()))
            if documents:
                yield from ((p, k, n, raw) for p, k, (n, raw) in zip(projector.keys(places).tolist(), keys.to_pylist(), documents))

        return some

    return map_columns(df, [key, text], "place long, doc_id long, n_tokens long, ids binary", make, as_lists=False)


def coarse(place):
    """One of 65,536 stretches of the curve."""
    return F.shiftright(place, DIMENSIONS * BITS - COARSE).cast("int")


def curve_ranges(placed: DataFrame, tokens: int) -> tuple[DataFrame, int]:
    """(cell, first, parts) for each coarse cell with documents: the first range that takes it, and over how many it is
    dealt; and the number of ranges.  At most 65,536 rows of sums reach the driver."""
    sums = placed.groupBy(coarse(F.col("place")).alias("cell")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()
    rows, at, held = [], 0, 0
    for r in sorted(sums, key=lambda r: r.cell):
        parts = min(-(-r.n // tokens), r.docs)
        if held and held + r.n > tokens:
            at, held = at + 1, 0
        rows.append((r.cell, at, parts))
        at, held = (at + parts, 0) if parts > 1 else (at, held + r.n)
    return placed.sparkSession.createDataFrame(rows, "cell int, first int, parts int"), max(1, at + (held > 0))


def pack(df: DataFrame, tokenizer_path: str, end_id: int, length: int = 2048, tokens_per_partition: int = 4_000_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    ship(df.sparkSession)
    df = whole_ids(df, key)
    placed = staged(curve_documents(df, tokenizer_path, end_id, key, text), "curve")  # else sorting would tokenize twice
    ranges, partitions = curve_ranges(placed, tokens_per_partition)
    among = F.pmod(F.xxhash64("doc_id", "n_tokens"), "parts").cast("int")
    located = placed.join(F.broadcast(ranges), coarse(F.col("place")) == F.col("cell")).withColumn("range", F.col("first") + among)
    ordered = located.repartitionById(partitions, "range").sortWithinPartitions("place", "doc_id", "ids")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(PIECES)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, filled = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            rows, held = [], 0
            for doc, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids"))):
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                at = 0
                while at < n:
                    take = min(length - filled, n - at)
                    rows.append((doc, at, take, ids[at : at + take].tobytes(), n, sequence, filled))
                    at, filled, held = at + take, filled + take, held + take
                    if filled == length:
                        sequence, filled = sequence + 1, 0
                if held > 2_000_000:
                    yield to_batch(rows, arrow)
                    rows, held = [], 0
            if rows:
                yield to_batch(rows, arrow)

    return ordered.select("doc_id", "n_tokens", "ids").mapInArrow(run, schema)
