"""Token ids as ORC files: integer run-length encoded ids, row indexes, and Bloom filters on the document ids.

Documents are range-partitioned and sorted by id, so file ``k`` holds lower ids than file ``k + 1``; each file's
stripes can be read in parallel and are skipped by the row index's minimum, maximum and Bloom filter when ids
are looked up.  Every row also holds its file's number and its place there, two columns that run-length encoding makes
next to free.  What is reported is read back from the files: counts, checksums, and each document's start among all
ids, by sums over blocks of places, over files, over groups of files, and within a block.  All of these are bounded,
whatever the ids' values are.

Ids are integers.  Null texts count as empty and hold the end id alone.  Null document ids sort first.  Repeated ids
are kept as rows of their own, in the order of their contents' hash and of where they were read; a range of equal
ids is split by these too.  An empty table writes no row and reads back as an empty one.  Columns beside the key and the text aren't read.
A text is tokenized by one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, shared_dir, ship, staged, task, whole_ids
from .word_tokens import WordIds

FILE_SCHEMA = "doc_id long, n_tokens long, ids array<int>, file int, place long"
FILES_PER_GROUP = 4096


def tokenized(df: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``FILE_SCHEMA``; ids go from the tokenizer to Arrow as whole columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    schema = _parse_datatype_string(FILE_SCHEMA)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task(lambda: WordIds.of(tokenizer_path)) as words:
            file, place = TaskContext.get().partitionId(), 0
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    keys, texts = batch.slice(at, 512).columns
                    ids, ends = words.joined(texts)
                    n = np.diff(ends, prepend=0) + 1
                    ids = np.insert(ids, ends, end_id).view(np.int32)
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), type=arrow.field("ids").type)
                    columns = [keys.cast(pa.int64()), pa.array(n), lists, pa.array(np.full(len(n), file, np.int32)), pa.array(np.arange(place, place + len(n)))]
                    place += len(n)
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(key, text).mapInArrow(run, schema)


def write_orc(df: DataFrame, path: str, tokenizer_path: str, end_id: int, bytes_per_file: int = 32 << 20, stripe_bytes: int = 16 << 20, key: str = "doc_id", text: str = "text") -> None:
    """Sort texts by id, tokenize in that order, write.  The texts are shuffled, once; ids are not."""
    df = whole_ids(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "doc_id")
    total = df.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    files = max(1, -(-(total["b"] or 0) // bytes_per_file))
    order = ["doc_id", "content", "read_at"]
    ordered = df.withColumns({"content": F.xxhash64("text"), "read_at": F.spark_partition_id()}).repartitionByRange(files, *order).sortWithinPartitions(*order)
    (
        tokenized(ordered, tokenizer_path, end_id)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "10000")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Documents by id: the predicate reaches the ORC reader, which prunes stripes and row groups."""
    return read_orc(spark, path).where(F.col("doc_id").isin(doc_ids)).drop("file", "place")


def file_bases(sizes: DataFrame, group: int = FILES_PER_GROUP) -> DataFrame:
    """(file, base): the sum of all files before, from (file, size).

    Files are summed up within groups of ``group`` files; the groups, one in ``files / group``, in one row's array.
    """
    files = sizes.withColumn("g", F.floor(F.col("file") / group))
    inside = Window.partitionBy("g").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    groups = sizes.groupBy(F.floor(F.col("file") / group).alias("g")).agg(F.sum("size").alias("size"))
    listed = groups.agg(F.array_sort(F.collect_list(F.struct("g", "size"))).alias("all"))
    sums = F.aggregate("all", F.array(F.lit(0).cast("long")), lambda s, x: F.array_append(s, F.element_at(s, -1) + x["size"]))
    bases = listed.select(F.explode(F.arrays_zip(F.col("all.g").alias("g"), F.slice(sums, 1, F.size("all")).alias("base"))).alias("x"))
    return files.join(bases.select(F.col("x.g").alias("g"), F.col("x.base").alias("group_base")), "g").select("file", (F.col("before") + F.col("group_base")).alias("base"))


def starts(df: DataFrame, sizes: DataFrame, rows_per_block: int) -> DataFrame:
    """Add ``start``, the sum of ``n_tokens`` over all rows before, in order of file and place.

    ``sizes``: the same rows' file, place and n_tokens, where they can be read more cheaply.
    """
    block = F.floor(F.col("place") / rows_per_block).alias("block")
    blocks = staged(sizes.groupBy("file", block).agg(F.sum("n_tokens").alias("size")), "orc-blocks")  # a row per block, used three times
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    bases = file_bases(blocks.groupBy("file").agg(F.sum("size").alias("size")))
    blocks = blocks.join(bases, "file").select("file", "block", (F.col("before") + F.col("base")).alias("base"))
    within = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("block", block).join(blocks, ["file", "block"]).withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))


def digests(df: DataFrame) -> DataFrame:
    """Counts and checksums of the ids as the files hold them."""

    def make():
        def one(k, n, ids, file, place):
            raw = np.ascontiguousarray(ids, "<i4")
            yield k, int(raw.size), zlib.crc32(raw.tobytes()), file, place

        return one

    return map_rows(df, ["doc_id", "n_tokens", "ids", "file", "place"], "doc_id long, n_tokens long, ids_crc32 long, file int, place long", make)


def store_documents(df: DataFrame, tokenizer_path: str, end_id: int, rows_per_block: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write, read back, and report doc_id, start, n_tokens, ids_crc32."""
    spark = df.sparkSession
    path = shared_dir(spark, "orc-ids")
    write_orc(df, path, tokenizer_path, end_id, key=key, text=text)
    narrow = read_orc(spark, path).select("file", "place", "n_tokens")  # the column of ids isn't read for these
    out = starts(digests(read_orc(spark, path)), narrow, rows_per_block)
    return out.select(F.col("doc_id").alias(key), F.col("start").cast("long").alias("start"), "n_tokens", "ids_crc32")
