"""Shared helpers: shared storage, shipping of the package to executors, Arrow batch plumbing, bounded memos."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors through Spark, once per application."""
    sc = spark.sparkContext
    # rows here are whole texts: smaller batches than the default bound what a task holds
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    if sc.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(), "weftgraph_src.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, names in os.walk(package):
                for n in sorted(names):
                    if n.endswith(".py"):
                        path = os.path.join(folder, n)
                        z.write(path, os.path.relpath(path, os.path.dirname(package)))
        sc.addPyFile(target)
        _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that driver and executors share (``spark.checkpoint.dir``).

    Only where that setting is absent on a local master (tests on one machine) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="weft-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


ROWS_PER_FILE = 25_000


def staged(df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into shared storage and read it back: cuts the lineage, survives lost executors.

    ``rows``, a measure of its size, sets the number of files: small tables in many files cost more than their rows.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete ``staged`` tables that nothing to come reads: what was made of them is stored by now."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], name: str) -> str:
    """``name``, or one like it, that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_ids(df: DataFrame, column: str) -> DataFrame:
    """Ids of any integer type as 64-bit ones; other types aren't taken."""
    kind = df.schema[column].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{column} must hold integers of at most 64 bits, not {kind}")
    return df if kind == "bigint" else df.withColumn(column, F.col(column).cast("long"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Memo(dict):
    """A dict that computes missing values.  At ``limit`` entries it sets them aside and starts anew; what is
    asked for again comes back from the set aside ones, so that frequent keys stay."""

    def __init__(self, make: Callable, limit: int = 60_000):
        super().__init__()
        self.make, self.limit, self.aside = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.aside = dict(self)
            self.clear()
        value = self.aside.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


#: What a Python worker keeps from task to task: tokenizers and their memos.
_kept: dict = {}
_used: set = set()


def kept(key, make: Callable):
    """``make()``, once per worker, for as long as its tasks ask for it."""
    if key not in _kept:
        _kept[key] = make()
    _used.add(key)
    return _kept[key]


def tidy() -> None:
    """Give freed memory back: workers outlive their tasks, and many share a machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


@contextlib.contextmanager
def task(make: Callable):
    """A task's function; what earlier tasks of other operators left in the worker goes first."""
    _used.clear()
    f = make()
    for key in _kept.keys() - _used:
        del _kept[key]
    tidy()
    yield f
    del f
    tidy()


def utf8_lists(batch: pa.RecordBatch, column: str) -> list:
    """The column's texts as UTF-8 bytes, null as None."""
    c = batch.column(batch.schema.get_field_index(column))
    return c.cast(pa.large_binary() if pa.types.is_large_string(c.type) else pa.binary()).to_pylist()


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """Apply ``make()`` to each row's ``columns`` (strings as UTF-8 bytes); it yields output tuples."""

    def rowwise():
        f = make()
        return lambda *columns: (out for row in zip(*columns) for out in f(*row))

    return map_columns(df, columns, schema, rowwise)


def map_columns(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., Iterable[tuple]]], rows_at_once: int = 512, as_lists: bool = True) -> DataFrame:
    """Apply ``make()`` to lists of the ``columns``' values (or Arrow arrays), some hundred rows at once; it yields
    output tuples.

    Only ``columns`` are read, so other columns, whatever their names, are pruned at the scan.  Output leaves in
    batches of some megabytes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    spark_schema = _parse_datatype_string(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        with task(make) as f:
            for batch in batches:
                for at in range(0, batch.num_rows, rows_at_once):
                    columns = batch.slice(at, rows_at_once).columns
                    for out in f(*map(values, columns)) if as_lists else f(*columns):
                        rows.append(out)
                        held += 64 + sum(getattr(x, "nbytes", 0) or (len(x) if isinstance(x, (bytes, str, list)) else 0) for x in out)
                        if held > 4 << 20:
                            yield to_batch(rows, arrow)
                            rows, held = [], 0
            if rows:
                yield to_batch(rows, arrow)

    return df.select(*columns).mapInArrow(run, spark_schema)


def map_arrays(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., Iterable[tuple]]], rows_at_once: int = 512) -> DataFrame:
    """As ``map_columns``, but from Arrow arrays to tuples of whole NumPy columns, without a Python object per row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    spark_schema = _parse_datatype_string(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task(make) as f:
            for batch in batches:
                for at in range(0, batch.num_rows, rows_at_once):
                    for out in f(*batch.slice(at, rows_at_once).columns):
                        if len(out[0]):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow.types)], schema=arrow)

    return df.select(*columns).mapInArrow(run, spark_schema)


def values(column: pa.Array) -> list:
    """Python values; strings as UTF-8 bytes, lists of numbers as NumPy arrays."""
    t = column.type
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        column = column.cast(pa.binary() if pa.types.is_string(t) else pa.large_binary())
    elif pa.types.is_list(t) and pa.types.is_primitive(t.value_type) and not column.null_count:
        flat, cuts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]
    return column.to_pylist()


def to_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)


class Bits:
    """A set of 63-bit numbers as a bitmap of their remainders: has every member, and a few others.

    Users treat "perhaps" like "yes" and settle it exactly later, so the size only sets how much work is spared.
    """

    def __init__(self, array: np.ndarray, size: int):
        self.array, self.size = array, size

    def perhaps(self, numbers: np.ndarray) -> np.ndarray:
        at = np.asarray(numbers, np.int64) & (self.size - 1)
        return (self.array[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bits_of(df: DataFrame, column: str, bits_per_row: int = 32, most: int = 1 << 28) -> Bits:
    """The bitmap of ``column`` (non-negative longs), built in Spark; between 2**20 and ``most`` bits reach the driver.

    ``df`` is read twice, for its size and for its bits: it should be a stored table or little more.
    """
    n = df.count()
    size = 1 << 20
    while size < min(most, n * bits_per_row):
        size <<= 1
    at = F.col(column).bitwiseAND(size - 1)
    parts = df.select(F.shiftright(at, 15).alias("part"), at.bitwiseAND(32767).alias("bit"))
    rows = parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toPandas()
    array = np.zeros(size // 8, np.uint8)
    for part, raw in zip(rows["part"], rows["bits"]):
        array[part * 4096 : part * 4096 + 4096] = np.frombuffer(raw, np.uint8)
    return Bits(array, size)


def rewrite_rows(df: DataFrame, column: str, make: Callable[[], Callable[..., list]], beside: str | None = None) -> DataFrame:
    """Keep, drop or change rows by one text column; all other columns pass through as Arrow data, as they are.

    ``make()`` maps a list of texts (UTF-8 bytes or None) to a list of the same length: False drops the row, True
    keeps it, a string replaces the text.  The values of a column ``beside`` go along as a second list; that column
    isn't returned.
    """
    ship(df.sparkSession)
    schema = df.drop(beside).schema if beside else df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task(make) as f:
            for batch in batches:
                at = batch.schema.get_field_index(column)
                for i in range(0, batch.num_rows, 512):
                    part = batch.slice(i, 512)
                    more = [values(part.column(batch.schema.get_field_index(beside)))] if beside else []
                    results = f(values(part.column(at)), *more)
                    changed = [r if isinstance(r, str) else None for r in results]
                    if any(c is not None for c in changed):
                        texts = pa.array(changed, part.column(at).type)
                        part = part.set_column(at, part.schema.field(at), pc.if_else(pc.is_valid(texts), texts, part.column(at)))
                    part = part.filter(pa.array([r is not False for r in results], pa.bool_()))
                    if part.num_rows:
                        yield part.drop_columns([beside]) if beside else part

    return df.mapInArrow(run, schema)


def spread_id(column: str):
    """A non-negative 63-bit number from an integer id, for ``Bits``."""
    return F.xxhash64(F.col(column).cast("long")).bitwiseAND(F.lit((1 << 63) - 1))


def perhaps_inside(numbers: np.ndarray, bits: Bits) -> np.ndarray:
    """Which rows may be in the set; number -1 stands for none."""
    return (numbers >= 0) & bits.perhaps(numbers)


class Members:
    """Two bitmaps of a set of ids: of its members, and of other ids of the table that the first takes for members.

    What isn't in the first is outside for sure; what is in the first alone is inside for sure.
    """

    def __init__(self, inside: Bits, mistaken: Bits):
        self.inside, self.mistaken = inside, mistaken

    def surely(self, numbers: np.ndarray) -> np.ndarray:
        return perhaps_inside(numbers, self.inside) & ~self.mistaken.perhaps(numbers)

    def unsettled(self, numbers: np.ndarray) -> np.ndarray:
        return perhaps_inside(numbers, self.inside) & self.mistaken.perhaps(numbers)


def members_of(ids: DataFrame, table: DataFrame, column: str = "doc_id"):
    """The broadcast ``Members`` of a stored table of ``ids`` among the ids of ``table``.  Only ids are shuffled."""
    spark = ids.sparkSession
    inside = bits_of(ids.select(spread_id(ids.columns[0]).alias("n")), "n")
    held = spark.sparkContext.broadcast(inside)
    narrow = table.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("id"), spread_id(column).alias("n"))
    near = where_number(narrow, "n", lambda n: held.value.perhaps(n))
    mistaken = staged(near.join(ids.toDF("member"), F.col("id") == F.col("member"), "left_anti").select("n").distinct(), "mistaken-ids")
    out = spark.sparkContext.broadcast(Members(inside, bits_of(mistaken, "n")))
    discard(mistaken)
    return out


def where_number(df: DataFrame, column: str, chosen: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows that ``chosen`` picks by the numbers in a column without nulls; all columns pass as they are."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            part = batch.filter(pa.array(chosen(batch.column(at).to_numpy(zero_copy_only=False))))
            if part.num_rows:
                yield part

    return df.mapInArrow(run, df.schema)


def numbered(df: DataFrame, column: str) -> tuple[DataFrame, str]:
    """``df`` with the ``spread_id`` of its ids (null: -1) in a new column, and that column's name."""
    name = fresh(df.columns, "_n")
    return df.withColumn(name, F.when(F.col(column).isNull(), F.lit(-1)).otherwise(spread_id(column))), name


def without_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows whose id isn't in the one column of ``ids``; other columns, whatever their names, stay as they are.

    Only rows that two bitmaps can't settle are shuffled.
    """
    ids = staged(ids.toDF("id").where("id IS NOT NULL").distinct(), "without-ids", rows=df.count())
    held = members_of(ids, df, column)
    rows, n = numbered(df, column)
    outside = where_number(rows, n, lambda x: ~perhaps_inside(x, held.value.inside)).drop(n)
    open_ = where_number(rows, n, lambda x: held.value.unsettled(x)).drop(n)
    return outside.unionByName(open_.join(ids, open_[column] == ids["id"], "left_anti"))
