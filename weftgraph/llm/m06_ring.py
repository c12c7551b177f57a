"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations alone.

Every shard owns ``vnodes`` points of a ring of 65,536 cells; a key hashes to a cell and belongs to the first
point clockwise.  A shard takes at most its capacity; keys beyond it go on clockwise to the next shard with room.
All keys of one arc meet the same shards in the same order, so it suffices to settle how many keys of each arc
stay and how many move on: a fold over arcs and rounds, on one small row, whose size depends on the ring's
parameters only.  Rows then find their shard by their rank in their arc.  Capacities differ by at most one and add
up to the number of rows, so counts do as well; a key moves only where a full shard pushes it on.

Texts are read once; what is needed of a row, its key, size and checksum, is written and shuffled by ring cell.  Keys
spread evenly there however skewed sources or texts are.  A cell of more than ``cell_rows`` rows, as one of null or
repeated keys can be, is ranked in parts, which also follow the partition that a row was read in.  A null text has no
bytes (size 1, checksum of the empty string); null keys and repeated keys are ordinary keys that share a cell, where
ties fall to checksum and size.  Keys can be of any type that casts to a string.  An empty table gives an empty
result.  Columns beside the key and the text aren't read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

CELLS = 1 << 16
PARTS = 256  # of a cell with many rows


def ring(shards: int, vnodes: int) -> list[tuple[int, list[int]]]:
    """The points: last cell of the arc that ends there, and the shards met clockwise from it, each once."""
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            cell = int(hashlib.md5(f"shard {s} point {v}".encode()).hexdigest()[:4], 16)
            at.setdefault(cell, s)
    points = sorted(at.items())
    out = []
    for i, (cell, _) in enumerate(points):
        met = list(dict.fromkeys(s for _, s in points[i:] + points[:i]))
        out.append((cell, met + [s for s in range(shards) if s not in met]))
    return out


def cell_of(key: Column) -> Column:
    """The first 16 bits of the key's MD5, as the ring's cell."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 4), 16, 10).cast("int")


def settle(cells: DataFrame, points: list[tuple[int, list[int]]], shards: int) -> DataFrame:
    """(arc, round, shard, first rank in the arc, keys, first slot in the shard), from (cell, n).

    At most ``arcs * shards`` rows.  The fold visits (round, arc) in order; its state is the room left per shard
    and, for each step, the keys that go on to the next round.
    """
    arcs = len(points)
    ends = F.array(*[F.lit(c) for c, _ in points])
    # cells behind the last point belong to the first arc, whose keys come before it round the ring
    arc_of = F.size(F.filter(ends, lambda e: e < F.col("cell")))
    by_arc = cells.select((arc_of % arcs).alias("arc"), "n").groupBy("arc").agg(F.sum("n").alias("n"))
    one = by_arc.agg(
        F.map_from_entries(F.collect_list(F.struct("arc", "n"))).alias("have"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")
    )
    targets = ",".join(str(points[a][1][j]) for j in range(shards) for a in range(arcs))
    one = one.selectExpr(
        f"transform(sequence(0, {arcs - 1}), a -> coalesce(have[a], 0L)) AS have",
        f"transform(sequence(0, {shards - 1}), s -> total div {shards} + IF(s < total % {shards}, 1L, 0L)) AS room",
        f"array({targets}) AS target",
    )
    folded = one.selectExpr(
        "have", "target",
        f"""aggregate(sequence(0, {arcs * shards - 1}), named_struct('room', room, 'left', cast(array() AS array<bigint>)),
        (s, k) -> transform(array(IF(k < {arcs}, have[k % {arcs}], s.left[greatest(k - {arcs}, 0)])),
          w -> transform(array(least(w, s.room[target[k]])), take -> named_struct(
            'room', transform(s.room, (r, i) -> IF(i = target[k], r - take, r)),
            'left', concat(s.left, array(w - take))))[0])[0]).left AS left""",
    )
    steps = folded.selectExpr(
        f"""explode(transform(sequence(0, {arcs * shards - 1}), k -> named_struct('arc', k % {arcs}, 'round', k div {arcs}, 'shard', target[k],
        'before', IF(k < {arcs}, have[k % {arcs}], left[greatest(k - {arcs}, 0)]), 'after', left[k], 'all', have[k % {arcs}]))) AS x"""
    ).select("x.*")
    taken = steps.where("before > after").select(
        "arc", "round", "shard", (F.col("all") - F.col("before")).alias("rank0"), (F.col("before") - F.col("after")).alias("keys")
    )
    earlier = Window.partitionBy("shard").orderBy("arc", "round").rowsBetween(Window.unboundedPreceding, -1)
    return taken.withColumn("slot0", F.coalesce(F.sum("keys").over(earlier), F.lit(0)))


def shard(df: DataFrame, shards: int = 8, vnodes: int = 64, key: str = "doc_id", text: str = "text", cell_rows: int = 1_000_000) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row; rows per shard differ by at most one."""
    points = ring(shards, vnodes)
    arcs = len(points)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        cell_of(F.col(key)).alias("cell"),
        F.spark_partition_id().alias("read_in"),
    )
    rows = staged(rows, "ring-rows")
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"))
    ends = F.array(*[F.lit(c) for c, _ in points])
    # place of each cell in its arc: keys in ring order, and the cells behind the last point first of all
    arc = (F.size(F.filter(ends, lambda e: e < F.col("cell"))) % arcs).alias("arc")
    turned = F.when(F.col("cell") > points[-1][0], F.col("cell") - CELLS).otherwise(F.col("cell"))
    within = Window.partitionBy("arc").orderBy("turned").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        cells.select("cell", "n", arc, turned.alias("turned"))
        .withColumn("cell_rank0", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .select(F.col("cell").alias("at_cell"), "arc", "cell_rank0", F.col("n").alias("in_cell"))
    )  # CELLS rows at most
    quotas = settle(cells, points, shards).groupBy("arc").agg(
        F.collect_list(F.struct("rank0", "keys", "shard", "slot0")).alias("quotas")
    )  # a row per arc, with an entry per shard at most
    part = F.when(F.col("in_cell") > cell_rows, F.pmod(F.xxhash64(key, "text_crc32", "size", "read_in"), F.lit(PARTS))).otherwise(0)
    located = rows.join(F.broadcast(placed), F.col("cell") == F.col("at_cell")).withColumn("part", part)
    sizes = located.where(F.col("in_cell") > cell_rows).groupBy(F.col("cell").alias("_cell"), F.col("part").alias("_part")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("_cell").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_cell", "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_rank0"))
    ranked = located.withColumn("nth", F.row_number().over(Window.partitionBy("cell", "part").orderBy(key, "text_crc32", "size")) - 1)
    ranked = ranked.join(sizes, (F.col("cell") == F.col("_cell")) & (F.col("part") == F.col("_part")), "left")
    joined = ranked.join(F.broadcast(quotas), "arc").withColumn("rank", F.col("cell_rank0") + F.coalesce("part_rank0", F.lit(0)) + F.col("nth"))
    mine = F.filter("quotas", lambda q: (q["rank0"] <= F.col("rank")) & (F.col("rank") < q["rank0"] + q["keys"]))[0]
    return joined.withColumn("q", mine).select(
        key, "size", "text_crc32", F.col("q.shard").cast("int").alias("shard"), (F.col("q.slot0") + F.col("rank") - F.col("q.rank0")).cast("long").alias("slot")
    )
