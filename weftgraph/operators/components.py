"""Connected components by alternating large and small stars, without collecting neighbourhoods."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, shared_path


LINKS_PER_FILE = 200_000
#: Links that a task holds at once when it joins what it can by itself.
BLOCK_LINKS = 250_000
#: Nodes on which blocks disagree, or their links, that are sent to all tasks rather than joined by a shuffle of all nodes.
FEW_NODES = 100_000


def _kept(df: DataFrame, store: str | None, links: int | None = None) -> DataFrame:
    """Cut the lineage: a written table below ``store``, else a reliable checkpoint; in files by the number of links."""
    if links is not None:
        df = df.coalesce(max(1, -(-links // LINKS_PER_FILE)))
    if store is None:
        return cut(df)
    path = f"{store.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", store: str | None = None, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an undirected graph; a component is named by its smallest node.

    Self links make a node of its own; null ends and repeated links are ignored.  Each round hangs every node's
    larger neighbours, then its smaller ones, below the smallest node it sees; the rounds grow with the logarithm of
    the longest path.  A node's neighbourhood is never gathered: minima are partial aggregates, joined back, and
    hot nodes are left to the join's skew handling.
    """
    links = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = _kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), store)
    size = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(most_rounds):
        if not size[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written before they are joined: a join of two plain reads can be split where a node is hot
        least = _kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), store, size[0])
        large = _kept(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), store, size[0])
        # here every u exceeds its v
        low = _kept(large.groupBy("u").agg(F.min("v").alias("m")), store, size[0])
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = _kept(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), store, size[0])
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == size:
            break
        size = after
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def contracted(links: DataFrame, block: int = BLOCK_LINKS) -> DataFrame:
    """(u, v) from links (a, b): each node beside the smallest node that it reaches within a block of consecutive links of
    one partition; that node beside itself.  The same nodes hang together as before."""
    import pyarrow as pa

    def run(batches):
        above: dict = {}

        def top(x):
            while (y := above[x]) != x:
                above[x] = y = above[y]
                x = y
            return x

        def rows():
            nodes = list(above)
            for i in range(0, len(nodes), 10_000):
                part = nodes[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([top(x) for x in part], kind)], ["u", "v"])

        held = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                above.setdefault(a, a)
                above.setdefault(b, b)
                a, b = top(a), top(b)
                if a < b:
                    above[b] = a
                elif b < a:
                    above[a] = b
                held += 1
                if held == block:
                    yield from rows()
                    above, held = {}, 0
        if above:
            yield from rows()

    kind = links.schema["a"].dataType.simpleString()
    return links.select("a", "b").mapInArrow(run, f"u {kind}, v {kind}")


def components_by_blocks(edges: DataFrame, src: str = "src", dst: str = "dst", block: int = BLOCK_LINKS) -> DataFrame:
    """As ``connected_components``, for links of which most of a component lie near each other.

    Each task first joins what it can by itself.  Where all blocks agree on a node's smallest, it is settled; elsewhere
    the blocks' smallest nodes are linked, and only these links, in one block or else in rounds, are followed further.
    """
    spark = edges.sparkSession
    links = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    store = shared_path(spark, "components")
    stars = _kept(contracted(links, block), store)
    low = _kept(stars.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("_last")), store)
    torn = low.where("v <> _last").select("u", F.col("v").alias("_m"))
    if not (n_torn := torn.count()):
        return low.select(F.col("u").alias("node"), F.col("v").alias("component"))
    joints = _kept(stars.join(F.broadcast(torn) if n_torn <= FEW_NODES else torn, "u").where("v <> _m").select(F.col("v").alias("a"), F.col("_m").alias("b")).distinct(), store)
    n_joints = joints.count()
    if n_joints <= block:
        tops = contracted(joints.coalesce(1), block).select(F.col("u").alias("_node"), F.col("v").alias("_top"))
    else:
        tops = connected_components(joints, "a", "b", store).select(F.col("node").alias("_node"), F.col("component").alias("_top"))
    if n_joints <= FEW_NODES:
        tops = F.broadcast(tops)
    settled = low.join(tops, low["v"] == tops["_node"], "left").select(F.col("u").alias("node"), F.coalesce("_top", "v").alias("component"))
    return _kept(settled, store)
