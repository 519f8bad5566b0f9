"""Connected components by random local contraction, as DataFrame joins.

Each level maps every node to the neighbour (or itself) of least random priority, contracts the
edges along that map and repeats on the smaller graph.  A graph of at most ``FINISH`` edges is
finished by one task instead: each level costs the driver memory for its plans, classes and threads,
however few edges are left.  Every level is a durable table; no level collects nodes or edges to the driver.  Groups are only reduced by map-side combinable aggregates,
and joins deal the rows of hubs over many tasks.  The maps are composed from the smallest graph
upwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaweave.llm.hot import hot_keys, join_hot
from deltaweave.runtime import ship, stage

#: Edges that one task joins by itself; a constant, so its time and memory don't grow with the input.
FINISH = 100_000


def roots(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of all edges in order, and the smallest id that each can reach."""
    ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    up = list(range(len(ids)))
    for a, b in zip(ends[: len(src)].tolist(), ends[len(src) :].tolist()):
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a < b:
            up[b] = a
        else:
            up[a] = b
    for i, parent in enumerate(up):  # parents come before their children
        up[i] = up[parent]
    return ids, ids[np.array(up, np.int64)]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(np.asarray(b.column(0), np.int64), np.asarray(b.column(1), np.int64)) for b in batches]
    if held:
        ids, root = roots(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root)], ["id", "parent"])


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id that occurs in ``edges(src, dst)``.

    ``component`` is the smallest id reachable.  Self loops only make their node appear; repeated
    edges and either direction are allowed; rows with a null end are ignored; an empty input gives
    an empty result.
    """
    edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    current = stage(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    nodes = stage(current.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "nodes")
    maps: list[tuple[DataFrame, int]] = []  # and twice the number of edges, which bounds the rows
    level = 0
    while many := current.where("src <> dst").count():
        live = current.where("src <> dst")
        if many <= FINISH:
            ship(edges.sparkSession)
            last = live.select("src", "dst").coalesce(1).mapInArrow(_finish, "id long, parent long")
            maps.append((stage(last, "finished"), 2 * many))
            break
        level += 1
        both = live.select("src", "dst").unionAll(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        priority = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(level)).alias("p"), F.col(c).alias("v"))
        best = both.groupBy("src").agg(F.min(priority("dst")).alias("near"), F.count(F.lit(1)).alias("n"))
        own = priority("src")
        parent = stage(best.select(F.col("src").alias("id"), F.least(F.col("near"), own)["v"].alias("parent"), "n"), f"parent{level}")
        maps.append((parent.select("id", "parent"), 2 * many))
        hot = hot_keys(parent, "id", total=2 * many)
        left = parent.select(F.col("id").alias("src"), F.col("parent").alias("a"))
        right = parent.select(F.col("id").alias("dst"), F.col("parent").alias("b"))
        moved = join_hot(join_hot(live, left, ["src"], hot, "dst"), right, ["dst"], hot, "src").where("a <> b")
        current = stage(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), f"edges{level}")
    if not maps:
        return nodes.select("id", F.col("id").alias("component"))
    root = maps[-1][0].select("id", F.col("parent").alias("root"))
    if not level:  # finished at once, by smallest ids
        return nodes.join(root, "id", "left").select("id", F.coalesce("root", "id").alias("component"))
    for parent, rows in maps[-2::-1]:
        hot = hot_keys(parent.groupBy("parent").agg(F.count(F.lit(1)).alias("n")), "parent", total=rows)
        above = root.select(F.col("id").alias("parent"), "root")
        root = join_hot(parent, above, ["parent"], hot, "id", "left").select("id", F.coalesce("root", "parent").alias("root"))
    labels = stage(nodes.join(root, "id", "left").select("id", F.coalesce("root", "id").alias("root")), "roots")
    least = stage(labels.groupBy("root").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n")), "least")
    return join_hot(labels, least.select("root", "component"), ["root"], hot_keys(least, "root"), "id").select("id", "component")
