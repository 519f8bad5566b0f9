"""Embedding near-dedup by sorted projection passes, completed exactly.

Equal vectors of a label are one class.

1. Passes.  In each pass every class gets a key of concatenated random hyperplane bits; the rows are
   range partitioned and sorted by (label, key), ties in an order of the pass's own, and each vector
   is compared with the ``NEIGHBOURS`` that follow it.  Verified pairs of all passes are united to
   clusters: a task passes on only those that join two groups it had not joined before, so a dense
   cluster sends fewer rows than it has vectors.
2. Completion.  Bounded windows can miss pairs of a crowded label, so the rest is compared exactly.
   A label with many classes gets pivots, about one in ``REGION`` of its vectors by hash, and each
   vector lives in the region of its nearest pivot.  For unit vectors x near pivot c and y near
   pivot p, the distance of x and y is at least x.(c - p) / |c - p|; so x is copied to the regions of
   smaller number that this bound can't exclude, and every pair that may link meets in exactly one
   region.  Regions are compared whole, in blocks of bounded size dealt over tasks: every link is
   counted, and pairs that join two clusters of the passes are passed on.

Disk stays in proportion to the vectors.  A few passes run at a time.  Copies for regions and blocks may
be many times the vectors, so they are never stored together: pairs of blocks are dealt to rounds, each
of which ships about as many rows as there are vectors, and its shuffle is deleted before the next.

Pivots save work where vectors form groups; for a label without any the comparisons of the second
step grow with the square of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm.components import components
from deltaweave.llm.groups import runs
from deltaweave.llm.wordhash import mix
from deltaweave.runtime import ship, stage, table

PASSES, BITS, NEIGHBOURS = 10, 40, 24
THRESHOLD, REGION, MOST_PIVOTS = 0.98, 1024, 1024
#: Passes that run together at least; least and most vectors of a block, and the square that a task compares at once.
TOGETHER, BLOCK_LEAST, BLOCK_MOST, TILE = 2, 1024, 8192, 2048
#: Rows that one round ships for each vector, and at least.
ROUND, ROUND_LEAST = 1.0, 250_000


def _unit(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(flat.flatten(), np.float64).reshape(-1, dim)
    values = values / np.abs(values).max(axis=1, keepdims=True)  # squares of very small or large components stay exact
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _passes(passes: range, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(2))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                unit = _unit(part.column(3), dim)
                for number in passes:
                    planes = np.random.default_rng([dim, number]).standard_normal((dim, bits))
                    key = ((unit @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64)[::-1])).astype(np.int64)
                    columns = [pa.array(np.full(len(key), number), pa.int32()), part.column(1), part.column(2), pa.array(key), part.column(0), part.column(3)]
                    yield pa.RecordBatch.from_arrays(columns, ["pass", "label", "dim", "sort", "rep", "vector"])

    return run


def _neighbours(neighbours: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            own = pa.Table.from_batches([batch])
            both = own if kept is None else pa.concat_tables([kept, own])
            kept = both.slice(max(0, both.num_rows - neighbours))
            fresh = both.num_rows - batch.num_rows
            group = np.stack([np.asarray(both.column(i).combine_chunks(), np.int64) for i in range(3)])
            rep = np.asarray(both.column(4).combine_chunks(), np.int64)
            src, dst = [], []
            for dim in np.unique(group[2]).tolist():
                rows = np.flatnonzero(group[2] == dim)
                unit = _unit(both.column(5).take(pa.array(rows)), dim)
                for step in range(1, min(neighbours, len(rows) - 1) + 1):
                    a, b = rows[:-step], rows[step:]
                    close = (group[:, a] == group[:, b]).all(axis=0) & (b >= fresh)
                    i = np.flatnonzero(close)
                    i = i[np.einsum("ij,ij->i", unit[i], unit[i + step]) >= threshold]
                    for x, y in zip(rep[a[i]].tolist(), rep[b[i]].tolist()):
                        p, q = find(x), find(y)
                        if p != q:
                            root[q] = p
                            src.append(x)
                            dst.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])
            if len(root) > 500_000:
                root.clear()  # pairs may repeat from here on

    return run


def _turn(label: int, dim: int, region: np.ndarray, rounds: int) -> np.ndarray:
    """The round of a region's first pairs of blocks."""
    key = np.array([label], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array([dim], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mix(mix(key) + region.astype(np.uint64)) % np.uint64(rounds)).astype(np.int32)


def _regions(pivots: dict[tuple[int, int], np.ndarray], threshold: float, now: int | None = None, rounds: int = 1, blocks: int = 1):
    """Each vector at its own region and as a copy wherever a link may be; ``pivots`` by label and length.

    Without ``now`` only ``label, dim, region, n``: how many vectors there are.  With it only regions
    that have work in that round, if none has more than ``blocks`` blocks.
    """
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    gaps = {k: np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (p @ p.T))) for k, p in pivots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dims = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            order = np.lexsort((dims, label))
            cuts = np.flatnonzero((np.diff(label[order]) != 0) | (np.diff(dims[order]) != 0)) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                group = (int(label[rows[0]]), int(dims[rows[0]]))
                if group in pivots:
                    part = _unit(batch.column(5).take(pa.array(rows)), group[1])
                    dots = part @ pivots[group].T
                    home = dots.argmax(axis=1)
                    near = dots[np.arange(len(rows)), home][:, None] - dots <= reach * gaps[group][home] + 1e-9
                    near &= np.arange(dots.shape[1]) <= home[:, None]
                    near[np.arange(len(rows)), home] = True
                    at, region = np.nonzero(near)
                else:
                    at, region, home = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                if now is None:
                    names, many = np.unique(region, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), group[0]), pa.int64()), pa.array(np.full(len(names), group[1]), pa.int32()), pa.array(names.astype(np.int32)), pa.array(many, pa.int64())], ["label", "dim", "region", "n"])
                    continue
                turn = _turn(*group, region, rounds)
                keep = (now - turn) % rounds < blocks
                at, region, turn = at[keep], region[keep], turn[keep]
                for low in range(0, len(at), 10_000):
                    a, r = at[low : low + 10_000], region[low : low + 10_000]
                    whole = batch.take(pa.array(rows[a]))
                    yield pa.RecordBatch.from_arrays([*whole.columns[:2], pa.array(r.astype(np.int32)), pa.array(turn[low : low + 10_000]), pa.array(r == home[a]), *whole.columns[2:]], ["label", "dim", "region", "turn", "home", "rep", "size", "cluster", "vector"])

    return run


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row of each row's group when the pairs (a, b) are united."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _compare(threshold: float):
    """Rows (src, links, null) with links met and (src, 0, dst) that join two clusters of the passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table_, edges in runs(batches, 5, 4_000):
            dims, i, j, block, rep, size, cluster = (np.asarray(table_.column(c).combine_chunks(), np.int64) for c in (1, 3, 4, 5, 7, 8, 9))
            home = np.asarray(table_.column(6).combine_chunks().cast(pa.int8()), bool)
            for at, to in zip(edges[:-1].tolist(), edges[1:].tolist()):
                unit = _unit(table_.column(10).slice(at, to - at), int(dims[at]))
                rows = np.arange(at, to)
                left, right = np.flatnonzero(block[rows] == i[at]), np.flatnonzero(block[rows] != i[at])
                if j[at] == i[at]:
                    right = left
                links = np.zeros(to - at, np.int64)
                names, group = np.unique(cluster[rows], return_inverse=True)
                least = np.arange(len(names))
                for p in range(0, len(left), TILE):
                    for q in range(p if j[at] == i[at] else 0, len(right), TILE):
                        one, two = left[p : p + TILE], right[q : q + TILE]
                        near = unit[one] @ unit[two].T >= threshold
                        near &= home[rows[one]][:, None] | home[rows[two]]
                        same = j[at] == i[at] and p == q
                        if same:
                            np.fill_diagonal(near, False)
                        links[one] += near @ size[rows[two]]
                        if not same:
                            links[two] += near.T @ size[rows[one]]
                        a, b = np.nonzero(near & (least[group[one]][:, None] != least[group[two]]))
                        if len(a):
                            least = _joined(len(names), np.concatenate([np.arange(len(names)), group[one[a]]]), np.concatenate([least, group[two[b]]]))
                met, moved = np.flatnonzero(links), np.flatnonzero(least != np.arange(len(names)))
                src = np.concatenate([rep[rows[met]], names[moved]])
                dst = pa.array(np.concatenate([rep[rows[met]], names[least[moved]]]), pa.int64(), mask=np.arange(len(src)) < len(met))
                counts = np.concatenate([links[met], np.zeros(len(moved), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(counts), dst], ["src", "links", "dst"])

    return run


def _usable(vector: Column, label: Column, key: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return key.isNotNull() & label.isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & whole & F.exists(vector, lambda x: x != 0)


def _kind(rows: DataFrame) -> str:
    return rows.schema["vector"].dataType.simpleString()


def window_links(classes: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, neighbours: int = NEIGHBOURS, first: int = 0) -> DataFrame:
    """``src, dst``: verified pairs of ``classes(rep, label, dim, vector)`` found by the passes from ``first``, as many as join their clusters."""
    order = ["pass", "label", "dim", "sort", "tie"]
    coded = classes.select("rep", "label", "dim", "vector").mapInArrow(_passes(range(first, passes), BITS), f"pass int, label long, dim int, sort long, rep long, vector {_kind(classes)}")
    coded = coded.withColumn("tie", F.xxhash64("pass", "rep")).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    return coded.mapInArrow(_neighbours(neighbours, threshold), "src long, dst long")


def _compared(told: DataFrame, pivots: dict[tuple[int, int], np.ndarray], threshold: float, block: int | None, most: int | None) -> DataFrame:
    """What ``_compare`` finds in all regions of ``told(label, dim, rep, size, cluster, vector)``, round by round."""
    group = ["label", "dim", "region"]
    sizes = told.mapInArrow(_regions(pivots, threshold), "label long, dim int, region int, n long")
    sizes = stage(sizes.groupBy(*group).agg(F.sum("n").alias("n")), "sizes")
    total = told.count()
    block = block or min(BLOCK_MOST, max(BLOCK_LEAST, total // 64))
    sizes = sizes.withColumn("blocks", (F.floor((F.col("n") - 1) / block) + 1).cast("int"))
    shipped, widest = sizes.agg(F.sum(F.col("n") * F.col("blocks")), F.max("blocks")).first()
    rounds = -(-(shipped or 0) // (most or max(ROUND_LEAST, int(ROUND * total)))) or 1
    fields = f"label long, dim int, region int, turn int, home boolean, rep long, size long, cluster long, vector {_kind(told)}"
    dealt = [*group, "i", "j"]
    both = lambda other: (F.least("block", other), F.greatest("block", other))
    compared = None
    for now in range(rounds):
        placed = told.mapInArrow(_regions(pivots, threshold, now, rounds, widest or 1), fields)
        members = placed.join(sizes.drop("n"), group).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        partners = F.sequence(F.lit(0), F.col("blocks") - 1)
        if rounds > 1:
            partners = F.filter(partners, lambda o: F.pmod(F.col("turn") + F.abs(F.col("block") - o), F.lit(rounds)) == now)
        spread = members.select(*group, "block", "home", "rep", "size", "cluster", "vector", F.explode(partners).alias("other"))
        spread = spread.select(*group, *[c.alias(n) for c, n in zip(both("other"), "ij")], "block", "home", "rep", "size", "cluster", "vector")
        spread = spread.repartition(*dealt).sortWithinPartitions(*dealt)
        some = stage(spread.mapInArrow(_compare(threshold), "src long, links long, dst long"), "compared")
        compared = some if compared is None else compared.unionAll(some)
    return compared


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, region: int = REGION, block: int | None = None, passes: int = PASSES, neighbours: int = NEIGHBOURS, most: int | None = None) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row; ``kept`` marks the smallest key of a component.

    Vectors are compared when their labels and lengths are equal.  A vector that is null, empty, zero
    or holds a null or non-finite component, or whose key or label is null, links with nothing and is
    its own component.  Repeated rows are separate vectors that link with each other.  Extra columns
    of any name are ignored; an empty table gives an empty result.  All pairs of at least
    ``threshold`` link and no others; the other parameters only deal the work (``most``: rows that
    one round ships).  Floats are kept as floats, which loses nothing, and compared as doubles.
    """
    ship(vectors.sparkSession)
    kind = "array<float>" if dict(vectors.select(F.col(vector).alias("v")).dtypes)["v"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast(kind).alias("vector"))
    rows = rows.withColumn("ok", F.coalesce(_usable(F.col("vector"), F.col("label"), F.col("id")), F.lit(False)))
    rows = rows.withColumns({"one": F.xxhash64("vector"), "two": F.xxhash64(F.lit(7), "vector")})
    same = ["label", "one", "two"]
    classes = rows.where("ok").groupBy(*same).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("vector").alias("vector"))
    classes = stage(classes.withColumn("dim", F.size("vector")), "classes")
    rows = stage(rows.drop("vector"), "rows")
    many = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * region)
    wanted = F.least(F.ceil(F.col("n") / region), F.lit(MOST_PIVOTS))
    chosen = classes.join(F.broadcast(many), ["label", "dim"]).where(F.pmod(F.xxhash64(F.lit(11), "rep"), F.col("n")) < wanted)
    listed: dict[tuple[int, int], list] = {}
    for r in chosen.select("label", "dim", "rep", "vector").orderBy("rep").collect():
        listed.setdefault((r["label"], r["dim"]), []).append(r["vector"])
    pivots = {k: _unit(pa.array(v, pa.list_(pa.float64())), k[1]) for k, v in listed.items()}
    links = None
    together = max(TOGETHER, 2 * ROUND_LEAST // max(classes.count(), 1))
    for first in range(0, passes, together):
        some = stage(window_links(classes, threshold, min(first + together, passes), neighbours, first), "window_links")
        links = some if links is None else links.unionAll(some)
    links = classes.select(F.col("rep").alias("src"), F.col("rep").alias("dst")).limit(0) if links is None else links
    clusters = stage(components(links).select(F.col("id").alias("rep"), F.col("component").alias("cluster")), "passes")
    told = classes.join(clusters, "rep", "left").select("label", "dim", "rep", "size", F.coalesce("cluster", "rep").alias("cluster"), "vector")
    told = stage(told, "told")
    compared = _compared(told, pivots, threshold, block, most)
    found = stage(components(links.unionAll(compared.where("dst IS NOT NULL").select("src", "dst"))).withColumnRenamed("id", "rep"), "clusters")
    degrees = compared.groupBy(F.col("src").alias("rep")).agg(F.sum("links").alias("links"))
    answer = classes.select(*same, "rep", "size").join(found, "rep", "left").join(degrees, "rep", "left")
    answer = stage(answer.select(*same, "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component")), "answer")
    linked = rows.where("ok").join(answer, same).select("id", (F.col("size") - 1 + F.col("links")).cast("long").alias("n_links"), "component")
    alone = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    both = linked.unionAll(alone)
    return both.select(F.col("id").alias(key), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
