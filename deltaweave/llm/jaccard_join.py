"""Exact n-gram Jaccard join: pivot regions, boundary replication and recursive in-region joins.

Documents are sets of word shingles under the Jaccard distance.  Almost all documents are at
distance 1 from any given document, so document pivots alone would put every document into every
region's boundary; the first level therefore uses shingles as pivots.

1. Documents with equal sets become one class, known by a fingerprint of the set.
2. Regions.  All shingles have one order: frequent ones (a bounded list, counted over all documents)
   last, the others by hash.  A class lies in the region of its first shingle and is replicated to
   those of the next ones as far as a partner within the wanted distance may begin: |x| - ceil(t |x|)
   + 1 in all.  Two sets with similarity t or more share such a region (prefix bound), so nothing is
   lost.
3. Pivots.  Each region's pivot is one of its classes; every other class is verified against it.
   Verified pairs make components; a region whose classes are in one component is done.
4. Remaining regions (larger ones in pairs of bounded blocks dealt over tasks) are joined recursively: members are embedded as counts of shingles per hash
   bucket, whose L1 distance never exceeds the symmetric difference; two far members are pivots of
   Voronoi cells, the triangle inequality replicates the members near the boundary to both cells.
   Each region passes on a spanning forest of the pairs that the embedding can't exclude.
5. The forests join classes to clusters, within which all further links lie.  A cluster's whole sets
   are written as differences from the set of its pivot (|x| and x - pivot, pivot - x together give
   every |x - y| exactly) and compared, in pairs of bounded blocks dealt over tasks, between different components
   only; each task passes on a spanning forest of the links, so no group sends all its pairs.

Whole sets are made only for classes of pairs that the embedding leaves: found through a Bloom filter
of bounded size, whose false hits only cost time, or by a join if there are too many for it.  Joins
deal the rows of hot classes, pivots and clusters over many tasks.  Nothing is sampled or capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm import bloom
from deltaweave.llm.components import components
from deltaweave.llm.groups import runs
from deltaweave.llm.hot import hot_keys, join_hot
from deltaweave.llm.tokens import slices
from deltaweave.llm.wordhash import hashes, inside, mix, rolling, words_of
from deltaweave.runtime import ship, shuffle_width, stage, table

WIDTH, PERCENT = 3, 90
#: Least and most buckets of the embedding, leaf size of in-region recursion, classes in a block of a cluster.
SIGNATURE, SIGNATURE_MOST, LEAF, BLOCK = 64, 8192, 48, 256
#: Frequent shingles that are told from the others (at most, by documents seen), per task slice and in all.
HOT_SLICE, HOT, HOT_LEAST = 2000, 50_000, 40
#: Characters of text for each bucket of regions; the most shuffle partitions, each of which takes many buckets one by one.
BUCKET_CHARS, MOST_PARTITIONS = 32_000_000, 1 << 14
#: Members of a region that one task joins; larger regions are dealt in pairs of blocks.
REGION = 2000


class Sets:
    """Distinct shingles of each text, sorted by hash."""

    def __init__(self, texts: pa.Array, width: int):
        words, counts = words_of(texts, lower=True)
        own = hashes(words)
        at = inside(counts, width)
        starts = np.cumsum(counts) - counts
        value = rolling(own, width)[at] if len(at) else np.zeros(0, np.uint64)
        of = np.searchsorted(np.cumsum(counts), at, "right")
        short = np.flatnonzero((counts > 0) & (counts < width))
        whole = [int.from_bytes(hashlib.blake2b(own[starts[i] : starts[i] + counts[i]].tobytes(), digest_size=8).digest(), "little") for i in short.tolist()]
        value, of = np.concatenate([value, np.array(whole, np.uint64)]), np.concatenate([of, short])
        order = np.lexsort((value, of))
        value, of = value[order], of[order]
        new = np.ones(len(of), bool)
        new[1:] = (np.diff(of) != 0) | (np.diff(value) != 0)
        self.value, self.of, self.many = value[new], of[new], len(counts)
        self.size = np.bincount(self.of, minlength=self.many).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size

    def classes(self) -> np.ndarray:
        """A number for each set: equal sets have equal numbers."""
        out = np.zeros(self.many, np.int64)
        full = np.flatnonzero(self.size > 0)
        if len(full):
            at = self.start[full]
            one = np.add.reduceat(mix(self.value ^ np.uint64(0x5851F42D4C957F2D)), at)
            two = np.bitwise_xor.reduceat(mix(self.value + np.uint64(0x14057B7EF767814F)), at)
            out[full] = mix(mix(one) + two + self.size[full].astype(np.uint64)).view(np.int64)
        return out

    def signatures(self, percent: int) -> list[bytes]:
        """Counts of shingles per hash bucket; larger sets have more buckets, so that they stay apart."""
        wide = tiers(self.size, percent)
        end = np.cumsum(wide)
        counts = np.bincount((end - wide)[self.of] + (self.value % wide[self.of].astype(np.uint64)).astype(np.int64), minlength=int(wide.sum()))
        packed = np.minimum(counts, 65535).astype("<u2").tobytes()  # a lower count only lowers distances, which stays a bound
        return [packed[2 * (b - n) : 2 * b] for b, n in zip(end.tolist(), wide.tolist())]

    def prefix(self, hot: np.ndarray, percent: int) -> np.ndarray:
        """Which shingles are in their set's prefix."""
        late = np.isin(self.value, hot)
        order = np.lexsort((late, self.of))  # stable: by hash among equals
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        rank -= self.start[self.of]
        return rank < reach(self.size, percent)[self.of]


def tiers(size: np.ndarray, percent: int) -> np.ndarray:
    """Buckets of the embedding for sets of the given sizes: powers of two, so coarser counts are sums of finer ones.

    Random sets of n elements are about 1.1 sqrt(n buckets) apart in L1; that has to exceed what a pair
    within the wanted distance may differ in.
    """
    allowed = 2 * (100 - percent) / (100 + percent)
    need = np.maximum(4 * allowed * allowed * size, 1)
    return np.clip(1 << np.ceil(np.log2(need)).astype(np.int64), SIGNATURE, SIGNATURE_MOST)


def fold(counts: np.ndarray, wide: int) -> np.ndarray:
    """Rows of counts in fewer buckets."""
    return counts.reshape(len(counts), -1, wide).sum(axis=1)


def unpack(column) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").astype(np.int64) for x in column.to_pylist()]


def reach(size: np.ndarray, percent: int) -> np.ndarray:
    """Length of the prefix: |x| - ceil(t |x|) + 1."""
    return size + (-percent * size) // 100 + 1


def may_reach(a: np.ndarray, b: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b that differ in at least ``apart`` elements can reach the similarity."""
    both = (a + b - apart) // 2
    return (both > 0) & (100 * both >= percent * (a + b - both))


def _describe(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = Sets(batch.column(1), width)
            n = sets.many
            signatures = pa.array(sets.signatures(percent), pa.binary())
            empty = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sets.size), pa.array(sets.classes()), signatures, empty, empty], _DESCRIBED)
            low = np.arange(len(sets.value)) - sets.start[sets.of] < 2 * reach(sets.size, percent)[sets.of]
            value, seen = np.unique(sets.value[low], return_counts=True)
            often = np.flatnonzero(seen > 1)
            often = often[np.argsort(-seen[often], kind="stable")[:HOT_SLICE]]
            nothing = pa.nulls(len(often), pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, pa.nulls(len(often), pa.binary()), pa.array(value[often].view(np.int64)), pa.array(seen[often].astype(np.int64))], _DESCRIBED)

    return run


_DESCRIBED = ["id", "tag", "n", "class", "signature", "shingle", "seen"]


def _regions(width: int, percent: int, hot: bytes, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.frombuffer(hot, np.uint64)
        for batch in slices(batches):
            sets = Sets(batch.column(1), width)
            classes = sets.classes()
            _, first = np.unique(classes, return_index=True)  # one of each class is enough
            lead = np.zeros(sets.many, bool)
            lead[first] = True
            keep = np.flatnonzero(lead[sets.of] & sets.prefix(late, percent))
            key, own = sets.value[keep], classes[sets.of[keep]]
            bucket = (key % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order])) + 1
            parts = np.split(order, edges) if len(order) else []
            high = (key >> np.uint64(32)).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[x[0]]) for x in parts], pa.int32()), pa.array([high[x].tobytes() for x in parts], pa.binary()), pa.array([own[x].tobytes() for x in parts], pa.binary())],
                ["bucket", "keys", "classes"],
            )

    return run


def _shared(table_: pa.Table) -> pa.Table:
    """Members of the regions of one bucket that have at least two classes, by the region's pivot.

    A region is known by its bucket and 32 bits of its shingle's hash; two shingles that agree in
    them make one larger region, which loses nothing.  Regions with one pivot are united: copies of
    a document share most of their regions.
    """
    key = np.concatenate([np.frombuffer(x, "<u4") for x in table_.column("keys").to_pylist()])
    own = np.concatenate([np.frombuffer(x, np.int64) for x in table_.column("classes").to_pylist()])
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    first = np.ones(len(key), bool)
    first[1:] = np.diff(key) != 0
    group = np.cumsum(first) - 1
    pivot = own[first][group]
    keep = (np.bincount(group, own != pivot) > 0)[group]
    pairs = np.unique(np.stack([pivot[keep], own[keep]], 1), axis=0)
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["pivot", "class"])


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(0), np.int64)


def _whole_sets(width: int, flags: bytes, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(flags, np.uint8)
        for batch in slices(batches):
            ids = np.asarray(batch.column(0).fill_null(0), np.int64)
            hit = bloom.holds(wanted, bits, ids) & ~np.asarray(batch.column(0).is_null())
            batch = batch.filter(pa.array(hit))
            sets = Sets(batch.column(1), width)
            classes = sets.classes()
            _, first = np.unique(classes, return_index=True)
            first = first[sets.size[first] > 0]
            parts = [sets.value[a : a + n].tobytes() for a, n in zip(sets.start[first].tolist(), sets.size[first].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(classes[first]), pa.array(parts, pa.binary())], ["class", "members"])

    return run


def _bounded(percent: int):
    """Pairs (a, b, sizes, signatures) that the embedding can't exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = unpack(batch.column(4)), unpack(batch.column(5))
            kinds = np.array([(len(x), len(y)) for x, y in zip(one, two)], np.int64).reshape(-1, 2)
            apart = np.zeros(len(kinds), np.int64)
            for m, n in np.unique(kinds, axis=0).tolist():
                rows = np.flatnonzero((kinds == (m, n)).all(axis=1))
                left, right = (fold(np.stack([side[r] for r in rows]), min(m, n)) for side in (one, two))
                apart[rows] = np.abs(left - right).sum(axis=1)
            keep = may_reach(np.asarray(batch.column(2), np.int64), np.asarray(batch.column(3), np.int64), apart, percent)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                spot = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[spot] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["src", "dst"])

    return run


def region_forest(label: np.ndarray, size: np.ndarray, signatures: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of rows that may reach the similarity, only as many as join all groups that such pairs join.

    Rows of one label are joined from the start.  Cells split recursively in the coarsest counts; the
    widest difference that a pair of the given sizes may have bounds the triangle windows.  Pairs that
    stay are compared in the finest counts that both have.
    """
    _, root = np.unique(label, return_inverse=True)
    edges: list[tuple[int, int]] = []
    wide = np.array([len(x) for x in signatures])
    signature = np.stack([x.reshape(-1, SIGNATURE).sum(axis=0) for x in signatures])
    place = np.zeros(len(label), np.int64)
    fine = {}
    for kind in np.unique(wide).tolist():
        rows_ = np.flatnonzero(wide == kind)
        place[rows_] = np.arange(len(rows_))
        fine[kind] = np.stack([signatures[r] for r in rows_])

    def finer(row: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that the finer counts leave."""
        keep = []
        for kind in np.unique(wide[others]).tolist():
            some = others[wide[others] == kind]
            least = min(kind, int(wide[row]))
            apart = np.abs(fold(fine[kind][place[some]], least) - signatures[row].reshape(-1, least).sum(axis=0)).sum(axis=1)
            keep.append(some[may_reach(size[some], size[row], apart, percent)])
        return np.concatenate(keep)

    def compare(left: np.ndarray, right: np.ndarray) -> None:
        apart = np.abs(signature[left][:, None, :] - signature[right][None, :, :]).sum(axis=2)
        fits = may_reach(size[left][:, None], size[right][None, :], apart, percent)
        for row, hits in zip(left.tolist(), fits):
            others = right[hits]
            others = others[root[others] != root[row]]
            if len(others) and (wide[row] > SIGNATURE or (wide[others] > SIGNATURE).any()):
                others = finer(row, others)
            for other in others.tolist():
                if root[other] != root[row]:
                    edges.append((row, other))
                    root[root == root[other]] = root[row]

    def cells(rows: np.ndarray) -> None:
        if len(rows) < 2 or (root[rows] == root[rows[0]]).all():
            return
        if len(rows) <= LEAF:
            compare(rows, rows)
            return
        widest = (100 - percent) * 2 * size[rows].max() // (100 + percent) + 1
        far = lambda r: np.abs(signature[rows] - signature[r]).sum(axis=1)
        to_one = far(rows[np.argmax(far(rows[0]))])
        to_two = far(rows[np.argmax(to_one)])
        # a pair differs in at most `widest`: if one of it is nearer to a pivot, the other is in this window
        left, right = rows[to_one - to_two <= 2 * widest], rows[to_two - to_one <= 2 * widest]
        if max(len(left), len(right)) < 0.9 * len(rows):
            cells(left)
            cells(right)
            return
        order = rows[np.argsort(size[rows], kind="stable")]  # no separation: blocks of near sizes
        for at in range(0, len(order), LEAF):
            block = order[at : at + LEAF]
            last = int(np.searchsorted(size[order], 100 * size[block[-1]] // percent, "right"))
            for other in range(at, last, 16 * LEAF):
                compare(block, order[other : min(other + 16 * LEAF, last)])

    cells(np.arange(len(label)))
    return edges


def _in_regions(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table_, edges in runs(batches, 3):
            classes, label, size = (np.asarray(table_.column(i).combine_chunks(), np.int64) for i in (3, 4, 5))
            signatures = unpack(table_.column(6))
            found = set()
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                for x, y in region_forest(label[a:b], size[a:b], signatures[a:b], percent):
                    one, two = int(classes[a + x]), int(classes[a + y])
                    found.add((min(one, two), max(one, two)))
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Intersection sizes of sorted sets, all of ``left`` against all of ``right``, exactly."""
    both = np.concatenate([*left, *right])
    of = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    value, column, seen = np.unique(both, return_inverse=True, return_counts=True)
    number = np.full(len(value), -1)
    number[seen > 1] = np.arange((seen > 1).sum())
    column = number[column]
    of, column = of[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    total = int((seen > 1).sum())
    edges = np.searchsorted(column, np.arange(0, total + chunk, chunk))
    for number_, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        dense = np.zeros((len(left) + len(right), chunk), np.float32)
        dense[of[a:b], column[a:b] - number_ * chunk] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out.astype(np.int64)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set as its size and its symmetric difference from the set of its cluster's pivot.

    Rows come sorted by (cluster, block, rank); the row of rank 0 holds the pivot's set.
    """
    pivot = np.zeros(0, np.uint64)
    for batch in batches:
        keep, sizes, parts = [], [], []
        for i, (rank, members) in enumerate(zip(batch.column(2).to_pylist(), batch.column(5))):
            own = np.frombuffer(members.as_buffer(), np.uint64)
            if rank == 0:
                pivot = own.copy()
                continue
            keep.append(i)
            sizes.append(len(own))
            parts.append(np.setxor1d(own, pivot, assume_unique=True).tobytes())
        rows = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(3), rows.column(4), pa.array(sizes, pa.int64()), pa.array(parts, pa.binary())], ["cluster", "block", "class", "label", "size", "apart"])


def _blocks(percent: int):
    """Links inside clusters, block by block; only as many as join what links join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table_, edges in runs(batches, 3, 2_000):
            i, block, classes, label, sizes = (np.asarray(table_.column(c).combine_chunks(), np.int64) for c in (1, 3, 4, 5, 6))
            src, dst = [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if (label[a:b] == label[a]).all():
                    continue
                apart = [np.frombuffer(x, np.uint64) for x in table_.column(7).slice(a, b - a).to_pylist()]
                size, far = sizes[a:b], np.array([len(x) for x in apart])
                left, right = np.flatnonzero(block[a:b] == i[a]), np.flatnonzero(block[a:b] != i[a])
                right = right if len(right) else left
                shared = overlaps([apart[x] for x in left], [apart[x] for x in right])
                differ = far[left][:, None] + far[right][None, :] - 2 * shared
                both = (size[left][:, None] + size[right][None, :] - differ) // 2
                near = 100 * both >= percent * (both + differ)
                _, root = np.unique(label[a:b], return_inverse=True)
                for row, hits in zip(left.tolist(), near):
                    for other in right[hits].tolist():
                        if root[other] != root[row]:
                            src.append(int(classes[a + row]))
                            dst.append(int(classes[a + other]))
                            root[root == root[other]] = root[row]
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return run


def block_pairs(inside_: DataFrame, block: int, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(group, class, label, block)``, ``(group, block)`` and ``(group, i, j, block)``: blocks of about ``block`` classes, and their pairs.

    All pairs of classes with different labels meet in at least one pair of blocks.  A large label has
    blocks of its own, which need no comparison among themselves; small ones share blocks.
    """
    parts = inside_.groupBy("group", "label").agg(F.count(F.lit(1)).alias("m"))
    parts = parts.select("group", "label", F.when(F.col("m") >= block // 2, F.concat(F.lit("c"), F.col("label"))).otherwise("shared").alias("part"), "m")
    parts = stage(parts, f"{name}_parts")
    hot = hot_keys(parts.groupBy("group").agg(F.sum("m").alias("n")), "group")
    widths = parts.groupBy("group", "part").agg((F.floor((F.sum("m") - 1) / block) + 1).cast("int").alias("blocks"))
    number = lambda i: F.xxhash64("group", "part", i)
    blocks = widths.select("group", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).select("group", "part", number(F.col("i")).alias("block"))
    blocks = stage(blocks, f"{name}_blocks")
    other = blocks.select("group", F.col("part").alias("other_part"), F.col("block").alias("other"))
    pairs = blocks.join(other, "group").where("block <= other AND (part <> other_part OR part = 'shared')").select("group", F.col("block").alias("i"), F.col("other").alias("j"))
    ends = pairs.select("group", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    whole = parts.join(widths, ["group", "part"]).select("group", "label", "part", "blocks")
    dealt = join_hot(inside_, whole, ["group", "label"], hot, "class")
    dealt = dealt.select("group", "class", "label", number(F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).alias("block"))
    return stage(dealt, f"{name}_dealt"), stage(blocks.select("group", "block"), f"{name}_all"), ends


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``id, tag, n, class, component`` per row: ``component`` is the smallest id reachable by links.

    Links join sets whose intersection is at least ``percent`` hundredths of their union.  Texts
    without words (or null) have the empty set and link with nothing; so do rows with a null key.
    Rows that share a key are separate nodes of their classes, told apart by ``tag``, a hash of the
    text.  Extra columns of any name are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    tagged = rows.select("id", "text", F.xxhash64("text").alias("tag"))
    told = stage(tagged.mapInArrow(_describe(width, percent), "id long, tag long, n long, class long, signature binary, shingle long, seen long"), "described")
    described = told.where("n IS NOT NULL").select("id", "tag", "n", "class", "signature")
    hot_rows = told.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= HOT_LEAST)
    hot = hot_rows.orderBy(F.desc("seen"), "shingle").limit(HOT).select("shingle").collect()
    late = np.sort(np.array([r["shingle"] for r in hot], np.int64).view(np.uint64)).tobytes()
    classes = described.where("n > 0 AND id IS NOT NULL").groupBy("class").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes, "classes")

    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(shuffle_width(spark), -(-chars // BUCKET_CHARS))
    entries = rows.where("id IS NOT NULL").mapInArrow(_regions(width, percent, late, buckets), "bucket int, keys binary, classes binary").repartition(min(buckets, MOST_PARTITIONS), "bucket")
    members = stage(entries.groupBy("bucket").applyInArrow(_shared, "pivot long, class long").distinct(), "members")
    hot_pivots = hot_keys(members.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")), "pivot")

    def whole(wanted: DataFrame, name: str) -> DataFrame:
        """``class, members`` of the wanted classes (and of a few others), one row each."""
        ids = stage(wanted.join(classes.select("class", "id"), "class").select("id"), f"{name}_ids")
        count = ids.count()
        if bloom.EACH * count <= bloom.MOST:
            sets = rows.mapInArrow(_whole_sets(width, *bloom.build(ids, count, _ids)), "class long, members binary")
        else:
            every = np.full(bloom.LEAST // 8, 255, np.uint8).tobytes()
            sets = rows.join(ids, "id", "left_semi").mapInArrow(_whole_sets(width, every, bloom.LEAST), "class long, members binary")
        sets = stage(sets.withColumn("row", F.monotonically_increasing_id()), f"{name}_sets")
        one_each = sets.groupBy("class").agg(F.min("row").alias("row"))  # repeated rows and false hits of the filter
        return sets.join(one_each.select("row"), "row", "left_semi").select("class", "members")

    of = lambda x, n, c: classes.select(F.col("class").alias(x), F.col(c).alias(n))
    with_pivot = lambda pairs, lookup: join_hot(pairs, lookup, ["a"], hot_pivots, "b")
    stars = members.where("class <> pivot").select(F.col("pivot").alias("a"), F.col("class").alias("b"))
    stars = with_pivot(stars, of("a", "na", "n")).join(of("b", "nb", "n"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    stars = with_pivot(stars, of("a", "sa", "signature")).join(of("b", "sb", "signature"), "b")  # only pairs of fitting sizes carry counts
    stars = stars.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_bounded(percent), "a long, b long")
    stars = stage(stars, "stars")
    sets = whole(stars.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "star")
    full = with_pivot(stars, sets.select(F.col("class").alias("a"), F.col("members").alias("x")))
    full = full.join(sets.select(F.col("class").alias("b"), F.col("members").alias("y")), "b")
    links = stage(full.select("a", "b", "x", "y").mapInArrow(_verified(percent), "src long, dst long"), "star_links")
    label = stage(components(links).select(F.col("id").alias("class"), F.col("component").alias("label")), "labels")

    marked = members.join(label, "class", "left").select("pivot", "class", F.coalesce("label", "class").alias("label"))
    marked = stage(marked, "marked")
    mixed = marked.groupBy("pivot").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.count(F.lit(1)).alias("m")).where("p <> q AND m > 2").select("pivot", "m")
    rest = stage(join_hot(marked.where("class <> pivot"), mixed, ["pivot"], hot_pivots, "class"), "rest")
    described_as = classes.select("class", "n", "signature")
    zero = F.lit(0).cast("long")
    parts = rest.where(F.col("m") <= REGION).select(F.col("pivot").alias("group"), zero.alias("i"), zero.alias("j"), "class", "label")
    large = rest.where(F.col("m") > REGION).select(F.col("pivot").alias("group"), "class", "label")
    if not large.isEmpty():
        dealt, _, ends = block_pairs(large, REGION // 2, "regions")
        parts = parts.unionAll(dealt.join(ends, ["group", "block"]).select("group", "i", "j", "class", "label"))
    parts = parts.join(described_as, "class").select("group", "i", "j", "class", "label", "n", "signature").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    maybe = stage(parts.mapInArrow(_in_regions(percent), "a long, b long").distinct(), "maybe")
    cluster = stage(components(links.unionAll(maybe)).select(F.col("id").alias("class"), F.col("component").alias("cluster")), "cluster")
    hot_clusters = hot_keys(cluster.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "cluster")
    open_ = cluster.join(maybe.select(F.col("a").alias("class")).distinct(), "class").select("cluster").distinct()
    inside_ = join_hot(cluster, open_, ["cluster"], hot_clusters, "class").join(label, "class", "left")
    inside_ = stage(inside_.select(F.col("cluster").alias("group"), "class", F.coalesce("label", "class").alias("label")), "open")
    dealt, blocks, ends = block_pairs(inside_, BLOCK, "clusters")
    sets = whole(inside_.select("class"), "open")
    heads = inside_.groupBy("group").agg(F.min("class").alias("class")).join(sets, "class").select("group", "members")
    heads = blocks.join(heads, "group").select("group", "block", F.lit(0).alias("rank"), zero.alias("class"), zero.alias("label"), "members")
    rows_ = dealt.join(sets, "class").select("group", "block", F.lit(1).alias("rank"), "class", "label", "members")
    apart = heads.unionAll(rows_).repartition("group", "block").sortWithinPartitions("group", "block", "rank")
    apart = apart.mapInArrow(_differences, "cluster long, block long, class long, label long, size long, apart binary").withColumnRenamed("cluster", "group")
    spread = apart.join(ends, ["group", "block"]).select("group", "i", "j", "block", "class", "label", "size", "apart")
    spread = spread.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    more = stage(spread.mapInArrow(_blocks(percent), "src long, dst long"), "more_links")
    found = stage(components(links.unionAll(more)).select(F.col("id").alias("class"), F.col("component").alias("root")), "found")
    least = stage(found.join(classes.select("class", "id"), "class").groupBy("root").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n")), "least_ids")
    linked = join_hot(found, least.select("root", "component"), ["root"], hot_keys(least, "root"), "class").select("class", "component")
    answer = stage(classes.select("class", "id", "copies").join(linked, "class", "left").select("class", "copies", F.coalesce("component", "id").alias("component")), "answer")
    real = join_hot(described.where("n > 0 AND id IS NOT NULL"), answer.select("class", "component"), ["class"], hot_keys(answer, "class", "copies"), "id")
    alone = described.where("n = 0 OR id IS NULL").select("id", "tag", "n", "class", F.col("id").alias("component"))
    return real.select("id", "tag", "n", "class", "component").unionAll(alone)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 3-word shingle sets are at least 0.9 alike."""
    found = jaccard_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document, that of the smallest key, of each group of near-duplicates.

    Rows without words or with a null key are in no group and stay; repeated rows of a key that stays
    all stay; of rows that share a key, only those whose own text goes are dropped.  Columns of any
    name pass as they are.
    """
    gone = jaccard_classes(docs, key, text, width, percent).where("id <> component").select("id", "tag").distinct()
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("tag"))
    return own.join(gone, ["id", "tag"], "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
