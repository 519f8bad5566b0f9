"""Best-fit packing of token sequences by a distributed grouping genetic algorithm.

Documents are tokenised once; only ``(key, piece, start, length, crc)`` rows travel.  Pieces of
exactly the capacity are sequences of their own.  The other pieces are dealt at random into cells
of bounded size.  Each cell is evolved by several islands (rows of a DataFrame, which carry their
whole population from epoch to epoch).  Founders are best fits of random orders; the first island
also has best-fit-decreasing, so no cell ends worse than that.  Crossover injects whole well-filled
bins of one parent into the other, drops the bins that hold duplicates, swaps displaced pieces for
smaller ones where that fills a bin better, and best-fits the rest; after each epoch the elite of
every island replaces the worst of the next island of its ring.  The best island of a cell wins.
Fewer bins count first, then the sum of squared fills: so free room gathers in few bins, which are
opened again and dealt into fewer cells, until one round closes them all.

No step needs more than one cell in a task, and the number of cells grows with the input.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaweave.llm.tokens import encoder, slices
from deltaweave.runtime import ship, shuffle_width, stage, table

CAPACITY = 2048
#: Pieces in a cell, islands of a cell, epochs (a migration lies between two), generations of an epoch, individuals of an island.
CELL, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 1500, 3, 3, 3, 4
#: Bins of a child in which pairs of pieces are tried against displaced pairs.
PAIR_BINS = 8
#: A bin is opened again for the next round if more than this share of it is free; the most rounds.
LOOSE, ROUNDS = 0.02, 4

Bins = list[list[int]]


def best_fit(lengths: list[int], order: list[int], bins: Bins, free: list[int], capacity: int) -> tuple[Bins, list[int]]:
    """Put the items of ``order`` into the fullest bin that has room, or a new one. Changes its arguments."""
    room = sorted((f, i) for i, f in enumerate(free))
    for item in order:
        need = lengths[item]
        at = bisect_left(room, (need, -1))
        if at < len(room):
            left, index = room.pop(at)
            bins[index].append(item)
        else:
            left, index = capacity, len(bins)
            bins.append([item])
            free.append(0)
        free[index] = left - need
        insort(room, (left - need, index))
    return bins, free


def fitness(free: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the sum of squared fills; smaller is better."""
    return len(free), -sum((1 - f / capacity) ** 2 for f in free)


def swap_in(lengths: list[int], displaced: list[int], bins: Bins, free: list[int], rng: random.Random) -> list[int]:
    """Swap displaced items for smaller ones where a bin gets fuller; returns what is displaced then. Changes its arguments."""
    items = sorted(displaced, key=lambda x: lengths[x])
    sizes = [lengths[x] for x in items]

    def trade(index: int, out: list[int], come: list[int]) -> None:
        for x in come:
            at = items.index(x, bisect_left(sizes, lengths[x]))
            del items[at], sizes[at]
        for x in out:
            at = bisect_left(sizes, lengths[x])
            items.insert(at, x)
            sizes.insert(at, lengths[x])
        bins[index] = [x for x in bins[index] if x not in out] + come
        free[index] -= sum(lengths[x] for x in come) - sum(lengths[x] for x in out)

    open_ = [i for i, f in enumerate(free) if f > 0]
    rng.shuffle(open_)
    for index in open_:
        for x in list(bins[index]):
            at = bisect_right(sizes, lengths[x] + free[index]) - 1
            if at >= 0 and sizes[at] > lengths[x]:
                trade(index, [x], [items[at]])
                if not free[index]:
                    break
    for index in [i for i in open_ if free[i]][:PAIR_BINS]:
        old = bins[index][:6]
        pair = max(((lengths[x] + lengths[y], x, y) for i, x in enumerate(old) for y in old[:i]), default=None, key=lambda t: (rng.random(), t))
        if pair:
            best, low, high = (pair[0], -1, -1), 0, len(items) - 1
            while low < high:
                total = sizes[low] + sizes[high]
                if total > pair[0] + free[index]:
                    high -= 1
                else:
                    best = max(best, (total, low, high))
                    low += 1
            if best[1] >= 0:
                trade(index, [pair[1], pair[2]], [items[best[1]], items[best[2]]])
    return items


def crossover(lengths: list[int], a: Bins, a_free: list[int], b: Bins, b_free: list[int], capacity: int, rng: random.Random) -> tuple[Bins, list[int]]:
    """Inject well-filled bins of ``b`` into ``a``, drop bins with duplicates, place the displaced items."""
    ranked = sorted(range(len(b)), key=lambda i: (b_free[i], rng.random()))
    chosen = [i for i in ranked[: max(1, len(ranked) // 2)] if rng.random() < 0.5] or ranked[:1]
    injected = {x for i in chosen for x in b[i]}
    bins, free = [list(b[i]) for i in chosen], [b_free[i] for i in chosen]
    displaced: list[int] = []
    for i, items in enumerate(a):
        if injected.isdisjoint(items):
            bins.append(list(items))
            free.append(a_free[i])
        else:
            displaced += [x for x in items if x not in injected]
    displaced = swap_in(lengths, displaced, bins, free, rng)
    return best_fit(lengths, displaced[::-1], bins, free, capacity)


def mutate(lengths: list[int], bins: Bins, free: list[int], capacity: int, rng: random.Random) -> tuple[Bins, list[int]]:
    """Open the emptiest bins and a few at random, and place their items again."""
    n = len(bins)
    drop = set(sorted(range(n), key=lambda i: -free[i])[: max(1, n // 20)]) | {rng.randrange(n) for _ in range(max(1, n // 50))}
    kept, kept_free = [list(b) for i, b in enumerate(bins) if i not in drop], [f for i, f in enumerate(free) if i not in drop]
    items = swap_in(lengths, [x for i in drop for x in bins[i]], kept, kept_free, rng)
    return best_fit(lengths, sorted(items, key=lambda x: -lengths[x] * rng.uniform(0.9, 1.1)), kept, kept_free, capacity)


def evolve(lengths: list[int], seed: int, people: list[list[int]] | None, migrant: list[int] | None, capacity: int = CAPACITY, generations: int = GENERATIONS, population: int = POPULATION, decreasing: bool = True) -> tuple[list[list[int]], tuple[int, float], int]:
    """One epoch of one island: its population (the bin number of each item, best first), the best fitness, and the crossovers made.

    Without ``people`` the island is founded: by best-fit-decreasing if ``decreasing``, and by best fits
    of random orders.  ``migrant`` replaces the worst.  Evolution ends early only when, after at
    least one crossover, no packing could be fitter: one bin alone has room.
    """
    rng = random.Random(seed)

    def unpack(assigned: list[int]) -> tuple[Bins, list[int]]:
        bins: Bins = [[] for _ in range(max(assigned) + 1)]
        for item, index in enumerate(assigned):
            bins[index].append(item)
        return bins, [capacity - sum(lengths[x] for x in b) for b in bins]

    score = lambda p: fitness(p[1], capacity)
    packings = [unpack(x) for x in people or []]
    if not packings:
        if decreasing:
            packings.append(best_fit(lengths, sorted(range(len(lengths)), key=lambda x: -lengths[x]), [], [], capacity))
        while len(packings) < population:
            packings.append(best_fit(lengths, rng.sample(range(len(lengths)), len(lengths)), [], [], capacity))
    packings.sort(key=score)
    if migrant:
        packings = sorted([*packings[: population - 1], unpack(migrant)], key=score)
    made = 0
    for _ in range(generations if len(packings[0][0]) > 1 and len(packings) > 1 else 0):
        if made and sum(f > 0 for f in packings[0][1]) <= 1:
            break
        young = []
        for _ in range(population - 1):
            first, second = rng.sample(packings, 2)
            child = crossover(lengths, *first, *second, capacity, rng)
            made += 1
            young.append(mutate(lengths, *child, capacity, rng) if rng.random() < 0.3 else child)
        packings = sorted(packings + young, key=score)[:population]
    out = []
    for bins, _ in packings:
        assigned = [0] * len(lengths)
        for index, items in enumerate(bins):
            for item in items:
                assigned[item] = index
        out.append(assigned)
    return out, score(packings[0]), made


_STATE = "cell int, island int, lengths array<int>, people array<array<int>>, n_bins long, loss double, crossovers long"


def _epoch(capacity: int, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r in enumerate(batch.to_pylist()):
                seed = (r["cell"] * 1009 + r["island"]) * 8191 + salt
                people, (n_bins, loss), made = evolve(r["lengths"], seed, r["people"], r["migrant"], capacity, decreasing=r["island"] == 0)
                row = batch.slice(i, 1)
                columns = [pa.array([people], pa.list_(pa.list_(pa.int32()))), pa.array([n_bins], pa.int64()), pa.array([loss], pa.float64()), pa.array([r["crossovers"] + made], pa.int64())]
                yield pa.RecordBatch.from_arrays([*row.columns[:3], *columns], ["cell", "island", "lengths", "people", "n_bins", "loss", "crossovers"])

    return run


def _pack_round(items: DataFrame, cells: int, capacity: int, islands: int, epochs: int, number: int) -> DataFrame:
    """``items(item, length)`` with ``cell``, ``bin`` and ``free`` of its bin."""
    dealt = items.withColumn("cell", F.pmod(F.xxhash64("item", F.lit(number)), F.lit(cells)).cast("int"))
    packed = dealt.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("items"))
    packed = stage(packed, f"cells{number}")
    state = packed.select("cell", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.length").alias("lengths"))
    state = state.withColumns({"people": F.lit(None).cast("array<array<int>>"), "migrant": F.lit(None).cast("array<int>"), "crossovers": F.lit(0).cast("long")})
    width = max(shuffle_width(items.sparkSession), -(-cells * islands // 16))
    for epoch in range(epochs):
        spread = state.repartition(width, "cell", "island").select("cell", "island", "lengths", "people", "migrant", "crossovers")
        state = stage(spread.mapInArrow(_epoch(capacity, number * 97 + epoch), _STATE), f"islands{number}_{epoch}")
        if epoch + 1 < epochs:
            ring = state.select("cell", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("people")[0].alias("migrant"))
            state = state.select("cell", "island", "lengths", "people", "crossovers").join(ring, ["cell", "island"])
    best = state.groupBy("cell").agg(F.min(F.struct("n_bins", "loss", "island", F.col("people")[0].alias("elite"))).alias("best")).select("cell", "best.elite")
    rows = packed.join(best, "cell").select("cell", F.explode(F.arrays_zip("items", "elite")).alias("x"))
    rows = rows.select("cell", F.col("x.items.item").alias("item"), F.col("x.items.length").alias("length"), F.col("x.elite").alias("bin"))
    free = rows.groupBy("cell", "bin").agg((F.lit(capacity) - F.sum("length")).alias("free"))
    return stage(rows.join(free, ["cell", "bin"]), f"packed{number}")


def pack(items: DataFrame, capacity: int = CAPACITY, cell: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``(item, sequence_id, offset)`` for ``items(item long, length int)`` with 1 <= length <= capacity.

    Items are distinct numbers from 0.  Offsets are gapless from 0 in each sequence.  An empty table gives
    an empty result.
    """
    ship(items.sparkSession)
    full = items.where(F.col("length") == capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < capacity).select("item", "length")
    done: list[DataFrame] = []
    count = rest.count()
    for number in range(ROUNDS if count else 0):
        cells = -(-count // cell)
        last = cells == 1 or number == ROUNDS - 1
        packed = _pack_round(rest, cells, capacity, islands, epochs, number)
        closed = packed if last else packed.where(F.col("free") <= int(LOOSE * capacity))
        inside = Window.partitionBy("cell", "bin").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
        name = -(((F.col("cell").cast("long") * ROUNDS + number) * F.lit(1 << 20)) + F.col("bin") + 1)
        done.append(closed.select("item", name.alias("sequence_id"), F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset")))
        if last:
            break
        rest = packed.where(F.col("free") > int(LOOSE * capacity)).select("item", "length")
        count = rest.count()
        if not count:
            break
    for part in done:
        full = full.unionAll(part)
    return full


def _pieces(path: str, end_id: int, capacity: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for key, packed in zip(batch.column(0).to_pylist(), encoder(path).packed(batch.column(1))):
                view = memoryview(bytes(packed) + end)
                for piece, at in enumerate(range(0, len(view), 4 * capacity)):
                    part = view[at : at + 4 * capacity]
                    for column, value in zip(out, (key, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Place every piece of every document: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null texts count as empty and hold only ``end_id``.  Documents longer than ``capacity`` are cut
    into pieces of ``capacity`` ids, the last of which may be shorter.  Repeated rows and null keys
    are packed like any other row.  Extra columns are ignored.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = source.mapInArrow(_pieces(path, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = stage(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces.select("item", F.col("length").cast("int").alias("length")), capacity)
    return pieces.join(placed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
