"""Particles on a grid: exchange with fields, division, boundaries, masses, random walks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.functions.draws import normal_column, uniform_column
from deltaweave.functions.names import unused
from deltaweave.operators.order import running
from deltaweave.runtime import ship


def bin_of(position: Column, size: float, bins: int) -> Column:
    """Grid place of a position, kept inside the grid."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(position / (size / bins)).cast("int")))


def deposit(particles: DataFrame, amount: str, out: str) -> DataFrame:
    """Sum of what the particles of each cell give off."""
    return particles.groupBy("by", "bx").agg(F.sum(amount).alias(out), F.count(F.lit(1)).alias("n"))


def exchange(particles: DataFrame, field: DataFrame, amount: str, value: str, volume: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Deposit on the field and sample the field as it was; returns the field's update and the particles."""
    given = deposit(particles, amount, "deposit").withColumn("deposit", F.col("deposit") / volume)
    sampled = particles.join(field.select("by", "bx", F.col(value).alias("sampled")), ["by", "bx"], "left")
    return given, sampled.withColumn(amount, F.lit(0.0))


def exchange_maps(particles: DataFrame, field: DataFrame, nx: int, ny: int, bounds: tuple[float, float], depth: float = 1.0, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Exchange of any molecules between ``particles(key, x, y, local, exchange)`` and ``field(mol, y, x, v)``.

    Returns the changes of the field ``(mol, y, x, v)`` (what the particles of a cell give off, by
    volume; molecules that the field lacks are lost) and of the particles ``(key, local, exchange)``:
    ``local`` becomes what the cell held before, ``exchange`` goes to zero.  Particles without a
    position take no part.
    """
    volume = max(bounds[0] / nx * (bounds[1] / ny) * depth, 1e-10)
    placed = particles.where("x IS NOT NULL AND y IS NOT NULL").select(F.col(key).alias("id"), bin_of(F.col("x"), bounds[0], nx).alias("bx"), bin_of(F.col("y"), bounds[1], ny).alias("by"), "local", "exchange")
    given = placed.select("by", "bx", F.explode("exchange").alias("mol", "amount")).groupBy("mol", "by", "bx").agg((F.sum("amount") / volume).alias("v"))
    known = field.select("mol", F.col("y").alias("by"), F.col("x").alias("bx"))
    onto = given.join(known, ["mol", "by", "bx"], "left_semi").select("mol", F.col("by").alias("y"), F.col("bx").alias("x"), "v")
    cells = field.groupBy(F.col("y").alias("by"), F.col("x").alias("bx")).agg(F.map_from_entries(F.collect_list(F.struct("mol", "v"))).alias("held"))
    sampled = placed.join(cells, ["by", "bx"], "left")
    local = F.transform_values("held", lambda mol, v: v - F.coalesce(F.try_element_at("local", mol), F.lit(0.0)))
    return onto, sampled.select(F.col("id").alias(key), local.alias("local"), F.transform_values("exchange", lambda _, v: -v).alias("exchange"))


def divide_particles(particles: DataFrame, mass: str, threshold: float, key: str, jitter: float = 0.0, seed: int = 0, most: int | None = None, parts: str | None = None) -> DataFrame:
    """Particles at or above the threshold become two of half the mass, with names of their own.

    With ``most``, division goes in the order of keys, and once there are that many particles a
    division leaves one daughter.  ``parts`` is a column of masses by name, which are halved too; the
    mass is then their sum.  ``jitter`` moves daughters (columns ``x`` and ``y``) by seeded normal draws.
    """
    index, place = unused("daughter", particles), unused("place", particles)
    held = F.coalesce(total_mass(F.col(parts)), F.col(mass)) if parts else F.col(mass)
    heavy = particles.where(held >= threshold)
    number = F.lit(2)
    if most is not None:
        room = max(0, most - particles.count())
        heavy = running(heavy, [key], None, place)
        number = F.when(F.col(place) < room, 2).otherwise(1)
    split = heavy.withColumn(index, F.explode(F.sequence(F.lit(0), number - 1))).drop(place)
    name = F.concat_ws("_", F.col(key).cast("string"), F.col(index).cast("string"))
    changed = {mass: held / 2, key: name}
    if parts:
        changed[parts] = F.transform_values(parts, lambda _, v: v / 2)
    if jitter:
        changed |= {c: F.col(c) + jitter * normal_column(F.lit(seed), name, F.lit(c)) for c in ("x", "y")}
    stay = particles.where(~F.coalesce(held >= threshold, F.lit(False))).withColumn(key, F.col(key).cast("string"))
    return stay.unionByName(split.withColumns(changed).drop(index))


def clamp(position: Column, low: float, high: float) -> Column:
    """The correction that brings a position back between the bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), position)) - position


def total_mass(parts: Column) -> Column:
    """Sum of a map's values."""
    return F.aggregate(F.map_values(parts), F.lit(0.0), lambda a, b: a + b)


def walk(particles: DataFrame, rate: float, dt: float, seed: int = 0, drift: tuple[float, float] = (0.0, 0.0), key: str = "id", step: int = 0) -> DataFrame:
    """Brownian displacement and drift; draws depend on the seed, the particle's key, the step and the axis alone."""
    spread = (2 * rate * dt) ** 0.5
    return particles.withColumns({c: F.col(c) + (spread * normal_column(F.lit(seed), F.col(key), F.lit(step), F.lit(c)) + v * dt) for c, v in zip(("x", "y"), drift)})


#: Mass by area, from which a particle's radius follows.
DENSITY = 0.015
#: Pairs of discs in neighbouring cells that are looked at together.
CANDIDATES = 1 << 20


def radius(mass: Column, density: float = DENSITY) -> Column:
    """The radius of a disc of this mass."""
    return F.sqrt(mass / (density * F.pi()))


def short_id(*parts: Column) -> Column:
    """A name of eight characters, from the hash of the parts."""
    return F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8)


def particle(x: Column, y: Column, mass: Column, molecules: list[str], *named_by: Column) -> Column:
    """A new particle as a struct, with empty exchange."""
    nothing = F.create_map(*[c for m in molecules for c in (F.lit(m), F.lit(0.0))]) if molecules else F.create_map().cast("map<string,double>")
    return F.struct(short_id(*named_by).alias("id"), x.alias("x"), y.alias("y"), mass.alias("mass"), radius(mass).alias("radius"), nothing.alias("local"), nothing.alias("exchange"))


#: Sides of the area: the axis, and whether it is the far end.
SIDES = {"left": ("x", False), "right": ("x", True), "bottom": ("y", False), "top": ("y", True)}


def manage(particles: DataFrame, bounds: tuple[float, float], buffer: float, remove: tuple[str, ...] = ()) -> DataFrame:
    """``particles`` without those beyond the sides of ``remove``, all others brought back inside the buffer.

    ``dx`` and ``dy`` are the corrections (0 where none is needed).  A particle without a position stays.
    """
    if unknown := set(remove) - set(SIDES):
        raise ValueError(f"unknown sides {sorted(unknown)}")
    size = dict(zip(("x", "y"), bounds))
    gone = F.lit(False)
    for side in remove:
        axis, far = SIDES[side]
        gone = gone | (F.col(axis) > size[axis] - buffer if far else F.col(axis) < buffer)
    kept = particles.where(~F.coalesce(gone, F.lit(False)))
    off = {a: clamp(F.col(a), buffer, size[a] - buffer) for a in size}
    needed = {a: F.when(F.abs(off[a]) > 1e-10, off[a]).otherwise(F.lit(0.0)) for a in size}
    return kept.withColumns({"dx": needed["x"], "dy": needed["y"]}).withColumns({a: F.col(a) + F.col(f"d{a}") for a in size})


def born(spark: SparkSession, sides: list[str], bounds: tuple[float, float], buffer: float, rate: float, dt: float, masses: tuple[float, float], seed: int, step: int = 0) -> DataFrame:
    """``id, side, x, y, mass, radius`` of the particles that enter in ``dt``: at each named side one with chance 1 - exp(-rate dt)."""
    rows = spark.createDataFrame([(i, s, *(SIDES[s] if s in SIDES else (None, None))) for i, s in enumerate(sides)], "n int, side string, axis string, far boolean")
    draw = lambda what: uniform_column(F.lit(seed), F.lit(step), F.col("n"), F.lit(what))
    rows = rows.where(draw("birth") < 1.0 - math.exp(-rate * dt))
    size = dict(zip(("x", "y"), bounds))
    spot = {a: F.when(F.col("axis").isNull(), size[a] / 2).when(F.col("axis") == a, F.when(F.col("far"), size[a] - buffer).otherwise(buffer)).otherwise(draw("spot") * size[a]) for a in size}
    mass = masses[0] + draw("mass") * (masses[1] - masses[0])
    told = rows.select(short_id(F.lit(seed), F.lit(step), F.col("n")).alias("id"), "side", spot["x"].alias("x"), spot["y"].alias("y"), mass.alias("mass"))
    return told.withColumn("radius", radius(F.col("mass")))


def collide(particles: DataFrame, bounds: tuple[float, float], dt: float, gravity: tuple[float, float] = (0.0, 0.0), elasticity: float = 1.0, damping: float = 0.0, substeps: int = 10, world: str = "world", key: str = "id") -> DataFrame:
    """Discs that move, fall, bounce off walls and off each other, world by world: ``world, key, dx, dy, dvx, dvy, dradius``.

    ``particles`` has ``world, key, x, y, vx, vy, mass, radius`` (null velocities are 0, a null mass is
    1).  A velocity falls to the part ``damping`` of itself in a unit of time, if that is between 0 and
    1.  Each substep moves all discs, reflects them at walls and exchanges impulses along the line of
    centres of those that touch; only discs of neighbouring grid cells are compared.  A world is one
    task's work; worlds are independent.  Infinite ``bounds`` are no walls on the far sides.
    """
    ship(particles.sparkSession)
    h, keep = dt / substeps, (damping ** (dt / substeps) if 0 < damping < 1 else 1.0)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key, kind="stable").reset_index(drop=True)
        at = frame[["x", "y"]].fillna(0.0).to_numpy(float)
        v = frame[["vx", "vy"]].fillna(0.0).to_numpy(float)
        m = frame["mass"].fillna(1.0).to_numpy(float)
        r = np.sqrt(m / (DENSITY * np.pi))
        start, v0, low, high = at.copy(), v.copy(), r[:, None], np.asarray(bounds)[None, :] - r[:, None]
        side = max(2 * float(r.max()), 1e-9) if len(r) else 1.0
        for _ in range(substeps):
            v = (v + h * np.asarray(gravity)) * keep
            at = at + h * v
            for wall, sign in ((low, 1.0), (high, -1.0)):
                out = (at - wall) * sign < 0
                v = np.where(out & (v * sign < 0), -elasticity * v, v)
                at = np.where(out, wall, at)
            for i, j in touching(at, r, side):
                gap = at[j] - at[i]
                far = math.hypot(*gap)
                line = gap / far if far > 0 else np.array([1.0, 0.0])
                speed = float((v[j] - v[i]) @ line)
                total = 1 / m[i] + 1 / m[j]
                if speed < 0:
                    push = -(1 + elasticity) * speed / total
                    v[i], v[j] = v[i] - push / m[i] * line, v[j] + push / m[j] * line
                overlap = r[i] + r[j] - far
                at[i], at[j] = at[i] - overlap / m[i] / total * line, at[j] + overlap / m[j] / total * line
        moved, faster = at - start, v - v0
        old = frame["radius"].to_numpy(float) if "radius" in frame else r
        return pd.DataFrame({world: frame[world], key: frame[key], "dx": moved[:, 0], "dy": moved[:, 1], "dvx": faster[:, 0], "dvy": faster[:, 1], "dradius": r - np.where(np.isnan(old), r, old)})

    kinds = [f"`{c}` {particles.schema[c].dataType.simpleString()}" for c in (world, key)]
    return particles.groupBy(world).applyInPandas(run, ", ".join([*kinds, "dx double", "dy double", "dvx double", "dvy double", "dradius double"]))


def touching(at: np.ndarray, r: np.ndarray, side: float) -> list[tuple[int, int]]:
    """Pairs of discs that overlap, in order; only neighbouring cells of a grid of width ``side`` are looked at."""
    if len(at) < 2:
        return []
    spots = np.floor(at / side).astype(np.int64)
    xs, column = np.unique(spots[:, 0], return_inverse=True)
    ys, row = np.unique(spots[:, 1], return_inverse=True)
    cell = column * len(ys) + row
    order = np.argsort(cell, kind="stable")
    filled = cell[order]
    found = []
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            x, y = np.searchsorted(xs, spots[:, 0] + dx), np.searchsorted(ys, spots[:, 1] + dy)
            near = np.minimum(x, len(xs) - 1) * len(ys) + np.minimum(y, len(ys) - 1)
            real = (xs[np.minimum(x, len(xs) - 1)] == spots[:, 0] + dx) & (ys[np.minimum(y, len(ys) - 1)] == spots[:, 1] + dy)
            first = np.searchsorted(filled, near, "left")
            many = np.where(real, np.searchsorted(filled, near, "right") - first, 0)
            ends = np.cumsum(many)
            low = 0
            while low < len(at):  # candidates of a bounded number of discs at once
                high = max(low + 1, int(np.searchsorted(ends, ends[low] - many[low] + CANDIDATES, "right")))
                n = many[low:high]
                i = np.repeat(np.arange(low, high), n)
                j = order[np.repeat(first[low:high] - (np.cumsum(n) - n), n) + np.arange(len(i))]
                i, j = i[j > i], j[j > i]
                close = np.hypot(*(at[j] - at[i]).T) < (r[i] + r[j]) * (1 + 1e-12)
                found.append(np.stack([i[close], j[close]], 1))
                low = high
    pairs = np.concatenate(found)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist()
    return [(i, j) for i, j in pairs if math.hypot(*(at[j] - at[i])) < r[i] + r[j]]
