"""Grid fields as long rows ``(mol, y, x, v)``: diffusion, advection and boundary rules.

Neighbours are found by shifting each cell onto its four neighbours and summing by place: one
shuffle, no self joins, and a fixed five rows for each cell.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaweave.runtime import stage

SIDES = {"w": (0, -1), "e": (0, 1), "n": (-1, 0), "s": (1, 0)}


#: Rules at a side; ``("dirichlet", v)`` holds the value v outside.
RULES = ("neumann", "outflow", "periodic", "dirichlet")
#: After so many substeps the field is written, which cuts its lineage.
EVERY = 8


def sides(boundary) -> dict[str, tuple[str, float]]:
    """The rule of each side from one rule for all or a mapping of sides (``w e n s``); a side that is not named has no gradient."""
    given = boundary if isinstance(boundary, dict) else dict.fromkeys(SIDES, boundary)
    if unknown := set(given) - set(SIDES):
        raise ValueError(f"unknown sides {sorted(unknown)}")
    told = {k: given.get(k, "neumann") for k in SIDES}
    out = {k: (v, 0.0) if isinstance(v, str) else (v[0], float(v[1])) for k, v in told.items()}
    if unknown := {v[0] for v in out.values()} - set(RULES):
        raise ValueError(f"unknown boundary rules {sorted(unknown)}")
    return out


def with_neighbors(field: DataFrame, nx: int, ny: int, boundary="neumann", outside: float | None = None) -> DataFrame:
    """Columns ``w e n s``: the neighbours' values; what lies beyond a side follows that side's rule.

    ``neumann`` and ``outflow`` repeat the cell itself, ``periodic`` takes the far end of the row or
    column, ``dirichlet`` a fixed value (``outside``, if it is given, for all of them).
    """
    rule = {k: (kind, value if outside is None else float(outside)) for k, (kind, value) in sides(boundary).items()}
    shifted = [F.struct(F.lit("v").alias("side"), F.col("y").alias("y"), F.col("x").alias("x"))]
    for k, (dy, dx) in SIDES.items():
        y, x = F.col("y") - dy, F.col("x") - dx
        if rule[k][0] == "periodic":
            y, x = F.pmod(y, F.lit(ny)), F.pmod(x, F.lit(nx))
        shifted.append(F.struct(F.lit(k).alias("side"), y.alias("y"), x.alias("x")))
    rows = field.select("mol", F.col("v").alias("told"), F.explode(F.array(*shifted)).alias("p")).select("mol", "p.side", "p.y", "p.x", "told")
    sums = rows.groupBy("mol", "y", "x").agg(*[F.max(F.when(F.col("side") == k, F.col("told"))).alias(k) for k in ("v", *SIDES)])
    missing = {k: F.lit(value) if kind == "dirichlet" else F.col("v") for k, (kind, value) in rule.items()}
    return sums.where("v IS NOT NULL").select("mol", "y", "x", "v", *[F.coalesce(k, missing[k]).alias(k) for k in SIDES])


def substeps(dt: float, dx: float, dy: float, rate: float) -> int:
    return max(1, math.ceil(dt / (min(dx, dy) ** 2 / (4 * rate)))) if rate > 0 else 1


def diffuse(field: DataFrame, nx: int, ny: int, rate: float = 0.1, dt: float = 1.0, dx: float = 1.0, dy: float = 1.0, boundary="neumann") -> DataFrame:
    """Explicit five-point diffusion with stable substeps, kept at 0 or above."""
    n = substeps(dt, dx, dy, rate)
    for i in range(n):
        if i and i % EVERY == 0:
            field = stage(field, "field")
        near = with_neighbors(field, nx, ny, boundary)
        flow = (F.col("e") - 2 * F.col("v") + F.col("w")) / dx**2 + (F.col("s") - 2 * F.col("v") + F.col("n")) / dy**2
        field = near.select("mol", "y", "x", F.greatest(F.lit(0.0), F.col("v") + rate * (dt / n) * flow).alias("v"))
    return field


def advect(field: DataFrame, nx: int, ny: int, vx: float, vy: float, dt: float, dx: float = 1.0, dy: float = 1.0, boundary="neumann") -> DataFrame:
    """One upwind step of the full time, kept at 0 or above."""
    near = with_neighbors(field, nx, ny, boundary)
    across = (F.col("v") - F.col("w")) if vx >= 0 else (F.col("e") - F.col("v"))
    down = (F.col("v") - F.col("n")) if vy >= 0 else (F.col("s") - F.col("v"))
    return near.select("mol", "y", "x", F.greatest(F.lit(0.0), F.col("v") - dt * (vx * across / dx + vy * down / dy)).alias("v"))


def flatten(field: DataFrame, nx: int) -> DataFrame:
    """Cells by their place in row order: ``mol, i, v``."""
    return field.select("mol", (F.col("y") * nx + F.col("x")).alias("i"), "v")


def rebuild(cells: DataFrame, nx: int) -> DataFrame:
    """Cells from their place in row order."""
    return cells.select("mol", F.floor(F.col("i") / nx).cast("int").alias("y"), F.pmod("i", F.lit(nx)).cast("int").alias("x"), "v")
