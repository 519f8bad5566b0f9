"""Flux balance: linear programs over a reaction network, one per row.

Rows are independent, so they are dealt over tasks as Arrow batches; the network is plan data of a
fixed size that travels with the function.  Rows without a solution stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaweave.runtime import ship

#: Rounding allowed in pivots and feasibility; biomass of at most ``BARE`` does nothing; an infinite bound counts as ``WIDE``.
TOLERANCE, BARE, WIDE = 1e-9, 1e-12, 1e6


@dataclass(frozen=True)
class Network:
    """Reactions; ``balance[m][r]`` is what reaction r makes of metabolite m."""

    reactions: tuple[str, ...]
    balance: tuple[tuple[float, ...], ...]
    lower: tuple[float, ...]
    upper: tuple[float, ...]
    objective: int


@dataclass(frozen=True)
class Uptake:
    """A substrate column, its exchange reaction (negative flux takes up) and its Monod constants."""

    substrate: str
    reaction: str
    km: float
    vmax: float


def network(document: dict) -> Network:
    """A network from a model document: ``metabolites`` and ``reactions`` with coefficients and bounds.

    The objective is the first reaction whose id speaks of biomass, in any case of letters; without
    one, the first with an objective coefficient.
    """
    metabolites = {m["id"]: i for i, m in enumerate(document["metabolites"])}
    reactions = document["reactions"]
    balance = np.zeros((len(metabolites), len(reactions)))
    for j, reaction in enumerate(reactions):
        for name, amount in reaction["metabolites"].items():
            balance[metabolites[name], j] = amount
    named = [j for j, r in enumerate(reactions) if "biomass" in r["id"].lower()]
    wanted = named or [j for j, r in enumerate(reactions) if r.get("objective_coefficient")]
    if not wanted:
        raise ValueError("the model has no objective")
    bounds = [[float(r[k]) for r in reactions] for k in ("lower_bound", "upper_bound")]
    return Network(tuple(r["id"] for r in reactions), tuple(map(tuple, balance.tolist())), *map(tuple, bounds), wanted[0])


def _pivot(t: np.ndarray, basis: list[int], row: int, column: int) -> None:
    t[row] /= t[row, column]
    others = np.arange(len(t)) != row
    t[others] -= np.outer(t[others, column], t[row])
    basis[row] = column


def _climb(t: np.ndarray, basis: list[int], allowed: int) -> None:
    """Simplex with the least-index rule, which cannot cycle; the last row is the objective."""
    while True:
        better = np.flatnonzero(t[-1, :allowed] < -TOLERANCE)
        if not len(better):
            return
        column = int(better[0])
        rows = np.flatnonzero(t[:-1, column] > TOLERANCE)
        if not len(rows):
            raise ValueError("unbounded")
        ratio = t[rows, -1] / t[rows, column]
        ties = rows[ratio <= ratio.min() + TOLERANCE]
        _pivot(t, basis, int(min(ties, key=lambda r: basis[r])), column)


def solve(net: Network, lower: np.ndarray, upper: np.ndarray) -> np.ndarray | None:
    """Fluxes that balance, keep the bounds and have the greatest objective; None where none do.

    Infinite bounds count as ``WIDE``, and an objective that only such a bound holds has no greatest value.
    """
    if np.isnan(lower).any() or np.isnan(upper).any() or (lower > upper).any():
        return None
    free = np.isinf(lower) | np.isinf(upper)
    lower, upper = np.clip(lower, -WIDE, WIDE), np.clip(upper, -WIDE, WIDE)
    balance, n = np.array(net.balance, dtype=float).reshape(-1, len(net.reactions)), len(net.reactions)
    m = len(balance)
    need = -balance @ lower
    sign = np.where(need < 0, -1.0, 1.0)
    # Columns: shifted fluxes, slacks of the upper bounds, artificial ones of the balances, the right side.
    t = np.zeros((m + n + 1, 2 * n + m + 1))
    t[:m, :n], t[:m, 2 * n : 2 * n + m], t[:m, -1] = balance * sign[:, None], np.eye(m), need * sign
    t[m:-1, :n], t[m:-1, n : 2 * n], t[m:-1, -1] = np.eye(n), np.eye(n), upper - lower
    basis = [2 * n + i for i in range(m)] + [n + i for i in range(n)]
    t[-1] = -t[:m].sum(axis=0)
    t[-1, 2 * n : 2 * n + m] = 0
    _climb(t, basis, 2 * n)
    if t[-1, -1] < -1e-7:
        return None
    for row in range(m + n):
        if basis[row] >= 2 * n:
            usable = np.flatnonzero(np.abs(t[row, : 2 * n]) > TOLERANCE)
            if len(usable):
                _pivot(t, basis, row, int(usable[0]))
    t[-1] = 0
    t[-1, net.objective] = -1
    for row, column in enumerate(basis):
        t[-1] -= t[-1, column] * t[row]
    _climb(t, basis, 2 * n)
    shifted = np.zeros(2 * n + m)
    shifted[basis] = t[:-1, -1]
    fluxes = lower + shifted[:n]
    return None if free.any() and abs(fluxes[net.objective]) >= WIDE / 2 else fluxes


def _balanced(net: Network, fluxes: np.ndarray) -> float:
    """The objective's flux; where it drains one metabolite, the sum of what the other reactions make of it, in their order."""
    drained = [row for row in net.balance if row[net.objective]]
    if len(drained) != 1:
        return fluxes[net.objective]
    made = 0.0
    for j, n in enumerate(drained[0]):
        if n and j != net.objective:
            made += n * fluxes[j]
    return made / -drained[0][net.objective]


def balance_cells(rows: DataFrame, nets: dict[str, Network], model: str, uptakes: list[Uptake], biomass: str, dt: float) -> DataFrame:
    """``balance_rows`` where the column ``model`` names each row's network; rows without a known one stay as they are."""
    parts = [balance_rows(rows.where(F.col(model) == name), net, [u for u in uptakes if u.reaction in net.reactions], biomass, dt) for name, net in nets.items()]
    other = rows.where(~F.coalesce(F.col(model).isin(list(nets)), F.lit(False))).drop("growth").withColumn("growth", F.lit(None).cast("double"))
    return reduce(DataFrame.unionByName, parts, other)


def balance_rows(rows: DataFrame, net: Network, uptakes: list[Uptake], biomass: str, dt: float) -> DataFrame:
    """Each row after ``dt``: uptake bounded by Monod kinetics, growth as great as the network allows.

    Adds ``growth`` (null where nothing was solved).  Substrates and biomass change by flux times
    biomass times ``dt`` and never fall below zero.  Null substrates count as zero, null or bare
    biomass does nothing; other columns pass through, and an input column ``growth`` is replaced.
    """
    ship(rows.sparkSession)
    place = {u.reaction: net.reactions.index(u.reaction) for u in uptakes}
    rows = rows.drop("growth")

    def grown(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            amounts = {u: frame[u.substrate].fillna(0.0).to_numpy(dtype=float).copy() for u in uptakes}
            mass = frame[biomass].to_numpy(dtype=float, na_value=np.nan).copy()
            growth = np.full(len(frame), np.nan)
            solved_for: dict[bytes, np.ndarray | None] = {}
            for i in np.flatnonzero(mass > BARE):
                lower, upper = np.array(net.lower), np.array(net.upper)
                for u in uptakes:
                    held = max(amounts[u][i], 0.0)
                    j = place[u.reaction]
                    lower[j] = -u.vmax * held / (u.km + held)
                    upper[j] = max(upper[j], lower[j])
                bounds = lower.tobytes() + upper.tobytes()
                if bounds not in solved_for:  # rows with equal bounds share a program
                    solved_for[bounds] = solve(net, lower, upper)
                fluxes = solved_for[bounds]
                if fluxes is None:
                    continue
                growth[i] = _balanced(net, fluxes)
                for u in uptakes:
                    amounts[u][i] = max(0.0, amounts[u][i] + fluxes[place[u.reaction]] * mass[i] * dt)
                mass[i] = max(0.0, mass[i] + growth[i] * mass[i] * dt)
            solved = ~np.isnan(growth)
            for u in uptakes:
                frame[u.substrate] = frame[u.substrate].where(~solved, amounts[u])
            frame[biomass] = frame[biomass].where(~solved, mass)
            frame["growth"] = pd.Series(growth, index=frame.index).astype("object").where(solved, None)
            yield frame

    return rows.mapInPandas(grown, T.StructType([*rows.schema.fields, T.StructField("growth", T.DoubleType())]))
