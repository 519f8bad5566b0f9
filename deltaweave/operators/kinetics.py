"""Reaction kinetics: ordered Monod folds and mass-action integration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaweave.functions.names import unused
from deltaweave.runtime import ship


@dataclass(frozen=True)
class Monod:
    """Uptake of ``reactant``; ``yields`` says what one unit makes of which product, ``mass`` how much biomass."""

    reactant: str
    km: float
    vmax: float
    mass: float = 0.0
    yields: tuple[tuple[str, float], ...] = ()


def monod(df: DataFrame, reactions: list[Monod], biomass: str, dt: float) -> DataFrame:
    """Reactions run in order against the running substrate columns; a flux never exceeds its substrate."""
    grown, flux_, grown_ = F.lit(0.0), unused("flux", df), unused("grown", df)
    for r in reactions:
        s = F.col(r.reactant)
        flux = F.when(s > 0, F.least(r.vmax * s / (r.km + s) * F.col(biomass) * dt, s)).otherwise(0.0)
        df = df.withColumn(flux_, flux)
        df = df.withColumns({r.reactant: s - F.col(flux_), **{p: F.col(p) + F.col(flux_) * y for p, y in r.yields}})
        df = df.withColumn(grown_, grown + F.col(flux_) * r.mass)
        grown = F.col(grown_)
    return df.withColumn(biomass, F.col(biomass) + grown).drop(flux_, grown_)


# The parameter sets of common models.
PRESETS = {
    "glucose_only": (Monod("glucose", 0.5, 0.2, mass=0.5),),
    "acetate_only": (Monod("acetate", 0.5, 0.1, mass=0.3),),
    "overflow": (Monod("glucose", 0.5, 0.2, mass=0.5), Monod("glucose", 0.5, 0.1, yields=(("acetate", 0.8),))),
    "cross_feeding": (Monod("glucose", 0.5, 0.2, mass=0.5), Monod("glucose", 0.5, 0.1, yields=(("acetate", 0.8),)), Monod("acetate", 0.5, 0.1, mass=0.3)),
}


@dataclass(frozen=True)
class Reaction:
    """``reactants`` become ``products``, both pairs of species and coefficient, at rate constant ``k``."""

    reactants: tuple[tuple[str, int], ...]
    products: tuple[tuple[str, int], ...]
    k: float


def derivatives(reactions: list[Reaction], x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Each species' change per time: every reaction runs at k times the product of its reactants' powers."""
    change = {name: np.zeros_like(v) for name, v in x.items()}
    for r in reactions:
        rate = np.full_like(next(iter(x.values())), r.k)
        for name, n in r.reactants:
            rate = rate * x[name] ** n
        for side, sign in ((r.reactants, -1.0), (r.products, 1.0)):
            for name, n in side:
                change[name] = change[name] + sign * n * rate
    return change


def mass_action(states: DataFrame, reactions: list[Reaction], species: list[str], dt: float, steps: int, method: str = "rk4") -> DataFrame:
    """Every row of ``states`` at the steps 0 to ``steps``, with columns ``i`` and ``t`` added.

    ``species`` are columns of numbers (null counts as 0), any stoichiometry is allowed; ``method`` is
    ``euler`` or ``rk4``.  Other columns are kept.  Rows are independent of each other.
    """
    if method not in ("euler", "rk4"):
        raise ValueError(f"unknown method {method}")
    if unknown := {name for r in reactions for name, _ in (*r.reactants, *r.products)} - set(species):
        raise ValueError(f"reactions name unknown species {sorted(unknown)}")
    ship(states.sparkSession)
    fields = [f"`{f.name}` {'double' if f.name in species else f.dataType.simpleString()}" for f in states.schema]

    def step(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        moved = lambda d, by: {n: x[n] + by * d[n] for n in species}
        one = derivatives(reactions, x)
        if method == "euler":
            return moved(one, dt)
        two = derivatives(reactions, moved(one, dt / 2))
        three = derivatives(reactions, moved(two, dt / 2))
        four = derivatives(reactions, moved(three, dt))
        return moved({n: one[n] + 2 * two[n] + 2 * three[n] + four[n] for n in species}, dt / 6)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = {n: frame[n].fillna(0.0).to_numpy(float) for n in species}
            for i in range(steps + 1):
                yield frame.assign(**x, i=i, t=i * dt)
                x = step(x) if i < steps else x

    return states.select(*[F.col(f.name).cast("double") if f.name in species else F.col(f.name) for f in states.schema]).mapInPandas(run, ", ".join([*fields, "i long", "t double"]))


def integrate(states: DataFrame, reactions: list[Reaction], species: list[str], dt: float, method: str = "rk4") -> DataFrame:
    """Every row of ``states`` one step later, by the given method."""
    return mass_action(states, reactions, species, dt, 1, method).where("i = 1").drop("i", "t")
