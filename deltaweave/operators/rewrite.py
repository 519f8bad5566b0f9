"""Pattern matching and rewriting over node tables.

At most one match per node and rule: the first in an explicit order.  Guards apply after that choice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaweave.functions.draws import Draws
from deltaweave.functions.names import unused
from deltaweave.operators.kinetics import Reaction
from deltaweave.operators.order import running
from deltaweave.runtime import ship


def first_match(candidates: DataFrame, node: list[str], order: list[str]) -> DataFrame:
    """The first candidate of each node."""
    name = unused("first", candidates)
    least = F.min_by(F.struct(*candidates.columns), F.struct(*order)).alias(name)
    return candidates.groupBy(*[F.col(n).alias(f"{name}{i}") for i, n in enumerate(node)]).agg(least).select(f"{name}.*")


def absent(nodes: DataFrame, children: DataFrame, on: list[str]) -> DataFrame:
    """Nodes without such a child."""
    return nodes.join(children.select(*on).distinct(), on, "left_anti")


def multiset_pairs(children: DataFrame, parent: str, order: list[str], one: Column, two: Column, fields: list[str]) -> DataFrame:
    """The first pair of distinct children that match two patterns, for each parent.

    The first child of one pattern pairs with the first of the other that is another child, so only
    the two least candidates of each pattern are needed: one aggregate, and a second one for parents
    whose first child matches both.
    """
    place = F.struct(*order)
    found = F.struct(place.alias("o"), F.struct(*fields).alias("f"))
    group = children.select(F.col(parent).alias("p"), F.coalesce(one, F.lit(False)).alias("one"), F.coalesce(two, F.lit(False)).alias("two"), found.alias("c"))
    firsts = group.groupBy("p").agg(F.min(F.when(F.col("one"), F.col("c"))).alias("x"), F.min(F.when(F.col("two"), F.col("c"))).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    clash = firsts.where("x.o = y.o").select("p", F.col("x.o").alias("same"))
    others = group.join(clash, "p").where("c.o <> same").groupBy("p").agg(F.min(F.when(F.col("one"), F.col("c"))).alias("x2"), F.min(F.when(F.col("two"), F.col("c"))).alias("y2"))
    both = firsts.join(others, "p", "left")
    pair = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.col(a).alias("a"), F.col(b).alias("b")))
    chosen = F.when(F.col("x.o") != F.col("y.o"), pair("x", "y")).otherwise(F.coalesce(pair("x", "y2"), pair("x2", "y")))
    rows = both.select(F.col("p").alias(parent), chosen.alias("pair")).where("pair IS NOT NULL")
    flat = lambda side: F.struct(F.col(f"pair.{side}.o").alias("o"), *[F.col(f"pair.{side}.f.{c}").alias(c) for c in fields]).alias(side)
    return rows.select(parent, F.struct(flat("a"), flat("b")).alias("pair"))


def active(nodes: DataFrame, ancestors: DataFrame, node: str, passive: Column) -> DataFrame:
    """Nodes of which no ancestor is passive; ``ancestors`` has a row per node and ancestor."""
    blocked = ancestors.where(passive).select(node).distinct()
    return nodes.join(blocked, node, "left_anti")


def fire(state: DataFrame, matched: DataFrame, keys: list[str], reactum: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Matched rows are removed and their rewritten forms added."""
    return state.join(matched.select(*keys), keys, "left_anti").unionByName(reactum(matched))


def weighted_pick(choices: DataFrame, weight: str, order: list[str], share: float) -> DataFrame:
    """The first choice, in any order, whose running weight (``cumulative``) reaches ``share`` of the total; no row if there is no weight.

    Running sums are taken within range partitions whose totals are summed first, so no task orders
    all choices.
    """
    total = choices.agg(F.sum(weight).alias("t")).first()["t"] or 0.0
    if total <= 0:
        return choices.limit(0).withColumn("cumulative", F.lit(0.0))
    summed = running(choices, order, weight, "cumulative")
    return summed.where(F.col("cumulative") >= share * total).orderBy(*order).limit(1)


def simulate(replicates: DataFrame, reactions: list[Reaction], species: list[str], interval: float, seed: int = 0, key: str = "replicate") -> DataFrame:
    """Exact stochastic simulation of any reactions, by the direct method, per replicate row.

    ``replicates`` has ``key`` and a column of counts for each of ``species`` (null counts as 0).  A
    reaction's propensity is its rate times the number of ways to take its reactants from the counts;
    the first reaction whose running propensity reaches the draw fires, and the event beyond the
    interval is discarded.  ``events`` counts what fired.  Replicates are independent, so they are
    dealt over tasks; draws depend on the seed and the replicate alone.
    """
    ship(replicates.sparkSession)
    place = {name: i for i, name in enumerate(species)}
    if unknown := {name for r in reactions for name, _ in (*r.reactants, *r.products)} - set(species):
        raise ValueError(f"reactions name unknown species {sorted(unknown)}")
    needs, changes = [], []
    for r in reactions:
        need, change = dict.fromkeys(range(len(species)), 0), [0] * len(species)
        for name, n in r.reactants:
            need[place[name]] += n
            change[place[name]] -= n
        for name, n in r.products:
            change[place[name]] += n
        needs.append([(i, n) for i, n in need.items() if n])
        changes.append(change)
    rates = [r.k for r in reactions]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, *counts in frame[[key, *species]].itertuples(index=False):
                counts = [0 if pd.isna(c) else int(c) for c in counts]
                draws, t, events = Draws(seed, int(name)), 0.0, 0
                while True:
                    weights = [k * math.prod(math.comb(counts[i], n) for i, n in need) for k, need in zip(rates, needs)]
                    total = sum(weights)
                    if total <= 0:
                        break
                    t += -math.log(1.0 - draws.next()) / total
                    if t > interval:
                        break
                    share, reached, last = draws.next() * total, 0.0, 0
                    for j, weight in enumerate(weights):
                        if weight > 0:
                            last, reached = j, reached + weight
                            if reached >= share:
                                break
                    counts = [c + d for c, d in zip(counts, changes[last])]
                    events += 1
                out.append((name, *counts, events))
            yield pd.DataFrame(out, columns=[key, *species, "events"])

    return replicates.mapInPandas(run, ", ".join([f"`{key}` long", *(f"`{n}` long" for n in species), "events long"]))


def gillespie(replicates: DataFrame, rates: dict[str, float], interval: float, seed: int = 0) -> DataFrame:
    """``simulate`` for A -> B (rate ``bind``) and B -> A (rate ``loose``) over ``replicates(replicate, a, b)``."""
    there, back = Reaction((("a", 1),), (("b", 1),), rates["bind"]), Reaction((("b", 1),), (("a", 1),), rates["loose"])
    return simulate(replicates, [there, back], ["a", "b"], interval, seed)
