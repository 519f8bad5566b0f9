"""Sorts, types, contracts, patterns, supersteps, flux balance, streams and documents."""

import itertools
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deltaweave.functions import registry, sorts
from deltaweave.operators import flux
from deltaweave.plans import assembly, schedule
from deltaweave.sources import documents
from deltaweave.streaming import live


def test_type_expressions():
    assert sorts.parse("a:float|b:map[list[string]]") == sorts.tree(a=sorts.FLOAT, b=sorts.Sort("map", (sorts.Sort("list", (sorts.STRING,)),)))
    assert sorts.parse("array[(2|3),integer]") == sorts.Sort("array", (sorts.INTEGER,), values=(2, 3))
    assert sorts.parse("enum[a,b]").values == ("a", "b")
    assert sorts.parse("set_float") == sorts.Sort("overwrite", (sorts.FLOAT,))
    assert sorts.parse("a:(b:float|c:x)|d:maybe[delta]").branches()["a"].branches() == {"b": sorts.FLOAT, "c": sorts.ANY}
    with pytest.raises(sorts.SortError):
        sorts.parse("list[float")


ATOM = st.sampled_from([sorts.ANY, sorts.BOOL, sorts.INTEGER, sorts.FLOAT, sorts.STRING])
SORT = st.recursive(ATOM, lambda s: st.builds(lambda a: sorts.Sort("list", (a,)), s) | st.dictionaries(st.sampled_from("abc"), s, min_size=1, max_size=3).map(lambda d: sorts.tree(**d)), max_leaves=6)


@settings(max_examples=200, deadline=None)
@given(SORT, SORT)
def test_order_of_sorts(a, b):
    assert sorts.refines(a, a) and sorts.resolve(a, sorts.ANY) == a == sorts.generalize(a, a)
    assert sorts.from_value(json.loads(json.dumps(sorts.as_value(a)))) == a
    try:
        both = sorts.resolve(a, b)
    except sorts.SortError:
        return
    assert sorts.resolve(both, b) == both


@settings(max_examples=100, deadline=None)
@given(SORT)
def test_defaults_are_members(sort):
    assert sorts.check(sort, sorts.default(sort))


def test_inference_and_checks():
    assert sorts.infer({"x": "1.5", "_hidden": 1, "y": [1], "z": {"_type": "delta"}}) == sorts.tree(x=sorts.FLOAT, y=sorts.Sort("list", (sorts.ANY,)), z=sorts.DELTA)
    assert sorts.check(sorts.FLOAT, 1) and not sorts.check(sorts.INTEGER, True) and not sorts.check(sorts.Sort("const", (sorts.FLOAT,)), 1.0)
    assert sorts.at(sorts.parse("a:map[b:integer|c:float]"), ["a", "k", "b"]) == sorts.INTEGER
    assert sorts.promote(sorts.parse("a:float|b:string"), sorts.parse("a:any")) == sorts.parse("a:float")


def test_realize_fills_and_round_trips(spark):
    sort = sorts.parse("a:integer|b:(c:float|d:list[string])|e:array[2,float]")
    rows = spark.createDataFrame([('{"a": 3, "b": {"d": ["x"]}}',), ("{}",), ("not json",), (None,)], "t string")
    got = [r.v.asDict(True) for r in rows.select(sorts.realize(F.col("t"), sort).alias("v")).collect()]
    empty = {"a": 0, "b": {"c": 0.0, "d": []}, "e": [0.0, 0.0]}
    assert got == [{"a": 3, "b": {"c": 0.0, "d": ["x"]}, "e": [0.0, 0.0]}, empty, empty, empty]
    again = rows.select(sorts.realize(F.col("t"), sort).alias("v")).select(sorts.realize(sorts.encode(F.col("v")), sort).alias("v"))
    assert [r.v.asDict(True) for r in again.collect()] == got


def test_types_of_ones_own(spark):
    types = registry.Registry()
    types.register("amount", registry.TypeMethods(sorts.DELTA))
    types.register("capped", registry.TypeMethods(sorts.DELTA, apply=lambda a, b: F.least(a + b, F.lit(10.0))), "amount")
    types.method("amount", "twice", lambda c: c * 2)
    row = spark.range(1).select(
        types.apply("capped", F.lit(8.0), F.lit(5.0)), types.divide("capped", F.lit(9.0), F.lit(0), 2), types.dispatch("capped", "twice", F.lit(3)),
        types.divide("integer", F.lit(-7), F.lit(0), 3), types.divide("integer", F.lit(-7), F.lit(2), 3), types.divide("float", F.lit(7.0), F.lit(0), 3),
        registry.chain_apply(F.array(*map(F.lit, "abc")), F.create_map(F.lit(0), F.lit("z")), F.array(F.lit(1)), F.array(F.lit("d"))),
    ).first()
    assert list(row) == [10.0, 4.5, 6, -3, -2, 7.0, ["z", "c", "d"]]
    with pytest.raises(ValueError):
        types.register("amount", registry.TypeMethods(), "capped")


def test_contracts():
    offered = registry.Contract(sorts.FLOAT, "mass", (("time", "hours"),))
    assert registry.connection_faults(offered, registry.Contract(sorts.INTEGER, "mass")) == []
    assert len(registry.connection_faults(offered, registry.Contract(sorts.STRING, "length", (("time", "days"),)))) == 3


def test_patterns(spark):
    cell = assembly.ion("cell", "Cell")
    pair = assembly.tensor(assembly.Pattern(({"x": assembly.Node("X")},)), assembly.Pattern(({"y": assembly.Node("Y")},)))
    whole = assembly.compose(cell, assembly.compose(assembly.merge(2), pair))
    assert cell.interfaces == (1, 1) and whole.is_ground
    assert [tuple(r) for r in assembly.to_rows(spark, whole).orderBy("path").collect()] == [(0, "/cell", "Cell"), (0, "/cell/x", "X"), (0, "/cell/y", "Y")]
    assert assembly.from_document({"cell": {"_control": "Cell", "x": {"_type": "X"}, "y": {"_type": "Y"}}}) == whole
    with pytest.raises(ValueError):
        assembly.compose(cell, pair)
    with pytest.raises(ValueError):
        assembly.tensor(pair, pair)


def test_changes_of_one_moment(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, v double")
    frame = lambda *r: spark.createDataFrame(list(r), "k string, v double")
    changes = [
        schedule.Change(changed=frame(("a", 1.0), ("b", 5.0), ("d", 1.0))),
        schedule.Change(changed=frame(("a", 1.0)), added=frame(("d", 10.0), ("b", 7.0)), removed=frame(("b", 0.0), ("c", 0.0))),
    ]
    got = schedule.apply_changes(schedule.Store(rows, ("k",), "v"), changes).rows
    assert sorted(map(tuple, got.collect())) == [("a", 3.0), ("b", 7.0), ("d", 11.0)]


def test_clocks_steps_and_layers(spark):
    one = spark.createDataFrame([(1, 1.0)], "k long, v double")
    stores = {n: schedule.Store(one, ("k",), "v", additive=n == "x") for n in ("x", "y", "z", "idle")}
    tick = lambda by: lambda view, dt: {"x": schedule.Change(one.withColumn("v", F.lit(by)))}
    copy = lambda a, b, name: schedule.Step(name, (a,), (b,), lambda view, dt: {b: schedule.Change(view[a].withColumn("v", F.col("v") * 2))})
    engine = schedule.Engine(stores, [schedule.Process("fast", ("x",), tick(1.0)), schedule.Process("slow", ("x",), tick(100.0), 3.0)], [copy("y", "z", "second"), copy("x", "y", "first"), copy("idle", "idle", "never")], every=2)
    assert [[s.name for s in layer] for layer in schedule.layers(engine.steps)] == [["first", "never"], ["second"]]
    got = {n: f.first()["v"] for n, f in engine.run(2.5).items()}
    assert got == {"x": 3.0, "y": 6.0, "z": 12.0, "idle": 1.0}
    assert engine.now == 2.5
    with pytest.raises(KeyError):
        engine.add_process(schedule.Process("lost", ("nowhere",), tick(1.0)))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_linear_programs_against_all_vertices(seed):
    """Small programs: the best of all vertices of the polytope has the same objective."""
    rng = np.random.default_rng(seed)
    m, n = int(rng.integers(1, 3)), int(rng.integers(3, 6))
    balance = rng.integers(-2, 3, (m, n)).astype(float)
    lower = rng.integers(-3, 1, n).astype(float)
    upper = lower + rng.integers(0, 5, n)
    net = flux.Network(tuple(map(str, range(n))), tuple(map(tuple, balance)), tuple(lower), tuple(upper), 0)
    best = None
    rank = np.linalg.matrix_rank(balance)
    for free in itertools.combinations(range(n), rank):
        fixed = [j for j in range(n) if j not in free]
        if rank and np.linalg.matrix_rank(balance[:, free]) < rank:
            continue
        for ends in itertools.product((0, 1), repeat=len(fixed)):
            x = np.zeros(n)
            x[fixed] = [(lower, upper)[e][j] for e, j in zip(ends, fixed)]
            if rank:
                x[list(free)] = np.linalg.lstsq(balance[:, free], -balance[:, fixed] @ x[fixed], rcond=None)[0]
            if np.abs(balance @ x).max() < 1e-7 and (x >= lower - 1e-7).all() and (x <= upper + 1e-7).all():
                best = x[0] if best is None else max(best, x[0])
    got = flux.solve(net, lower, upper)
    assert (got is None) == (best is None)
    if got is not None:
        assert abs(got[0] - best) < 1e-6 and np.abs(balance @ got).max() < 1e-6


def test_rows_without_a_solution_stay(spark):
    document = {"metabolites": [{"id": "s"}], "reactions": [{"id": "EX", "metabolites": {"s": -1}, "lower_bound": 0, "upper_bound": 10}, {"id": "biomass", "metabolites": {"s": -1}, "lower_bound": 1, "upper_bound": 10}]}
    rows = spark.createDataFrame([(1, 4.0, 0.0), (2, 0.0, 1.0), (3, None, None), (4, 8.0, 1.0)], "id long, s double, m double")
    after = flux.balance_rows(rows, flux.network(document), [flux.Uptake("s", "EX", 1.0, 9.0)], "m", 0.1)
    assert sorted(map(tuple, after.collect()), key=lambda r: r[0]) == [(1, 4.0, 0.0, None), (2, 0.0, 1.0, None), (3, None, None, None), (4, pytest.approx(7.2), pytest.approx(1.8), pytest.approx(8.0))]
    assert after.where("id < 0").count() == 0


def test_streams_of_several_batches(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(k, float(i)) for k in range(i + 1)] + [(9, None)], "k long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert sorted(map(tuple, live.drain(live.totals(stream, ["k"], "v"), ["k"]).collect())) == [(0, 3.0, 3), (1, 3.0, 2), (2, 2.0, 1)]


def test_documents(spark, tmp_path):
    document = {"state": {"mass": "1", "cells": {"a": 1}}, "schema": {"mass": "delta", "cells": "map[integer]"}}
    documents.save(spark, document, str(tmp_path / "doc"))
    loaded = documents.load(spark, str(tmp_path / "doc") + "/*.txt")
    assert loaded == document
    assert documents.sort_of(loaded) == sorts.parse("mass:delta|cells:(a:integer)")
    documents.to_csv(spark.range(3), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    empty = spark.range(0)
    assert documents.from_arrow(documents.to_arrow(empty), "id long").count() == 0
