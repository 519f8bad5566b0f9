"""Topologies, composites, caches, runs, units, particles, orders and names."""

import math
from types import SimpleNamespace as Names

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaweave import runtime
from deltaweave.functions import exprs, registry, sorts, units
from deltaweave.operators import delta, divide, flux, grid, kinetics, order, particles, rewrite, trace
from deltaweave.plans import composites, runs, schedule
from deltaweave.plans.schedule import Change, Engine, Process, Step, Store
from deltaweave.sources import documents


def store(spark, *rows, additive=True):
    return Store(spark.createDataFrame(list(rows), "k string, v double"), ("k",), "v", additive)


def values_of(frame):
    return {r["k"]: r["v"] for r in frame.collect()}


def test_wires():
    at = ("cells", "n", "grow")
    assert composites.resolve_wire(["x"], at) == ("cells", "n", "x") and composites.resolve_wire([], at) == ("cells", "n")
    assert composites.resolve_wire(["..", "..", "pool", 3, 2.0], at) == ("pool", "3", "2") and composites.resolve_wire(["%", "mass"], at) == (*at, "mass")
    assert composites.resolve_wires({"s": {"glucose": ["..", "g"], "acetate": ["a"]}, "m": ["%"]}, at) == {"s.glucose": ("cells", "g"), "s.acetate": ("cells", "n", "a"), "m": at}


def test_processes_found_in_a_state_come_and_go(spark):
    factory = composites.Factory()
    factory.register("Add", lambda name, config, inputs, outputs: Process(name, tuple(inputs.values()), lambda view, dt: {outputs["to"]: Change(view[inputs["from"]].withColumn("v", F.lit(config["by"] * dt)))}))
    link = lambda by, data="Add", protocol="local": {"_type": "process", "address": {"protocol": protocol, "data": data}, "config": {"by": by}, "inputs": {"from": ["x"]}, "outputs": {"to": ["x"]}}
    state = {"one": link(1.0), "watch": {"_type": "step", "address": "local:RAMEmitter"}}
    engine = composites.engine_of({"x": store(spark, ("a", 0.0))}, state, factory)
    engine.run(2.0)
    assert composites.refresh(engine, {"one": link(1.0), "two": link(10.0)}, factory) == (["two"], [])
    engine.run(1.0)
    assert composites.refresh(engine, {"two": link(10.0)}, factory) == ([], ["one"])
    assert values_of(engine.run(1.0)["x"]) == {"a": 23.0}
    assert "Add" in factory and factory.names() == ["Add"] and factory.missing({"z": link(1.0, "Other")}) == ["Other"]
    for bad, error in ((link(1.0, "Other"), KeyError), (link(1.0, protocol="telegraph"), ValueError)):
        with pytest.raises(error):
            composites.discover({"z": bad}, factory)
    with pytest.raises(KeyError):
        composites.engine_of({}, {"z": link(1.0, "Other")}, factory)


def test_composites_pass_on_changes_and_conduits(spark):
    inner = Engine({"x": store(spark)}, [Process("p", ("x",), lambda v, dt: {"x": Change(v["x"].withColumn("v", F.lit(1.0))), "out": Change(v["x"].select("k", (F.col("v") * 100).alias("v")))})])
    outer = Engine({"a": store(spark, ("k", 5.0)), "log": store(spark, ("k", 0.0))}, [composites.composite("c", inner, {"a": "x"}, {"x": "a", "out": "log"}, 2.0)])
    got = outer.run(4.0)
    assert values_of(got["a"]) == {"k": 9.0} and values_of(got["log"]) == {"k": 500.0 + 600 + 700 + 800}


def test_steps_by_path_and_priority(spark):
    seen = []
    step = lambda name, reads, priority=0.0: Step(name, reads, (), lambda view, dt: seen.append(name) or {}, priority)
    stores = {n: store(spark, ("k", 1.0)) for n in ("cells", "cells/a", "cellar", "pool")}
    engine = Engine(stores, [], [step("low", ("cells/a",)), step("high", ("cells",), 2.0), step("never", ("cellar",)), step("pool", ("pool",))])
    engine.settle({"cells"})
    assert seen == ["high", "low"]
    engine.extend("pool", {"note": F.lit("x"), "v": F.lit(9.0)})
    assert engine.stores["pool"].rows.first().asDict() == {"k": "k", "v": 1.0, "note": "x"}
    engine.add_store("more", store(spark))
    with pytest.raises(KeyError):
        engine.add_store("more", store(spark))
    with pytest.raises(ValueError):
        Engine({"x": store(spark)}, [Process("p", ("x",), lambda v, dt: {}, lambda v: 0.0)]).run(1.0)
    with pytest.raises(RuntimeError):
        Engine({"x": store(spark, ("a", 1.0), ("b", 1.0))}, most_rows=1).cut()


def test_cached_steps(spark, tmp_path):
    made = []

    def build(version, forced=frozenset()):
        step = lambda name, reads, writes: Step(name, reads, writes, lambda view, dt: made.append(name) or {writes[0]: Change(view[reads[0]].withColumn("v", F.col("v") * 2))}, cached=True)
        stores = {"x": store(spark, ("a", 3.0))} | {n: store(spark, ("a", 0.0), additive=False) for n in ("y", "z")}
        engine = Engine(stores, [], [step("one", ("x",), ("y",)), step("two", ("y",), ("z",))], cache=schedule.StepCache(str(tmp_path), version, forced))
        engine.settle({"x"})
        return values_of(engine.stores["z"].rows)

    assert build("v1") == {"a": 12.0} and made == ["one", "two"]
    assert build("v1") == {"a": 12.0} and made == ["one", "two"]
    assert build("v1", frozenset({"one"})) == {"a": 12.0} and made == ["one", "two"] * 2
    assert build("v1", frozenset({"two"})) == {"a": 12.0} and made == ["one", "two"] * 2 + ["two"]
    assert build("v2") == {"a": 12.0} and made[-2:] == ["one", "two"]


def test_runs(spark):
    grow = Process("grow", ("x",), lambda v, dt: {"x": Change(v["x"].withColumn("v", F.col("v") * dt))})
    engine = lambda: Engine({"x": store(spark, ("a", 1.0))}, [grow])
    assert values_of(runs.invoke(engine(), ["x"], 3.0)["x"]) == {"a": 8.0}
    told = runs.invoke_trace(engine(), "x", 2.0, 1.0)
    assert [(r["i"], r["time"], r["v"]) for r in told.rows.orderBy("i").collect()] == [(0, 0.0, 1.0), (1, 1.0, 2.0), (2, 2.0, 4.0)]
    assert len(told) == 3 and not told.is_empty() and [r["value"] for r in told.series("v").orderBy("i").collect()] == [1.0, 2.0, 4.0]
    assert [r["time"] for r in told.times().collect()] == [0.0, 1.0, 2.0]
    driven = Engine({"x": store(spark), "y": store(spark, ("a", 0.0))}, [], [Step("s", ("x",), ("y",), lambda v, dt: {"y": Change(v["x"])})])
    given = trace.Trace(told.rows, "in", sorts.FLOAT)
    assert [r["v"] for r in runs.invoke_driven(driven, "x", given, "y", sorts.FLOAT).rows.orderBy("i").collect()] == [1.0, 3.0, 7.0]
    with pytest.raises(TypeError):
        runs.invoke_driven(driven, "x", trace.Trace(told.rows, "in", sorts.STRING), "y", sorts.FLOAT)
    assert runs.run_process(store(spark, ("a", 1.0)).rows, lambda rows, dt: rows, 0.0).rows.count() == 1


def test_traces_with_gaps_and_headers(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, 5.0), (1, 2, None), (1, 3, 7.0), (1, 4, 7.0)], "t long, o long, v double")
    told = trace.trace_of(rows, ["t"], ["o"], "v").orderBy("o").collect()
    assert [r["delta"] for r in told] == [None, 5.0, None, 2.0, None] and [r["i"] for r in told] == list(range(5))
    frames = spark.createDataFrame([(0.0, '{"a": 1}'), (1.0, None)], "time double, payload string")
    streams = documents.trace_to_arrow(frames.coalesce(1), "run", sorts.parse("a:integer"))
    back = documents.trace_from_arrow(streams, sorts.parse("a:integer")).orderBy("time").collect()
    assert [(r["name"], r["time"], r["payload"]) for r in back] == [("run", 0.0, '{"a": 1}'), ("run", 1.0, "null")]
    with pytest.raises(Exception, match="refine"):
        documents.trace_from_arrow(streams, sorts.parse("a:string")).collect()


def test_units():
    length, time, mass, amount = (units.Dimension.of(**{n: 1}) for n in ("length", "time", "mass", "amount"))
    assert length * time / time == length and length**2 / length == length and (length / length) == units.Dimension()
    km, m, hour = units.Unit(length, 1000.0), units.Unit(length), units.Unit(time, 3600.0)
    assert units.conversion(km, m) == units.Conversion(1000.0) and units.conversion(m, m) == units.Conversion()
    assert units.conversion(km / hour, m / units.Unit(time)).scale == pytest.approx(1 / 3.6)
    kelvin, celsius = units.Unit(units.Dimension.of(heat=1)), units.Unit(units.Dimension.of(heat=1), 1.0, 273.15)
    assert units.conversion(celsius, kelvin) == units.Conversion(1.0, 273.15) and units.conversion(kelvin, celsius) == units.Conversion(1.0, -273.15)
    assert units.conversion(m, units.Unit(mass)) is None
    molar = units.Bridge(mass, amount, column="w", divides=True, both_ways=True)
    there, back = units.conversion(units.Unit(mass), units.Unit(amount), [molar]), units.conversion(units.Unit(amount), units.Unit(mass), [molar])
    assert (there.divides, back.divides, there.column) == (True, False, "w")
    fixed = units.Bridge(length, time, factor=4.0, both_ways=True)
    assert units.conversion(units.Unit(time), units.Unit(length), [fixed]).scale == 0.25
    assert units.conversion(units.Unit(amount), units.Unit(mass), [units.Bridge(mass, amount, column="w")]) is None


def test_strict_expressions(spark):
    row = spark.range(1).select(F.lit(2.5).alias("x"), F.lit(3).alias("n"), F.lit(True).alias("t"), F.lit("a").alias("s"), F.parse_json(F.lit('{"a": {"b": 7}}')).alias("j"))
    c = F.col
    got = row.select(exprs.compare("<", c("x"), c("n")), exprs.logic("and", c("t"), ~c("t")), exprs.logic("not", c("t")), exprs.negate(c("n")), exprs.plus_plus(c("s"), F.lit("b")), exprs.choose(c("t"), c("n")), exprs.choose(~c("t"), c("n")), exprs.equal(F.lit(None), F.lit(None)), exprs.field(c("j"), "a.b", "int"), exprs.field(c("j"), "a.c", "int")).first()
    assert list(got) == [True, False, False, -3, "ab", 3, None, True, 7, None]
    for wrong in (exprs.compare("<", c("s"), c("n")), exprs.logic("and", c("n"), c("t")), exprs.negate(c("s")), exprs.choose(c("n"), c("t")), exprs.logic("or", F.lit(None).cast("boolean"), c("t"))):
        with pytest.raises(Exception, match="(needs|null)"):
            row.select(wrong).collect()
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in (("a", 1), ("b", 2), ("a", 3))])
    assert row.select(exprs.map_comprehension(pairs, lambda p: p["k"], lambda p: p["v"] * 10, lambda p: p["v"] != 2)).first()[0] == {"a": 30}
    exprs.define(spark, "twice", "x DOUBLE", "x * 2", "DOUBLE")
    assert row.select(exprs.record(a=F.expr("twice(x)"))["a"]).first()[0] == 5.0


def test_columns_of_nested_sorts(spark):
    row = spark.range(1).select(
        registry.apply_column(sorts.parse("array[2|2,float]"), F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))), F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))).alias("grid"),
        registry.apply_column(sorts.parse("tuple[integer,string]"), F.struct(F.lit(1).alias("_1"), F.lit("a").alias("_2")), F.struct(F.lit(2).alias("_1"), F.lit(None).cast("string").alias("_2"))).alias("pair"),
        registry.apply_column(sorts.parse("maybe[float]"), F.lit(None).cast("double"), F.lit(2.0)).alias("maybe"),
        registry.apply_entries(sorts.parse("map[float]"), F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(2.0)), F.create_map(F.lit("c"), F.lit(5.0)), F.array(F.lit("a")), F.create_map(F.lit("c"), F.lit(1.0))).alias("map"),
        registry.apply_items(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2)), F.array(F.lit(9)), F.lit(False)).alias("list"),
        registry.divide_column(sorts.parse("map[integer]"), F.create_map(F.lit("a"), F.lit(7)), F.lit(0), 2).alias("part"),
    ).first()
    assert row["grid"] == [[2.0, 2.0], [3.0, 5.0]] and tuple(row["pair"]) == (3, "a") and row["maybe"] == 2.0 and row["map"] == {"b": 2.0, "c": 6.0} and row["list"] == [1, 9] and row["part"] == {"a": 4}
    big = spark.createDataFrame([(2**62 + 511,), (2**60 + 77,), (-(2**62) - 511,)], "v long")
    for n in (2, 3):
        parts = divide.daughters(big, n).groupBy("v").agg(F.sum(divide.split_int(F.col("v"), n, F.col("daughter"))).alias("s"))
        assert all(r["s"] == r["v"] for r in parts.collect())


def test_running_sums_over_any_order(spark):
    rng = np.random.default_rng(1)
    rows = [(f"k{i:03}", float(w)) for i, w in enumerate(rng.random(300))]
    table = spark.createDataFrame(rows, "k string, w double").repartition(7)
    sums = np.cumsum([w for _, w in rows])
    got = {r["k"]: (r["c"], r["place"]) for r in order.running(order.running(table, ["k"], "w", "c"), ["k"], None, "place").collect()}
    assert all(abs(got[k][0] - s) < 1e-9 and got[k][1] == i for i, ((k, _), s) in enumerate(zip(rows, sums)))
    picked = rewrite.weighted_pick(table, "w", ["k"], 0.5).collect()
    assert [r["k"] for r in picked] == [rows[int(np.argmax(sums >= 0.5 * sums[-1]))][0]]
    assert rewrite.weighted_pick(table.withColumn("w", F.lit(0.0)), "w", ["k"], 0.5).count() == 0


def test_names_of_ones_own_stay(spark):
    clash = ["_change", "_new", "_rank", "change", "new", "first", "flux", "grown", "daughter", "total", "part", "base"]
    state = spark.createDataFrame([(1, 5.0, *clash), (2, 7.0, *clash)], ["k", "v", *clash])
    update = spark.createDataFrame([(1, 2.0)], "k long, u double")
    for out, want in ((delta.apply_add(state, update, ["k"], "v", "u"), {1: 7.0, 2: 7.0}), (delta.apply_replace(state, update, ["k"], "v", "u"), {1: 2.0, 2: 7.0})):
        assert {r["k"]: r["v"] for r in out.collect()} == want and set(out.columns) == set(state.columns) and out.first()["_change"] == "_change"
    firsts = rewrite.first_match(state, ["first"], ["k"])
    assert firsts.columns == state.columns and [r["k"] for r in firsts.collect()] == [1]
    grown = kinetics.monod(state.withColumn("s", F.lit(1.0)), [kinetics.Monod("s", 1.0, 1.0)], "v", 1.0)
    assert grown.first()["flux"] == "flux" and set(grown.columns) == {*state.columns, "s"}
    split = divide.divide_rows(state, F.col("k") == 1, "k", ["v"])
    assert sorted((r["k"], r["v"], r["daughter"]) for r in split.collect()) == [("1_0", 2.5, "daughter"), ("1_1", 2.5, "daughter"), ("2", 7.0, "daughter")]
    assert order.running(state, ["k"], "v", "sum").columns == [*state.columns, "sum"]


def test_boundaries(spark):
    field = spark.createDataFrame([("m", y, x, float(3 * y + x)) for y in range(3) for x in range(3)], "mol string, y int, x int, v double")
    near = {(r["y"], r["x"]): r for r in grid.with_neighbors(field, 3, 3, {"w": ("dirichlet", 50.0), "e": "outflow", "n": "periodic"}).collect()}
    assert near[0, 0]["w"] == 50.0 and near[0, 2]["e"] == 2.0 and near[0, 1]["n"] == 7.0 and near[2, 1]["s"] == 7.0 and near[1, 1]["w"] == 3.0
    for wrong in ("absorbing", {"w": "absorbing"}, {"up": "neumann"}):
        with pytest.raises(ValueError):
            grid.with_neighbors(field, 3, 3, wrong)
    fine = grid.diffuse(field, 3, 3, 3.0, 1.0)
    assert grid.substeps(1.0, 1.0, 1.0, 3.0) == 12 and abs(fine.agg(F.sum("v")).first()[0] - 36.0) < 1e-9
    assert sorted(map(tuple, grid.rebuild(grid.flatten(field, 3), 3).collect())) == sorted(map(tuple, field.collect()))


def test_discs_keep_momentum_and_energy(spark):
    rng = np.random.default_rng(2)
    rows = [(w, i, *map(float, rng.uniform(30, 170, 2)), *map(float, rng.uniform(-20, 20, 2)), 1.0, None) for w in (1, 2) for i in range(25)]
    table = spark.createDataFrame(rows, "world long, id long, x double, y double, vx double, vy double, mass double, radius double")
    moved = {(r["world"], r["id"]): r for r in particles.collide(table, (200.0, 200.0), 0.5, substeps=50).collect()}
    for w in (1, 2):
        before = sum(r[4] ** 2 + r[5] ** 2 for r in rows if r[0] == w)
        after = sum((r[4] + moved[w, r[1]]["dvx"]) ** 2 + (r[5] + moved[w, r[1]]["dvy"]) ** 2 for r in rows if r[0] == w)
        assert abs(before - after) < 1e-6 * before
    assert any(abs(m["dvx"]) > 1e-9 for m in moved.values()) and all(m["dradius"] == 0 for m in moved.values())
    pair = spark.createDataFrame([(1, 1, 50.0, 50.0, 10.0, 0.0, 1.0, None), (1, 2, 60.0, 50.0, 0.0, 0.0, 1.0, None)], table.schema)
    after = {r["id"]: r for r in particles.collide(pair, (200.0, 200.0), 0.5, substeps=50).collect()}
    assert after[1]["dvx"] == pytest.approx(-10.0) and after[2]["dvx"] == pytest.approx(10.0)
    slowed = particles.collide(pair.where("id = 1"), (200.0, 200.0), 1.0, damping=0.5, substeps=8).first()
    assert slowed["dvx"] == pytest.approx(-5.0)
    rng = np.random.default_rng(5)
    at, r = rng.uniform(0, 50, (80, 2)), np.full(80, 2.0)
    assert particles.touching(at, r, 4.0) == [(i, j) for i in range(80) for j in range(i + 1, 80) if math.hypot(*(at[j] - at[i])) < 4.0]


def test_particles_enter_and_leave(spark):
    for rate, many in ((1e9, 4), (0.0, 0)):
        new = particles.born(spark, ["left", "right", "bottom", "top"], (100.0, 60.0), 2.0, rate, 1.0, (1.0, 3.0), 7).collect()
        assert len(new) == many and all(2.0 - 1e-9 <= r["x"] <= 100 and 0 <= r["y"] <= 60 and 1 <= r["mass"] <= 3 for r in new if r["side"] != "bottom" and r["side"] != "top")
    side = {r["side"]: r for r in particles.born(spark, ["left", "right", "bottom", "top"], (100.0, 60.0), 2.0, 1e9, 1.0, (1.0, 3.0), 7).collect()}
    assert side["left"]["x"] == 2.0 and side["right"]["x"] == 98.0 and side["bottom"]["y"] == 2.0 and side["top"]["y"] == 58.0
    births = sum(particles.born(spark, ["left"], (1.0, 1.0), 0.1, 0.5, 1.0, (1.0, 1.0), 7, step).count() for step in range(40))
    assert 5 < births < 30  # 40 chances of 0.39
    rows = spark.createDataFrame([(1, 0.5, 30.0), (2, 99.9, 59.0), (3, 50.0, None)], "id long, x double, y double")
    assert sorted((r["id"], r["x"], r["y"]) for r in particles.manage(rows, (100.0, 60.0), 2.0, ("left",)).collect()) == [(2, 98.0, 58.0), (3, 50.0, None)]
    with pytest.raises(ValueError):
        particles.manage(rows, (1.0, 1.0), 0.1, ("north",))
    walked = [sorted((r["id"], r["x"]) for r in particles.walk(rows.repartition(n), 0.5, 1.0, seed=1).collect()) for n in (1, 5)]
    assert walked[0] == walked[1]
    capped = particles.divide_particles(spark.createDataFrame([(i, 4.0) for i in range(5)], "id long, mass double"), "mass", 2.0, "id", most=7)
    assert sorted(r["id"] for r in capped.collect()) == ["0_0", "0_1", "1_0", "1_1", "2_0", "3_0", "4_0"]
    one = spark.range(1).select(particles.particle(F.lit(1.0), F.lit(2.0), F.lit(3.0), ["g"], F.lit("a")).alias("p")).first()["p"]
    assert len(one["id"]) == 8 and one["radius"] == pytest.approx(math.sqrt(3 / (0.015 * math.pi))) and one["exchange"] == {"g": 0.0}


def test_networks_with_infinite_bounds_and_by_cell(spark):
    document = lambda upper: {"metabolites": [{"id": "s"}], "reactions": [{"id": "EX", "metabolites": {"s": -1}, "lower_bound": 0, "upper_bound": float("inf")}, {"id": "biomass", "metabolites": {"s": -1}, "lower_bound": 0, "upper_bound": upper}]}
    net = flux.network(document(float("inf")))
    assert flux.solve(net, np.array([-3.0, 0.0]), np.array(net.upper))[1] == pytest.approx(3.0)
    assert flux.solve(net, np.array([-np.inf, 0.0]), np.array(net.upper)) is None
    rows = spark.createDataFrame([(1, "a", 8.0, 1.0), (2, "b", 8.0, 1.0), (3, "z", 8.0, 1.0), (4, None, 8.0, 1.0)], "id long, model string, s double, m double")
    nets = {"a": flux.network(document(10.0)), "b": flux.network(document(2.0))}
    got = {r["id"]: r["growth"] for r in flux.balance_cells(rows, nets, "model", [flux.Uptake("s", "EX", 1.0, 9.0)], "m", 0.1).collect()}
    assert got == {1: pytest.approx(8.0), 2: pytest.approx(2.0), 3: None, 4: None}


def test_one_step_of_an_integrator(spark):
    start = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    got = kinetics.integrate(start, [kinetics.Reaction((("a", 1),), (("b", 1),), 0.7)], ["a", "b"], 0.2, "euler").first()
    assert (got["a"], got["b"]) == (pytest.approx(0.86), pytest.approx(0.14))


def test_staged_tables_give_back_the_drivers_memory(spark, monkeypatch):
    asked, grown = [], Names(totalMemory=lambda: 600, maxMemory=lambda: 1000)
    beans = Names(invoke=lambda bean, name, *_: asked.append(name))
    lang = Names(Runtime=Names(getRuntime=lambda: grown), System=Names(gc=lambda: asked.append("gc")), management=Names(ManagementFactory=Names(getPlatformMBeanServer=lambda: beans)))
    jvm = Names(java=Names(lang=lang), javax=Names(management=Names(ObjectName=str)))
    monkeypatch.setattr(runtime, "_tidied", float("-inf"))
    for _ in range(3):  # one after the other: only the first asks
        runtime.tidy(Names(sparkContext=Names(_jvm=jvm)))
    assert asked == ["gc", "systemTrimNativeHeap"]
    monkeypatch.setattr(runtime, "_tidied", float("-inf"))
    assert runtime.stage(spark.range(3), "numbers").count() == 3 and runtime._tidied > 0  # and this JVM takes the calls
