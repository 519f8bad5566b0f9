"""Laws of the delta algebra and behaviour at the edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaweave.functions import exprs
from deltaweave.operators import delta, divide, flux, graph, grid, kinetics, particles, rewrite
from deltaweave.plans import catalogue


def test_diff_then_apply_gives_the_target(spark):
    a = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 1.0)], "k long, v double")
    b = spark.createDataFrame([(1, 5.0), (2, 9.0), (4, 2.0)], "k long, v double")
    update = delta.diff(a, b, ["k"], "v")
    assert {tuple(r) for r in update.collect()} == {(2, "change", 2.0), (3, "remove", None), (4, "add", 2.0)}
    changed = delta.apply_add(a, update.where("op = 'change'"), ["k"], "v", "delta")
    added = update.where("op = 'add'").select("k", F.col("delta").alias("v"))
    out = delta.apply_add_remove(changed, update.where("op = 'remove'"), added, ["k"])
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in b.collect()}
    assert delta.diff(b, b, ["k"], "v").count() == 0


def test_reconcile_is_the_sum_of_updates(spark):
    u = spark.createDataFrame([(1, 2.0), (1, -2.0), (2, 3.0), (2, 4.0)], "k long, v double")
    assert {tuple(r) for r in delta.reconcile_sum(u, ["k"], "v", "s").collect()} == {(2, 7.0)}


def test_integer_division_keeps_the_total(spark):
    rows = divide.daughters(spark.createDataFrame([(7,), (-7,), (0,), (9,)], "v long"), 3)
    out = rows.withColumn("part", divide.split_int(F.col("v"), 3, F.col("daughter"))).groupBy("v").agg(F.sum("part").alias("s"), F.sort_array(F.collect_list("part")).alias("p"))
    got = {r["v"]: (r["s"], r["p"]) for r in out.collect()}
    assert got == {7: (7, [2, 2, 3]), -7: (-7, [-3, -2, -2]), 0: (0, [0, 0, 0]), 9: (9, [3, 3, 3])}


def test_diffusion_keeps_mass_and_flattens(spark):
    field = spark.createDataFrame([("m", y, x, 9.0 if (y, x) == (1, 1) else 0.0) for y in range(3) for x in range(3)], "mol string, y int, x int, v double")
    out = grid.diffuse(field, 3, 3, 0.1, 1.0)
    values = [r["v"] for r in out.collect()]
    assert len(values) == 9 and abs(sum(values) - 9.0) < 1e-9 and max(values) < 9.0


def test_rk4_is_close_to_the_exact_solution(spark):
    start = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    decay = [kinetics.Reaction((("a", 1),), (("b", 1),), 0.7)]
    last = kinetics.mass_action(start, decay, ["a", "b"], 0.2, 25).where("i = 25").first()
    assert abs(last["a"] - math.exp(-0.7 * 5)) < 1e-5 and abs(last["a"] + last["b"] - 1) < 1e-9


def test_division_by_zero_is_ieee(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0)], "a double, b double")
    got = [r[0] for r in df.select(exprs.divide(F.col("a"), F.col("b"))).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 2.0


def test_gillespie_keeps_totals_and_is_seeded(spark):
    start = spark.createDataFrame([(i, 10, 0) for i in range(8)], "replicate long, a long, b long")
    one, two = (sorted(map(tuple, rewrite.gillespie(start, {"bind": 1.0, "loose": 0.5}, 1.0, seed=3).collect())) for _ in range(2))
    assert one == two and all(r[1] + r[2] == 10 for r in one)


def test_particles_divide_and_stay_inside(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 1.0)], "id long, mass double")
    assert sorted(map(tuple, particles.divide_particles(df, "mass", 2.0, "id").collect())) == [("1_0", 2.0), ("1_1", 2.0), ("2", 1.0)]
    row = df.select((F.col("mass") + particles.clamp(F.col("mass"), 2.0, 3.0)).alias("m")).collect()
    assert [r["m"] for r in row] == [3.0, 2.0]


def test_mass_action_takes_any_stoichiometry(spark):
    start = spark.createDataFrame([(1, 2.0, 1.0, 0.0), (2, 0.5, None, 3.0)], "id long, x double, y double, z double")
    network = [kinetics.Reaction((("x", 2), ("y", 1)), (("z", 3),), 0.4), kinetics.Reaction((("z", 1),), (("y", 1), ("y", 1)), 0.3), kinetics.Reaction((), (("x", 1),), 0.1)]
    euler = {(r["id"], r["i"]): (r["x"], r["y"], r["z"]) for r in kinetics.mass_action(start, network, ["x", "y", "z"], 0.1, 20, "euler").collect()}

    def flow(x, y, z):
        a, b, c = 0.4 * x * x * y, 0.3 * z, 0.1
        return -2 * a + c, -a + 2 * b, 3 * a - b

    for i, state in ((1, (2.0, 1.0, 0.0)), (2, (0.5, 0.0, 3.0))):
        for n in range(21):
            assert all(abs(p - q) < 1e-12 for p, q in zip(euler[i, n], state))
            state = tuple(v + 0.1 * d for v, d in zip(state, flow(*state)))
    fine = {r["id"]: r for r in kinetics.mass_action(start, network, ["x", "y", "z"], 0.001, 2000, "euler").where("i = 2000").collect()}
    rk4 = {r["id"]: r for r in kinetics.mass_action(start, network, ["x", "y", "z"], 0.1, 20).where("i = 20").collect()}
    assert all(abs(rk4[i][c] - fine[i][c]) < 2e-3 for i in (1, 2) for c in "xyz")


def test_simulation_takes_any_reactions(spark):
    start = spark.createDataFrame([(i, 30, 0, None) for i in range(400)], "replicate long, x long, y long, z long")
    pair = [kinetics.Reaction((("x", 2),), (("y", 1),), 0.01)]
    rows = rewrite.simulate(start, pair, ["x", "y", "z"], 1.0, seed=1).collect()
    assert all(r["x"] + 2 * r["y"] == 30 and r["y"] == r["events"] and r["z"] == 0 for r in rows)
    p = [1.0] + [0.0] * 15  # chances of n events by small steps of the master equation
    rate = lambda n: 0.01 * math.comb(30 - 2 * n, 2)
    for _ in range(2000):
        p = [p[n] + (p[n - 1] * rate(n - 1) if n else 0.0) / 2000 - p[n] * rate(n) / 2000 for n in range(16)]
    assert abs(sum(r["events"] for r in rows) / 400 - sum(n * q for n, q in enumerate(p))) < 0.3
    born = rewrite.simulate(start.limit(50), [kinetics.Reaction((), (("z", 2),), 5.0), kinetics.Reaction((("z", 1),), (), 1.0)], ["x", "y", "z"], 3.0).collect()
    assert any(r["z"] for r in born) and all(r["z"] >= 0 and r["x"] == 30 for r in born)


def test_growth_has_the_bits_of_its_mass_balance(spark):
    cells = spark.createDataFrame([(float(n), 1.0) for n in range(1, 51)], "sugar double, biomass double").withColumn("start", F.col("sugar"))
    rows = flux.balance_rows(cells, flux.network(catalogue._NETWORK), [flux.Uptake("sugar", "EX_sugar", 5.0, 6.0)], "biomass", 0.1).collect()
    for r in rows:
        u = 6.0 * r["start"] / (5.0 + r["start"])
        assert r["growth"] == 0.1 * min(u, 1.5) + 0.03 * max(u - 1.5, 0.0)


def test_whole_numbers_above_long_are_divided(spark, tmp_path):
    keys = (0, 92_233, 92_234, 119_999, 276_700)
    spark.createDataFrame([(k, 1 + k % 50) for k in keys], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    out = catalogue.divide_whole(spark, str(tmp_path))
    assert dict(out.dtypes)["share"] == "bigint"
    whole = {k: divmod(k * 10**14 + 1 + k % 50, 3) for k in keys}
    assert {(r["p_partkey"], r["daughter"]): r["share"] for r in out.collect()} == {(k, i): q + (i < rest) for k, (q, rest) in whole.items() for i in range(3)}
    shares = [divide.split_int(F.col("v"), 3, F.lit(i), wide=True).alias(f"s{i}") for i in range(3)]
    wide = spark.createDataFrame([(str(v),) for v in (-3 * 2**63, -(2**63) - 2, 2**63 + 1, 3 * 2**63 - 3)], "v string").select(F.col("v").cast("decimal(38,0)").alias("v"))
    assert all(sum(r[1:]) == int(r["v"]) for r in wide.select("v", *shares).collect())
    with pytest.raises(Exception, match="beyond long"):
        spark.range(1).select(F.lit(str(3 * 2**63)).cast("decimal(38,0)").alias("v")).select(*shares).collect()


def test_shares_above_long_are_whole(spark, tmp_path):
    keys = (0, 276_700, 276_702, 1_199_999, 2**63 - 1)
    spark.createDataFrame([*((k, 1 + k % 50) for k in keys), (None, 3), (7, None)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    out = catalogue.divide_whole(spark, str(tmp_path))
    assert dict(out.dtypes)["share"] == "decimal(38,0)"
    whole = {k: divmod(k * 10**14 + 1 + k % 50, 3) for k in keys}
    want = {(k, i): q + (i < rest) for k, (q, rest) in whole.items() for i in range(3)} | {(k, i): None for k in (None, 7) for i in range(3)}
    assert {(r["p_partkey"], r["daughter"]): None if r["share"] is None else int(r["share"]) for r in out.collect()} == want
    for n in (2, 3, 10):
        shares = [divide.split_int(F.col("v"), n, F.lit(i), wide=divide.WHOLE).alias(f"s{i}") for i in range(n)]
        totals = [sign * v for v in (0, 1, n - 1, 2**63 + 1, n * 2**63 - n, n * 2**63 - 1, n * 2**63 + 1, 10**19 * n - 1, 10**30 + 7, 10**38 - 1) for sign in (1, -1)]
        wide = spark.createDataFrame([(str(v),) for v in totals], "v string").select(F.col("v").cast("decimal(38,0)").alias("v"))
        for v, *got, fits in wide.select("v", *shares, divide.fits_long(F.col("v"), n)).collect():
            q, rest = divmod(abs(int(v)), n)
            want = [(q + (i < rest)) * (1 if v >= 0 else -1) for i in range(n)]
            assert [int(x) for x in got] == want and fits == (min(want) >= -(2**63) and max(want) < 2**63)


def test_bodies_of_large_keys_meet_no_wall(spark, tmp_path):
    keys = [0, 999_998, 999_999, 1_000_000, *range(1_100_000, 1_100_040)]
    spark.createDataFrame([(k, 1) for k in keys], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(map(tuple, catalogue.bodies_fall(spark, str(tmp_path)).collect())) == [(k, -10.0, -8.0, 3.0) for k in keys]


def test_touching_pairs_of_a_crowd_are_all_found(monkeypatch):
    draw = np.random.default_rng(3)
    at = np.concatenate([draw.normal(0, 3, (150, 2)), draw.uniform(-40, 40, (150, 2)), np.full((20, 2), 7.0), [[1e12, -5.0]]])
    r = draw.uniform(0.5, 2.0, len(at))
    want = [(i, j) for i in range(len(at)) for j in range(i + 1, len(at)) if math.hypot(*(at[j] - at[i])) < r[i] + r[j]]
    for most in (1 << 20, 50):
        monkeypatch.setattr(particles, "CANDIDATES", most)
        assert particles.touching(at, r, 4.0) == want
    assert particles.touching(at[:1], r[:1], 4.0) == [] == particles.touching(at[:0], r[:0], 4.0)


def test_edges_that_carry_their_ends_are_divided_in_their_join(spark):
    vertices = spark.createDataFrame([(f"v{n}", n) for n in range(12)], "id string, n int")
    pairs = spark.range(12).select(F.col("id").cast("int").alias("p")).crossJoin(spark.range(12).select(F.col("id").cast("int").alias("q")))
    edges = pairs.select(F.concat(F.lit("v"), "p").alias("a"), F.concat(F.lit("v"), "q").alias("b"), "p", "q")
    of = lambda n: F.when(F.col(n) > 0, F.pmod(n, F.lit(3)))
    _, want = graph.divide_graph(vertices, edges.select("a", "b"), of("n"))
    _, got = graph.divide_graph(vertices, edges, of("n"), ends=(of("p"), of("q")))
    assert sorted(map(tuple, got.select("a", "b", "daughter").collect())) == sorted(map(tuple, want.collect())) and want.count() == 41
    plan = catalogue.graph_divide(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1  # no edge looks its ends up
