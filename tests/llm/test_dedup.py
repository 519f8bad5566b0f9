"""Dedup operators against brute force, with nulls, empty texts, ties and repeated rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from deltaweave import runtime
from deltaweave.llm import bloom, embedding_dedup, exact_dedup, hot, jaccard_join, substring_dedup
from deltaweave.llm import components as components_
from deltaweave.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=5):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(rng.choice([6, 30, 80, 120]))] for _ in range(6)]
    out = []
    for i in range(260):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 4])):
            words[rng.randrange(len(words))] = "z" + str(rng.randrange(60))
        out.append((i, " ".join(words)))
    return out + [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two"), (905, "\x1cone  \x0btwo")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _key string").repartition(3)


def union(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("least", [64, 0])
def test_components(spark, monkeypatch, least):
    monkeypatch.setattr(hot, "HOT_LEAST", least)
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    pairs += [(2000, 2001 + i) for i in range(300)] + [(2150, 3000 + i) for i in range(100)] + [(5000, 5000)]  # hubs and a loop
    ids = {x for p in pairs for x in p}
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == union(ids, pairs)
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("finish", [0, 200, 100_000])
def test_components_finish_small_graphs_in_one_task(spark, monkeypatch, finish):
    """Levels alone, levels and one task, one task alone: the same components, from ever fewer tables."""
    monkeypatch.setattr(components_, "FINISH", finish)
    staged, stage = [], runtime.stage
    monkeypatch.setattr(components_, "stage", lambda df, name: staged.append(name) or stage(df, name))
    rng = random.Random(2)
    pairs = [(rng.randrange(-150, 150), rng.randrange(-150, 150)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(150)]
    pairs += [(2000, 2001 + i) for i in range(200)] + [(2150, 3000 + i) for i in range(50)] + [(5000, 5000), (None, 7), (2**62, -(2**62))]
    ends = [p for p in pairs if None not in p]
    ids = {x for p in ends for x in p}
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == union(ids, ends)
    assert ("finished" in staged) == (finish > 0) and ("parent1" in staged) == (finish < 100_000)
    if finish == 100_000:
        assert staged == ["edges", "nodes", "finished"]


def test_bloom_filter_reaches_the_driver_once(spark, monkeypatch):
    """Every key is found, few others are, and the driver gets no more than the filter's bytes."""
    got, iterate = [], DataFrame.toLocalIterator
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda self, *a, **b: (got.append(len(r["flags"])) or r for r in iterate(self, *a, **b)))
    keys = spark.range(-3000, 3000, 1, 5).select((F.col("id") * 7919).alias("id"))
    flags, bits = bloom.build(keys, 6000, lambda batch: np.asarray(batch.column(0), np.int64))
    assert 8 * sum(got) == 8 * len(flags) == bits
    flags = np.frombuffer(flags, np.uint8)
    own = np.arange(-3000, 3000) * 7919
    assert bloom.holds(flags, bits, own).all()
    assert bloom.holds(flags, bits, own + 1).mean() < 0.1


def test_exact_dedup(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "c"), (None, "a")] + [(100 + i, "hot") for i in range(200)]
    for capacity, least in ((512, 64), (2, 10_000)):
        got = exact_dedup.exact_dedup(frame(spark, rows), capacity=capacity, least=least).collect()
        assert len(got) == len(rows)
        for r in got:
            same = [k for k, t in rows if hashlib.sha256((t or "").encode()).hexdigest() == r["text_sha256"]]
            keep = max((k for k in same if k is not None), default=None)
            assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(same), r["doc_id"] == keep)
    assert exact_dedup.exact_dedup(frame(spark, rows).limit(0)).count() == 0


def test_misra_gries_finds_frequent_items():
    items = [b"x"] * 40 + [bytes([i]) for i in range(100)]
    random.Random(0).shuffle(items)
    assert b"x" in exact_dedup.misra_gries(iter(items), 4)


@pytest.mark.parametrize("width, percent, region, least", [(3, 90, 2000, 64), (5, 80, 6, 0)])
def test_jaccard_join(spark, monkeypatch, width, percent, region, least):
    monkeypatch.setattr(jaccard_join, "REGION", region)
    monkeypatch.setattr(hot, "HOT_LEAST", least)
    rows = texts()
    sets = {}
    for i, t in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m.group(0).lower(), t or ""))
        sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = union(sets, pairs)
    got = {r["id"]: (r["n"], r["component"]) for r in jaccard_join.jaccard_classes(frame(spark, rows), width=width, percent=percent).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_region_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(1)
    n = 300
    sign = rng.poisson(6, (8, 128))[rng.integers(0, 8, n)] + rng.poisson(0.4, (n, 128))
    size, label = sign.sum(axis=1), rng.integers(0, 50, n)
    full = [(i, j) for i in range(n) for j in range(i + 1, n) if jaccard_join.may_reach(size[i], size[j], np.abs(sign[i] - sign[j]).sum(), 90)]
    first = {}
    same = [(first.setdefault(x, i), i) for i, x in enumerate(label.tolist())]
    found = jaccard_join.region_forest(label, size, list(sign), 90)
    assert union(range(n), found + same) == union(range(n), full + same)


def test_substring_dedup(spark):
    rng = random.Random(0)
    word = lambda: rng.choice("ab") if rng.random() < 0.9 else rng.choice("cde")
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 5, 19, 20, 21, 60, 200])))) for i in range(120)] + [(500, "x " * 300), (501, None), (502, "  a\x1cb \x0b c")]
    docs, first = [(i, WORD.findall(t or "")) for i, t in rows], {}
    for i, w in docs:
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, s))
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    for i, w in docs:
        gone = {k for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] != (i, s) for k in range(s, s + 20)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert got[i] == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_embedding_dedup(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((12, 32))
    rows = [(i, (base[i % 12] + 0.02 * rng.standard_normal(32)).tolist(), int(i % 12 % 3)) for i in range(240)]
    odd = [(901, None, 1), (902, [0.0] * 32, 1), (903, [float("nan")] * 32, 1), (904, base[0].tolist(), None), (905, [1.0], 1), (906, [], 1), (907, [2.0], 1), (907, [2.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"), block=16).collect()}
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (v @ v.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(v), dtype=bool)
    want = union(range(len(rows)), [tuple(p) for p in np.argwhere(near).tolist()])
    found = sum(got[i][0] for i in range(len(rows)))
    assert found >= 0.9 * near.sum() and all(got[i][0] <= near[i].sum() for i in range(len(rows)))
    assert all(got[i][1] == want[i] for i in range(len(rows)))
    assert [got[i] for i in (901, 902, 903, 904, 906)] == [(0, i, True) for i in (901, 902, 903, 904, 906)]
    assert got[905] == (2, 905, True) and got[907][:2] == (2, 905)


def test_embedding_dedup_is_exact_in_a_crowded_label(spark):
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    crowd = unit(np.sqrt(0.95) * unit(rng.standard_normal(64)) + np.sqrt(0.05) * unit(rng.standard_normal((1500, 64))))  # about 0.95 alike
    side = unit(rng.standard_normal((150, 64)))
    side = unit(side - (side * crowd[:150]).sum(axis=1, keepdims=True) * crowd[:150])
    pairs = 0.982 * crowd[:150] + np.sqrt(1 - 0.982**2) * side
    v = np.concatenate([crowd, pairs, unit(rng.standard_normal((900, 64)))])
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    near = (v @ v.T >= 0.98) & ~np.eye(len(v), dtype=bool)
    want = union(range(len(v)), [tuple(p) for p in np.argwhere(near).tolist()])
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    for sizes in ({}, {"region": 100, "block": 64}):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(frame_, **sizes).collect()}
        assert got == {i: (int(near[i].sum()), want[i]) for i in want}


def test_embedding_dedup_ships_its_blocks_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((500, 16))
    v[250:] = v[:250] + 0.03 * rng.standard_normal((250, 16))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    label = np.arange(500) % 250 % 2
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(500, dtype=bool)
    want = union(range(500), [tuple(p) for p in np.argwhere(near).tolist()])
    frame_ = spark.createDataFrame([(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, label))], "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embedding_dedup, "TILE", 7)
    monkeypatch.setattr(embedding_dedup, "ROUND_LEAST", 1000)
    staged = []
    keep = embedding_dedup.stage
    monkeypatch.setattr(embedding_dedup, "stage", lambda df, name: staged.append((name, df.schema)) or keep(df, name))
    for sizes in ({"region": 60, "block": 40, "most": 700}, {"region": 1000, "block": 16, "most": 600, "passes": 3}):
        staged.clear()
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(frame_, **sizes).collect()}
        assert got == {i: (int(near[i].sum()), want[i]) for i in want}
        names = [n for n, _ in staged]
        assert names.count("compared") >= 3 and names.count("window_links") == -(-sizes.get("passes", 10) // 4)
        assert {s["vector"].dataType.simpleString() for _, s in staged if "vector" in s.names} == {"array<float>"}


def test_staged_tables_leave_no_shuffle_files(spark):
    live = lambda: len(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split("shuffle_"))
    before = live()
    table_ = runtime.stage(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count(), "t")
    assert live() <= before and table_.count() == 10
