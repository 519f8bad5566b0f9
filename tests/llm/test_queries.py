"""The registered queries, with production parameters, against SQL and brute force on the smallest tables."""

import glob
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from deltaweave.llm import catalogue, packing, toxicity
from deltaweave.runtime import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}


def rows_of(spark, name):
    found = catalogue.QUERIES[name](spark, SF)
    assert len(set(found.columns)) == len(found.columns)
    return found.collect()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {path.rpartition('/')[2].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    want = con.sql(catalogue.ORACLES[name])
    got = catalogue.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def ids(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in docs.items()}


def test_token_store_query(spark, ids):
    got, at = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(spark, "op3_token_store")}, 0
    for i in sorted(ids):
        assert got.pop(i) == (at, len(ids[i]) + 1, crc([*ids[i], 1]))
        at += len(ids[i]) + 1
    assert not got


def test_packing_query(spark, ids):
    rows = rows_of(spark, "op5_best_fit_packing")
    pieces = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    want = {}
    for i, own in ids.items():
        own = [*own, 0]
        for n, at in enumerate(range(0, len(own), 2048)):
            want[i, n] = (at, len(own[at : at + 2048]), crc(own[at : at + 2048]))
    assert pieces == want and len(rows) == len(want)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    lengths = [n for _, n, _ in want.values()]
    decreasing = packing.best_fit(lengths, sorted(range(len(lengths)), key=lambda x: -lengths[x]), [], [], 2048)
    assert -(-sum(lengths) // 2048) <= len(bins) <= len(decreasing[0])


def test_byte_bpe_query(spark, docs):
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = {}
    for i, t in docs.items():
        found = encoding.encode_ordinary(t)
        want[i] = (len(found), sha(",".join(map(str, found)).encode()), sha(t.encode()))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows_of(spark, "op8_byte_bpe")} == want


def luhn(digits):
    return sum((int(c) * (1 + i % 2)) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(digits))) % 10 == 0


def numbers(text):
    return re.sub("[^0-9]", "", text)


RULES = {
    "op4_secret_scan": [
        ("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m.group()) >= 24),
    ],
    "op9_pii": [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(numbers(m.group())) <= 19 and luhn(numbers(m.group()))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(numbers(m.group())) <= 15),
    ],
}


@pytest.mark.parametrize("name", sorted(RULES))
def test_span_queries(spark, docs, name):
    got = {r["doc_id"]: r.asDict() for r in rows_of(spark, name)}
    assert set(got) == set(docs)
    for i, text in docs.items():
        spans = sorted((m.start(), rank, kind, m.end()) for rank, (kind, pattern, ok) in enumerate(RULES[name]) for m in re.finditer(pattern, text) if ok(m))
        shown = [f"{kind}:{a}:{b}" for a, _, kind, b in spans]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert all(got[i][f"n_{kind}"] == sum(s[2] == kind for s in spans) for kind, _, _ in RULES[name])
        every = [s for s in got[i]["spans"].split(",") if s]
        assert [s for s in every if s.split(":")[0] in {k for k, _, _ in RULES[name]}] == shown
        assert all(0 <= int(a) < int(b) <= len(text) for _, a, b in (s.split(":") for s in every))


def test_toxicity_query(spark, docs):
    """The score of the query is that of the model learnt from the rows it may learn from, computed word by word."""
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    for r in rows_of(spark, "op2_toxicity"):
        words = set(re.findall(r"[^\W_]+", docs[r["doc_id"]].lower()))
        score = model["bias"] + sum(model["weights"].get(f, 0.0) for f in toxicity.features(words))
        assert abs(r["score"] - 1 / (1 + np.exp(-score))) < 1e-9 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
