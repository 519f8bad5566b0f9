"""Toxicity classifier with counterfactual regularisation.

Training.  A bounded sample of labelled documents (``MAX_TRAIN``, by hash of their key) is read.
Features are the presence of words and of word beginnings; those whose presence differs most
between the labels are kept (``MAX_FEATURES``).  A logistic regression is fitted to them.  For every
sentence of the sample that names an identity group (at most ``MAX_PAIRS``, by hash), a counterfactual is made by swapping the term
for another of its list, and the squared change of the score between the two is added to the loss:
so a group's name alone cannot carry weight, and neutral mentions are not rejected.

Scoring is one pass over whole texts.  Only the model, which has a fixed size bound, is sent to the
executors.  The score depends on the text alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from deltaweave.llm.tokens import slices
from deltaweave.runtime import ship, stage, table

#: Bounds of the fit: labelled documents, features, swapped sentences.
MAX_TRAIN, MAX_FEATURES, MAX_PAIRS = 6000, 4096, 20_000
#: Least |z| of a feature's difference between the labels, penalties, steps of the fit, the cut of a score.
LEAST_Z, RIDGE, SWAP, STEPS, CUT = 4.0, 0.1, 30.0, 400, 0.3
BEGINNINGS = (4, 5, 6)

# Identity terms that can stand for each other in a sentence.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "african", "european", "hispanic", "arab"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("ausländer", "einwanderer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
)
SWAPS = {term: group[(i + 1) % len(group)] for group in IDENTITY for i, term in enumerate(group)}


def features(words: set[str]) -> set[str]:
    """Words and word beginnings."""
    found = {w for w in words if len(w) > 2}
    for n in BEGINNINGS:
        found |= {w[:n] + "*" for w in words if len(w) > n}
    return found


def plain_words(texts: pa.StringArray) -> pa.ListArray:
    """Lower-cased runs of letters and digits of each text; null counts as empty."""
    return pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+", " "))


def swapped(text: str) -> list[tuple[set[str], set[str]]]:
    """Features of each sentence that names a group, as it is and with the term swapped."""
    out = []
    for sentence in re.split(r"[.!?\n]+", text.lower()):
        words = re.findall(r"\w+", sentence)
        if any(w in SWAPS for w in words):
            out.append((features(set(words)), features({SWAPS.get(w, w) for w in words})))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    every, toxic = Counter(), Counter()
    for batch in slices(batches):
        for label, words in zip(batch.column(0).to_pylist(), plain_words(batch.column(1)).to_pylist()):
            found = features(set(words))
            every.update(found)
            if label:
                toxic.update(found)
    names = list(every)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([every[f] for f in names], pa.int64()), pa.array([toxic[f] for f in names], pa.int64())], ["feature", "n", "pos"])


def least_pairs(pairs: list[tuple]) -> list[tuple]:
    """``MAX_PAIRS`` pairs of least hash, which comes first in each; the choice doesn't depend on their order."""
    return sorted(pairs)[:MAX_PAIRS]


def _rows(names: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda found: sorted(names[f] for f in found if f in names)
        for batch in slices(batches):
            found, pairs = [], []
            for text, words in zip(batch.column(1).to_pylist(), plain_words(batch.column(1)).to_pylist()):
                found.append(number(features(set(words))))
                own = hashlib.blake2b((text or "").encode(), digest_size=16).digest()
                for i, (a, b) in enumerate(swapped(text or "")):
                    pairs.append((hashlib.blake2b(own + i.to_bytes(8, "little"), digest_size=8).hexdigest(), number(a - b), number(b - a), len(found) - 1))
            pairs = least_pairs(pairs)
            by_row: list[list] = [[] for _ in found]
            for *pair, row in pairs:
                by_row[row].append(pair)
            column = lambda i, t: pa.array([[x[i] for x in own] for own in by_row], pa.list_(t))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, ints), column(0, pa.string()), column(1, ints), column(2, ints)], ["label", "found", "place", "minus", "plus"])

    return run


def fit_weights(rows: list[list[int]], labels: list[int], pairs: list[tuple[list[int], list[int]]], size: int, swap: float = SWAP, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights of the regularised logistic regression, by Adam on the full gradient."""
    n, y = len(rows), np.asarray(labels, float)
    if not n:
        return math.log(0.05 / 0.95), np.zeros(size)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    of = np.fromiter((f for r in rows for f in r), np.int64)
    pair_at = np.fromiter((i for i, p in enumerate(pairs) for side in p for _ in side), np.int64)
    pair_of = np.fromiter((f for p in pairs for side in p for f in side), np.int64)
    sign = np.fromiter((s for p in pairs for side, s in zip(p, (-1.0, 1.0)) for _ in side), float)
    bias = math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[size] = bias
    for step in range(1, steps + 1):
        score = np.clip(np.bincount(at, w[of], n) + w[size], -30, 30)
        error = 1 / (1 + np.exp(-score)) - y
        grad = np.zeros(size + 1)
        grad[:size] = np.bincount(of, error[at], size) + RIDGE * w[:size]
        grad[size] = error.sum()
        if pairs:
            change = np.bincount(pair_at, sign * w[pair_of], len(pairs))
            grad[:size] += swap * n / len(pairs) * 0.01 * np.bincount(pair_of, sign * change[pair_at], size)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * (1 - 0.9 * step / steps)
    return float(w[size]), w[:size]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_train: int = MAX_TRAIN) -> dict:
    """The model ``{"bias", "weights": feature -> weight}`` from labelled documents that are not held out.

    Rows without a label are left out, null texts count as empty, and a key with contradicting labels
    counts as toxic; with no usable row the score of every text is 0.05.
    """
    ship(docs.sparkSession)
    usable = labels.where(~held_out(F.col(key)) & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max("toxic").alias("label"))
    chosen = usable.orderBy(F.xxhash64("k"), "k").limit(max_train)
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k").select(F.col("label").cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text"))
    sample = stage(sample, "toxicity_sample")
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).first()
    n, pos = totals["n"], totals["pos"] or 0
    counts = sample.mapInArrow(_count, "feature string, n long, pos long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    rate, other = F.col("pos") / max(pos, 1), (F.col("n") - F.col("pos")) / max(n - pos, 1)
    mean = F.col("n") / max(n, 1)
    z = F.abs(rate - other) / F.sqrt(mean * (1 - mean) * (1 / max(pos, 1) + 1 / max(n - pos, 1)) + 1e-12)
    best = counts.where("n >= 4").withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES)
    names = [r["feature"] for r in best.collect()]
    numbered = {f: i for i, f in enumerate(names)}
    rows = sample.mapInArrow(_rows(numbered), "label int, found array<int>, place array<string>, minus array<array<int>>, plus array<array<int>>").collect()
    pairs = [(a, b) for _, a, b in least_pairs([x for r in rows for x in zip(r["place"], r["minus"], r["plus"])])]
    bias, weights = fit_weights([r["found"] for r in rows], [r["label"] for r in rows], pairs, len(names))
    return {"bias": bias, "weights": {f: float(x) for f, x in zip(names, weights) if abs(x) > 1e-6}}


def held_out(key):
    """Rows that are never learnt from."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(4)) == 2


def score_texts(texts: pa.StringArray, model: dict) -> np.ndarray:
    """Scores from 0 to 1 of whole texts."""
    names = list(model["weights"])
    number, weights = {f: i for i, f in enumerate(names)}, np.array([model["weights"][f] for f in names])
    cut = plain_words(texts)
    of = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(cut), np.int64))
    coded = pc.list_flatten(cut).dictionary_encode()
    hits = {}
    for i, word in enumerate(coded.dictionary.to_pylist()):
        found = [number[f] for f in (word, word[:4] + "*", word[:5] + "*", word[:6] + "*") if f in number]
        if found:
            mine = features({word})
            found = [j for j in found if names[j] in mine]
            if found:
                hits[i] = found
    mask = np.zeros(len(coded.dictionary) + 1, bool)
    mask[list(hits)] = True
    index = np.asarray(coded.indices, np.int64)
    places = np.flatnonzero(mask[index]) if len(index) else np.zeros(0, np.int64)
    seen = {(d, f) for d, i in zip(of[places].tolist(), index[places].tolist()) for f in hits[i]}
    score = np.full(len(texts), model["bias"])
    if seen:
        pairs = np.array(sorted(seen))
        score += np.bincount(pairs[:, 0], weights[pairs[:, 1]], len(texts))
    return 1 / (1 + np.exp(-np.clip(score, -500, 500)))


def _score(model: dict, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], batch.schema.names[at]):
                scores = pa.array(score_texts(part.column(at), model), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, "score"])

    return run


def _scored(docs: DataFrame, model: dict, text: str) -> DataFrame:
    """``docs`` with columns ``c0``, ``c1`` and so on, in order, and ``score``."""
    ship(docs.sparkSession)
    source = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return source.mapInArrow(_score(model, docs.columns.index(text)), StructType([*source.schema.fields, StructField("score", DoubleType())]))


def _named(scored: DataFrame, names: list[str]) -> list[Column]:
    return [F.col(f"c{i}").alias(name) for i, name in enumerate(names)]


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with a ``score`` column (an own column of that name is replaced).

    Null texts count as empty and get the score of an empty text; repeated rows, null keys and extra
    columns of any name pass as they are; an empty table gives an empty result.
    """
    scored = _scored(docs, model, text)
    return scored.select(*[c for c, name in zip(_named(scored, docs.columns), docs.columns) if name != "score"], "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_harmless(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` without the rows that score ``cut`` or more under a model learnt from ``labels``.

    All columns, whatever their names, repeated rows, null texts and null keys pass as they are.
    """
    scored = _scored(docs, fit(docs, labels, key, text), text)
    return scored.where(F.col("score") < cut).select(*_named(scored, docs.columns))
