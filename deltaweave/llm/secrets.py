"""Secret scan in DataFrame expressions: fixed formats plus sliding-window entropy.

Candidate strings are maximal runs of token characters and, inside those that are no secrets, maximal
runs of hexadecimal digits: a name or sign glued to a key doesn't raise the limit for its digits.  The
characters of a run decide its class (hexadecimal or base64-like).  A window of ``WINDOW`` characters slides over it; its
character counts and the sum of c*log2(c) over them are carried along and changed by the character
that leaves and the one that enters, and the highest entropy of any window is compared with the class's limit.  Spans of fixed
formats and pieces on the allow list (identifiers and samples with known shapes) are cut out of a run
first, and each remaining part of at least ``WINDOW`` characters is a candidate.  Candidates without
both letters and digits are suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm import spans
from deltaweave.runtime import table

# The base formats.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"  # a shorter run holds no match of 20 characters at a later start either
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex")
LEAST_ASSIGNED = 6

#: Candidate runs, the entropy window, and the limits in bits by class.
RUN = r"[A-Za-z0-9+/=_-]{20,}+"
HEX_RUN = r"[0-9a-fA-F]{20,}+"
WINDOW, HEX_BITS, BASE64_BITS = 20, 3.0, 3.7
#: The least and the greatest character of a run, as numbers.
FIRST, LAST = ord("+"), ord("z")
#: Shapes that are no secrets: UUIDs that stand alone, counting samples, named placeholders.
ALLOWED = r"(?i)(?<![a-z0-9+/=_-])[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}(?![a-z0-9+/=_-])|0123456789|abcdefghij|example|placeholder|changeme|dummy|sample"


def _part(count: Column) -> Column:
    """c * log2(c), 0 for 0."""
    return F.when(count > 0, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def highest_entropy(run: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits, of any window of ``window`` characters of ``run`` (at least that long, of ``RUN``'s characters)."""

    def highest(codes: Column) -> Column:
        first = F.slice(codes, 1, window)
        counts = F.transform(F.sequence(F.lit(0), F.lit(LAST - FIRST)), lambda k: F.size(F.filter(first, lambda c: c == k)))
        total = lambda counts: F.aggregate(counts, F.lit(0.0), lambda s, c: s + _part(c))

        def step(state: Column, i: Column) -> Column:
            out, new = F.get(codes, i), F.get(codes, i + window)
            gone, came = F.get(state["counts"], out), F.get(state["counts"], new)
            now = state["sum"] - _part(gone) + _part(gone - 1) - _part(came) + _part(came + 1)
            moved = F.transform(state["counts"], lambda c, k: c - (k == out).cast("int") + (k == new).cast("int"))
            changed = F.struct(moved.alias("counts"), now.alias("sum"), F.least(state["least"], now).alias("least"))
            return F.when(out == new, state).otherwise(changed)

        def least(counts: Column) -> Column:
            zero = F.struct(counts.alias("counts"), total(counts).alias("sum"), total(counts).alias("least"))
            steps = F.when(F.size(codes) > window, F.sequence(F.lit(0), F.size(codes) - window - 1)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(steps, zero, step)["least"]

        return spans.let(counts, least)

    codes = F.transform(F.split(run, ""), lambda c: F.ascii(c) - FIRST)
    return F.log2(F.lit(float(window))) - spans.let(codes, highest) / window


def is_secret(run: Column) -> Column:
    mixed = run.rlike("[0-9]") & run.rlike("[A-Za-z]")
    limit = F.when(run.rlike("^[0-9a-fA-F]+$"), F.lit(HEX_BITS)).otherwise(F.lit(BASE64_BITS))
    return F.when(mixed, highest_entropy(run) >= limit).otherwise(F.lit(False))


def _secret_parts(run: Column, start: Column) -> Column:
    """The run if it is a secret, else the hexadecimal runs in it that are."""
    whole = F.array(spans.span(start, start + F.length(run), "entropy", 3))
    return F.when(is_secret(run), whole).otherwise(spans.shift(spans.find(run, HEX_RUN, "entropy", 3, is_secret), start))


def _base(body: Column) -> Column:
    long_enough = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= LEAST_ASSIGNED
    return spans.sort(spans.find(body, ASSIGN, "assign", 0, long_enough), spans.find(body, ACCESS, "access", 1), spans.find(body, HEX, "hex", 2))


def _found(body: Column, base: Column) -> Column:
    """Base spans and the secrets in what the text has besides them and allowed pieces."""
    allowed = lambda left: spans.blank(left, spans.find(left, ALLOWED, "allowed", 0))
    added = lambda left: F.when(left.rlike(RUN), spans.let(allowed(left), lambda rest: spans.find_parts(rest, RUN, _secret_parts))).otherwise(spans.no_spans())
    return spans.let(base, lambda own: F.when(body.rlike(RUN), spans.sort(own, spans.let(spans.blank(body, own), added))).otherwise(own))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, the text, ``base`` spans and ``found`` spans (base ones and entropy hits).

    Null texts count as empty and have no spans; null keys, repeated rows and extra columns of any
    name are allowed; an empty table gives an empty result.  Whole texts of any length are read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.select("key", "text", _base(body).alias("base"))
    return rows.select(F.col("key").alias(key), F.col("text").alias(text), "base", _found(body, F.col("base")).alias("found"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = scan(table(spark, sf_dir, "documents"))
    counts = [spans.count(F.col("base"), kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(spans.show(F.col("base")), 256).alias("base_sha256"), spans.show(F.col("found")).alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; a column ``n_chars`` follows the new length.

    Overlapping spans become one mark.  Texts without spans, null ones too, stay as they are; so do
    all other columns, whatever their names, repeated rows and empty tables.
    """
    body = lambda rows: F.coalesce(rows["text"], F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    rows = rows.select("row", "text", _base(body(rows)).alias("base"))
    rows = rows.select("row", "text", _found(body(rows), F.col("base")).alias("found"))
    fill = lambda s, before: F.when(s["start"] >= before, F.lit(mark)).otherwise(F.lit(""))
    hit = F.size("found") > 0
    rows = rows.select("row", "found", F.when(hit, spans.replace(body(rows), F.col("found"), fill)).otherwise(F.col("text")).alias("text"))
    values = {name: F.col("row")[name] for name in docs.columns}
    values[text] = F.col("text")
    if "n_chars" in docs.columns and text != "n_chars":
        values["n_chars"] = F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return rows.select(*[value.alias(name) for name, value in values.items()])
