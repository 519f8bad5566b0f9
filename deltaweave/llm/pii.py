"""Personal data in DataFrame expressions: fixed formats plus boosted candidate spans.

1. Fixed formats (e-mail, IP, card, phone) with their own checks give the base spans; they stay.
2. High-recall generators propose further, overlapping spans: written-out addresses and any run of
   digits with separators.
3. Labels come from planted evidence: every base span is rewritten into a form that its fixed format
   refuses (``jane (at) mail (dot) org``, a phone number without its plus, a card number with dots)
   and stands in the base span's own context as a positive.  Proposals that overlap no base span are
   unlabelled and count as negatives, but for those that a weak label vouches for.
4. Each candidate is described by a few coarse format and context features.  How often each
   combination of them occurs, and how often it is positive, is counted over all documents; the
   table is bounded by the product of the features' values.
5. Boosted depth-two trees are fitted to those counts, and each generator's threshold is calibrated
   on a held-out fold of documents to the wanted precision.  Proposals that score above it and
   overlap no base span are added.

Scanning, counting and scoring are Column expressions; the driver sees only the bounded table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm import spans
from deltaweave.runtime import stage, table

# The base formats.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

#: Generators of further candidates.
WRITTEN = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++"
NUMBER = r"(?<![0-9])\+?\(?[0-9][0-9\x20().-]{6,}[0-9]"
#: The end of a written-out address with a named domain.
NAMED = r"(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z][A-Za-z-]*[A-Za-z]$"
CUES = r"(?i)(phone|tel|call|mobile|fax|mail|contact|card|visa|ssn|ip|address|konto|rufnummer|correo|telefon|appel|courriel)[^A-Za-z]{0,12}$"
FEATURES = ("digits", "separators", "dots", "groups", "plus", "cue", "glued", "at")
CONTEXT, ROUNDS, RATE, PRECISION = 24, 24, 0.3, 0.9


def luhn(hit: Column) -> Column:
    """12 to 19 digits that pass the Luhn check."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    value = lambda c, i: F.when(i % 2 == 1, F.element_at(doubled, c.cast("int") + 1)).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, b: a + b)
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def _phone(hit: Column) -> Column:
    return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(9, 15)


def _ip(hit: Column) -> Column:
    return hit.rlike(rf"^{_PART}(\.{_PART}){{3}}$")


def base_spans(text: Column) -> Column:
    return spans.sort(
        spans.find(text, EMAIL, "email", 0),
        spans.find(text, IP, "ip", 1, _ip),
        spans.find(text, CARD, "card", 2, luhn),
        spans.find(text, PHONE, "phone", 3, _phone),
    )


def features(body: Column, before: Column, after: Column) -> Column:
    """Coarse format and context features of a candidate, each a small whole number, from its text and what is around it."""
    of = lambda pattern: F.length(F.regexp_replace(body, pattern, ""))
    digits, groups = of("[^0-9]"), F.size(F.split(body, "[^0-9A-Za-z]+"))
    values = {
        "digits": F.when(digits < 7, 0).when(digits < 9, 1).when(digits < 12, 2).when(digits < 16, 3).when(digits == 16, 4).otherwise(5),
        "separators": F.least(of("[^ ()-]"), F.lit(4)),
        "dots": F.least(of("[^.]"), F.lit(4)),
        "groups": F.least(groups, F.lit(5)),
        "plus": body.startswith("+").cast("int"),
        "cue": before.rlike(CUES).cast("int"),
        "glued": (before.rlike("[A-Za-z0-9]$") | after.rlike("[A-Za-z0-9]")).cast("int"),
        "at": F.when(body.contains("@"), 2).when(body.rlike("at[)\\]]"), 1).otherwise(0),
    }
    return F.struct(*[values[name].cast("int").alias(name) for name in FEATURES])


def rewritten(kind: Column, body: Column, choice: Column) -> Column:
    """A base span's text in a form that no base format has; ``choice`` is any whole number.  IPs and what no generator proposes give null."""
    pick = lambda *ways: F.element_at(F.array(*ways), F.pmod(choice, F.lit(len(ways))).cast("int") + 1)
    local, domain = F.substring_index(body, "@", 1), F.substring_index(body, "@", -1)
    spoken = lambda at, dot: F.concat(local, F.lit(at), F.regexp_replace(domain, r"\.", dot))
    email = pick(spoken(" (at) ", " (dot) "), spoken("(at)", "."), spoken(" [at] ", "[dot]"), spoken(" @ ", " . "))
    bare = F.ltrim(F.regexp_replace(body, r"\+", ""))
    phone = pick(bare, F.regexp_replace(bare, r"[\x20()-]+", "."), F.regexp_replace(bare, "[()]", ""))
    digits = F.regexp_replace(body, "[^0-9]", "")
    card = F.regexp_replace(F.regexp_replace(digits, "([0-9]{4})", "$1."), r"\.$", "")
    new = F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card)
    fits = F.when(kind == "email", new.rlike(f"^(?:{WRITTEN})$")).otherwise(new.rlike(f"^(?:{NUMBER})$"))
    return F.when(fits, new)


def _sure(kind: Column, body: Column, x: Column) -> Column:
    """Weak labels that need no base span: written-out addresses with a named domain, numbers of 7 to 16 digits right after a cue."""
    number = (x["cue"] == 1) & (x["glued"] == 0) & x["digits"].between(1, 4)
    return F.when(kind == "written", body.rlike(NAMED)).otherwise(number)


@dataclass(frozen=True)
class Tree:
    """Split on one feature, then on one feature of each side; four leaf values."""

    root: tuple[str, int]
    sides: tuple[tuple[str, int], tuple[str, int]]
    leaves: tuple[tuple[float, float], tuple[float, float]]

    def value(self, row) -> float:
        side = int(row[self.root[0]] > self.root[1])
        name, limit = self.sides[side]
        return self.leaves[side][int(row[name] > limit)]

    def column(self, row: Column) -> Column:
        half = lambda i: F.when(row[self.sides[i][0]] > self.sides[i][1], F.lit(self.leaves[i][1])).otherwise(F.lit(self.leaves[i][0]))
        return F.when(row[self.root[0]] > self.root[1], half(1)).otherwise(half(0))


def boost(cells: list[dict], rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list[Tree]]:
    """Gradient boosting of the logistic loss on ``cells`` (features, ``n`` and ``pos``): prior score and trees."""
    n, pos = sum(c["n"] for c in cells), sum(c["pos"] for c in cells)
    prior = math.log((pos + 1) / (n - pos + 1))
    scores = [prior] * len(cells)
    cuts = sorted({(f, v) for f in FEATURES for v in {c[f] for c in cells}})
    trees: list[Tree] = []

    def stats(rows):
        return sum(grad[i] for i in rows), sum(hess[i] for i in rows)

    def split(rows: list[int]) -> tuple[float, tuple[str, int]]:
        g, h = stats(rows)
        best = (0.0, ("digits", 1 << 20))
        for f, v in cuts:
            right = [i for i in rows if cells[i][f] > v]
            a, b = stats(right)
            if right and len(right) < len(rows):
                best = max(best, (a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1), (f, v)))
        return best

    def leaf(rows: list[int]) -> float:
        g, h = stats(rows)
        return round(rate * g / (h + 1), 9)

    for _ in range(rounds if cells else 0):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        grad = [c["pos"] - c["n"] * q for c, q in zip(cells, p)]
        hess = [c["n"] * q * (1 - q) for c, q in zip(cells, p)]
        every = list(range(len(cells)))
        _, root = split(every)
        halves = [[i for i in every if (cells[i][root[0]] > root[1]) == bool(side)] for side in (0, 1)]
        sides = tuple(split(rows)[1] for rows in halves)
        leaves = tuple(tuple(leaf([i for i in rows if (cells[i][side[0]] > side[1]) == bool(k)]) for k in (0, 1)) for rows, side in zip(halves, sides))
        trees.append(Tree(root, sides, leaves))
        scores = [s + trees[-1].value(c) for s, c in zip(scores, cells)]
    return prior, trees


def calibrate(cells: list[dict], prior: float, trees: list[Tree], precision: float = PRECISION) -> float:
    """The least score from which on the held-out cells reach ``precision``; infinite if none does."""
    scored = sorted(((prior + sum(t.value(c) for t in trees), c["n"], c["pos"]) for c in cells), reverse=True)
    best, n, pos = math.inf, 0, 0
    for i, (score, many, right) in enumerate(scored):
        n, pos = n + many, pos + right
        if (i + 1 == len(scored) or scored[i + 1][0] < score) and n and pos / n >= precision:
            best = score
    return best


def _described(text: Column, base: Column, proposed: Column, key: Column) -> Column:
    """Proposals and rewritten base spans of one text with their features: ``kind, start, stop, x, known, sure, planted``."""

    def around(parts: Column, start: Column, stop: Column, use) -> Column:
        return spans.let(F.struct(spans.cut(parts, start, stop).alias("body"), spans.cut(parts, F.greatest(start - CONTEXT, F.lit(0)), start).alias("before"), spans.cut(parts, stop, stop + 1).alias("after")), use)

    def candidate(s: Column, kind: Column, x: Column, known: Column, sure: Column, planted: bool) -> Column:
        return F.struct(s.alias("span"), kind.alias("kind"), x.alias("x"), known.alias("known"), sure.alias("sure"), F.lit(planted).alias("planted"))

    def own(parts: Column, s: Column, known: Column) -> Column:
        with_x = lambda t: spans.let(features(t["body"], t["before"], t["after"]), lambda x: candidate(s, s["kind"], x, known, _sure(s["kind"], t["body"], x), False))
        return around(parts, s["start"], s["stop"], with_x)

    def plant(parts: Column, s: Column) -> Column:
        kind = F.when(s["kind"] == "email", F.lit("written")).otherwise(F.lit("number"))
        choice = F.pmod(F.crc32(F.concat_ws(":", key.cast("string"), s["start"].cast("string"))), F.lit(12))
        with_x = lambda t: spans.let(rewritten(s["kind"], t["body"], choice), lambda new: F.when(new.isNotNull(), candidate(s, kind, features(new, t["before"], t["after"]), F.lit(False), F.lit(True), True)))
        return around(parts, s["start"], s["stop"], with_x)

    def both(parts: Column) -> Column:
        real = spans.touched(base, lambda known: F.transform(proposed, lambda s: own(parts, s, known(s))))
        planted = F.filter(F.transform(base, lambda s: plant(parts, s)), lambda c: c.isNotNull())
        return F.concat(real, planted)

    return F.when((F.size(base) > 0) | (F.size(proposed) > 0), spans.let(spans.pieces(text), both))


def learn(cells: list[dict]) -> tuple[float, list[Tree], dict[str, float], dict[str, dict]]:
    """Prior, trees, each generator's limit, and what the limit gives on held-out planted and unlabelled candidates.

    ``cells`` have the features, ``kind``, ``held``, the count ``n`` and the positives ``pos`` among
    them, and the planted ones ``planted``.
    """
    cells = sorted(cells, key=lambda c: (c["kind"], c["held"], *(c[f] for f in FEATURES)))
    prior, trees = boost([c for c in cells if not c["held"]])
    limits, report = {}, {}
    for kind in ("written", "number"):
        held = [c for c in cells if c["held"] and c["kind"] == kind]
        limits[kind] = calibrate(held, prior, trees)
        taken = [c for c in held if prior + sum(t.value(c) for t in trees) >= limits[kind] - 1e-9]
        add = lambda rows, name: sum(c[name] for c in rows)
        report[kind] = {"planted": add(held, "planted"), "planted_taken": add(taken, "planted"), "unlabelled": add(held, "n") - add(held, "pos"), "unlabelled_taken": add(taken, "n") - add(taken, "pos")}
    return prior, trees, limits, report


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, base, proposed``: base spans, and described proposals and rewritten base spans (null if a text has neither)."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    body = F.col("text")
    rows = rows.select("key", "text", base_spans(body).alias("base"), F.concat(spans.find(body, WRITTEN, "written", 4), spans.find(body, NUMBER, "number", 5)).alias("proposed"))
    described = spans.let(F.col("base"), lambda base: spans.let(F.col("proposed"), lambda proposed: _described(F.col("text"), base, proposed, F.col("key"))))
    return rows.select("key", "base", described.alias("proposed"))


def counts(rows: DataFrame) -> list[dict]:
    """How often each combination of features occurs among the candidates that overlap no base span, by fold."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("key").cast("string"), F.lit(""))), F.lit(4)) == 3
    single = rows.select(fold.alias("held"), F.explode("proposed").alias("c")).where("NOT c.known").select("held", "c.kind", "c.x.*", "c.sure", "c.planted")
    grouped = single.groupBy("kind", "held", *FEATURES)
    return [r.asDict() for r in grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("sure").cast("long")).alias("pos"), F.sum(F.col("planted").cast("long")).alias("planted")).collect()]


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, ``base`` spans and ``found`` spans (base ones and added ones).

    Null texts count as empty and have no spans; null keys, repeated rows and extra columns of any
    name are allowed; an empty table gives an empty result.  Whole texts of any length are read.
    """
    rows = stage(candidates(docs, key, text), "candidates")
    prior, trees, limits, _ = learn(counts(rows))

    def chosen(c: Column) -> Column:
        score = F.lit(prior)
        for tree in trees:
            score = score + tree.column(c["x"])
        limit = F.when(c["kind"] == "written", F.lit(limits["written"])).otherwise(F.lit(limits["number"]))
        return ~c["known"] & ~c["planted"] & (score >= limit - 1e-9)

    added = F.transform(F.filter("proposed", chosen), lambda c: c["span"])
    return rows.select(F.col("key").alias(key), "base", spans.sort(F.col("base"), F.coalesce(added, spans.no_spans())).alias("found"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = detect(table(spark, sf_dir, "documents"))
    counts = [spans.count(F.col("base"), kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(spans.show(F.col("base")), 256).alias("base_sha256"), spans.show(F.col("found")).alias("spans"))
