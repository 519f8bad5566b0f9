"""Text spans as DataFrame expressions: regular expressions with positions, without Python workers.

A span is ``struct<start int, rank int, kind string, stop int>``: code points, stop exclusive; rank is
the place of its kind in the operator's list of kinds.  ``split`` gives the gaps between the
leftmost non-overlapping matches that ``regexp_extract_all`` gives, so running sums of lengths are the
positions.  Running sums and maxima are made by doubling (n log n steps), parts of a text are taken
from pieces of ``PIECE`` code points, and overlaps are found by binary search, so many hits in one text
take little more than proportional time.  Patterns here have no backtracking into repeated groups
(possessive quantifiers), so very long runs don't exhaust the stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of the pieces that parts of texts are taken from (a power of two).
PIECE = 256
SPANS = "array<struct<start:int,rank:int,kind:string,stop:int>>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """``values[0]``, ``join(values[0], values[1])`` and so on, for an associative ``join``."""
    powers = F.array(*[F.lit(1 << i) for i in range(31)])

    def doubled(now: Column, k: Column) -> Column:
        return F.transform(now, lambda v, i: F.when(i >= k, join(F.get(now, i - k), v)).otherwise(v))

    return let(values, lambda v: F.aggregate(F.filter(powers, lambda k: k < F.size(v)), v, doubled))


def find_parts(text: Column, pattern: str, parts: Callable[[Column, Column], Column]) -> Column:
    """All spans that ``parts`` gives for the matches of ``pattern`` in ``text``, from a match and its start."""

    def placed(gaps: Column, hits: Column) -> Column:
        widths = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda gap, hit: F.length(gap) + F.length(hit))
        return let(running(widths, lambda a, b: a + b), lambda ends: F.flatten(F.transform(hits, lambda hit, i: parts(hit, F.get(ends, i) - F.length(hit)))))

    found = let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: placed(gaps, hits)))
    return F.when(text.rlike(pattern), found).otherwise(no_spans())


def find(text: Column, pattern: str, kind: str, rank: int, valid: Callable[[Column], Column] | None = None) -> Column:
    """Spans of the matches of ``pattern`` in ``text`` that ``valid`` accepts."""

    def whole(hit: Column, start: Column) -> Column:
        one = F.array(span(start, start + F.length(hit), kind, rank))
        return one if valid is None else F.when(valid(hit), one).otherwise(no_spans())

    return find_parts(text, pattern, whole)


def span(start: Column, stop: Column, kind: str, rank: int) -> Column:
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), stop.alias("stop"))


def shift(spans: Column, by: Column) -> Column:
    """The spans moved by ``by`` code points."""
    return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), (s["stop"] + by).alias("stop")))


def sort(*spans: Column) -> Column:
    """All spans by start, then rank, then stop."""
    return F.array_sort(F.concat(*spans))


def show(spans: Column) -> Column:
    """``kind:start:stop`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def pieces(text: Column) -> Column:
    """The text in pieces of ``PIECE`` code points."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}+"), F.lit(0))


def cut(parts: Column, start: Column, stop: Column) -> Column:
    """Code points ``start`` to ``stop`` of a text given as its ``pieces``."""
    bits = PIECE.bit_length() - 1
    piece = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    first, last = F.shiftright(start, bits), F.shiftright(stop, bits)
    skip = start.bitwiseAND(F.lit(PIECE - 1))
    middle = F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    over_pieces = F.concat(F.substring(piece(first), skip + 1, F.lit(PIECE)), middle, F.substring(piece(last), F.lit(1), stop.bitwiseAND(F.lit(PIECE - 1))))
    return F.when(stop <= start, F.lit("")).when(first == last, F.substring(piece(first), skip + 1, stop - start)).otherwise(over_pieces)


def reach(spans: Column) -> Column:
    """The highest stop of each span and those before it."""
    return running(F.transform(spans, lambda s: s["stop"]), lambda a, b: F.greatest(a, b))


def replace(text: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """``text`` with ``fill(span, end of the spans before)`` in place of each of the sorted ``spans``."""

    def put(parts: Column, ends: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            return let(F.coalesce(F.get(ends, i - 1), F.lit(0)), lambda before: F.concat(cut(parts, before, F.greatest(before, s["start"])), fill(s, before)))

        return F.concat(F.array_join(F.transform(spans, one), ""), cut(parts, F.element_at(ends, -1), F.length(text)))

    return F.when(F.size(spans) > 0, let(pieces(text), lambda parts: let(reach(spans), lambda ends: put(parts, ends)))).otherwise(text)


def blank(text: Column, spans: Column) -> Column:
    """``text`` with the characters of the sorted ``spans`` replaced by spaces."""
    return replace(text, spans, lambda s, before: F.repeat(F.lit(" "), F.greatest(s["stop"] - F.greatest(before, s["start"]), F.lit(0))))


def below(values: Column, limit: Column) -> Column:
    """How many of the sorted ``values`` are below ``limit``, by binary search."""
    powers = F.array(*[F.lit(1 << i) for i in reversed(range(31))])
    step = lambda at, k: F.when(F.get(values, at + k - 1) < limit, at + k).otherwise(at)
    return F.aggregate(F.filter(powers, lambda k: k <= F.size(values)), F.lit(0), step)


def touched(spans: Column, use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``use`` of a test whether a span shares a character with any of the sorted ``spans``."""

    def test(starts: Column, ends: Column) -> Callable[[Column], Column]:
        return lambda s: F.coalesce(F.get(ends, below(starts, s["stop"]) - 1) > s["start"], F.lit(False))

    return let(F.transform(spans, lambda s: s["start"]), lambda starts: let(reach(spans), lambda ends: use(test(starts, ends))))
