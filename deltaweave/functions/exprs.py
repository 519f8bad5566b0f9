"""Scalar expressions of the surface language as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """IEEE division: by zero it gives an infinity or NaN instead of an error."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def int_arithmetic(op: str, a: Column, b: Column) -> Column:
    """Whole-number + - * through doubles, as the surface language computes them."""
    x, y = a.cast("double"), b.cast("double")
    return {"+": x + y, "-": x - y, "*": x * y}[op].cast("long")


def join_path(left: Column, right: Column) -> Column:
    return F.when((left == "") | F.endswith(left, F.lit("/")), F.concat(left, right)).otherwise(F.concat(left, F.lit("/"), right))


def interpolate(*parts: Column) -> Column:
    """Parts in one string; null parts are empty."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def comprehension(items: Column, body, where) -> Column:
    """``[body(x) for x in items if where(x)]``."""
    return F.transform(F.filter(items, where), body)


def convert(value: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    """Affine unit conversion; parts that change nothing are left out."""
    out = value if scale == 1.0 else value * scale
    return out if offset == 0.0 else out + offset


def numeric_string(value: Column) -> Column:
    """Inferred kind of a string: numeric-looking strings are floats."""
    return F.when(value.try_cast("double").isNotNull(), "float").otherwise("string")


def _wanted(column: Column, kinds: str, what: str, use: Column) -> Column:
    """``use`` if the column's type is one of ``kinds``, else an error."""
    return F.when(F.typeof(column).rlike(f"^({kinds})"), use).otherwise(F.raise_error(F.concat(F.lit(f"{what} needs "), F.lit(kinds), F.lit(", not "), F.typeof(column))))


NUMBERS = "tinyint|smallint|int|bigint|float|double|decimal"


def compare(op: str, a: Column, b: Column) -> Column:
    """``< <= > >=`` of numbers; anything else is an error, as is an unknown operator."""
    found = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return _wanted(a, NUMBERS, op, _wanted(b, NUMBERS, op, found))


def equal(a: Column, b: Column) -> Column:
    """Structural equality: nulls are equal to nulls."""
    return a.eqNullSafe(b)


def logic(op: str, a: Column, b: Column | None = None) -> Column:
    """``and or not`` of booleans; anything else is an error, and so is null."""
    strict = lambda c: _wanted(c, "boolean", op, F.when(c.isNull(), F.raise_error(F.lit(f"{op} of null"))).otherwise(c.cast("boolean")))
    if op == "not":
        return ~strict(a)
    sides = F.array(strict(a), strict(b))  # both are looked at, whatever the first one is
    return {"and": F.forall(sides, lambda x: x), "or": F.exists(sides, lambda x: x)}[op]


def negate(a: Column) -> Column:
    """Unary minus of a number."""
    return _wanted(a, NUMBERS, "-", -a)


def plus_plus(a: Column, b: Column) -> Column:
    """Concatenation of two strings or two lists."""
    return F.concat(a, b)


def choose(condition: Column, then: Column, otherwise: Column | None = None) -> Column:
    """``if``: the condition must be boolean; without ``else`` the value is null."""
    strict = _wanted(condition, "boolean", "if", condition.cast("boolean"))
    return F.when(strict, then) if otherwise is None else F.when(strict, then).otherwise(otherwise)


def field(value: Column, path: str, kind: str = "string") -> Column:
    """A path in a variant column; null where it leads nowhere or the value there is of another kind."""
    return F.try_variant_get(value, "$." + path, kind)


def record(**entries: Column) -> Column:
    """Named parts as one value."""
    return F.struct(*[c.alias(n) for n, c in entries.items()])


def map_comprehension(entries: Column, key, body, where=None) -> Column:
    """``{key(x): body(x) for x in entries if where(x)}``; of equal keys the last wins."""
    kept = entries if where is None else F.filter(entries, where)
    pairs = F.transform(kept, lambda x: F.struct(key(x).alias("key"), body(x).alias("value")))
    later = lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"])
    return F.map_from_entries(F.filter(pairs, later))


def define(spark, name: str, parameters: str, body: str, returns: str) -> None:
    """A function of the session's SQL, from an SQL expression over its parameters."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
