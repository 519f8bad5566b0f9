"""Deltas as DataFrames: reconcile batches of updates, apply them, merge and diff keyed stores.

Every function takes explicit key columns and an explicit order where order matters.  Sums and
last-wins reductions are map-side combinable aggregates; keyed stores meet in equi joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaweave.functions.names import unused
from deltaweave.functions.sorts import Sort

#: An additive update of at most this size is no change.
EPSILON = 2.220446049250313e-16


def reconcile_sum(updates: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """One additive update per key; updates that cancel out are dropped."""
    return updates.groupBy(*keys).agg(F.sum(value).alias(out)).where(F.abs(F.col(out)) > EPSILON)


def reconcile_last(updates: DataFrame, keys: list[str], value: str, order: list[str], out: str) -> DataFrame:
    """One replacing update per key: the last that is not null."""
    given = updates.where(F.col(value).isNotNull())
    return given.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(out))


def void_removed(updates: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """Updates of keys that the same batch does not remove: removal wins over change."""
    return updates.join(removed.select(*keys).distinct(), keys, "left_anti")


def reconcile_list(updates: DataFrame, keys: list[str], items: str, order: list[str], out: str) -> DataFrame:
    """Plain lists of one key are concatenated in order."""
    name = unused("items", order)
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(items).alias(name))))
    return updates.groupBy(*keys).agg(F.flatten(F.transform(rows, lambda r: r[name])).alias(out))


def reconcile_tree(updates: DataFrame, keys: list[str], branches: Sort, order: list[str]) -> DataFrame:
    """One update per key for rows whose columns are the branches of a tree: each branch by the rule of its sort.

    Amounts are summed (null where they cancel out), lists are concatenated in order, tuples (structs)
    go place by place, constants are left out, and of all else the last value that is not null stays.
    """

    def folded(column: Column, sort: Sort) -> Column | None:
        if sort.kind in ("integer", "float", "delta"):
            total = F.sum(column)
            return F.when(F.abs(total) > (0 if sort.kind == "integer" else EPSILON), total)
        if sort.kind == "const":
            return None
        if sort.kind == "maybe":
            return folded(column, sort.args[0])
        if sort.kind in ("tuple", "tree"):
            names = sort.names or tuple(f"_{i + 1}" for i in range(len(sort.args)))
            parts = [(n, folded(column[n], s)) for n, s in zip(names, sort.args)]
            return F.struct(*[p.alias(n) for n, p in parts if p is not None])
        if sort.kind == "list":
            rows = F.sort_array(F.collect_list(F.when(column.isNotNull(), F.struct(*order, column.alias("items")))))
            return F.flatten(F.transform(rows, lambda r: r["items"]))
        return F.max_by(column, F.when(column.isNotNull(), F.struct(*order)))

    made = [(n, folded(F.col(n), s)) for n, s in branches.branches().items()]
    return updates.groupBy(*keys).agg(*[c.alias(n) for n, c in made if c is not None])


def list_remove_add(current: Column, removed: Column, added: Column) -> Column:
    """Remove by value, then append."""
    return F.concat(F.filter(current, lambda x: ~F.array_contains(removed, x)), added)


def array_sum(updates: DataFrame, keys: list[str], array: str, out: str) -> DataFrame:
    """Element-wise sum of arrays, as one row per key and place: no array of a whole group is gathered."""
    name = unused("item", keys, ["place"])
    cells = updates.select(*keys, F.posexplode(array).alias("place", name))
    return cells.groupBy(*keys, "place").agg(F.sum(F.col(name).cast("double")).alias(out))


def apply_add(state: DataFrame, update: DataFrame, keys: list[str], value: str, change: str) -> DataFrame:
    """Additive application: keys without an update stay."""
    name = unused("change", state)
    joined = state.join(update.select(*keys, F.col(change).alias(name)), keys, "left")
    return joined.withColumn(value, F.col(value) + F.coalesce(name, F.lit(0))).drop(name)


def apply_replace(state: DataFrame, update: DataFrame, keys: list[str], value: str, new: str) -> DataFrame:
    """Replacing application: keys without an update, or with a null one, stay."""
    name = unused("new", state)
    joined = state.join(update.select(*keys, F.col(new).alias(name)), keys, "left")
    return joined.withColumn(value, F.coalesce(name, value)).drop(name)


def apply_add_remove(state: DataFrame, removed: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """Delete the removed keys, then insert absolute rows; an added key replaces what is there."""
    gone = removed.select(*keys).unionByName(added.select(*keys)).distinct()
    return state.join(gone, keys, "left_anti").unionByName(added)


def merge(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Union of two keyed stores; where both have a value, ``b`` has it."""
    of_a, of_b = unused("a", keys), unused("b", keys)
    left = a.select(*keys, F.struct(*values).alias(of_a))
    right = b.select(*keys, F.struct(*values).alias(of_b))
    return left.join(right, keys, "full_outer").select(*keys, *[F.coalesce(F.col(of_b)[v], F.col(of_a)[v]).alias(v) for v in values])


def _compared(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, Column, Column, Column]:
    """Rows that differ, with the operation and both values."""
    of_a, of_b = unused("a", keys), unused("b", keys)
    left, right = (f.select(*keys, F.struct(F.col(value).alias("v")).alias(n)) for f, n in ((a, of_a), (b, of_b)))
    old, new = F.col(of_a), F.col(of_b)
    op = F.when(old.isNull(), "add").when(new.isNull(), "remove").otherwise("change")
    changed = old.isNull() | new.isNull() | ~old["v"].eqNullSafe(new["v"])
    return left.join(right, keys, "full_outer").where(changed), op, old["v"], new["v"]


def diff(a: DataFrame, b: DataFrame, keys: list[str], value: str, digits: int | None = None) -> DataFrame:
    """The least update from ``a`` to ``b``: ``op`` is add, remove or change; ``delta`` a value, null or difference."""
    rows, op, old, new = _compared(a, b, keys, value)
    delta = F.when(op == "add", new).when(op == "change", new - old)
    return rows.select(*keys, op.alias("op"), (delta if digits is None else F.round(delta, digits)).alias("delta"))


def structural_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What differs from ``a`` to ``b`` without any sort: ``op`` is add, remove or change; ``value`` is the new value itself, null if removed."""
    rows, op, _, new = _compared(a, b, keys, value)
    return rows.select(*keys, op.alias("op"), new.alias("value"))


def array_diff(a: Column, b: Column) -> Column:
    """Element-wise difference; 0 where nothing changed."""
    return F.zip_with(a, b, lambda x, y: y - x)
