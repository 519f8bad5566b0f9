"""Types of one's own, methods on types, and contracts between connected ports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from deltaweave.functions import sorts
from deltaweave.operators.divide import split_int


@dataclass(frozen=True)
class TypeMethods:
    """How a type of one's own behaves, as functions of columns; what is None follows ``representation``.

    ``apply(current, update)``, ``divide(value, part, n)``, ``check(value)``, ``default()``.
    """

    representation: sorts.Sort = sorts.ANY
    apply: Callable[[Column, Column], Column] | None = None
    divide: Callable[[Column, Column, int], Column] | None = None
    check: Callable[[Column], Column] | None = None
    default: Callable[[], Column] | None = None


def apply_column(sort: sorts.Sort, current: Column, update: Column) -> Column:
    """An update acting on a column of the sort; a null update changes nothing."""
    if sort.kind in ("integer", "float", "delta"):
        return F.coalesce(current, F.lit(0)) + F.coalesce(update, F.lit(0))
    if sort.kind == "const":
        return current
    if sort.kind == "maybe":
        return F.when(current.isNull(), update).otherwise(apply_column(sort.args[0], current, update))
    if sort.kind == "array":
        below = sorts.Sort("array", sort.args, values=sort.values[1:]) if len(sort.values) > 1 else sort.args[0]
        added = F.zip_with(current, update, lambda a, b: apply_column(below, a, b))
        return F.when(F.size(current) == F.size(update), added).otherwise(F.coalesce(update, current))
    if sort.kind == "map":
        known = F.map_zip_with(current, update, lambda _, a, b: F.when(b.isNull(), a).when(a.isNull(), b).otherwise(apply_column(sort.args[0], a, b)))
        return F.when(update.isNull(), current).when(current.isNull(), update).otherwise(known)
    if sort.kind in ("tree", "tuple"):
        names = sort.names or tuple(f"_{i + 1}" for i in range(len(sort.args)))
        parts = [apply_column(a, current[n], update[n]).alias(n) for n, a in zip(names, sort.args)]
        return F.when(update.isNull(), current).otherwise(F.struct(*parts))
    return F.coalesce(update, current)


def apply_entries(sort: sorts.Sort, current: Column, change: Column | None = None, removed: Column | None = None, added: Column | None = None) -> Column:
    """A map column after its entries are removed (names), added (whole values) and changed, in this order."""
    if removed is not None:
        current = F.when(removed.isNull(), current).otherwise(F.map_filter(current, lambda k, _: ~F.array_contains(removed, k)))
    if added is not None:
        kept = F.map_filter(current, lambda k, _: ~F.array_contains(F.map_keys(added), k))
        current = F.when(added.isNull(), current).otherwise(F.map_concat(kept, added))
    return current if change is None else apply_column(sort, current, change)


def apply_items(current: Column, removed: Column | None = None, added: Column | None = None, cleared: Column | None = None) -> Column:
    """A list column after items are removed by value (all of them where ``cleared``), then added."""
    kept = current if removed is None else F.when(removed.isNull(), current).otherwise(F.filter(current, lambda x: ~F.array_contains(removed, x)))
    kept = kept if cleared is None else F.when(cleared, F.slice(current, 1, 0)).otherwise(kept)
    return kept if added is None else F.when(added.isNull(), kept).otherwise(F.concat(kept, added))


def divide_column(sort: sorts.Sort, value: Column, part: Column, n: int, wide: bool | str = False) -> Column:
    """Daughter ``part`` of ``n``: extensive amounts are split, integers with their remainder, all else is shared.

    Integers may be ``wide``, in up to 38 digits, as ``split_int`` says.
    """
    if sort.kind == "delta":
        return value / n
    if sort.kind == "integer":
        return split_int(value, n, part, wide)
    if sort.kind in ("maybe", "overwrite"):
        return divide_column(sort.args[0], value, part, n, wide)
    if sort.kind == "map":
        return F.transform_values(value, lambda _, v: divide_column(sort.args[0], v, part, n, wide))
    if sort.kind == "array" and len(sort.values) > 1:
        below = sorts.Sort("array", sort.args, values=sort.values[1:])
        return F.transform(value, lambda v: divide_column(below, v, part, n, wide))
    if sort.kind in ("list", "array"):
        return F.transform(value, lambda v: divide_column(sort.args[0], v, part, n, wide))
    if sort.kind in ("tree", "tuple"):
        names = sort.names or tuple(f"_{i + 1}" for i in range(len(sort.args)))
        return F.struct(*[divide_column(a, value[k], part, n, wide).alias(k) for k, a in zip(names, sort.args)])
    return value


@dataclass
class Registry:
    """Named types with parents, and methods looked up by type, then by its parents."""

    types: dict[str, TypeMethods] = field(default_factory=dict)
    parents: dict[str, str] = field(default_factory=dict)
    methods: dict[tuple[str, str], Callable] = field(default_factory=dict)

    def register(self, name: str, behaviour: TypeMethods, parent: str | None = None) -> None:
        """A type; a parent that descends from it raises."""
        if parent is not None:
            if name in self.lineage(parent):
                raise ValueError(f"{name} and {parent} would inherit from each other")
            self.parents[name] = parent
        self.types[name] = behaviour

    def alias(self, name: str, of: str) -> None:
        """Another name of a type."""
        self.register(name, self.types[of], of)

    def lineage(self, name: str) -> list[str]:
        """The type and its ancestors, nearest first."""
        out = []
        while name is not None and name not in out:
            out.append(name)
            name = self.parents.get(name)
        return out

    def _found(self, name: str, what: str):
        return next((f for t in self.lineage(name) if t in self.types and (f := getattr(self.types[t], what))), None)

    def _representation(self, name: str) -> sorts.Sort:
        return next((self.types[t].representation for t in self.lineage(name) if t in self.types), sorts.parse(name))

    def apply(self, name: str, current: Column, update: Column) -> Column:
        """The type's own rule, or that of its representation."""
        own = self._found(name, "apply")
        return own(current, update) if own else apply_column(self._representation(name), current, update)

    def divide(self, name: str, value: Column, part: Column, n: int) -> Column:
        """The type's own rule, or that of its representation; ``n`` is at least 2."""
        if n < 2:
            raise ValueError("a division makes at least two")
        own = self._found(name, "divide")
        return own(value, part, n) if own else divide_column(self._representation(name), value, part, n)

    def method(self, type_name: str, name: str, function: Callable) -> None:
        """A method ``function(receiver, *arguments)`` of a type."""
        self.methods[type_name, name] = function

    def dispatch(self, type_name: str, name: str, receiver, *arguments):
        """Call the nearest method of that name."""
        for owner in self.lineage(type_name):
            if (owner, name) in self.methods:
                return self.methods[owner, name](receiver, *arguments)
        raise KeyError(f"{type_name} has no method {name}")


def chain_apply(items: Column, put: Column, removed: Column, added: Column) -> Column:
    """An ordered list: set ``put`` (index to value), remove by index, append.  Indices are those before."""
    changed = F.transform(items, lambda x, i: F.coalesce(put[i], x))
    return F.concat(F.filter(changed, lambda x, i: ~F.array_contains(removed, i)), added)


@dataclass(frozen=True)
class Contract:
    """What a port promises or asks: sort, dimension, and named terms such as method or time axis."""

    sort: sorts.Sort = sorts.ANY
    dimension: str | None = None
    terms: tuple[tuple[str, str], ...] = ()


def connection_faults(offered: Contract, asked: Contract) -> list[str]:
    """Why the ports can't be connected, before any plan is built; empty where they can."""
    faults = []
    if not sorts.refines(offered.sort, asked.sort):
        faults.append(f"sort {offered.sort.kind} does not refine {asked.sort.kind}")
    if asked.dimension not in (None, offered.dimension):
        faults.append(f"dimension {offered.dimension} is not {asked.dimension}")
    held = dict(offered.terms)
    faults += [f"{k} is {held.get(k)}, not {v}" for k, v in asked.terms if held.get(k) != v]
    return faults
