"""Sorts: the types of state, their expressions, their order, and the columns they stand for.

A sort decides how values default, how they are checked and which Spark type holds them.  Sorts are
driver-side plan data; values stay in columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SortError(ValueError):
    """An expression is no sort."""


@dataclass(frozen=True)
class Sort:
    """``args`` are inner sorts, ``names`` their branches in a tree, ``values`` of an enum or sizes of an array."""

    kind: str
    args: tuple[Sort, ...] = ()
    names: tuple[str, ...] = ()
    values: tuple = ()

    def branches(self) -> dict[str, Sort]:
        return dict(zip(self.names, self.args))


ANY, BOOL, INTEGER, FLOAT, DELTA, STRING = (Sort(k) for k in ("any", "bool", "integer", "float", "delta", "string"))

#: Names of atomic sorts in type expressions.
ATOMS = {
    "any": ANY, "node": ANY, "bool": BOOL, "boolean": BOOL, "xor": BOOL, "int": INTEGER, "integer": INTEGER,
    "float": FLOAT, "mass": FLOAT, "concentration": FLOAT, "count": FLOAT, "positive_float": FLOAT,
    "process_interval": FLOAT, "number": FLOAT, "nonnegative": FLOAT, "string": STRING, "delta": DELTA,
    "set_float": Sort("overwrite", (FLOAT,)),
    "positive_array": Sort("list", (FLOAT,)),
}
#: Sorts that change how an update acts, around one inner sort.
WRAPPERS = ("overwrite", "maybe", "const", "quote")
#: Kinds of nodes, the more special last.
NODES = ("link", "step", "process", "composite")


def tree(**branches: Sort) -> Sort:
    """A tree with these branches."""
    return Sort("tree", tuple(branches.values()), tuple(branches))


def _split(text: str, mark: str) -> list[str]:
    """Parts of ``text`` between marks that are outside all brackets."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "[(") - (c in "])")
        if depth < 0:
            raise SortError(f"unbalanced brackets in {text!r}")
        if c == mark and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    if depth:
        raise SortError(f"unbalanced brackets in {text!r}")
    return [p.strip() for p in (*parts, text[start:])]


def parse(text: str) -> Sort:
    """The sort of a type expression; unknown names are ``any``."""
    text = text.strip()
    named = [_split(p, ":") for p in _split(text, "|")]
    if all(len(p) > 1 and p[0].isidentifier() for p in named):
        return Sort("tree", tuple(parse(":".join(p[1:])) for p in named), tuple(p[0] for p in named))
    if text.startswith("(") and text.endswith(")"):
        return parse(text[1:-1])
    if not text.endswith("]"):
        return ATOMS.get(text, ANY)
    head, _, inner = text[:-1].partition("[")
    given = [p for p in _split(inner, ",") if p]
    if head == "enum":
        return Sort("enum", values=tuple(given))
    if head == "array":
        sizes = given[0].strip("()") if given else ""
        return Sort("array", (parse(given[1]) if len(given) > 1 else FLOAT,), values=tuple(int(n) for n in sizes.split("|") if n))
    if head in ("map", "list", "tree", *WRAPPERS):
        return Sort("recursive" if head == "tree" else head, (parse(given[0]) if given else ANY,))
    if head in ("tuple", *NODES):
        return Sort(head, tuple(map(parse, given)))
    return ANY


def default(sort: Sort) -> Any:
    """The canonical value."""
    kind, args = sort.kind, sort.args
    plain = {"bool": False, "integer": 0, "float": 0.0, "delta": 0.0, "string": ""}
    if kind in plain:
        return plain[kind]
    if kind == "enum":
        return sort.values[0] if sort.values else ""
    if kind in ("overwrite", "const", "quote"):
        return default(args[0])
    if kind == "tuple":
        return [default(a) for a in args]
    if kind == "tree":
        return {n: default(a) for n, a in sort.branches().items()}
    if kind == "array":
        value = default(args[0])
        for size in reversed(sort.values):
            value = [value] * size
        return value
    return {"list": [], "map": {}, "recursive": {}}.get(kind)


def check(sort: Sort, value: Any) -> bool:
    """Is the value of this sort?  Sorts that hold nothing to look into have no members."""
    kind, args = sort.kind, sort.args
    number = isinstance(value, int | float) and not isinstance(value, bool)
    if kind in ("any", "bool", "integer", "string", "enum", "float", "delta"):
        return {
            "any": True, "bool": isinstance(value, bool), "integer": number and isinstance(value, int),
            "float": number, "delta": number, "string": isinstance(value, str), "enum": value in sort.values,
        }[kind]
    if kind in ("maybe", "overwrite"):
        return (kind == "maybe" and value is None) or check(args[0], value)
    if kind == "list":
        return isinstance(value, list) and all(check(args[0], v) for v in value)
    if kind == "tuple":
        return isinstance(value, list | tuple) and len(value) == len(args) and all(map(check, args, value))
    if kind == "map":
        return isinstance(value, dict) and all(check(args[0], v) for v in value.values())
    if kind == "tree":
        return isinstance(value, dict) and all(n in value and check(a, value[n]) for n, a in sort.branches().items())
    if kind == "recursive":
        return all(check(sort, v) for v in value.values()) if isinstance(value, dict) else check(args[0], value)
    if kind == "array":
        inner = Sort("array", args, values=sort.values[1:]) if len(sort.values) > 1 else args[0]
        return isinstance(value, list) and (not sort.values or len(value) == sort.values[0]) and all(check(inner, v) for v in value)
    return False


def infer(value: Any) -> Sort:
    """The least sort of a value: numeric strings are floats, lists hold anything, hidden keys are left out."""
    if isinstance(value, dict):
        if isinstance(value.get("_type"), str):
            return parse(value["_type"])
        return tree(**{k: infer(v) for k, v in value.items() if not k.startswith("_")})
    if isinstance(value, str):
        try:
            float(value)
        except ValueError:
            return STRING
        return FLOAT
    for types, sort in ((bool, BOOL), (int, INTEGER), (float, FLOAT), (list, Sort("list", (ANY,)))):
        if isinstance(value, types):
            return sort
    return ANY


def at(sort: Sort, path: list[str]) -> Sort:
    """The sort at a path; ``any`` where the path leaves the known."""
    for name in path:
        while sort.kind in WRAPPERS:
            sort = sort.args[0]
        if sort.kind == "tree":
            sort = sort.branches().get(name, ANY)
        elif sort.kind == "tuple":
            sort = sort.args[int(name)] if name.isdigit() and int(name) < len(sort.args) else ANY
        elif sort.kind in ("map", "list", "array"):
            sort = sort.args[0]
        elif sort.kind != "recursive":
            return ANY
    return sort


def _paired(how, a: tuple[Sort, ...], b: tuple[Sort, ...]) -> tuple[Sort, ...]:
    """Place by place; what only one side has stays."""
    return tuple(how(x, y) for x, y in zip(a, b)) + (a[len(b) :] or b[len(a) :])


def _branched(how, a: Sort, b: Sort) -> Sort:
    """Branch by branch; what only one side has stays."""
    left, right = a.branches(), b.branches()
    return tree(**{n: how(left[n], right[n]) if n in left and n in right else left.get(n, right.get(n)) for n in {**left, **right}})


def _alike(how, a: Sort, b: Sort) -> Sort | None:
    """Two sorts of one kind, part by part; None for kinds without parts."""
    if a.kind == "enum":
        return Sort("enum", values=a.values + tuple(v for v in b.values if v not in a.values))
    if a.kind == "tree":
        return _branched(how, a, b)
    if a.kind == "array":
        longer, shorter = (a.values, b.values) if len(a.values) >= len(b.values) else (b.values, a.values)
        sizes = tuple(max(n, m) for n, m in zip(longer, shorter)) + longer[len(shorter) :]
        return Sort("array", _paired(how, a.args, b.args), values=sizes)
    return Sort(a.kind, _paired(how, a.args, b.args), a.names, a.values) if a.args and b.args else None


def resolve(a: Sort, b: Sort) -> Sort:
    """The join: the least sort that both refine.  It is total: of two sorts with nothing in common it is the second."""
    if a == b or b == ANY:
        return a
    if a == ANY:
        return b
    kinds = {a.kind, b.kind}
    if len(kinds) == 1:
        return _alike(resolve, a, b) or b
    for wrapper in ("maybe", "overwrite", "const"):
        if wrapper in kinds:
            inner = (a.args[0], b) if a.kind == wrapper else (a, b.args[0])
            return Sort(wrapper, (resolve(*inner),))
    if kinds == {"integer", "float"} or kinds == {"float", "delta"}:
        return FLOAT if "integer" in kinds else DELTA
    one = lambda kind: a if a.kind == kind else b
    for special in ("array", "tuple"):
        if kinds == {"list", special}:
            return one(special)
    if kinds == {"map", "tree"}:
        value = one("map").args[0]
        if value.kind in NODES:
            return one("map")  # entries that come later keep their type
        return Sort("tree", tuple(resolve(value, s) if a.kind == "map" else resolve(s, value) for s in one("tree").args), one("tree").names)
    if kinds == {"map", "recursive"}:
        return Sort("recursive", (resolve(one("recursive").args[0], one("map").args[0]),))
    if kinds <= set(NODES):
        return Sort(max(kinds, key=NODES.index), _paired(resolve, a.args, b.args))
    return b


def promote(library: Sort, sparse: Sort) -> Sort:
    """``sparse`` with what the library says about its own paths, and no others."""
    if library.kind == sparse.kind == "tree":
        known = library.branches()
        return tree(**{n: promote(known[n], s) if n in known else s for n, s in sparse.branches().items()})
    return resolve(library, sparse)


def generalize(a: Sort, b: Sort) -> Sort:
    """The meet: wrappers are dropped, numbers widen, enums and trees are united; of two sorts with nothing in common it is the second."""
    if a == ANY or b == ANY:
        return b if a == ANY else a
    if a.kind in WRAPPERS or b.kind in WRAPPERS:
        return generalize(a.args[0], b) if a.kind in WRAPPERS else generalize(a, b.args[0])
    kinds = {a.kind, b.kind}
    if a == b:
        return a
    if kinds == {"integer", "float"} or kinds == {"float", "delta"}:
        return FLOAT if "integer" in kinds else DELTA
    return (_alike(generalize, a, b) if len(kinds) == 1 and a.kind not in NODES else None) or b


def refines(a: Sort, b: Sort) -> bool:
    """Does ``a`` promise all that ``b`` does?"""
    return resolve(a, b) == a


def as_value(sort: Sort) -> dict:
    """The sort as plain data."""
    return {"kind": sort.kind, "args": [as_value(a) for a in sort.args], "names": list(sort.names), "values": list(sort.values)}


def from_value(value: dict) -> Sort:
    """The sort that :func:`as_value` wrote."""
    return Sort(value["kind"], tuple(map(from_value, value["args"])), tuple(value["names"]), tuple(value["values"]))


def data_type(sort: Sort) -> T.DataType:
    """The Spark type of a column of this sort; what is not known is a variant."""
    kind, args = sort.kind, sort.args
    atoms = {"bool": T.BooleanType(), "integer": T.LongType(), "float": T.DoubleType(), "delta": T.DoubleType(), "string": T.StringType(), "enum": T.StringType()}
    if kind in atoms:
        return atoms[kind]
    if kind in WRAPPERS:
        return data_type(args[0])
    if kind == "list":
        return T.ArrayType(data_type(args[0]))
    if kind == "array":
        out = data_type(args[0])
        for _ in sort.values or (0,):
            out = T.ArrayType(out)
        return out
    if kind == "map":
        return T.MapType(T.StringType(), data_type(args[0]))
    if kind in ("tree", "tuple"):
        names = sort.names or tuple(f"_{i + 1}" for i in range(len(args)))
        return T.StructType([T.StructField(n, data_type(a), metadata={"extensive": a.kind == "delta"}) for n, a in zip(names, args)])
    return T.VariantType()


def default_column(sort: Sort) -> Column:
    """The canonical value as a column."""
    if sort.kind == "tree":
        return F.struct(*[default_column(a).alias(n) for n, a in sort.branches().items()])
    if sort.kind == "array":
        column = default_column(sort.args[0])
        for size in reversed(sort.values):
            column = F.array_repeat(column, size)
        return column.cast(data_type(sort)) if sort.values else F.array().cast(data_type(sort))
    if sort.kind in ("overwrite", "const", "quote"):
        return default_column(sort.args[0])
    if sort.kind == "list":
        return F.array().cast(data_type(sort))
    if sort.kind == "map":
        return F.create_map().cast(data_type(sort))
    if sort.kind == "tuple":
        return F.struct(*[default_column(a).alias(f"_{i + 1}") for i, a in enumerate(sort.args)])
    value = default(sort)
    return F.lit(value).cast(data_type(sort)) if value is not None else F.lit(None).cast(data_type(sort))


def _filled(column: Column, sort: Sort) -> Column:
    if sort.kind == "tree":
        return F.struct(*[_filled(column[n], a).alias(n) for n, a in sort.branches().items()])
    return F.coalesce(column, default_column(sort))


def realize(text: Column, sort: Sort) -> Column:
    """JSON text as a column of the sort; what is absent, null or unreadable takes its default."""
    return _filled(F.from_json(text, data_type(sort)), sort)


def encode(column: Column) -> Column:
    """A tree, map or list as JSON text."""
    return F.to_json(column)
