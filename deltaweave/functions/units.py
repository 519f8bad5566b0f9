"""Units: dimensions, the conversion between two units, and bridges between dimensions.

Conversions are found once, from plan data; what is left in the plan is one multiplication, one affine
expression, or one operation with a column that holds the bridge's factor.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column

from deltaweave.functions import exprs


@dataclass(frozen=True)
class Dimension:
    """Powers of base dimensions, none of them zero."""

    powers: frozenset[tuple[str, Fraction]] = frozenset()

    @staticmethod
    def of(**powers: int | Fraction) -> Dimension:
        return Dimension(frozenset((n, Fraction(p)) for n, p in powers.items() if p))

    def __mul__(self, other: Dimension) -> Dimension:
        mine, theirs = dict(self.powers), dict(other.powers)
        return Dimension.of(**{n: mine.get(n, 0) + theirs.get(n, 0) for n in {**mine, **theirs}})

    def __pow__(self, power: int | Fraction) -> Dimension:
        return Dimension.of(**{n: p * power for n, p in self.powers})

    def __truediv__(self, other: Dimension) -> Dimension:
        return self * other**-1


@dataclass(frozen=True)
class Unit:
    """A value in this unit times ``scale`` plus ``offset`` is the value in base units."""

    dimension: Dimension
    scale: float = 1.0
    offset: float = 0.0

    def __mul__(self, other: Unit) -> Unit:
        return Unit(self.dimension * other.dimension, self.scale * other.scale)

    def __truediv__(self, other: Unit) -> Unit:
        return Unit(self.dimension / other.dimension, self.scale / other.scale)


@dataclass(frozen=True)
class Bridge:
    """Leads from one dimension to another: times a constant ``factor``, or times (or divided by) a named column."""

    source: Dimension
    target: Dimension
    factor: float | None = None
    column: str | None = None
    divides: bool = False
    both_ways: bool = False


@dataclass(frozen=True)
class Conversion:
    """``value * scale + offset``, or ``value`` times or divided by ``column``."""

    scale: float = 1.0
    offset: float = 0.0
    column: str | None = None
    divides: bool = False

    def apply(self, value: Column, factor: Column | None = None) -> Column:
        """The converted column; ``factor`` is the bridge's column."""
        if self.column is None:
            return exprs.convert(value, self.scale, self.offset)
        if factor is None:
            raise ValueError(f"the conversion needs {self.column}")
        return exprs.divide(value, factor) if self.divides else value * factor


def conversion(source: Unit, target: Unit, contexts: list[Bridge] | None = None) -> Conversion | None:
    """How to get from one unit to another; None if no context leads there."""
    if source.dimension == target.dimension:
        scale = source.scale / target.scale
        return Conversion(1.0 if abs(scale - 1) < 2.220446049250313e-16 else scale, (source.offset - target.offset) / target.scale)
    for bridge in contexts or []:
        forward = (bridge.source, bridge.target) == (source.dimension, target.dimension)
        if forward or (bridge.both_ways and (bridge.target, bridge.source) == (source.dimension, target.dimension)):
            if bridge.factor is not None:
                return Conversion(bridge.factor if forward else 1 / bridge.factor)
            return Conversion(column=bridge.column, divides=bridge.divides == forward)
    return None
