"""Division of one entity into n daughters, field by field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaweave.functions.names import unused

#: The type of shares that long can't hold.
WHOLE = "decimal(38,0)"


def daughters(df: DataFrame, n: int, index: str = "daughter") -> DataFrame:
    """n rows for each row, numbered from 0."""
    if n < 2:
        raise ValueError("division needs at least two daughters")
    return df.withColumn(index, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def split_extensive(total: Column, n: int) -> Column:
    return total / n


def fits_long(total: Column, n: int) -> Column:
    """Whether the shares of a whole number are long, null where it is null."""
    least, most = (F.lit(str(n * x)).cast(WHOLE) for x in (-(2**63), 2**63 - 1))
    return (total >= least) & (total <= most)


def split_int(total: Column, n: int, index: Column, wide: bool | str = False) -> Column:
    """Truncated share; the remainder goes one apiece, with its sign, to the first daughters.

    A ``wide`` total may have 38 digits; shares are long, and one that long can't hold is an error,
    unless ``wide`` is ``WHOLE``: then they are of that type.
    """
    total = total.cast(WHOLE if wide else "long")  # whole numbers only: doubles lose what is above 2^53
    extra = total % n
    if wide == WHOLE:  # div gives long, so the quotient is put together from parts that long holds
        share, rest = F.lit(0).cast(WHOLE), total
        for part in (10**19, 10**9, 1):
            by = F.lit(str(n * part)).cast(WHOLE)
            share, rest = share + F.call_function("div", rest, by).cast("decimal(19,0)") * F.lit(str(part)).cast("decimal(20,0)"), rest % by
        one = F.when(index < F.abs(extra), F.when(extra < 0, -1).otherwise(1)).otherwise(0)
        return (share + one.cast("decimal(1,0)")).cast(WHOLE)
    share = F.call_function("div", total, F.lit(n))
    if wide:  # the division of decimals cuts what long can't hold
        share = F.when(total.isNull() | fits_long(total, n), share).otherwise(F.raise_error(F.lit("a share is beyond long")).cast("long"))
    return share + F.when(index < F.abs(extra), F.when(extra < 0, -1).otherwise(1)).otherwise(0).cast("long")


def divide_rows(state: DataFrame, dividing: Column, key: str, extensive: list[str], n: int = 2, whole: tuple[str, ...] = (), override: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Rows that divide are replaced by daughters ``<key>_0 ...``.

    ``extensive`` fields are split, ``whole`` numbers with their remainder, all others shared; what
    ``override`` makes of a daughter's number is laid over that.
    """
    index = unused("daughter", state)
    split = daughters(state.where(dividing), n, index)
    split = split.withColumns({c: split_extensive(F.col(c), n) for c in extensive} | {c: split_int(F.col(c), n, F.col(index)) for c in whole})
    split = split.withColumns({c: make(F.col(index)) for c, make in (override or {}).items()})
    split = split.withColumn(key, F.concat_ws("_", F.col(key).cast("string"), F.col(index).cast("string"))).drop(index)
    stay = state.where(~F.coalesce(dividing, F.lit(False))).withColumn(key, F.col(key).cast("string"))
    return stay.unionByName(split.select(*stay.columns))


def round_robin(df: DataFrame, rank: Column, n: int, out: str = "daughter", part: Column | None = None) -> DataFrame:
    """An ordered chain dealt in turn (``rank`` counts from 0), or where ``part`` says so, to that daughter."""
    turn = F.pmod(rank, F.lit(n)).cast("long")
    return df.withColumn(out, turn if part is None else F.coalesce(part.cast("long"), turn))
