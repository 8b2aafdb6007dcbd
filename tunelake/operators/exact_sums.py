"""Sums of doubles that do not depend on the order or the grouping of the rows.

A finite double is an integer times a power of two.  ``Digits.split`` writes it
as signed digits to the base 2^24, one long column for each place between the
lowest bit and the largest value that occur; longs are added exactly, partial
sums merge by addition, and ``Digits.join`` turns the sums of all places back
into a double.  Nothing is too small or too large, and nothing can overflow
before 2^39 rows.  Infinities and NaN are counted beside the digits.
All expressions are native.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24
_MANTISSA = 53


def _times_power(x: Column, e: int) -> Column:
    """x * 2^e in steps that a double can hold."""
    while e:
        step = max(-1000, min(1000, e))
        x = x * F.lit(math.ldexp(1.0, step))
        e -= step
    return x


@dataclass
class Digits:
    """Places low..high of one column; ``special``: infinities or NaN occur."""

    low: int
    high: int
    special: bool

    @property
    def columns(self) -> int:
        return self.high - self.low + 1 + (3 if self.special else 0)

    def split(self, x: Column) -> list[Column]:
        """Long columns to be added up; null where x is null."""
        x = x.cast("double")
        finite = ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
        size, out = F.abs(x), []
        base = F.lit(float(1 << BITS))
        for place in range(self.low, self.high + 1):
            scaled = _times_power(size, -BITS * place)
            digit = F.floor(scaled - F.floor(scaled / base) * base)
            top = BITS * place + BITS + _MANTISSA  # a larger value has no bit in this place
            if top <= 1023:
                digit = F.when(size < F.lit(math.ldexp(1.0, top)), digit).otherwise(F.lit(0))
            digit = F.when(x < 0, -digit).otherwise(digit).cast("long")
            out.append(F.when(x.isNotNull(), F.when(finite, digit).otherwise(F.lit(0)).cast("long")))
        if self.special:
            for which in (x == F.lit(math.inf), x == F.lit(-math.inf), F.isnan(x)):
                out.append(F.when(x.isNotNull(), which.cast("long")))
        return out

    def join(self, sums: list[Column]) -> Column:
        """The double of the summed places; null where nothing was added."""
        n = self.high - self.low + 1
        high = [F.shiftright(sums[i], BITS) for i in range(n)]  # rounds down; what is left is under 2^24
        value = _times_power(high[-1].cast("double"), BITS * (self.high + 1))
        for i in range(n - 1, -1, -1):  # from the top: terms under 2^53, so nothing is lost before a sum is rounded
            term = sums[i] - F.shiftleft(high[i], BITS)
            term = term + high[i - 1] if i else term
            value = value + _times_power(term.cast("double"), BITS * (self.low + i))
        if self.special:
            plus, minus, nan = sums[-3:]
            value = (F.when((nan > 0) | ((plus > 0) & (minus > 0)), F.lit(math.nan)).when(plus > 0, F.lit(math.inf))
                     .when(minus > 0, F.lit(-math.inf)).otherwise(value))
        return F.when(sums[0].isNotNull(), value)


def plan(df: DataFrame, columns: list[str]) -> dict[str, Digits]:
    """The places that each double column needs: one aggregation to one row."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        size = F.when(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)) & (x != 0), F.abs(x))
        aggs += [F.min(size).alias(f"lo{i}"), F.max(size).alias(f"hi{i}"),
                 F.max(F.isnan(x) | (F.abs(x) == F.lit(math.inf))).alias(f"special{i}")]
    row = df.agg(*aggs).first()
    return {c: _digits(row[f"lo{i}"], row[f"hi{i}"], bool(row[f"special{i}"])) for i, c in enumerate(columns)}


def _digits(least: float | None, largest: float | None, special: bool) -> Digits:
    if least is None:
        return Digits(0, 0, special)
    lowest_bit = max(math.frexp(least)[1] - _MANTISSA, -1074)
    return Digits(lowest_bit // BITS, (math.frexp(largest)[1] - 1) // BITS, special)


def exact_sum(df: DataFrame, group: list[str], columns: dict[str, Column], others: list[Column] = ()) -> DataFrame:
    """Sums of double columns by group that are the same however the rows are spread; ``others`` are plain aggregates."""
    named = df.withColumns({f"_x_{name}": c for name, c in columns.items()})
    places = plan(named, [f"_x_{name}" for name in columns])
    aggs = [F.sum(d).alias(f"_x_{name}_{i}") for name in columns
            for i, d in enumerate(places[f"_x_{name}"].split(F.col(f"_x_{name}")))]
    g = named.groupBy(*group).agg(*aggs, *others)
    joined = []
    for name in columns:
        d = places[f"_x_{name}"]
        joined.append(d.join([F.col(f"_x_{name}_{i}") for i in range(d.columns)]).alias(name))
    return g.select(*[c for c in g.columns if not c.startswith("_x_")], *joined)
