"""Signed integers of any width as Column expressions: arrays of 64-bit words that carry 28 bits each.

Lowest word first; all words but the last are in [0, 2^28), the last one is signed. Sums and products are made word by word
without carries, which 64 bits hold for products of up to 32 words, and carried once at the end. Nulls give null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 28
_MASK = (1 << WORD) - 1
#: Decimal digits that a step of the conversion to text takes off.
_DIGITS = 8


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _carried(words: list[Column]) -> Column:
    """Words that hold more than 28 bits, or negative ones, as words that keep the rule; the same number of words and one more."""
    start = F.struct(_long(0).alias("carry"), F.array().cast("array<bigint>").alias("done"))

    def step(state: Column, word: Column) -> Column:
        total = state["carry"] + word
        return F.struct(F.shiftright(total, WORD).alias("carry"), F.array_append(state["done"], total.bitwiseAND(_long(_MASK))).alias("done"))

    return F.aggregate(F.array(*words), start, step, lambda state: F.array_append(state["done"], state["carry"]))


@dataclass
class Wide:
    """``words`` is an array column of ``size`` words; wider operands are taken as they come, results grow as they have to."""

    words: Column
    size: int

    @classmethod
    def of(cls, value: Column) -> Wide:
        """A 64-bit integer."""
        v = value.cast("bigint")
        return cls(F.array(v.bitwiseAND(_long(_MASK)), F.shiftright(v, WORD).bitwiseAND(_long(_MASK)), F.shiftright(v, 2 * WORD)), 3)

    @classmethod
    def of_two(cls, high: Column, low: Column) -> Wide:
        """high * 2^31 + low, with low in [0, 2^31)."""
        rest = F.shiftright(high, 25)
        second = F.shiftright(low, WORD) + F.shiftleft(high.bitwiseAND(_long((1 << 25) - 1)), 3)
        return cls(F.array(low.bitwiseAND(_long(_MASK)), second, rest.bitwiseAND(_long(_MASK)), F.shiftright(rest, WORD)), 4)

    def named(self, name: str) -> Wide:
        """The same number once it is a column of its own; a number that is used more than once should be."""
        return Wide(F.col(name), self.size)

    def _word(self, k: int) -> Column:
        return F.get(self.words, F.lit(k)) if k < self.size else _long(0)

    def _sum(self, other: Wide, sign: int) -> Wide:
        n = max(self.size, other.size)
        words = [self._word(k) + other._word(k) if sign > 0 else self._word(k) - other._word(k) for k in range(n)]
        return Wide(_carried(words), n + 1)

    def __add__(self, other: Wide) -> Wide:
        return self._sum(other, 1)

    def __sub__(self, other: Wide) -> Wide:
        return self._sum(other, -1)

    def __neg__(self) -> Wide:
        return Wide(_carried([-self._word(k) for k in range(self.size)]), self.size + 1)

    def _products(self, other: Wide) -> list[Column]:
        words: list = [None] * (self.size + other.size - 1)
        for i in range(self.size):
            for j in range(other.size):
                x = self._word(i) * other._word(j)
                words[i + j] = x if words[i + j] is None else words[i + j] + x
        return words

    def __mul__(self, other: Wide) -> Wide:
        words = self._products(other)
        return Wide(_carried(words), len(words) + 1)

    def cross(self, b: Wide, c: Wide, d: Wide) -> Wide:
        """self * d - b * c of numbers of equal size, carried once."""
        words = [x - y for x, y in zip(self._products(d), b._products(c), strict=True)]
        return Wide(_carried(words), len(words) + 1)

    def sign(self) -> Column:
        last = self._word(self.size - 1)
        return F.when(last < 0, -1).when(F.exists(self.words, lambda w: w != 0), 1).when(self.words.isNotNull() & last.isNotNull(), 0)

    def compare(self, other: Wide) -> Column:
        """-1, 0 or 1."""
        return (self - other).sign()

    def to_double(self) -> Column:
        """From the highest word down: within two units in the last place."""
        return F.aggregate(F.reverse(self.words), F.lit(0.0), lambda total, w: total * float(1 << WORD) + w.cast("double"))

    def to_text(self) -> Column:
        """Decimal digits: the size without sign is divided by 10^8 as often as it has groups of eight digits."""
        sign = self.sign()
        size = F.when(sign < 0, (-self).words).otherwise(F.array_append(self.words, _long(0)))
        groups = (WORD * (self.size + 1) * 302) // (1000 * _DIGITS) + 1

        def divide(state: Column, _: Column) -> Column:
            by = _long(10**_DIGITS)
            begin = F.struct(_long(0).alias("rest"), F.array().cast("array<bigint>").alias("words"))

            def step(at: Column, w: Column) -> Column:
                whole = at["rest"] * _long(1 << WORD) + w
                return F.struct((whole % by).alias("rest"), F.array_append(at["words"], F.floor((whole - whole % by) / by).cast("bigint")).alias("words"))

            found = F.aggregate(state["words"], begin, step)
            text = F.concat(F.lpad(found["rest"].cast("string"), _DIGITS, "0"), state["text"])
            return F.struct(found["words"].alias("words"), text.alias("text"))

        start = F.struct(F.reverse(size).alias("words"), F.lit("").alias("text"))
        digits = F.aggregate(F.array(*map(F.lit, range(groups))), start, divide, lambda state: F.regexp_replace(state["text"], "^0+(?=.)", ""))
        return F.when(sign < 0, F.concat(F.lit("-"), digits)).when(sign.isNotNull(), digits)
