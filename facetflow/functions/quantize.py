"""Coordinates on an integer grid of 30 bits, and seeded perturbation there."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetflow.functions.vec import V3

BITS = 30
#: The fewest grid steps, as a power of two, that the shortest edge must span.
LEAST_EDGE_BITS = 10


#: Bits of the shortest edge that perturbations leave alone, the bits of the smallest range of perturbations, and those of the largest,
#: as offsets are drawn modulo a prime of 20 bits.
BUFFER_BITS, LEAST_RANGE_BITS, MOST_RANGE_BITS = 8, 2, 18


def perturbation_budget(edge_bits: Column, first: int) -> tuple[Column, Column]:
    """(bits of the first range of perturbations, how many ranges there are), each twice as wide as the one before.

    A range takes one bit more of those that the shortest edge has on its mesh's grid; the last leaves ``BUFFER_BITS``. The first is
    ``first`` bits wide, or less where the edge has so few that not at least five ranges would follow.
    """
    begin = F.least(F.lit(first), F.greatest(F.lit(LEAST_RANGE_BITS), edge_bits - BUFFER_BITS - 4))
    return begin, F.least(edge_bits - BUFFER_BITS, F.lit(MOST_RANGE_BITS)) - begin + 1


class QuantizationError(ValueError):
    """``code`` says why a mesh has no grid."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def _power(exponent: int | Column) -> float | Column:
    return F.pow(F.lit(2.0), exponent) if isinstance(exponent, Column) else 2.0**exponent


def binary_exponent(x: Column) -> Column:
    """The smallest e with abs(x) < 2^e, exactly: the logarithm's rounding is put right."""
    guess = F.floor(F.log2(x)) + 1
    return (guess + (F.pow(F.lit(2.0), guess) <= x).cast("int") - (F.pow(F.lit(2.0), guess - 1) > x).cast("int")).cast("int")


def grid_exponents(largest: Column, shortest: Column) -> tuple[Column, Column]:
    """The exponent of a mesh's grid by its largest coordinate and its shortest edge, and ``OK`` or why there is no grid."""
    exponent = F.when(largest > 0, binary_exponent(largest)).otherwise(0) + 1
    enough = (shortest > 0) & (binary_exponent(shortest) - (exponent - BITS) >= LEAST_EDGE_BITS)
    return exponent, F.when(enough, "OK").otherwise("EXCESSIVE_DYNAMIC_RANGE_FOR_QUANTIZATION")


@dataclass
class Quantizer:
    """``magnify`` takes coordinates to the grid, truncating towards zero; ``edge_bits``: bits of the shortest edge, if it is known."""

    exponent: int | Column
    edge_bits: int | None = None

    @property
    def magnify(self) -> float | Column:
        return _power(BITS - self.exponent)

    @property
    def quantum(self) -> float | Column:
        return _power(self.exponent - BITS)

    @classmethod
    def of(cls, max_magnitude: float, min_edge: float | None = None) -> Quantizer:
        exponent = math.frexp(max_magnitude)[1] + 1
        if min_edge is None:
            return cls(exponent)
        bits = math.frexp(min_edge)[1] - (exponent - BITS)
        if bits < LEAST_EDGE_BITS:
            raise QuantizationError("EXCESSIVE_DYNAMIC_RANGE_FOR_QUANTIZATION")
        return cls(exponent, bits)

    @classmethod
    def calibrate(cls, *meshes) -> Quantizer:
        """On the largest coordinate of all operands: one number comes to the driver."""
        biggest = 0.0
        for mesh in meshes:
            got = mesh.vertices.agg(F.max(F.greatest(F.abs("x"), F.abs("y"), F.abs("z")))).first()[0]
            biggest = max(biggest, got or 0.0)
        return cls.of(biggest)

    @classmethod
    def per_mesh(cls) -> Quantizer:
        """For rows that carry their mesh's ``exponent``, as ``grid_exponents`` finds it."""
        return cls(F.col("exponent"))

    def to_grid(self, p: V3) -> V3:
        return V3(*((c * self.magnify).cast("bigint") for c in p.parts()))

    def back(self, p: V3) -> V3:
        return V3(*(c.cast("double") * self.quantum for c in p.parts()))


#: The prime that perturbations are drawn modulo.
PRIME = 1_000_003


def perturbation(vid: Column, seed: int, quanta: int | Column) -> V3:
    """Grid offsets of -quanta to quanta per axis: a cubic of the vertex id and a seed modulo a prime, so that no structure of
    the ids survives; the same in any engine with 64-bit integers.
    """

    def offset(axis: int) -> Column:
        h = (vid * 3 + axis + 7919 * seed) % PRIME
        return ((h * h % PRIME) * (h + 17)) % PRIME % (2 * quanta + 1) - quanta

    return V3(*(offset(axis) for axis in range(3)))


def sql_perturbation(vid: str, axis: int, seed: int, quanta: int) -> str:
    """The same as SQL text."""
    h = f"(({vid} * 3 + {axis + 7919 * seed}) % {PRIME})"
    return f"(({h} * {h} % {PRIME}) * ({h} + 17)) % {PRIME} % {2 * quanta + 1} - {quanta}"
