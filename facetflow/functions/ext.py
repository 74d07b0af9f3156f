"""Exterior algebra of R4 as Column expressions.

``K1``, ``K2`` and ``K3`` are vectors of 4, 6 and 4 components in lexicographic order of their indices: a point is a K1 with
its last component 1, an edge a K2, a plane a K3. The number type is that of the columns: double, or decimal for exact
integers. With ``sign=+1`` everywhere (``absolute()``) products add absolute values, which bounds rounding errors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetflow.functions.vec import V3, fdiv


class _K:
    e: tuple[Column, ...]
    bound: bool

    def _like(self, kind, parts) -> _K:
        return kind(tuple(parts), self.bound)

    def _minus(self, a: Column) -> Column:
        return a if self.bound else -a

    def negate(self):
        return self._like(type(self), [self._minus(a) for a in self.e])

    def inner(self, o) -> Column:
        total = self.e[0] * o.e[0]
        for a, b in zip(self.e[1:], o.e[1:], strict=True):
            total = total + a * b
        return total

    def equals(self, o) -> Column:
        same = self.e[0] == o.e[0]
        for a, b in zip(self.e[1:], o.e[1:], strict=True):
            same = same & (a == b)
        return same

    def absolute(self):
        return type(self)(tuple(F.abs(a) for a in self.e), True)

    def columns(self, prefix: str) -> list[Column]:
        return [a.alias(f"{prefix}{n}") for a, n in zip(self.e, self.NAMES, strict=True)]


@dataclass(eq=False)
class K1(_K):
    e: tuple[Column, ...]
    bound: bool = False
    NAMES = ("0", "1", "2", "3")

    @classmethod
    def point(cls, p: V3, one: Column | None = None) -> K1:
        return cls((*p.parts(), F.lit(1.0) if one is None else one))

    def to_point(self) -> V3:
        return V3(*(fdiv(a, self.e[3]) for a in self.e[:3]))

    def dual(self) -> K3:
        a, b, c, d = self.e
        return self._like(K3, (d, self._minus(c), b, self._minus(a)))

    def reverse_dual(self) -> K3:
        return self.dual().negate()

    def join(self, o: K1 | K2):
        if isinstance(o, K2):
            return o.join(self)
        a, b = self.e, o.e
        term = (lambda i, j: a[i] * b[j] + a[j] * b[i]) if self.bound else (lambda i, j: a[i] * b[j] - a[j] * b[i])
        return self._like(K2, (term(0, 1), term(0, 2), term(0, 3), term(1, 2), term(1, 3), term(2, 3)))


@dataclass(eq=False)
class K2(_K):
    e: tuple[Column, ...]
    bound: bool = False
    NAMES = ("01", "02", "03", "12", "13", "23")

    def dual(self) -> K2:
        e01, e02, e03, e12, e13, e23 = self.e
        return self._like(K2, (e23, self._minus(e13), e12, e03, self._minus(e02), e01))

    reverse_dual = dual

    def join(self, o: K1) -> K3:
        e01, e02, e03, e12, e13, e23 = self.e
        b = o.e
        # the component ijk is ij*k - ik*j + jk*i
        term = (lambda ij, k, ik, j, jk, i: ij * b[k] + ik * b[j] + jk * b[i]) if self.bound else (lambda ij, k, ik, j, jk, i: ij * b[k] - ik * b[j] + jk * b[i])
        return self._like(K3, (term(e01, 2, e02, 1, e12, 0), term(e01, 3, e03, 1, e13, 0), term(e02, 3, e03, 2, e23, 0), term(e12, 3, e13, 2, e23, 1)))

    def meet(self, o: K3) -> K1:
        return self.dual().join(o.dual()).reverse_dual()


@dataclass(eq=False)
class K3(_K):
    e: tuple[Column, ...]
    bound: bool = False
    NAMES = ("012", "013", "023", "123")

    def dual(self) -> K1:
        a, b, c, d = self.e
        return self._like(K1, (d, self._minus(c), b, self._minus(a)))

    def reverse_dual(self) -> K1:
        return self.dual().negate()

    def meet(self, o: K2 | K3):
        if isinstance(o, K2):
            return o.meet(self)
        return self.dual().join(o.dual()).reverse_dual()
