"""Vectors of two and three components as Column expressions.

A ``V3`` or ``V2`` holds one Column per component; arithmetic builds expressions that stay inside whole-stage codegen.
Division by zero gives infinity or NaN as doubles do, whatever the session's ANSI mode.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def _col(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def fdiv(a: Number, b: Number) -> Column:
    """IEEE division of doubles."""
    a, b = _col(a), _col(b)
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.coalesce(F.try_divide(a, b), F.when(a.isNotNull() & (b == 0), by_zero))


class _Vector:
    """What both dimensions share; ``parts()`` gives the components."""

    def parts(self) -> tuple[Column, ...]:
        return tuple(getattr(self, n) for n in self.__dataclass_fields__)

    def _map(self, f, *others):
        return type(self)(*(f(*p) for p in zip(self.parts(), *(o.parts() for o in others), strict=True)))

    def __add__(self, o):
        return self._map(lambda a, b: a + b, o)

    def __sub__(self, o):
        return self._map(lambda a, b: a - b, o)

    def __mul__(self, k: Number):
        return self._map(lambda a: a * _col(k))

    __rmul__ = __mul__

    def __truediv__(self, k: Number):
        return self._map(lambda a: fdiv(a, k))

    def __neg__(self):
        return self._map(lambda a: -a)

    def double(self):
        return self._map(lambda a: a.cast("double"))

    def equals(self, o) -> Column:
        return reduce(lambda a, b: a & b, (a == b for a, b in zip(self.parts(), o.parts(), strict=True)))

    def before(self, o) -> Column:
        """Lexicographic order."""
        return self.struct() < o.struct()

    def dot(self, o) -> Column:
        return reduce(lambda a, b: a + b, (a * b for a, b in zip(self.parts(), o.parts(), strict=True)))

    def len_squared(self) -> Column:
        return self.dot(self)

    def length(self) -> Column:
        return F.sqrt(self.len_squared())

    def normalized(self, to: Number = 1.0):
        k = fdiv(_col(to).cast("double"), self.length())
        return self._map(lambda a: a * k)

    def abs(self):
        return self._map(F.abs)

    def least(self, *others):
        return self._map(lambda *p: F.least(*p), *others)

    def greatest(self, *others):
        return self._map(lambda *p: F.greatest(*p), *others)

    def max_component(self) -> Column:
        return F.greatest(*self.parts())

    def min_component(self) -> Column:
        return F.least(*self.parts())

    def max_dim(self) -> Column:
        """Index of the largest component, the first of equals."""
        return self._extreme(F.greatest)

    def min_dim(self) -> Column:
        return self._extreme(F.least)

    def _extreme(self, pick) -> Column:
        best = pick(*self.parts())
        found = None
        for k, p in enumerate(self.parts()[:-1]):
            found = F.when(p == best, k) if found is None else found.when(p == best, k)
        return found.otherwise(len(self.parts()) - 1)

    def at(self, dim: Column) -> Column:
        parts = self.parts()
        found = F.when(dim == 0, parts[0])
        for k, p in enumerate(parts[1:], 1):
            found = found.when(dim == k, p)
        return found

    def struct(self) -> Column:
        return F.struct(*(p.alias(n) for p, n in zip(self.parts(), self.__dataclass_fields__, strict=True)))

    def columns(self, prefix: str) -> list[Column]:
        return [p.alias(f"{prefix}{n}") for p, n in zip(self.parts(), self.__dataclass_fields__, strict=True)]


@dataclass(eq=False)
class V2(_Vector):
    x: Column
    y: Column

    @classmethod
    def of(cls, prefix: str) -> V2:
        return cls(F.col(f"{prefix}x"), F.col(f"{prefix}y"))

    def det(self, o: V2) -> Column:
        return self.x * o.y - self.y * o.x


@dataclass(eq=False)
class V3(_Vector):
    x: Column
    y: Column
    z: Column

    @classmethod
    def of(cls, prefix: str = "") -> V3:
        return cls(F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z"))

    @classmethod
    def lit(cls, x: float, y: float, z: float) -> V3:
        return cls(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))

    def cross(self, o: V3) -> V3:
        return V3(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def det(self, b: V3, c: V3) -> Column:
        """The determinant of three vectors as rows."""
        return self.dot(b.cross(c))

    def project(self, dim: Column) -> V2:
        """The two components after ``dim``, cyclically."""
        x, y, z = self.parts()
        pick = lambda a, b, c: F.when(dim == 0, a).when(dim == 1, b).otherwise(c)
        return V2(pick(y, z, x), pick(z, x, y))


@dataclass
class Triangle:
    """Three corners as expressions."""

    a: V3
    b: V3
    c: V3

    @classmethod
    def of(cls) -> Triangle:
        return cls(V3.of("a"), V3.of("b"), V3.of("c"))

    def edge_vectors(self) -> tuple[V3, V3, V3]:
        return self.a - self.b, self.a - self.c, self.b - self.c

    def normal(self) -> V3:
        return (self.b - self.a).cross(self.c - self.a)

    def double_area(self) -> Column:
        return self.normal().length()

    def signed_volume6(self) -> Column:
        """Six times the signed volume of the tetrahedron with the origin."""
        return self.a.det(self.b, self.c)

    def box(self) -> Box:
        return Box(self.a.least(self.b, self.c), self.a.greatest(self.b, self.c))

    def edge_squares(self) -> tuple[Column, Column, Column]:
        return tuple(e.len_squared() for e in (self.b - self.a, self.c - self.b, self.a - self.c))

    def centroid(self) -> V3:
        return (self.a + self.b + self.c) * F.lit(1 / 3)

    def project_2d(self, p: V3) -> V2:
        """A point on the coordinate plane that shows the triangle largest, its second axis turned so that the area is positive."""
        n = self.normal()
        dim = n.abs().max_dim()
        flat = p.project(dim)
        return V2(flat.x, F.when(n.at(dim) < 0, -flat.y).otherwise(flat.y))


@dataclass
class Box:
    """An axis-aligned box; touching boxes meet."""

    low: V3
    high: V3

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(V3.of(f"{prefix}min_"), V3.of(f"{prefix}max_"))

    def center(self) -> V3:
        return (self.low + self.high) * 0.5

    def dim(self) -> V3:
        return self.high - self.low

    def surface_area(self) -> Column:
        d = self.dim()
        return (d.y * d.z + d.x * d.z + d.x * d.y) * 2

    def scaled(self, k: Number) -> Box:
        """Grown or shrunk around its centre."""
        c, half = self.center(), self.dim() * 0.5 * _col(k)
        return Box(c - half, c + half)

    def contains_point(self, p: V3) -> Column:
        return _all(a <= b for a, b in zip(self.low.parts(), p.parts(), strict=True)) & _all(a <= b for a, b in zip(p.parts(), self.high.parts(), strict=True))

    def contains(self, o: Box) -> Column:
        return self.contains_point(o.low) & self.contains_point(o.high)

    def meets(self, o: Box) -> Column:
        return _all(a <= b for a, b in zip(self.low.parts(), o.high.parts(), strict=True)) & _all(a <= b for a, b in zip(o.low.parts(), self.high.parts(), strict=True))

    def misses(self, o: Box) -> Column:
        return ~self.meets(o)

    def is_empty(self) -> Column:
        return (self.high.x < self.low.x) | (self.high.y < self.low.y) | (self.high.z < self.low.z)

    def union(self, o: Box) -> Box:
        return Box(self.low.least(o.low), self.high.greatest(o.high))

    def intersection(self, o: Box) -> Box:
        return Box(self.low.greatest(o.low), self.high.least(o.high))

    def columns(self, prefix: str = "") -> list[Column]:
        return [*self.low.columns(f"{prefix}min_"), *self.high.columns(f"{prefix}max_")]


def seeded_vector(key: Column, low: float, high: float) -> V3:
    """A vector with components of [low, high) from a whole number: the same in every run, and in any engine with 64-bit integers."""

    def number(k: int) -> Column:
        state = (key * 1_103_515_245 + 12_345 * (k + 1)) % 2_147_483_648
        state = (state * 1_103_515_245 + 12_345) % 2_147_483_648
        return F.lit(low) + F.lit(high - low) * (state / F.lit(2_147_483_648.0))

    return V3(*map(number, range(3)))


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)
