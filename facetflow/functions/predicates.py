"""Geometric predicates as Column expressions: rays, segments, and exact orientation signs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetflow.functions.ext import K1
from facetflow.functions.vec import V2, V3, Box, Triangle, fdiv

#: Machine epsilon of the floating filter, and its coefficients by stage (point of intersection, edge, triangle).
EPS = 2.0**-52
FILTER = {"point": 10 * EPS + 64 * EPS**2, "edge": 20 * EPS + 256 * EPS**2, "triangle": 24 * EPS + 512 * EPS**2}


def inverse_direction(d: V3) -> V3:
    return V3(*(fdiv(F.lit(1.0), c) for c in d.parts()))


def ray_signs(d: V3) -> tuple[Column, ...]:
    """1 where the ray runs downwards."""
    return tuple((c < 0).cast("int") for c in d.parts())


def ray_meets_box(origin: V3, d: V3, box: Box) -> Column:
    """Slab test of the whole line along ``d``; components of ``d`` must not be 0."""
    inv = inverse_direction(d)
    near, far = [], []
    for o, i, down, low, high in zip(origin.parts(), inv.parts(), ray_signs(d), box.low.parts(), box.high.parts(), strict=True):
        near.append((F.when(down == 1, high).otherwise(low) - o) * i)
        far.append((F.when(down == 1, low).otherwise(high) - o) * i)
    return F.greatest(*near) <= F.least(*far)


def ray_triangle(origin: V3, d: V3, t: Triangle) -> tuple[Column, Column, V3]:
    """Whether a ray hits a triangle in front of its origin; the ray's parameter and barycentric coordinates."""
    a, b, c = t.a - origin, t.b - origin, t.c - origin
    ab, bc, ca = a.det(b, d), b.det(c, d), -a.det(c, d)
    whole, total = a.det(b, c), ab + bc + ca
    inside = (ab * whole >= 0) & (bc * whole >= 0) & (ca * whole >= 0) & (total != 0)
    at = fdiv(whole, total)
    hit = inside & F.when(total != 0, at > 0).otherwise(False)
    return hit, F.when(hit, at), V3(*(F.when(hit, fdiv(x, total)) for x in (bc, ca, ab)))


def segments_cross(p: V2, q: V2, r: V2, s: V2) -> Column:
    """Whether pq and rs cross properly: touching and collinear segments do not."""
    d1, d2 = (p - r).det(s - r), (q - r).det(s - r)
    d3, d4 = (r - p).det(q - p), (s - p).det(q - p)
    return (((d1 < 0) & (d2 > 0)) | ((d1 > 0) & (d2 < 0))) & (((d3 > 0) & (d4 < 0)) | ((d3 < 0) & (d4 > 0)))


def exact(p: V3) -> V3:
    """Integer coordinates, of 2^29 at most, as 64-bit integers."""
    return V3(*(c.cast("bigint") for c in p.parts()))


_LOW = 31
_MASK = (1 << _LOW) - 1
SIGNS = ("sp", "sq", "s1", "s2", "s3")


def triple(u: V3, cross: V3) -> tuple[Column, Column]:
    """u . cross as high * 2^31 + low, low in [0, 2^31): exact for 31-bit differences and their 62-bit cross products.

    The cross product's components are split at bit 31, so that both sums of products stay below 2^63.
    """
    high = low = None
    for x, y in zip(u.parts(), cross.parts(), strict=True):
        h, k = x * F.shiftright(y, _LOW), x * y.bitwiseAND(F.lit(_MASK))
        high, low = (h, k) if high is None else (high + h, low + k)
    return high + F.shiftright(low, _LOW), low.bitwiseAND(F.lit(_MASK))


def _sign(high: Column, low: Column) -> Column:
    """Of high * 2^31 + low, where low may have a few bits more than 31 or be negative."""
    carried, rest = high + F.shiftright(low, _LOW), low.bitwiseAND(F.lit(_MASK))
    return F.when(carried < 0, -1).when((carried > 0) | (rest > 0), 1).otherwise(0)


def orient3d(a: V3, b: V3, c: V3, d: V3) -> Column:
    """The exact sign of det[a-d, b-d, c-d] of integer points, in 64-bit arithmetic."""
    u, v, w = (a - d, b - d, c - d)
    return _sign(*triple(u, v.cross(w)))


def with_piercing_signs(rows: DataFrame, p: V3, q: V3, t: Triangle) -> DataFrame:
    """Adds the five orientation signs that decide whether an edge pq meets a triangle, all of integer points.

    With everything taken relative to p, four triple products hold all five. Differences, cross products and triple products
    are columns of steps of their own, so that each is computed once and generated code stays small.
    """
    known = lambda v: V3(*(F.coalesce(x, F.lit(0).cast("bigint")) for x in v.parts()))  # noqa: E731  without null checks for each operation
    p, names = known(p), {n: known(v) for n, v in (("q", q), ("a", t.a), ("b", t.b), ("c", t.c))}
    rows = rows.withColumns({f"_{n}{k}": x for n, v in names.items() for k, x in zip("xyz", (v - p).parts(), strict=True)})
    d = {n: V3.of(f"_{n}") for n in names}
    rows = rows.withColumns({f"_{u}{v}{k}": x for u, v in ("ab", "bc", "ca") for k, x in zip("xyz", d[u].cross(d[v]).parts(), strict=True)})
    products = {"0": triple(d["a"], V3.of("_bc")), "1": triple(d["q"], V3.of("_ab")), "2": triple(d["q"], V3.of("_bc")), "3": triple(d["q"], V3.of("_ca"))}
    rows = rows.withColumns({f"_{n}{i}": x for i, both in products.items() for n, x in zip("hl", both, strict=True)})
    h, k = ([F.col(f"_{n}{i}") for i in range(4)] for n in "hl")
    signs = [_sign(h[0], k[0]), _sign(h[0] - h[1] - h[2] - h[3], k[0] - k[1] - k[2] - k[3]), *(-_sign(h[i], k[i]) for i in (1, 2, 3))]
    return _behind_barrier(rows, dict(zip(SIGNS, signs, strict=True)))


def _behind_barrier(rows: DataFrame, made: dict[str, Column]) -> DataFrame:
    """Adds columns and drops those of the steps before. Filters on the new columns stay above: pushed down through the steps
    they would repeat each step's expressions in the next one's.
    """
    kept = [F.col(c) for c in rows.columns if not c.startswith("_")]
    return rows.select(*kept, F.inline(F.array(F.struct(*[x.alias(n) for n, x in made.items()]))))


def pierces() -> tuple[Column, Column]:
    """(meets, degenerate) of an edge and the open triangle, from the columns of ``with_piercing_signs``.

    Degenerate: a zero among the signs that decide. Degenerate pairs do not meet.
    """
    sp, sq, s1, s2, s3 = (F.col(n) for n in SIGNS)
    low, high = F.least(s1, s2, s3), F.greatest(s1, s2, s3)
    apart = (sp * sq > 0) | ((low < 0) & (high > 0))
    degenerate = ~apart & ((sp == 0) | (sq == 0) | (s1 == 0) | (s2 == 0) | (s3 == 0))
    return ~apart & ~degenerate, degenerate


def with_filtered_verdict(rows: DataFrame, p: V3, q: V3, t: Triangle, name: str = "verdict") -> DataFrame:
    """Adds the floating filter in exterior algebra: 'empty', 'meets' or 'maybe' of an edge and a triangle in doubles.

    Where they meet in the plane, whether that lies between the edge's ends, and within the triangle; each value has a
    bound of its rounding error, from the same products of absolute values. In steps, like the exact signs.
    """
    ends, corners = [K1.point(p), K1.point(q)], [K1.point(x) for x in (t.a, t.b, t.c)]
    made = {"e": ends[0].join(ends[1]), "t": corners[0].join(corners[1]).join(corners[2])}
    sizes = [x.absolute() for x in (*ends, *corners)]
    made |= {"ke": sizes[0].join(sizes[1]), "kt": sizes[2].join(sizes[3]).join(sizes[4])}
    rows = rows.withColumns({f"_{n}{k}": x for n, v in made.items() for k, x in zip(v.NAMES, v.e, strict=True)})
    at = lambda n, like, bound: type(like)(tuple(F.col(f"_{n}{k}") for k in like.NAMES), bound)
    edge, plane, edge_size, plane_size = (at(n, v, n.startswith("k")) for n, v in made.items())
    point, point_size = edge.meet(plane), edge_size.meet(plane_size)
    rows = rows.withColumns({f"_{n}{k}": x for n, v in (("p", point), ("kp", point_size)) for k, x in zip(v.NAMES, v.e, strict=True)})
    turn = F.when(F.col("_p3") < 0, -1.0).otherwise(1.0)
    point, point_size = K1(tuple(F.col(f"_p{k}") * turn for k in K1.NAMES)), at("kp", point, True)
    values = {}
    for k in range(2):
        a, b = [point if j == k else x for j, x in enumerate(ends)], [point_size if j == k else x for j, x in enumerate(sizes[:2])]
        values[f"_v{k}"], values[f"_k{k}"] = edge.inner(a[0].join(a[1])), edge_size.inner(b[0].join(b[1])) * FILTER["edge"]
    for k in range(3):
        a, b = [point if j == k else x for j, x in enumerate(corners)], [point_size if j == k else x for j, x in enumerate(sizes[2:])]
        values[f"_v{k + 2}"], values[f"_k{k + 2}"] = plane.inner(a[0].join(a[1]).join(a[2])), plane_size.inner(b[0].join(b[1]).join(b[2])) * FILTER["triangle"]
    rows = rows.withColumns(values)
    reliable = [F.abs(f"_v{k}") > F.col(f"_k{k}") for k in range(5)]
    outside, unsure = F.lit(False), F.lit(False)
    for k, sure in enumerate(reliable):
        outside, unsure = outside | (sure & (F.col(f"_v{k}") < 0)), unsure | ~sure
    flat = F.abs("_p3") <= F.col("_kp3") * FILTER["point"]
    return _behind_barrier(rows, {name: F.when(flat, "maybe").when(outside, "empty").when(unsure, "maybe").otherwise("meets")})
