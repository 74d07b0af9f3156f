"""Text meshes: parsing, a Spark data source ``off``, and writing.

A file has a header line OFF or COFF, a line of three counts, vertex lines of three numbers (COFF: and four colour values, which
are dropped) and face lines ``3 a b c``. ``#`` starts a comment; blank lines are skipped.
"""

from __future__ import annotations

import math
import re
import urllib.parse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from facetflow.operators.tables import write_table
from facetflow.operators.topology import dense_numbers
from facetflow.sources.derived import MeshFrame


class OffError(ValueError):
    """``code``: OFF_ERROR_BAD_HEADER, OFF_ERROR_READING_COUNTS, OFF_ERROR_READING_VERTICES, OFF_READ_DUPLICATE_VERTICES,
    OFF_NON_TRIANGULAR_FACE, OFF_ERROR_READING_FACES, OFF_FACE_INDEX_OUT_OF_RANGE, UNABLE_TO_OPEN_FILE.
    """

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def _numbers(fields: list[str], count: int, kind, code: str, line: str) -> list:
    if len(fields) != count:
        raise OffError(code, line)
    try:
        return [kind(x) for x in fields]
    except ValueError:
        raise OffError(code, line) from None


def parse(text: str, dedup: bool = False) -> tuple[list[tuple[float, float, float]], list[tuple[int, int, int]]]:
    """Vertices and faces; equal vertices are an error unless ``dedup`` makes them one."""
    lines = (x for x in (line.split("#", 1)[0].strip() for line in text.splitlines()) if x)
    header = next(lines, "")
    if header not in ("OFF", "COFF"):
        raise OffError("OFF_ERROR_BAD_HEADER", header)
    line = next(lines, "")
    n_vertices, n_faces, _ = _numbers(line.split(), 3, int, "OFF_ERROR_READING_COUNTS", line)
    vertices: list[tuple[float, float, float]] = []
    where: dict[tuple[float, ...], int] = {}
    index = []
    for _ in range(n_vertices):
        line = next(lines, "")
        x, y, z = _numbers(line.split(), 7 if header == "COFF" else 3, float, "OFF_ERROR_READING_VERTICES", line)[:3]
        if not all(map(math.isfinite, (x, y, z))):
            raise OffError("OFF_ERROR_READING_VERTICES", line)
        key = (x + 0.0, y + 0.0, z + 0.0)
        if key in where and not dedup:
            raise OffError("OFF_READ_DUPLICATE_VERTICES", line)
        if key not in where:
            where[key] = len(vertices)
            vertices.append((x, y, z))
        index.append(where[key])
    faces = []
    for _ in range(n_faces):
        line = next(lines, "")
        fields = line.split()
        if fields and fields[0].isdigit() and fields[0] != "3":
            raise OffError("OFF_NON_TRIANGULAR_FACE", line)
        _, a, b, c = _numbers(fields, 4, int, "OFF_ERROR_READING_FACES", line)
        if not all(0 <= v < n_vertices for v in (a, b, c)):
            raise OffError("OFF_FACE_INDEX_OUT_OF_RANGE", line)
        faces.append((index[a], index[b], index[c]))
    return vertices, faces


def render(vertices, faces, precision: int | None = 6) -> str:
    """The text of a mesh; ``precision`` significant digits, or None for numbers that read back exactly."""
    number = (lambda v: f"%.{precision}g" % v) if precision else repr
    rows = ["OFF", f"{len(vertices)} {len(faces)} 0", *(" ".join(map(number, v)) for v in vertices), *(f"3 {a} {b} {c}" for a, b, c in faces)]
    return "\n".join(rows) + "\n"


_ROWS = "mesh_id string, kind string, id long, x double, y double, z double, a long, b long, c long, status string"


def _rows(path: str, text: str, dedup: bool, permissive: bool):
    named = re.search(r"/mesh_id=([^/]+)/[^/]*$", path)  # as write_off names folders
    name = urllib.parse.unquote(named[1]) if named else path.rsplit("/", 1)[-1].removesuffix(".off")
    try:
        vertices, faces = parse(text, dedup)
    except OffError as error:
        if not permissive:
            raise
        yield (name, "error", None, None, None, None, None, None, None, error.code)
        return
    for k, (x, y, z) in enumerate(vertices):
        yield (name, "vertex", k, x, y, z, None, None, None, "ok")
    for k, (a, b, c) in enumerate(faces):
        yield (name, "triangle", k, None, None, None, a, b, c, "ok")


def read_off(spark: SparkSession, path: str, dedup: bool = False, permissive: bool = False, pieces: bool = False) -> MeshFrame:
    """All meshes under a path or pattern that Spark can read; ``mesh_id`` is the file's name, or that of the
    folder ``mesh_id=...`` it is in.

    A file is one row of bytes and is parsed in one task; ids start from 0 in each mesh (``topology.unique_ids`` makes them
    unique). With ``permissive`` a bad file is left out here and listed by ``read_errors``. With ``pieces`` a file is read by
    as many tasks as it has splits, for files that are too large for one (``_read_pieces``).
    """
    if pieces:
        mesh, errors = _read_pieces(spark, path, dedup)
        if not permissive and (bad := errors.first()):
            raise OffError(bad.status, bad.mesh_id)
        return mesh
    rows = _parsed(spark, path, dedup, permissive)
    return MeshFrame(rows.where("kind = 'vertex'").select("mesh_id", F.col("id").alias("vid"), "x", "y", "z"), rows.where("kind = 'triangle'").select("mesh_id", F.col("id").alias("tid"), "a", "b", "c"))


def read_errors(spark: SparkSession, path: str, dedup: bool = False, pieces: bool = False) -> DataFrame:
    if pieces:
        return _read_pieces(spark, path, dedup)[1]
    return _parsed(spark, path, dedup, True).where("kind = 'error'").select("mesh_id", "status")


def _parsed(spark: SparkSession, path: str, dedup: bool, permissive: bool) -> DataFrame:
    import pandas as pd

    names = [x.split()[0] for x in _ROWS.split(", ")]

    def parsed(parts):
        for part in parts:
            for where, content in zip(part["path"], part["content"], strict=True):
                got = list(_rows(where, content.decode("utf-8", "replace"), dedup, permissive))
                for low in range(0, len(got), 50_000):
                    frame = pd.DataFrame(got[low : low + 50_000], columns=names)
                    yield frame.astype({n: "Int64" for n in ("id", "a", "b", "c")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parsed, _ROWS)


#: Numbers as a line may hold them.
_REAL, _WHOLE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", r"^[+-]?\d+$"


def _read_pieces(spark: SparkSession, path: str, dedup: bool) -> tuple[MeshFrame, DataFrame]:
    """Meshes without errors, and (mesh_id, status) of the others, the first error of each; files are read by splits.

    A line's number is its place among the lines of its split, plus the lines of all splits before it: one row a split is summed.
    Lines are written to the scratch folder once, so that a split keeps its numbers. Files of one folder ``mesh_id=...`` follow
    each other by the number in ``part-...``: ``write_off`` with ``pieces`` writes them so.
    """
    name, folder = F.regexp_extract("file", r"([^/]*)$", 1), F.regexp_extract("file", r"/mesh_id=([^/]+)/[^/]*$", 1)
    plain = lambda c: F.url_decode(F.regexp_replace(c, r"\+", "%2B"))
    mesh_id = F.when(folder != "", plain(plain(folder))).otherwise(F.regexp_replace(plain(name), r"\.off$", "")).alias("mesh_id")  # values in names of folders are escaped themselves
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    text = spark.read.text(path).select(F.trim(F.regexp_replace(F.split("value", "#", 2)[0], r"\s+", " ")).alias("line"), *at)
    text = text.where("line <> ''").withColumn("id", F.monotonically_increasing_id())
    lines, _ = write_table(text.select(mesh_id, "file", "start", "id", "line"))
    files = spark.read.format("binaryFile").load(path).select(at[0]).select(mesh_id).distinct()
    split = lines.groupBy("mesh_id", "file", "start").agg(F.min("id").alias("first"), F.count("*").alias("lines"))
    part = F.coalesce(F.regexp_extract("file", r"/part-(\d+)[^/]*$", 1).try_cast("long"), F.lit(0))
    before = F.sum("lines").over(W.partitionBy("mesh_id").orderBy(part, "file", "start")) - F.col("lines")
    numbered = lines.join(split.withColumn("before", before), ["mesh_id", "file", "start"]).select("mesh_id", (F.col("id") - F.col("first") + F.col("before")).alias("number"), "line", F.split("line", " ").alias("f"))
    numbered, _ = write_table(numbered)

    whole = lambda k: F.get("f", F.lit(k)).try_cast("long")
    all_like = lambda fields, pattern: F.forall(fields, lambda x: x.rlike(pattern))
    heads = numbered.where("number < 2").groupBy("mesh_id").agg(F.max(F.when(F.col("number") == 0, F.col("line"))).alias("header"), F.max(F.when((F.col("number") == 1) & (F.size("f") == 3) & all_like(F.col("f"), _WHOLE), F.struct(whole(0).alias("v"), whole(1).alias("t")))).alias("n"))
    heads = heads.join(numbered.groupBy("mesh_id").agg(F.count("*").alias("lines")), "mesh_id")
    known = F.col("header").isin("OFF", "COFF")
    v, t, number = F.greatest(F.col("n.v"), F.lit(0)), F.greatest(F.col("n.t"), F.lit(0)), F.col("number")
    early = F.when(~known, F.struct(F.lit(0).cast("long").alias("number"), F.lit("OFF_ERROR_BAD_HEADER").alias("status")))
    early = early.when(F.col("n").isNull(), F.struct(F.lit(1).cast("long").alias("number"), F.lit("OFF_ERROR_READING_COUNTS").alias("status")))
    early = early.when(F.col("lines") < 2 + v, F.struct(F.col("lines").alias("number"), F.lit("OFF_ERROR_READING_VERTICES").alias("status")))
    early = early.when(F.col("lines") < 2 + v + t, F.struct(F.col("lines").alias("number"), F.lit("OFF_ERROR_READING_FACES").alias("status")))

    body = numbered.where("number >= 2").join(heads.where(known & F.col("n").isNotNull()), "mesh_id").where(number < 2 + v + t).withColumn("corner", number < 2 + v)
    fields, real = F.col("f"), [F.get("f", F.lit(k)).try_cast("double") for k in range(3)]
    good_vertex = (F.size("f") == F.when(F.col("header") == "COFF", 7).otherwise(3)) & all_like(fields, _REAL) & ~F.greatest(*[F.abs(x) for x in real]).isin(float("inf"))
    ids = [whole(k) for k in (1, 2, 3)]
    bad = F.when(F.col("corner"), F.when(~good_vertex, "OFF_ERROR_READING_VERTICES"))
    bad = bad.when(fields[0].rlike(r"^\d+$") & (fields[0] != "3"), "OFF_NON_TRIANGULAR_FACE").when((F.size("f") != 4) | ~all_like(fields, _WHOLE), "OFF_ERROR_READING_FACES")
    bad = bad.when(~F.coalesce(F.least(*ids) >= 0, F.lit(False)) | (F.greatest(*ids) >= v), "OFF_FACE_INDEX_OUT_OF_RANGE")
    body = body.select("mesh_id", "number", "corner", (number - 2 - F.when(F.col("corner"), 0).otherwise(v)).alias("id"), *[x.alias(c) for c, x in zip("xyz", real, strict=True)], *[x.alias(c) for c, x in zip("abc", ids, strict=True)], bad.alias("bad"))
    body, _ = write_table(body)
    found = heads.where(early.isNotNull()).select("mesh_id", early.alias("e")).union(body.where("bad IS NOT NULL").groupBy("mesh_id").agg(F.min(F.struct("number", F.col("bad").alias("status"))).alias("e")))
    zero = [(F.col(c) + 0.0).alias(c) for c in "xyz"]  # -0.0 is 0.0
    places = body.where("corner AND bad IS NULL").select("mesh_id", "number", "id", *zero)
    same = places.groupBy("mesh_id", "x", "y", "z").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    if not dedup:  # the second of equal vertices is the error
        later = places.join(same.where("n > 1"), ["mesh_id", "x", "y", "z"]).where("id > first")
        found = found.union(later.groupBy("mesh_id").agg(F.min(F.struct("number", F.lit("OFF_READ_DUPLICATE_VERTICES").alias("status"))).alias("e")))
    empty = files.join(lines.select("mesh_id").distinct(), "mesh_id", "left_anti")
    found = found.union(empty.select("mesh_id", F.struct(F.lit(0).cast("long").alias("number"), F.lit("OFF_ERROR_BAD_HEADER").alias("status"))))
    errors, _ = write_table(found.groupBy("mesh_id").agg(F.min("e").alias("e")).select("mesh_id", "e.status"))
    body = body.join(errors, "mesh_id", "left_anti")
    vertices = body.where("corner").select("mesh_id", F.col("id").alias("vid"), "x", "y", "z")
    triangles = body.where("NOT corner").select("mesh_id", F.col("id").alias("tid"), "a", "b", "c")
    if dedup:
        kept = same.join(errors, "mesh_id", "left_anti").select("mesh_id", F.col("first").alias("id"))
        new = dense_numbers(kept, "id")
        remap = places.join(same, ["mesh_id", "x", "y", "z"]).select("mesh_id", "id", "first").join(new.withColumnRenamed("id", "first"), ["mesh_id", "first"])
        vertices = vertices.join(new.withColumnRenamed("id", "vid"), ["mesh_id", "vid"]).select("mesh_id", F.col("new").alias("vid"), "x", "y", "z")
        for corner in "abc":
            triangles = triangles.join(remap.select("mesh_id", F.col("id").alias(corner), F.col("new").alias(f"new_{corner}")), ["mesh_id", corner])
        triangles = triangles.select("mesh_id", "tid", *[F.col(f"new_{c}").alias(c) for c in "abc"])
    return MeshFrame(vertices, triangles), errors


class OffSource(DataSource):
    """``spark.read.format("off").option("dedup", "true").load(path)``: a row per vertex and triangle, paths on a local or mounted disk.

    ``read_off`` reads through Spark's own file systems.
    """

    @classmethod
    def name(cls) -> str:
        return "off"

    def schema(self) -> str:
        return _ROWS

    def reader(self, schema) -> DataSourceReader:
        return _OffReader(self.options)


class _OffReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        import glob

        found = sorted(glob.glob(self.options["path"]))
        if not found:
            raise OffError("UNABLE_TO_OPEN_FILE", self.options["path"])
        return [InputPartition(p) for p in found]

    def read(self, partition):
        with open(partition.value, encoding="utf-8", errors="replace") as file:
            text = file.read()
        yield from _rows(partition.value, text, self.options.get("dedup", "") == "true", self.options.get("mode", "").lower() == "permissive")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OffSource)


def mesh_text(mesh: MeshFrame, precision: int | None = 6) -> DataFrame:
    """(mesh_id, text): each mesh's file, put together in one task per mesh; ids have to be dense (``topology.compact``)."""
    import pandas as pd

    kind = "mesh_id string, text string"
    v = mesh.vertices.select("mesh_id", "vid", "x", "y", "z").groupBy("mesh_id")
    t = mesh.triangles.select("mesh_id", "tid", "a", "b", "c").groupBy("mesh_id")

    def put(vertices: pd.DataFrame, triangles: pd.DataFrame) -> pd.DataFrame:
        v, t = vertices.sort_values("vid"), triangles.sort_values("tid")
        name = (v if len(v) else t)["mesh_id"].iloc[0]
        text = render(list(v[["x", "y", "z"]].itertuples(index=False, name=None)), list(t[["a", "b", "c"]].itertuples(index=False, name=None)), precision)
        return pd.DataFrame([(name, text)], columns=["mesh_id", "text"])

    return v.cogroup(t).applyInPandas(put, kind)


def mesh_lines(mesh: MeshFrame, precision: int | None = 6) -> DataFrame:
    """(mesh_id, number, line): the lines of each mesh's file, numbered; ids have to be dense (``topology.compact``). No mesh has to fit into a task.

    Numbers are rounded to ``precision`` significant digits, or read back exactly (None).
    """
    digits = (lambda x: F.format_string(f"%.{precision - 1}e", x).cast("double")) if precision else (lambda x: x)
    shown = lambda n: F.regexp_replace(digits(F.col(n).cast("double")).cast("string"), r"\.0(E|$)", "$1")
    count = lambda rows, name: rows.groupBy("mesh_id").agg(F.count("*").alias(name))
    sizes = count(mesh.vertices, "v").join(count(mesh.triangles, "t"), "mesh_id", "full").fillna(0, ["v", "t"])
    head = F.inline(F.array(F.struct(F.lit(0).cast("long").alias("number"), F.lit("OFF").alias("line")), F.struct(F.lit(1).cast("long").alias("number"), F.concat_ws(" ", "v", "t", F.lit("0")).alias("line"))))
    vertices = mesh.vertices.select("mesh_id", (F.col("vid") + 2).alias("number"), F.concat_ws(" ", *map(shown, "xyz")).alias("line"))
    faces = mesh.triangles.join(sizes, "mesh_id").select("mesh_id", (F.col("tid") + F.col("v") + 2).alias("number"), F.concat_ws(" ", F.lit("3"), *[F.col(n).cast("string") for n in "abc"]).alias("line"))
    return sizes.select("mesh_id", head).union(vertices).union(faces)


def write_off(mesh: MeshFrame, path: str, precision: int | None = 6, pieces: bool = False) -> None:
    """A folder per mesh (``mesh_id=...``) with its file.

    With ``pieces`` a mesh is written by several tasks, each of which has a range of its lines: the folder's files, one after the other, are the
    mesh's text. Spark's committer makes them seen together.
    """
    if pieces:
        rows = mesh_lines(mesh, precision).withColumn("mesh_id", F.coalesce("mesh_id", F.lit("")))  # not null: the order of lines then serves the writer as it is
        rows.repartitionByRange("mesh_id", "number").sortWithinPartitions("mesh_id", "number").select("mesh_id", "line").write.partitionBy("mesh_id").text(path)
        return
    text = mesh_text(mesh, precision).withColumn("text", F.regexp_replace("text", "\n$", ""))  # the writer ends lines
    text.write.partitionBy("mesh_id").text(path)


#: Names of a triangle's vertices and edges by slot.
VERTEX_NAMES, EDGE_NAMES = ("VertexA", "VertexB", "VertexC"), ("EdgeAB", "EdgeBC", "EdgeCA")


def tuple_text(*parts: Column, marks: str = "()") -> Column:
    """``(a, b, c)`` for ids, or with ``marks`` "[]" and "," between for coordinates: how rows are shown in logs."""
    between = ", " if marks == "()" else ","
    return F.concat(F.lit(marks[0]), F.concat_ws(between, *[p.cast("string") for p in parts]), F.lit(marks[1]))


def slot_name(slot: Column, names: tuple[str, ...] = EDGE_NAMES) -> Column:
    return F.get(F.array(*map(F.lit, names)), slot.cast("int"))


def polyline_text(points: DataFrame, key: str) -> DataFrame:
    """(key, pos, line): ``x y z`` of ordered points."""
    return points.select(key, "pos", F.concat_ws(" ", *[F.col(n).cast("string") for n in "xyz"]).alias("line"))
