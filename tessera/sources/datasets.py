"""Data sources by name: image files of scene layouts, sensor streams and meshes, read by parts.

``register(spark)`` makes them known to ``spark.read.format(..)``:

* ``tessera_frames``: pixels of the images of a dataset's layout; options ``dataset``, ``root`` and ``kind``
  (rgb, depth or seg). Files of other scenes and frames are neither listed nor opened where filters say so.
* ``tessera_sens``: frames of sensor streams; options ``path`` and ``skip``. Partitions are planned from a pass
  over the sizes of frames, which reads 96 bytes of each, and take byte ranges of a stream of any size.
* ``tessera_ply``: rows of an element of meshes; options ``path`` and ``element``. Partitions are byte ranges:
  rows of one size are found by their number, others by an index of every so many.

A schema given to the reader limits the columns; pixels, colour and depth that it leaves out are not
read. ``bytes`` is how much a partition takes, about. Paths must be reachable from Python tasks, see ``stores``.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
    StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.types import StructType

from tessera.sources import frames, stores
from tessera.sources.binary import FACE_LISTS, PLY_TYPES, decode_depth, ply_header, sens_header

#: Bytes of a partition by default, and of one read of a file that is indexed.
PART, READ = 128 << 20, 8 << 20

_TESTS = {
    EqualTo: lambda x, v: x == v, EqualNullSafe: lambda x, v: x == v, In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
}


@dataclass
class Part(InputPartition):
    """Rows of one or more files."""

    rows: list


class Pruned(DataSourceReader):
    """A reader that decides filters on its ``keys``, columns without nulls, before files are read."""

    keys: tuple[str, ...] = ()

    def __init__(self, schema: StructType, options: dict):
        self.columns, self.options = schema.names, dict(options)
        self.part = int(options.get("bytes", PART))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) not in (*_TESTS, IsNotNull) or len(f.attribute) > 1 or f.attribute[0] not in self.keys:
                yield f
            elif type(f) is not IsNotNull:
                self.tests.append(f)

    def read(self, partition: Part | None) -> Iterator[tuple]:
        """Rows of a partition; none where no file is left to plan."""
        return iter(()) if partition is None else self.rows_of(partition)

    def fits(self, **values) -> bool:
        return all(_TESTS[type(f)](values[f.attribute[0]], f.value) for f in self.tests if f.attribute[0] in values)

    def paths(self) -> list[tuple[str, int]]:
        """(path, bytes) of the files of the option path, a glob or a JSON list of them, that filters on path leave."""
        path = self.options["path"]
        patterns = json.loads(path) if path.startswith("[") else [path]
        return [(p, n) for pattern in patterns for p, n in stores.listed(pattern) if self.fits(path=p)]

    def planned(self, plan, files: list) -> list[Part]:
        """The partitions that ``plan`` makes of each file, several files at a time."""
        with ThreadPoolExecutor(16) as pool:
            return [p for parts in pool.map(plan, files) for p in parts]

    def ordered(self, rows: Iterable[dict]) -> Iterator[tuple]:
        for r in rows:
            yield tuple(r[c] for c in self.columns)


def bundles(files: list[tuple], size_of, limit: int) -> list[Part]:
    """Files in groups of about ``limit`` bytes."""
    out, held = [], 0
    for f in files:
        if not out or held + size_of(f) > limit:
            out.append(Part([]))
            held = 0
        out[-1].rows.append(f)
        held += size_of(f)
    return out


# --- Images of a layout ---------------------------------------------------------------------------


class FrameReader(Pruned):
    keys = ("seq", "frame_id", "path")

    def partitions(self) -> list[Part]:
        template, root = frames.layout(self.options["dataset"])[self.options.get("kind", "depth")], self.options["root"].rstrip("/")
        rest = template.removeprefix("{seq}/")
        folder, _, name = rest.rpartition("/")
        number = re.compile(re.escape(name).replace(r"\{frame\}", r"(\d+)"))

        def of_scene(scene: str) -> list[tuple]:
            found = []
            for path, size in stores.children(f"{scene}/{folder}" if folder else scene):
                m = number.fullmatch(path.rsplit("/", 1)[1])
                if m and size is not None and self.fits(frame_id=int(m[1]), path=path):
                    found.append((scene.rsplit("/", 1)[1], int(m[1]), path, size))
            return found

        scenes = [p for p, size in stores.children(root) if size is None and self.fits(seq=p.rsplit("/", 1)[1])]
        return bundles(self.planned(of_scene, scenes), lambda f: f[3], self.part)

    def rows_of(self, partition: Part) -> Iterator[tuple]:
        from tessera.sources.images import decode_png

        pixels = {"v", "u", "value"} & {*self.columns}
        for seq, frame, path, size in partition.rows:
            about = {"seq": seq, "frame_id": frame, "path": path, "bytes": size}
            if not pixels:
                yield from self.ordered([about])
                continue
            with stores.opened(path) as f:
                image = decode_png(f.read())
            image = image if image.ndim == 2 else image[:, :, 0]
            for v, row in enumerate(image.tolist()):
                yield from self.ordered(about | {"v": v, "u": u, "value": x} for u, x in enumerate(row))


class FrameFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_frames"

    def schema(self) -> str:
        frames.layout(self.options["dataset"])  # an unknown name is an error at once
        return "seq string, frame_id int, path string, bytes long, v int, u int, value int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(schema, self.options)


# --- Sensor streams -------------------------------------------------------------------------------

#: Before each frame: its pose, two times and two sizes.
_FRAME = "<16f4Q"
_HEAD = struct.calcsize(_FRAME)


class SensReader(Pruned):
    keys = ("path", "idx")

    def partitions(self) -> list[Part]:
        skip = int(self.options.get("skip", 1))
        payload = [c in self.columns for c in ("color", "depth")]

        def of_stream(file: tuple[str, int]) -> list[Part]:
            parts, held = [], 0
            with stores.opened(file[0]) as f:
                header, count = sens_header(f)
                at = f.tell()
                for i in range(count):
                    f.seek(at)
                    sizes = struct.unpack(_FRAME, f.read(_HEAD))[18:]
                    if i % skip == 0 and self.fits(idx=i):
                        cost = _HEAD + sum(n for n, wanted in zip(sizes, payload) if wanted)
                        if not parts or held + cost > self.part:
                            parts.append(Part([file[0], header, []]))
                            held = 0
                        parts[-1].rows[2].append((i, at))
                        held += cost
                    at += _HEAD + sum(sizes)
            return parts

        return self.planned(of_stream, self.paths())

    def rows_of(self, partition: Part) -> Iterator[tuple]:
        from tessera.sources.images import encode_png

        path, header, places = partition.rows
        if "color" in self.columns and header["color_codec"] != "jpeg":
            raise ValueError(f"unknown color codec {header['color_codec']}")
        with stores.opened(path) as f:
            for i, at in places:
                f.seek(at)
                *pose, t_color, t_depth, n_color, n_depth = struct.unpack(_FRAME, f.read(_HEAD))
                row = {"path": path, "idx": i, "pose": pose, "ts_color": t_color, "ts_depth": t_depth}
                if "color" in self.columns:
                    row["color"] = f.read(n_color)
                if "depth" in self.columns:
                    f.seek(at + _HEAD + n_color)
                    image = decode_depth(f.read(n_depth), header["depth_codec"], header["depth_height"], header["depth_width"])
                    row["depth"] = encode_png(image.astype(np.uint16))
                yield from self.ordered([row])


class SensorStreams(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_sens"

    def schema(self) -> str:
        return "path string, idx int, pose array<float>, ts_color long, ts_depth long, color binary, depth binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SensReader(schema, self.options)


class SensHeaderReader(Pruned):
    keys = ("path",)

    def partitions(self) -> list[Part]:
        return bundles(self.paths(), lambda f: 1, 64)

    def rows_of(self, partition: Part) -> Iterator[tuple]:
        for path, _ in partition.rows:
            with stores.opened(path) as f:
                header, count = sens_header(f)
            yield from self.ordered([header | {"path": path, "frames": count}])


class SensorHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_sens_header"

    def schema(self) -> str:
        matrices = ", ".join(f"{a}_{b} array<float>" for a in ("intrinsic", "extrinsic") for b in ("color", "depth"))
        sizes = ", ".join(f"{s} long" for s in ("color_width", "color_height", "depth_width", "depth_height"))
        return f"path string, sensor string, {matrices}, color_codec string, depth_codec string, {sizes}, depth_shift double, frames long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SensHeaderReader(schema, self.options)


# --- Meshes ---------------------------------------------------------------------------------------


class _Steps:
    """A file read on in blocks of ``READ`` bytes, with no more held than is not used yet."""

    def __init__(self, path: str, at: int):
        self.file, self.at, self.data, self.off = stores.opened(path), at, b"", 0
        self.file.seek(at)

    def take(self, n: int) -> memoryview:
        while len(self.data) - self.off < n:
            more = self.file.read(max(READ, n))
            if not more:
                raise EOFError("a mesh file ends early")
            self.data, self.off = self.data[self.off :] + more, 0
        self.off += n
        self.at += n
        return memoryview(self.data)[self.off - n : self.off]

    def line(self) -> bytes:
        while (end := self.data.find(b"\n", self.off)) < 0:
            more = self.file.read(READ)
            if not more:
                end = len(self.data)
                break
            self.data, self.off = self.data[self.off :] + more, 0
        out = self.data[self.off : end]
        self.at += len(out) + 1
        self.off = end + 1
        return out


def _fixed(props: list, order: str) -> np.dtype | None:
    return None if any(kind[0] == "list" for _, kind in props) else np.dtype([(p, order + PLY_TYPES[kind[0]]) for p, kind in props])


def _uniform(props: list, order: str, sizes: list[int]) -> np.dtype:
    """Rows whose lists have these lengths."""
    sizes, fields = list(sizes), []
    for p, kind in props:
        if kind[0] == "list":
            fields += [(f"{p} n", order + PLY_TYPES[kind[1]]), (p, order + PLY_TYPES[kind[2]], (sizes.pop(0),))]
        else:
            fields.append((p, order + PLY_TYPES[kind[0]]))
    return np.dtype(fields)


def _row(steps: _Steps, props: list, order: str) -> dict:
    """One binary row of any size."""
    out = {}
    for p, kind in props:
        if kind[0] == "list":
            n = int(np.frombuffer(steps.take(np.dtype(PLY_TYPES[kind[1]]).itemsize), order + PLY_TYPES[kind[1]])[0])
            out[p] = np.frombuffer(steps.take(n * np.dtype(PLY_TYPES[kind[2]]).itemsize), order + PLY_TYPES[kind[2]]).tolist()
        else:
            out[p] = np.frombuffer(steps.take(np.dtype(PLY_TYPES[kind[0]]).itemsize), order + PLY_TYPES[kind[0]])[0].item()
    return out


def _text_row(line: bytes, props: list) -> dict:
    w, k, out = line.split(), 0, {}
    for p, kind in props:
        if kind[0] == "list":
            n = int(w[k])
            out[p] = [int(x) if PLY_TYPES[kind[2]][0] != "f" else float(x) for x in w[k + 1 : k + 1 + n]]
            k += 1 + n
        else:
            out[p] = float(w[k]) if PLY_TYPES[kind[0]][0] == "f" else int(w[k])
            k += 1
    return out


class PlyReader(Pruned):
    keys = ("path",)

    def partitions(self) -> list[Part]:
        element = self.options.get("element", "vertex")

        def of_mesh(file: tuple[str, int]) -> list[Part]:
            path, size = file
            with stores.opened(path) as f:
                form, elements, at = ply_header(f)
            order = ">" if form == "binary_big_endian" else "<"
            for name, n, props in elements:
                last = name == elements[-1][0]
                if form == "ascii":
                    parts, at = self.by_lines(path, at, n, props, name == element)
                elif dtype := _fixed(props, order):
                    parts = self.by_number(path, at, n, props, dtype)
                    at += dtype.itemsize * n
                elif last and name == element and n and (dtype := self.of_one_size(path, at, n, props, order, size - at)):
                    parts = self.by_number(path, at, n, props, dtype)
                elif last and name != element:
                    parts = []
                else:
                    parts, at = self.by_index(path, at, n, props, order)
                if name == element:
                    return parts
            return []

        return self.planned(of_mesh, self.paths())

    def by_number(self, path: str, at: int, n: int, props: list, dtype: np.dtype) -> list[Part]:
        step = max(1, self.part // dtype.itemsize)
        return [Part([path, "fixed", props, dtype.descr, i, min(step, n - i), at + i * dtype.itemsize]) for i in range(0, n, step)]

    def of_one_size(self, path: str, at: int, n: int, props: list, order: str, left: int) -> np.dtype | None:
        """The layout of all rows, if lists as long as the first row's fill what is left of the file and a pass over the lengths agrees."""
        first = _row(_Steps(path, at), props, order)
        sizes = [len(first[p]) for p, kind in props if kind[0] == "list"]
        dtype = _uniform(props, order, sizes)
        if dtype.itemsize * n != left:
            return None
        steps, step = _Steps(path, at), max(1, READ // dtype.itemsize)
        for i in range(0, n, step):
            rows = np.frombuffer(steps.take(min(step, n - i) * dtype.itemsize), dtype)
            if any((rows[name] != k).any() for name, k in zip([x for x in dtype.names if x.endswith(" n")], sizes)):
                return None
        return dtype

    def by_index(self, path: str, at: int, n: int, props: list, order: str) -> tuple[list[Part], int]:
        """A partition every ``bytes`` bytes, from a pass over all rows; where the element ends."""
        steps, parts, start, first = _Steps(path, at), [], at, 0
        for i in range(n):
            _row(steps, props, order)
            if steps.at - start >= self.part or i == n - 1:
                parts.append(Part([path, "any", props, order, first, i + 1 - first, start]))
                start, first = steps.at, i + 1
        return parts, steps.at

    def by_lines(self, path: str, at: int, n: int, props: list, wanted: bool) -> tuple[list[Part], int]:
        """The same of an element of n lines; lines are counted by blocks."""
        parts, start, first, seen = [], at, 0, 0
        with stores.opened(path) as f:
            f.seek(at)
            while seen < n:
                block = f.read(READ)
                if not block:
                    parts.append(Part([path, "text", props, "", first, n - first, start]))
                    break
                lines = block.count(b"\n")
                if seen + lines >= n:
                    ends = np.flatnonzero(np.frombuffer(block, np.uint8) == 10)
                    at += int(ends[n - seen - 1]) + 1
                    seen = n
                    parts.append(Part([path, "text", props, "", first, n - first, start]))
                else:
                    seen, end = seen + lines, at + block.rfind(b"\n") + 1
                    at += len(block)
                    if wanted and lines and end - start >= self.part:
                        parts.append(Part([path, "text", props, "", first, seen - first, start]))
                        start, first = end, seen
        return parts if wanted else [], at

    def rows_of(self, partition: Part) -> Iterator[tuple]:
        path, kind, props, form, first, n, at = partition.rows
        steps = _Steps(path, at)

        def rows() -> Iterator[dict]:
            if kind == "fixed":
                dtype = np.dtype([tuple(d) for d in form])
                step = max(1, READ // dtype.itemsize)
                for i in range(0, n, step):
                    block = np.frombuffer(steps.take(min(step, n - i) * dtype.itemsize), dtype)
                    names = [p for p in block.dtype.names if not p.endswith(" n")]
                    for values in zip(*(block[p].tolist() for p in names)):
                        yield dict(zip(names, values))
            elif kind == "any":
                for _ in range(n):
                    yield _row(steps, props, form)
            else:
                for _ in range(n):
                    yield _text_row(steps.line(), props)

        lists = next((p for p, k in props if p in FACE_LISTS and k[0] == "list"), None)
        value = self.options.get("value")
        for i, r in enumerate(rows()):
            r = r | {"path": path, "row": first + i}
            r["verts"] = r.get(lists, []) if lists else []
            if value:
                r["value"] = None if value not in r else int(r[value])
            yield tuple(float(r[c]) if c in "xyz" else r[c] for c in self.columns)


class Meshes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_ply"

    def schema(self) -> str:
        if self.options.get("element", "vertex") == "vertex":
            return "path string, row long, x double, y double, z double"
        return "path string, row long, verts array<int>" + (", value int" if "value" in self.options else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return PlyReader(schema, self.options)


SOURCES = (FrameFiles, SensorStreams, SensorHeaders, Meshes)


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session, filters included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in SOURCES:
        spark.dataSource.register(source)


def load(spark: SparkSession, name: str, path: str | list[str], schema: str | None = None, **options):
    """Rows of a source over files that Spark knows, from any store that Python tasks can open."""
    register(spark)
    at = json.dumps([stores.reachable(spark, p) for p in ([path] if isinstance(path, str) else path)])
    reader = spark.read.format(name).option("path", at)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return (reader.schema(schema) if schema else reader).load()
