"""Binary layouts: PLY meshes, sensor streams, and numpy archives.

Paths are listed and read by Spark, so any store that Spark reads will do. ``LAYOUTS`` names the
readers; ``scan`` reads by name.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of masks in one archive.
ARCHIVE = 1 << 22
#: Types of PLY properties as numpy names them, and names of the list that holds a face's vertices.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
FACE_LISTS = ("vertex_indices", "vertex_index")


def ply_header(file) -> tuple[str, list[tuple[str, int, list]], int]:
    """(format, elements, where the data begin) of an open PLY file; an element is (name, rows, [(property, its words)])."""
    head = b""
    while b"end_header" not in head or b"\n" not in head[head.index(b"end_header") :]:
        more = file.read(1 << 16)
        if not more:
            raise ValueError("not a PLY file")
        head += more
    end = head.index(b"end_header")
    form, elements = "ascii", []
    for line in head[:end].decode("ascii", "replace").split("\n"):
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[-1], w[1:-1]))
    return form, elements, head.index(b"\n", end) + 1


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _expand(files: DataFrame, rows, schema: str) -> DataFrame:
    """The rows that ``rows`` (content -> DataFrame) makes of each file, with its path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                found = rows(data)
                for at in range(0, len(found), 100_000):
                    part = found.iloc[at : at + 100_000].copy()
                    part.insert(0, "path", path)
                    yield part

    return files.mapInPandas(run, f"path string, {schema}")


def scan_ply_points(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Columns path, point_id, x, y, z; a mesh is read by parts, see ``datasets``."""
    from tessera.sources.datasets import load

    return load(spark, "tessera_ply", path, element="vertex", **options).withColumnRenamed("row", "point_id")


def scan_ply_faces(spark: SparkSession, path: str | list[str], value: str = "category_id", **options) -> DataFrame:
    """Columns path, face_pos, verts, value: faces with one of their properties, null where they have none; read by parts."""
    from tessera.sources.datasets import load

    return load(spark, "tessera_ply", path, element="face", value=value, **options).withColumnsRenamed({"row": "face_pos", "value": value})


#: Codecs of sensor streams by number.
COLOUR_CODECS = {-1: "unknown", 0: "raw", 1: "png", 2: "jpeg"}
DEPTH_CODECS = {-1: "unknown", 0: "raw_ushort", 1: "zlib_ushort", 2: "occi_ushort"}


def sens_header(file) -> tuple[dict, int]:
    """(header, frames) of an open version 4 sensor stream, which is left where the frames begin."""

    def take(form: str):
        found = struct.unpack("<" + form, file.read(struct.calcsize("<" + form)))
        return found if len(found) > 1 else found[0]

    version = take("I")
    if version != 4:
        raise ValueError(f"sensor stream of version {version}, not 4")
    name = file.read(take("Q")).decode("utf-8", "replace")
    matrices = {k: list(take("16f")) for k in ("intrinsic_color", "extrinsic_color", "intrinsic_depth", "extrinsic_depth")}
    colour, depth = take("i"), take("i")
    header = {"sensor": name, **matrices, "color_codec": COLOUR_CODECS[colour], "depth_codec": DEPTH_CODECS[depth]}
    header |= dict(zip(("color_width", "color_height", "depth_width", "depth_height"), take("4I")))
    header["depth_shift"], count = take("f"), take("Q")
    return header, count


def encode_sens(header: dict, frames: list[dict]) -> bytes:
    """The stream of this header and these frames."""
    codes = {v: k for k, v in COLOUR_CODECS.items()}, {v: k for k, v in DEPTH_CODECS.items()}
    name = header["sensor"].encode()
    out = [struct.pack("<IQ", 4, len(name)), name]
    out += [struct.pack("<16f", *header[k]) for k in ("intrinsic_color", "extrinsic_color", "intrinsic_depth", "extrinsic_depth")]
    out.append(struct.pack("<ii", codes[0][header["color_codec"]], codes[1][header["depth_codec"]]))
    out.append(struct.pack("<4I", *(header[k] for k in ("color_width", "color_height", "depth_width", "depth_height"))))
    out.append(struct.pack("<fQ", header["depth_shift"], len(frames)))
    for f in frames:
        out.append(struct.pack("<16f4Q", *f["pose"], f["ts_color"], f["ts_depth"], len(f["color"]), len(f["depth"])))
        out += [f["color"], f["depth"]]
    return b"".join(out)


def decode_depth(data: bytes, codec: str, height: int, width: int) -> np.ndarray:
    """A depth frame as uint16; codecs but zlib and raw are errors."""
    if codec not in ("zlib_ushort", "raw_ushort"):
        raise ValueError(f"unknown depth codec {codec}")
    return np.frombuffer(zlib.decompress(data) if codec == "zlib_ushort" else data, "<u2").reshape(height, width)


def scan_sens(spark: SparkSession, path: str | list[str], skip: int = 1, **options) -> DataFrame:
    """Columns path, idx, pose, ts_color, ts_depth, color (JPEG), depth (16-bit PNG): every skip-th frame. Colour of other codecs is an error.

    Streams of any size are read by ranges of frames, see ``datasets``; option schema leaves columns out.
    """
    from tessera.sources.datasets import load

    return load(spark, "tessera_sens", path, skip=skip, **options)


def scan_sens_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Columns path, sensor, intrinsic and extrinsic matrices, codecs, sizes, depth shift and the number of frames; frames are not read."""
    from tessera.sources.datasets import load

    return load(spark, "tessera_sens_header", path)


def export_sens(spark: SparkSession, path: str | list[str], root: str, skip: int = 10) -> int:
    """Every skip-th frame of sensor streams as files below root, in a folder a stream: color/n.jpg, depth/n.png, pose/n.txt, and its two intrinsic matrices."""
    from tessera.sources.sinks import write_files

    stream = F.regexp_extract("path", r"([^/]*?)(?:\.sens)?$", 1)
    rows = lambda m: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(12), F.lit(4)), lambda i: F.array_join(F.transform(F.slice(m, i + 1, 4), lambda x: x.cast("string")), " ")), "\n")
    frames = scan_sens(spark, path, skip).withColumn("to", stream)
    named = lambda kind, form: F.concat_ws("/", "to", F.lit(kind), F.concat(F.col("idx"), F.lit(f".{form}")))
    out = frames.select(F.explode(F.array(
        F.struct(named("color", "jpg").alias("name"), F.col("color").alias("content")), F.struct(named("depth", "png").alias("name"), F.col("depth").alias("content")),
        F.struct(named("pose", "txt").alias("name"), rows(F.col("pose")).cast("binary").alias("content")),
    )).alias("f")).select("f.*")
    heads = scan_sens_header(spark, path).withColumn("to", stream)
    for m in ("intrinsic_color", "intrinsic_depth"):
        out = out.unionByName(heads.select(F.concat_ws("/", "to", F.lit("intrinsic"), F.lit(f"{m}.txt")).alias("name"), rows(F.col(m)).cast("binary").alias("content")))
    return write_files(out, root)


def scan_predictions(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(points, meta) of archives with pred_masks, pred_score and pred_classes: seq, inst, point_id and seq, inst, class_id, score.

    A scene may come in parts, see ``prediction_archive``.
    """

    def load(data: bytes):
        return np.load(io.BytesIO(data), allow_pickle=False)

    def points(data: bytes) -> pd.DataFrame:
        a = load(data)
        p, i = np.nonzero(a["pred_masks"])
        return pd.DataFrame({"inst": i.astype("int32"), "point_id": p.astype("int64") + (int(a["first_point"]) if "first_point" in a else 0)})

    def meta(data: bytes) -> pd.DataFrame:
        a = load(data)
        if "first_point" in a:  # the first part has them
            return pd.DataFrame({"inst": [], "class_id": [], "score": []}).astype({"inst": "int32", "class_id": "int32", "score": float})
        return pd.DataFrame({"inst": np.arange(len(a["pred_score"]), dtype="int32"), "class_id": a["pred_classes"].astype("int32"), "score": a["pred_score"].astype(float)})

    files = _files(spark, path).where(~F.col("path").rlike(r"/semantic_instance_evaluation[^/]*$"))
    # once for each file, not for each row
    files = files.select(F.regexp_replace(F.substring_index("path", "/", -1), r"(\.part[1-9][0-9]*)?\.npz$", "").alias("path"), "content")
    a, b = _expand(files, points, "inst int, point_id long"), _expand(files, meta, "inst int, class_id int, score double")
    return a.select(F.col("path").alias("seq"), "inst", "point_id"), b.select(F.col("path").alias("seq"), "inst", "class_id", "score")


def prediction_archive(pred: DataFrame, meta: DataFrame, scene: DataFrame, cells: int = ARCHIVE) -> DataFrame:
    """Columns seq, name, content: archives of pred_masks, pred_score and pred_classes for each scene, also for one without instances.

    A scene whose masks take more than ``cells`` bytes comes in several: the first has the scene's name, the
    others a number behind it and, as first_point, the point that their masks begin with.
    """
    size = scene.groupBy("seq").agg((F.max("point_id") + 1).alias("n"))
    row = F.struct("inst", "class_id", "score")
    some = size.join(meta.groupBy("seq").agg(F.sort_array(F.collect_list(row)).alias("meta")), "seq", "left")
    step = F.greatest(F.lit(1), F.floor(F.lit(cells) / F.greatest(F.lit(1), F.size(F.coalesce("meta", F.array().cast(some.schema["meta"].dataType)))))).cast("long")
    some = some.withColumn("step", step)
    parts = some.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("step")))).alias("part"))
    held = pred.join(some.select("seq", "step"), "seq").select("seq", F.floor(F.col("point_id") / F.col("step")).alias("part"), "inst", "point_id")
    kind = dict(parts.dtypes)["seq"]

    def run(one: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        at = one.iloc[0]
        mine = [tuple(m.values()) if isinstance(m, dict) else tuple(m) for m in (at["meta"] if at["meta"] is not None else [])]
        inst, first = np.array([m[0] for m in mine], np.int64), int(at["part"] * at["step"])
        masks = np.zeros((min(int(at["n"]) - first, int(at["step"])), len(mine)), bool)
        points = points[points["inst"].isin(inst)]
        masks[points["point_id"].to_numpy(np.int64) - first, np.searchsorted(inst, points["inst"].to_numpy(np.int64))] = True
        out, more = io.BytesIO(), {"first_point": np.int64(first)} if first else {}
        np.savez(out, pred_masks=masks, pred_score=np.array([m[2] for m in mine], float), pred_classes=np.array([m[1] for m in mine], np.int32), **more)
        name = f"{at['seq']}.part{at['part']}.npz" if first else f"{at['seq']}.npz"
        return pd.DataFrame({"seq": [at["seq"]], "name": [name], "content": [out.getvalue()]})

    return parts.groupBy("seq", "part").cogroup(held.groupBy("seq", "part")).applyInPandas(run, f"seq {kind}, name string, content binary")


#: Readers by the name of their layout.
LAYOUTS = {"ply": scan_ply_points, "ply_faces": scan_ply_faces, "sens": scan_sens, "sens_header": scan_sens_header}


def scan(spark: SparkSession, layout: str, path: str | list[str], **options) -> DataFrame:
    """The rows of the files of a layout; an unknown layout is an error."""
    if layout not in LAYOUTS:
        raise NotImplementedError(f"unknown layout {layout!r}; known: {', '.join(LAYOUTS)}")
    return LAYOUTS[layout](spark, path, **options)
