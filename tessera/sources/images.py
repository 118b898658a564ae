"""PNG images as pixel tables, and back. 8 and 16 bit, grey, RGB and RGBA, without interlacing."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray:
    """(height, width) or (height, width, channels), as uint8 or uint16."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, packed, header = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    width, height, depth, colour, _, _, interlace = header
    if depth not in (8, 16) or colour not in _CHANNELS or interlace:
        raise ValueError(f"unsupported PNG: {depth} bits, colour type {colour}, interlace {interlace}")
    step = _CHANNELS[colour] * depth // 8
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].copy()
        if kind == 1:
            line = np.add.accumulate(line.reshape(width, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            left, up = [0] * step, above.tolist()
            values = line.tolist()
            for i, v in enumerate(values):
                a = values[i - step] if i >= step else 0
                if kind == 3:
                    values[i] = (v + (a + up[i]) // 2) & 255
                else:
                    c = up[i - step] if i >= step else 0
                    p = a + up[i] - c
                    pa, pb, pc = abs(p - a), abs(p - up[i]), abs(p - c)
                    values[i] = (v + (a if pa <= pb and pa <= pc else up[i] if pb <= pc else c)) & 255
            line = np.array(values, np.uint8)
        out[y] = above = line
    image = out.view(">u2").astype(np.uint16) if depth == 16 else out
    channels = _CHANNELS[colour]
    return image.reshape(height, width) if channels == 1 else image.reshape(height, width, channels)


def encode_png(image: np.ndarray) -> bytes:
    """A grey uint8 or uint16 image, or an RGB uint8 one (height, width, 3), as PNG."""
    height, width = image.shape[:2]
    depth, colour = 16 if image.dtype == np.uint16 else 8, 2 if image.ndim == 3 else 0
    raw = image.astype(">u2").view(np.uint8).reshape(height, -1) if depth == 16 else image.astype(np.uint8).reshape(height, -1)
    packed = zlib.compress(np.hstack([np.zeros((height, 1), np.uint8), raw]).tobytes())
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + chunk(b"IDAT", packed) + chunk(b"IEND", b"")


def nearest(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image at another size, each pixel from the nearest below and to the left."""
    v, u = np.arange(height) * image.shape[0] // height, np.arange(width) * image.shape[1] // width
    return image[v][:, u]


def scan_pixels(spark: SparkSession, paths: str | list[str], resize: tuple[int, int] | None = None) -> DataFrame:
    """Columns path, v, u, value of the PNG files of a glob, one task a few files; resize: (height, width)."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                image = decode_png(data)
                image = image if image.ndim == 2 else image[:, :, 0]
                image = nearest(image, *resize) if resize else image
                v, u = np.indices(image.shape)
                yield pd.DataFrame({"path": path, "v": v.ravel().astype("int32"), "u": u.ravel().astype("int32"), "value": image.ravel().astype("int32")})

    return files.mapInPandas(run, "path string, v int, u int, value int")


def scan_depth(spark: SparkSession, paths: str | list[str], scale: float = 1000.0) -> DataFrame:
    """Columns path, v, u, depth in metres."""
    return scan_pixels(spark, paths).select("path", "v", "u", (F.col("value") / F.lit(scale)).cast("float").alias("depth"))


def scan_segmentation(spark: SparkSession, paths: str | list[str], resize: tuple[int, int] | None = None) -> DataFrame:
    """Columns path, v, u, mask_id; 0 is background."""
    return scan_pixels(spark, paths, resize).withColumnRenamed("value", "mask_id")


def scan_rgb(spark: SparkSession, paths: str | list[str], rgb: bool = True) -> DataFrame:
    """Columns path, height, width, channels, data: 8-bit images, rows of RGB (or BGR) bytes, by Spark's image reader."""
    images = spark.read.format("image").load(paths).select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    if not rgb:
        return images

    @F.pandas_udf("binary")
    def swapped(data: pd.Series, channels: pd.Series) -> pd.Series:
        turn = lambda d, c: np.frombuffer(d, np.uint8).reshape(-1, c)[:, [2, 1, 0, *range(3, c)]].tobytes() if c >= 3 else d
        return pd.Series([turn(d, c) for d, c in zip(data, channels)])

    return images.withColumn("data", swapped("data", "channels"))


def masks_as_png(image: DataFrame, height: int, width: int) -> DataFrame:
    """Columns seq, frame_id, content: a label image (seq, frame_id, v, u, mask_id) of each frame as PNG, 16 bit beyond 255 masks."""
    kinds = dict(image.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((height, width), np.uint16 if pdf["mask_id"].max() > 255 else np.uint8)
        out[pdf["v"], pdf["u"]] = pdf["mask_id"]
        return pd.DataFrame({"seq": [pdf["seq"].iloc[0]], "frame_id": [pdf["frame_id"].iloc[0]], "content": [encode_png(out)]})

    return image.groupBy("seq", "frame_id").applyInPandas(run, f"seq {kinds['seq']}, frame_id {kinds['frame_id']}, content binary")


def runs_as_png(runs: DataFrame, height: int, width: int) -> DataFrame:
    """The same of a label image as disjoint runs (seq, frame_id, mask_id, start, length) over places v * width + u."""
    kinds = dict(runs.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(height * width, np.uint16 if pdf["mask_id"].max() > 255 else np.uint8)
        for mask, start, length in zip(pdf["mask_id"], pdf["start"], pdf["length"]):
            out[start : start + length] = mask
        return pd.DataFrame({"seq": [pdf["seq"].iloc[0]], "frame_id": [pdf["frame_id"].iloc[0]], "content": [encode_png(out.reshape(height, width))]})

    return runs.groupBy("seq", "frame_id").applyInPandas(run, f"seq {kinds['seq']}, frame_id {kinds['frame_id']}, content binary")


def mask_pictures(pictures: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns seq, frame_id, content: each picture and the colours of its masks side by side at half size, as PNG.

    pictures: seq, frame_id, height, width, channels, data (rows of RGB bytes); labels: seq, frame_id,
    v, u, r, g, b of the pixels with a mask, the others are black. A picture without masks has a black half.
    """
    kinds = dict(pictures.dtypes)

    def run(key: tuple, one: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for height, width, channels, data in zip(one["height"], one["width"], one["channels"], one["data"]):
            left = np.frombuffer(data, np.uint8).reshape(height, width, channels)
            left = left[:, :, :3] if channels >= 3 else np.repeat(left[:, :, :1], 3, axis=2)
            right = np.zeros((height, width, 3), np.uint8)
            right[masks["v"].to_numpy(int), masks["u"].to_numpy(int)] = masks[["r", "g", "b"]].to_numpy(np.uint8)
            half = lambda x: nearest(x, max(1, height // 2), max(1, width // 2))
            out.append((*key, encode_png(np.hstack([half(left), half(right)]))))
        return pd.DataFrame(out, columns=["seq", "frame_id", "content"])

    keys = ["seq", "frame_id"]
    a = pictures.select(*keys, "height", "width", "channels", "data")
    b = labels.select(*keys, "v", "u", "r", "g", "b")
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(run, f"seq {kinds['seq']}, frame_id {kinds['frame_id']}, content binary")


def crops(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Columns of boxes + crop: the pixels of each box on a white square, as rows of bytes, for an external encoder.

    images: seq, frame_id, height, width, channels, data; boxes: seq, frame_id, .., u0, v0, u1, v1, side, pad_left, pad_top.
    """

    @F.pandas_udf("binary")
    def cut(data: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series, u0: pd.Series, v0: pd.Series, u1: pd.Series, v1: pd.Series, side: pd.Series, left: pd.Series, top: pd.Series) -> pd.Series:
        out = []
        for d, hh, ww, cc, a, b, e, f, s, x, y in zip(data, h, w, c, u0, v0, u1, v1, side, left, top):
            canvas = np.full((s, s, cc), 255, np.uint8)
            part = np.frombuffer(d, np.uint8).reshape(hh, ww, cc)[b:f, a:e]
            canvas[y : y + part.shape[0], x : x + part.shape[1]] = part
            out.append(canvas.tobytes())
        return pd.Series(out)

    met = boxes.join(images, ["seq", "frame_id"])
    return met.select(*boxes.columns, cut("data", "height", "width", "channels", "u0", "v0", "u1", "v1", "side", "pad_left", "pad_top").alias("crop"))
