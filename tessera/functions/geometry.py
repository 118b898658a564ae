"""Cameras and boxes as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_pose(pose: Column) -> Column:
    """False for a pose with an infinite entry; other oddities are not looked for."""
    return ~F.exists(pose, lambda x: F.abs(x) == float("inf"))


def valid_depth(depth: Column, trunc: float = 20.0) -> Column:
    return (depth > 0) & (depth < trunc)


def depth_metres(raw: Column, scale: float = 1000.0) -> Column:
    """Stored depth in metres, in single precision."""
    return (raw / F.lit(scale)).cast("float")


def camera_point(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column, Column]:
    """A pixel as a point before its camera."""
    return (u - cx) * depth / fx, (v - cy) * depth / fy, depth


def transform(pose: Column, x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    """A point moved by a row-major 4x4 camera-to-world matrix."""
    return tuple(pose[4 * r] * x + pose[4 * r + 1] * y + pose[4 * r + 2] * z + pose[4 * r + 3] for r in range(3))


def backproject(u: Column, v: Column, depth: Column, intr: Column, pose: Column) -> tuple[Column, ...]:
    """The world coordinates of a pixel; intr: struct of fx, fy, cx, cy."""
    return transform(pose, *camera_point(u, v, depth, intr["fx"], intr["fy"], intr["cx"], intr["cy"]))


def quaternion_rotation(w: Column, x: Column, y: Column, z: Column) -> Column:
    """The nine entries, row by row, of the rotation of a unit quaternion."""
    two = F.lit(2.0)
    return F.array(
        1 - two * (y * y + z * z), two * (x * y - w * z), two * (x * z + w * y),
        two * (x * y + w * z), 1 - two * (x * x + z * z), two * (y * z - w * x),
        two * (x * z - w * y), two * (y * z + w * x), 1 - two * (x * x + y * y),
    )


def rigid_inverse(rotation: Column, t: Column) -> Column:
    """The 4x4 inverse, row-major, of a world-to-camera rotation (nine entries) and translation (three)."""
    zero, rows = F.lit(0.0), []
    for c in range(3):
        column = [rotation[3 * r + c] for r in range(3)]
        rows += [*column, -(column[0] * t[0] + column[1] * t[1] + column[2] * t[2])]
    return F.array(*rows, zero, zero, zero, F.lit(1.0))


def gl_to_cv(pose: Column) -> Column:
    """A pose whose y and z axes are turned from up and back to down and forward."""
    return F.transform(pose, lambda x, i: F.when((i < 12) & ((i % 4 == 1) | (i % 4 == 2)), -x).otherwise(x))


#: Parameters of COLMAP camera models that give focal lengths and centre: positions of fx, fy, cx, cy.
CAMERA_MODELS = {
    "SIMPLE_PINHOLE": (0, 0, 1, 2), "PINHOLE": (0, 1, 2, 3), "SIMPLE_RADIAL": (0, 0, 1, 2), "RADIAL": (0, 0, 1, 2), "OPENCV": (0, 1, 2, 3),
    "OPENCV_FISHEYE": (0, 1, 2, 3), "FULL_OPENCV": (0, 1, 2, 3),
}


def intrinsics(model: Column, params: Column) -> Column:
    """Struct of fx, fy, cx, cy of a camera; an unknown model is an error."""
    out = F.raise_error(F.concat(F.lit("unknown camera model "), model)).cast("struct<fx:double,fy:double,cx:double,cy:double>")
    for name, places in CAMERA_MODELS.items():
        one = F.struct(*(params[i].cast("double").alias(k) for k, i in zip(("fx", "fy", "cx", "cy"), places)))
        out = F.when(model == name, one).otherwise(out)
    return out


def boxes_touch(a: dict[str, tuple[Column, Column]], b: dict[str, tuple[Column, Column]]) -> Column:
    """Closed boxes {axis: (min, max)} that share a point."""
    out = F.lit(True)
    for axis in a:
        out = out & (a[axis][0] <= b[axis][1]) & (b[axis][0] <= a[axis][1])
    return out


def inside_box(point: dict[str, Column], box: dict[str, tuple[Column, Column]]) -> Column:
    """A point strictly between the sides of a box."""
    out = F.lit(True)
    for axis, c in point.items():
        out = out & (c > box[axis][0]) & (c < box[axis][1])
    return out


def levels(lo: Column, hi: Column, limit: Column, level: Column, expansion: float = 0.1) -> tuple[Column, Column]:
    """One side of the crop of a level: the tight side widened by level times a tenth of its extent, clamped.

    The upper bound is exclusive, as in a slice.
    """
    grow = F.floor((hi - lo) * F.lit(expansion)) * level
    return F.greatest(F.lit(0), lo - grow), F.least(limit, hi + grow)


def square_padding(w: Column, h: Column) -> tuple[Column, Column, Column]:
    """(side, left, top) of a box centred on a square canvas."""
    side = F.greatest(w, h)
    return side, F.floor((side - w) / 2), F.floor((side - h) / 2)


def palette(i: Column) -> tuple[Column, Column, Column]:
    """(r, g, b) of a label: the bits of its number dealt to the channels in turn, highest first."""
    out = []
    for channel in range(3):
        c = F.lit(0)
        for j in range(8):
            bit = F.shiftright(i, 3 * j + channel).bitwiseAND(F.lit(1))
            c = c.bitwiseOR(F.shiftleft(bit, 7 - j))
        out.append(c)
    return tuple(out)


def gamma(c: Column, power: float = 1 / 2.2) -> Column:
    return F.pow(c, F.lit(power))
