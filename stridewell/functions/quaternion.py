"""Quaternion algebra as column expressions; structs x, y, z, w with the scalar last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quat(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"), w.alias("w"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"] + a["w"] * b["w"]


def times(a: Column, b: Column) -> Column:
    """Hamilton product."""
    return quat(
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
    )


def inverse(a: Column) -> Column:
    """Of a unit quaternion."""
    return quat(-a["x"], -a["y"], -a["z"], a["w"])


def geodesic(a: Column, b: Column) -> Column:
    """Angle between two rotations in radians, 0 to pi; either sign of a quaternion is the same rotation."""
    cos = F.abs(dot(a, b))
    return F.when(cos.isNotNull(), 2 * F.acos(F.least(F.lit(1.0), cos)))


def vector_norm(a: Column) -> Column:
    return F.sqrt(a["x"] * a["x"] + a["y"] * a["y"] + a["z"] * a["z"])


def relative_angle(a: Column, b: Column) -> Column:
    """Angle of inverse(a) * b by atan2, exact for small turns too."""
    r = times(inverse(a), b)
    return 2 * F.atan2(vector_norm(r), F.abs(r["w"]))


def axis_angle(a: Column) -> Column:
    """angle and unit axis; the identity has axis (1, 0, 0), a zero quaternion raises."""
    size = F.sqrt(dot(a, a))
    n = vector_norm(a)
    own = lambda c, still: F.when(n > 1e-12, a[c] / n).otherwise(F.lit(still))
    angle = F.when(size <= 1e-12, F.raise_error(F.lit("zero quaternion")).cast("double")).otherwise(2 * F.atan2(n, a["w"]))
    return F.struct(angle.alias("angle"), own("x", 1.0).alias("x"), own("y", 0.0).alias("y"), own("z", 0.0).alias("z"))


def rotation_vector(a: Column) -> Column:
    """Axis times angle of the shorter turn."""
    n, w = vector_norm(a), F.abs(a["w"])
    scale = F.when(n > 1e-12, 2 * F.atan2(n, w) / n).otherwise(F.lit(2.0)) * F.when(a["w"] < 0, -1.0).otherwise(1.0)
    return F.struct((a["x"] * scale).alias("x"), (a["y"] * scale).alias("y"), (a["z"] * scale).alias("z"))


def slerp(a: Column, b: Column, share: Column) -> Column:
    """The rotation ``share`` of the way from a to b on the shorter arc; linear where they are close."""
    raw = dot(a, b)
    sign = F.when(raw < 0, -1.0).otherwise(1.0)
    cos = F.least(F.lit(1.0), F.abs(raw))
    turn = F.acos(cos)
    near = cos > 0.9995
    wa = F.when(near, 1 - share).otherwise(F.try_divide(F.sin((1 - share) * turn), F.sin(turn)))
    wb = F.when(near, share).otherwise(F.try_divide(F.sin(share * turn), F.sin(turn))) * sign
    mixed = {c: a[c] * wa + b[c] * wb for c in "xyzw"}
    size = F.sqrt(sum((mixed[c] * mixed[c] for c in "yzw"), mixed["x"] * mixed["x"]))
    return quat(*(mixed[c] / size for c in "xyzw"))


def euler(a: Column) -> Column:
    """Angles about x, y and z in degrees."""
    x, y, z, w = (a[c] for c in "xyzw")
    return F.struct(
        F.degrees(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))).alias("x"),
        F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x))))).alias("y"),
        F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))).alias("z"),
    )
