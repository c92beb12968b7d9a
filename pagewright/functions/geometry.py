"""Box, point and resize expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Canvas sizes and bounds of the resize rules.
MAX_IMAGE_DIMENSION = 2048
DETECTOR_SQUARE = 1280
DETECTOR_MAGNIFY = 1.5
DETECTOR_MULTIPLE = 32
RECOGNIZER_HEIGHT = 32
RECOGNIZER_WIDTH = 100


def corner_points(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The corners of an upright box: top-left, top-right, bottom-right, bottom-left."""
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))


def bbox(points: Column) -> Column:
    """Struct (x, y, w, h, area) of whole numbers around the points; truncates toward zero."""
    edge = lambda pick, axis: pick(F.transform(points, lambda p: p[axis].cast("int")))
    x, y = edge(F.array_min, "x"), edge(F.array_min, "y")
    w, h = edge(F.array_max, "x") - x, edge(F.array_max, "y") - y
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), (w * h).alias("area"))


def order_points(points: Column) -> Column:
    """Four points clockwise from top-left; the two with the least y are the top ones."""
    # Fields are zipped, which is compiled; a lambda over the points would be interpreted for every row.
    by_y = F.sort_array(F.arrays_zip(points["y"].alias("y"), points["x"].alias("x")))
    by_x = lambda part: F.sort_array(F.arrays_zip(part["x"].alias("x"), part["y"].alias("y")))
    return F.concat(by_x(F.slice(by_y, 1, 2)), F.reverse(by_x(F.slice(by_y, 3, 2))))


def rescale_points(points: Column, ratio_w: Column, ratio_h: Column) -> Column:
    return F.transform(
        points,
        lambda p: F.struct((p["x"] / ratio_w).alias("x"), (p["y"] / ratio_h).alias("y")),
    )


def crop_size(w: Column, h: Column) -> Column:
    """Struct (width, height, blank) of an upright crop, longer side first.

    Crops under 10 x 5 are blank ones of 100 x 32.
    """
    long, short = F.greatest(w, h).cast("int"), F.least(w, h).cast("int")
    blank = (long < 10) | (short < 5)
    return F.struct(
        F.when(blank, RECOGNIZER_WIDTH).otherwise(long).alias("width"),
        F.when(blank, RECOGNIZER_HEIGHT).otherwise(short).alias("height"),
        blank.alias("blank"),
    )


def resize_plan(w: Column, h: Column, max_dim: int = MAX_IMAGE_DIMENSION) -> Column:
    """Struct (width, height): the long side bounded by ``max_dim``, aspect kept."""
    fits = F.greatest(w, h) <= max_dim
    scaled = lambda side, long: F.when(side == long, max_dim).otherwise(
        (side * (F.lit(float(max_dim)) / F.nullif(long, F.lit(0)))).cast("int"))
    # A square has two long sides, and both become max_dim.
    long = F.greatest(w, h)
    return F.struct(
        F.when(fits, w).otherwise(scaled(w, long)).alias("width"),
        F.when(fits, h).otherwise(scaled(h, long)).alias("height"),
    )


def detector_resize_plan(w: Column, h: Column, square: int = DETECTOR_SQUARE,
                         magnify: float = DETECTOR_MAGNIFY) -> Column:
    """Struct (width, height, ratio, ratio_w, ratio_h) of the detector's canvas.

    Sides are floored to multiples of 32; ``ratio`` is the nominal scale, ``ratio_w`` and
    ``ratio_h`` are the true ones after flooring.
    """
    long = F.nullif(F.greatest(w, h), F.lit(0)).cast("double")
    ratio = F.least(magnify * long, F.lit(float(square))) / long
    side = lambda s: (F.floor((s * ratio).cast("int") / DETECTOR_MULTIPLE) * DETECTOR_MULTIPLE).cast("int")
    return F.struct(
        side(w).alias("width"), side(h).alias("height"), ratio.alias("ratio"),
        F.try_divide(side(w).cast("double"), w).alias("ratio_w"),
        F.try_divide(side(h).cast("double"), h).alias("ratio_h"),
    )


def recognizer_resize_plan(w: Column, h: Column, height: int = RECOGNIZER_HEIGHT,
                           width: int = RECOGNIZER_WIDTH) -> Column:
    """Struct (width, pad): scaled to a fixed height, cut at ``width``, padded up to it."""
    scaled = (height * F.try_divide(w.cast("double"), h)).cast("bigint")
    new_w = F.least(scaled, F.lit(width)).cast("int")
    return F.struct(new_w.alias("width"), (width - new_w).alias("pad"))


def normalized_skew(angle: Column, n_points: Column, min_points: int = 100,
                    negligible: float = 0.5) -> Column:
    """Skew angle folded into -45..45; 0 for too few ink points or a negligible angle."""
    folded = F.when(angle < -45, 90 + angle).when(angle > 45, angle - 90).otherwise(angle)
    return F.when((n_points < min_points) | (F.abs(folded) < negligible), 0.0).otherwise(folded)
