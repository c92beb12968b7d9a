"""Image rules as table operators over pixel rows (image, x, y, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.functions.text import fixed


def otsu_threshold(pixels: DataFrame, group: str = "image_id", value: str = "value") -> DataFrame:
    """The grey level that splits each image best: greatest between-class variance.

    Only the histogram, at most 256 rows per image, is sorted. Lowest level on ties; an
    image of one level gives 0.
    """
    histogram = pixels.groupBy(group, F.col(value).alias("level")).agg(F.count("*").alias("n"))
    whole = W.partitionBy(group)
    upto = whole.orderBy("level").rowsBetween(W.unboundedPreceding, W.currentRow)
    mass = F.col("n") * F.col("level")
    sums = histogram.select(
        group, "level",
        F.sum("n").over(upto).alias("n0"), F.sum(mass).over(upto).alias("s0"),
        F.sum("n").over(whole).alias("n_all"), F.sum(mass).over(whole).alias("s_all"))
    n1 = F.col("n_all") - F.col("n0")
    # n0 * n1 * (mean0 - mean1)^2 written over whole numbers, so that equal splits tie exactly.
    whole_number = lambda c: F.col(c).cast("decimal(19,0)")
    gap = (whole_number("s0") * whole_number("n_all")
           - whole_number("s_all") * whole_number("n0")).cast("double")
    between = F.when(n1 > 0, gap * gap / (F.col("n0").cast("double") * n1)).otherwise(0.0)
    best = F.max(F.struct(between.alias("score"), (-F.col("level")).alias("neg")))
    return sums.groupBy(group).agg(best.alias("b"), F.count("*").alias("levels")).select(
        group, F.when(F.col("levels") > 1, -F.col("b.neg")).otherwise(0).cast("int").alias("threshold"))


def binarize(pixels: DataFrame, thresholds: DataFrame, group: str = "image_id",
             value: str = "value", invert: bool = False) -> DataFrame:
    """Add ``bit``: 255 above the image's threshold and 0 otherwise, or the reverse."""
    high, low = (0, 255) if invert else (255, 0)
    bit = F.when(F.col(value) > F.col("threshold"), high).otherwise(low)
    return pixels.join(thresholds, group).withColumn("bit", bit.cast("int"))


def _profile(pixels: DataFrame, axis: str, group: str, value: str) -> DataFrame:
    return pixels.groupBy(group, F.col(axis).alias("pos")).agg(F.sum(value).alias("total"))


def projection_profiles(pixels: DataFrame, group: str = "image_id", value: str = "value") -> DataFrame:
    """Row and column sums in long form: (image, axis, pos, total)."""
    rows = _profile(pixels, "y", group, value).withColumn("axis", F.lit("row"))
    cols = _profile(pixels, "x", group, value).withColumn("axis", F.lit("col"))
    return rows.unionByName(cols)


def profile_spread(pixels: DataFrame, group: str = "image_id", value: str = "value") -> DataFrame:
    """Population standard deviation of the row sums and of the column sums."""
    spread = lambda axis: F.stddev_pop(F.when(F.col("axis") == axis, F.col("total")))
    return projection_profiles(pixels, group, value).groupBy(group).agg(
        spread("row").alias("row_std"), spread("col").alias("col_std"))


def needs_rotation(spread: DataFrame, sizes: DataFrame, group: str = "image_id") -> DataFrame:
    """Add ``rotate_90``: a tall image whose columns vary much more than its rows.

    Every image keeps its row; one whose size is not known is not turned.
    """
    tall = F.col("height") > 1.5 * F.col("width")
    sideways = F.col("col_std") > 1.5 * F.col("row_std")
    return spread.join(sizes, group, "left").withColumn(
        "rotate_90", F.coalesce(tall & sideways, F.lit(False)))


def transformation_log(color: Column, target_size: Column, denoise: Column, deskew: Column,
                       skew_angle: Column, contrast: Column) -> Column:
    """Names of the steps applied to an image, in order."""
    steps = F.array(
        F.when(color, "grayscale_conversion"),
        F.when(target_size.isNotNull() & (target_size > 0),
               F.concat(F.lit("resize_to_"), target_size.cast("string"))),
        F.when(denoise, "denoising"),
        F.when(deskew, F.concat(F.lit("deskew_"), fixed(skew_angle, 2), F.lit("deg"))),
        F.when(contrast, "contrast_enhancement"),
        F.lit("binarization"),
        F.lit("morphological_ops"),
    )
    return F.array_compact(steps)
