"""Image quality, occupancy and channel composition as aggregates over pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stabilising constants of the similarity index for 8-bit samples: (0.01 * 255)^2 and (0.03 * 255)^2.
C1, C2 = 6.5025, 58.5225


def roi_quality(pixels: DataFrame, key: str, reference: str, candidate: str) -> DataFrame:
    """Mean squared error, peak signal-to-noise ratio (infinite where there is no error) and structural
    similarity over all samples of each key, from one pass of means, variances and covariance."""
    a, b = F.col(reference).cast("double"), F.col(candidate).cast("double")
    s = pixels.groupBy(key).agg(F.avg((a - b) * (a - b)).alias("mse"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.covar_pop(a, b).alias("cab"))
    ssim = (2 * F.col("ma") * F.col("mb") + C1) * (2 * F.col("cab") + C2) / ((F.col("ma") ** 2 + F.col("mb") ** 2 + C1) * (F.col("va") + F.col("vb") + C2))
    psnr = F.when(F.col("mse") > 0, F.round(10 * F.log10(F.lit(65025.0) / F.col("mse")), 6)).when(F.col("mse") == 0, float("inf"))
    return s.select(key, F.round("mse", 6).alias("mse"), psnr.alias("psnr"), F.round(ssim, 6).alias("ssim"))


def geometry_overlap(pixels: DataFrame, key: str, first: str, second: str, *, background: int, tolerance: int = 12, min_iou: float = 0.75, max_xor: float = 0.25) -> DataFrame:
    """Overlap of the pixels that stand out from the background in either of two images: shared part
    and differing part of their union (1 and 0 where nothing stands out), and whether both are in bounds."""
    a, b = (F.abs(F.col(c) - background) > tolerance for c in (first, second))
    s = pixels.groupBy(key).agg(F.count_if(a & b).alias("both"), F.count_if(a | b).alias("any"), F.count_if(a != b).alias("one"))
    iou = F.when(F.col("any") == 0, 1.0).otherwise(F.col("both") / F.col("any"))
    xor = F.when(F.col("any") == 0, 0.0).otherwise(F.col("one") / F.col("any"))
    return s.select(key, F.round(iou, 9).alias("iou"), F.round(xor, 9).alias("xor_ratio"), ((iou >= min_iou) & (xor <= max_xor)).alias("passed"))


def composed(planes: DataFrame, by: list[str], mode: str) -> DataFrame:
    """Colour of each pixel from its channels (v, and the channel's colour r, g, b): the sum or the
    maximum of coloured samples, rounded half to even and cut to 8 bits. Samples stay integers until
    the end, so the result doesn't depend on the order of rows."""
    how = F.sum if mode == "sum" else F.max

    def plane(c: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(255), F.rint(how(F.col("v") * F.col(c)) / F.lit(255.0)))).cast("bigint").alias(c)

    return planes.groupBy(*by).agg(*map(plane, "rgb"))


def composed_floor(planes: DataFrame, by: list[str]) -> DataFrame:
    """The other composition rule: integer floor of each coloured sample, then the maximum."""
    one = lambda c: F.max(F.call_function("div", (F.col("v") * F.col(c)).cast("bigint"), F.lit(255).cast("bigint"))).alias(c)
    return planes.groupBy(*by).agg(*map(one, "rgb"))
