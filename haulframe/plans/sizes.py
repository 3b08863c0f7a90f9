"""Size distribution and length-weight relation of one or all species."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulframe.functions.semantics import divide, first_by, power
from haulframe.operators.dedupe import keep_first
from haulframe.operators.filters import plausible_singles, sized
from haulframe.operators.joins import match_missing, present_in
from haulframe.operators.order_stats import (
    histogram, merged_values, quantiles, quantiles_of, upper_size_bound,
)
from haulframe.operators.reshape import add_steps, whole_count
from haulframe.plans.indicators import centimetres
from haulframe.sources import columns as C

UPPER_QUANTILE = 0.995
OUTLIER_DEVIATION = 1
CURVE_STEP_CM = 0.5

# Diagnosis texts of a point.
MISSING_VALUE = "Val. manquante"
VALUE_OK = "val. ok"
RELATION_UNKNOWN = "RTP inconnue"
RELATION_ABERRANT = "RTP aberrante"
RELATION_OK = "RTP ok"


def _fish(df: DataFrame, missing_counts: str) -> DataFrame:
    """Sized lines; the count is used as a weight.

    A missing count fails the job, or is left out with ``missing_counts="skip"``.
    """
    if missing_counts not in ("fail", "skip"):
        raise ValueError(f"unknown: {missing_counts}")
    count = whole_count(F.col(C.CATCHES))
    if missing_counts == "fail":
        missing = F.raise_error(F.lit("a sized line has no count")).cast("int")
        return sized(df).withColumn(C.CATCHES, F.when(F.col(C.CATCHES).isNull(), missing).otherwise(count))
    return sized(df.where(F.col(C.CATCHES).isNotNull()).withColumn(C.CATCHES, count))


def _bound(found: DataFrame) -> DataFrame:
    return found.withColumn("size_limit", upper_size_bound(F.col("upper_size")).cast("double"))


def size_bound(df: DataFrame, groups: Sequence[str] = (C.VERNACULAR,), missing_counts: str = "fail") -> DataFrame:
    """99.5 % quantile of size over single fish, and the axis end above it."""
    return _bound(quantiles(_fish(df, missing_counts), groups, C.SIZE, {"upper_size": UPPER_QUANTILE}, C.CATCHES))


def size_histogram(df: DataFrame, groups: Sequence[str] = (C.VERNACULAR,), missing_counts: str = "fail") -> DataFrame:
    """Fish per 10 mm class up to the size bound of their group."""
    groups = list(groups)
    values = merged_values(_fish(df, missing_counts), groups, C.SIZE, C.CATCHES)
    limit = _bound(quantiles_of(values, groups, {"upper_size": UPPER_QUANTILE}))
    per_size = match_missing(values, limit.select(*groups, "size_limit"), groups, "inner")
    return histogram(per_size, groups, "value", "w", high=F.col("size_limit"))


def legal_sizes(size_limits: DataFrame, order: str = C.ROW_ID) -> DataFrame:
    """Legal minimum size by vernacular name: the one on the first row."""
    return size_limits.groupBy(C.VERNACULAR).agg(
        first_by(C.LEGAL_SIZE, order).alias(C.LEGAL_SIZE)
    )


def with_legal_size(
    classes: DataFrame, size_limits: DataFrame, order: str = C.ROW_ID
) -> DataFrame:
    """Mark histogram classes that end at or below the legal minimum size."""
    joined = match_missing(classes, legal_sizes(size_limits, order), [C.VERNACULAR])
    return joined.withColumn("below_min", F.col("class_max") <= F.col(C.LEGAL_SIZE))


def length_weight_reference(
    coefficients: DataFrame, df: DataFrame, order: str = C.ROW_ID
) -> DataFrame:
    """One relation per species that occurs in the data."""
    first = keep_first(
        coefficients.select(
            C.SPECIES, order, F.col("a_FB").alias("a"), F.col("b_FB").alias("b"),
            F.col("origine_FB").alias("origin"),
        ),
        [C.SPECIES], order,
    )
    return present_in(first.drop(order), df, [C.SPECIES])


def length_weight_points(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Single fish with their predicted weight and a diagnosis.

    A predicted weight of 0 is an infinite deviation, so such points are
    aberrant without a division.
    """
    points = plausible_singles(df).withColumn("size_cm", centimetres(C.SIZE))
    points = points.withColumn("odd_value", (F.col("size_cm") == 0) | (F.col(C.WEIGHT) == 0))
    points = match_missing(points, reference, [C.SPECIES]).withColumn(
        "predicted_g", F.col("a") * power("size_cm", "b")
    )
    gap = F.abs(F.col(C.WEIGHT) - F.col("predicted_g"))
    aberrant = F.when((F.col("predicted_g") == 0) & (gap > 0), F.lit(True)).otherwise(
        divide(gap, "predicted_g") > OUTLIER_DEVIATION
    )
    points = points.withColumns({"gap_g": gap, "odd_relation": aberrant})
    relation = (
        F.when(F.col("odd_relation").isNull(), RELATION_UNKNOWN)
        .when(F.col("odd_relation"), RELATION_ABERRANT)
        .otherwise(RELATION_OK)
    )
    text = F.when(F.col("odd_value"), MISSING_VALUE).when(
        ~F.col("odd_value"), F.concat(F.lit(VALUE_OK + " / "), relation)
    )
    return points.withColumns({
        "outlier": F.col("odd_value") | F.col("odd_relation"), "diagnosis": text,
    })


def relation_available(points: DataFrame) -> DataFrame:
    """One row: is there any point with a known relation?"""
    return points.agg(
        F.coalesce(F.max(F.col("a").isNotNull()), F.lit(False)).alias("available")
    )


def length_weight_curve(
    points: DataFrame, groups: Sequence[str] = (C.SPECIES,), step: float = CURVE_STEP_CM
) -> DataFrame:
    """Predicted weight from size 0 to the largest valid size, per group.

    Without a valid point, or without a relation, there is no curve.
    """
    ends = (
        points.where(~F.col("odd_value"))
        .groupBy(*groups)
        .agg(
            F.max("size_cm").alias("end"),
            first_by("a", C.ROW_ID).alias("a"),
            first_by("b", C.ROW_ID).alias("b"),
            first_by("origin", C.ROW_ID).alias("origin"),
            F.max(F.col("a").isNotNull()).alias("known"),
        )
        .where("known")
        .drop("known")
    )
    return add_steps(ends, "end", step, "curve_cm").drop("end").withColumn(
        "curve_g", F.col("a") * power("curve_cm", "b")
    )
