"""Vector arithmetic on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def squared_distance(left: Column, right: Column) -> Column:
    gaps = F.zip_with(left, right, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x * x)


def l2_normalize(vector: Column) -> Column:
    """Scale to unit length as float32; a zero vector stays as it is, null stays null.

    The division sits in the finish step of the fold, so the length is computed once per vector
    and not once per element.
    """
    return F.aggregate(
        vector,
        F.lit(0.0),
        lambda total, x: total + x.cast("double") * x.cast("double"),
        lambda total: F.transform(
            vector, lambda x: F.when(total > 0, x / F.sqrt(total)).otherwise(x).cast("float")
        ),
    )
