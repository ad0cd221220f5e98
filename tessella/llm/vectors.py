"""Rows of a table of vectors that take part, shared by the operators on embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def finite(vector: Column | str) -> Column:
    """Whether a vector is there and none of its components is null or not finite."""
    bound = F.lit(float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < bound))


def of_one_length(rows: DataFrame, vector: str, key: str, parts: int = 1) -> tuple[DataFrame, int]:
    """Rows as long as the vector of the smallest key, among lengths that are positive multiples of parts; and that length.

    Vectors of different lengths can't be compared; without any row the length is 0.
    """
    fits = rows.where((F.size(vector) > 0) & (F.size(vector) % parts == 0))
    first = fits.select(F.size(vector).alias("n"), key).orderBy(F.col(key).asc_nulls_last(), "n").limit(1).collect()
    length = first[0].n if first else 0
    return fits.where(F.size(vector) == length), length


def floors(vector: Column | str, scale: int, bound: int) -> Column:
    """Integers floor(scale * x) of the components as doubles; beyond plus or minus bound they are held at it."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(float(-bound)), F.least(F.lit(float(bound)), x.cast("double") * scale))))
