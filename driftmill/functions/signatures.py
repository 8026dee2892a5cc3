"""Feature-row signatures and coordinate comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of a full feature row that hold policy values. Fixed values.
POLICY_PLACES = (*range(24, 48), *range(59, 62))
WIDTH = 76
STRUCTURAL = tuple(i for i in range(WIDTH) if i not in POLICY_PLACES)


def full_signature(features: Column) -> Column:
    """The row itself, without negative zeros."""
    return F.transform(features, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))


def structural(features: Column) -> Column:
    """The 49 places that no policy touches; null for rows of another width."""
    return F.when(F.size(features) == WIDTH, F.array(*[F.when(features[i] == 0, F.lit(0.0)).otherwise(features[i]) for i in STRUCTURAL]))


def signature_key(signature: Column) -> Column:
    return F.sha2(F.to_json(signature), 256)


def distance(a: Column, b: Column) -> Column:
    """Places that differ; rows of different length are an error."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("dimension mismatch"))).otherwise(differ)


def differing_places(a: Column, b: Column) -> Column:
    """array<struct<place, left, right>> of the places that differ."""
    zipped = F.transform(F.arrays_zip(a.alias("l"), b.alias("r")), lambda z, i: F.struct(i.alias("place"), z["l"].alias("left"), z["r"].alias("right")))
    return F.filter(zipped, lambda z: ~z["left"].eqNullSafe(z["right"]))


def named_coordinates(df: DataFrame, id_col: str, features: str, names: DataFrame) -> DataFrame:
    """(id, place, name, value) for the places listed in ``names`` (place, name)."""
    return df.select(id_col, F.posexplode(features).alias("place", "value")).join(names, "place").select(id_col, "place", "name", "value")
