"""Text vectors without a model: hashed bags of tokens, normalised. A trained model can take their place behind the same signature."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.text import tokens


def embedded(text: Column, dims: int = 64) -> Column:
    """A unit vector of dims signed token counts; zeros for a text without tokens. Stays in Catalyst."""
    hashed = F.transform(tokens(text), lambda t: F.xxhash64(t))
    places = F.transform(hashed, lambda h: F.struct(F.pmod(h, F.lit(dims)).cast("int").alias("d"), F.when(F.pmod(F.shiftrightunsigned(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    summed = F.transform(F.array(places), lambda p: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(F.filter(p, lambda x: x["d"] == d), F.lit(0.0), lambda a, x: a + x["s"])))[0]

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))

    return F.transform(F.array(summed), unit)[0]
