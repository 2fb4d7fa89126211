"""8-bit scalar quantisation, by the least and greatest element of each vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the least range that a vector is scaled by.
LEAST_RANGE = 1e-10


def encode(vec: Column) -> Column:
    """A struct (q_min, q_max, q8): each element as trunc((x - min) * 255 / range + 0.5) in 0 .. 255."""
    low, high = F.array_min(vec).cast("double"), F.array_max(vec).cast("double")
    scale = F.lit(255.0) / F.greatest(high - low, F.lit(LEAST_RANGE))
    code = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") - low) * scale + 0.5).cast("int"))).cast("smallint")
    return F.struct(low.alias("q_min"), high.alias("q_max"), F.transform(vec, code).alias("q8"))


def decode(code: Column) -> Column:
    """The vector of a struct of encode(): a constant vector comes back as it was."""
    step = (code["q_max"] - code["q_min"]) / 255.0
    return F.transform(code["q8"], lambda q: q.cast("double") * step + code["q_min"])
