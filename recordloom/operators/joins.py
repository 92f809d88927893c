"""A left join that keeps rows without a key apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_where_keyed(df: DataFrame, table: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """``df`` left-joined to ``table`` on ``keys``; rows whose first key is null
    match nothing, and the other keys compare null to null.

    All null keys have one hash, so a plain left join would send every row
    without a key to one task. Here such rows hash by the ``spread`` column
    instead. ``table`` has one row per key, and a key that very many rows share
    is left to the runtime, which splits the left side of a skewed outer join.
    """
    has = F.col(keys[0]).isNotNull()
    left = df.withColumns({"_has": has, "_at": F.when(has, F.xxhash64(*keys)).otherwise(F.xxhash64(spread))})
    right = table.withColumns({"_has0": F.lit(True), "_at0": F.xxhash64(*keys)})
    right = right.withColumnsRenamed({k: f"{k}0" for k in keys})
    same = (F.col("_at") == F.col("_at0")) & (F.col("_has") == F.col("_has0"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}0"))
    return left.join(right, same, "left").drop("_has", "_at", "_has0", "_at0", *[f"{k}0" for k in keys])
