"""Bounded samples of labelled rows, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALE = 1 << 30


def crc32_fold(id_column: Column, folds: int) -> Column:
    """Remainder of the checksum of the id's decimal digits."""
    return F.crc32(id_column.cast("string")) % folds


def stratified(df: DataFrame, key: str, per_key: int, most_keys: int = 1000, most_rows: int | None = None) -> DataFrame:
    """Return about ``per_key`` rows of each value of ``key``, chosen by a hash of the id.

    At most ``most_keys`` values are counted, the most frequent ones; ``most_rows``
    bounds the rows of all values together.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count().orderBy(F.desc("count"), key).limit(most_keys).collect()
    if most_rows:
        per_key = min(per_key, most_rows // max(1, len(counts)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(0x5A)), F.lit(_SCALE))
    wanted = F.lit(False)
    for value, n in counts:
        wanted = wanted | ((F.col(key) == value) & (draw < min(_SCALE, per_key * _SCALE // n)))
    return df.where(wanted)
