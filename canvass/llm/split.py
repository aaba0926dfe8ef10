"""Which documents a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(id_col: str) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; a row without id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def sampled(id_col: str, share: Column) -> Column:
    """A fixed pseudo-random ``share`` of the ids."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1_000_000)) < share * 1_000_000
