"""The best rows of many questions: running lists inside tasks, ranks across them."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Best:
    """The k best (score, id) so far; ties to the smaller id, null last."""

    __slots__ = ("k", "rows")

    def __init__(self, k: int):
        self.k = k
        #: (-score, id is null, id), best first
        self.rows: list[tuple] = []

    def floor(self) -> int | float:
        """The score below which nothing gets in."""
        return -self.rows[-1][0] if len(self.rows) == self.k else -math.inf

    def add(self, scores: list, ids: list) -> None:
        found = [(-s, i is None, i) for s, i in zip(scores, ids)]
        self.rows = heapq.nsmallest(self.k, [*self.rows, *found], key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))


def ranked(found: DataFrame, id_col: str, k: int) -> DataFrame:
    """``rank`` (from 1) among the rows of each ``ask``, up to k; Spark ranks inside the tasks first."""
    order = Window.partitionBy("ask").orderBy(F.col("score").desc(), F.col(id_col).asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
