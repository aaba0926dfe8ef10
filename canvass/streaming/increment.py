"""A profile that grows with its table: stored sums that add up, updated by batches or by a stream.

Every batch leaves the sums of its joint groups in a folder of its own, named
by its number. Writing a batch again replaces its folder, so a stream that is
restarted counts nothing twice. The profile is read from the folders alone; as
the sums are exact, it equals that of the whole table to the last bit, in
whatever batches the rows came. ``compact`` replaces many folders by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canvass.operators import profile as P
from canvass.session import drop_path, folders


class GrowingProfile:
    """A stored profile by cuts whose domains bound the groups, below ``path``."""

    def __init__(self, spark: SparkSession, path: str, cuts: Sequence[P.Cut], measures: Sequence[P.Measure]):
        if not P.joint_groups_bounded(cuts):
            raise ValueError("cuts need domains that bound their groups, since each batch stores them all")
        self.spark, self.path, self.cuts, self.measures = spark, path.rstrip("/"), list(cuts), list(measures)
        self.keys = [c.column for c in cuts]
        self.columns = list(dict.fromkeys(m.column for m in measures))

    def update(self, rows: DataFrame, batch: int) -> None:
        """Add a batch of rows, or put it in the place of an earlier one of the same number."""
        found = P.partials(P.enforced(rows, self.cuts), self.keys, self.columns)
        found.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")  # at most the joint groups

    def follow(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Update from a streaming table; ``checkpoint`` remembers which rows have been counted."""
        writer = stream.writeStream.foreachBatch(lambda rows, batch: self.update(rows, batch)).option("checkpointLocation", checkpoint)
        return writer.trigger(**trigger).start() if trigger else writer.start()

    def _merged(self) -> int | None:
        """The highest batch that a compaction has taken in."""
        done = [int(f.rpartition("=")[2]) for f in folders(self.spark, f"{self.path}/merged=*")]
        return max(done, default=None)

    def partials(self) -> DataFrame:
        """All stored sums: the latest compaction and the batches after it."""
        upto = self._merged()
        later = [f for f in folders(self.spark, f"{self.path}/batch=*") if upto is None or int(f.rpartition("=")[2]) > upto]
        return self.spark.read.parquet(*later, *([f"{self.path}/merged={upto}"] if upto is not None else []))

    def profile(self, *, overall: str = "All Farms", count_as: str | None = "N", with_order: bool = False) -> DataFrame:
        """The profile of all rows so far, as ``profile.profile`` gives it."""
        rolled = P.roll_up_partials(self.partials(), [[], *[[k] for k in self.keys]], self.keys, self.columns)
        return P.shown(rolled, self.cuts, self.measures, overall=overall, count_as=count_as, with_order=with_order)

    def compact(self, upto: int) -> None:
        """One folder for all batches up to a number that no running update will write again.

        The new folder counts from the moment its single file is there, and
        the old ones are passed over from then on, so a lost driver loses and
        doubles nothing; they are deleted last.
        """
        before = self._merged()
        if before is not None and before >= upto:
            return
        old = [f for f in folders(self.spark, f"{self.path}/batch=*") if int(f.rpartition("=")[2]) <= upto]
        if not old:
            return
        read = self.spark.read.parquet(*old, *([f"{self.path}/merged={before}"] if before is not None else []))
        sums = [c for c in read.columns if c not in self.keys]
        read.groupBy(*self.keys).agg(*[F.sum(f"`{c}`").alias(c) for c in sums]).coalesce(1).write.parquet(f"{self.path}/merged={upto}")
        for folder in [*old, *([f"{self.path}/merged={before}"] if before is not None else [])]:
            drop_path(self.spark, folder)
