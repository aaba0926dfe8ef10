"""A growing profile against the profile of the whole table, by batches and by a stream."""

import struct

import pytest

from canvass.domain import Domain
from canvass.operators import profile as P
from canvass.session import local_table
from canvass.streaming.increment import GrowingProfile

CUTS = [P.Cut("k", "K", Domain(("a", "b"))), P.Cut("g", "G", Domain(("x",)))]
MEASURES = [*P.means("v", "f"), P.Measure("total", "v", "sum")]
DDL = "k string, g string, v double, f int"


def rows(n, seed):
    return [("abc"[(k * seed) % 3], [None, "x", "y"][k % 3], None if k % 11 == 0 else (k * 0.1 - seed) * 10.0 ** (k % 7 - 3), k % 2) for k in range(n)]


def bits(df):
    return sorted(([struct.pack("<d", c) if isinstance(c, float) else c for c in r] for r in df.collect()), key=repr)


def test_batches_add_up_to_the_last_bit(spark, tmp_path):
    batches = [rows(100, 1), rows(7, 2), [], rows(300, 5)]
    growing = GrowingProfile(spark, str(tmp_path / "p"), CUTS, MEASURES)
    for k, b in enumerate(batches):
        growing.update(local_table(spark, b, DDL).repartition(3), k)
    whole = P.profile(local_table(spark, sum(batches, []), DDL), CUTS, MEASURES, with_order=True)
    assert bits(growing.profile(with_order=True)) == bits(whole)
    growing.update(local_table(spark, batches[1], DDL), 1)  # once more: in its old place
    assert bits(growing.profile(with_order=True)) == bits(whole)
    growing.compact(1)
    growing.compact(2)
    growing.compact(2)
    assert bits(growing.profile(with_order=True)) == bits(whole)
    growing.update(local_table(spark, rows(5, 3), DDL), 4)
    assert growing.profile().filter("type = 'All Farms'").first().N == 412


def test_a_restarted_stream_counts_nothing_twice(spark, tmp_path):
    source, growing = tmp_path / "in", GrowingProfile(spark, str(tmp_path / "p"), CUTS, MEASURES)
    all_rows = []
    for k in range(3):
        all_rows += rows(40 + k, k + 1)
        local_table(spark, rows(40 + k, k + 1), DDL).coalesce(2).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(source))
        growing.follow(stream, str(tmp_path / "check"), availableNow=True).awaitTermination(120)
        assert bits(growing.profile()) == bits(P.profile(local_table(spark, all_rows, DDL), CUTS, MEASURES))


def test_unbounded_cuts_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        GrowingProfile(spark, str(tmp_path), [P.Cut("k", "K")], MEASURES)
