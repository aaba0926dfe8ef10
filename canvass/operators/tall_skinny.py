"""QR factors of tables that are long and narrow, without squaring the columns.

Every task factors its rows piece by piece and hands on one small triangle per
group; groups of triangles are stacked and factored again until few are left.
Rank is decided on the last triangle, whose error is that of one rounding a
step: a column may depend on others up to a share of 1e-11 of its length before
it counts as explained by them. Normal equations would see no further than the
square root of that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a column's length that has to be its own.
TOLERANCE = 1e-11
#: Triangles per group that may reach the driver.
_LAST = 64

Matrices = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]


def _stacked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack([a, b]), mode="r")


def _square(r: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[: len(r)] = r
    return out


def triangles(table: DataFrame, matrices: Matrices, groups: int, p: int) -> np.ndarray:
    """Triangular factors (groups + 1, p, p); the last one of all rows.

    ``matrices`` yields from a batch pieces of the p columns, and which rows
    belong to which group (rows × groups, 0 or 1).
    """
    names = ["part", "grp", "cells"]

    def factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = np.zeros((groups + 1, p, p))
        for batch in batches:
            for x, member in matrices(batch):
                whole = np.linalg.qr(x, mode="r")
                found[groups] = _square(_stacked(found[groups], whole), p)
                for g in range(groups):
                    mine = member[:, g] > 0
                    if mine.any():
                        found[g] = _square(_stacked(found[g], whole if mine.all() else x[mine]), p)
        yield batch_of(TaskContext.get().partitionId(), range(groups + 1), found)

    def batch_of(part: int, which, found: np.ndarray) -> pa.RecordBatch:
        cells = [r.tobytes() for r in found]
        return pa.RecordBatch.from_arrays([pa.array([part] * len(cells), pa.int32()), pa.array(list(which), pa.int32()), pa.array(cells, pa.binary())], names=names)

    def merged(group: pa.Table) -> pa.Table:
        out = np.zeros((p, p))
        for cell in group.column("cells"):
            out = _square(_stacked(out, np.frombuffer(cell.as_py()).reshape(p, p)), p)
        first = group.slice(0, 1)
        return pa.table([first.column("part"), first.column("grp"), pa.array([out.tobytes()], pa.binary())], names=names)

    parts = table.mapInArrow(factored, "part int, grp int, cells binary")
    few = parts.withColumn("part", F.col("part") % _LAST).groupBy("grp", "part").applyInArrow(merged, "part int, grp int, cells binary")
    out = np.zeros((groups + 1, p, p))
    # at most 64 triangles per group, however many tasks there were
    for row in sorted(few.collect(), key=lambda r: (r.grp, r.part)):
        out[row.grp] = _square(_stacked(out[row.grp], np.frombuffer(row.cells).reshape(p, p)), p)
    return out


def independent(r: np.ndarray, columns: list[int] | None = None, rounding: np.ndarray | None = None) -> list[int]:
    """The columns that the ones kept before do not explain, in order.

    ``rounding`` is, per column, the share of its length that the rounding of
    its cells may make up; what is left of a column has to be more than that too.
    """
    kept: list[int] = []
    basis = np.zeros((len(r), 0))
    length = np.linalg.norm(r, axis=0)
    noise = np.zeros(r.shape[1]) if rounding is None else rounding * length
    for k in range(r.shape[1]) if columns is None else columns:
        rest = r[:, k] - basis @ (basis.T @ r[:, k])
        rest = rest - basis @ (basis.T @ rest)  # twice, so that what is left is orthogonal to rounding
        size = np.linalg.norm(rest)
        shares = np.linalg.lstsq(r[:, kept], r[:, k], rcond=None)[0] if kept else np.zeros(0)
        if size > max(TOLERANCE * length[k], 8 * (noise[k] + np.abs(shares) @ noise[kept])):
            kept.append(k)
            basis = np.column_stack([basis, rest / size])
    return kept
