"""Whether a 0/1 regression has a finite maximum, decided by linear programming on distributed rows.

Let a row's vector point to the side of its answer (regressors times +1 or -1).
A direction with which no vector makes an obtuse angle, and some an acute one,
separates the answers: the likelihood grows along it without end. The program

    maximise c'd  subject to  a'd >= 0 for every row, -1 <= d <= 1

with c the sum of all vectors has an optimum above zero exactly then. It is
solved by column generation on its dual: the driver holds the few rows that
have mattered so far, each pass over the table looks for rows that the current
direction still cuts off, a handful per model, and none found is the proof. An
optimum of zero proves overlap by the rows held, which stays true for all rows.
A second program (largest margin) tells complete from quasi-complete separation.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Margins below this share of a row's length count as none.
MARGIN = 1e-9
#: Passes over the table at most; each takes in rows that no earlier direction satisfied.
PASSES = 200


class Program:
    """max c'd with a'd >= 0 for the rows added so far and d within a unit box, by the dual simplex method's columns."""

    def __init__(self, c: np.ndarray):
        q = len(c)
        self.c = c
        self.columns = np.hstack([np.eye(q), -np.eye(q)])
        self.costs = np.ones(2 * q)
        self.basis = [i if c[i] >= 0 else q + i for i in range(q)]

    def add(self, rows: np.ndarray) -> None:
        self.columns = np.hstack([self.columns, -rows.T])
        self.costs = np.concatenate([self.costs, np.zeros(len(rows))])

    def solve(self) -> tuple[float, np.ndarray]:
        """Optimum and direction."""
        for step in range(100_000):
            b = self.columns[:, self.basis]
            level = np.maximum(np.linalg.solve(b, self.c), 0.0)
            d = np.linalg.solve(b.T, self.costs[self.basis])
            reduced = self.costs - d @ self.columns
            reduced[self.basis] = 0.0
            below = np.flatnonzero(reduced < -MARGIN / 10)
            if not len(below):
                break
            # the steepest first; lowest index after many steps, which cannot cycle
            enter = below[np.argmin(reduced[below])] if step < 200 else below[0]
            w = np.linalg.solve(b, self.columns[:, enter])
            out = np.flatnonzero(w > 1e-11)
            if not len(out):
                break
            ratio = level[out] / w[out]
            ties = out[ratio <= ratio.min() + 1e-15]
            leave = min(ties, key=lambda i: self.basis[i]) if step >= 200 else ties[np.argmax(w[ties])]
            self.basis[leave] = int(enter)
        return float(self.costs[self.basis] @ level), d


#: Directions by model in, most obstructed rows by model out (each row's vector scaled to length one).
Obstructed = Callable[[dict[int, np.ndarray]], dict[int, np.ndarray]]


def _optimum(programs: dict[int, Program], obstructed: Obstructed, widen: Callable[[np.ndarray], np.ndarray], narrow: Callable[[np.ndarray], tuple]) -> dict[int, float]:
    """Optimum of each program over all rows of the table."""
    found, todo = {}, dict(programs)
    for _ in range(PASSES):
        directions = {}
        for k, program in list(todo.items()):
            best, d = program.solve()
            found[k] = best
            if best <= MARGIN * max(1.0, np.abs(program.c).max()):
                del todo[k]
            else:
                directions[k] = narrow(d)
        if not directions:
            break
        rows = obstructed(directions)
        for k in directions:
            if len(rows.get(k, ())):
                todo[k].add(widen(rows[k]))
            else:
                del todo[k]
        if not todo:
            break
    return found


def separations(totals: dict[int, np.ndarray], obstructed: Obstructed) -> dict[int, str]:
    """``overlap``, ``quasi-separated`` or ``separated`` for each model, from the sums of its rows' vectors.

    ``obstructed`` takes a direction and a margin per model and returns, per
    model, unit rows whose product with the direction is below the margin.
    """
    out = {k: "overlap" for k in totals}
    programs = {k: Program(c / max(np.linalg.norm(c), 1e-300)) for k, c in totals.items()}
    best = _optimum(programs, obstructed, lambda rows: rows, lambda d: (d, 0.0))
    apart = [k for k, v in best.items() if v > MARGIN]
    if apart:
        margin = {k: Program(np.append(np.zeros(len(totals[k])), 1.0)) for k in apart}
        widen = lambda rows: np.column_stack([rows, -np.ones(len(rows))])
        best = _optimum(margin, obstructed, widen, lambda d: (d[:-1], float(d[-1])))
        out |= {k: "separated" if best[k] > MARGIN else "quasi-separated" for k in apart}
    return out
