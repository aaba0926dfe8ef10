"""Conversation repair against exhaustive search, and its bounded memory."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from canvass.llm import conversation_repair as cr

SPACE = " \t\n\x0b\f\r"
COLUMNS = "conv_id long, turn long, role string, text string"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(SPACE)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """All edits of up to two inserts in each place, by trial."""
    faults = faults_of(rows)
    best = None
    choices = []
    for (role, text), fault in zip(rows, faults):
        row = [("D", 3, None)]
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            row += [("K", more, (role, text)), ("R", 2 + more, ("user", text)), ("R", 2 + more, ("assistant", text))]
        choices.append(row)
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for inserts in itertools.product(gaps, repeat=len(rows) + 1):
        for picks in itertools.product(*choices):
            cost = sum(p[1] for p in picks) + 2 * sum(map(len, inserts))
            if best and cost > best[0]:
                continue
            audit, lines = "", []
            for k, ins in enumerate(inserts):
                audit += "I" * len(ins)
                lines += [(r, "") for r in ins]
                if k < len(picks):
                    audit += picks[k][0]
                    lines += [picks[k][2]] if picks[k][2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def searched(rows):
    figures, audit, out = cr._Report(), "", []
    for letters, lines in figures.edits((0, 0, r, t, f) for (r, t), f in zip(rows, faults_of(rows))):
        audit += letters
        out += [(r, t) for _, r, t in lines]
    return figures.cost, audit, out


ROLES = ["user", "assistant", "system", "tool", "user", "assistant", ""]


@pytest.mark.parametrize("seed", range(150))
def test_same_as_exhaustive_search(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(ROLES), rng.choice(["a.", "b?", "c", "d", "e f", "", "g! "]) ) for _ in range(rng.choice([0, 1, 2, 3, 3, 3]))]
    assert searched(rows) == cheapest(rows), rows


def plain(rows):
    """Cheapest repair by whole audits in every state, without tree or bounds."""
    best = {cr.START: (0, "", [])}

    def with_inserts(best):
        out = dict(best)
        for _ in range(3):
            for s, (c, a, ls) in list(out.items()):
                to = cr.NEXT[s]
                new = (c + 2, a + "I", [*ls, (cr.NAMES[to], "")])
                if to not in out or new[:2] < out[to][:2]:
                    out[to] = new
        return out

    for (role, text), fault in zip(rows, faults_of(rows)):
        after = {}

        def offer(to, new):
            if to not in after or new[:2] < after[to][:2]:
                after[to] = new

        for s, (c, a, ls) in best.items():
            offer(s, (c + 3, a + "D", ls))
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            for s, (c, a, ls) in with_inserts(best).items():
                if (s, role[:1]) in cr.KEPT:
                    offer(cr.KEPT[s, role[:1]], (c + more, a + "K", [*ls, (role, text)]))
                offer(cr.NEXT[s], (c + 2 + more, a + "R", [*ls, (cr.NAMES[cr.NEXT[s]], text)]))
        best = after
    closed = with_inserts(best)
    return min(closed[s] for s in (cr.START, cr.ASSISTANT) if s in closed)


@pytest.mark.parametrize("seed", range(60))
def test_long_conversations_and_lasting_ties(seed):
    rng = random.Random(seed)
    roles = ["user"] if seed % 3 == 0 else ROLES
    texts = ["t", "a.", ""] if seed % 2 else ["t"]
    rows = [(rng.choice(roles), (t := rng.choice(texts)) and f"{k}{t}") for k in range(120)]
    assert searched(rows) == plain(rows)


def test_paths_leave_before_the_end():
    tree, given = cr.PathTree(), 0
    for k in range(10_000):
        if k % 3 == 2:
            tree.forced()
        else:
            given += sum(len(letters) for letters, _ in tree.row(["user", "assistant"][k % 3], f"{k}.", False))
    assert tree.longest_open <= 3 and given > 9_990


def damaged_rows(table):
    for c, t, role, text in table:
        c, t, role, text = [" " if x is None else x for x in (c, t, role, text)]
        k = zlib.crc32(f"{c}:{t}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        yield c, t, [] if k == 0 else [(role, text)] * (2 if k == 3 else 1)


def expected(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = sorted((r for r in table if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns, lines = [], []
        for (c, t, *_), (_, _, made) in zip(rows, damaged_rows(rows)):
            turns += [t] * len(made)
            lines += made
        known = [t for t in turns if t is not None]
        faults = faults_of(lines)
        cost, audit, fixed = plain(lines)
        pairs = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), pairs, cost, audit, sha)
    return out


def got(df):
    return {r[0]: tuple(r)[1:9] for r in df.collect()}


def test_tables_with_odd_cells(spark):
    rng = random.Random(5)
    table = [(c, t * rng.choice([1, 2]), rng.choice([*ROLES, None]), rng.choice(["Hi.", "what", " \t", None, "x!?", "ü\U0001f600.", "long " * 20_000])) for c in [*range(60), None] for t in range(c or 3 if (c or 3) < 9 else 9)]
    table = list({r[:2]: r for r in table}.values()) + [(7, None, "user", "a."), (800, None, None, None), (-1, 4, "tool", "b.")]
    df = spark.createDataFrame([(*r, 1, "x") for r in table], COLUMNS + ", conv long, fault string").repartition(5)
    out = cr.conversation_repair(df)
    assert got(out) == expected(table)
    assert cr.conversation_repair(df.limit(0)).count() == 0


def test_conversations_that_lose_all_rows(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    df = spark.createDataFrame([(c, 0, "user", "a.") for c in gone], COLUMNS)
    assert set(got(cr.conversation_repair(df)).values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_sample_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert got(cr.conversation_repair(df)) == expected([tuple(r) for r in df.collect()])


def test_repaired_turns_are_real_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "bot", "Well."), (2, 0, "assistant", "Lost."), (3, 0, "user", " ")], COLUMNS)
    rows = sorted(tuple(r) for r in cr.repair(cr.undamaged(df)).collect())
    assert rows == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Well."), (2, 0, "I", "user", ""), (2, 1, "K", "assistant", "Lost.")]
