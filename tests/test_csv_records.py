"""Records with line breaks read by many tasks, and column types found in the cells."""

import csv
import random

import duckdb
import pytest

from canvass.sources import records
from canvass.sources.conform import read_survey
from canvass.sources.infer import inferred_types, narrowest


@pytest.fixture()
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def written(path, rows, end="\n", quoting=csv.QUOTE_MINIMAL):
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator=end, quoting=quoting).writerows(rows)
    return str(path)


def cells(rng):
    return "".join(rng.choice(["a", "b", '"', ",", "\n", '""', "\n\n", " ", "é", "NA", "x" * 30]) for _ in range(rng.choice([0, 1, 3, 12])))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_tasks_give_the_same_cells(spark, small_blocks, tmp_path, seed, end):
    rng = random.Random(seed)
    rows = [["n", "a.b", "c"], *[[str(k), cells(rng) + "|", cells(rng) + "|"] for k in range(200)]]
    path = written(tmp_path / "t.csv", rows, end, csv.QUOTE_ALL if seed % 2 else csv.QUOTE_MINIMAL)
    df = records.read_cells(spark, path, rows[0])
    assert records._lines(spark, path).rdd.getNumPartitions() > 5
    assert sorted(map(list, df.collect())) == sorted(rows[1:])


def test_one_cell_over_many_blocks(spark, small_blocks, tmp_path):
    long = "\n".join(f"line {k}, with a comma" for k in range(400)) + "|"
    rows = [["a", "b"], ["1", "x"], ["2", long], ["3", 'say "hi"\n'], ["4", long]]
    df = records.read_cells(spark, written(tmp_path / "t.csv", rows))
    assert sorted(map(list, df.collect())) == rows[1:]


def test_sorted_way_beyond_few_blocks(spark, small_blocks, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "FEW_BLOCKS", 2)
    rng = random.Random(9)
    rows = [["a", "b"], *[[str(k), cells(rng) + "|"] for k in range(300)]]
    df = records.read_cells(spark, written(tmp_path / "t.csv", rows), rows[0])
    assert sorted(map(list, df.collect())) == sorted(rows[1:])


def test_several_files_each_with_a_header(spark, small_blocks, tmp_path):
    (tmp_path / "d").mkdir()
    for k in range(3):
        written(tmp_path / "d" / f"{k}.csv", [["a", "b"], *[[f"{k}.{j}", "two\nlines"] for j in range(50)], []])
    got = records.read_cells(spark, str(tmp_path / "d"))
    assert got.columns == ["a", "b"] and got.count() == 150 and got.filter("b = 'two\nlines'").count() == 150
    with pytest.raises(Exception, match="header differs"):
        records.read_cells(spark, str(tmp_path / "d"), ["a", "c"]).collect()


def test_an_open_quote_loses_no_rows(spark, small_blocks, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "".join(f"{k},x\n" for k in range(300)) + '300,"open\nto the end\n')
    got = {r.a: r.b for r in records.read_cells(spark, str(path)).collect()}
    assert len(got) == 301 and got["300"].startswith("open\nto the end")


def test_header_only_and_empty(spark, tmp_path):
    assert records.read_cells(spark, written(tmp_path / "t.csv", [["a", "b"]])).count() == 0


TYPED = [
    ["yes.no", "whole", "real", "text", "mixed", "blank", "big", "codes", "note"],
    ["true", "1", "1.5", "x", "true", "", "9007199254740993", "5d", "two\nlines"],
    ["false", "-20", "2", "", "3", "", "1", "3f", "a"],
    ["", "", "1e-3", "y z", "", "", "", "7", "b"],
]


def test_types_are_those_of_duckdb(spark, tmp_path):
    path = written(tmp_path / "t.csv", TYPED)
    df = read_survey(spark, path, multi_line=True, infer=True)
    kinds = {"BOOLEAN": "boolean", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string"}
    want = {n.replace(".", "_"): kinds[t] for n, t, *_ in duckdb.sql(f"describe select * from read_csv('{path}', all_varchar=false, sample_size=-1)").fetchall()}
    want["blank"] = "boolean"  # nothing to go by: logical here, text there
    assert dict(df.dtypes) == want
    rows = df.orderBy("whole").collect()
    assert [r.whole for r in rows] == [None, -20, 1] and [r.big for r in rows] == [None, 1, 9007199254740993]
    assert [r.yes_no for r in rows] == [None, False, True] and [r.text for r in rows] == ["y z", "", "x"]


def test_kinds_merge(make):
    def kind(*values):
        return inferred_types(make([(v,) for v in values], "a string"))["a"]

    assert kind("TRUE", "F", "NA", None) == "boolean" and kind("NA", None, " ") == "boolean"
    assert kind("1", " 2 ", "+3") == "bigint" and kind("1", "2.", "NA") == "double"
    assert kind("1", "99999999999999999999") == "double" and kind("1e5", "-Inf", "NaN") == "double"
    assert kind("1", "TRUE") == kind("5d") == kind("0x1g") == kind("1_000") == kind("1,5") == kind(".") == "string"
    assert [narrowest(b) for b in (0, 1, 2, 4, 6, 3, 5, 8, 15)] == ["boolean", "boolean", "bigint", "double", "double", "string", "string", "string", "string"]


def test_questionnaire_kinds_are_strict(spark, tmp_path):
    path = written(tmp_path / "t.csv", [["rev.est", "state"], ["5d", "x"], ["3f", "y"], ["1e3", "z"], [" 7 ", ""]])
    assert [r.rev_est for r in read_survey(spark, path).collect()] == [None, None, 1000.0, 7.0]
