from collections import Counter

import pytest

from canvass.operators.profile import Cut, means, profile
from canvass.session import materialized, scratch_path, shared_dir
from canvass.sources import maps, schema, sinks
from canvass.sources.conform import conform, read_region_map, read_survey


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def test_survey_columns_are_complete_and_distinct():
    assert len(schema.COLUMNS) == len(set(schema.COLUMNS)) == 114


CSV = 'state,rev.est,water.stand,Train.Attend\nOhio,1000,Used,Yes\n"NA",NA,"",NA\n,,,\n"a ""b"", c",1e3,NA,No\n'


@pytest.mark.parametrize("columns", [None, ["state", "rev.est", "water.stand", "Train.Attend"]])
def test_blank_missing_and_numbers(spark, folder, columns):
    path = f"{folder}/survey.csv"
    with open(path, "w") as f:
        f.write(CSV)
    df = read_survey(spark, path, columns)
    assert df.columns == ["state", "rev_est", "water_stand", "train_attend"]
    assert [tuple(r) for r in df.collect()] == [
        ("Ohio", 1000.0, "Used", "Yes"), (None, None, "", None), ("", None, "", ""),
        ('a "b", c', 1000.0, None, "No")]


def test_line_breaks_inside_cells(spark, folder):
    path = f"{folder}/survey.csv"
    with open(path, "w") as f:
        f.write('state,other.pna\n"two\nlines",x\n')
    assert read_survey(spark, path, multi_line=True).first().state == "two\nlines"


def test_typed_columns_stay(make):
    got = conform(make([(1.5, "NA", "7")], "rev_est double, state string, exp_est string"))
    assert tuple(got.first()) == (1.5, None, 7.0)


def test_numbers(make):
    got = conform(make([(t,) for t in ("1.5", " 2 ", "1e3", "-4", "NaN", "NA", "", "x", None)], "rev_est string"))
    assert [r[0] for r in got.collect()] == [1.5, 2.0, 1000.0, -4.0, None, None, None, None, None]


def test_region_map_constants(spark):
    rows = maps.region_map(spark).collect()
    assert len(rows) == len({r.state_abb for r in rows}) == 51
    assert Counter(r.region_epa for r in rows) == {
        "New England": 6, "NY and NJ": 2, "Mid-Atlantic": 6, "Southeast": 8, "Upper Midwest": 6,
        "Midwest, Plains, and S. Central": 15, "Southwest and West Coast": 8}
    assert {r.state_abb for r in rows} == set(maps.STATE_NAMES)


def test_quoted_region_csv(spark, folder):
    path = f"{folder}/map.csv"
    with open(path, "w") as f:
        f.write('region_epa,state.abb\nNew England,ME\n"Midwest, Plains, and S. Central",AR')
    assert [tuple(r) for r in read_region_map(spark, path).collect()] == [
        ("New England", "ME"), ("Midwest, Plains, and S. Central", "AR")]


TABLE = [("a,b", 1, 0.5, ""), (None, None, None, "*"), ('say "hi"', 3, 2.0, None)]
COLUMNS = "t string, n bigint, m double, s string"


def text_of(path):
    import glob

    return "".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_csv_sink(spark, make, folder):
    df = make(TABLE, COLUMNS).coalesce(1)
    sinks.write_table(df, f"{folder}/t")
    assert text_of(f"{folder}/t") == 't,n,m,s\n"a,b",1,0.5,""\nNA,NA,NA,*\n"say ""hi""",3,2.0,NA\n'
    assert [tuple(r) for r in sinks.read_table(spark, f"{folder}/t", df).collect()] == TABLE


def test_quoted_csv_sink(spark, make, folder):
    df = make(TABLE, COLUMNS).coalesce(1)
    sinks.write_quoted_table(df, f"{folder}/q")
    assert [tuple(r) for r in sinks.read_table(spark, f"{folder}/q", df).collect()] == TABLE


ODD = [("NA", "NA", 1.0), (None, "", None), ("", "\x01NA", 0.0), ("\x01\x01NA", '"NA"', -1.5), ('a,"NA",b', "x,NA", 1e300), ("two\nlines", " NA ", 2.0), ('","', '"', None), ("NAN", "na", 3.0)]


@pytest.mark.parametrize("write", [sinks.write_table, sinks.write_quoted_table])
def test_missing_blank_and_text_na_stay_apart(spark, make, folder, write):
    df = make(ODD, "t string, `odd, name` string, m double").repartition(3)
    write(df, f"{folder}/t")
    assert sorted(map(tuple, sinks.read_table(spark, f"{folder}/t", df).collect()), key=repr) == sorted(ODD, key=repr)


@pytest.mark.parametrize("write", [sinks.write_table, sinks.write_quoted_table])
def test_empty_table_keeps_its_header(spark, make, folder, write):
    df = make([], "t string, n bigint")
    write(df, f"{folder}/t")
    assert text_of(f"{folder}/t").replace('"', "") == "t,n\n"
    assert sinks.read_table(spark, f"{folder}/t", df).collect() == []


def test_bundle(spark, make, folder):
    one, two = make([(1,), (2,)], "a int"), make([("x", 1.0)], "b string, c double")
    sinks.write_bundle({"one": one, "two": two}, folder + "/b")
    assert {tuple(r) for r in sinks.bundle_manifest(spark, folder + "/b", ["one", "two"]).collect()} == {
        ("one", 2, 1), ("two", 1, 2)}


def test_ordered_write_keeps_order(spark, make, folder):
    from canvass.operators.profile import in_order
    from canvass.domain import Domain

    df = make([("b", 1), ("a", 0), (None, 1), ("b", 0)], "k string, f int")
    table = in_order(profile(df, [Cut("k", "K", Domain(("b", "a")))], means("f"), with_order=True))
    sinks.write_table(table, f"{folder}/t")
    lines = [line for line in text_of(f"{folder}/t").splitlines() if not line.startswith("type")]
    assert lines == ["All Farms,All,4,0.5", "K,b,2,0.5", "K,a,1,0.0", "K,NA,1,1.0"]


def test_materialized_table_is_dropped(spark):
    import os

    with materialized(spark.range(10), "probe") as table:
        path = table.inputFiles()[0]
        assert path.removeprefix("file://").startswith(shared_dir(spark)) and table.count() == 10
    assert not os.path.exists(path.removeprefix("file://"))


def test_scratch_paths_differ(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_shared_dir_is_required_off_the_local_master(spark):
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Context:
        def __init__(self, named):
            self.named = named

        def getCheckpointDir(self):
            return self.named

    class Session:
        def __init__(self, named=None, **values):
            self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})
            self.sparkContext = Context(named)

    with pytest.raises(RuntimeError):
        shared_dir(Session(spark_master="spark://host"))
    assert shared_dir(Session("hdfs://x/named", spark_master="yarn")) == "hdfs://x/named"
    assert shared_dir(Session(**{"spark_master": "yarn", "spark_checkpoint_dir": "hdfs://x/y/"})) == "hdfs://x/y"


def test_report_sink(spark, make, folder):
    report = make([("b", 1, "x"), ("a", 0, "y")], "term string, row_ord int, dep string")
    sinks.write_reports({"fs": report}, folder)
    assert text_of(f"{folder}/fs").splitlines()[-2:] == ['"a","y"', '"b","x"']
