"""Shapefiles: bytes laid out by hand, what is written read back, and what the format cannot hold."""

import datetime
import json
import struct

import numpy as np
import pytest

from canvass.sources import shapes

SQUARE = [[0, 0], [0, 9], [9, 9], [9, 0], [0, 0]]
HOLE = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]
ISLAND = [[20, 0], [20, 5], [25, 5], [25, 0], [20, 0]]


def paths(kind, parts, tail=b""):
    points = np.array([p for part in parts for p in part], "<f8")
    starts = np.cumsum([0, *map(len, parts[:-1])]).astype("<i4")
    return struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(parts), len(points)) + starts.tobytes() + points.tobytes() + tail


def test_text_of_every_kind():
    assert shapes.wkt(struct.pack("<i", 0)) is None
    assert shapes.wkt(struct.pack("<i2d", 1, 1.5, -2)) == "POINT (1.5 -2)"
    assert shapes.wkt(struct.pack("<i4d", 11, 1.5, -2, 7, 8)) == "POINT (1.5 -2)"
    assert shapes.wkt(struct.pack("<i4di4d", 8, 0, 0, 0, 0, 2, 1, 2, 3, 4)) == "MULTIPOINT ((1 2), (3 4))"
    assert shapes.wkt(paths(3, [[[0, 0], [1, 1]]])) == "LINESTRING (0 0, 1 1)"
    assert shapes.wkt(paths(13, [[[0, 0], [1, 1]], [[2, 2], [3, 0.25]]], b"\0" * 48)) == "MULTILINESTRING ((0 0, 1 1), (2 2, 3 0.25))"
    assert shapes.wkt(paths(5, [SQUARE])) == "POLYGON ((0 0, 0 9, 9 9, 9 0, 0 0))"
    with pytest.raises(ValueError, match="unknown shape type"):
        shapes.wkt(paths(31 + 6, [SQUARE]))


def test_holes_go_to_the_smallest_ring_around_them():
    inner = [[0.5, 0.5], [0.5, 3], [3, 3], [3, 0.5], [0.5, 0.5]]
    found = shapes.polygons([np.array(r, float) for r in (ISLAND, HOLE, SQUARE, inner)])
    assert [[r.tolist() for r in own] for own in found] == [[ISLAND], [SQUARE], [inner, HOLE]]
    assert shapes.wkt(paths(5, [HOLE, ISLAND])) == "MULTIPOLYGON (((1 1, 2 1, 2 2, 1 2, 1 1)), ((20 0, 20 5, 25 5, 25 0, 20 0)))"


ROWS = [(i, None if i % 5 == 0 else f"né {i}", i / 7 if i % 3 else None, i % 2 == 0 if i % 7 else None,
         datetime.date(2000 + i % 20, 1 + i % 12, 3) if i % 4 else None,
         None if i % 6 == 0 else [SQUARE, HOLE] if i % 2 else [ISLAND[::-1]]) for i in range(200)]
COLUMNS = "id long, name string, share double, even boolean, day date, rings array<array<array<double>>>"


def test_written_rows_come_back_from_many_tasks(spark, tmp_path):
    rows = [(*r[:5], r[5] and [[[float(x) for x in p] for p in ring] for ring in r[5]]) for r in ROWS]
    shapes.write_shapes(spark.createDataFrame(rows, COLUMNS).repartition(3), str(tmp_path / "out"), file_bytes=6000)
    assert len(json.loads((tmp_path / "out" / "_parts").read_text())) > 3
    (tmp_path / "out" / "part-left-by-a-lost-task.shx").write_bytes(b"")
    back = shapes.read_shapes(spark, f"file:{tmp_path}/out", split_bytes=2000)
    assert back.rdd.getNumPartitions() > 10
    assert back.dtypes == [("id", "bigint"), ("name", "string"), ("share", "double"), ("even", "boolean"), ("day", "date"), ("geometry_wkt", "string")]
    square, hole = "(0 0, 0 9, 9 9, 9 0, 0 0)", "(1 1, 2 1, 2 2, 1 2, 1 1)"
    text = {0: None, 1: f"POLYGON ({square}, {hole})", 2: "POLYGON ((20 0, 20 5, 25 5, 25 0, 20 0))"}
    want = [(*r[:5], text[0 if r[5] is None else len(r[5]) == 2 and 1 or 2]) for r in ROWS]
    assert sorted(map(tuple, back.collect())) == want


def laid_out(folder, name, deleted=(), fields=((b"NAME", b"C", 6, 0), (b"CODE", b"N", 4, 0)), shift=0):
    """Three points with attributes in Latin-1, records in reverse order in the file, and a wide gap between them."""
    contents = [struct.pack("<i2d", 1, k, k) for k in range(3)]
    shp, index = bytearray(100), [None] * 3
    for k in (2, 1, 0):
        index[k] = (len(shp) // 2, len(contents[k]) // 2)
        shp += struct.pack(">2i", k + 1, len(contents[k]) // 2) + contents[k] + bytes(shift)
    width = 1 + sum(f[2] for f in fields)
    dbf = struct.pack("<4BIHH20x", 3, 95, 7, 26, 3, 33 + 32 * len(fields), width)
    dbf += b"".join(struct.pack("<11sc4xBB14x", *f) for f in fields) + b"\r"
    for k in range(3):
        cells = [f"é{k}".encode("latin-1").ljust(f[2]) if f[1] == b"C" else (b"%d" % k if k else b"").rjust(f[2]) for f in fields]
        dbf += (b"*" if k in deleted else b" ") + b"".join(cells)
    for ending, data in (("shp", shp), ("shx", bytes(100) + b"".join(struct.pack(">2i", *i) for i in index)), ("dbf", dbf)):
        (folder / f"{name}.{ending}").write_bytes(bytes(data))


def test_files_laid_out_by_hand(spark, tmp_path):
    laid_out(tmp_path, "a", deleted=(1,))
    laid_out(tmp_path, "b", shift=500)
    one = [("é0", None, "POINT (0 0)"), ("é2", 2, "POINT (2 2)")]
    assert sorted(map(tuple, shapes.read_shapes(spark, f"{tmp_path}/a.shp").collect())) == one
    both = shapes.read_shapes(spark, str(tmp_path), geometry="name")
    assert both.columns == ["NAME", "CODE", "name_"]
    assert sorted(map(tuple, both.collect()), key=str) == sorted([*one, *one, ("é1", 1, "POINT (1 1)")], key=str)


def test_files_that_disagree_are_an_error(spark, tmp_path):
    laid_out(tmp_path, "a")
    laid_out(tmp_path, "b", fields=((b"NAME", b"C", 6, 0), (b"CODE", b"C", 4, 0)))
    with pytest.raises(Exception, match="other columns"):
        shapes.read_shapes(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="no shapefile"):
        (tmp_path / "empty").mkdir()
        shapes.read_shapes(spark, str(tmp_path / "empty")).collect()


def test_without_attributes(spark, tmp_path):
    laid_out(tmp_path, "a")
    for ending in ("shp", "shx"):
        (tmp_path / f"bare.{ending}").write_bytes((tmp_path / f"a.{ending}").read_bytes())
    assert [tuple(r) for r in shapes.read_shapes(spark, f"{tmp_path}/bare.shp").collect()] == [(f"POINT ({k} {k})",) for k in range(3)]


def test_a_table_without_rows(spark, tmp_path):
    empty = spark.createDataFrame([], COLUMNS)
    shapes.write_shapes(empty, str(tmp_path / "none"))
    back = shapes.read_shapes(spark, str(tmp_path / "none"))
    assert back.count() == 0 and back.columns == ["id", "name", "share", "even", "day", "geometry_wkt"]


@pytest.mark.parametrize("row, columns, message", [
    (("x" * 255,), "name string", "255 bytes"),
    ((10**18,), "id long", "19 bytes"),
    ((float("inf"),), "share double", "infinite"),
    (("x",), "eleven_long string", "ten ASCII"),
    (([1],), "list array<int>", "no column type"),
])
def test_what_the_format_cannot_hold(spark, tmp_path, row, columns, message):
    df = spark.createDataFrame([(*row, None)], f"{columns}, rings array<array<array<double>>>")
    with pytest.raises(Exception, match=message):
        shapes.write_shapes(df, str(tmp_path / "out"))
