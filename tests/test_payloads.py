"""Payload literals: kinds, dialects, headers, rows and completeness."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.sources import loading, packages, payloads

BODIES = {
    "semicolon": (b"a;b\n1,5;2,5\n3,5;4,5\n", True),
    "preamble": (b"sep=;\na;b\n1;2\n", True),
    "dupes": (b"a,a,,b\n1,2,3,4\n5,6,7,8\n", True),
    "ragged": (b"a,b,c\n1,2\n1,2,3,4\n", True),
    "banner": ("Στοιχεία;;;\nΈτος;;Σύνολο;\n;Α;;Β\n2020;1;2;3\n2021;4;5;6\n".encode(), True),
    "footnote": (b"a;b;c\n1;2;3\n4;5;6\n* provisional;;\n", True),
    "cut": ("name,value\nx,1\ny,Ω".encode()[:-1], False),
    "html": (b"<!DOCTYPE html><html></html>", True),
    "greek1253": ("Όνομα;Τιμή\nΑθήνα;5\nΒόλος;6\n".encode("cp1253"), True),
    "bom": (b"\xef\xbb\xbfa;b\n1;2\n", True),
    "nul": (b"a,b\n1,\x002\n", True),
    "blank": (b"\n\n", True),
    "collapsed": (b"a;b,c|d\n1;2,3|4\nx;y,z|w\n", True),
}


@pytest.fixture(scope="module")
def parsed(spark):
    bodies = spark.createDataFrame([(k, bytearray(b), c) for k, (b, c) in BODIES.items()], "rid string, content binary, body_complete boolean")
    rows = payloads.parse_delimited(bodies, max_rows=50).cache()
    tables = {r["rid"]: r.asDict() for r in payloads.payload_tables(rows, bodies).collect()}
    cells = {}
    for r in payloads.payload_cells(rows).orderBy("rid", "row_idx", "col_idx").collect():
        cells.setdefault(r["rid"], {}).setdefault(r["row_idx"], {})[r["col_name"]] = r["cell"]
    return tables, cells


def test_dialects(parsed):
    tables, cells = parsed
    assert tables["semicolon"]["delimiter"] == ";" and cells["semicolon"][0] == {"a": "1,5", "b": "2,5"}
    assert cells["preamble"] == {0: {"a": "1", "b": "2"}}
    assert tables["greek1253"]["encoding"] == "cp1253" and cells["greek1253"][0] == {"Όνομα": "Αθήνα", "Τιμή": "5"}
    assert list(cells["bom"][0]) == ["a", "b"]


def test_headers_and_rows(parsed):
    tables, cells = parsed
    assert tables["dupes"]["names"] == ["a", "a_2", "col_3", "b"]
    assert cells["ragged"] == {0: {"a": "1", "b": "2", "c": None}, 1: {"a": "1", "b": "2", "c": "3"}}
    assert not tables["banner"]["header_trusted"] and tables["banner"]["dropped_rows"] == 2
    assert len(cells["banner"]) == 2
    assert tables["footnote"]["row_count"] == 2 and tables["footnote"]["dropped_rows"] == 1


def test_quotes_and_names(spark):
    body = 'a,a_2,a\n"x,""1""","two\nlines",3\n5" pipe,6" pipe,7\n'
    frame = spark.createDataFrame([("q", bytearray(body.encode()), True)], "rid string, content binary, body_complete boolean")
    rows = payloads.parse_delimited(frame).filter("row_idx >= 0").orderBy("row_idx").collect()
    assert rows[0]["names"] == ["a", "a_2", "a_3"]
    assert [r["cells"] for r in rows] == [['x,"1"', "two\nlines", "3"], ['5" pipe', '6" pipe', "7"]]


def test_no_table_is_cut_by_default(spark):
    body = "a;b\n" + "".join(f"{i};{i}\n" for i in range(60_000)) + "x;y\n"
    frame = spark.createDataFrame([("x", bytearray(body.encode()), True)], "rid string, content binary, body_complete boolean")
    parsed = payloads.parse_delimited(frame)
    assert payloads.payload_tables(parsed, frame).first()["row_count"] == 60_001
    assert {r["source_type"] for r in payloads.source_types(payloads.payload_cells(parsed)).collect()} == {"text"}


def test_completeness(parsed):
    tables, _ = parsed
    assert (tables["cut"]["row_count"], tables["cut"]["incomplete_reason"]) == (1, "byte_cap")
    assert tables["semicolon"]["complete"] and tables["semicolon"]["incomplete_reason"] is None


def test_errors_stay_rows(parsed):
    tables, _ = parsed
    assert {k for k, t in tables.items() if t["error_kind"]} >= {"nul", "blank", "html"}


def test_row_cap(spark):
    body = "a,b\n" + "".join(f"{i},{i}\n" for i in range(50))
    frame = spark.createDataFrame([("x", bytearray(body.encode()), True)], "rid string, content binary, body_complete boolean")
    for cap, reason in ((5, "row_cap"), (50, None), (49, "row_cap")):
        found = payloads.payload_tables(payloads.parse_delimited(frame, cap), frame).first()
        assert (found["row_count"], found["incomplete_reason"]) == (min(cap, 50), reason)


def test_kinds(spark):
    bodies = {"zip": b"PK\x03\x04abc", "pdf": b"%PDF-1.4", "ole": b"\xd0\xcf\x11\xe0x", "gzip": b"\x1f\x8bx", "png": b"\x89PNG", "empty": b"  \n", "html": b" <HTML>",
              "xml": b"<?xml v", "json": b"\xef\xbb\xbf [1]", "binary": b"ab\x00cd", "csv": b"a;b", "jpeg": b"\xff\xd8\xff\xe0", "sqlite": b"SQLite format 3\x00"}
    frame = spark.createDataFrame([(k, bytearray(b)) for k, b in bodies.items()], "want string, content binary")
    got = frame.select("want", payloads.payload_kind(F.col("content")).alias("kind")).collect()
    assert {r["want"]: r["kind"] for r in got} == {k: k for k in bodies}
    typed = frame.filter("want = 'csv'").select(payloads.payload_kind(F.col("content"), F.lit("text/HTML")).alias("k")).first()
    assert typed["k"] == "html"


def test_source_types(spark):
    columns = {"i": ["1", "-2"], "n": ["1.5", "2"], "d": ["2024-01-01", ""], "b": ["ναι", "no"], "g": ["86,6", "1"], "t": ["x", "1"], "e": ["", None], "ts": ["2024-01-01T10:00", "2024-01-02 11:00"]}
    cells = spark.createDataFrame(
        [("r", i, c, name, v) for c, (name, vs) in enumerate(columns.items()) for i, v in enumerate(vs)], "rid string, row_idx long, col_idx int, col_name string, cell string")
    got = {r["col_name"]: r["source_type"] for r in payloads.source_types(cells).collect()}
    assert got == {"i": "integer", "n": "number", "d": "date", "b": "boolean", "g": "text", "t": "text", "e": "text", "ts": "timestamp"}


def test_records(spark):
    bodies = {"list": '[{"b": 1, "a": "x"}, {"a": null, "c": {"d": [1]}, "e": true}]', "one": '{"n": 1, "rows": [{"a": 1}]}', "two": '{"x": [], "y": []}',
              "none": '{"x": 1}', "scalars": "[1, 2]", "bad": "[{"}
    frame = spark.createDataFrame(list(bodies.items()), "rid string, content string")
    rows = payloads.parse_records(frame).cache()
    assert {r["rid"] for r in rows.filter("error_kind is not null").collect()} == {"two", "none", "scalars", "bad"}
    header = payloads.record_header(rows)
    assert [r["col_name"] for r in header.filter("rid = 'list'").orderBy("col_idx").collect()] == ["b", "a", "c", "e"]
    cells = {(r["row_idx"], r["col_name"]): r["cell"] for r in payloads.record_cells(rows, header).filter("rid = 'list'").collect()}
    assert cells[(0, "b")] == "1" and cells[(1, "c")] == '{"d":[1]}' and cells[(1, "e")] == "true" and cells[(1, "b")] is None


def test_pages(spark):
    fields = [("_id", "int4"), ("v", "numeric"), ("w", "geo")]
    pages = spark.createDataFrame([
        ("full", 0, 2, fields, [{"_id": "1", "v": "5"}, {"_id": "2", "v": "6", "w": "x"}]), ("short", 0, 3, fields, [{"v": "1"}]),
    ], payloads.PAGES)
    tables = {r["rid"]: (r["row_count"], r["complete"], r["incomplete_reason"]) for r in payloads.paged_tables(pages).collect()}
    assert tables == {"full": (2, True, None), "short": (1, False, "page_stop")}
    columns = payloads.paged_columns(pages)
    assert [(r["col_name"], r["source_type"]) for r in columns.filter("rid = 'full'").orderBy("col_idx").collect()] == [("v", "number"), ("w", "text")]
    assert payloads.paged_cells(pages, columns).filter("rid = 'full' and col_name = 'w' and row_idx = 1").first()["cell"] == "x"


def test_files(spark, tmp_path):
    (tmp_path / "one.csv").write_bytes(b"a;b\n1;2\n")
    (tmp_path / "two.csv").write_bytes(b"a;b\n3;4\n")
    cells = payloads.payload_cells(payloads.parse_delimited(payloads.read_files(spark, str(tmp_path), "*.csv")))
    assert sorted(r["cell"] for r in cells.collect()) == ["1", "2", "3", "4"]


SPLIT_BODIES = {
    **{k: b for k, (b, c) in BODIES.items() if c},
    "quotes": ('a,a_2,a\n"x,""1""","two\nlines",3\n5" pipe,6" pipe,7\n"' + "long\n\n" * 40 + '",8,9\r\n10,"11"x,12\n').encode(),
    "open": b'a;b\n1;2\n"never;closed\n3;4\n',
    "runaway": b'a;b\n1;2\n"' + b"and so on\n" * 20_000,
    "returns": b"a;b\r1;2\r3;4\r",
    "marks": b"\xef\xbb\xbfa;b\r\n\r\n1;2\r\n",
}


def test_splits_of_files_read_like_bodies(spark, tmp_path):
    for name, body in SPLIT_BODIES.items():
        folder = tmp_path / ("large" if name == "runaway" else "small")
        folder.mkdir(exist_ok=True)
        (folder / name).write_bytes(body)
    frame = spark.createDataFrame([(k, bytearray(b), True) for k, b in SPLIT_BODIES.items()], "rid string, content binary, body_complete boolean")
    order = ["rid", "row_idx"]
    whole = payloads.parse_delimited(frame).withColumn("encoding", F.replace("encoding", F.lit("-sig"), F.lit(""))).orderBy(*order).collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size, folder in (("90", "small"), ("50000", "large")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            split = payloads.parse_files(spark, str(tmp_path / folder)).withColumn("rid", F.element_at(F.split("rid", "/"), -1)).orderBy(*order).collect()
            assert split == [r for r in whole if not folder or (r["rid"] == "runaway") == (folder == "large")], size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    kinds = {r["rid"]: r["error_detail"] for r in whole if r["row_idx"] == -1}
    assert "longer" in kinds["runaway"] and kinds["open"] is None and "NUL" in kinds["nul"]


def test_packages(spark, tmp_path):
    (tmp_path / "page.json").write_text('{"count": 2, "results": [{"id": "d1", "name": "n", "type": "dataset", "state": "active", "title": " T ", "notes": "N", '
        '"title_translated": {"en": "E"}, "tags": [{"name": "t1"}, {"name": "t2"}], "organization": {"name": "o", "title": "O"}, "theme": ["http://x/ENVI"], '
        '"temporal_coverage": [{"start": "2020", "end": "2021"}], "resources": [{"id": "r1", "format": " csv", "size": "12", "mimetype": "", "mimetype_inner": "m"}, '
        '{"id": "r2", "format": null, "size": ""}]}, {"id": "d2", "name": "x", "type": "dataset", "state": "deleted"}]}')
    found = packages.read_packages(spark, str(tmp_path)).cache()
    row = packages.normalise_datasets(found, F.lit("now")).collect()
    assert len(row) == 1
    assert row[0]["search_text"] == "T\nE\nt1 t2\nN" and row[0]["num_resources"] == 2 and row[0]["temporal_start"] == "2020" and row[0]["spatial_text"] is None
    resources = {r["id"]: r.asDict() for r in packages.normalise_resources(found).collect()}
    assert resources["r1"]["is_tabular"] and resources["r1"]["size"] == 12 and resources["r1"]["mimetype"] == "m"
    assert not resources["r2"]["is_tabular"] and resources["r2"]["size"] is None and not resources["r2"]["datastore_active"]
    assert tuple(packages.harvest_counts(found).first()) == (2, 1, 1, 2)


def test_kinds_behind_blanks_and_marks(spark):
    bodies = {"empty": " ﻿ 　\n".encode(), "html": " ﻿ \n<!DOCTYPE html>x".encode(), "json": b"\xef\xbb\xbf\n [1]  ", "csv": "a;b ﻿<html".encode()}
    frame = spark.createDataFrame([(k, bytearray(b)) for k, b in bodies.items()], "want string, content binary")
    found = frame.select("want", payloads.payload_kind(F.col("content")).alias("kind")).collect()
    assert [r["kind"] for r in found] == [r["want"] for r in found]


def test_bodies_are_not_shuffled_to_their_parsers(spark):
    """Resources and bodies meet by id; a body declared to be JSON is read as JSON whatever it looks like."""
    rng = random.Random(5)
    sized = [(str(i), bytearray(b'[{"a": "x"}]' if i % 2 else b"a;b\n" + b"".join(b"%s;y\n" % rng.randbytes(8).hex().encode() for _ in range(2000))), True) for i in range(40)]
    odd = [("odd", bytearray(b"a;b\n1;2\n"), True), ("bad", bytearray(b"\x00\x01"), False), ("nobody", bytearray(b"a;b\n1;2\n"), True)]
    landed = spark.createDataFrame(sized + odd, "rid string, content binary, body_complete boolean")
    resources = spark.createDataFrame([*[(str(i), "CSV") for i in range(40)], ("odd", "json "), ("bad", "CSV"), ("gone", "CSV")], "id string, format string")
    store = spark.sparkContext._jsc.sc().statusStore()
    lists, none = spark.sparkContext._jvm.java.util.ArrayList, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: store.stageList(lists(), False, False, none, lists())
    before = sum(stages().apply(i).shuffleWriteBytes() for i in range(stages().size()))
    found = {r["rid"]: (r["row_count"], r["complete"], r["error_kind"]) for r in loading.load_tables(resources, landed).tables.collect()}
    written = sum(stages().apply(i).shuffleWriteBytes() for i in range(stages().size())) - before
    assert written < 100_000  # of twenty bodies of 38 kB each
    assert found["0"] == (2000, True, None) and found["1"] == (1, True, None) and len(found) == 43
    assert found["odd"] == (0, None, "malformed") and found["bad"][2] == "malformed" and found["gone"] == (0, None, "unavailable")
