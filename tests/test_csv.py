"""CSV rows by byte ranges against the csv module."""

import csv
import io
import os
import tempfile
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from waymerge.sources.csvrows import ends_inside, read_rows, split_row
from waymerge.sources.files import read_places_csv, saved_archives


def reference(text):
    rows = [r for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")) if r]
    return (rows[0], rows[1:]) if rows else (None, [])


@pytest.fixture
def narrow(spark):
    """Byte ranges of a few bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "23", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def got(spark, path):
    rows = sorted(((r["__file"], r["__n"], tuple(r["__header"]), tuple(r["__values"])) for r in read_rows(spark, path).collect()))
    by = {}
    for file, n, header, values in rows:
        by.setdefault(os.path.basename(file), []).append((n, list(header), list(values)))
    return by


def write(files):
    path = tempfile.mkdtemp(prefix="waymerge-test-")
    for name, text in files.items():
        with open(f"{path}/{name}", "w", newline="", encoding="utf-8") as f:
            f.write(text)
    return path


def expected(files):
    out = {}
    for name, text in files.items():
        header, rows = reference(text)
        if rows:
            out[name] = [(i, header, r) for i, r in enumerate(rows, 1)]
    return out


field = st.text('ab,"\n é', max_size=12) | st.sampled_from(["", '5" pipe', "a\r\nb", '"', "x" * 60, "\n" * 30])
rows = st.lists(st.lists(field, min_size=1, max_size=4), max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(rows, st.sampled_from(["\n", "\r\n"]), st.sampled_from(["", "﻿", "\n\n", "\r\n"]), st.booleans()), min_size=1, max_size=3))
def test_written_rows(narrow, tables):
    files = {}
    for i, (table, end, before, cut) in enumerate(tables):
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator=end).writerows(table)
        text = before + out.getvalue()
        files[f"{i}.csv"] = text.rstrip("\r\n") if cut else text
    assert got(narrow, write(files)) == expected(files)


@settings(max_examples=400, deadline=None)
@given(st.text('ab,"', max_size=14), st.text('ab,"', max_size=14))
def test_odd_quotes(first, second):
    """Stray quotes: the same open and closed fields, and the same texts, as in the csv module."""
    text = first + "\n" + second
    lines = [text] if ends_inside(first, False) else [first, second]
    assert [split_row(x) for x in lines if x] == [r for r in csv.reader(io.StringIO(text, newline="")) if r]


def test_large_rows_and_many_ranges(narrow):
    spark = narrow
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2500")
    body = [["t%d" % i, "line\nbreak \"quoted\", " * (i % 7), "40.5", "-74"] for i in range(300)]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows([["Title\nof place", "Note", "lat", "lng"], *body, ["long", "x\n" * 5_000, "", ""], ["end"]])
    files = {"a.csv": "\n\n" + out.getvalue(), "empty.csv": "", "head.csv": "Title,Note\n", "blank.csv": "\n\r\n"}
    path = write(files)
    assert got(spark, path) == expected(files)
    lines = spark.read.options(lineSep="\n").text(path)
    assert lines.rdd.getNumPartitions() > 8


def test_places_with_quoted_header_and_blank_first_line(spark):
    path = write({"a.csv": '\n"Name","notes","la\nt",lat,lng\nA,"x\ny",,1,2\n,no title,,,\n\nB\n'})
    places, rejects = read_places_csv(spark, path)
    assert sorted((r.title, r.notes, r.latitude, r.ord.n) for r in places.collect()) == [("A", "x\ny", 1.0, 1), ("B", None, None, 3)]
    assert [(r.row, r.reason) for r in rejects.collect()] == [(3, "Missing title/name")]


def zipped(members, how=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", how) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def test_archives_by_member(spark, monkeypatch):
    body = [["t%d" % i, "a\nb, \"c\"" * (i % 4)] for i in range(60)]
    out = io.StringIO(newline="")
    csv.writer(out).writerows([["Title", "Note"], *body])
    mixed = {"Takeout/Saved/One.csv": "\ufeff" + out.getvalue(), "Takeout/saved/two.CSV": '\r\n"na\nme",Comment,Title\n,x,"Té"', "Takeout/Saved/none.csv": "", "other.csv": "Title\nno\n"}
    whole = zipped(mixed)
    at = whole.index(b"PK", 4) - 20  # inside the first member's packed bytes
    archives = [("a.zip", whole), ("b.zip", zipped({"x/list.csv": "Name\nB\n"}, zipfile.ZIP_BZIP2)), ("c.zip", zipped({"c.csv": "Name\nC"}, zipfile.ZIP_STORED)), ("d.zip", b"no zip"), ("e.zip", b""), ("f.zip", None),
                ("g.zip", whole[:at] + bytes(20) + whole[at + 20:])]
    df = spark.createDataFrame([(p, c, 1) for p, c in archives], "path string, content binary, member int")
    places, rejects = saved_archives(df)
    found = {}
    for r in places.collect():
        found.setdefault((r.ord.file, r.listName), []).append((r.ord.n, r.title, r.notes))
    want_one = [(i, t, n or None) for i, (t, n) in enumerate(body, 1)]
    assert sorted(found["a.zip!Takeout/Saved/One.csv", "One"]) == want_one
    assert found["a.zip!Takeout/saved/two.CSV", "two"] == [(1, "Té", "x")]
    assert found["b.zip!x/list.csv", "list"] == [(1, "B", None)] and found["c.zip!c.csv", "c"] == [(1, "C", None)]
    assert {k[0].split("!")[0] for k in found} <= {"a.zip", "b.zip", "c.zip", "g.zip"}
    assert {"d.zip", "e.zip", "f.zip", "g.zip"} == {r.archive for r in rejects.collect()}
    assert saved_archives(df.limit(0))[0].count() == 0
