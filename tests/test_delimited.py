"""Parallel scans of delimited text against the csv module."""

import csv
import gzip
import io
import random

import pytest

from sequor.sources import delimited as D
from sequor.sources import tabular


def rows_of(text):
    return [r for r in csv.reader(io.StringIO(text, newline=""))]


def content(n, seed=3):
    rng = random.Random(seed)
    cells = ["plain", "", 'a "quoted" word', "two\nlines", "three\n\nlines, with\ncommas", 'x"', '""', "é語", " spaced ", "\r\nx", "long " * 40]
    out = io.StringIO(newline="")
    w = csv.writer(out)
    w.writerow(["id", "a", "b"])
    for i in range(n):
        w.writerow([i, rng.choice(cells), rng.choice(cells)])
    return out.getvalue()


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def read(df):
    return [[c or "" for c in r[:-1]] for r in sorted(df.collect(), key=lambda r: r.row_ord)]


def test_one_file_over_many_splits_equals_the_whole(spark, tmp_path, small_splits):
    text = content(300)
    (tmp_path / "a.csv").write_text(text, encoding="utf-8", newline="")
    df = D.read_table(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "a", "b", "row_ord"]
    assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 20
    assert read(df) == rows_of(text)[1:]


@pytest.mark.parametrize("text", ['a,b\n"x\n' + "y\n" * 900 + '",2\n3,4\n', 'a,b\n1,5" long\n2,"x ""y"" z"\n3,4" and 5"\n', "a,b\r\n1,2\r\n\r\n3,\"x\r\ny\"\r\n", "a,b\n1\n1,2,3\n", '﻿a,b\n"1\n,""2""","z"'])
def test_cells_over_many_blocks_and_stray_quotes(spark, tmp_path, small_splits, text):
    (tmp_path / "a.csv").write_text(text, encoding="utf-8", newline="")
    df = D.read_table(spark, str(tmp_path / "a.csv"))
    want = [(r + ["", ""])[:2] for r in rows_of(text.lstrip("﻿"))[1:] if r]
    assert df.columns == ["a", "b", "row_ord"] and read(df) == want


def test_gzip_is_told_by_its_bytes(spark, tmp_path):
    text = content(40)
    raw = text.encode()
    for name, data in (("named.csv.gz", gzip.compress(raw)), ("unnamed.csv", gzip.compress(raw)), ("plain.csv.gz", raw)):
        (tmp_path / name).write_bytes(data)
        assert read(D.read_table(spark, str(tmp_path / name))) == rows_of(text)[1:], name


def test_bad_bytes_are_replaced_and_open_quotes_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'a,b\n1,\xff\xfe\n2,"open\nto the end')
    assert read(D.read_table(spark, str(tmp_path / "a.csv"))) == [["1", "��"], ["2", "open\nto the end"]]
    (tmp_path / "b.csv").write_bytes(b"")
    with pytest.raises(ValueError, match="no header"):
        D.read_table(spark, str(tmp_path / "b.csv"))


def test_several_files_have_headers_of_their_own(spark, tmp_path, small_splits):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(content(50, k), encoding="utf-8", newline="")
    got = sorted([c or "" for c in r[:-1]] for r in D.read_table(spark, str(tmp_path)).collect())
    assert got == sorted(r for k in range(3) for r in rows_of(content(50, k))[1:])


def test_states_of_lines_equal_the_csv_module():
    rng = random.Random(1)
    for _ in range(3000):
        line = "".join(rng.choice('a,"\t') for _ in range(rng.randint(0, 9)))
        for inside in (False, True):
            # a cell that is still open takes in the next line
            rows = rows_of(('"x\n' if inside else "") + line + "\nZ")
            assert D.leaves_inside(line, inside) == (not (rows and rows[-1] == ["Z"])), (line, inside)


def test_missing_columns_are_named(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="label: missing columns z"):
        tabular.read_csv(spark, str(tmp_path / "a.csv"), ("x", "z"), "label")
