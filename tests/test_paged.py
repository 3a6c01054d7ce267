import pytest
from test_sources import write

from sequor.sources.paged import PagedCsv


def reader(spark, folder, **options):
    spark.dataSource.register(PagedCsv)
    read = spark.read.format("paged_csv").option("url", f"file://{folder}/p-{{page}}.csv").option("page_size", "2").option("attempts", "1")
    for k, v in options.items():
        read = read.option(k, v)
    return read


def fill(folder, *sizes):
    for page, n in enumerate(sizes):
        write(folder / f"p-{page}.csv", ["a", "b"], *[[f"{page}-{i}", "x,y"] for i in range(n)])
    return sum(sizes)


def test_pages_are_partitions(spark, tmp_path):
    write(tmp_path / "p-0.csv", ["a", "b"], ["1", "x,y"], ["2", "z"])
    write(tmp_path / "p-1.csv", ["a", "b"], ["3", ""])
    df = reader(spark, tmp_path, pages="2").load()
    assert sorted(map(tuple, df.collect())) == [("1", "x,y"), ("2", "z"), ("3", "")]
    assert df.rdd.getNumPartitions() == 2
    assert reader(spark, tmp_path).load().count() == 3
    write(tmp_path / "p-1.csv", ["a", "c"], ["3", ""])
    with pytest.raises(Exception, match="header changed"):
        reader(spark, tmp_path, pages="2").load().collect()


def test_an_outage_is_an_error_and_not_the_end(spark, tmp_path):
    fill(tmp_path, 2, 2, 2, 1)
    (tmp_path / "p-2.csv").unlink()
    for options in ({}, {"pages": "4"}):
        with pytest.raises(Exception, match="No such file|p-2"):
            reader(spark, tmp_path, **options).load().collect()


def test_a_short_page_before_the_last_is_an_error(spark, tmp_path):
    fill(tmp_path, 2, 1, 2)
    with pytest.raises(Exception, match="page 1 has 1 rows"):
        reader(spark, tmp_path, pages="3").load().collect()


def test_more_pages_than_allowed_are_an_error(spark, tmp_path):
    assert fill(tmp_path, *[2] * 101) == 202
    with pytest.raises(Exception, match="more than 100 pages"):
        reader(spark, tmp_path).load().collect()
    (tmp_path / "p-100.csv").unlink()
    write(tmp_path / "p-99.csv", ["a", "b"], ["last", ""])
    assert reader(spark, tmp_path).load().count() == 199
    write(tmp_path / "p-99.csv", ["a", "b"], ["1", ""], ["2", ""])
    write(tmp_path / "p-100.csv", ["a", "b"])
    assert reader(spark, tmp_path, max_pages="101").load().count() == 200
