"""The range reader against Spark's reader of whole files."""

import csv
import random

import pytest

from revgauge.sources import csv_ranges
from revgauge.sources.reviews import CSV_OPTIONS

PIECES = ["a", "b c", '"', "\n", "\r\n", ",", '""', "é", "", " ", "x" * 50, "\n\n", "\\", '\\"', "\t"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r = random.Random(3)
    path = tmp_path_factory.mktemp("csv")
    for i, (line, quoting) in enumerate([("\n", csv.QUOTE_MINIMAL), ("\r\n", csv.QUOTE_ALL), ("\n", csv.QUOTE_NONNUMERIC)]):
        with open(path / f"f{i}.csv", "w", newline="") as f:
            w = csv.writer(f, lineterminator=line, quoting=quoting)
            w.writerow(["ID", " Title ", 'n,a"me', "x" if i else "x\ny"])
            w.writerows([f"{i}-{k}", *("".join(r.choice(PIECES) for _ in range(r.randint(0, 6))) for _ in range(3))] for k in range(150))
            if i == 2:
                f.write("short\n\n\nlong,1,2,3,4,5\n ,\n1,\"open at the\nend\",,")
    return path


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture
def ranges_of(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]

    def size(n):
        for k, v in zip(keys, (n, 1), strict=True):
            spark.conf.set(k, str(v))

    yield size
    for k, v in zip(keys, before, strict=True):
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [37, 300, 5000, 1 << 27])
def test_equals_whole_files(spark, folder, ranges_of, size):
    ranges_of(size)
    whole = spark.read.options(**CSV_OPTIONS).csv(str(folder))
    got = csv_ranges.read_csv(spark, str(folder), CSV_OPTIONS)
    assert got.columns == whole.columns
    assert rows(got) == rows(whole)
    one = str(folder / "f1.csv")
    assert rows(csv_ranges.read_csv(spark, one, CSV_OPTIONS)) == rows(spark.read.options(**CSV_OPTIONS).csv(one))


def test_one_file_is_many_tasks(spark, folder, ranges_of):
    ranges_of(500)
    assert csv_ranges.records(spark, str(folder / "f0.csv")).where("file is not null").rdd.getNumPartitions() > 8


@pytest.mark.parametrize("body, n", [("", 0), ("\n\n", 0), ("1,\"a\nb\",c,d", 1), ("\"\",,,\n", 1)])
def test_small_files(spark, tmp_path, ranges_of, body, n):
    ranges_of(3)
    path = tmp_path / "one.csv"
    path.write_text("ID,a,b,c\n" + body)
    got = csv_ranges.read_csv(spark, str(path), CSV_OPTIONS)
    assert rows(got) == rows(spark.read.options(**CSV_OPTIONS).csv(str(path))) and got.count() == n


@pytest.mark.parametrize("size", [8, 1 << 27])
@pytest.mark.parametrize("body", ['1,5" tall,x\n2,y,"5\n6"\n', '1,"open,2\n3,4,5\n', '1,"a"b,c\n'])
def test_odd_quotes_are_an_error(spark, tmp_path, ranges_of, body, size):
    ranges_of(size)
    path = tmp_path / "odd.csv"
    path.write_text("ID,a,b\n" + body)
    with pytest.raises(Exception, match="quote"):
        csv_ranges.read_csv(spark, str(path), CSV_OPTIONS).collect()
