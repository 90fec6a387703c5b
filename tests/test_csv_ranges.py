"""CSV files read by byte ranges against one task a file."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from usemeter.sources.csv_ranges import inside_after
from usemeter.operators.replies import first_prose
from usemeter.sources.sheets import _large_sheets, read_sheets


def rows_of(spark, path, **how):
    return sorted((r.sheet_id, r.row_no, r.cells) for r in read_sheets(spark, str(path), columns=8, **how).collect())


def ranged(spark, path, split):
    """Every file by ranges of ``split`` bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        return rows_of(spark, path, range_bytes=0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def written(folder, name, records, ends="\n", mark="", encoding="utf-8"):
    text = io.StringIO()
    csv.writer(text, lineterminator=ends).writerows(records)
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes((mark + text.getvalue()).encode(encoding))


def records(seed, n, breaks="\n"):
    rnd = random.Random(seed)
    parts = ["a", "b c", ",", '"', '""', breaks, breaks * 2, "\u00e9\u6f22", " ", ""]
    cell = lambda: "".join(rnd.choices(parts, k=rnd.randint(0, 7)))
    return [[f"r{i}", *[cell() for _ in range(rnd.randint(1, 4))], "x"] for i in range(n)]


@pytest.mark.parametrize("ends, mark", [("\n", ""), ("\r\n", "\ufeff")])
def test_ranges_find_the_same_records(spark, tmp_path, ends, mark):
    folder = tmp_path / "in"
    for i in range(2):
        written(folder, f"{i}.csv", records(i, 60, breaks=ends), ends, mark)
    long = [["head", "x"], ["q", "line\n" * 400 + 'say "so", and\n"' + "y" * 900, "x"], ["after", "", "x"]]
    written(folder, "long.csv", long, "\n")
    want = rows_of(spark, folder)
    assert len(want) > 100
    for split in (37, 400):
        assert ranged(spark, folder, split) == want


def test_blank_lines_and_plain_quotes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    text = 'a,b\n\n5" disk,x\n"q"tail,"in\n\nside"\n   \n,,\n"",""\nlast,"no line end\nhere"'
    (folder / "odd.csv").write_text(text, encoding="utf-8")
    (folder / "empty.csv").write_text("", encoding="utf-8")
    want = rows_of(spark, folder)
    for split in (5, 11, 1000):
        assert ranged(spark, folder, split) == want


def test_old_encoding_is_a_matter_of_the_whole_file(spark, tmp_path):
    folder = tmp_path / "in"
    written(folder, "ansi.csv", [[f"r{i}", "plain", "x"] for i in range(40)] + [["Caf\u00e9 \u2013 \u20ac", "q\nq", "x"]], encoding="cp1252")
    written(folder, "utf8.csv", [["Caf\u00e9 \u2013 \u20ac", "q\nq", "x"]])
    want = rows_of(spark, folder)
    assert any("Caf\u00e9 \u2013 \u20ac" in r[2] for r in want if "ansi" in r[0])
    assert ranged(spark, folder, 50) == want


def test_large_files_only(spark, tmp_path):
    """Files up to the limit are read whole, larger ones by ranges: each once."""
    folder = tmp_path / "in"
    written(folder, "small.csv", records(1, 5))
    written(folder, "large.csv", records(2, 200))
    limit = (folder / "small.csv").stat().st_size
    assert rows_of(spark, folder, range_bytes=limit) == rows_of(spark, folder)


def test_lone_carriage_returns_are_refused(spark, tmp_path):
    (tmp_path / "mac.csv").write_bytes(b"a,b\rc,d\r" * 20)
    with pytest.raises(Exception, match="lone carriage return"):
        ranged(spark, tmp_path, 1000)


def test_lines_as_functions_of_one_bit(spark):
    lines = ['', 'a,b', '"a', 'a"b', '"a""b', 'a",b', '"a","b', 'x","y"', '""', '"","', ',"', '"q"z,"', '"a"b"c']
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").select(
        "i", inside_after(F.col("x"), False).alias("o"), inside_after(F.col("x"), True).alias("n")).collect()

    def after(line, inside):  # the state that Python's reader is in behind the line
        start = '"' if inside else ""
        return len(list(csv.reader(io.StringIO(start + line + "\nz\n")))) == 1

    for r in got:
        assert (r.o, r.n) == (after(lines[r.i], False), after(lines[r.i], True)), lines[r.i]


def test_records_and_replies_are_parsed_once(spark, tmp_path):
    """A filter on what is parsed would parse each record again for every cell, and each reply twice."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    written(tmp_path / "in", "a.csv", records(3, 20))
    assert plan(_large_sheets(spark, str(tmp_path / "in"), 8, 0)).count("from_csv") == 1
    replies = spark.createDataFrame([("a", 1, '{"usage": "u"}'), ("a", 2, "x"), ("b", 1, None)], "ord string, attempt int, reply string")
    assert plan(first_prose(replies, "ord", 3)).count("split(reply") < 2
    assert [tuple(r) for r in first_prose(replies, "ord", 3).collect()] == [("a", "", "u", "")]


def test_ranges_with_and_without_quotes(spark, tmp_path):
    """Ranges without quotes lie inside cells, or hold a record a line; both beside ranges with quotes."""
    rows = [[f"r{i}", "x"] for i in range(40)]
    written(tmp_path / "in", "a.csv", [*rows, ["q", "plain\n" * 60], *rows, ["last", 'say "so"']])
    want = rows_of(spark, tmp_path / "in")
    for split in (50, 300):
        assert ranged(spark, tmp_path / "in", split) == want
