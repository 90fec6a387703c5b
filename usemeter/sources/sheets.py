"""Submission sheets: CSV scan, header row, column mapping, canonical rows."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usemeter.config import FIELDS, HEADER_ALIASES, LABEL_HINTS, UsageSpec
from usemeter.functions.binding import let
from usemeter.functions.repo import is_repo_link
from usemeter.functions.text import BLANK_CLASS, any_of, blank_if_null, first_line, header_key, strip
from usemeter.session import stored
from usemeter.sources.csv_ranges import read_ranges

COLUMNS = 256
_SENTINELS = 8  # cells beyond the columns read that tell a wider sheet
MIN_SUBSTRING_ALIAS = 5
_EMAIL = rf"(?U)[^@{BLANK_CLASS}]+@[^@{BLANK_CLASS}]+\.[^@{BLANK_CLASS}]+"

# Windows-1252 differs from ISO-8859-1 in 0x80-0x9F only.
_C1 = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
_C1_FROM = "".join(chr(b) for b in _C1)
_C1_TO = bytes(_C1).decode("cp1252")


_FILES = {"pathGlobFilter": "*.[cC][sS][vV]"}


def _csv_options(encoding: str, columns: int) -> dict[str, str]:
    return {
        "header": "false", "multiLine": "true", "quote": '"', "escape": '"', "encoding": encoding,
        "maxColumns": str(max(20_480, columns + _SENTINELS)), "maxCharsPerColumn": "-1",
    }


def _cells_of(cells: Column) -> Column:
    """Cells cut behind the last filled one."""
    return F.slice(cells, F.lit(1), _filled_width(cells))


def default_range_bytes(spark: SparkSession) -> int:
    """Spark's own limit for a task's part of a file: larger files are read by ranges of it."""
    return int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")))


def _scan(spark: SparkSession, path: str, encoding: str, columns: int, upto: int) -> DataFrame:
    """``sheet_id, row_no, cells`` of all rows of files of up to ``upto`` bytes, cut behind their last filled cell.

    A multi-line file is read in order by one task, so the running id grows by one a row within a
    sheet; less the sheet's first one it is the place in the sheet, whatever else the task reads.
    Blank rows have no cells.
    """
    width = columns + _SENTINELS
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    raw = spark.read.options(**_FILES, **_csv_options(encoding, columns)).schema(schema).csv(path)
    cells = F.array(*[blank_if_null(F.col(f"c{i}")) for i in range(width)])
    return raw.where(F.col("_metadata.file_size") <= upto).select(
        F.col("_metadata.file_path").alias("sheet_id"),
        F.monotonically_increasing_id().alias("_id"), cells.alias("cells"),
    ).select("sheet_id", "_id", _cells_of(F.col("cells")).alias("cells"))


def _large_sheets(spark: SparkSession, path: str, columns: int, above: int) -> DataFrame:
    """``sheet_id, row_no, cells`` of all rows of larger files, each read by many tasks; blank rows have no cells."""
    width = columns + _SENTINELS
    ddl = ", ".join(f"c{i} string" for i in range(width))
    decode = F.translate(F.decode(F.col("text").cast("binary"), "ISO-8859-1"), _C1_FROM, _C1_TO)
    rows = read_ranges(spark, path, above, ddl, _csv_options("UTF-8", columns), decode, _FILES)
    cells = lambda r: F.array(*[blank_if_null(r[f"c{i}"]) for i in range(width)])
    # Bound names: a plain column is put in wherever it is used, and the record parsed there again.
    return rows.select("sheet_id", "row_no", let(let(F.col("record"), cells), _cells_of).alias("cells"))


def _has_large_files(spark: SparkSession, path: str, above: int) -> bool:
    listed = spark.read.format("binaryFile").options(**_FILES).load(path).select("length")
    return not listed.where(F.col("length") > above).isEmpty()


def _in_sheets(rows: DataFrame) -> DataFrame:
    """Stored rows with their place in the sheet in place of the running id, blank rows left out."""
    # A row a sheet, and the driver has listed the sheets' files: few enough to broadcast.
    first = F.broadcast(rows.groupBy("sheet_id").agg(F.min("_id").alias("_first")))
    placed = rows.where(F.size("cells") > 0).join(first, "sheet_id")
    return placed.select("sheet_id", (F.col("_id") - F.col("_first")).alias("row_no"), "cells")


def _filled_width(cells: Column) -> Column:
    """Position of the last cell with any content, 0 if there is none."""
    return F.array_max(
        F.transform(cells, lambda c, i: F.when(strip(c) != "", i + 1).otherwise(0))
    )


def other_files(spark: SparkSession, path: str) -> DataFrame:
    """``sheet_id`` of the files below ``path`` that are no CSV; their contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.select(F.col("path").alias("sheet_id")).where(~F.rlike("path", F.lit(r"(?i)\.csv$")))


def read_sheets(
    spark: SparkSession, path: str, columns: int = COLUMNS, range_bytes: int | None = None
) -> DataFrame:
    """``sheet_id, row_no, cells`` of all CSV files below ``path``, blank rows left out.

    ``(sheet_id, row_no)`` is the file and the place in it: the same in every run, however files are
    packed into tasks and whatever other files there are.  Files are UTF-8 (with or without a byte
    order mark) or, if that fails anywhere in the file, Windows-1252.  Files of up to ``range_bytes`` (by
    default ``spark.sql.files.maxPartitionBytes``, the size of a task's part of a file) are parsed whole,
    one task a file; larger ones by such parts (``csv_ranges``), which finds the same rows.  Cells beyond
    ``columns`` are kept for the first few, see ``unusable_sheets``.
    """
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in ("", ".csv"):
        raise ValueError(f"unsupported sheet type: {suffix} (use .csv)")
    limit = default_range_bytes(spark) if range_bytes is None else range_bytes
    rows = _small_sheets(spark, path, columns, limit)
    if not _has_large_files(spark, path, limit):
        return rows
    large = stored(_large_sheets(spark, path, columns, limit), "large-sheets")
    return rows.unionByName(large.where(F.size("cells") > 0))  # on stored rows: a filter before parses them twice


def _small_sheets(spark: SparkSession, path: str, columns: int, upto: int) -> DataFrame:
    """Sheets parsed whole, once, and stored.

    A replacement character marks a sheet as suspect; only then are the bytes checked, line by line, and
    the broken sheets parsed again.
    """
    rows = stored(_scan(spark, path, "UTF-8", columns, upto), "sheets")
    replaced = F.exists("cells", lambda c: F.contains(c, F.lit("\ufffd")))
    suspects = rows.where(replaced).select("sheet_id").distinct()
    if suspects.isEmpty():
        return _in_sheets(rows)
    # The text source hands on a line's bytes as they are.
    bytes_ = spark.read.options(**_FILES).text(path).select(
        F.col("_metadata.file_path").alias("sheet_id"), "value"
    )
    broken = stored(
        bytes_.where(~F.is_valid_utf8("value")).select("sheet_id").distinct()
        .join(suspects, "sheet_id", "left_semi"), "broken",
    )
    decoded = F.transform("cells", lambda c: F.translate(c, _C1_FROM, _C1_TO))
    ansi = _scan(spark, path, "ISO-8859-1", columns, upto).join(broken, "sheet_id", "left_semi")
    return _in_sheets(rows.join(broken, "sheet_id", "left_anti")).unionByName(
        _in_sheets(stored(ansi.withColumn("cells", decoded), "sheets"))
    )


def resolve_columns(cells: DataFrame, spec: UsageSpec) -> DataFrame:
    """Per sheet the header row and the column of each field.

    ``sheet_id, header_row, <field>...`` with 0-based column numbers, null where a field has
    no column.  Sheets without a repo column and a label column are missing from the result.

    Only the first rows of a sheet are gathered (a rank limit before the shuffle); the width
    is a partial aggregate over all its rows.
    """
    caps = spec.caps
    width = cells.groupBy("sheet_id").agg(F.max(_filled_width(F.col("cells"))).alias("width"))
    order = Window.partitionBy("sheet_id").orderBy("row_no")
    head = (
        cells.withColumn("_at", F.row_number().over(order))
        .where(F.col("_at") <= caps.header_rows + caps.sample_rows)
        .groupBy("sheet_id")
        .agg(F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("rows"))
    )
    blanks = F.array_repeat(F.lit(""), F.col("width"))
    even = F.transform(
        "rows", lambda r: F.slice(F.concat(r["cells"], blanks), F.lit(1), F.col("width"))
    )
    candidates = (
        head.join(width, "sheet_id")
        .select("sheet_id", "width", "rows", even.alias("texts"))
        .select(
            "sheet_id", "width", "texts",
            F.posexplode(F.slice("rows", 1, caps.header_rows)).alias("at", "row"),
        )
        .select(
            "sheet_id",
            F.col("row.row_no").alias("header_row"),
            F.transform(F.get("texts", F.col("at")), strip).alias("headers"),
            F.slice("texts", F.col("at") + 2, F.lit(caps.sample_rows)).alias("sample"),
            F.greatest(F.lit(2), F.floor((F.col("width") + 1) / 2).cast("int")).alias("_need"),
        )
        .where(F.size(F.filter("headers", lambda h: h != "")) >= F.col("_need"))
    )
    claimed = F.filter(
        F.array(_claim_columns(F.col("headers"), F.col("sample"), spec)),
        lambda c: (_at(c, "github") >= 0) & (_at(c, "project") >= 0),
    )
    return (
        candidates.select("sheet_id", "header_row", F.explode(claimed).alias("columns"))
        .groupBy("sheet_id")
        .agg(F.min(F.struct("header_row", "columns")).alias("m"))
        .select(
            "sheet_id", "m.header_row",
            *[_null_if_none(_at(F.col("m.columns"), f)).alias(f) for f in FIELDS],
        )
    )


def _at(columns: Column, field: str) -> Column:
    return F.get(columns, F.lit(FIELDS.index(field)))


def _null_if_none(column: Column) -> Column:
    return F.when(column >= 0, column)


def _put(columns: Column, field: Column, value: Column) -> Column:
    return F.transform(columns, lambda c, i: F.when(i == field, value).otherwise(c))


def _first(flags: Column) -> Column:
    """0-based position of the first true, -1 if there is none."""
    return F.array_position(flags, True).cast("int") - 1


def _claim_columns(headers: Column, sample: Column, spec: UsageSpec) -> Column:
    """Column number per field (-1 for none) of one candidate header row.

    Each field in turn takes the first free column that suits it: header equal to an alias,
    then header containing a longer alias, then cell contents.  A claimed column is taken for
    all later steps, so this is a fold over the steps, not a ranking per field.
    """
    steps = [(i, True, HEADER_ALIASES[f]) for i, f in enumerate(FIELDS)] + [
        (i, False, tuple(a for a in HEADER_ALIASES[f] if len(a) >= MIN_SUBSTRING_ALIAS))
        for i, f in enumerate(FIELDS)
    ]
    step_rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("field"), F.lit(exact).alias("exact"),
                F.array(*[F.lit(a) for a in aliases]).alias("aliases"),
            )
            for i, exact, aliases in steps
        ]
    )

    def free(columns: Column, j: Column) -> Column:
        return ~F.array_contains(columns, j)

    def by_content(normed: Column, columns: Column) -> Column:
        return let(_claim_repo(columns, normed), lambda c: _claim_label(c, normed))

    def _claim_repo(columns: Column, normed: Column) -> Column:
        hits = F.transform(
            normed, lambda h, j: F.size(F.filter(sample, lambda r: is_repo_link(F.get(r, j), spec)))
        )

        def most(n: Column) -> Column:
            best = F.array_position(n, F.array_max(n)).cast("int") - 1
            wanted = (_at(columns, "github") < 0) & (F.array_max(n) > 0) & free(columns, best)
            return F.when(
                wanted, _put(columns, F.lit(FIELDS.index("github")), best)
            ).otherwise(columns)

        return let(hits, most)

    def _claim_label(columns: Column, normed: Column) -> Column:
        def values(j: Column) -> Column:
            cells = F.transform(sample, lambda r: strip(blank_if_null(F.get(r, j))))
            return F.slice(F.filter(cells, lambda v: v != ""), 1, spec.caps.label_values)

        # 2: plain text under a hinted header, 1: plain text, 0: neither or taken
        grades = F.transform(
            normed,
            lambda h, j: F.when(
                free(columns, j) & let(values(j), lambda v: _is_plain(v, spec)),
                F.when(any_of([F.contains(h, F.lit(w)) for w in LABEL_HINTS]), 2).otherwise(1),
            ).otherwise(0),
        )

        def label(g: Column) -> Column:
            best = F.when(
                F.array_max(g) > 0, F.array_position(g, F.array_max(g)).cast("int") - 1
            ).otherwise(-1)
            project, names = _at(columns, "project"), _at(columns, "names")
            chosen = F.when(project >= 0, project).when(names >= 0, names).otherwise(best)
            return _put(columns, F.lit(FIELDS.index("project")), chosen)

        return let(grades, label)

    def by_header(normed: Column) -> Column:
        def step(columns: Column, s: Column) -> Column:
            suits = F.transform(
                normed,
                lambda h, j: free(columns, j) & F.when(s["exact"], F.array_contains(s["aliases"], h))
                .otherwise(F.exists(s["aliases"], lambda a: F.contains(h, a))),
            )
            return F.when(F.get(columns, s["field"]) >= 0, columns).otherwise(
                _put(columns, s["field"], _first(suits))
            )

        none = F.array_repeat(F.lit(-1), len(FIELDS))
        return let(F.aggregate(step_rows, none, step), lambda c: by_content(normed, c))

    return let(F.transform(headers, header_key), by_header)


def _is_plain(values: Column, spec: UsageSpec) -> Column:
    def link(v: Column) -> Column:
        return is_repo_link(v, spec) | F.startswith(F.lower(v), F.lit("http"))

    def email(v: Column) -> Column:
        return F.rlike(v, F.lit(_EMAIL))

    def number(v: Column) -> Column:
        rest = F.regexp_replace(v, rf"(?U)[.\-{BLANK_CLASS},%$]", "")
        return F.rlike(rest, F.lit(r"(?U)^\d+$"))

    return (
        (F.size(values) > 0)
        & ~F.exists(values, lambda v: link(v) | email(v))
        & ~F.forall(values, number)
    )


def canonical_rows(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Data rows as the canonical text fields, in sheet order by ``row_no``.

    The mapping has a row a sheet and goes to the rows, which stay where they are.
    """
    joined = cells.join(F.broadcast(mapping), "sheet_id")

    def cell(field: str) -> Column:
        return strip(blank_if_null(F.get("cells", F.col(field))))

    return joined.where(F.col("row_no") > F.col("header_row")).select(
        "sheet_id", "row_no",
        *[(first_line(cell(f)) if f == "project" else cell(f)).alias(f) for f in FIELDS],
    )


def row_key(sheet_id: Column, row_no: Column) -> Column:
    """Sheet and place as one text: unique, the same in every run, and in sheet order."""
    return F.concat(sheet_id, F.lit("#"), F.lpad(row_no.cast("string"), 12, "0"))


def load_submissions(
    spark: SparkSession, path: str, spec: UsageSpec, limit: int = 0, columns: int = COLUMNS,
    skip_unusable: bool = False, range_bytes: int | None = None,
) -> DataFrame:
    """Sheets below ``path`` as submissions, optionally only the first ``limit`` rows.

    ``ord`` is the row's key (``row_key``): it orders the rows, and replies are joined on it, also in
    later runs.  Anything below ``path`` that cannot be used is an error, unless ``skip_unusable``;
    ``unusable_sheets`` lists it.
    """
    cells = read_sheets(spark, path, columns, range_bytes)
    if cells.isEmpty():
        raise ValueError(f"no rows found in {path}")
    mapping = stored(resolve_columns(cells, spec), "columns")
    unusable = unusable_sheets(spark, path, cells, mapping, columns)
    if not skip_unusable:
        worst = unusable.orderBy("sheet_id").limit(5).collect()
        if worst:
            raise ValueError("; ".join(f"{r.sheet_id}: {r.reason}" for r in worst))
    usable = mapping.join(unusable.select("sheet_id"), "sheet_id", "left_anti")
    rows = canonical_rows(cells, usable).withColumn("ord", row_key(F.col("sheet_id"), F.col("row_no")))
    rows = rows.select("ord", "sheet_id", "row_no", *FIELDS)
    return first_rows(rows, limit) if limit else rows


def first_rows(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows in the order of ``ord``: rows are counted by sheet, and only sheets that are
    needed are ranked, each up to what is still wanted of it.

    Every counted sheet has a row, so the first ``limit`` sheets suffice.
    """
    key = F.concat("sheet_id", F.lit("#"))
    counts = rows.groupBy("sheet_id").agg(F.count("*").alias("n")).orderBy(key).limit(limit)
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    wanted = counts.select(
        "sheet_id", (F.lit(limit) - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("_wanted")
    ).where("_wanted > 0")
    at = F.row_number().over(Window.partitionBy("sheet_id").orderBy("row_no"))
    needed = rows.join(wanted, "sheet_id").withColumn("_at", at).where(F.col("_at") <= limit)
    return needed.where("_at <= _wanted").drop("_at", "_wanted")


def unusable_sheets(
    spark: SparkSession, path: str, cells: DataFrame, mapping: DataFrame, columns: int = COLUMNS
) -> DataFrame:
    """Everything below ``path`` that gives no submissions, and why: ``sheet_id, reason``."""
    wide = cells.groupBy("sheet_id").agg(F.max(F.size("cells")).alias("n")).where(F.col("n") > columns)
    wide = wide.select("sheet_id", F.lit(f"more than {columns} columns").alias("reason"))
    unmapped = unresolved_sheets(cells, mapping).join(wide, "sheet_id", "left_anti").select(
        "sheet_id",
        F.concat(
            F.lit("no repo column and label column found; headers seen: "),
            F.array_join("headers", ", "),
        ).alias("reason"),
    )
    other = other_files(spark, path).withColumn("reason", F.lit("not a CSV file"))
    return wide.unionByName(unmapped).unionByName(other)


def unresolved_sheets(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sheets without a mapping, with their first row: ``sheet_id, headers``."""
    first = cells.groupBy("sheet_id").agg(F.min(F.struct("row_no", "cells")).alias("r"))
    return first.join(mapping, "sheet_id", "left_anti").select(
        "sheet_id", F.filter("r.cells", lambda c: strip(c) != "").alias("headers")
    )


def column_profile(cells: DataFrame, spec: UsageSpec) -> DataFrame:
    """Per sheet and column: filled cells, repo links, links, e-mails, numbers.

    Takes the long form ``sheet_id, row_no, col_no, value``; plain partial aggregates.
    """
    v = strip(blank_if_null(F.col("value")))
    rest = F.regexp_replace(v, rf"(?U)[.\-{BLANK_CLASS},%$]", "")
    return cells.groupBy("sheet_id", "col_no").agg(
        F.count("*").alias("rows"),
        F.count_if(v != "").alias("filled"),
        F.count_if(is_repo_link(v, spec)).alias("repo_links"),
        F.count_if(F.startswith(F.lower(v), F.lit("http"))).alias("links"),
        F.count_if(F.rlike(v, F.lit(_EMAIL))).alias("emails"),
        F.count_if(F.rlike(rest, F.lit(r"(?U)^\d+$"))).alias("numbers"),
    )


def long_cells(cells: DataFrame) -> DataFrame:
    return cells.select("sheet_id", "row_no", F.posexplode("cells").alias("col_no", "value"))
