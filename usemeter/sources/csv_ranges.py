"""Large CSV files read by many tasks: byte ranges, and an automaton that tells where records start.

A line break ends a record unless it stands inside quotes, so a line is a function of one bit: inside
or outside at its start gives inside or outside at its end.  The functions of a range's lines compose to
one of the range, those of the ranges before give each range its incoming bit, and with it every line
knows whether it starts a record.  Lines meet in their range; a record that runs over a range's end takes
what follows from the next ones.  Records are then parsed one by one, as the CSV reader would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usemeter.functions.binding import let
from usemeter.session import stored

# States of the scan behind a quote or at a line's start.
_OUTSIDE, _INSIDE, _CLOSED, _AT_START = 0, 1, 2, 3


def inside_after(line: Column, inside: bool) -> Column:
    """Whether a line that starts inside (or outside) quotes ends inside them.

    A quote opens a field only where the field starts; a doubled one inside is a quote; behind a closing
    one the rest of the field is plain text.
    """

    def step(state: Column, before: Column) -> Column:
        opens = F.endswith(before, F.lit(",")) | ((state == _AT_START) & (before == ""))
        return (
            F.when(state == _INSIDE, _CLOSED)
            .when((state == _CLOSED) & (before == ""), _INSIDE)
            .when(opens, _INSIDE)
            .otherwise(_OUTSIDE)
        )

    def scan(parts: Column) -> Column:
        start = F.lit(_INSIDE if inside else _AT_START)
        return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step) == _INSIDE

    return F.when(F.contains(line, F.lit('"')), let(F.split(line, '"', -1), scan)).otherwise(F.lit(inside))


def _lines(spark: SparkSession, path: str, larger_than: int, options: dict[str, str]) -> DataFrame:
    """``sheet_id, block, id, line, from_out, from_in`` of files of more than ``larger_than`` bytes.

    A line belongs to the range (``block``) in which it begins; ``id`` orders the lines of a range.
    """
    raw = spark.read.options(**options).text(path, lineSep="\n")
    line = F.col("value")
    return raw.where(F.col("_metadata.file_size") > larger_than).select(
        F.col("_metadata.file_path").alias("sheet_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        line.alias("line"),
        inside_after(line, False).alias("from_out"),
        inside_after(line, True).alias("from_in"),
    )


def _ranges(lines: DataFrame) -> DataFrame:
    """Per range the bit with which it begins: ``sheet_id, block, inside``, and what its file is like.

    Of a range only the lines that change something are gathered, as two bits each.  ``plain``: there are
    none and it begins outside, so each line is a record.  ``ansi``: some line of the file is no UTF-8;
    ``crlf``: its first line ends so, which then all do.
    """
    changes = ~F.col("from_in") | F.col("from_out")
    functions = F.array_sort(F.collect_list(F.when(changes, F.struct("id", "from_out", "from_in"))))

    def compose(acc: Column, x: Column) -> Column:
        then = lambda bit: F.when(bit, x["from_in"]).otherwise(x["from_out"])
        return F.struct(then(acc["from_out"]).alias("from_out"), then(acc["from_in"]).alias("from_in"))

    identity = F.struct(F.lit(False).alias("from_out"), F.lit(True).alias("from_in"))
    composed = lines.groupBy("sheet_id", "block").agg(
        F.aggregate(functions, identity, compose).alias("f"), F.bool_or(changes).alias("turns"),
        F.bool_and(F.is_valid_utf8("line")).alias("utf8"), F.min_by("line", "id").alias("first"),
    )
    # One row for each range: a file's ranges fit into one task.
    before = Window.partitionBy("sheet_id").orderBy("block")
    earlier = F.collect_list("f").over(before.rowsBetween(Window.unboundedPreceding, -1))
    bit = F.aggregate(earlier, F.lit(False), lambda b, f: F.when(b, f["from_in"]).otherwise(f["from_out"]))
    whole = Window.partitionBy("sheet_id")
    first = F.regexp_replace(F.first("first").over(before), "\r$", "")
    lone = F.raise_error(F.concat(F.lit("lines that end with a lone carriage return: "), "sheet_id"))
    return composed.select(
        "sheet_id", "block", bit.alias("inside"), (~bit & ~F.col("turns")).alias("plain"),
        (~F.bool_and("utf8").over(whole)).alias("ansi"),
        F.when(F.contains(first, F.lit("\r")), lone.cast("boolean"))
        .otherwise(F.endswith(F.first("first").over(before), F.lit("\r"))).alias("crlf"),
    )


def _pieces(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """The lines of each record within a range, put together: ``sheet_id, block, start, text, ansi, crlf``.

    ``start`` is the id of the record's first line, null for the lines with which a range goes on with a
    record of an earlier one.  Lines of plain ranges are taken as they are, only the others are put in order.
    There is a row for each range, and the driver has listed the files: few enough to broadcast.
    """
    known = lines.join(F.broadcast(ranges), ["sheet_id", "block"])
    single = known.where("plain").select("sheet_id", "block", F.col("id").alias("start"), F.col("line").alias("text"), "ansi", "crlf")
    own = Window.partitionBy("sheet_id", "block").orderBy("id")
    upto, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    swaps = (F.col("from_out") & ~F.col("from_in")).cast("int")
    resets = F.col("from_out") == F.col("from_in")
    # The bit at a line: the last reset before it, or the range's bit, turned by the swaps since.
    counted = known.where("not plain").withColumn("swaps", F.sum(swaps).over(upto))
    reset = F.last(F.when(resets, F.struct(F.col("from_out").alias("bit"), F.col("swaps").alias("at"))), True)
    since = (F.col("swaps") - swaps - F.coalesce("reset.at", F.lit(0))) % 2 == 1
    inside = F.coalesce("reset.bit", F.col("inside")) != since
    started = F.max(F.when(~F.col("in_record"), F.col("id"))).over(upto)
    return single.unionByName(
        counted.withColumn("reset", reset.over(before)).withColumn("in_record", inside)
        .withColumn("start", started)
        .groupBy("sheet_id", "block", "start")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n")
            .alias("text"),
            F.first("ansi").alias("ansi"), F.first("crlf").alias("crlf"),
        )
    )


def _records(pieces: DataFrame) -> DataFrame:
    """Whole records: ``sheet_id, block, start, text, ansi, crlf``.

    Only the last record of a range can go on in later ones, and only a range's first lines can belong to
    an earlier one: at most one row a range of each, joined; all others stay where they are.
    """
    last = pieces.where("start is not null").groupBy("sheet_id", "block").agg(F.max("start").alias("last"))
    heads = pieces.where("start is null").select("sheet_id", "block", "text")
    both = last.select("sheet_id", "block", "last", F.lit(None).cast("string").alias("text")).unionByName(
        heads.withColumn("last", F.lit(None).cast("bigint"))
    )
    # A head belongs to the last range before its own in which a record starts.
    order = Window.partitionBy("sheet_id").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("last").isNotNull(), F.struct("block", "last")), True).over(order)
    more = (
        both.withColumn("owner", owner).where("text is not null")
        .groupBy("sheet_id", F.col("owner.block").alias("block"), F.col("owner.last").alias("start"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("block").alias("at"), "text"))).alias("more"))
    )
    joined = pieces.where("start is not null").join(more, ["sheet_id", "block", "start"], "left")
    rest = F.transform("more", lambda x: x["text"])
    whole = F.when(F.col("more").isNull(), F.col("text")).otherwise(
        F.array_join(F.concat(F.array("text"), rest), "\n")
    )
    return joined.withColumn("text", whole).drop("more")


def read_ranges(
    spark: SparkSession, path: str, larger_than: int, ddl: str, csv: dict[str, str], decode: Column,
    options: dict[str, str],
) -> DataFrame:
    """``sheet_id, row_no, record`` of the files below ``path`` with more than ``larger_than`` bytes.

    ``record`` is a struct of ``ddl`` as the CSV options give it.  ``row_no`` counts a file's records from
    0, empty lines apart, as the one-task reading does.  A file that is not UTF-8 throughout gets
    ``decode`` of its text (the column ``text``).  Lines end with LF or CRLF, inside cells both are LF.
    """
    lines = _lines(spark, path, larger_than, options)
    pieces = stored(_pieces(lines, stored(_ranges(lines), "ranges")), "pieces")
    text = F.when(F.col("ansi"), decode).otherwise(F.col("text"))
    text = F.when(F.col("crlf"), F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text)
    text = F.when(F.col("crlf"), F.regexp_replace(text, "\r$", "")).otherwise(text)
    records = _records(pieces).withColumn("text", text).where("text <> ''")
    own = Window.partitionBy("sheet_id", "block").orderBy("start")
    marked = (F.col("block") == 0) & (F.col("at") == 0) & F.startswith("text", F.lit("\ufeff"))
    bare = F.when(marked, F.substring("text", 2, 2**31 - 1)).otherwise(F.col("text"))
    counts = records.groupBy("sheet_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sheet_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("sheet_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return (
        records.withColumn("at", F.row_number().over(own) - 1).join(offsets, ["sheet_id", "block"])
        .select("sheet_id", (F.col("offset") + F.col("at")).alias("row_no"), F.from_csv(bare, F.lit(ddl), csv).alias("record"))
    )
