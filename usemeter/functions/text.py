"""Text helpers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from usemeter.functions.binding import let

# Blanks as Unicode defines them plus the four ASCII separators; Java's \s has
# only the ASCII ones, and trim() only the space.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
BLANK_CLASS = r"\s\x1c-\x1f"
OTHER_BREAKS = r"[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
LINE_BREAK = rf"\r\n|\n|{OTHER_BREAKS}"


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def header_key(c: Column) -> Column:
    """Header or placeholder in its comparable form: lowercase letters and digits only."""
    return F.regexp_replace(F.lower(blank_if_null(c)), "[^a-z0-9]", "")


def name_key(c: Column) -> Column:
    """Project name in its comparable form: trimmed, lowercase, single blanks."""
    return F.regexp_replace(F.lower(strip(blank_if_null(c))), rf"(?U)[{BLANK_CLASS}]+", " ")


def first_line(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\n")), strip(F.substring_index(c, "\n", 1))).otherwise(c)


def lines(c: Column) -> Column:
    """All lines of a text; a final line break does not open another line.

    Texts with plain line feeds only, nearly all of them, are cut at a literal character, which
    needs no regex.
    """

    def without_last_blank(parts: Column) -> Column:
        return F.when(
            F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts)

    text = blank_if_null(c)
    return F.when(
        ~F.rlike(text, F.lit(OTHER_BREAKS)), let(F.split(text, "\n"), without_last_blank)
    ).otherwise(let(F.split(text, LINE_BREAK), without_last_blank))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return any_of([F.contains(c, F.lit(w)) for w in words])


def words_in(c: Column, words: tuple[str, ...]) -> Column:
    """The dictionary words that occur in a text, in dictionary order."""
    found = [F.when(F.contains(c, F.lit(w)), F.lit(w)) for w in words]
    return F.array_compact(F.array(*found)) if words else F.array().cast("array<string>")


def same_struct_array(items: list[Column]) -> Column:
    """Array of the structs whose condition held (``when`` without ``otherwise``)."""
    return F.array_compact(F.array(*items))
