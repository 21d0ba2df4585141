"""File names and words as Column expressions. Where a delimiter is absent the whole text is returned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def before_first(c: Column, d: str) -> Column:
    return F.substring_index(c, d, 1)


def after_last(c: Column, d: str) -> Column:
    return F.substring_index(c, d, -1)


def before_last(c: Column, d: str) -> Column:
    n = F.size(F.split(c, _quoted(d))) - 1
    return F.when(n <= 0, c).otherwise(F.call_function("substring_index", c, F.lit(d), n))


def after_first(c: Column, d: str) -> Column:
    at = F.instr(c, d)
    return F.when(at == 0, c).otherwise(F.substring(c, at + len(d), F.length(c)))


def _quoted(d: str) -> str:
    return "".join("\\" + x if not x.isalnum() else x for x in d)


def base_name(c: Column) -> Column:
    """The last part of a path without its extensions."""
    return before_first(after_last(c, "/"), ".")


def extension(c: Column) -> Column:
    return after_last(c, ".")


def compose(n: Column, stack: Column) -> Column:
    return F.format_string("%06d@%s", n, stack)


def image_number(c: Column) -> Column:
    return F.regexp_extract(c, "^([0-9]+)@", 1).try_cast("long")


def stack_name(c: Column) -> Column:
    return F.regexp_replace(c, "^[0-9]+@", "")


def number_prefix(c: Column, kind: str = "double") -> Column:
    """The number that a text begins with, null if none."""
    return F.regexp_extract(c, r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)", 1).try_cast("double").try_cast(kind)


def simplify(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def nth_word(c: Column, n: int, missing: str = "undefined") -> Column:
    """The n-th comma-separated word, from the end for negative n."""
    return F.coalesce(F.try_element_at(F.split(c, ","), F.lit(n)), F.lit(missing)) if n else F.lit(missing)


def word_count(c: Column) -> Column:
    return F.when(c == "undefined", 0).otherwise(F.size(F.split(c, ","))).cast("long")


def truth(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("1", "true", "yes"), True).when(low.isin("0", "false", "no"), False)


def without_char(c: Column, char: str) -> Column:
    return F.replace(c, F.lit(char), F.lit(""))


def unescaped(c: Column) -> Column:
    """Tabs as spaces, other control characters gone."""
    return F.regexp_replace(F.translate(c, "\t", " "), "[\\x07\\x08\\n\\x0b\\x0c\\r]", "")


def without_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def split_word(c: Column, delimiter: str, n: int) -> Column:
    """The n-th part, from 1, null beyond the last."""
    return F.try_element_at(F.split(c, _quoted(delimiter)), F.lit(n))


def is_number(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.lit(False))


def padded(n: Column, width: int, fill: str = "0") -> Column:
    return F.lpad(n.cast("string"), width, fill)


def star_quoted(c: Column) -> Column:
    """A value as it is written in a table: empty ones as "", those with blanks or a leading sign in quotes."""
    mark = F.when(F.contains(c, F.lit('"')), "'").otherwise('"')
    return F.when(c == "", '""').when(c.rlike(r"\s|^[\"'#_]"), F.concat(mark, c, mark)).otherwise(c)


def job_parts(c: Column) -> tuple[Column, Column, Column]:
    """(folder, job, rest) of Folder/jobNNN/rest, job being the first part after a folder that begins so; else all of it is rest."""
    pattern = r"^(.+?/)(job[0-9]{3}[^/]*/?)(.*)$"
    found = c.rlike(pattern)
    return tuple(F.when(found, F.regexp_extract(c, pattern, k)).otherwise("" if k < 3 else c) for k in (1, 2, 3))


def insert_before_extension(c: Column, text: str) -> Column:
    return F.when(F.instr(c, ".") == 0, F.concat(c, F.lit(text))).otherwise(F.concat(before_last(c, "."), F.lit(text), F.lit("."), after_last(c, ".")))


def without_extension(c: Column) -> Column:
    return F.when(F.instr(c, ".") == 0, c).otherwise(before_last(c, "."))


def with_extension(c: Column, extension_: str) -> Column:
    return F.concat(without_extension(c), F.lit("." + extension_))


def without_directories(c: Column, keep: int = 0) -> Column:
    """The last part of a path and so many folders before it."""
    return F.substring_index(c, "/", -(keep + 1))


def other_half(c: Column) -> Column:
    """half1 in a name as half2 and the other way round."""
    return F.when(F.contains(c, F.lit("half1")), F.replace(c, F.lit("half1"), F.lit("half2"))).when(F.contains(c, F.lit("half2")), F.replace(c, F.lit("half2"), F.lit("half1")))
