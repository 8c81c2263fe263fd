"""Column functions for names, statements and ids.  A null counts as an empty string unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split sees it.
_BLANK = r"(?U)[\s\x1c-\x1f]+"


def _text(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """What `body` makes of the value, which is worked out once a row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm_file(x) -> Column:
    """Trimmed, backslashes as slashes, without any leading dots and slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(_text(x)), r"\\", "/"), r"^[./]+", "")


def strip(x) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(_text(x), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse(x) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_text(x), _BLANK, " "))


norm_stmt = collapse


def nospace(x) -> Column:
    return F.regexp_replace(_text(x), _BLANK, "")


def loose_stmt(x) -> Column:
    """Without spaces and without trailing commas, colons and semicolons."""
    return F.regexp_replace(F.replace(collapse(x), F.lit(" "), F.lit("")), "[,:;]+$", "")


def one_quote(x) -> Column:
    return F.translate(_text(x), '"', "'")


def quote_norm(x) -> Column:
    return collapse(one_quote(x))


def squash(x) -> Column:
    return nospace(one_quote(x))


def parse_line(x) -> Column:
    """The number that a string of digits is; null for anything else."""
    digits = F.trim(_text(x))
    return F.when(digits.rlike("^[0-9]+$"), digits.try_cast("bigint"))


def repo_name(x) -> Column:
    """What stands between the first double underscore and a trailing number."""
    # Two patterns take less time than cutting by positions, which are worked out again wherever they are named.
    return F.regexp_replace(F.regexp_replace(_text(x), "^.*?__", ""), "-[0-9]+$", "")


def short_id(x) -> Column:
    return F.element_at(F.split(_text(x), "__"), -1)


def enum(x) -> Column:
    return F.lower(F.trim(_text(x)))


def image_name(x) -> Column:
    return F.lower(F.replace(_text(x), F.lit("__"), F.lit("_1776_")))


def change_number(x) -> Column:
    return F.substring_index(_text(x), "-", -1)


def without_prefix(x, prefix: str) -> Column:
    """Without the prefix, once."""
    return F.when(_text(x).startswith(prefix), F.substring(_text(x), len(prefix) + 1, 1 << 30)).otherwise(_text(x))


def string_list(x) -> Column:
    """The strings of a JSON list; null for anything else."""
    return F.from_json(x, "array<string>")


def label_head(x) -> Column:
    """The first five characters of a label, as column heads show them."""
    return F.substring(_text(x), 1, 5)


def two_reasonings(first, second) -> Column:
    """What a juror reads: both annotators' reasoning, in the order given (a fixed layout)."""
    part = lambda k, x: F.concat(F.lit(f'Annotator {k} reasoning:\n"""\n'), strip(x), F.lit('\n"""'))
    return F.concat(part(1, first), F.lit("\n\n"), part(2, second))


def owner_and_repo(x) -> Column:
    """owner/repo of an instance id like owner__repo-12."""
    return F.concat(F.substring_index(_text(x), "__", 1), F.lit("/"), repo_name(x))
