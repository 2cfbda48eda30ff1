"""Small building blocks shared by the Column-expression library."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters a browser trims: ASCII white space, no-break space, BOM.
SPACE = r"[\s\x{A0}\x{FEFF}]"


def cached_columns(build: Callable) -> Callable:
    """Keep the Columns a builder returns.

    A Column is a plain expression tree that belongs to no DataFrame, and
    building a large one takes thousands of calls into the JVM."""
    kept: dict = {}

    @wraps(build)
    def get(*args):
        key = (id(SparkContext._gateway), args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return get


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``.

    Column expressions are trees: using a Column twice evaluates it twice.
    A one-element ``transform`` gives it a name, also inside other lambdas.
    """
    return F.transform(F.array(value), body).getItem(0)


def browser_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse_space(text: Column) -> Column:
    return browser_trim(F.regexp_replace(text, f"{SPACE}+", " "))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def utf16_length(text: Column) -> Column:
    """String length in UTF-16 units, the unit browsers count in."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def clip(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def slug(text: Column) -> Column:
    """Lower-risk identifier part: runs of other characters become a dash."""
    body = F.regexp_replace(F.regexp_replace(text, "(?i)[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(blank_to_null(body), F.lit("unknown"))


def csv_cell(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def table_cell(text: Column) -> Column:
    return browser_trim(F.regexp_replace(text, "[|\r\n]+", " "))


def compact(text: Column, chars: int = 480) -> Column:
    """Single-line summary: collapse space, clip with an ellipsis."""
    return let(
        collapse_space(text),
        lambda t: F.when(
            F.length(t) > chars, F.concat(F.substring(t, 1, chars - 1), F.lit("…"))
        ).otherwise(F.coalesce(blank_to_null(t), F.lit("(empty)"))),
    )


def computed_once(df: DataFrame, keys: list[str], columns: list[Column]) -> DataFrame:
    """Add ``columns`` to ``keys`` so that later filters cannot re-derive them.

    Spark pushes a filter on a projected column below the projection and
    evaluates the column's expression again there.  For an expression that
    lexes a page this costs more than the filter saves.  Filters stop at a
    generator, so the columns come out of a one-row ``inline``; filters on
    ``keys`` still reach the scan."""
    return df.select(*keys, F.inline(F.array(F.struct(*columns))))
