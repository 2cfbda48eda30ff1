"""HTML character references as Column expressions.

A page is brought to a canonical form once: every reference becomes its characters, except that
characters which are markup or white space stay as one of a few canonical references, which
``resolved`` turns into characters in a value that has been cut out.  Text is split at each
ampersand; a name is looked up in a table dealt into buckets by its checksum, first whole with its
semicolon, then the longest old name it begins with that needs none."""

from __future__ import annotations

import json
import zlib
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.expr import let

#: Characters that stay references in a canonical page; the ampersand's comes last when resolved.
CANONICAL = {
    "<": "&lt;",
    ">": "&gt;",
    '"': "&quot;",
    "'": "&#39;",
    "\x01": "&#1;",
    "\t": "&#9;",
    "\n": "&#10;",
    "\f": "&#12;",
    "\r": "&#13;",
    " ": "&#32;",
    "&": "&amp;",
}
BUCKETS = 1024
REPLACEMENT = "�"


def canonical_form(text: str) -> str:
    return "".join(CANONICAL.get(c, c) for c in text)


def legacy_names() -> list[str]:
    """Names that need no semicolon, the longest first."""
    return sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))


@cache
def _buckets() -> str:
    """The standard's table of names (from Python's library) as JSON, by checksum of the name."""
    out: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for name, text in html5.items():
        out[zlib.crc32(name.encode()) % BUCKETS][name] = canonical_form(text)
    return json.dumps(out)


@cache
def _windows_controls() -> str:
    """Numbers 128 to 159 stand for the characters of Windows code page 1252, where it has one."""
    return json.dumps([bytes([n]).decode("cp1252", errors="ignore") or chr(n) for n in range(128, 160)])


def named(name: Column) -> Column:
    """Canonical form of a name's characters (the name as in the table, with its semicolon if it has one)."""
    table = F.from_json(F.lit(_buckets()), "array<map<string,string>>")
    return F.element_at(F.get(table, (F.crc32(name.cast("binary")) % BUCKETS).cast("int")), name)


def numbered(code: Column) -> Column:
    """Canonical form of the character of a number; null and what is no character are U+FFFD."""
    table = F.from_json(F.lit(_windows_controls()), "array<string>")
    special = F.create_map(*[F.lit(x) for c, ref in CANONICAL.items() for x in (ord(c), ref)])
    character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when(code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit(REPLACEMENT))
        .when(code < 64, F.coalesce(F.element_at(special, code.cast("int")), character))
        .when(code.between(128, 159), F.get(table, (code - 128).cast("int")))
        .otherwise(character)
    )


def _number(digits: Column, base: int) -> Column:
    """The number, or null if it is too long to be a character."""
    short = F.regexp_replace(digits, "^0+", "")
    return F.when(short == "", 0).when(F.length(short) <= 7, F.conv(short, base, 10)).cast("long")


def _after(part: Column, taken: Column) -> Column:
    return F.substr(part, F.length(taken) + 1)


def _numeric(part: Column) -> Column:
    def value(taken: Column) -> Column:
        digits = F.regexp_extract(taken, "([0-9A-Fa-f]+);?$", 1)
        code = F.when(taken.rlike("^#[xX]"), _number(digits, 16)).otherwise(_number(digits, 10))
        return F.when(taken == "", F.concat(F.lit("&amp;"), part)).otherwise(
            F.concat(let(code, numbered), _after(part, taken))
        )

    return let(F.regexp_extract(part, "^(#(?:[0-9]+|[xX][0-9A-Fa-f]+);?)", 1), value)


def _legacy_pattern() -> str:
    return f"^({'|'.join(legacy_names())})"


def _named(part: Column) -> Column:
    untouched = F.concat(F.lit("&amp;"), part)

    def without_semicolon(name: Column) -> Column:
        rest = _after(part, name)
        return (
            F.when(name == "", untouched)
            # In an attribute such a name is no reference; a lone ampersand marks it for texts.
            .when(rest.rlike("^[=A-Za-z0-9]"), F.concat(F.lit("&"), part))
            .otherwise(F.concat(named(name), rest))
        )

    def whole(x: Column) -> Column:
        return F.when(x["hit"].isNotNull(), F.concat(x["hit"], _after(part, x["name"]))).otherwise(
            let(F.regexp_extract(part, _legacy_pattern(), 1), without_semicolon)
        )

    name = F.regexp_extract(part, "^([A-Za-z][A-Za-z0-9]*;)", 1)
    return let(let(name, lambda n: F.struct(n.alias("name"), F.when(n != "", named(n)).alias("hit"))), whole)


def _split_at_ampersands(text: Column, resolve) -> Column:
    def whole(t: Column) -> Column:
        pieces = F.split(t, "&")
        tail = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), resolve)
        return F.when(t.contains("&"), F.concat(F.get(pieces, F.lit(0)), F.array_join(tail, ""))).otherwise(t)

    return let(text, whole)


def canonical_references(markup: Column) -> Column:
    """Markup with every character reference resolved or canonical.

    What is no reference has its ampersand as `&amp;`; a lone ampersand is left only before an old
    name without semicolon that goes on with a letter, a digit or `=`."""

    def resolve(part: Column) -> Column:
        return (
            F.when(part.startswith("amp;"), F.concat(F.lit("&"), part))
            .when(part.startswith("#"), _numeric(part))
            .when(part.rlike("^[A-Za-z]"), _named(part))
            .otherwise(F.concat(F.lit("&amp;"), part))
        )

    return _split_at_ampersands(markup, resolve)


def resolved(text: Column) -> Column:
    """The canonical references of a value as their characters."""

    def whole(t: Column) -> Column:
        out = t
        for character, reference in CANONICAL.items():
            out = F.replace(out, F.lit(reference), F.lit(character))
        return F.when(t.contains("&"), out).otherwise(t)

    return let(text, whole)


def text_of(text: Column) -> Column:
    """Text of a canonical page as its characters, the names left for texts among them."""
    old = F.from_json(F.lit(json.dumps({n: canonical_form(html5[n]) for n in legacy_names()})), "map<string,string>")

    def resolve(part: Column) -> Column:
        def name(n: Column) -> Column:
            return F.when(n == "", F.concat(F.lit("&"), part)).otherwise(F.concat(F.element_at(old, n), _after(part, n)))

        known = part.rlike("^(?:lt|gt|quot|#[0-9]+|amp);")
        return F.when(known, F.concat(F.lit("&"), part)).otherwise(let(F.regexp_extract(part, _legacy_pattern(), 1), name))

    return resolved(_split_at_ampersands(text, resolve))
