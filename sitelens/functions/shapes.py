"""Shapes of JSON values, compiled to one Column that lists where a VARIANT departs from them.

A shape is a plain declaration; ``Shape.issues`` turns it into built-in expressions, so a table of
documents is checked in one pass without Python.  An issue is "path: what is wrong"; keys that a
shape doesn't name are allowed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.expr import let

ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z$"


def none() -> Column:
    return F.array().cast("array<string>")


def one(text: str) -> Column:
    """An issue of the value itself; what holds the value puts the way to it in front."""
    return F.array(F.lit(f": {text}"))


def under(prefix: Column, found: Column) -> Column:
    return F.transform(found, lambda i: F.concat(prefix, i))


def member(value: Column, key: str) -> Column:
    """A member of an object, NULL if it isn't there."""
    return F.try_variant_get(value, f"$.{key}", "variant")


def as_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def as_list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def first_of(checks: list[tuple[Column, str]]) -> Column:
    """The first rule that is broken."""
    out = F
    for broken, text in checks:
        out = out.when(broken, one(text))
    return out.otherwise(none())


class Shape:
    def issues(self, value: Column) -> Column:
        """array<string> for a VARIANT that is there (it may be JSON null)."""
        raise NotImplementedError


@dataclass(frozen=True)
class Anything(Shape):
    def issues(self, value: Column) -> Column:
        return none()


@dataclass(frozen=True)
class Nullable(Shape):
    shape: Shape

    def issues(self, value: Column) -> Column:
        return F.when(F.is_variant_null(value), none()).otherwise(self.shape.issues(value))


@dataclass(frozen=True)
class Text(Shape):
    least: int = 0
    most: int | None = None
    among: tuple[str, ...] = ()
    time: bool = False

    def issues(self, value: Column) -> Column:
        text = F.try_variant_get(value, "$", "string")
        checks = [(F.schema_of_variant(value) != "STRING", "is no text")]
        if self.least:
            checks.append((F.length(text) < self.least, "is empty" if self.least == 1 else f"is shorter than {self.least}"))
        if self.most is not None:
            checks.append((F.length(text) > self.most, f"is longer than {self.most}"))
        if self.among:
            checks.append((~text.isin(*self.among), "is none of the known values"))
        if self.time:
            checks.append((~text.rlike(ISO_TIME) | F.try_to_timestamp(text).isNull(), "is no date and time"))
        return first_of(checks)


@dataclass(frozen=True)
class Whole(Shape):
    least: int = 0
    among: tuple[int, ...] = ()

    def issues(self, value: Column) -> Column:
        number = F.try_variant_get(value, "$", "double")
        whole = F.schema_of_variant(value).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)") & (number == F.floor(number))
        wrong = ~number.isin(*map(float, self.among)) if self.among else number < self.least
        text = "is none of the known values" if self.among else f"is below {self.least}"
        return first_of([(~F.coalesce(whole, F.lit(False)), "is no whole number"), (wrong, text)])


@dataclass(frozen=True)
class Flag(Shape):
    only: bool | None = None

    def issues(self, value: Column) -> Column:
        wrong = F.schema_of_variant(value) != "BOOLEAN"
        if self.only is not None:
            wrong = wrong | (F.try_variant_get(value, "$", "boolean") != F.lit(self.only))
        return first_of([(wrong, "is no flag" if self.only is None else f"is not {str(self.only).lower()}")])


@dataclass(frozen=True)
class ListOf(Shape):
    item: Shape
    most: int | None = None

    def issues(self, value: Column) -> Column:
        def checks(items: Column) -> Column:
            out = F.when(items.isNull(), one("is no list"))
            if self.most is not None:
                out = out.when(F.size(items) > self.most, one(f"has more than {self.most} items"))
            if isinstance(self.item, Anything):
                return out.otherwise(none())
            return out.otherwise(F.flatten(F.transform(items, lambda x, i: under(F.concat(F.lit("."), i.cast("string")), self.item.issues(x)))))

        return let(as_list(value), checks)


@dataclass(frozen=True)
class Record(Shape):
    """Any keys, values of one shape."""

    item: Shape

    def issues(self, value: Column) -> Column:
        def checks(entries: Column) -> Column:
            each = F.transform(F.map_entries(entries), lambda e: under(F.concat(F.lit("."), e["key"]), self.item.issues(e["value"])))
            return F.when(entries.isNull(), one("is no object")).otherwise(F.flatten(each))

        return let(as_object(value), checks)


@dataclass(frozen=True)
class Object(Shape):
    required: dict[str, Shape]
    optional: dict[str, Shape] = field(default_factory=dict)

    def issues(self, value: Column) -> Column:
        def part(key: str, shape: Shape, needed: bool) -> Column:
            missing = one("is missing") if needed else none()
            found = let(member(value, key), lambda v: F.when(v.isNull(), missing).otherwise(shape.issues(v)))
            return under(F.lit(f".{key}"), found)

        parts = [part(k, s, True) for k, s in self.required.items()] + [part(k, s, False) for k, s in self.optional.items()]
        return F.when(as_object(value).isNull(), one("is no object")).otherwise(F.concat(none(), *parts))


@dataclass(frozen=True)
class Either(Shape):
    shapes: tuple[Shape, ...]

    def issues(self, value: Column) -> Column:
        fits = F.lit(False)
        for shape in self.shapes:
            fits = fits | (F.size(shape.issues(value)) == 0)
        return first_of([(~fits, "is none of the known values")])


@dataclass(frozen=True)
class Tagged(Shape):
    """Objects whose member ``tag`` says which shape they have."""

    tag: str
    shapes: dict[str, Shape]

    def issues(self, value: Column) -> Column:
        def chosen(tag: Column) -> Column:
            out = F.when(as_object(value).isNull(), one("is no object"))
            for name, shape in self.shapes.items():
                out = out.when(tag == name, shape.issues(value))
            return out.otherwise(under(F.lit(f".{self.tag}"), one("is none of the known values")))

        return let(F.try_variant_get(value, f"$.{self.tag}", "string"), chosen)


@dataclass(frozen=True)
class Also(Shape):
    """A shape, and if it holds a further rule."""

    shape: Shape
    rule: Callable[[Column], Column]

    def issues(self, value: Column) -> Column:
        return let(self.shape.issues(value), lambda own: F.when(F.size(own) > 0, own).otherwise(self.rule(value)))


def issues(shape: Shape, value: Column) -> Column:
    """Issues of a VARIANT column; NULL, which is no JSON value, is one."""
    found = F.when(value.isNull(), F.array(F.lit("(root): is no JSON value"))).otherwise(shape.issues(value))
    return F.transform(found, lambda i: F.regexp_replace(F.regexp_replace(i, r"^\.", ""), "^: ", "(root): "))
