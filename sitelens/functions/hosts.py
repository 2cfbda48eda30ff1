"""Host names as a browser writes them, as native Column expressions.

Names are percent-decoded, lower-cased and written in ASCII (punycode, one label at a time);
hosts whose last label is a number are IPv4 addresses in any of their spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.expr import let

# The parameters of punycode (RFC 3492) and its digits.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# Full stops of other scripts.
STOPS = "。．｡"
#: Digits of a variable-length number, at most: enough for any label of 2^16 characters.
MOST_DIGITS = 10


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long") if isinstance(b, int) else b)


def _number(delta: Column, bias: Column) -> Column:
    """``delta`` as a variable-length number."""

    def step(s: Column, i: Column) -> Column:
        def digit(t: Column) -> Column:
            last = s["left"] < t
            value = F.when(last, s["left"]).otherwise(t + (s["left"] - t) % (BASE - t))
            return F.struct(
                F.when(last, F.lit(-1).cast("long")).otherwise(_div(s["left"] - t, BASE - t)).alias("left"),
                F.concat(s["text"], F.substr(F.lit(DIGITS), value.cast("int") + 1, F.lit(1))).alias("text"),
            )

        threshold = F.least(F.greatest(i * BASE - bias, F.lit(T_MIN).cast("long")), F.lit(T_MAX).cast("long"))
        return F.when(s["left"] < 0, s).otherwise(let(threshold, digit))

    places = F.sequence(F.lit(1).cast("long"), F.lit(MOST_DIGITS).cast("long"))
    return F.aggregate(places, F.struct(delta.alias("left"), F.lit("").alias("text")), step)["text"]


def _bias(delta: Column, points: Column, first: Column) -> Column:
    scaled = let(F.when(first, _div(delta, DAMP)).otherwise(_div(delta, 2)), lambda d: d + _div(d, points))
    most = (BASE - T_MIN) * T_MAX // 2

    def shrink(s: Column, _: Column) -> Column:
        smaller = F.struct(_div(s["d"], BASE - T_MIN).alias("d"), (s["k"] + BASE).alias("k"))
        return F.when(s["d"] > most, smaller).otherwise(s)

    zero = F.struct(scaled.alias("d"), F.lit(0).cast("long").alias("k"))
    rounds = F.sequence(F.lit(1), F.lit(MOST_DIGITS))
    return F.aggregate(rounds, zero, shrink, lambda s: s["k"] + _div(s["d"] * (BASE - T_MIN + 1), s["d"] + SKEW))


def _punycode(label: Column) -> Column:
    """One label with other than ASCII characters: they are inserted in order of code and place."""

    def insert(s: Column, code: Column, here: Column) -> Column:
        emitted = F.struct(
            F.lit(0).cast("long").alias("delta"),
            _bias(s["delta"], s["points"] + 1, s["first"]).alias("bias"),
            (s["points"] + 1).alias("points"),
            F.lit(False).alias("first"),
            F.concat(s["text"], _number(s["delta"], s["bias"])).alias("text"),
        )
        skipped = F.struct((s["delta"] + 1).alias("delta"), s["bias"].alias("bias"), s["points"].alias("points"), s["first"].alias("first"), s["text"].alias("text"))
        return F.when(here < code, skipped).when(here == code, emitted).otherwise(s)

    def encode(p: Column) -> Column:
        def code_point(acc: Column, code: Column) -> Column:
            s = acc["s"]
            before = F.struct(
                (s["delta"] + (code - acc["code"]) * (s["points"] + 1)).alias("delta"),
                s["bias"].alias("bias"),
                s["points"].alias("points"),
                s["first"].alias("first"),
                s["text"].alias("text"),
            )
            after = F.aggregate(p["codes"], before, lambda x, here: insert(x, code, here))
            return let(
                after,
                lambda x: F.struct(
                    (code + 1).alias("code"),
                    F.struct((x["delta"] + 1).alias("delta"), x["bias"].alias("bias"), x["points"].alias("points"), x["first"].alias("first"), x["text"].alias("text")).alias("s"),
                ),
            )

        start = F.struct(
            F.lit(FIRST_CODE).cast("long").alias("code"),
            F.struct(
                F.lit(0).cast("long").alias("delta"),
                F.lit(FIRST_BIAS).cast("long").alias("bias"),
                F.length(p["plain"]).cast("long").alias("points"),
                F.lit(True).alias("first"),
                F.when(p["plain"] == "", F.lit("")).otherwise(F.concat(p["plain"], F.lit("-"))).alias("text"),
            ).alias("s"),
        )
        others = F.array_sort(F.array_distinct(F.filter(p["codes"], lambda c: c >= FIRST_CODE)))
        return F.concat(F.lit("xn--"), F.aggregate(others, start, code_point)["s"]["text"])

    characters = F.regexp_extract_all(label, F.lit("(?s)(.)"), F.lit(1))
    parts = F.struct(
        F.transform(characters, lambda c: F.ascii(c).cast("long")).alias("codes"),
        F.regexp_replace(label, r"[^\x00-\x7F]", "").alias("plain"),
    )
    return let(parts, encode)


def ascii_host(host: Column) -> Column:
    """Labels with other than ASCII characters as punycode; ASCII hosts pass through."""
    labels = F.split(F.translate(host, STOPS, "..."), r"\.")
    encoded = F.array_join(F.transform(labels, lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), _punycode(x)).otherwise(x)), ".")
    return F.when(host.rlike(r"[^\x00-\x7F]"), encoded).otherwise(host)


def _ipv4_part(part: Column) -> Column:
    """Decimal, 0x hexadecimal or 0 octal; NULL when it is no number."""
    value = (
        F.when(part.rlike("^0x[0-9a-f]*$"), F.conv(F.concat(F.lit("0"), F.substr(part, F.lit(3))), 16, 10))
        .when(part.rlike("^0[0-7]*$"), F.conv(part, 8, 10))
        .when(part.rlike("^[1-9][0-9]*$"), F.conv(part, 10, 10))
    )
    return value.cast("decimal(20,0)")


def _ipv4(host: Column) -> Column:
    """The dotted form of a host that ends in a number; NULL when a part is no number or too large."""

    def dotted(parts: Column) -> Column:
        n = F.size(parts)
        most = F.element_at(F.array(*(F.lit(256**k).cast("decimal(20,0)") for k in (4, 3, 2, 1))), F.least(n, F.lit(4)))
        ahead = F.slice(parts, F.lit(1), n - 1)
        fits = (n <= 4) & F.forall(parts, lambda p: p.isNotNull()) & F.forall(ahead, lambda p: p < 256) & (F.element_at(parts, -1) < most)
        last = F.element_at(parts, -1).cast("long")
        octets = F.concat(
            F.transform(ahead, lambda p: p.cast("long")),
            F.transform(F.sequence(4 - n, F.lit(0), F.lit(-1)), lambda k: _div(last, F.pow(F.lit(256), k).cast("long")) % 256),
        )
        return F.when(fits, F.array_join(F.transform(octets, lambda x: x.cast("string")), "."))

    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    return let(F.transform(parts, _ipv4_part), dotted)


def normal_host(host: Column) -> Column:
    """A host of an http-like URL in its one spelling; NULL for a bad escape or a bad address."""

    def spelled(h: Column) -> Column:
        return F.when(h.rlike(r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?$"), _ipv4(h)).otherwise(h)

    def taken_apart(h: Column) -> Column:
        decoded = F.when(h.contains("%"), F.lower(F.try_url_decode(F.replace(h, F.lit("+"), F.lit("%2B"))))).otherwise(h)
        return let(let(decoded, ascii_host), spelled)

    # Nearly all hosts are plain names and need none of this.
    plain = r"^[a-z0-9_-]+(?:\.[a-z0-9_-]+)*\.[a-z][a-z0-9_-]*$"
    return let(host, lambda h: F.when(h.rlike(plain), h).otherwise(taken_apart(h)))
