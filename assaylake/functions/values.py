"""Numbers, timestamps and flags from text."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv


def blank(col: Column) -> Column:
    """Null, empty or only spaces."""
    return col.isNull() | (F.length(F.trim(col)) == 0)


def none_if_blank(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def parse_numeric(value: Column) -> Column:
    """First number in the text as a double, or null.

    Only ASCII digits count; other Unicode digits give null.
    """
    number = F.regexp_extract(value, fv.NUMBER_PATTERN, 0)
    return F.nullif(number, F.lit("")).try_cast("double")


def parse_time(text: Column) -> Column:
    """Timestamp in the session zone (UTC), or null; text without an offset is UTC."""
    return F.try_to_timestamp(text)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_match(cases: Iterable[tuple[Column, Column | str]], default: Column | str | None) -> Column:
    """The value of the first true condition, else the default."""
    (condition, value), *rest = cases
    chosen = F.when(condition, value)
    for condition, value in rest:
        chosen = chosen.when(condition, value)
    return chosen.otherwise(default)


def upper_trim(col: Column) -> Column:
    return F.upper(F.trim(col))


def range_flag(value: Column, code_known: Column, low: Column, high: Column) -> Column:
    """H / L / N / UNKNOWN against inclusive bounds; a missing bound never flags."""
    return (
        F.when(value.isNull() | ~code_known, fv.FLAG_UNKNOWN)
        .when(value < low, fv.FLAG_LOW)
        .when(value > high, fv.FLAG_HIGH)
        .otherwise(fv.FLAG_NORMAL)
    )


def _without_trailing_zeros(decimal_text: Column) -> Column:
    """``12.500`` -> ``12.5`` and ``12.000`` -> ``12.0``: one digit stays after the point."""
    return F.regexp_replace(decimal_text, r"(\.\d+?)0+$", "$1")


def float_text(value: Column) -> Column:
    """Shortest decimal text of a double: plain from 1e-4 up to 1e16, exponent form outside.

    Spark changes to exponent form at 1e-3 and 1e7; the digits are the same, so only the layout
    is rewritten here.
    """
    text = value.cast("string")
    plain = _without_trailing_zeros(text.try_cast("decimal(38,20)").cast("string"))
    mantissa = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", "")
    exponent = F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.when(F.abs(exponent) < 10, F.concat(F.lit("0"), F.abs(exponent).cast("string"))).otherwise(
            F.abs(exponent).cast("string")
        ),
    )
    size = F.abs(value)
    return (
        F.when(~F.contains(text, F.lit("E")), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def iso_text(ts: Column) -> Column:
    """``2026-01-01T00:00:00``, with six fraction digits when there is a fraction."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


_EVENT_TIME = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-](?!00:00)\d\d:\d\d)?$"
_DATE_ONLY = r"^\d{4}-\d\d-\d\d$"
_OFFSET = r"(?i)[T ].*?(Z|[+-]\d{2}(?::?\d{2})?)$"


def _rebuilt_time_text(text: Column) -> Column:
    """Any other readable form: blank for ``T``, no seconds, fractions, odd offsets."""

    def suffix(offset: Column) -> Column:
        digits = F.rpad(F.regexp_replace(offset, ":", ""), 5, "0")
        return (
            F.when(offset == "", "")
            .when((F.upper(offset) == "Z") | F.endswith(digits, F.lit("0000")), "Z")
            .otherwise(F.concat(F.substring(digits, 1, 3), F.lit(":"), F.substring(digits, 4, 2)))
        )

    def rebuilt(offset: Column) -> Column:
        local = F.substring(text, F.lit(1), F.length(text) - F.length(offset)).try_cast("timestamp_ntz")
        return F.concat(bind(local, iso_text), suffix(offset))

    return bind(F.regexp_extract(text, _OFFSET, 1), rebuilt)


def event_time_text(text: Column) -> Column:
    """Source date text in the form events carry: ISO with ``T``, UTC as ``Z``, offset kept.

    Null when the text is no date. Text in that form already is passed on as it is, so the costly
    rebuilding runs on odd rows only.
    """
    trimmed = F.trim(text)
    return (
        F.when(F.try_to_timestamp(trimmed).isNull(), F.lit(None).cast("string"))
        .when(trimmed.rlike(_EVENT_TIME), trimmed)
        .when(trimmed.rlike(_DATE_ONLY), F.concat(trimmed, F.lit("T00:00:00")))
        .otherwise(_rebuilt_time_text(trimmed))
    )
