"""Parsing and formatting of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """A trimmed decimal, exponent or 0x number, 0 for an empty text; null for anything else and for infinities."""
    t = F.trim(text)
    plain = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    hexed = F.when(t.rlike(r"^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substr(t, F.lit(3)), 16, 10).cast("double"))
    return F.when(t == "", 0.0).when(F.abs(F.coalesce(plain, hexed)) < float("inf"), F.coalesce(plain, hexed))


def timestamp_ms(text: Column) -> Column:
    """Epoch milliseconds of an ISO date-time; without a zone it is taken for UTC; null if it can't be read."""
    zoned = F.when(zone_status(text) == "missing", F.concat(F.trim(text), F.lit("Z"))).otherwise(F.trim(text))
    return F.floor(F.unix_micros(F.try_to_timestamp(zoned)) / 1000)


def zone_status(text: Column) -> Column:
    """explicit, missing (no zone), invalid (not a date-time) or none (null or empty)."""
    t = F.trim(text)
    return (
        F.when(text.isNull() | (t == ""), "none")
        .when(~t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*(?i:z|[+-]\d{2}:?\d{2})?$"), "invalid")
        .when(t.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$") & t.contains(":"), "explicit")
        .otherwise("missing")
    )


#: What stands between thousands and before decimals, by language; the digits from which thousands are parted.
SEPARATORS = {"en": (",", ".", 4), "de": (".", ",", 4), "es": (".", ",", 5), "fr": (" ", ",", 4), "ru": (" ", ",", 4)}
#: The months' long names as dates have them.
MONTHS = {
    "en": "January February March April May June July August September October November December",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
}
#: A date from day, month and year, and without the year.
DATES = {"en": ("%2$s %1$s, %3$s", "%2$s %1$s"), "de": ("%1$s. %2$s %3$s", "%1$s. %2$s"), "es": ("%1$s de %2$s de %3$s", "%1$s de %2$s"), "fr": ("%1$s %2$s %3$s", "%1$s %2$s"), "ru": ("%1$s %2$s %3$s", "%1$s %2$s")}


def decimal(c: Column, language: str = "en") -> Column:
    """One decimal, halves away from zero, thousands parted as the language does; null stays null. Halves are found at ten times
    the number, so that the last bit of a difference near 207.55 doesn't decide."""
    group, point, digits = SEPARATORS[language]
    tenths = F.when(F.abs(c) < 1e15, F.signum(c) * F.floor(F.abs(c) * 10 + 0.5) / 10).otherwise(c)
    plain = F.format_string("%.1f", tenths)
    text = F.when(F.abs(plain.cast("double")) >= 10 ** (digits - 1), F.format_string("%,.1f", tenths)).otherwise(plain)
    return F.when(c.isNotNull(), F.translate(text, ",.", group + point))


def measured(c: Column, unit: str, language: str) -> Column:
    return F.when(F.abs(c) < float("inf"), F.concat(decimal(c, language), F.lit(f" {unit}"))).otherwise("—")


def date_text(day: Column, month: Column, year: Column | None, language: str = "en") -> Column:
    """A date in words; the day may be any text, such as a range."""
    whole, short = DATES[language]
    name = F.element_at(F.array(*map(F.lit, MONTHS[language].split())), month)
    return F.format_string(whole if year is not None else short, day.cast("string"), name, *([year.cast("string")] if year is not None else []))


def kilometres(metres: Column, language: str = "en", unit: str = "km") -> Column:
    return measured(metres / 1000, unit, language)


def clock(seconds: Column) -> Column:
    """h:mm:ss of whole seconds, halves up."""
    s = F.floor(seconds + 0.5).cast("long")
    return F.when(F.abs(seconds) < float("inf"), F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise("—")


def speed_text(kmh: Column, language: str = "en", unit: str = "km/h") -> Column:
    return measured(kmh, unit, language)


def metres_text(metres: Column, language: str = "en", unit: str = "m") -> Column:
    return measured(metres, unit, language)


def rounded_metres(metres: Column) -> Column:
    """Whole metres for an audit, halves up; n/a without a value."""
    return F.when(F.abs(metres) < float("inf"), F.format_string("%d m", F.floor(metres + 0.5).cast("long"))).otherwise("n/a")


def rounded_seconds(seconds: Column) -> Column:
    return F.when(F.abs(seconds) < float("inf"), F.format_string("%d s", F.floor(seconds + 0.5).cast("long"))).otherwise("n/a")


def rounded_count(count: Column) -> Column:
    return F.when(F.abs(count) < float("inf"), F.floor(count + 0.5).cast("long").cast("string")).otherwise("0")


def hex_colour(red: Column, green: Column, blue: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(F.floor(c + 0.5).cast("long")), 2, "0")) for c in (red, green, blue)))
