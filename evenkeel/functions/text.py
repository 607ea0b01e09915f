"""Display formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: size units, each 1024 times the one before
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def _text(value) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def fixed(value: Column, decimals: int) -> Column:
    """A number with a fixed count of decimals, halves rounded to even, no separators."""
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def format_bytes(value: Column, precision: int = 2) -> Column:
    value = value.cast("double")
    result = None
    for power, unit in enumerate(BYTE_UNITS):
        scaled = F.concat(fixed(value / (1024.0**power), precision), F.lit(" " + unit))
        if unit == BYTE_UNITS[-1]:
            return result.otherwise(scaled)
        below = value < 1024.0 ** (power + 1)
        result = F.when(below, scaled) if result is None else result.when(below, scaled)


def format_number(value: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_string("%,d", value.cast("long"))


def format_percentage(value: Column, total: Column, precision: int = 1) -> Column:
    share = value.cast("double") / F.nullif(total.cast("double"), F.lit(0.0)) * 100
    return F.when(total == 0, "0.0%").otherwise(F.concat(fixed(share, precision), F.lit("%")))


def format_duration(seconds: Column) -> Column:
    """The two largest units: `30.5s`, `2m 5s`, `2h 2m`, `1d 1h`."""
    seconds = seconds.cast("double")

    def whole(value: Column) -> Column:
        return F.floor(value).cast("string")

    return (
        F.when(seconds < 60, F.concat(fixed(seconds, 1), F.lit("s")))
        .when(seconds < 3600, F.concat(whole(seconds / 60), F.lit("m "), whole(seconds % 60), F.lit("s")))
        .when(seconds < 86400, F.concat(whole(seconds / 3600), F.lit("h "), whole(seconds / 60 % 60), F.lit("m")))
        .otherwise(F.concat(whole(seconds / 86400), F.lit("d "), whole(seconds / 3600 % 24), F.lit("h")))
    )


def format_table_name(schema: Column | str, table: Column | str) -> Column:
    return F.concat(F.lit("["), _text(schema), F.lit("].["), _text(table), F.lit("]"))


def full_name(schema: Column | str, table: Column | str) -> Column:
    return F.concat(_text(schema), F.lit("."), _text(table))


def truncate(text: Column, max_length: int = 50, suffix: str = "...") -> Column:
    """Text cut so that it fits `max_length` together with the suffix."""
    cut = F.concat(F.substring(text, 1, max_length - len(suffix)), F.lit(suffix))
    return F.when(F.length(text) <= max_length, text).otherwise(cut)


def shortened(text: Column, max_length: int = 200) -> Column:
    """Text cut to `max_length`, with the suffix after it."""
    return F.when(F.length(text) <= max_length, text).otherwise(
        F.concat(F.substring(text, 1, max_length), F.lit("..."))
    )


def source_name(program: Column, host: Column) -> Column:
    """`program (host)`; empty and missing parts show as Unknown."""

    def part(value: Column) -> Column:
        return F.when(value.isNull() | (value == ""), "Unknown").otherwise(value)

    return F.concat(part(program), F.lit(" ("), part(host), F.lit(")"))
