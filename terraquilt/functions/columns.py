"""Column expressions for cleaning and labelling. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_label(label: Column) -> tuple[Column, Column]:
    """(season, type): text before and after the first space. Without a space
    the type is null; a null label gives two nulls."""
    parts = F.split(label, " ", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def coalesce_cols(first: Column, second: Column) -> Column:
    return F.coalesce(first, second)


def epoch_to_ts(seconds: Column) -> Column:
    """Epoch seconds to a zone-less UTC timestamp. Adding an interval to a
    zone-less origin does not depend on the session time zone."""
    zero = F.lit(0)
    origin = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return origin + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))


def parse_date(text: Column, fmt: str | None = None, lenient: bool = False) -> Column:
    """Text to timestamp. Bad input raises unless ``lenient``, then it is null."""
    parse = F.try_to_timestamp if lenient else F.to_timestamp
    return (parse(text, F.lit(fmt) if lenient else fmt) if fmt else parse(text)).cast("timestamp_ntz")


def concat_text(prefix: str, text: Column) -> Column:
    """Hover text; null when the column is null."""
    return F.concat(F.lit(prefix), text)


def series_title(entity: Column, indicator: Column) -> Column:
    return F.format_string("<b>%s</b><br>%s", entity, indicator)


def label_popup(name: Column, area: Column) -> Column:
    """Popup text with a name and an area; missing values print as None."""
    def shown(c: Column) -> Column:
        return F.coalesce(c, F.lit("None"))

    return F.concat(
        F.lit("Fire name: "), shown(name.cast("string")), F.lit(" <br>Burnt Area (ha): "), shown(plain_number(area))
    )


def plain_number(number: Column) -> Column:
    """A number's shortest text without an exponent, from 0.0001 up to below 1e16."""
    text, size = number.cast("string"), F.abs(number.cast("double"))
    digits = F.regexp_replace(number.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(F.contains(text, F.lit("E")) & (size >= 1e-4) & (size < 1e16), digits).otherwise(text)


def axis_scale(value: Column, kind: str) -> Column:
    """Values as placed on a linear or logarithmic axis. A logarithmic axis
    cannot show zero or negative values, so those become null."""
    if kind not in ("Linear", "Log"):
        raise ValueError("kind is 'Linear' or 'Log'")
    return F.when(value > 0, F.log10(value)) if kind == "Log" else value
