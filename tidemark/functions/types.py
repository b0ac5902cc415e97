"""Text to typed columns and back, with this engine's NULL, padding and trimming rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBERS = {"smallint": "smallint", "int": "int", "bigint": "bigint", "float": "float", "double": "double"}
_TIME = r"^(\d{1,2}):(\d{2}):(\d{2})(?: \(UTC ([+-])(\d{1,2})(?::(\d{2}))?(?::(\d{2}))?\))?$"


def _sized(name: str) -> tuple[str, int | None]:
    m = re.fullmatch(r"(\w+)(?:\((\d+)\))?", name.lower().replace(" ", ""))
    if not m:
        raise ValueError(f"unknown type {name}")
    return m[1], int(m[2]) if m[2] else None


def spark_type(name: str) -> str:
    """The Spark type that holds a type of the engine's closed list."""
    kind, n = _sized(name)
    fixed = NUMBERS | {"date": "date", "timestamp": "timestamp_ntz", "time": "struct<ms:int,utc_offset_ms:int>", "rid": "bigint"}
    if kind in fixed:
        return fixed[kind]
    if kind in ("char", "varchar") and n:
        return f"{kind}({n})"
    raise ValueError(f"unknown type {name}")


def no_nan(c: Column) -> Column:
    """NaN marks a missing number in the row format; here it becomes NULL."""
    return F.when(~F.isnan(c), c)


def parse_field(c: Column, type_name: str) -> Column:
    """Text to a value. NULL or the word NULL in any case is NULL; text of no valid form raises, as ANSI casts do; text longer than its type raises."""
    kind, n = _sized(type_name)
    given = F.when(F.upper(F.trim(c)) != "NULL", c)
    if kind in NUMBERS:
        value = F.trim(given).cast(NUMBERS[kind])
        return no_nan(value) if kind in ("float", "double") else value
    if kind == "char":
        return F.when(F.length(given) <= n, F.rpad(given, n, " ")).otherwise(F.when(given.isNull(), None).otherwise(F.raise_error(F.lit(f"text longer than char({n})"))))
    if kind == "varchar":
        t = F.trim(given)
        return F.when(F.length(t) <= n, t).otherwise(F.when(t.isNull(), None).otherwise(F.raise_error(F.lit(f"text longer than varchar({n})"))))
    if kind == "date":
        return F.trim(given).cast("date")
    if kind == "timestamp":
        return F.trim(given).cast("timestamp_ntz")
    if kind == "time":
        part = lambda i: F.coalesce(F.nullif(F.regexp_extract(F.trim(given), _TIME, i), F.lit("")).cast("int"), F.lit(0))
        ms = ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000
        sign = F.when(F.regexp_extract(F.trim(given), _TIME, 4) == "-", -1).otherwise(1)
        shift = ((part(5) * 60 + part(6)) * 60 + part(7)) * 1000 * sign
        ok = F.trim(given).rlike(_TIME) & (part(1) < 24) & (part(2) < 60) & (part(3) < 60)
        return F.when(ok, F.struct(ms.cast("int").alias("ms"), shift.cast("int").alias("utc_offset_ms"))).otherwise(
            F.when(given.isNull(), None).otherwise(F.raise_error(F.lit("not a time")))
        )
    raise ValueError(f"unknown type {type_name}")


def time_instant(c: Column) -> Column:
    """What times compare on: milliseconds in UTC."""
    return c["ms"] - c["utc_offset_ms"]


def render_field(c: Column, type_name: str) -> Column:
    """A value as text; NULL prints as the word NULL."""
    kind, _ = _sized(type_name)
    if kind == "timestamp":
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
    elif kind == "time":
        s, o = F.floor(c["ms"] / 1000), F.abs(c["utc_offset_ms"])
        two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
        clock = F.concat_ws(":", F.floor(s / 3600).cast("string"), two(F.floor(s / 60) % 60), two(s % 60))
        zone = F.concat(F.lit(" (UTC "), F.when(c["utc_offset_ms"] < 0, "-").otherwise("+"), F.floor(o / 3600000).cast("string"), F.lit(":"), two(F.floor(o / 60000) % 60), F.lit(")"))
        text = F.when(c["utc_offset_ms"] == 0, clock).otherwise(F.concat(clock, zone))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("NULL"))
