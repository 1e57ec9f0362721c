"""Column functions (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from logtide.functions.text import SIZE_NUMBER, ts_text

# --- fixed values: severity names by syslog priority 0..7 -------------------
PRIORITY_LABELS = ["Emergency", "Alert", "Critical", "Error", "Warning", "Notice", "Info", "Debug"]
UNKNOWN_LABEL = "Unknown"
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]
DEFAULT_TOTAL_MEMORY = 16 * 1024**3
# --- end fixed values --------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_literal(dt: datetime, ntz: bool = True) -> Column:
    """Constant timestamp; a cast of a string literal folds, so it pushes down."""
    return F.lit(ts_text(dt)).cast("timestamp_ntz" if ntz else "timestamp")


def ts_literal_like(df, col: str, dt: datetime) -> Column:
    return ts_literal(dt, isinstance(df.schema[col].dataType, TimestampNTZType))


def minute_key(ts) -> Column:
    """RFC 3339 text of the minute, e.g. 2026-01-17T14:30:00+00:00 (UTC)."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:00+00:00")


def truncate_like(df, col: str, unit: str) -> Column:
    """date_trunc that keeps the column's own type (date_trunc alone always
    returns a zoned timestamp, even for a zone-less column)."""
    return F.date_trunc(unit, F.col(col)).cast(df.schema[col].dataType)


def minute_start(ts) -> Column:
    """Start of the minute as a zone-less UTC wall clock."""
    return F.date_trunc("minute", _col(ts)).cast("timestamp_ntz")


def strict_int(c, type_name: str = "int") -> Column:
    """Whole-string signed integer parse; NULL for blanks, fractions, overflow."""
    c = _col(c)
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast(type_name))


def uid_text(c) -> Column:
    """`Uid(1234)` -> `1234`; NULL when the text has another form."""
    c = _col(c)
    return F.when(c.rlike(r"^Uid\(.*\)$"), F.regexp_extract(c, r"^Uid\((.*)\)$", 1))


def cmdline(cmd) -> Column:
    cmd = _col(cmd)
    return F.when(F.size(cmd) > 0, F.array_join(cmd, " "))


def priority_label(p) -> Column:
    p = _col(p)
    labels = F.array(*[F.lit(s) for s in PRIORITY_LABELS])
    return F.when((p >= 0) & (p <= 7), F.element_at(labels, p + 1)).otherwise(F.lit(UNKNOWN_LABEL))


def severity_class(p) -> Column:
    p = _col(p)
    return (
        F.when(p <= 2, "critical").when(p == 3, "error").when(p == 4, "warning").otherwise("")
    )


def fixed1(v) -> Column:
    """Text of a number with one decimal, rounded on its exact binary value with
    ties to even, as C and Rust formatting do (6.55 is stored as 6.5499... and
    gives 6.5; 0.25 gives 0.2).

    `format_string('%.1f')` would round the shortest decimal text half-up
    instead (6.6, 0.3); `format_number` with a pattern uses a decimal formatter
    that works on the exact value, without grouping separators.
    """
    return F.call_function("format_number", _col(v).cast("double"), F.lit("0.0"))


def human_bytes(b) -> Column:
    """`-` for <= 0, else one decimal in 1024 steps from B to PB."""
    b = _col(b).cast("double")
    idx = F.lit(len(BYTE_UNITS) - 1)
    for i in range(len(BYTE_UNITS) - 2, -1, -1):
        idx = F.when(b < float(1024 ** (i + 1)), F.lit(i)).otherwise(idx)
    scaled = b / F.pow(F.lit(1024.0), idx)  # exact: division by a power of two
    units = F.array(*[F.lit(u) for u in BYTE_UNITS])
    return F.when(b.isNull() | (b <= 0), F.lit("-")).otherwise(
        F.concat(fixed1(scaled), F.lit(" "), F.element_at(units, idx + 1))
    )


def human_runtime(s) -> Column:
    """45s, 5m 30s, 2h 15m, 3d 12h; zero remainders left out."""
    s = _col(s).cast("long")
    m, h, d = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)

    def two(big, big_unit, rem, rem_unit):
        return F.when(rem > 0, F.format_string(f"%d{big_unit} %d{rem_unit}", big, rem)).otherwise(
            F.format_string(f"%d{big_unit}", big)
        )

    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(m < 60, two(m, "m", s % 60, "s"))
        .when(h < 24, two(h, "h", m % 60, "m"))
        .otherwise(two(d, "d", h % 24, "h"))
    )


def memory_percent(b, total_bytes: int = DEFAULT_TOTAL_MEMORY) -> Column:
    b = _col(b).cast("double")
    return F.when(b.isNull() | (b <= 0), F.lit(0.0)).otherwise(b / F.lit(float(total_bytes)) * 100.0)


def search_text(pid="pid", name="name", user="user", cpu="cpu_usage", ts="timestamp") -> Column:
    """Lower-cased `pid name user cpu(.1f) timestamp` used by the process search."""
    return F.lower(
        F.concat_ws(
            " ",
            _col(pid).cast("string"),
            F.coalesce(_col(name), F.lit("")),
            F.coalesce(_col(user), F.lit("")),
            fixed1(_col(cpu)),
            _col(ts).cast("string"),
        )
    )


def fuzzy(text, query: str) -> Column:
    """True when every character of query occurs in text, in order."""
    if not query:
        return F.lit(True)
    pattern = "(?s)" + ".*".join(re.escape(ch) for ch in query)
    return _col(text).rlike(pattern)


def age_seconds(ts, now: datetime) -> Column:
    """Whole seconds from ts to now."""
    t = _col(ts).cast("timestamp")
    return F.floor(
        (F.unix_micros(ts_literal(now, ntz=False)) - F.unix_micros(t)) / F.lit(1_000_000)
    ).cast("long")


def size_bytes(text) -> Column:
    """Column form of `parse_size`: `5G` etc. -> bytes, NULL if it is not a size.

    A BIGINT ends at 2**63 - 1, where larger sizes stay."""
    t = F.btrim(_col(text).cast("string"), F.lit(" \t\n\r\x0b\x0c"))
    unit = F.when(t.rlike("[KMGT]$"), F.right(t, F.lit(1))).otherwise("")
    number = F.when(unit != "", F.left(t, F.length(t) - 1)).otherwise(t)
    mult = F.lit(1.0)
    for i, u in enumerate("KMGT"):
        mult = F.when(unit == u, 1024.0 ** (i + 1)).otherwise(mult)
    value = number.try_cast("double") * mult
    bytes_ = F.when(F.isnan(value) | ~(value > 0), 0).when(value >= 2.0**63, 2**63 - 1).otherwise(value.try_cast("long"))
    return F.when(number.rlike(f"^(?:{SIZE_NUMBER.pattern})$"), bytes_.cast("long"))


def row_bytes(df, exclude=()) -> Column:
    """Size of a row for storage budgets: UTF-8 bytes of text columns, 8 per other."""
    parts = []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if f.dataType.simpleString() == "string":
            parts.append(F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)))
        else:
            parts.append(F.lit(8))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total.cast("long")
