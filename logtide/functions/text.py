"""Driver-side argument parsing: time expressions, LIKE patterns, sizes.

These turn user text into literals once per query; no data passes through
them.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

_REL_UNITS = {"d": "days", "h": "hours", "m": "minutes", "s": "seconds"}
_SIZE_UNITS = {"K": 1024, "M": 1024**2, "G": 1024**3, "T": 1024**4}
_INT_RE = re.compile(r"^[+-]?[0-9]+$")


def _naive_utc(dt: datetime) -> datetime:
    if dt.tzinfo is not None:
        dt = dt.astimezone(timezone.utc).replace(tzinfo=None)
    return dt


def parse_time(text: str, now: datetime) -> datetime:
    """`now`, `-<int>{d,h,m,s}` or RFC 3339; returns a naive UTC datetime.

    The number after the leading `-` may itself be signed, so `--5h` is five
    hours in the future.  Anything else raises ValueError.
    """
    now = _naive_utc(now)
    if text == "now":
        return now
    if text.startswith("-"):
        body = text[1:]
        unit = body[-1:] if body else ""
        if unit not in _REL_UNITS:
            raise ValueError(f"not an offset like -15m: {text!r}")
        num = body[:-1]
        if not _INT_RE.match(num):
            raise ValueError(f"the offset {text!r} needs a whole number, not {num!r}")
        return now - timedelta(**{_REL_UNITS[unit]: int(num)})
    m = re.match(
        r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$", text
    )
    if not m:
        raise ValueError(f"neither now, an offset nor a date with time and zone: {text!r}")
    frac = (m.group(7) or ".0")[1:][:6].ljust(6, "0")
    tz = m.group(8)
    offset = timezone.utc if tz in ("Z", "z") else timezone(
        (1 if tz[0] == "+" else -1) * timedelta(hours=int(tz[1:3]), minutes=int(tz[4:6]))
    )
    dt = datetime(*(int(m.group(i)) for i in range(1, 7)), int(frac), tzinfo=offset)
    return _naive_utc(dt)


def escape_like(q: str) -> str:
    """Make `\\`, `%` and `_` literal for a LIKE pattern with `\\` as escape."""
    return q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_pattern(q: str) -> str:
    """Pattern for a case-insensitive substring match of q."""
    return "%" + escape_like(q) + "%"


#: A decimal number as the size settings take it.
SIZE_NUMBER = re.compile(r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))")


def parse_size(text: str) -> int:
    """`5G`, `500M`, `1T`, `1024K` (capitals) or a plain number of bytes.

    The number may have a sign, a fraction, an exponent, or be `inf` or `nan`; the
    result is cut to whole bytes and kept between 0 and 2**64 - 1 (`nan`: 0)."""
    s = text.strip()
    mult = _SIZE_UNITS.get(s[-1:], 1)
    number = s[:-1] if s[-1:] in _SIZE_UNITS else s
    if not SIZE_NUMBER.fullmatch(number):
        raise ValueError(f"not a size: {text!r}")
    value = float(number) * mult
    if not value > 0:
        return 0
    return 2**64 - 1 if value >= 2.0**64 else int(value)


def split_list(text: str | None) -> list[str] | None:
    """Comma list as given (values are not trimmed); None or empty means no filter."""
    if not text:
        return None
    return text.split(",")


def ts_text(dt: datetime) -> str:
    """Literal text for a naive UTC datetime, microsecond precision."""
    return _naive_utc(dt).strftime("%Y-%m-%d %H:%M:%S.%f")
