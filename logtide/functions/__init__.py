"""Column functions and driver-side argument parsers."""

from logtide.functions.columns import (  # noqa: F401
    PRIORITY_LABELS,
    age_seconds,
    cmdline,
    fuzzy,
    human_bytes,
    human_runtime,
    memory_percent,
    minute_key,
    minute_start,
    priority_label,
    row_bytes,
    search_text,
    severity_class,
    size_bytes,
    strict_int,
    ts_literal,
    uid_text,
)
from logtide.functions.text import (  # noqa: F401
    contains_pattern,
    escape_like,
    parse_size,
    parse_time,
    split_list,
)
