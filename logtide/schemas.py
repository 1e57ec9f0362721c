"""Table schemas for stored journal logs and process metrics.

The column lists below are fixed values: they must equal the field names and
types of the journal table the package replaces, or stored data would not be
interchangeable.  They are kept together and in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: journal field -> stored column, in table order -----------
# (stored column name, journal field name, kind)   kind: str | int | long
KNOWN_FIELDS: list[tuple[str, str, str]] = [
    ("message", "MESSAGE", "str"),
    ("message_id", "MESSAGE_ID", "str"),
    ("priority", "PRIORITY", "int"),
    ("code_file", "CODE_FILE", "str"),
    ("code_line", "CODE_LINE", "int"),
    ("code_func", "CODE_FUNC", "str"),
    ("errno", "ERRNO", "int"),
    ("invocation_id", "INVOCATION_ID", "str"),
    ("user_invocation_id", "USER_INVOCATION_ID", "str"),
    ("syslog_facility", "SYSLOG_FACILITY", "int"),
    ("syslog_identifier", "SYSLOG_IDENTIFIER", "str"),
    ("syslog_pid", "SYSLOG_PID", "int"),
    ("syslog_timestamp", "SYSLOG_TIMESTAMP", "str"),
    ("syslog_raw", "SYSLOG_RAW", "str"),
    ("documentation", "DOCUMENTATION", "str"),
    ("tid", "TID", "int"),
    ("unit", "UNIT", "str"),
    ("user_unit", "USER_UNIT", "str"),
    ("_PID", "_PID", "int"),
    ("_UID", "_UID", "int"),
    ("_GID", "_GID", "int"),
    ("_COMM", "_COMM", "str"),
    ("_EXE", "_EXE", "str"),
    ("_CMDLINE", "_CMDLINE", "str"),
    ("_CAP_EFFECTIVE", "_CAP_EFFECTIVE", "str"),
    ("_AUDIT_SESSION", "_AUDIT_SESSION", "int"),
    ("_AUDIT_LOGINUID", "_AUDIT_LOGINUID", "int"),
    ("_SYSTEMD_CGROUP", "_SYSTEMD_CGROUP", "str"),
    ("_SYSTEMD_SLICE", "_SYSTEMD_SLICE", "str"),
    ("_SYSTEMD_UNIT", "_SYSTEMD_UNIT", "str"),
    ("_SYSTEMD_USER_UNIT", "_SYSTEMD_USER_UNIT", "str"),
    ("_SYSTEMD_USER_SLICE", "_SYSTEMD_USER_SLICE", "str"),
    ("_SYSTEMD_SESSION", "_SYSTEMD_SESSION", "str"),
    ("_SYSTEMD_OWNER_UID", "_SYSTEMD_OWNER_UID", "int"),
    ("_SELINUX_CONTEXT", "_SELINUX_CONTEXT", "str"),
    ("_SOURCE_REALTIME_TIMESTAMP", "_SOURCE_REALTIME_TIMESTAMP", "long"),
    ("_SOURCE_BOOTTIME_TIMESTAMP", "_SOURCE_BOOTTIME_TIMESTAMP", "long"),
    ("_BOOT_ID", "_BOOT_ID", "str"),
    ("_MACHINE_ID", "_MACHINE_ID", "str"),
    ("_SYSTEMD_INVOCATION_ID", "_SYSTEMD_INVOCATION_ID", "str"),
    ("_HOSTNAME", "_HOSTNAME", "str"),
    ("_TRANSPORT", "_TRANSPORT", "str"),
    ("_STREAM_ID", "_STREAM_ID", "str"),
    ("_LINE_BREAK", "_LINE_BREAK", "str"),
    ("_NAMESPACE", "_NAMESPACE", "str"),
    ("_RUNTIME_SCOPE", "_RUNTIME_SCOPE", "str"),
    ("_KERNEL_DEVICE", "_KERNEL_DEVICE", "str"),
    ("_KERNEL_SUBSYSTEM", "_KERNEL_SUBSYSTEM", "str"),
    ("_UDEV_SYSNAME", "_UDEV_SYSNAME", "str"),
    ("_UDEV_DEVNODE", "_UDEV_DEVNODE", "str"),
    ("_UDEV_DEVLINK", "_UDEV_DEVLINK", "str"),
    ("COREDUMP_UNIT", "COREDUMP_UNIT", "str"),
    ("COREDUMP_USER_UNIT", "COREDUMP_USER_UNIT", "str"),
    ("OBJECT_PID", "OBJECT_PID", "int"),
    ("OBJECT_UID", "OBJECT_UID", "int"),
    ("OBJECT_GID", "OBJECT_GID", "int"),
    ("OBJECT_COMM", "OBJECT_COMM", "str"),
    ("OBJECT_EXE", "OBJECT_EXE", "str"),
    ("OBJECT_CMDLINE", "OBJECT_CMDLINE", "str"),
    ("OBJECT_AUDIT_SESSION", "OBJECT_AUDIT_SESSION", "int"),
    ("OBJECT_AUDIT_LOGINUID", "OBJECT_AUDIT_LOGINUID", "int"),
    ("OBJECT_SYSTEMD_CGROUP", "OBJECT_SYSTEMD_CGROUP", "str"),
    ("OBJECT_SYSTEMD_SESSION", "OBJECT_SYSTEMD_SESSION", "str"),
    ("OBJECT_SYSTEMD_OWNER_UID", "OBJECT_SYSTEMD_OWNER_UID", "int"),
    ("OBJECT_SYSTEMD_UNIT", "OBJECT_SYSTEMD_UNIT", "str"),
    ("OBJECT_SYSTEMD_USER_UNIT", "OBJECT_SYSTEMD_USER_UNIT", "str"),
    ("OBJECT_SYSTEMD_USER_SLICE", "OBJECT_SYSTEMD_USER_SLICE", "str"),
    ("OBJECT_SYSTEMD_INVOCATION_ID", "OBJECT_SYSTEMD_INVOCATION_ID", "str"),
    ("__CURSOR", "__CURSOR", "str"),
    ("__REALTIME_TIMESTAMP", "__REALTIME_TIMESTAMP", "long"),
    ("__MONOTONIC_TIMESTAMP", "__MONOTONIC_TIMESTAMP", "long"),
    ("__SEQNUM", "__SEQNUM", "long"),
    ("__SEQNUM_ID", "__SEQNUM_ID", "long"),
]

# Columns left out of the column catalogue (internal bookkeeping).
EXCLUDED_COLUMNS = ["__CURSOR", "__MONOTONIC_TIMESTAMP", "minute_key"]

# Columns shown when a search names none.
DEFAULT_COLUMNS = ["timestamp", "_hostname", "_systemd_unit", "priority", "_pid", "_comm", "message"]

# Display names for search output.
DISPLAY_NAMES = {"_hostname": "hostname", "_systemd_unit": "unit", "_pid": "pid", "_comm": "comm"}
# --- end fixed values --------------------------------------------------------

KNOWN_FIELD_NAMES = [f for _, f, _ in KNOWN_FIELDS]
KIND_TYPES = {"str": T.StringType(), "int": T.IntegerType(), "long": T.LongType()}

# The stored timestamp is a zone-less UTC wall clock, like the table it replaces.
TS_TYPE = T.TimestampNTZType()

JOURNAL_SCHEMA = T.StructType(
    [T.StructField("timestamp", TS_TYPE, False), T.StructField("minute_key", T.StringType(), False)]
    + [T.StructField(c, KIND_TYPES[k], True) for c, _, k in KNOWN_FIELDS]
    + [T.StructField("extra_fields", T.StringType(), True)]
)

JOURNAL_COLUMNS = [f.name for f in JOURNAL_SCHEMA.fields]

# Schema version 1 columns of process_metrics, then the four added by version 2.
PROCESS_SCHEMA_V1 = T.StructType(
    [
        T.StructField("timestamp", TS_TYPE, False),
        T.StructField("pid", T.IntegerType(), False),
        T.StructField("name", T.StringType(), True),
        T.StructField("cpu_usage", T.DoubleType(), True),
        T.StructField("mem_usage", T.DoubleType(), True),
        T.StructField("user", T.StringType(), True),
        T.StructField("runtime", T.LongType(), True),
    ]
)
PROCESS_SCHEMA = T.StructType(
    PROCESS_SCHEMA_V1.fields
    + [
        T.StructField("cmdline", T.StringType(), True),
        T.StructField("virtual_memory", T.DoubleType(), True),
        T.StructField("status", T.StringType(), True),
        T.StructField("parent_pid", T.IntegerType(), True),
    ]
)

# The supplied `events` table the fixtures are derived from (read without inference).
EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType(), True),
        T.StructField("ts", T.TimestampNTZType(), True),
        T.StructField("user_id", T.LongType(), True),
        T.StructField("event_type", T.StringType(), True),
        T.StructField("value", T.DoubleType(), True),
        T.StructField("props", T.StringType(), True),
    ]
)

# One process sample as it arrives from a sampler (file or stream source).
RAW_SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType(), True),
        T.StructField("pid", T.IntegerType(), True),
        T.StructField("name", T.StringType(), True),
        T.StructField("cpu_percent", T.FloatType(), True),
        T.StructField("memory_bytes", T.LongType(), True),
        T.StructField("user_id", T.StringType(), True),
        T.StructField("runtime_secs", T.LongType(), True),
        T.StructField("cmd", T.ArrayType(T.StringType()), True),
        T.StructField("virtual_memory_bytes", T.LongType(), True),
        T.StructField("status", T.StringType(), True),
        T.StructField("parent_pid", T.IntegerType(), True),
    ]
)


def column_for(name: str) -> str | None:
    """Case-insensitive match of a requested name against the journal columns."""
    low = name.lower()
    for c in JOURNAL_COLUMNS:
        if c.lower() == low:
            return c
    return None
