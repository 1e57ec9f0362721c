"""One import for the public operations (the signatures of SURVEY 2.J).

    from logtide import api
    logs = api.read_logs(spark, "/data/journal_logs")
    page, state = api.search_page(logs, now, start="-1h", q="error", limit=100)
"""

from logtide.functions.columns import (  # noqa: F401
    age_seconds,
    cmdline,
    fuzzy,
    human_bytes,
    human_runtime,
    memory_percent,
    minute_key,
    priority_label,
    search_text,
    severity_class,
    size_bytes,
    strict_int,
    uid_text,
)
from logtide.functions.text import escape_like, parse_size, parse_time  # noqa: F401
from logtide.operators.charts import timechart, timechart_pivot, timechart_stacked  # noqa: F401
from logtide.operators.ingest import (  # noqa: F401
    extra_fields,
    field,
    ingest_summary,
    ingest_summary_all,
    parse_entries,
    rebuild_fields,
    type_fields,
    with_entry_timestamp,
)
from logtide.operators.maintenance import (  # noqa: F401
    append_samples,
    apply_delete_minute,
    apply_retention_by_age,
    apply_retention_by_size,
    clear,
    clear_table,
    compact,
    conform,
    delete_minute,
    drop_oldest_tenth,
    retain_by_age,
    retain_by_size,
    retention_report,
    run_retention,
    write_logs,
    write_process_metrics,
)
from logtide.operators.predicates import log_filter  # noqa: F401
from logtide.operators.processes import (  # noqa: F401
    dedupe_samples,
    latest_processes,
    process_page,
    process_table,
    to_process_metrics,
)
from logtide.operators.search import (  # noqa: F401
    entries_for_minute,
    page_state,
    resolve_columns,
    search,
    search_page,
    search_total,
    sort_columns,
    sorted_page,
)
from logtide.operators.stats import (  # noqa: F401
    buffer_stats,
    column_profile,
    count_by_minute,
    count_entries,
    distinct_minutes,
    filter_values,
    filters,
    minute_bounds,
    minute_counts,
    severity_counts,
    status,
    storage_health,
    storage_stats,
    stored_column_profile,
    stored_filters,
    stored_health,
    stored_status,
)
from logtide.session import build_session, checkpoint_dir  # noqa: F401
from logtide.sources.journal import (  # noqa: F401
    accepted_rows,
    at_timestamp,
    backfill,
    follow_from,
    line_report,
    newest_first,
    parse_lines,
    read_journal,
    read_journal_typed,
    recent_history,
    rejected_lines,
    skip_older_than,
    stream_journal,
    tail,
    tail_start,
)
from logtide.sources.samples import read_process_samples, stream_process_samples  # noqa: F401
from logtide.sources.tables import read_logs, read_logs_with_text, read_process_metrics  # noqa: F401
from logtide.streaming.jobs import (  # noqa: F401
    ingest_lines,
    live_ingest_summary,
    live_timechart,
    read_ingest_counts,
    read_live_summary,
    read_live_timechart,
    read_rejects,
    run_to_table,
    start_journal_ingest,
    start_live_summary,
    start_live_timechart,
    start_log_ingest,
    start_sample_ingest,
)
