"""DataFrame operators: predicates, search, charts, statistics, processes,
ingest transforms and table maintenance."""
