from datetime import datetime

from pyspark.sql import functions as F

from logtide.operators.ingest import parse_entries


def entries(spark, rows):
    """rows: list of (datetime or None, dict of fields) -> entry frame (`fields` map).

    A datetime is written into __REALTIME_TIMESTAMP as microseconds, as the
    journal does.
    """
    data = []
    for ts, fields in rows:
        f = dict(fields)
        if ts is not None:
            f["__REALTIME_TIMESTAMP"] = str(int((ts - datetime(1970, 1, 1)).total_seconds() * 1_000_000))
        data.append((f,))
    return spark.createDataFrame(data, "fields map<string,string>")


def typed(spark, rows, now=datetime(2026, 1, 20)):
    return parse_entries(entries(spark, rows), now)


def col_list(df, c):
    return [r[0] for r in df.select(c).collect()]


_ = F
