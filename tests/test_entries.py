"""Per-file entries of stored tables: filter values, filled counts, trigram signatures."""

import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logtide.operators import maintenance as M
from logtide.operators import search, stats
from logtide.operators.predicates import message_contains
from logtide.sources import tables
from logtide.sources.files import TableFiles
from logtide.sources.ledger import Filled, Trigrams, Values
from tests.conftest import SF001
from tests.test_table_jobs import _spoil


def _rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_filters_and_catalogue_follow_every_write(spark, tmp_dir):
    path = f"{tmp_dir}/logs"
    logs = tables.journal_logs(spark, SF001)

    def same():
        now = tables.read_logs(spark, path)
        for got, want in zip(stats.stored_filters(spark, path), stats.filters(now)):
            assert _rows(got) == _rows(want)
        assert _rows(stats.stored_column_profile(spark, path)) == _rows(stats.column_profile(now))

    M.write_logs(logs.where("__SEQNUM % 2 = 0"), path)
    same()
    M.write_logs(logs.where("__SEQNUM % 2 = 1"), path)
    M.compact(spark, path, ["2024-01-10", "2024-01-11"])
    M.delete_before(spark, path, datetime(2024, 1, 9, 12))
    same()
    want = [_rows(x) for x in stats.stored_filters(spark, path)]
    _spoil(path, TableFiles(spark, path).dates())  # nothing of the rows is read again
    assert [_rows(x) for x in stats.stored_filters(spark, path)] == want
    assert Filled(spark, path).refresh().count() > 0
    M.clear_table(spark, path)
    assert Values(spark, path).counts("priority").count() == 0 and stats.stored_filters(spark, path)[2].agg(F.sum("count")).first()[0] == 0


TEXTS = ["disk full", "Disk FULL on /dev/sda1", "100% of user_17", "100 of userX17", "ERREUR é è", "İstanbul ŞEHİR", "日本語のログ", "it's", "", None, "ab", "back\\slash", "x" * 500]


@pytest.mark.parametrize("q", ["disk", "DISK full", "sda1", "%", "_17", "r_17", "é è", "É", "istanbul", "şehir", "日本", "本語の", "ab", "a", "back\\s", "'s", "xxxx", "nowhere at all", "full on"])
def test_text_search_reads_fewer_files_for_the_same_rows(spark, tmp_dir_once, q):
    logs = tables.read_logs(spark, tmp_dir_once)
    some = tables.read_logs_with_text(spark, tmp_dir_once, q)
    cond = message_contains(q)
    assert _rows(some.where(cond).select("__CURSOR", "message", "date")) == _rows(logs.where(cond).select("__CURSOR", "message", "date"))
    files = Trigrams(spark, tmp_dir_once).files_with(q)
    if len(q.encode()) < 3:
        assert files is None
    if q in ("sda1", "nowhere at all", "本語の"):
        assert len(files) <= 2 < len(TableFiles(spark, tmp_dir_once).files())


@pytest.fixture(scope="module")
def tmp_dir_once(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('text')}/logs"
    rng = random.Random(2)
    base = tables.journal_logs(spark, SF001).limit(1)
    rows = [(datetime(2024, 1, 1 + i % 13, i % 24), f"t-{i}", TEXTS[i % 13] if rng.random() < 2 else "") for i in range(52)]
    extra = spark.createDataFrame(rows, "timestamp timestamp_ntz, __CURSOR string, message string")
    names = [c for c in base.columns if c not in extra.columns]
    frame = extra.crossJoin(F.broadcast(base.select(*[F.col(f"`{c}`") for c in names]))).select(*[F.col(f"`{c}`") for c in base.columns])
    M.write_logs(frame, path)
    return path


def test_text_search_after_appends(spark, tmp_dir):
    path = f"{tmp_dir}/logs"
    logs = tables.journal_logs(spark, SF001)
    M.write_logs(logs.where("__SEQNUM < 500"), path)
    assert tables.read_logs_with_text(spark, path, "zzzz never").count() == 0
    Trigrams(spark, path).refresh()
    M.write_logs(logs.where("__SEQNUM >= 500"), path)  # files without a signature are measured before they are left out
    now = datetime(2024, 1, 31)
    got = search.search(tables.read_logs_with_text(spark, path, "user_9"), now, start="-30d", q="user_9", limit=500)
    want = search.search(logs, now, start="-30d", q="user_9", limit=500)
    assert _rows(got) == _rows(want) and got.count() > 0
    assert os.path.isdir(f"{path}/_trigrams")
