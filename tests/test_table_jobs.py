"""Table jobs against each other, replays of epochs, keyed appends, and the date ledger."""

import glob
import os
import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logtide.functions.columns import row_bytes
from logtide.operators import maintenance as M
from logtide.operators import processes, stats
from logtide.sources import tables
from logtide.sources.files import CALLED_OFF, TableFiles
from logtide.sources.ledger import Ledger
from logtide.streaming import jobs
from tests.conftest import SF001

T0 = datetime(2026, 1, 1)
DAYS = ["2026-01-01", "2026-01-02", "2026-01-03"]


def _logs(spark, n=100, start=T0, step=timedelta(minutes=40)):
    rows = [(start + i * step, f"c-{i:05d}", "x" * (i % 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, __CURSOR string, message string")
    return df.withColumn("minute_key", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:00+00:00"))


def _cursors(spark, path):
    return sorted(r["__CURSOR"] for r in spark.read.parquet(path).collect())


def _clean(path):
    assert not (glob.glob(f"{path}/_stage*") + glob.glob(f"{path}/_replace*"))


# claims ------------------------------------------------------------------------------


def test_a_file_is_published_once(spark, tmp_dir):
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: TableFiles(spark, tmp_dir).publish("_claims/x/1", str(i)), range(24)))
    assert sum(won) == 1 and TableFiles(spark, tmp_dir).read("_claims/x/1") == str(won.index(True))
    assert not glob.glob(f"{tmp_dir}/_claims/x/*.part")


def test_two_jobs_staged_at_once(spark, tmp_dir, monkeypatch):
    path = f"{tmp_dir}/logs"
    M.write_logs(_logs(spark), path)
    want, claim, inner = _cursors(spark, path), TableFiles.claim, []

    def late(self, job, dates):
        if not inner:  # the first job has staged; another one does all its work now
            inner.append(True)
            assert M.compact(spark, path, DAYS) == 100
        return claim(self, job, dates)

    with monkeypatch.context() as m:
        m.setattr(TableFiles, "claim", late)
        assert M.compact(spark, path, DAYS) == 100
    assert _cursors(spark, path) == want
    _clean(path)


def test_many_jobs_on_the_same_dates(spark, tmp_dir):
    path = f"{tmp_dir}/logs"
    M.write_logs(_logs(spark), path)
    minute = T0 + timedelta(minutes=80)
    todo = [lambda: M.compact(spark, path, DAYS), lambda: M.compact(spark, path, DAYS[:2], 2), lambda: M.apply_delete_minute(spark, path, minute),
            lambda: M.apply_delete_minute(spark, path, minute), lambda: M.delete_before(spark, path, T0 + timedelta(minutes=41)), lambda: M.compact(spark, path, DAYS)]
    with ThreadPoolExecutor(6) as pool:
        done = [f.result() for f in [pool.submit(t) for t in todo]]
    assert sorted(done[2:4]) == [0, 1] and done[4] == 2
    assert _cursors(spark, path) == [f"c-{i:05d}" for i in range(100) if i not in (0, 1, 2)]
    _clean(path)


@pytest.mark.parametrize("noted", [False, True])
def test_a_claimant_that_died_is_called_off_or_finished(spark, tmp_dir, monkeypatch, noted):
    path = f"{tmp_dir}/logs"
    M.write_logs(_logs(spark), path)
    want, note, dead = _cursors(spark, path), TableFiles.note, []

    def die(self, name, old):
        dead.append((name, self, old))
        if noted:
            note(self, name, old)
        raise KeyboardInterrupt  # no cleaning up

    with monkeypatch.context() as m:
        m.setattr(TableFiles, "note", die)
        with pytest.raises(KeyboardInterrupt):
            M.compact(spark, path, DAYS)
    name, table, old = dead[0]
    if not noted:
        assert not TableFiles(spark, path).claim("another", DAYS[:1])  # it could still be at work
        late = TableFiles(spark, path, lease=0.0)
        assert late.claim("another", DAYS) and TableFiles(spark, path).read(f"_replace-{name}") == CALLED_OFF
        assert note(table, name, old) is False  # had it only been slow, it would learn so here
        late.call_off("another")
    assert M.compact(spark, path, DAYS) == 100
    assert _cursors(spark, path) == want


def test_finishing_twice_and_side_by_side(spark, tmp_dir):
    path = f"{tmp_dir}/logs"
    M.write_logs(_logs(spark), path)
    want = _cursors(spark, path)
    table = TableFiles(spark, path)
    old = table.files()
    spark.read.option("basePath", path).parquet(*old).repartition(3).write.partitionBy("date").parquet(table.stage("job"))
    assert table.claim("job", DAYS) and table.note("job", old)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: TableFiles(spark, path).finish("job"), range(4)))
    assert _cursors(spark, path) == want
    assert TableFiles(spark, path).claim("next", DAYS)  # released
    _clean(path)


# epochs of streams ----------------------------------------------------------------------


@pytest.mark.parametrize("rewrite", ["compact", "retain", "minute", "clear"])
def test_a_replay_after_a_rewrite_adds_nothing(spark, tmp_dir, rewrite):
    path = f"{tmp_dir}/logs"
    run = jobs._append_once(M.write_logs, path, f"{tmp_dir}/ckpt")
    rows = _logs(spark)
    run(rows, 0)
    run(rows.limit(0), 1)
    if rewrite == "compact":
        M.compact(spark, path, DAYS)
    elif rewrite == "retain":
        M.delete_before(spark, path, T0 + timedelta(days=1))
    elif rewrite == "minute":
        M.apply_delete_minute(spark, path, T0)
    else:
        M.clear_table(spark, path)
    left = TableFiles(spark, path).files()
    run(rows, 0)
    run(rows.limit(0), 1)
    assert TableFiles(spark, path).files() == left


def test_compaction_in_the_middle_of_an_epoch(spark, tmp_dir, monkeypatch):
    path = f"{tmp_dir}/logs"
    run = jobs._append_once(M.write_logs, path, f"{tmp_dir}/ckpt")
    rows, move = _logs(spark), TableFiles.move_in

    def half(self, stage, prefix):
        files = self._glob(f"{stage}/date=*/*.parquet")
        for p in files[: len(files) // 2]:
            folder, name = p.rsplit("/", 2)[1:]
            self._fs.mkdirs(self._at(f"{self.path}/{folder}"))
            self._fs.rename(self._at(p), self._at(f"{self.path}/{folder}/{prefix}{name}"))
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(TableFiles, "move_in", half)
        with pytest.raises(KeyboardInterrupt):
            run(rows, 0)
    assert 0 < spark.read.parquet(path).count() < 100
    M.compact(spark, path, DAYS)
    monkeypatch.setattr(TableFiles, "move_in", move)
    run(rows, 0)
    run(rows, 0)
    assert _cursors(spark, path) == [f"c-{i:05d}" for i in range(100)]


def test_a_stream_begun_anew_counts_its_epochs_anew(spark, tmp_dir):
    path, ckpt = f"{tmp_dir}/logs", f"{tmp_dir}/ckpt"
    names = set()
    for run_id in ("a", "b"):
        os.makedirs(ckpt, exist_ok=True)
        with open(f"{ckpt}/metadata", "w") as f:
            f.write('{"id":"%s"}' % run_id)
        names.add(jobs._run_name(TableFiles(spark, path), ckpt))
        jobs._append_once(M.write_logs, path, ckpt)(_logs(spark, 10), 0)
    assert len(names) == 2 and spark.read.parquet(path).count() == 20


def test_old_epoch_records_go(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr("logtide.sources.files.EPOCHS_KEPT", 3)
    path = f"{tmp_dir}/logs"
    run = jobs._append_once(M.write_logs, path, f"{tmp_dir}/ckpt")
    for epoch in range(8):
        run(_logs(spark, 2), epoch)
    assert len(glob.glob(f"{path}/_epochs/*/*")) == 4 and spark.read.parquet(path).count() == 16


# keyed appends ---------------------------------------------------------------------------


def _samples(spark, keys):
    rows = [(T0 + timedelta(hours=h), p, f"p{p}", float(i)) for i, (h, p) in enumerate(keys)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, pid int, name string, cpu_usage double")


def test_appending_twice_changes_nothing(spark, tmp_dir):
    path = f"{tmp_dir}/procs"
    rng = random.Random(1)
    keys = [(rng.randint(0, 60), rng.randint(1, 30)) for _ in range(400)]
    assert M.write_process_metrics(_samples(spark, keys[:200]), path) == len(set(keys[:200]))
    files = TableFiles(spark, path).files()
    assert M.write_process_metrics(_samples(spark, keys[:200]), path) == 0 and TableFiles(spark, path).files() == files
    assert M.write_process_metrics(_samples(spark, keys), path) == len(set(keys)) - len(set(keys[:200]))
    got = spark.read.parquet(path)
    assert got.count() == len(set(keys)) == got.select("timestamp", "pid").distinct().count()
    assert M.write_process_metrics(_samples(spark, keys).limit(0), path) == 0
    _clean(path)


def test_appends_of_the_same_keys_at_once(spark, tmp_dir):
    path = f"{tmp_dir}/procs"
    keys = [(h, p) for h in range(30) for p in range(5)]
    with ThreadPoolExecutor(4) as pool:
        added = list(pool.map(lambda _: M.write_process_metrics(_samples(spark, keys), path), range(4)))
    assert sum(added) == 150 and spark.read.parquet(path).count() == 150


def test_first_arrival_stays_and_null_keys_are_keys(spark, tmp_dir):
    path = f"{tmp_dir}/procs"
    schema = "timestamp timestamp_ntz, pid int, name string, seq long"
    rows = spark.createDataFrame([(T0, 1, "late", 9), (T0, 1, "first", 2), (T0, None, "x", 3), (T0, None, "y", 4)], schema)
    assert M.write_process_metrics(rows, path) == 2 and M.write_process_metrics(rows, path) == 0
    assert sorted(r["name"] for r in spark.read.parquet(path).collect()) == ["first", "x"] and "seq" not in spark.read.parquet(path).columns


@pytest.mark.parametrize("bits", [1 << 15, 1 << 25])
def test_absent_keys_by_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(M, "BLOOM_BITS", bits)
    rng = random.Random(bits)
    pick = lambda n: [(rng.choice([None, *range(200)]), rng.choice([None, "a", "b"])) for _ in range(n)]
    batch, stored = pick(300), pick(300)
    frames = [spark.createDataFrame(x, "k int, s string") for x in (batch, stored)]
    got = M.absent_keys(frames[0], frames[1], ["k", "s"]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(x) for x in batch if x not in set(stored))
    plan = M.absent_keys(frames[0], frames[1], ["k", "s"])._jdf.queryExecution().toString()
    assert "bitmap_construct_agg" in plan and "LeftAnti" in plan


# the ledger ------------------------------------------------------------------------------


def _scanned(spark, path):
    df = spark.read.parquet(path)
    t = F.col("timestamp").cast("timestamp_ntz")
    return sorted(map(tuple, df.groupBy("date").agg(F.count("*"), F.sum(row_bytes(df, exclude=("date",))), F.min(t), F.max(t)).collect()))


def _ledger(spark, path):
    return sorted(map(tuple, Ledger(spark, path).by_date().collect()))


def test_ledger_follows_every_write(spark, tmp_dir):
    path = f"{tmp_dir}/logs"
    assert Ledger(spark, path).totals().first()[:] == (0, 0, None, None)
    M.write_logs(_logs(spark), path)
    assert _ledger(spark, path) == _scanned(spark, path)
    jobs._append_once(M.write_logs, path, f"{tmp_dir}/ckpt")(_logs(spark, 30, T0 + timedelta(hours=5)), 0)  # measured when asked
    _logs(spark, 20, T0 + timedelta(hours=7)).withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").parquet(path)  # by somebody else
    assert _ledger(spark, path) == _scanned(spark, path)
    M.compact(spark, path, DAYS[:2])
    M.apply_delete_minute(spark, path, T0)
    M.delete_before(spark, path, T0 + timedelta(hours=30))
    assert _ledger(spark, path) == _scanned(spark, path)
    # a ledger that was lost is made again
    import shutil

    shutil.move(f"{path}/_ledger", f"{tmp_dir}/aside")
    assert _ledger(spark, path) == _scanned(spark, path)


def test_ledger_is_written_anew_and_old_parts_go(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr("logtide.sources.ledger.MOST_PARTS", 3)
    path = f"{tmp_dir}/logs"
    for i in range(9):
        M.write_logs(_logs(spark, 5, T0 + timedelta(hours=i)), path)
    assert _ledger(spark, path) == _scanned(spark, path)
    ledger = Ledger(spark, path)
    assert len(ledger._parts()) <= 4 < len(glob.glob(f"{path}/_ledger/*"))
    ledger.table.lease = -1.0
    ledger._parts()
    assert len(glob.glob(f"{path}/_ledger/*")) <= 4 and _ledger(spark, path) == _scanned(spark, path)


def _spoil(path, dates):
    """Files of these dates can no longer be read: whoever opens one fails."""
    for d in dates:
        for f in glob.glob(f"{path}/date={d}/*.parquet"):
            n = os.path.getsize(f)
            os.remove(f"{os.path.dirname(f)}/.{os.path.basename(f)}.crc")
            with open(f, "wb") as out:
                out.write(b"x" * n)


def test_budgets_and_status_open_no_older_date(spark, tmp_dir):
    logs, procs = tables.journal_logs(spark, SF001), tables.process_metrics(spark, SF001)
    lp, pp = f"{tmp_dir}/logs", f"{tmp_dir}/procs"
    M.write_logs(logs, lp)
    M.write_process_metrics(procs, pp)
    budget = 60_000
    cut = M.stored_size_cutoff(spark.read.parquet(lp), budget)
    older = [d for d in TableFiles(spark, lp).dates() if d < cut.date().isoformat()]
    assert len(older) > 3
    health = stats.stored_health(spark, lp, pp, size="rows").first()
    want = stats.storage_health(logs, procs).first()
    assert health == want
    _spoil(lp, older)
    assert M.stored_cutoff(spark, lp, budget) == cut
    table = tables.read_logs(spark, lp)
    assert M.budget_cutoff(table, budget, "fit") == cut  # batches of dates, newest first
    assert stats.stored_health(spark, lp, pp, size="rows").first() == want
    removed = M.apply_retention_by_size(spark, lp, budget)
    assert removed == logs.where(F.col("timestamp") < F.lit(cut.isoformat(sep=" ")).cast("timestamp_ntz")).count()
    # the newest snapshot: dates from the listing
    newest = TableFiles(spark, pp).dates()[-1]
    at = processes.latest_timestamp(tables.read_process_metrics(spark, pp))
    _spoil(pp, [d for d in TableFiles(spark, pp).dates() if d != newest])
    assert processes.latest_timestamp(tables.read_process_metrics(spark, pp)) == at
    assert M.apply_retention_by_age(spark, pp, datetime.combine(datetime.fromisoformat(newest), datetime.min.time()), 0) > 0
