"""What is known of each data file of a stored table: the date ledger and the value dictionary.

Entries are small Parquet files in a folder of the table, one folder for each write.  An entry
counts as long as its data file is there, so a rewrite or a deletion needs no
upkeep; a data file without an entry (of a stream's batch, of a job that died, of a
table that never had entries) is measured once, when they are next asked for.
What is read to answer grows with the number of files, not with the rows.

- `Ledger`: rows, bytes, first and last time.  Size budgets, reports and status pages add
  them up instead of scanning stored dates.
- `Values`: the values of the filter columns with their rows.  The search page's choices are merged from them.
- `Filled`: how many rows have a value, column by column, for the column catalogue.
- `Trigrams`: which three-byte sequences the lower-cased messages hold, as a bitmap; a text search
  leaves out files that lack one of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions.columns import row_bytes
from logtide.sources.files import TableFiles, date_of

#: Folders of entries after which they are written anew as one.
MOST_PARTS = 24
#: Data files that are measured by one scan.
MOST_FILES = 10_000
#: Bits of a file's trigram signature, and bits of one of its rows.
TRIGRAM_BITS, BITMAP_BITS = 1 << 18, 32768
FILTER_COLUMNS = ("_HOSTNAME", "_SYSTEMD_UNIT", "priority")


class Entries:
    """Entries (day, file, ...) of one table's data files; subclasses say what is measured."""

    FOLDER: str
    SCHEMA: str

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.table = spark, path.rstrip("/"), TableFiles(spark, path)

    def _of(self, rows: DataFrame) -> DataFrame:
        """The entries of some rows that carry `day` and `file`."""
        raise NotImplementedError

    def _parts(self) -> list[str]:
        """Folders of entries; those that were written anew are left out, and deleted when nobody reads them any more."""
        old: set[str] = set()
        for record in self.table._names(f"{self.FOLDER}-merged"):
            names = (self.table.read(f"{self.FOLDER}-merged/{record}") or "").split("\n")
            old |= set(names)
            if self.table.age(f"{self.FOLDER}-merged/{record}") > self.table.lease:
                for n in names:
                    self.table.drop(f"{self.FOLDER}/{n}")
                self.table.delete([f"{self.path}/{self.FOLDER}-merged/{record}"])
        return [p for p in self.table._glob(f"{self.path}/{self.FOLDER}/*") if p.rsplit("/", 1)[1] not in old]

    def _noted(self, parts: list[str]) -> DataFrame:
        """All entries, of files that are gone, too; a file that was measured twice has one."""
        frame = self.spark.read.schema(self.SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], self.SCHEMA)
        return frame.dropDuplicates()

    def _present(self, files: list[str]) -> DataFrame:
        names = [(date_of(p), p.rsplit("/", 1)[1]) for p in files]
        return self.spark.createDataFrame(names, "day string, file string")

    def _measure(self, files: list[str]) -> None:
        """One scan of the files; what the entries need of them."""
        rows = self.spark.read.option("basePath", self.path).parquet(*files)
        folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
        own = rows.select(F.element_at(F.split(folder, "="), -1).alias("day"), F.col("_metadata.file_name").alias("file"), *[F.col(f"`{c}`") for c in rows.columns if c != "date"])
        self._of(own).coalesce(1).write.parquet(f"{self.path}/{self.FOLDER}/{uuid.uuid4().hex}")

    def refresh(self) -> DataFrame:
        """Entries of all data files that are there now; files without one are measured first."""
        for attempt in range(5):
            files, parts = self.table.files(), self._parts()
            # as many names as the listing has, which the driver holds anyway
            known = {tuple(r) for r in self._noted(parts).select("day", "file").distinct().collect()} if parts and files else set()
            missing = [p for p in files if (date_of(p), p.rsplit("/", 1)[1]) not in known]
            try:
                for i in range(0, len(missing), MOST_FILES):
                    self._measure(missing[i : i + MOST_FILES])
                break
            except Exception:
                if attempt == 4 or self.table.all_there(missing):
                    raise
        if missing:
            parts = self._parts()
        if files and not missing and len(known) == len(files) and len(parts) <= MOST_PARTS:
            return self._noted(parts)  # nothing to leave out
        if not files or not parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        entries = self._noted(parts).join(self._present(files), ["day", "file"], "left_semi")
        if len(parts) > MOST_PARTS:
            name = uuid.uuid4().hex
            entries.coalesce(1).write.parquet(f"{self.path}/{self.FOLDER}/{name}")  # readers of both see doubles, which count once
            self.table.publish(f"{self.FOLDER}-merged/{name}", "\n".join(p.rsplit("/", 1)[1] for p in parts))
            entries = self._noted([f"{self.path}/{self.FOLDER}/{name}"])
        return entries


class Ledger(Entries):
    """Rows, bytes, first and last time of every data file."""

    FOLDER = "_ledger"
    SCHEMA = "day string, file string, rows long, bytes long, first timestamp_ntz, last timestamp_ntz"

    def _of(self, rows: DataFrame) -> DataFrame:
        time = F.col("timestamp").cast("timestamp_ntz")
        return rows.groupBy("day", "file").agg(
            F.count("*").alias("rows"), F.sum(row_bytes(rows, exclude=("day", "file"))).alias("bytes"), F.min(time).alias("first"), F.max(time).alias("last"))

    def by_date(self) -> DataFrame:
        """(date, rows, bytes, first, last), a row for each stored date; rows without a time are under no date."""
        return self.refresh().groupBy(F.try_to_date("day").alias("date")).agg(
            F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.min("first").alias("first"), F.max("last").alias("last"))

    def totals(self) -> DataFrame:
        """(rows, bytes, first, last) of the whole table, one row."""
        return self.refresh().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
                                  F.min("first").alias("first"), F.max("last").alias("last"))

    def rows_of(self, files: list[str]) -> int:
        """Rows of some data files."""
        own = self.refresh().join(self._present(files), ["day", "file"], "left_semi") if files else None
        return 0 if own is None else own.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


class Values(Entries):
    """Every value of the filter columns, as text, with its rows, for every data file; a file's rows without value are under NULL."""

    FOLDER = "_values"
    SCHEMA = "day string, file string, name string, value string, rows long"

    def _of(self, rows: DataFrame) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in FILTER_COLUMNS if c in rows.columns]
        pairs = pairs or [F.struct(F.lit("").alias("name"), F.lit(None).cast("string").alias("value"))]  # so that the file has an entry
        own = rows.select("day", "file", F.explode(F.array(*pairs)).alias("x"))
        return own.groupBy("day", "file", "x.name", "x.value").agg(F.count("*").alias("rows"))

    def counts(self, column: str) -> DataFrame:
        """(value, rows) of one filter column over the whole table, NULL included."""
        return self.refresh().where(F.col("name") == column).groupBy("value").agg(F.sum("rows").alias("rows"))


class Filled(Entries):
    """Rows with a value of every column, for every data file."""

    FOLDER = "_filled"
    SCHEMA = "day string, file string, name string, rows long"

    def _of(self, rows: DataFrame) -> DataFrame:
        names = [c for c in rows.columns if c not in ("day", "file")]
        counts = rows.groupBy("day", "file").agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)])
        pairs = [F.struct(F.lit(c).alias("name"), F.col(f"c{i}").alias("rows")) for i, c in enumerate(names)]
        return counts.select("day", "file", F.explode(F.array(*pairs)).alias("x")).select("day", "file", "x.name", "x.rows")


def trigram_places(text: Column) -> Column:
    """Places in a signature of the three-byte sequences of a lower-cased text."""
    raw = F.lower(text).cast("binary")
    n = F.octet_length(raw)
    grams = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.pmod(F.xxhash64(F.substring(raw, i, F.lit(3))), F.lit(TRIGRAM_BITS)))
    return F.array_distinct(F.when(n > 2, grams).otherwise(F.array().cast("array<bigint>")))


class Trigrams(Entries):
    """A bitmap of the messages' trigrams for every data file, in rows of 32,768 bits."""

    FOLDER = "_trigrams"
    SCHEMA = "day string, file string, chunk int, bits binary"

    def _of(self, rows: DataFrame) -> DataFrame:
        places = rows.select("day", "file", F.explode_outer(trigram_places(F.col("message"))).alias("p"))
        chunk = F.coalesce(F.floor(F.col("p") / BITMAP_BITS).cast("int"), F.lit(-1))  # -1: so that a file without text has an entry
        bit = F.coalesce(F.pmod("p", F.lit(BITMAP_BITS)), F.lit(0).cast("long"))
        return places.groupBy("day", "file", chunk.alias("chunk")).agg(F.bitmap_construct_agg(bit).alias("bits"))

    def files_with(self, q: str) -> list[str] | None:
        """Data files whose messages may hold `q`, whatever its case; None if q is too short to say."""
        asked = self.spark.range(1).select(F.explode(trigram_places(F.lit(q))).alias("p"))
        asked = asked.select(F.floor(F.col("p") / BITMAP_BITS).cast("int").alias("chunk"), F.pmod("p", F.lit(BITMAP_BITS)).cast("int").alias("bit"))
        n = asked.count()
        if not n:
            return None
        byte = F.conv(F.hex(F.expr("substring(bits, bit div 8 + 1, 1)")), 16, 10).cast("int")
        held = self.refresh().join(F.broadcast(asked), "chunk").where(byte.bitwiseAND(F.expr("shiftleft(1, bit % 8)")) != 0)
        rows = held.groupBy("day", "file").agg(F.count("*").alias("n")).where(F.col("n") == n).select("day", "file").toLocalIterator()
        return sorted(f"{self.path}/date={r['day']}/{r['file']}" for r in rows)
