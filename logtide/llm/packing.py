"""Bounded-space online packing of tokenised documents into fixed windows.

Each partition keeps at most `open_windows` windows open.  A document goes, whole,
into the open window it fills best; when it fits none and no further window may be
opened, the fullest is topped up with the document's head and emitted, and the rest
is placed again (a cut leaves at least `min_piece` ids on either side, otherwise the
window is emitted as it is).  Documents longer than a window first fill windows of
their own.  Emitted windows are final.  What is open at the end of a partition is
merged: the pieces left by `MERGED` neighbouring partitions, a bounded number of
windows, are packed again by decreasing length, best fit, without further cuts.

The pieces, with their ids, are written once in the shared folder; the merge reads
and moves only the few that were left open.

Defined results: a null or empty text is its end id alone; repeated rows are packed
each; every id of a document lies in exactly one piece; special tokens spelled out
in a text are ordinary text; columns named like one of the result are replaced.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.llm.scratch import written

WINDOW, OPEN_WINDOWS, MIN_PIECE, MERGED = 2048, 32, 16, 8
RESULT = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")
#: Fixed value: the word pattern of byte-level BPE.
BYTE_BPE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters, of settled classes, are split alike by every regular-expression engine.
SETTLED = re.compile(r"[\t\n\r -~\xa0-ſ–—‘’“”…]*")


def _byte_alphabet() -> dict[str, int]:
    """Character in a byte-level vocabulary -> byte: printable ones stand for themselves, the rest follow U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of a tokenizer file as little-endian unsigned 32-bit bytes.

    Byte-level BPE whose merges are numbered in order is the merging of ranked byte
    strings, which tiktoken does several times faster from the same file; other
    tokenizers, and texts with other than settled characters, go to tokenizers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            self.ranked = self._ranked(json.load(f))

    @staticmethod
    def _ranked(spec: dict):
        import tiktoken

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if (model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True)
                or pre.get("add_prefix_space") or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))):
            return None
        byte, vocab = _byte_alphabet(), model["vocab"]
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        first = len(vocab) - len(made)
        if any(vocab.get(w) != first + i for i, w in enumerate(made)) or first != len(byte):
            return None
        return tiktoken.Encoding("own", pat_str=BYTE_BPE, mergeable_ranks={bytes(map(byte.__getitem__, w)): i for w, i in vocab.items()}, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.ranked is not None and SETTLED.fullmatch(text):
            ids = self.ranked.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype="<u4").tobytes()


class Packer:
    """Open windows of one partition; a window is [free, id, [piece, ...]]."""

    def __init__(self, window: int, open_windows: int, min_piece: int, next_id):
        self.window, self.most, self.min_piece, self.next_id = window, open_windows, min_piece, next_id
        self.open: list[list] = []
        self.closed: list[list] = []

    def _put(self, w: list, piece: tuple, n: int) -> None:
        w[2].append((*piece, self.window - w[0]))
        w[0] -= n
        if not w[0]:
            self._emit(w)

    def _emit(self, w: list) -> None:
        self.closed.append(w)
        if w in self.open:
            self.open.remove(w)

    def add(self, doc: int, n: int) -> None:
        start = 0
        while n - start >= self.window:
            w = [self.window, self.next_id(), []]
            self._put(w, (doc, start, self.window), self.window)
            start += self.window
        while start < n:
            rest = n - start
            fits = [w for w in self.open if w[0] >= rest]
            if fits:
                w, take = min(fits, key=lambda w: w[0]), rest
            elif len(self.open) < self.most:
                w, take = [self.window, self.next_id(), []], rest
                self.open.append(w)
            else:
                w = min(self.open, key=lambda w: w[0])
                take = min(w[0], rest - self.min_piece)
                if take < self.min_piece:
                    self._emit(w)
                    continue
            self._put(w, (doc, start, take), take)
            if w[0] and not fits and take < rest:
                self._emit(w)
            start += take


def merge_windows(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window, offset) of each piece: best fit, by decreasing length."""
    free: list[tuple[int, int]] = []  # sorted (room left, window)
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    n = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect.bisect_left(free, (lengths[i], -1))
        if at < len(free):
            room, w = free.pop(at)
        else:
            room, w, n = window, n, n + 1
        out[i] = (w, window - room)
        if room > lengths[i]:
            bisect.insort(free, (room - lengths[i], w))
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text", window: int = WINDOW,
         open_windows: int = OPEN_WINDOWS, min_piece: int = MIN_PIECE) -> DataFrame:
    """A row for each piece: `key`, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    tokenizer: path of a tokenizer file that every executor can read."""
    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        end, encoder, count = np.array([end_id], dtype="<u4").tobytes(), Encoder(tokenizer), iter(range(1 << 32))
        packer = Packer(window, open_windows, min_piece, lambda: (part << 32) + next(count))
        held: dict[int, tuple] = {}  # ids of documents with pieces not yet emitted: doc -> (key, ids)
        number = 0

        def out(windows: list[list], done: bool) -> pa.RecordBatch:
            pieces = [(held[p[0]], p, w[1]) for w in windows for p in w[2]]
            return pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h, _, _ in pieces], key_type),
                 *[pa.array(x, pa.int64()) for x in ([p[1] for _, p, _ in pieces], [p[2] for _, p, _ in pieces])],
                 pa.array([h[1][4 * p[1] : 4 * (p[1] + p[2])] for h, p, _ in pieces], pa.binary()),
                 *[pa.array(x, pa.int64()) for x in ([len(h[1]) // 4 for h, _, _ in pieces], [w for _, _, w in pieces], [p[3] for _, p, _ in pieces])],
                 pa.array([done] * len(pieces), pa.bool_()), pa.array([part] * len(pieces), pa.int64())],
                names=[key, *RESULT, "done", "part"])

        key_type = pa.null()
        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, t in zip(batch.column(0), batch.column(1)):
                ids = encoder.encode(t.as_py() or "") + end
                held[number] = (k.as_py(), ids)
                packer.add(number, len(ids) // 4)
                number += 1
                if len(packer.closed) >= 256:
                    yield out(packer.closed, True)
                    packer.closed = []
                    needed = {p[0] for w in packer.open for p in w[2]}
                    held = {d: held[d] for d in needed}
        if packer.closed:
            yield out(packer.closed, True)
        if packer.open:
            yield out(packer.open, False)

    long = lambda n: T.StructField(n, T.LongType())
    schema = T.StructType([rows.schema[0], long("start"), long("length"), T.StructField("ids", T.BinaryType()), long("doc_tokens"),
                           long("sequence_id"), long("offset"), T.StructField("done", T.BooleanType()), long("part")])
    pieces = written(rows.mapInArrow(run, schema), "packed")

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by([("old_id", "ascending"), ("old_offset", "ascending")])
        at = merge_windows(group.column("length").to_pylist(), window)
        first = (1 << 62) + (group.column("lot")[0].as_py() << 24) if group.num_rows else 0
        return pa.table({"old_id": group.column("old_id"), "old_offset": group.column("old_offset"),
                         "new_id": pa.array([first + w for w, _ in at], pa.int64()), "new_offset": pa.array([o for _, o in at], pa.int64())})

    left = pieces.where("not done")
    lots = left.select(F.floor(F.col("part") / MERGED).alias("lot"), F.col("sequence_id").alias("old_id"), F.col("offset").alias("old_offset"), "length")
    moved = lots.groupBy("lot").applyInArrow(merge, "old_id long, old_offset long, new_id long, new_offset long")
    columns = [F.col(f"`{key}`"), "start", "length", "ids", "doc_tokens"]
    again = left.join(moved, (F.col("sequence_id") == F.col("old_id")) & (F.col("offset") == F.col("old_offset"))).select(
        *columns, F.col("new_id").alias("sequence_id"), F.col("new_offset").alias("offset"))
    return pieces.where("done").select(*columns, "sequence_id", "offset").unionByName(again)
