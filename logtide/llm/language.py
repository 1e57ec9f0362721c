"""Language identification by prediction by partial matching (PPM).

Each language owns a tree of byte contexts of up to `order` bytes.  In a context,
a byte seen there c times out of n has probability c / (n + d), d being the
number of distinct bytes seen; what is left, d / (n + d), is the escape to the
context that is one byte shorter, where bytes already predicted are excluded.
Below the empty context all 256 values are equally likely.  A NUL begins a text anew.  The statistics are
frozen after training, so the code length of a byte depends on nothing but its
context: it is tabulated once, and a text costs one table row per byte.

Counts are taken by Spark over every training text, and every gram reaches the model.
The table's size is bounded by `MAX_CELLS` (contexts x bytes x languages): the most
frequent contexts have a row there.  All others are kept sparse, language by language:
a code length for each gram seen, and what the escape from each context adds; the
code lengths are the same either way.

Defined results: a null text, or one without a letter, is `und` with score 0;
with no learned language everything is `und`; equal code lengths go to the first
language in code-point order; repeated rows are judged alike; a column of the
input that is named like one of the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.llm.scratch import written
from logtide.llm.textops import blocks, texts_of

UNKNOWN = "und"
ORDER = 3
MAX_CELLS = 12_000_000
RESULT = ("lang_pred", "score", "bits_per_byte")


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of some numbers in an ascending array."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class LanguageModel:
    """Frozen code lengths: bits[context, symbol, language], and how to find a context."""

    languages: list[str]
    symbol: np.ndarray  # byte -> symbol; 0: a byte never seen in training, 1: NUL, which also stands before a text
    context: np.ndarray  # the last ORDER symbols as one number -> row of bits
    bits: np.ndarray
    order: int
    # of each order with contexts outside the table, ascending: (order, contexts in the table, their rows,
    # rows of the order below, by language (grams, code lengths, contexts, code lengths of the escape))
    sparse: list[tuple] = field(default_factory=list)

    def rest(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Code lengths (a column a language) of symbols whose contexts may be outside the table."""
        size, n_lang = self.bits.shape[1:]
        out, todo = np.zeros((len(context), n_lang)), np.ones((len(context), n_lang), dtype=bool)
        for k, kept, rows, _, by_language in reversed(self.sparse):
            own = context % size**k
            at, inside = _find(kept, own)
            inside = np.flatnonzero(inside)
            out[inside] += np.where(todo[inside], self.bits[rows[at[inside]], symbol[inside]], 0)
            todo[inside] = False
            for lang, (grams, bits, contexts, escape) in enumerate(by_language):
                i = np.flatnonzero(todo[:, lang])
                at, ok = _find(grams, own[i] * size + symbol[i])
                out[i[ok], lang] += bits[at[ok]]
                todo[i[ok], lang] = False
                i = i[~ok]
                at, ok = _find(contexts, own[i])
                out[i[ok], lang] += escape[at[ok]]
        k, below = (self.sparse[0][0], self.sparse[0][3]) if self.sparse else (self.order + 1, self.context)
        return out + np.where(todo, self.bits[below[context % size ** (k - 1)], symbol], 0)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (rows) under each language (columns)."""
        out = np.zeros((len(texts), len(self.languages)))
        size = len(self.symbol_values)
        for a, b in blocks(texts):
            # `order` NULs before each text: no context reaches into its neighbour
            pad = b"\x00" * self.order
            raw = np.frombuffer(pad + pad.join(texts[a:b]), dtype=np.uint8)
            sizes = np.fromiter((len(t) for t in texts[a:b]), dtype=np.int64, count=b - a)
            first = np.cumsum(np.concatenate([[0], sizes[:-1] + self.order])) + self.order
            sym = self.symbol[raw]
            code = np.zeros(max(0, len(sym) - self.order), dtype=np.int64)
            for k in range(self.order):
                code = code * size + sym[k : k + len(code)]
            for i in range(0, len(code), 1 << 19):  # bounded rows of float64 at a time
                ctx = code[i : i + (1 << 19)]
                goal = sym[self.order + i :][: len(ctx)]
                rows = self.bits[self.context[ctx], goal]
                if self.sparse:
                    out_of = np.flatnonzero(~_find(self.sparse[-1][1], ctx)[1])
                    grams, place = np.unique(ctx[out_of] * size + goal[out_of], return_inverse=True)
                    rows[out_of] = self.rest(grams // size, grams % size)[place]
                at = np.arange(i, i + len(rows))
                text = np.searchsorted(first - self.order, at, side="right") - 1
                inside = at < (first - self.order + sizes)[text]
                for lang in range(rows.shape[1]):
                    out[a:b, lang] += np.bincount(text[inside], rows[inside, lang], minlength=b - a)
        return out

    @property
    def symbol_values(self) -> range:
        return range(int(self.symbol.max()) + 1)


def _count_grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[np.ndarray]] = {}

        def fold(parts: list[np.ndarray]) -> list[np.ndarray]:
            keys, counts = np.concatenate(parts[0::2]), np.concatenate(parts[1::2])
            keys, place = np.unique(keys, return_inverse=True)
            return [keys, np.bincount(place, counts, len(keys)).astype(np.int64)]

        for batch in batches:
            texts, langs = texts_of(batch.column(0)), batch.column(1).to_pylist()
            by: dict[str, list[bytes]] = {}
            for t, lang in zip(texts, langs):
                by.setdefault(lang, []).append(t)
            for lang, own in by.items():
                for a, b in blocks(own):
                    pad = b"\x00" * order
                    raw = np.frombuffer(pad + pad.join(own[a:b]), dtype=np.uint8).astype(np.int64)
                    code = raw[order:].copy()
                    starts = raw[order:] == 0
                    for k in range(1, order + 2):  # grams of k bytes: a context of k - 1 and its byte
                        if k > 1:
                            code = code + (raw[order - k + 1 : len(raw) - k + 1] << (8 * (k - 1)))
                        keys, counts = np.unique(code[~starts], return_counts=True)
                        total.setdefault(lang, []).extend([keys + (k << 40), counts])
                if len(total.get(lang, ())) > 64:
                    total[lang] = fold(total[lang])
        for lang, parts in total.items():
            keys, counts = fold(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())],
                names=["lang", "gram", "n"],
            )

    return run


def train(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, max_cells: int = MAX_CELLS) -> LanguageModel:
    """Context trees of every language of `docs`, from all its texts.

    Rows whose text or language is null teach nothing.  Spark sums the counts of
    grams; the driver gets them all, a row for each language and gram of up to order + 1 bytes."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counts = written(rows.mapInArrow(_count_grams(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    names = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    places = docs.sparkSession.createDataFrame(list(enumerate(names)), "place int, lang string")
    grams = counts.join(F.broadcast(places), "lang").select("place", "gram", "n").toArrow()
    return _tabulate(names, grams.column("place").to_numpy(), grams.column("gram").to_numpy(), grams.column("n").to_numpy(), order, max_cells)


def _tabulate(names: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int, max_cells: int) -> LanguageModel:
    """lang: place in `names` of each gram's language."""
    languages = sorted(names)
    which = np.array([languages.index(x) for x in names] or [0])[lang]
    length, code = gram >> 40, gram & ((1 << 40) - 1)
    seen = np.setdiff1d(code[length == 1], [0])
    symbol = np.zeros(256, dtype=np.int64)
    symbol[0], symbol[seen] = 1, np.arange(2, len(seen) + 2)
    size, n_lang = len(seen) + 2, max(1, len(languages))
    unseen = 255 - len(seen)  # byte values that symbol 0 stands for
    # every gram as base-`size` number
    key = np.zeros(len(code), dtype=np.int64)
    for k in reversed(range(order + 1)):
        key = key * size + np.where(length > k, symbol[(code >> (8 * k)) & 255], 0)

    # contexts by order: the empty one, then the most frequent of each length that fit
    room = max(1, max_cells // (size * n_lang))
    kept: list[np.ndarray] = [np.zeros(1, dtype=np.int64)]
    for k in range(1, order + 1):
        own = length == k + 1
        ctx, place = np.unique(key[own] // size, return_inverse=True)
        weight = np.bincount(place, n[own], len(ctx))
        best = np.argsort(-weight, kind="stable")[: max(0, room - sum(map(len, kept)))]
        kept.append(np.sort(ctx[best]))

    p = np.empty((sum(map(len, kept)), size, n_lang), dtype=np.float32)
    row_of = [np.zeros(1, dtype=np.int64)]  # by order: last k symbols -> row
    base = 0
    for k in range(order + 1):
        rows = base + np.arange(len(kept[k]))
        if k == 0:
            p[0] = 1 / 256  # order -1, spread over the symbols: symbol 0 stands for all unseen bytes
            p[0, 0] = unseen / 256
        else:
            p[rows] = p[row_of[k - 1][kept[k] % size ** (k - 1)]]
            full = np.tile(row_of[k - 1], size)
            full[kept[k]] = rows
            row_of.append(full)
        for lang_at in range(len(languages) if len(rows) else 0):
            own = (length == k + 1) & (which == lang_at)
            at = np.searchsorted(kept[k], key[own] // size)
            ok = (at < len(kept[k])) & (kept[k][np.minimum(at, len(kept[k]) - 1)] == key[own] // size)
            counts = np.zeros((len(rows), size))
            counts[at[ok], (key[own] % size)[ok]] = n[own][ok]
            total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
            lower = np.where(counts > 0, 0, p[rows, :, lang_at].astype(np.float64))
            left = lower.sum(1, keepdims=True)
            # where nothing is left to escape to, no mass goes there
            escape = np.where(left > 0, distinct / np.maximum(1, total + distinct), 0.0)
            new = np.where(counts > 0, counts / np.maximum(1, total + np.where(left > 0, distinct, 0)), escape * lower / np.where(left > 0, left, 1))
            p[rows, :, lang_at] = np.where(total > 0, new, p[rows, :, lang_at])
        base += len(rows)
    p[:, 0] /= max(1, unseen)  # of one unseen byte value
    np.maximum(p, 1e-30, out=p)
    np.log2(p, out=p)
    model = LanguageModel(languages, symbol, row_of[order], np.negative(p, out=p), order)
    base = 1
    for k in range(1, order + 1):
        own = np.flatnonzero(length == k + 1)
        own = own[~_find(kept[k], key[own] // size)[1]]
        by_language = [_sparse(model, row_of[k - 1], which[own] == at, at, k, key[own], n[own]) for at in range(len(languages))]
        # in the list from the first order with such contexts on: later ones build upon it
        if len(own) or model.sparse:
            model.sparse.append((k, kept[k], base + np.arange(len(kept[k])), row_of[k - 1] if not model.sparse else None, by_language))
        base += len(kept[k])
    return model


def _sparse(model: LanguageModel, below: np.ndarray, mine: np.ndarray, lang: int, k: int, key: np.ndarray, n: np.ndarray) -> tuple:
    """(grams, code lengths, contexts, code lengths of the escape) of a language's contexts of k bytes outside the table."""
    size = model.bits.shape[1]
    order = np.argsort(key[mine], kind="stable")
    grams, n = key[mine][order], n[mine][order].astype(np.float64)
    contexts, place = np.unique(grams // size, return_inverse=True)
    lower = np.empty(len(grams))
    shorter = model if model.sparse else LanguageModel(model.languages, model.symbol, below, model.bits, k - 1)
    for a in range(0, len(grams), 1 << 18):
        some = grams[a : a + (1 << 18)]
        lower[a : a + len(some)] = np.exp2(-shorter.rest(some // size % size ** (k - 1), some % size)[:, lang])
    total, distinct = np.bincount(place, n, len(contexts)), np.bincount(place, minlength=len(contexts))
    # where nothing is left to escape to, no mass goes there
    left = 1 - np.bincount(place, lower, len(contexts))
    some = distinct < 256
    left = np.where(some, np.maximum(left, 1e-12), 1)
    bits = -np.log2(n / (total + np.where(some, distinct, 0))[place])
    return grams, bits.astype(np.float32), contexts, np.where(some, -np.log2(distinct / (total + distinct) / left), 100).astype(np.float32)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (its columns `keep`, by default all) with lang_pred, score and bits_per_byte.

    score is the posterior of the chosen language under equal priors, from the
    code lengths; bits_per_byte is the mean code length under it (null if `und`)."""
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    own = "__text", "__letter"
    rows = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(own[0]),
        F.coalesce(F.col(f"`{text}`").rlike("\\p{L}"), F.lit(False)).alias(own[1]),
    )
    shared = spark.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LanguageModel(**shared.value)
        for batch in batches:
            n = batch.num_rows
            letter = batch.column(len(keep) + 1).to_numpy(zero_copy_only=False)
            if not m.languages:
                letter = np.zeros(n, dtype=bool)
            texts = [t if ok else b"" for t, ok in zip(texts_of(batch.column(len(keep))), letter)]
            bits = m.code_lengths(texts) if m.languages else np.zeros((n, 1))
            best = bits.argmin(1)
            low = bits.min(1)
            score = np.where(letter, 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1), 0.0)
            sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)],
                 pa.array([m.languages[i] if ok else UNKNOWN for i, ok in zip(best, letter)], pa.string()),
                 pa.array(score, pa.float64()),
                 pa.array(low / np.maximum(1, sizes), pa.float64(), mask=~letter)],
                names=[*keep, *RESULT],
            )

    fields = [f for f in rows.schema.fields if f.name in keep]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("bits_per_byte", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def crc_fold(doc_id: str, mod: int):
    """crc32 of doc_id as text, modulo `mod`; a null id counts as empty text (remainder 0)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod
