"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

A word's probability is that of its class, times that of its group in the class, times
that of the word in its group.  The most frequent words are classes of their own; the
others share classes by their last letters, which tell languages and word forms apart.
Groups are up to `GROUP` of the `HEAD` most frequent words of a class, by frequency; all
rarer words of a class are one more item, the rest.  Each class, group and item has an
output vector and a bias.  The two words before give the context: a class vector, plus
one of its own for each word of the head, each through its own matrix, add up to a vector
whose products with the output vectors, and biases, are the logits; scores are normalised
over all classes, the groups of the class, and the items of the group.  Inside the rest,
words have their frequency plus one, and one more share is kept for unknown words.

Spark counts all training words.  Each round takes its share of the training texts, all
rounds together take each text once: tasks train on all tokens they read in numpy (NCE
against the frequencies, a noise sample a batch for classes, siblings of each goal below them, Adagrad), and Spark averages
the parameters, by the tasks' token counts, or a word's by its occurrences.  Scoring is
one pass over the texts by matrix products.  Words beyond the head, which travels with
the model, meet their counts in a join.

Defined results: a null text is the end token alone; repeated rows are scored alike; with
no training text the scores are 0; a null id belongs to the training part (its checksum
is that of empty text); columns named like one of the result are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.bounded import most_frequent
from logtide.llm.scratch import written
from logtide.llm.textops import blocks, slices, texts_of

OWN_CLASSES, SHARED_CLASSES, HEAD, GROUP = 128, 128, 1 << 17, 32
DIM, NOISE, BATCH, EPOCHS, LEAST_STEPS, ROUNDS, RATE, FREQUENCY = 24, 64, 2048, 1, 100, 3, 0.3, 0.1
SIBLINGS, ROW_RATE, BUFFER, SLICE, SCORED = 4, 0.1, 1 << 20, 4096, 1024
END = b""
FLUSH = 200_000
RESULT = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
LN10 = float(np.log(10))


def tokens(text: bytes) -> list[bytes]:
    """Words, A-Z in lower case, then the end."""
    out = text.lower().split()
    out.append(END)
    return out


def shared_class(word: bytes) -> int:
    return OWN_CLASSES + zlib.crc32(word[-3:]) % SHARED_CLASSES


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array([shared_class(w) for w in words], pa.int32()), pa.array(counts.values(), pa.int64())],
            names=["word", "class", "n"])

    for batch in batches:
        for text in texts_of(batch.column(0)):
            counts.update(tokens(text))
            if len(counts) > FLUSH:
                yield out()
                counts.clear()
    if counts:
        yield out()


@dataclass
class Vocabulary:
    """What a task needs to read words: the head of the word list, class by class sizes."""

    head: dict[bytes, int]  # word -> place in the arrays below
    head_class: np.ndarray
    head_count: np.ndarray
    class_total: np.ndarray  # tokens of each class
    class_words: np.ndarray  # distinct words of each class
    total: int
    distinct: int

    def classes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(class, place in the head or -1) of some tokens."""
        at = np.fromiter(map(self.head.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        cls = self.head_class[at] if len(self.head_class) else np.zeros(len(words), dtype=np.int64)
        rest = np.flatnonzero(at < 0)
        cls[rest] = [shared_class(words[i]) for i in rest]
        return cls, at


def vocabulary(training: DataFrame, text: str = "text", head: int = HEAD) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary and the table of all counts (word, class, n)."""
    rows = training.select(F.col(f"`{text}`").cast("string").alias("text"))
    counts = written(rows.mapInArrow(_count_words, "word binary, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n")), "words")
    top = most_frequent(counts, "n", head, "word").toArrow()  # bounded by `head`
    words, n = top.column("word").to_pylist(), top.column("n").to_numpy().copy()
    cls = top.column("class").to_numpy().astype(np.int64)
    cls[:OWN_CLASSES] = np.arange(min(OWN_CLASSES, len(cls)))
    n_classes = OWN_CLASSES + SHARED_CLASSES
    total, size = np.zeros(n_classes, dtype=np.int64), np.zeros(n_classes, dtype=np.int64)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # a row a class
        total[r["class"]], size[r["class"]] = r["n"], r["v"]
    for i, w in enumerate(words[:OWN_CLASSES]):  # moved into classes of their own
        c = shared_class(w)
        total[c], size[c], total[i], size[i] = total[c] - n[i], size[c] - 1, n[i], 1
    return Vocabulary({w: i for i, w in enumerate(words)}, cls, n, total, size, int(total.sum()), int(size.sum())), counts


class Tree:
    """Items (words of the head, and the rest of each shared class) by class and group.

    An item's number is its place in that order, so groups and classes are ranges."""

    def __init__(self, vocab: Vocabulary):
        n, head = len(vocab.class_total), len(vocab.head_class)
        self.rest_tokens = vocab.class_total - np.bincount(vocab.head_class, vocab.head_count, n).astype(np.int64)
        self.rest_words = vocab.class_words - np.bincount(vocab.head_class, minlength=n)
        cls = np.concatenate([vocab.head_class, np.arange(OWN_CLASSES, n)])
        weight = np.concatenate([vocab.head_count, self.rest_tokens[OWN_CLASSES:] + 1]) + 0.5
        order = np.lexsort((-weight, cls))
        place = np.empty(len(cls), dtype=np.int64)
        place[order] = np.arange(len(cls))
        self.of_head, self.of_rest = place[:head], np.concatenate([np.zeros(OWN_CLASSES, dtype=np.int64), place[head:]])
        self.item_class, self.item_weight = cls[order], weight[order]
        nth = np.arange(len(cls)) - np.searchsorted(self.item_class, self.item_class)
        self.item_group = np.cumsum(nth % GROUP == 0) - 1
        first = np.flatnonzero(nth % GROUP == 0)
        self.group_first = np.append(first, len(cls))
        self.group_class = self.item_class[first]
        self.group_weight = np.add.reduceat(self.item_weight, first)
        self.class_first = np.searchsorted(self.group_class, np.arange(n + 1))
        self.end = int(self.of_head[vocab.head[END]]) if END in vocab.head else 0

    def items(self, cls: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, np.append(self.of_head, 0)[at], self.of_rest[cls]).astype(np.int32)


def _contexts(item: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(two before, one before) of every token; before a text there are ends."""
    one, two = np.empty_like(item), np.empty_like(item)
    one[1:], two[2:] = item[:-1], item[:-2]
    one[first] = end
    two[first] = end
    two[np.minimum(first + 1, len(item) - 1)] = end
    return two, one


def _read(texts: list[bytes], vocab: Vocabulary) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(words, class, head place, first token of each text) of a block."""
    words: list[bytes] = []
    first = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        first[i] = len(words)
        words += tokens(t)
    return words, *vocab.classes(words), first


@dataclass
class Parameters:
    vectors: np.ndarray  # of the classes as context
    before: np.ndarray  # matrix of the class before
    two_before: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in vars(self).values()]).astype(np.float64)

    def like(self, flat: np.ndarray) -> Parameters:
        ends = np.cumsum([x.size for x in vars(self).values()])
        return Parameters(*[p.reshape(x.shape).astype(np.float32) for p, x in zip(np.split(flat, ends[:-1]), vars(self).values())])

    def log_probabilities(self, two: np.ndarray, one: np.ndarray, frequency: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of all classes after the given contexts.

        A tenth (FREQUENCY) comes from the classes' frequencies: a context unlike all
        training text can't cost more than that."""
        q = self.vectors[one] @ self.before + self.vectors[two] @ self.two_before
        s = q @ self.outputs.T + self.bias
        top = s.max(1, keepdims=True)
        e = np.exp(s - top)
        return np.log((1 - FREQUENCY) * e / e.sum(1, keepdims=True) + FREQUENCY * frequency.astype(np.float32))


def frequencies(class_total: np.ndarray) -> np.ndarray:
    return (class_total + 0.5) / (class_total + 0.5).sum()


def start(class_total: np.ndarray, seed: int = 5) -> Parameters:
    """Small random vectors; the biases are the classes' frequencies, so the model begins as these."""
    rng, n = np.random.default_rng(seed), len(class_total)
    p = frequencies(class_total)
    made = 0.1 * rng.standard_normal((n, DIM)), np.eye(DIM), 0.5 * np.eye(DIM), 0.1 * rng.standard_normal((n, DIM)), np.log(p)
    return Parameters(*[x.astype(np.float32) for x in made])


@dataclass
class Items:
    """Vectors of items as context, beside that of their class, and output vectors (bias last) of items and groups."""

    own: np.ndarray
    words: np.ndarray
    groups: np.ndarray


def start_items(tree: Tree) -> Items:
    """All zero but the biases, which are frequencies: the model begins as that of classes."""
    out = []
    for weight, parent, first in ((tree.item_weight, tree.item_group, tree.group_first), (tree.group_weight, tree.group_class, tree.class_first)):
        table = np.zeros((len(weight), DIM + 1), dtype=np.float32)
        table[:, DIM] = np.log(weight / np.add.reduceat(weight, first[:-1])[parent])
        out.append(table)
    return Items(np.zeros((len(tree.item_weight), DIM), dtype=np.float32), *out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Of an array that may be overwritten."""
    np.clip(x, -30, 30, out=x)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.divide(1, x, out=x)


def _sums(rows: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of the vectors x that fall on each of n rows."""
    d = x.shape[1]
    return np.bincount((rows[:, None] * d + np.arange(d)).ravel(), x.ravel(), n * d).reshape(n, d).astype(np.float32)


class Trainer:
    """Noise-contrastive training of (copies of) the parameters, batch by batch."""

    def __init__(self, p: Parameters, class_total: np.ndarray, seed: int, items: Items | None = None, tree: Tree | None = None, sums: list[np.ndarray] | None = None):
        self.rng, self.n = np.random.default_rng(seed), len(class_total)
        self.p = Parameters(*[x.copy() for x in vars(p).values()])
        self.seen = [np.full_like(x, 1e-2) for x in vars(p).values()]
        self.noise = frequencies(class_total)
        self.upto, self.log_noise = np.cumsum(self.noise), np.log(self.noise).astype(np.float32)
        self.tree, self.items = tree, None if items is None else Items(*[x.copy() for x in vars(items).values()])
        if tree is not None:
            self.sums = [x.copy() for x in sums] if sums else [np.ones(len(x), dtype=np.float32) for x in vars(items).values()]
            self.times = [np.zeros(len(x), dtype=np.float32) for x in vars(items).values()]  # occurrences of each row
            self.place = np.zeros(max(len(x) for x in self.sums), dtype=np.int64)
            self.levels = []  # by level: share of the parent, bounds of siblings
            for weight, parent, first in ((tree.item_weight, tree.item_group, tree.group_first), (tree.group_weight, tree.group_class, tree.class_first)):
                share = weight / np.add.reduceat(weight, first[:-1])[parent]
                self.levels.append((np.log(share * SIBLINGS).astype(np.float32), np.append(0, np.cumsum(weight)), first[parent], first[parent + 1]))

    def _add(self, which: int, rows: np.ndarray, gradient: np.ndarray) -> None:
        """An Adagrad step of some rows, which may repeat."""
        at = np.sort(rows)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        self.place[at] = np.arange(len(at))
        g = _sums(self.place.take(rows), gradient, len(at))
        s = self.sums[which]
        now = s.take(at) + np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
        s[at] = now
        g *= (np.float32(ROW_RATE) / np.sqrt(now))[:, None]
        table = list(vars(self.items).values())[which]
        table[at] = table.take(at, axis=0) + g

    def _siblings(self, which: int, own: np.ndarray) -> np.ndarray:
        """Noise for each goal: its siblings, by frequency."""
        _, upto, lo, hi = self.levels[which - 1]
        lo, hi = lo.take(own)[:, None], hi.take(own)[:, None]
        low, high = upto.take(lo), upto.take(hi)
        bad = np.searchsorted(upto, low + self.rng.random((len(own), SIBLINGS)) * (high - low), side="right") - 1
        return np.clip(bad, lo, hi - 1)

    def step(self, two: np.ndarray, one: np.ndarray, goal: np.ndarray) -> None:
        """One batch: classes, or items if there is a tree."""
        p, n, k, size = self.p, self.n, NOISE, len(goal)
        rows, item = (two, one), goal
        if self.tree is not None:
            two, one, goal = (self.tree.item_class.take(x) for x in (two, one, goal))
        r1, r2 = p.vectors.take(one, axis=0), p.vectors.take(two, axis=0)
        if self.tree is not None:
            r1 += self.items.own.take(rows[1], axis=0)
            r2 += self.items.own.take(rows[0], axis=0)
        q = r1 @ p.before
        q += r2 @ p.two_before
        false = np.minimum(np.searchsorted(self.upto, self.rng.random(k), side="right"), n - 1)
        log_noise = self.log_noise + np.float32(np.log(k))
        wanted = p.outputs.take(goal, axis=0)
        up = 1 - _sigmoid(np.einsum("ij,ij->i", q, wanted) + (p.bias - log_noise).take(goal))  # wanted higher
        down = q @ p.outputs[false].T
        down += p.bias[false] - log_noise[false]
        down = _sigmoid(down)  # wanted lower
        dq = up[:, None] * wanted
        dq -= down @ p.outputs[false]
        out = _sums(goal, up[:, None] * q, n) - _sums(false, down.T @ q, n)
        bias = (np.bincount(goal, up, n) - np.bincount(false, down.sum(0), n)).astype(np.float32)
        if self.tree is not None:
            some = np.flatnonzero(goal >= OWN_CLASSES)
            if len(some):
                q1 = np.ones((len(some), DIM + 1), dtype=np.float32)
                q1[:, :DIM] = q.take(some, axis=0)
                own_item = item.take(some)
                for which, own in zip((1, 2), (own_item, self.tree.item_group.take(own_item))):
                    table, (log_q, _, lo, hi) = self.items.words if which == 1 else self.items.groups, self.levels[which - 1]
                    drawn = np.concatenate([own[:, None], self._siblings(which, own)], axis=1)
                    rows_of = table.take(drawn, axis=0)
                    pull = _sigmoid(np.einsum("ijk,ik->ij", rows_of, q1) - log_q.take(drawn))
                    np.negative(pull, out=pull)
                    pull[:, 0] += 1
                    pull[hi.take(own) - lo.take(own) < 2] = 0  # an only child
                    dq[some] += np.einsum("ij,ijk->ik", pull, rows_of)[:, :DIM]
                    np.multiply(pull[:, :, None], q1[:, None, :], out=rows_of)
                    self._add(which, drawn.ravel(), rows_of.reshape(-1, DIM + 1))
        d = np.concatenate([dq @ p.before.T, dq @ p.two_before.T])
        if self.tree is not None:
            self._add(0, np.concatenate([rows[1], rows[0]]), d)
        vec = _sums(np.concatenate([one, two]), d, n)
        for x, g, s in zip(vars(p).values(), (vec, r1.T @ dq, r2.T @ dq, out, bias), self.seen):
            g = g / size
            s += g * g
            x += RATE * g / np.sqrt(s)

    def _count(self, two: np.ndarray, one: np.ndarray, goal: np.ndarray) -> None:
        """Occurrences of the rows that some tokens have trained: contexts, items, and their groups."""
        goal = goal[self.tree.item_class[goal] >= OWN_CLASSES]
        for times, rows in zip(self.times, ((two, one), (goal,), (self.tree.item_group[goal],))):
            for x in rows:
                times += np.bincount(x, minlength=len(times))

    def learn(self, two: np.ndarray, one: np.ndarray, goal: np.ndarray, least: int = 0) -> None:
        """EPOCHS times all tokens in random order, and `least` batches at least."""
        n, done = len(goal), 0
        while done < EPOCHS * n or done < least * BATCH:
            order = self.rng.permutation(n)
            if n < BATCH:
                order = np.concatenate([order, self.rng.integers(0, n, BATCH - n)])
            for a in range(0, len(order), BATCH):
                at = order[a : a + BATCH]
                self.step(two[at], one[at], goal[at])
                if (done := done + len(at)) >= max(EPOCHS * n, least * BATCH):
                    break
            if self.tree is not None:
                used = order[: a + BATCH]
                self._count(two[used], one[used], goal[used])


def nce(p: Parameters, triple: np.ndarray, count: np.ndarray, class_total: np.ndarray, seed: int) -> Parameters:
    """The class part alone, trained on all tokens of counted class triples, LEAST_STEPS batches at least."""
    n = len(class_total)
    t = np.repeat(triple, count)
    trainer = Trainer(p, class_total, seed)
    trainer.learn(t // (n * n), t // n % n, t % n, LEAST_STEPS)
    return trainer.p


def _train(shared, now, seed: int):
    """Sums of the parameters of a task, times what it has seen of them: slice 0 of table -1 is the classes' part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocab = Vocabulary(**shared.value)
        tree = Tree(vocab)
        flat, tables, sums = now.value
        trainer = Trainer(start(vocab.class_total).like(flat), vocab.class_total, seed * 1_000_003 + TaskContext.get().partitionId(), Items(*tables), tree, sums)
        held, waiting, seen = [], 0, 0
        for batch in slices(batches):
            texts = texts_of(batch.column(0))
            for a, b in blocks(texts):
                _, cls, at, first = _read(texts[a:b], vocab)
                item = tree.items(cls, at)
                held.append((*_contexts(item, first, tree.end), item))
                waiting += len(item)
                if waiting >= BUFFER:
                    trainer.learn(*[np.concatenate(x) for x in zip(*held)])
                    held, waiting, seen = [], 0, seen + waiting
        if waiting:
            trainer.learn(*[np.concatenate(x) for x in zip(*held)], 0 if seen else LEAST_STEPS)
            seen += waiting
        if not seen:
            return
        names = ["which", "slice", "x", "w"]
        row = lambda which, i, x, w: pa.RecordBatch.from_pydict(
            {"which": pa.array([which], pa.int32()), "slice": pa.array([i], pa.int32()), "x": pa.array([x.astype("<f4").tobytes()], pa.binary()), "w": pa.array([w.astype("<f4").tobytes()], pa.binary())})
        flat = trainer.p.flat()
        yield row(-1, 0, flat * seen, np.full(1, seen)).select(names)
        for which, (table, times, s) in enumerate(zip(vars(trainer.items).values(), trainer.times, trainer.sums)):
            table = np.concatenate([table, s[:, None]], axis=1)
            for i in range(0, len(table), SLICE):
                w = times[i : i + SLICE]
                if w.any():
                    yield row(which, i // SLICE, table[i : i + SLICE] * w[:, None], w).select(names)

    return run


def _summed(group: pa.Table) -> pa.Table:
    total = lambda c: sum(np.frombuffer(x.as_py(), dtype="<f4").astype(np.float64) for x in group.column(c))
    return pa.table({"which": group.column("which").slice(0, 1), "slice": group.column("slice").slice(0, 1),
                     "x": pa.array([total("x").astype("<f4").tobytes()], pa.binary()), "w": pa.array([total("w").astype("<f4").tobytes()], pa.binary())})


def train(training: DataFrame, vocab: Vocabulary, text: str = "text", rounds: int = ROUNDS) -> tuple[Parameters, Items]:
    """Parameters from all tokens of the training texts."""
    spark = training.sparkSession
    shared = spark.sparkContext.broadcast(vars(vocab))
    rows = training.select(F.col(f"`{text}`").cast("string").alias("text"))
    p, items = start(vocab.class_total), start_items(Tree(vocab))
    sums = [np.ones(len(x), dtype=np.float32) for x in vars(items).values()]  # Adagrad's, of each row
    if not vocab.total:
        return p, items
    for r in range(rounds):
        now = spark.sparkContext.broadcast((p.flat(), list(vars(items).values()), sums))
        # as many models as tasks run at a time: each has the whole head
        some = rows.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r).coalesce(spark.sparkContext.defaultParallelism)
        parts = some.mapInArrow(_train(shared, now, r), "which int, slice int, x binary, w binary").groupBy("which", "slice")
        for s in parts.applyInArrow(_summed, "which int, slice int, x binary, w binary").toArrow().to_pylist():  # the size of the model
            x, w = np.frombuffer(s["x"], dtype="<f4"), np.frombuffer(s["w"], dtype="<f4")
            if s["which"] < 0:
                p = p.like(x / w[0])
            else:
                at, seen = slice(s["slice"] * SLICE, s["slice"] * SLICE + len(w)), w > 0
                mean = x.reshape(len(w), -1)[seen] / w[seen, None]
                list(vars(items).values())[s["which"]][at][seen] = mean[:, :-1]
                sums[s["which"]][at][seen] = mean[:, -1]
        now.unpersist()
    shared.unpersist()
    return p, items


def _exp(s: np.ndarray) -> np.ndarray:
    """Its exponentials, in place; of logits that may leave the range of floats, divided by the greatest of their row."""
    if s.size and max(s.max(), -s.min()) > 60:
        s -= s.max(1, keepdims=True)
    return np.exp(s, out=s)


def _among(q: np.ndarray, own: np.ndarray, goal: np.ndarray, parent: np.ndarray, first: np.ndarray, table: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of nodes, after the context q[own], among those of the same parent, which are ranges that begin at `first`."""
    of = parent.take(goal)
    order = np.argsort(of.astype(np.uint16) if len(first) <= 1 << 16 else of, kind="stable")
    goal, of, own = goal[order], of[order], own[order]
    share = np.ones(len(goal), dtype=np.float32)
    cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, dtype=np.int64)
    ends, nth, every = np.append(cuts[1:], len(of)), goal - first.take(of), np.arange(np.diff(np.append(cuts, len(of))).max(initial=0))
    for a, b, lo, hi in zip(cuts.tolist(), ends.tolist(), first.take(of[cuts]).tolist(), first.take(of[cuts] + 1).tolist()):
        if hi - lo < 2:
            continue
        s = _exp(q.take(own[a:b], axis=0) @ table[lo:hi].T)
        share[a:b] = s[every[: b - a], nth[a:b]] / s.sum(1)
    among = np.add.reduceat(weight, first[:-1]).take(of)
    out = np.zeros(len(goal))
    out[order] = np.log((1 - FREQUENCY) * share + FREQUENCY * weight.take(goal) / among)
    return out


def log_probabilities(p: Parameters, items: Items, tree: Tree, two: np.ndarray, one: np.ndarray, goal: np.ndarray, frequency: np.ndarray, mapped=None) -> np.ndarray:
    """Natural log-probability of each item after its context: class, group in it, item in that.

    Each triple is computed once, and the classes' logits once for each context."""
    first, second = mapped or mapped_contexts(p, items, tree)
    n = len(tree.item_class)
    triple, back = np.unique((two.astype(np.int64) * n + one) * n + goal, return_inverse=True)
    context, goal = np.divmod(triple, n)
    new = np.concatenate([[True], context[1:] != context[:-1]]) if len(context) else np.zeros(0, dtype=bool)
    own, (two, one) = np.cumsum(new) - 1, np.divmod(context[new], n)
    q = np.ones((len(one), DIM + 1), dtype=np.float32)
    q[:, :DIM] = first.take(one, axis=0)
    q[:, :DIM] += second.take(two, axis=0)
    outputs, cls = np.concatenate([p.outputs, p.bias[:, None]], axis=1).T, tree.item_class.take(goal)
    out = np.empty(len(goal))
    for a in range(0, len(q), 4096):
        s = _exp(q[a : a + 4096] @ outputs)
        lo, hi = np.searchsorted(own, (a, a + 4096))
        at, c = own[lo:hi] - a, cls[lo:hi]
        out[lo:hi] = np.log((1 - FREQUENCY) * s[at, c] / s.sum(1)[at] + FREQUENCY * frequency[c])
    some = np.flatnonzero(cls >= OWN_CLASSES)
    own, goal = own[some], goal[some]
    out[some] += _among(q, own, tree.item_group[goal], tree.group_class, tree.class_first, items.groups, tree.group_weight)
    out[some] += _among(q, own, goal, tree.item_group, tree.group_first, items.words, tree.item_weight)
    return out[back]


def mapped_contexts(p: Parameters, items: Items, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """What each item adds to the context vector, as the word before and as the one before that."""
    v = p.vectors[tree.item_class] + items.own
    return v @ p.before, v @ p.two_before


def _score(shared, model):
    """Per row what the task knows (word null), and the words it must look up (tf of each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocab = Vocabulary(**shared.value)
        flat, mapped, words_out, groups_out = model.value
        p, items, tree = start(vocab.class_total).like(flat), Items(np.zeros((0, DIM), dtype=np.float32), words_out, groups_out), Tree(vocab)
        frequency = frequencies(vocab.class_total)
        number = TaskContext.get().partitionId() << 33
        # of a word inside the rest of its class: (count + 1) / (tokens + words + 1)
        inside = np.log10(tree.rest_tokens + tree.rest_words + 1.0)
        gain = np.log10(np.append(vocab.head_count, 0) + 1.0)  # the last one for words outside the head
        for batch in slices(batches, SCORED):
            texts = texts_of(batch.column(1))
            for a, b in blocks(texts, 1 << 20):
                words, cls, at, first = _read(texts[a:b], vocab)
                sizes = np.diff(np.append(first, len(words)))
                doc = np.repeat(np.arange(b - a), sizes)
                item = tree.items(cls, at)
                two, one = _contexts(item, first, tree.end)
                logp = log_probabilities(p, items, tree, two, one, item, frequency, mapped) / LN10
                known = at >= 0
                logp[~known] -= inside[cls[~known]]
                base = np.where(known, gain[at], 0.0)
                ids = number + np.arange(b - a)
                number += b - a
                sums = lambda x: np.bincount(doc, x, minlength=b - a)  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(ids, pa.int64()), pa.nulls(b - a, pa.binary()), pa.array(sizes, pa.int64()),
                     pa.array(sums(known.astype(float)).astype(np.int64), pa.int64()), pa.array(sums(base), pa.float64()), pa.array(sums(logp), pa.float64())], names=SCORES)
                rare = np.flatnonzero(~known)
                if len(rare):
                    tf = Counter(zip(doc[rare].tolist(), [words[i] for i in rare]))
                    own = np.fromiter((d for d, _ in tf), dtype=np.int64, count=len(tf))
                    m = len(tf)
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(m, batch.schema.field(0).type), pa.array(ids[own], pa.int64()), pa.array([w for _, w in tf], pa.binary()), pa.array(tf.values(), pa.int64()),
                         pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], names=SCORES)

    return run


SCORES = ["key", "row", "word", "n", "known", "base", "logp"]


def score(docs: DataFrame, training: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """A row for every row of docs: its columns `keep`, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    keep = [c for c in keep if c not in RESULT]
    vocab, counts = vocabulary(training, text)
    parameters, items = train(training, vocab, text)
    mapped = mapped_contexts(parameters, items, Tree(vocab))
    shared, model = spark.sparkContext.broadcast(vars(vocab)), spark.sparkContext.broadcast((parameters.flat(), mapped, items.words, items.groups))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, row long, word binary, n long, known long, base double, logp double"
    parts = written(rows.mapInArrow(_score(shared, model), schema), "scores")
    # words beyond the head: none is frequent, so none is a hot key
    looked = parts.where("word is not null").select("row", "word", "n").join(counts.withColumnRenamed("n", "c").select("word", "c"), "word")
    gain = looked.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("gain"))
    out = parts.where("word is null").join(gain, "row", "left").na.fill(0, ["more", "gain"])
    total = vocab.total + vocab.distinct + 1
    empty = vocab.total == 0
    return out.select(
        "key.*", F.col("n").alias("n_tokens"), (F.col("known") + F.col("more")).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("gain") - F.col("n") * F.lit(float(np.log10(total)))).alias("base_score"),
        (F.lit(0.0) if empty else F.col("logp") + F.col("gain")).alias("score"))
