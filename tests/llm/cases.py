"""Small documents with every awkward case, and brute-force helpers."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, id string, node string, kept string, copies long, n long, words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng: random.Random, n: int, tongue: str = "en") -> str:
    parts = {"en": ["the", "ing", "th", "wh", "and", "ly"], "de": ["der", "ung", "sch", "ein", "ß", "ich"]}[tongue]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(spark, n: int = 60, seed: int = 3):
    """Plain, null, empty, blank, tiny, very long, repeated and nearly repeated texts; null ids and sources; clashing columns."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        tongue = "de" if i % 3 == 0 else "en"
        rows.append((i, sentence(rng, rng.randint(1, 400), tongue), tongue, f"s{i % 4}"))
    passage = sentence(rng, 120)
    rows += [(100, None, "en", "s0"), (101, "", None, "s1"), (102, " \t\n ", "en", None), (103, "the", "en", "s2"), (104, "12 34 !?", "de", "s2"),
             (105, sentence(rng, 30_000), "en", "s0"), (106, "x" * 5000, "en", "s1"), (107, "ab " * 900, "en", "s1"),
             (108, f"{passage} {sentence(rng, 40)}", "en", "s3"), (109, f"{sentence(rng, 30)} {passage}", "en", "s3"), (110, passage, "en", None),
             (111, rows[5][1], "en", "s0"), (112, rows[5][1], "en", "s0"), (112, rows[5][1], "en", "s0"), (113, rows[5][1] + " the end", "en", "s0"),
             (None, rows[7][1], "en", "s1"), (None, "the null one", None, None), (114, "é\x00日本 \x85 ſ word", "en", "s1")]
    # a family of near copies around one text
    base = sentence(rng, 300).split(" ")
    for i in range(12):
        words = list(base)
        for _ in range(i):
            words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((200 + i, " ".join(words), "en", "s2"))
    return spark.createDataFrame([(a, b, c, d, None if b is None else len(b), 0.5, "x", "y", "z", "k", 7, 8, "w") for a, b, c, d in rows], SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def save(df, folder: str, name: str = "documents") -> str:
    """The frame as a table that queries read."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return folder


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, size: int = 5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
