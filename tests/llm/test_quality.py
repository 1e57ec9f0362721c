import random
import re

import duckdb
from pyspark.sql import functions as F

from logtide.llm import quality, registry
from tests.llm import cases


def _sql(folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return con.sql(registry.ORACLE["op12_quality"])


def _key(r):
    return tuple((x is None, x) for x in r)


def _junk(spark):
    """Prose of two languages, and what must go: shouting, decoration, lists of words, one word over and over."""
    rng = random.Random(8)
    words = {"en": ["the", "of", "and", "to", "in", "is"], "de": ["der", "die", "und", "zu", "von", "das"]}

    def prose(tongue, n):
        return " ".join(rng.choice(words[tongue]) if rng.random() < 0.4 else cases.sentence(rng, 1, tongue) for _ in range(n))

    rows = [(i, prose("en" if i % 2 else "de", rng.randint(80, 300)), "en" if i % 2 else "de", "good") for i in range(120)]
    rows += [(1000, " ".join(w.upper() + "!!" for w in prose("en", 200).split()), "en", "bad"), (1001, " ".join(w + "***" for w in prose("de", 200).split()), "de", "bad"),
             (1002, " | ".join(cases.sentence(rng, 1) for _ in range(200)), "en", "bad"), (1003, "spam " * 200, "en", "bad"), (1004, prose("en", 20), "en", "bad"), (1005, None, "en", "bad"),
             (1006, "\n".join(["one line again"] * 90), None, "bad"), (1007, "", None, "bad")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kind string").repartition(3)


def test_query_equals_sql_on_awkward_documents(spark, tmp_dir):
    for name, docs in (("a", cases.documents(spark)), ("b", _junk(spark)), ("c", cases.documents(spark).withColumn("lang", F.lit(None).cast("string"))), ("d", cases.documents(spark).where("doc_id in (1, 100, 101, 104)")),
                       ("e", cases.empty(spark)), ("f", spark.createDataFrame([(1, None, "x"), (2, " \n", "x"), (2, " \n", "x"), (3, None, None)], "doc_id long, text string, lang string"))):
        folder = cases.save(docs, f"{tmp_dir}/{name}")
        out = registry.QUERIES["op12_quality"](spark, folder)
        want = _sql(folder)
        assert out.columns == want.columns
        got, want = sorted(map(_key, out.collect()), key=repr), sorted(map(_key, want.fetchall()), key=repr)
        assert got == want, name


def test_junk_goes_and_prose_stays(spark):
    out = quality.rules(_junk(spark))
    assert {(r.doc_id, r.kept) for r in out.collect() if r.kept != (r.kind == "good")} == set()
    assert out.columns == ["doc_id", "lang", "kind", *quality.RESULT[:5], "base_failed", "class_distance", "common_distance", "kept"]
    # a reference of too few words judges nobody: only the base rules are left
    free = quality.rules(_junk(spark), reference_words=10**9).collect()
    assert all(r.kept == (not r.base_failed) and r.class_distance is None for r in free)


def test_repeated_words_of_random_texts(spark):
    rng, rows = random.Random(5), []
    for i in range(300):
        rows.append((i, [rng.choice("abcd") for _ in range(rng.randint(0, 40))]))
    rows.append((999, ["x"] * 5000))

    def brute(w):
        at, hit = {}, set()
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        for places in at.values():
            if len(places) > 1:
                hit |= {p + k for p in places for k in range(3)}
        return len(hit)

    df = spark.createDataFrame(rows, "id long, w array<string>").select("id", F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    got = {r.id: r.n_repeat_words for r in quality.with_repeated_words(df, "h").collect()}
    assert got == {i: brute(w) for i, w in rows}


def test_class_counts_add_up(spark):
    texts = ["", "Ab, 1 #é日\n\t-~", "x" * 1000, "|<>|", "\x00\x7f"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quality.class_counts(F.col("t")).alias("c")).collect()
    for r in rows:
        count = lambda p: len(re.findall(p, r.t))
        assert sum(r.c) == len(r.t) and len(r.c) == quality.N_CLASSES
        assert r.c[:3] == [count("[a-z]"), count(r"[^\x00-\x7F]"), count("[A-Z]")] and r.c[-1] == count(" ") and r.c[6] == count("[#*$%&|<>]")


def test_no_python_on_the_way(spark):
    plan = quality.rules(cases.documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
