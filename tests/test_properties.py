"""Property tests against plain Python: the literal case-insensitive text
filter (D3 with H3 escaping) and the in-order subsequence match (D10), on
random ASCII text full of LIKE and regex metacharacters."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logtide.functions.columns import fuzzy
from logtide.operators.predicates import message_contains

ALPHABET = "aAbB%_\\'\".*+?()[]{}|^$ 19"
text = st.text(alphabet=ALPHABET, min_size=0, max_size=12)


@settings(max_examples=25, deadline=None)
@given(st.lists(text, min_size=1, max_size=8), text)
def test_text_filter_is_literal_substring(spark, messages, q):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "i int, message string")
    cond = message_contains(q)
    got = sorted(r.i for r in (df.filter(cond) if cond is not None else df).collect())
    want = sorted(i for i, m in enumerate(messages) if not q or q.lower() in m.lower())
    assert got == want


def _subsequence(q: str, t: str) -> bool:
    it = iter(t)
    return all(ch in it for ch in q)


@settings(max_examples=25, deadline=None)
@given(st.lists(text, min_size=1, max_size=8), text)
def test_fuzzy_is_in_order_subsequence(spark, texts, q):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = sorted(r.i for r in df.filter(fuzzy(F.col("t"), q)).collect())
    want = sorted(i for i, t in enumerate(texts) if _subsequence(q, t))
    assert got == want


def _runtime_text(s: int) -> str:
    """The display rule in plain Python: the two largest units, zero remainder left out."""
    steps = [("d", 86400, "h", 3600), ("h", 3600, "m", 60), ("m", 60, "s", 1)]
    if s < 60:
        return f"{s}s"
    for big, big_size, small, small_size in steps:
        if s >= big_size:
            whole, rem = divmod(s, big_size)
            rem //= small_size
            return f"{whole}{big} {rem}{small}" if rem else f"{whole}{big}"
    return f"{s}s"


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=10**8), min_size=1, max_size=30))
def test_human_runtime_rule(spark, seconds):
    from logtide.functions.columns import human_runtime

    df = spark.createDataFrame([(i, s) for i, s in enumerate(seconds)], "i int, s long")
    got = [r[1] for r in df.select("i", human_runtime("s")).orderBy("i").collect()]
    assert got == [_runtime_text(s) for s in seconds]
