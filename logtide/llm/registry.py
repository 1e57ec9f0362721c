"""Queries of this subpackage: one per operator, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import debruijn, importance, language, lm, minhash, mixing, neighbours, packing, quality, search, suffixes, warc, whitening

#: Public vocabulary files; executors have them in the same place.
TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


@register("op1_language")
def q_op1(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document; a fifth of them, by crc32 of doc_id, is held out of training."""
    docs = table(spark, sf, "documents").withColumn("held_out", language.crc_fold("doc_id", 5) == 0)
    model = language.train(docs.where("not held_out"))
    return language.identify(docs.select("doc_id", "held_out", "text"), model, keep=["doc_id", "held_out"])


@register("op5_mixing")
def q_op5(spark: SparkSession, sf: str) -> DataFrame:
    """All documents mixed by source weights 1, 2, 3, ...: the words each one contributes."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    mixed = mixing.allot(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP3_SQL = """
WITH x AS (SELECT DISTINCT vec_id, [floor(256 * CAST(c AS DOUBLE)) for c in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([c for c in embedding if c IS NULL OR isnan(c) OR isinf(c)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM x q JOIN x c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@register("op3_topk", OP3_SQL)
def q_op3(spark: SparkSession, sf: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector against all others."""
    vectors = search.quantised(table(spark, sf, "embeddings"))
    return search.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@register("op4_packing")
def q_op4(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, tokenised and packed into sequences of at most 2048 ids."""
    pieces = packing.pack(table(spark, sf, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register("op6_fingerprints")
def q_op6(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of all documents and of their edits, and their likeness."""
    return neighbours.compared(table(spark, sf, "documents").select("doc_id", "text"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k ON p.h = k.h
"""


@register("op7_warc", OP7_SQL)
def q_op7(spark: SparkSession, sf: str) -> DataFrame:
    """All pages written as WARC records, and every record looked up and read back."""
    archive = warc.write_archive(table(spark, sf, "pages"))
    return warc.resolved(warc.read_archive(archive, archive.captures))


@register("op10_debruijn")
def q_op10(spark: SparkSession, sf: str) -> DataFrame:
    """All documents without the 50-word passages that a smaller doc_id already has."""
    out = debruijn.without_repeats(table(spark, sf, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op8_suffixes")
def q_op8(spark: SparkSession, sf: str) -> DataFrame:
    """All documents without the bytes of 400-byte strings that start in two places."""
    out = suffixes.without_repeats(table(spark, sf, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register("op9_minhash")
def q_op9(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate class of every document: Jaccard of five-word shingles at least 0.8, linked."""
    return minhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"), keep=["doc_id"]).select("doc_id", "class_id", "class_size")


@register("op2_lm")
def q_op2(spark: SparkSession, sf: str) -> DataFrame:
    """Model and unigram scores of all documents; a seventh of them, by crc32 of doc_id, is held out of training."""
    docs = table(spark, sf, "documents").withColumn("held_out", language.crc_fold("doc_id", 7) == 2)
    return lm.score(docs, docs.where("not held_out"), keep=["doc_id", "held_out"])


#: crc32 of a word, byte by byte, from the table of the reflected polynomial 0xEDB88320.
OP13_SQL = """
WITH RECURSIVE steps(b, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
words AS (SELECT d.rowid AS r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM (SELECT row_number() OVER () AS rowid, * FROM documents) d),
target AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
vocab AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM words UNION SELECT w FROM target)),
bytes AS (SELECT w, list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))) AS b FROM vocab),
hashed AS (SELECT w, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
s AS (SELECT bucket, count(*) AS s FROM words JOIN hashed USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM target JOIN hashed USING (w) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM words) AS s_all, (SELECT count(*) FROM target) AS t_all),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE)
  / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
weighed AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM words JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM (SELECT row_number() OVER () AS r, * FROM documents) LEFT JOIN weighed USING (r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank FROM ranked
"""


@register("op13_importance", OP13_SQL)
def q_op13(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of the documents with 20 words or more, drawn towards the word distribution of the benchmark."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return importance.resample(docs, table(spark, sf, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


@register("op11_whitening")
def q_op11(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings whitened by their eight leading principal components."""
    return whitening.whiten(table(spark, sf, "embeddings"), ["vec_id"])


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, lang FROM documents),
top AS (SELECT lang FROM d WHERE lang IS NOT NULL GROUP BY lang HAVING sum(length(t)) > 0 ORDER BY sum(length(t)) DESC, lang LIMIT 256),
e AS (SELECT d.*, CASE WHEN top.lang IS NULL THEN '(rest)' ELSE 'own ' || top.lang END AS g, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d LEFT JOIN top ON d.lang = top.lang),
w AS (SELECT r, g, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM e),
chars AS (SELECT g, sum(length(t)) AS chars FROM e GROUP BY g),
counts AS (SELECT g, w, count(*) AS k FROM w GROUP BY g, w),
n AS (SELECT g, sum(k) AS n FROM counts GROUP BY g),
common AS (SELECT g, w, k / n AS q FROM counts JOIN n USING (g) JOIN chars USING (g) WHERE k * (length(w) + 1) * 400 >= chars AND length(w) <= 40),
others AS (SELECT g, n, greatest(0.0, 1 - coalesce(sum(q), 0)) AS q, count(q) AS places FROM n LEFT JOIN common USING (g) GROUP BY g, n),
found AS (SELECT r, w, count(*) AS c FROM w JOIN common USING (g, w) GROUP BY r, w),
own AS (SELECT r, g, len(words) AS m FROM e WHERE len(words) > 0),
terms AS (SELECT own.r, coalesce(c, 0) / m AS p, q FROM own JOIN common USING (g) LEFT JOIN found ON found.r = own.r AND found.w = common.w
  UNION ALL SELECT own.r, (m - coalesce((SELECT sum(c) FROM found WHERE found.r = own.r), 0)) / m, q FROM own JOIN others USING (g)),
common_bits AS (SELECT r, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2) AS bits FROM terms GROUP BY r),
s0 AS (SELECT *, regexp_replace(t, '[a-z ]+', '', 'g') AS a FROM e),
s1 AS (SELECT *, regexp_replace(a, '[^\x00-\x7F]+', '', 'g') AS b FROM s0),
s2 AS (SELECT *, regexp_replace(b, '[A-Z]+', '', 'g') AS c FROM s1),
s3 AS (SELECT *, regexp_replace(c, '[.,]+', '', 'g') AS d FROM s2),
s4 AS (SELECT *, regexp_replace(d, '[\x09-\x0D]+', '', 'g') AS f FROM s3),
s5 AS (SELECT *, regexp_replace(f, '[0-9]+', '', 'g') AS h FROM s4),
s6 AS (SELECT *, regexp_replace(h, '[#*$%&|<>]+', '', 'g') AS j FROM s5),
s7 AS (SELECT *, regexp_replace(j, '[!?;:''"()_/-]+', '', 'g') AS l, length(t) - length(replace(t, ' ', '')) AS blanks FROM s6),
classes AS (SELECT r, doc_id, g, t, words, blanks, length(h) - length(j) AS symbols, length(d) - length(f) AS breaks,
  [length(t) - length(a) - blanks, length(a) - length(b), length(b) - length(c), length(c) - length(d), length(d) - length(f), length(f) - length(h), length(h) - length(j), length(j) - length(l), length(l), blanks] AS x FROM s7),
flat AS (SELECT r, g, unnest(x) AS x, generate_subscripts(x, 1) AS i, list_sum(x) AS size FROM classes WHERE len(words) > 0),
every AS (SELECT g, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM classes),
shares AS (SELECT g, i, sum(x) / sum(sum(x)) OVER (PARTITION BY g) AS q FROM every GROUP BY g, i),
class_terms AS (SELECT r, x / size AS p, q FROM flat JOIN shares USING (g, i)),
class_bits AS (SELECT r, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2) AS bits FROM class_terms GROUP BY r),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM (SELECT r, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE c IS NOT NULL),
repeated AS (SELECT r, count(DISTINCT i + j) AS n FROM windows, range(3) s(j) WHERE k >= 2 GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM e),
base AS (SELECT c.r, c.g, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(t) - blanks - breaks AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM classes c JOIN lines USING (r) LEFT JOIN repeated p ON p.r = c.r),
judged AS (SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CASE WHEN o.n >= 5000 THEN sqrt(greatest(0, k.bits)) <= 0.3 AND greatest(0, m.bits) <= 0.35 * 0.35 + o.places / (n_words * 8 * 0.6931471805599453) END AS within
  FROM base LEFT JOIN others o ON o.g = base.g LEFT JOIN class_bits k ON k.r = base.r LEFT JOIN common_bits m ON m.r = base.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(within, true) AS kept FROM judged
"""


@register("op12_quality", OP12_SQL)
def q_op12(spark: SparkSession, sf: str) -> DataFrame:
    """All documents judged by their base counts and their distance to the distributions of their language."""
    judged = quality.rules(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
