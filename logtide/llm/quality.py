"""Quality rules by distribution divergence (DataFrame functions only).

A document's characters fall into ten classes, its words into a language's common
words and all others.  Both histograms are compared with those of its language by the
Jensen-Shannon divergence in bits, 0 for equal and 1 for disjoint ones; the distance is its
square root.  Shouting, decoration and tables move the classes, word lists and
gibberish the common words.  A document is kept if both distances stay within bounds.

The references come from all documents of a language, summed by Spark.  A common
word makes up, with a blank, at least one `share`-th of a language's characters, so there are
about `share` of them at most, found without a sort.  The `MOST_LANGUAGES` languages with most words have a reference; all other
documents, those without a language included, share one more.  References are joined by broadcast: their
number, words and lengths are bounded.

Guards: fewer than `least_words` words, or more than `repeated` percent of them in repeated
three-word windows, fail before any histogram; a reference of fewer than `reference_words` words judges
nobody; a short document's histogram differs by chance, so that the bound on common words is
wider by what as many words drawn from the reference differ on average.

Repeated windows are found inside a row by 64-bit hashes of its windows, sorted with their places, in n log n.

Defined results: a null text has no words; a text without words has every count 0 and fails;
equal rows are judged alike; lines are equal byte by byte; an empty table gives an
empty result; columns of the input that are named like one of the result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.scratch import written

BLANKS = " \t\n\x0b\x0c\r"
#: Character classes, in the order in which they are taken out of a text; what is left is the last one.
#: Small letters and blanks go first, together: they are runs of most of a text.
CLASSES = {"lower": "[a-z ]+", "beyond": r"[^\x00-\x7F]+", "upper": "[A-Z]+", "stop": "[.,]+", "line": r"[\x09-\x0D]+",
           "digit": "[0-9]+", "symbol": "[#*$%&|<>]+", "mark": "[!?;:'\"()_/-]+"}
N_CLASSES = len(CLASSES) + 2
MOST_LANGUAGES = 256
SHARE = 400
LONGEST_WORD = 40
REFERENCE_WORDS = 5000
LEAST_WORDS, REPEATED = 50, 50
MOST_CLASS, MOST_COMMON = 0.3, 0.35
LN2 = 0.6931471805599453
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULT = (*BASE, "base_failed", "class_distance", "common_distance", "kept")


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text that is not null, in order."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def class_counts(text: Column) -> Column:
    """The class counts of a text that is not null: those of CLASSES, the rest, blanks.

    Each class is taken out of what the earlier ones left, so that later ones read little.  The steps are
    nested lambdas: as one generated method they would be too long for the JVM to compile."""
    patterns = list(CLASSES.values())

    def left(i: int, rest: Column, lengths: list[Column]) -> Column:
        if i == len(patterns):
            return F.array(*lengths, F.length(F.replace(text, F.lit(" "), F.lit(""))))
        return _let(F.regexp_replace(rest, patterns[i], ""), lambda r: left(i + 1, r, [*lengths, F.length(r)]))

    def counts(n: Column) -> Column:
        k = len(patterns)
        blanks = n[0] - n[k + 1]
        return F.array(*[x.cast("long") for x in (n[0] - n[1] - blanks, *[n[i] - n[i + 1] for i in range(1, k)], n[k], blanks)])

    return _let(left(0, text, [F.length(text)]), counts)


def _class(name: str) -> Column:
    return F.col("__c")[list(CLASSES).index(name)]


def with_repeated_words(docs: DataFrame, hashes: str) -> DataFrame:
    """`docs` with n_repeat_words: words inside three-word windows that occur twice or more, from the words' hashes (a column).

    A text whose windows all differ, as most do, is seen so from the size of their set.  Those of the others are
    sorted, each one number: the upper bits of its hash, its place in the lower ones."""
    n, windows, sorted_ = F.size(hashes), F.col("__windows"), F.col("__sorted")
    h = F.col(hashes)
    own = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
    docs = docs.withColumn("__windows", F.when(n > 3, own)).withColumn("__mask", F.expr(f"shiftleft(1L, cast(ceil(log2(size({hashes}) + 1)) as int)) - 1"))
    mask = F.col("__mask")
    packed = F.transform(windows, lambda x, i: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))
    docs = docs.withColumn("__sorted", F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(packed)))
    at = lambda x: F.get(windows, x.bitwiseAND(mask).cast("int"))

    def twice(x: Column, j: Column) -> Column:
        same = lambda y: (x.bitwiseOR(mask) == y.bitwiseOR(mask)) & (at(x) == at(y))
        return F.coalesce(same(F.get(sorted_, j + 1)), F.lit(False)) | F.coalesce(same(F.get(sorted_, j - 1)), F.lit(False))

    places = F.sort_array(F.transform(F.filter(sorted_, twice), lambda x: x.bitwiseAND(mask)))
    start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3).cast("long"), i - s["last"])).alias("n"))
    docs = docs.withColumn("__places3", F.when(sorted_.isNotNull(), places))
    covered = F.aggregate("__places3", start, step, lambda s: s["n"])
    return docs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__windows", "__mask", "__sorted", "__places3")


def _bits(p: Column, q: Column) -> Column:
    """A place's share of the divergence: (p log(p / m) + q log(q / m)) / 2, m their mean."""
    part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(F.lit(0.0))
    return (part(p) + part(q)) / 2


def divergence(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon divergence, in bits, of some counts and the shares of a reference."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return _let(total, lambda n: F.aggregate(F.zip_with(counts, reference, lambda c, q: _bits(c / n, q)), F.lit(0.0), lambda s, x: s + x))


def common_divergence(n: Column, places: Column, reference: Column) -> Column:
    """The same of n words, of which some are at places (from 1) among the common words, and the shares of the places.

    Run by run of the sorted places; place 0 stands for all other words."""
    def runs(s: Column) -> Column:
        m = F.size(s)
        ends = F.when(m > 0, F.filter(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i + 1)))).otherwise(F.array().cast("array<int>"))
        first = F.get(reference, F.lit(0))
        start = F.struct(F.lit(-1).alias("last"), _bits((n - m) / n, first).alias("bits"), first.alias("seen"))

        def step(x: Column, end: Column) -> Column:
            q = F.get(reference, F.get(s, end))
            return F.struct(end.alias("last"), (x["bits"] + _bits((end - x["last"]) / n, q)).alias("bits"), (x["seen"] + q).alias("seen"))

        # a place that the document lacks adds half of its share
        return F.aggregate(ends, start, step, lambda x: x["bits"] + F.greatest(F.lit(0.0), 1 - x["seen"]) / 2)

    return _let(F.sort_array(places), runs)


def common_words(docs: DataFrame, text: str = "text", lang: str = "lang", share: int = SHARE) -> DataFrame:
    """(__lang, n, common, shares): words, common words, and the shares of all other words, then theirs.

    A row for each of at most MOST_LANGUAGES languages (those of most characters), and one (null) for the rest."""
    own = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__t"), F.col(f"`{lang}`").cast("string").alias("__lang"))
    by_lang = written(own.groupBy("__lang").agg(F.sum(F.length("__t")).alias("chars")), "quality-sums")
    top = by_lang.where("__lang is not null and chars > 0").orderBy(F.desc("chars"), "__lang").limit(MOST_LANGUAGES).select("__lang")
    top = written(top, "quality-languages")
    sized = written(grouped(by_lang, "__lang", top).groupBy("__g").agg(F.sum("chars").alias("chars")).select(F.col("__g").alias("__h"), "chars"), "quality-groups")

    counts = grouped(own, "__lang", top).select("__g", F.explode(words_of(F.col("__t"))).alias("w")).groupBy("__g", "w").agg(F.count("*").alias("k"))
    counts = counts.join(F.broadcast(sized), F.col("__g").eqNullSafe(F.col("__h")))
    # a common word and a blank behind each make up at least a share-th of all characters
    often = (F.col("k") * (F.length("w") + 1) * share >= F.col("chars")) & (F.length("w") <= LONGEST_WORD)
    found = counts.groupBy("__g").agg(F.sum("k").alias("n"), F.sort_array(F.collect_list(F.when(often, F.struct((-F.col("k")).alias("k"), "w")))).alias("x"))
    p = F.transform("x", lambda x: -x["k"] / F.col("n"))
    other = F.greatest(F.lit(0.0), 1 - F.aggregate(p, F.lit(0.0), lambda s, x: s + x))
    return written(found.select(F.col("__g").alias("__lang"), "n", F.transform("x", lambda x: x["w"]).alias("common"), F.concat(F.array(other), p).alias("shares")), "quality-words")


def grouped(docs: DataFrame, lang: str, groups: DataFrame) -> DataFrame:
    """`docs` with `__g`, their language if it is one of `groups` (at most MOST_LANGUAGES rows), else null."""
    own = groups.where("__lang is not null").select(F.col("__lang").alias("__own"))
    return docs.join(F.broadcast(own), F.col(lang) == F.col("__own"), "left").withColumn("__g", F.col("__own")).drop("__own")


def measured(docs: DataFrame, common: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """`docs` without the text: the base counts, class counts, and the distance to the common words of their language."""
    names = [c for c in docs.columns if c not in (*RESULT, text)]
    kept = [f"`{c}`" for c in names]
    own = docs.select(*kept, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__t"), F.col(f"`{lang}`").cast("string").alias("__lang"))
    refs = common.select(F.col("__lang").alias("__h"), F.col("n").alias("__n"), F.col("common").alias("__common"), F.col("shares").alias("__shares"),
                         F.coalesce(F.array_max(F.transform("common", lambda w: F.length(w))), F.lit(0)).alias("__longest"))
    own = grouped(own, "__lang", common).join(F.broadcast(refs), F.col("__g").eqNullSafe(F.col("__h")), "left")
    own = own.withColumn("__c", class_counts(F.col("__t"))).withColumn("__w", words_of(F.col("__t")))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    short = F.filter("__w", lambda w: F.length(w) <= F.col("__longest"))
    places = F.filter(F.transform(short, lambda w: F.array_position(F.col("__common"), w).cast("int")), lambda x: x > 0)
    out = own.select(
        *kept, "__g", "__n", "__shares", "__c", F.size("__common").alias("__places"), F.transform("__w", lambda w: F.xxhash64(w)).alias("__hashes"), places.alias("__found"),
        F.size("__w").cast("long").alias("n_words"), (F.length("__t") - F.col("__c")[N_CLASSES - 1] - _class("line")).cast("long").alias("word_chars"),
        _class("symbol").alias("n_symbols"), _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    out = with_repeated_words(out, "__hashes")
    distance = F.sqrt(F.greatest(F.lit(0.0), common_divergence(F.col("n_words"), F.col("__found"), F.col("__shares"))))
    out = out.withColumn("common_distance", F.when((F.col("n_words") > 0) & F.col("__n").isNotNull(), distance))
    return out.select(*kept, "__g", "__n", "__places", "__c", *BASE, "common_distance")


def verdicts(rows: DataFrame, least_words: int = LEAST_WORDS, repeated: int = REPEATED, reference_words: int = REFERENCE_WORDS,
             most_class: float = MOST_CLASS, most_common: float = MOST_COMMON) -> DataFrame:
    """The rows of a written `measured` table with class_distance, base_failed and kept.

    A distance is null where there is nothing to compare: no word, or no reference of enough words."""
    names = [c for c in rows.columns if c not in (*RESULT, "__g", "__n", "__places", "__c")]
    # the characters of a group, class by class; at most MOST_LANGUAGES + 1 groups
    sums = rows.groupBy("__g").agg(*[F.sum(F.col("__c")[i]).alias(f"c{i}") for i in range(N_CLASSES)])
    chars = sum((F.col(f"c{i}") for i in range(1, N_CLASSES)), F.col("c0"))
    classes = sums.select(F.col("__g").alias("__h"), F.array(*[F.when(chars > 0, F.col(f"c{i}") / chars).otherwise(F.lit(0.0)) for i in range(N_CLASSES)]).alias("__classes"))
    out = rows.join(F.broadcast(classes), F.col("__g").eqNullSafe(F.col("__h")), "left")
    judges = (F.col("__n") >= reference_words) & (F.col("n_words") > 0)
    out = out.withColumn("class_distance", F.when(judges, F.sqrt(F.greatest(F.lit(0.0), divergence(F.col("__c"), F.col("__classes"))))))
    out = out.withColumn("common_distance", F.when(judges, F.col("common_distance")))
    out = out.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeated * F.col("n_words")))
    # n words drawn from the reference itself differ from it by about (places - 1) / (8 n ln 2) bits
    chance = F.col("__places") / (F.col("n_words") * 8 * LN2)
    within = (F.col("class_distance") <= most_class) & (F.pow("common_distance", F.lit(2.0)) <= most_common**2 + chance)
    kept = ~F.col("base_failed") & F.coalesce(within, F.lit(True))
    return out.select(*[f"`{c}`" for c in names], *BASE, "base_failed", "class_distance", "common_distance", kept.alias("kept"))


def rules(docs: DataFrame, text: str = "text", lang: str = "lang", share: int = SHARE, **limits) -> DataFrame:
    """`docs` without the text, judged by the references that they give themselves."""
    return verdicts(written(measured(docs, common_words(docs, text, lang, share), text, lang), "quality-measured"), **limits)
