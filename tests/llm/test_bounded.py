import pytest
from pyspark.sql import functions as F

from logtide.llm import bounded


def test_most_frequent_is_the_sorted_head(spark):
    df = spark.range(500).select((F.col("id") % 97 * (F.col("id") % 5) + 1).alias("n"), F.col("id").cast("string").alias("w")).repartition(7)
    rows = [(r.n, r.w) for r in df.collect()]
    for most in (1, 10, 250, 499, 1000):
        got = [(r.n, r.w) for r in bounded.most_frequent(df, "n", most, "w").collect()]
        assert got == sorted(rows, key=lambda r: (-r[0], r[1]))[:most]
    assert bounded.most_frequent(df.limit(0), "n", 5, "w").count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_long_lists_are_not_broadcast(spark, tmp_dir, how):
    docs = spark.range(400).select((F.col("id") % 90).alias("k"), F.lit(7).alias("c"), F.concat(F.lit("text "), "id").alias("text"))
    spark.range(60).select(F.col("id").alias("k"), F.lit(7).alias("c"), F.expr("transform(sequence(1, 30000), x -> struct(x AS place, bigint(1) AS count))").alias("spans")).write.parquet(f"{tmp_dir}/side")
    side = spark.read.parquet(f"{tmp_dir}/side")
    out = bounded.join_counted(docs, side, ["k", "c"], how, most_bytes=bounded.MOST_BYTES)
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert len(joins) == (2 if how == "inner" else 3)
    assert all(("strategy=broadcast" in x) == ("LeftSemi" in x or "LeftAnti" in x) for x in joins)
    plain = docs.join(side, ["k", "c"], how)
    assert out.columns == plain.columns
    short = lambda df: sorted(tuple(r) for r in df.withColumn("spans", F.when(F.col("spans").isNotNull(), F.size("spans"))).fillna(-1).collect())
    assert short(out) == short(plain)
    few = bounded.join_counted(docs, side.withColumn("spans", F.slice("spans", 1, 3)), ["k", "c"], how, most_bytes=bounded.MOST_BYTES)
    assert "strategy=broadcast" in few._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1].split("\n")[0]
