"""A source of many buckets is mixed like one of a few."""

from pyspark.sql import functions as F

from priorweave.llm import mixing


def test_buckets_past_the_long_product(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), F.lit("a").alias("source"))
    want = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)  # 3,000 buckets, as 12 million rows have
    assert sorted(map(tuple, mixing.mix(docs).collect())) == want


def test_buckets_are_ranges_of_the_key(spark):
    top = (1 << 53) - 1
    for n in (1, 1024, 1025, 4097, 10**6 + 3):
        keys = sorted({0, 1, top // n, min(top, top // n + 1), top // 2, top - top // n, top - 1, top})
        got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "key long").orderBy("key").select(mixing.bucket(F.col("key"), F.lit(n).cast("long"))).collect()]
        assert got == sorted(got) and got[0] == 0 and got[-1] == n - 1
