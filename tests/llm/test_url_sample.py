"""The sample that the URL regression is fitted on holds both verdicts, however rare or repeated."""

from pyspark.sql import functions as F

from codeloom.llm import url_filter


def test_rare_verdicts_and_repeated_urls(spark):
    common = spark.range(6000).select(F.concat(F.lit("http://good.org/page/"), "id").alias("url"), F.lit("allow").alias("verdict"))
    rare = spark.range(3).select(F.concat(F.lit("http://bad.net/casino/"), "id").alias("url"), F.lit("block").alias("verdict"))
    weights = url_filter.fit(common.unionByName(rare), rows=100)
    score = lambda url: url_filter.score(url_filter.host_of(F.lit(url)), url_filter.path_of(F.lit(url)), weights)
    good, bad = spark.range(1).select(score("http://good.org/page/x"), score("http://bad.net/casino/x")).first()
    assert any(weights[1:]) and bad < good
    # Each URL many times: the draw goes over different URLs.
    often = spark.range(5000).select(F.lit(None).cast("string").alias("url"), F.lit("allow").alias("verdict"))
    for i in range(6):
        often = often.unionByName(spark.range(500).select(F.lit(f"http://{'ab'[i % 2]}.org/{i}").alias("url"), F.lit(["allow", "block"][i % 2]).alias("verdict")))
    assert any(url_filter.fit(often, rows=10)[1:])
    assert url_filter.fit(often.limit(0)) == [0.0] * (1 + url_filter.BUCKETS)
    one = url_filter.fit(common, rows=10)
    assert one[0] == 1.0 and not any(one[1:])
