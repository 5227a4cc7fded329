"""URL verdicts: rules first, then logistic regression on hashed character n-grams of host and path.

Everything is column expressions and Spark ML's estimator: no Python runs on executors. The
regression is fitted on a small labelled URL table; its weights (``BUCKETS`` numbers) are a
literal array in the scoring expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import stored

BUCKETS = 2048
GRAMS = (3, 5)
# Different URLs of each verdict that the fit takes at most, about: of more they are drawn by a hash.
LABELLED_ROWS = 4000

Rule = tuple[str, str]  # verdict and host/path, such as ("block", "com/de/")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does. Of equally long rules the first wins."""
    best_rule, best_verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        best_rule = F.when(fits, rule).otherwise(best_rule)
        best_verdict = F.when(fits, verdict).otherwise(best_verdict)
    return best_rule, best_verdict


def gram_buckets(host: Column, path: Column) -> Column:
    """Buckets of the overlapping n-grams of ``^host$`` and ``^path$``, apart for host and path and for each length."""
    parts = []
    for kind, text in (("h", host), ("p", path)):
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        for n in GRAMS:
            grams = F.regexp_extract_all(framed, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
            parts.append(F.transform(grams, lambda g, k=kind: F.pmod(F.xxhash64(F.lit(k), g), F.lit(BUCKETS)).cast("int")))
    return F.concat(*parts)


def fit(labelled: DataFrame, rows: int = LABELLED_ROWS) -> list[float]:
    """Intercept and ``BUCKETS`` weights from a table of ``url`` and ``verdict`` (allow or block).

    Repeated URLs count once. Of a verdict with more than ``rows`` different URLs about ``rows``
    are drawn by a hash, of one with fewer all; weights restore the shares of the verdicts.
    With drawn URLs of one kind only, or none, the weights are zero and the intercept speaks
    for that kind (0 for none).
    """
    valid = labelled.where("verdict in ('allow', 'block')").select("url", "verdict", F.xxhash64("url").alias("h"))
    counts = {r["verdict"]: r["count"] for r in valid.select("verdict", "h").distinct().groupBy("verdict").count().collect()}
    if not counts:
        return [0.0] * (1 + BUCKETS)
    total = F.create_map(*[x for v, n in counts.items() for x in (F.lit(v), F.lit(n))])
    drawn = stored(valid.where(F.pmod("h", total[F.col("verdict")]) < rows).select("url", "verdict").distinct())
    taken = {r["verdict"]: r["count"] for r in drawn.groupBy("verdict").count().collect()}
    if len(taken) < 2:
        return [{"allow": 1.0, "block": -1.0}.get(next(iter(taken), ""), 0.0), *[0.0] * BUCKETS]
    weight = F.create_map(*[x for v, n in taken.items() for x in (F.lit(v), F.lit(max(counts[v], n) / n))])
    drawn = drawn.select(
        (F.col("verdict") == "allow").cast("double").alias("label"), weight[F.col("verdict")].alias("weight"),
        gram_buckets(host_of(F.col("url")), path_of(F.col("url"))).cast("array<string>").alias("b"),
    )
    places = CountVectorizerModel.from_vocabulary([str(b) for b in range(BUCKETS)], "b", "features", binary=True)
    model = LogisticRegression(maxIter=30, regParam=0.01, standardization=False, weightCol="weight").fit(places.transform(drawn).select("label", "weight", "features"))
    return [float(model.intercept), *map(float, model.coefficients)]


def score(host: Column, path: Column, weights: Sequence[float]) -> Column:
    """Probability of ``allow``."""
    table = F.expr(f"array({', '.join(f'{w!r}D' for w in weights[1:])})")
    total = F.aggregate(F.array_distinct(gram_buckets(host, path)), F.lit(float(weights[0])), lambda s, b: s + F.get(table, b))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``score`` and ``verdict`` of every row.

    The verdict is that of the longest fitting rule; where none fits it is allow exactly if
    the score is at least 0.5. ``labelled`` has ``url`` and ``verdict``; without it the rows
    that a rule decides are the labelled ones. A null URL, or one without ``://``, has empty
    host and path and is scored as such. Keys may be null or repeated; every row stays and
    other columns are left out. An empty table gives an empty table.
    """
    rows = pages.select(F.col(key), F.col(url).alias("_url")).select(key, "_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    rule, of_rule = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = rows.withColumns({"rule": rule, "_of_rule": of_rule})
    if labelled is None:
        labelled = ruled.where("rule is not null").select(F.col("_url").alias("url"), F.col("_of_rule").alias("verdict"))
    weights = fit(labelled)
    scored = ruled.withColumn("score", score(F.col("host"), F.col("path"), weights))
    verdict = F.coalesce("_of_rule", F.when(F.col("score") >= 0.5, "allow").otherwise("block"))
    return scored.select(key, "host", "path", "rule", "score", verdict.alias("verdict"))
