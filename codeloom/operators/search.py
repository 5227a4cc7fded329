"""BM25 search.

Two forms share one scoring expression. ``search`` reads the texts once and counts query
terms inside each row, so nothing is exploded or shuffled but the top rows. A stored
inverted index (``postings``) answers repeated queries by reading only the query's terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.text import analyze
from codeloom.schema import DEFAULT_SEARCH_LIMIT, POSTINGS
from codeloom.session import durable


@dataclass(frozen=True)
class Bm25:
    """Ranking assumptions, kept in one place: every query term must match."""

    k1: float = 1.2
    b: float = 0.75
    digits: int = 6


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """Distinct tokens of a query, made by the same analyzer as the texts."""
    row = spark.range(1).select(F.array_sort(F.array_distinct(analyze(F.lit(query)))).alias("terms")).first()
    return list(row.terms)


def _occurrences(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == F.lit(term))).cast("bigint")


def _score(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column, p: Bm25) -> Column:
    idf = F.ln(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))
    norm = F.lit(p.k1) * (F.lit(1 - p.b) + F.lit(p.b) * dl / avgdl)
    return idf * tf * F.lit(p.k1 + 1) / (tf + norm)


def _top(hits: DataFrame, by: list[str], key: str, limit: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), key)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def search(
    corpus: DataFrame,
    text: str,
    key: str,
    query: str,
    limit: int = DEFAULT_SEARCH_LIMIT,
    keep: str | None = None,
    by: list[str] | None = None,
    params: Bm25 = Bm25(),
) -> DataFrame:
    """Rank rows of ``corpus`` whose ``text`` holds every term of ``query``.

    Term and length statistics come from the whole corpus; ``keep`` (a SQL predicate such
    as a project filter) is applied after scoring. With ``by`` the limit counts per group.
    Result: the corpus columns but the text, plus ``score`` and, when grouped, ``rank``.
    """
    terms = query_terms(corpus.sparkSession, query)
    kept = [c for c in corpus.columns if c != text]
    if not terms:
        return corpus.select(*kept).limit(0).withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(0))
    # The texts are tokenised once; what is stored of them is a few numbers per row.
    counted = durable(
        corpus.select(*kept, analyze(F.col(text)).alias("_tokens")).select(
            *kept,
            F.size("_tokens").cast("bigint").alias("_dl"),
            *[_occurrences(F.col("_tokens"), w).alias(f"_tf{i}") for i, w in enumerate(terms)],
        )
    )
    # One row: corpus size, mean length and the document frequency of each term.
    facts = counted.agg(
        F.struct(
            F.count("*").alias("n"),
            F.avg("_dl").alias("avgdl"),
            *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))],
        ).alias("facts")
    )
    matching = counted
    for i in range(len(terms)):
        matching = matching.filter(F.col(f"_tf{i}") > 0)
    if keep:
        matching = matching.filter(keep)
    matching = matching.withColumn("_facts", facts.scalar())
    total = None
    for i in range(len(terms)):
        part = _score(
            F.col(f"_tf{i}"), F.col("_dl"), F.col(f"_facts.df{i}"), F.col("_facts.n"), F.col("_facts.avgdl"), params
        )
        total = part if total is None else total + part
    hits = matching.select(*kept, F.round(total, params.digits).alias("score"))
    if by:
        return _top(hits, by, key, limit)
    return hits.orderBy(F.desc("score"), key).limit(limit)


def postings(corpus: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Inverted index rows (token, keys…, tf, dl), ready to be written ordered by token.

    Tokens are counted by text and token, with partial counts before the shuffle.
    """
    tokens = corpus.select(*keys, analyze(F.col(text)).alias("_tokens"))
    each = tokens.select(*keys, F.size("_tokens").cast("bigint").alias("dl"), F.explode("_tokens").alias("token"))
    return each.groupBy("token", *keys, "dl").agg(F.count("*").alias("tf")).select("token", *keys, "tf", "dl")


# How many texts, and bytes unless one batch has more, a task holds as it makes posting lists.
LIST_TEXTS = 16_384
LIST_BYTES = 1 << 25


def _cutter() -> Callable[[pa.Array], tuple]:
    """``analyze`` of texts in ASCII, all of a batch at once: the number of tokens of each text, and all tokens in a row."""

    def cut(texts: pa.Array) -> tuple:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.string()), "")
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if len(texts) == 0 or ends[0] == ends[-1]:
            return np.zeros(len(texts), np.int64), pa.array([], pa.string())
        signs, ends = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
        # Blanks 0, letters 1, digits 2, any other sign 3; a run of letters or digits is one token.
        kinds, lower = np.full(256, 3, np.uint8), np.arange(256, dtype=np.uint8)
        kinds[list(b" \t\n\x0b\x0c\r")] = 0
        kinds[65:91] = kinds[97:123] = 1
        kinds[48:58] = 2
        lower[65:91] += 32
        kind = kinds[signs]
        begins = kind == 3
        begins[1:] |= kind[1:] != kind[:-1]
        begins[ends[:-1][ends[:-1] < len(signs)]] = True
        kept = kind != 0
        begins &= kept
        starts = np.cumsum(kept, dtype=np.int32)[begins] - 1
        held = lower[signs[kept]]
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(held)).astype(np.int32)), pa.py_buffer(held))
        upto = np.append(0, np.cumsum(begins))
        return upto[ends[1:]] - upto[ends[:-1]], words

    return cut


def _in_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def token_count(text: Column) -> Column:
    """The number of tokens that ``analyze`` finds; 0 for no text."""
    cut = _cutter()

    def count(texts: pa.Array) -> pa.Array:
        import pyarrow as pa

        return pa.array(cut(texts)[0], pa.int64())

    counted = F.arrow_udf(count, "bigint")(F.when(_in_ascii(text), text))
    return F.coalesce(F.when(_in_ascii(text), counted).otherwise(F.size(analyze(text)).cast("bigint")), F.lit(0).cast("bigint"))


def posting_lists(texts: DataFrame, text: str) -> DataFrame:
    """Posting lists (token, block, gaps, tfs) of texts (block, place, ``text``): ``postings`` of numbered texts, many to a row.

    Tokens are counted where the texts are, so no posting is moved or grouped by itself. A token may have several lists of one
    block. Places rise within a list.
    """
    cut = _cutter()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def lists(held):
            plain, tokens, block, place = (pa.concat_arrays([b.column(k) for b in held]) for k in ("text", "tokens", "block", "place"))
            tokens = pc.split_pattern(tokens.cast(pa.string()), "\n")
            n, lengths = len(tokens), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
            plain_lengths, words = cut(plain)
            words = pa.concat_arrays([words, tokens.flatten()]).dictionary_encode()
            block, place = block.dictionary_encode(), place.to_numpy()
            blocks = block.indices.to_numpy()
            order = np.lexsort((place, blocks))
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            # One number per token of a text; equal ones are counted.
            key = words.indices.to_numpy().astype(np.int64) * n + np.concatenate([np.repeat(rank, plain_lengths), np.repeat(rank, lengths)])
            key.sort()
            first = np.flatnonzero(np.diff(key, prepend=-1))
            tfs, key = np.diff(first, append=len(key)), key[first]
            token, at = key // n, order[key % n]
            blocks, place = blocks[at], place[at]
            begins = (np.diff(token, prepend=-1) != 0) | (np.diff(blocks, prepend=-1) != 0)
            starts = np.flatnonzero(begins)
            ends = np.append(starts, len(key)).astype(np.int32)
            gaps = np.where(begins, place, np.diff(place, prepend=0))
            columns = [words.dictionary.take(pa.array(token[starts])), block.dictionary.take(pa.array(blocks[starts]))]
            columns += [pa.ListArray.from_arrays(ends, pa.array(v, pa.int64())) for v in (gaps, tfs)]
            return pa.RecordBatch.from_arrays(columns, ["token", "block", "gaps", "tfs"])

        held, rows, size = [], 0, 0
        for batch in batches:
            held, rows, size = [*held, batch], rows + len(batch), size + batch.nbytes
            if rows >= LIST_TEXTS or size >= LIST_BYTES:
                yield lists(held)
                held, rows, size = [], 0, 0
        if rows:
            yield lists(held)

    # Few texts hold other signs than ASCII; those are cut by Spark. No token holds a line's end, and as a list of lists
    # Spark would measure all that a batch holds anew with each row.
    found = F.col(text)
    other = F.when(~_in_ascii(found), F.nullif(F.array_join(analyze(found), "\n"), F.lit("")))
    return texts.select("block", "place", F.when(_in_ascii(found), found).alias("text"), other.alias("tokens")).mapInArrow(task, POSTINGS)


def listed(lists: DataFrame) -> DataFrame:
    """The postings (token, block, place, tf) of posting lists."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lengths = pc.list_value_length(batch.column("gaps")).to_numpy()
            gaps, rows = batch.column("gaps").flatten().to_numpy(), pa.array(np.repeat(np.arange(len(batch)), lengths))
            # Sums run over all lists of the batch; what was summed before a list is taken off again.
            before = np.append(0, np.cumsum(gaps))
            place = before[1:] - np.repeat(before[np.cumsum(lengths) - lengths], lengths)
            columns = [batch.column(k).take(rows) for k in ("token", "block")] + [pa.array(place, pa.int64()), batch.column("tfs").flatten()]
            yield pa.RecordBatch.from_arrays(columns, ["token", "block", "place", "tf"])

    return lists.mapInArrow(task, "token string, block string, place bigint, tf bigint")


def as_lists(postings: DataFrame) -> DataFrame:
    """Posting lists of postings (token, block, place, tf), a list for each ``LIST_TEXTS`` places of a block."""
    held = postings.groupBy("token", "block", F.floor(F.col("place") / LIST_TEXTS).alias("_range")).agg(
        F.array_sort(F.collect_list(F.struct("place", "tf"))).alias("_items")
    )
    before = F.concat(F.array(F.lit(0).cast("bigint")), F.col("_items.place"))
    gaps = F.transform("_items", lambda x, i: x["place"] - F.get(before, i))
    return held.select("token", "block", gaps.alias("gaps"), F.col("_items.tf").alias("tfs"))


def search_postings(
    index: DataFrame,
    corpus_size: DataFrame,
    keys: list[str],
    query: str,
    limit: int = DEFAULT_SEARCH_LIMIT,
    keep: str | None = None,
    params: Bm25 = Bm25(),
) -> DataFrame:
    """The same ranking from stored postings; ``corpus_size`` is one row (n, avgdl)."""
    terms = query_terms(index.sparkSession, query)
    hits = index.filter(F.col("token").isin(terms))
    frequency = hits.groupBy("token").agg(F.count("*").alias("df"))
    scored = (
        hits.join(F.broadcast(frequency), "token")  # one row per query term
        .withColumn("_facts", corpus_size.select(F.struct("n", "avgdl").alias("facts")).scalar())
        .withColumn(
            "part",
            _score(F.col("tf"), F.col("dl"), F.col("df"), F.col("_facts.n"), F.col("_facts.avgdl"), params),
        )
        .groupBy(*keys)
        .agg(F.sum("part").alias("score"), F.count("*").alias("matched"))
        .filter(F.col("matched") == len(terms))
    )
    if keep:
        scored = scored.filter(keep)
    return (
        scored.select(*keys, F.round("score", params.digits).alias("score"))
        .orderBy(F.desc("score"), *keys)
        .limit(limit)
    )


def terms_of(spark: SparkSession, queries: list[str]) -> list[list[str]]:
    """Distinct tokens of each query."""
    asked = spark.createDataFrame(list(enumerate(queries)), "query int, text string")
    rows = asked.select("query", F.array_sort(F.array_distinct(analyze(F.col("text")))).alias("terms")).collect()
    return [list(r.terms) for r in sorted(rows)]


def rank_postings(
    hits: DataFrame,
    asked: list[list[str]],
    n: int,
    avgdl: float,
    limit: int,
    project: str | None = None,
    by_project: bool = False,
    params: Bm25 = Bm25(),
) -> DataFrame:
    """(query, project, file_path, score, rank) from the postings of all terms of all queries, read once.

    ``hits`` has (token, project, file_path, tf, dl); frequencies count over all of them, ``project`` filters
    the ranking. A query without terms has no result.
    """
    spark = hits.sparkSession
    rows = [(q, t, len(terms)) for q, terms in enumerate(asked) for t in terms]
    terms = F.broadcast(spark.createDataFrame(rows, "query int, token string, needed int"))
    frequency = F.broadcast(hits.groupBy("token").agg(F.count("*").alias("df")))  # one row per term
    mine = hits if project is None else hits.filter(F.col("project") == project)
    part = _score(F.col("tf"), F.col("dl"), F.col("df"), F.lit(n), F.lit(avgdl), params)
    scored = (
        mine.join(frequency, "token")
        .join(terms, "token")
        .groupBy("query", "needed", "project", "file_path")
        .agg(F.round(F.sum(part), params.digits).alias("score"), F.count("*").alias("matched"))
        .filter("matched = needed")
        .select("query", "project", "file_path", "score")
    )
    return _top(scored, ["query", "project"] if by_project else ["query"], "file_path", limit)


def corpus_size(corpus: DataFrame, text: str) -> DataFrame:
    return corpus.agg(F.count("*").alias("n"), F.avg(F.size(analyze(F.col(text)))).alias("avgdl"))
