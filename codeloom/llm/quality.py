"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at counts of the whole text and votes good (1), bad (-1) or abstains (0). A
two-class model, in which rules vote independently given the class, is fitted to all rows
that pass the base checks (the others are decided).
Rows with the same votes are alike to it, so the fit works on the number of rows per vote
pattern: at most three to the number of rules, whatever the data. A row is kept if the
posterior probability of good is at least ``KEEP``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import SPACES, arrow_map, slices, stored

KEEP = 0.5
ROUNDS = 100
_SPACE_BYTES = SPACES.encode()
# Fixed values of the base contract.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words

# What each rule looks at: a ratio, the bound from which it votes bad, the bound from which it votes good.
RULES: dict[str, tuple[str, float, float]] = {
    "length": ("n_words / 1.0", 30, 80),
    "short_words": ("word_chars / greatest(n_words, 1)", 2.5, 3.5),
    "long_words": ("word_chars / greatest(n_words, 1)", 14, 10),
    "symbols_by_word": ("n_symbols / greatest(n_words, 1)", 0.2, 0.05),
    "symbols_by_char": ("n_symbols / greatest(word_chars, 1)", 0.03, 0.01),
    "other_marks": ("(word_chars - n_letters) / greatest(word_chars, 1)", 0.1, 0.05),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 0.3, 0.1),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 0.3, 0.1),
    "capitals": ("n_upper / greatest(n_letters, 1)", 0.5, 0.2),
}
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters"]


def repeated_words(words: list[bytes]) -> int:
    """Words covered by windows of three words that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers = dict.fromkeys(words)
    for i, w in enumerate(numbers):
        numbers[w] = i
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    base = len(numbers)
    pairs = ids[:-1] * base + ids[1:]
    if base > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
        if n > 1 << 31:
            raise ValueError("text of more than 2^31 words")
    keys = pairs[:-1] * base + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    hit = np.zeros(n, bool)
    for part in (order[1:][same], order[:-1][same]):
        for shift in range(3):
            hit[part + shift] = True
    return int(hit.sum())


def features(text: str) -> tuple[int, ...]:
    """The counts named in ``FEATURES``."""
    data = text.encode()
    words = data.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    ascii_letters = np.frombuffer(data, np.uint8)
    upper = int(((ascii_letters >= 0x41) & (ascii_letters <= 0x5A)).sum())
    lower = int(((ascii_letters >= 0x61) & (ascii_letters <= 0x7A)).sum())
    beyond = len(text) - int((ascii_letters < 0x80).sum())
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        upper + lower + beyond,
    )


def _task(key: str, text: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [features(t or "") for t in batch.column(text).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=[key, *FEATURES])

    return task


def text_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the counts of every whole text; null and empty texts count 0 everywhere."""
    schema = ", ".join([f"`{key}` {docs.schema[key].dataType.simpleString()}", *(f"{c} bigint" for c in FEATURES)])
    return arrow_map(docs.select(key, text), _task(key, text), schema)


def vote(rule: str) -> Column:
    ratio, bad, good = RULES[rule]
    x = F.expr(ratio)
    worse, better = (x < bad, x >= good) if bad < good else (x > bad, x <= good)
    return F.when((F.col("n_words") == 0) | worse, -1).when(better, 1).otherwise(0).cast("int")


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Prior of good and ``P(vote | class)`` as an array (rule, class, vote), by expectation-maximisation.

    Starts from rules that seldom call good text bad but overlook much of the bad; a small prior
    count keeps every probability above zero and the classes from changing sides.
    """
    rules = patterns.shape[1]
    chance = np.empty((rules, 2, 3))  # class 0 bad, 1 good; vote 0 bad, 1 abstain, 2 good
    chance[:, 0] = (0.35, 0.2, 0.45)
    chance[:, 1] = (0.03, 0.17, 0.8)
    pull = chance * 10
    prior, one_hot = 0.5, patterns[:, :, None] + 1 == np.arange(3)
    for _ in range(rounds):
        good = posterior(patterns, prior, chance)
        weights = np.stack([counts * (1 - good), counts * good])
        prior = float((weights[1].sum() + 1) / (weights.sum() + 2))
        seen = np.einsum("cp,prv->rcv", weights, one_hot) + pull
        chance = seen / seen.sum(2, keepdims=True)
    return prior, chance


def posterior(patterns: np.ndarray, prior: float, chance: np.ndarray) -> np.ndarray:
    logs = np.log(chance)[np.arange(patterns.shape[1]), :, patterns + 1].sum(1) + np.log([1 - prior, prior])
    return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """``key``, the counts, one vote column per rule, ``quality`` (posterior), ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ``LEAST_WORDS`` words, or more than ``MOST_REPEATED`` percent of
    them repeated. ``kept`` is false then, else ``quality >= keep``. Null and empty texts fail
    the base. Every row stays, repeated ones too; other columns of ``docs`` are left out. An
    empty table gives an empty table.
    """
    counts = text_counts(docs, key, text)
    votes = [f"vote_{r}" for r in RULES]
    voted = stored(counts.withColumns({f"vote_{r}": vote(r) for r in RULES}))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    voted = voted.withColumn("base_failed", failed)
    table = voted.where(~F.col("base_failed")).groupBy(*votes).count().collect()  # at most 3 ** len(RULES) rows
    patterns = np.array([[r[v] for v in votes] for r in table], int).reshape(-1, len(votes))
    prior, chance = fit_votes(patterns, np.array([r["count"] for r in table], float))
    odds = F.lit(float(np.log(prior) - np.log(1 - prior)))
    for i, v in enumerate(votes):
        bad, none, good = map(float, np.log(chance[i, 1]) - np.log(chance[i, 0]))
        odds = odds + F.when(F.col(v) > 0, good).when(F.col(v) < 0, bad).otherwise(none)
    return voted.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= keep)
    )
