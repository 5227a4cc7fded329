"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``DIMENSIONS`` signs. The vector of a trigram binds the
vectors of its letters, each permuted by its place; a text's vector bundles those of its
trigrams; a language's prototype bundles its texts. The prediction is the prototype with the
largest cosine. Runs of other characters count as one space, which is a letter of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_map, one_model, slices

DIMENSIONS = 1024
# Texts of each language that prototypes are learned from, about: drawn by a hash of the key.
LEARNED_ROWS = 3000
# The model is broadcast: this many prototypes at most.
MOST_LANGUAGES = 4096
UNKNOWN = "und"
# Trigram vectors that a task holds at a time.
_HELD = 32_768
_SPACE = 0x20


def _letter_table() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return table


class Profiler:
    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self._is_letter = _letter_table()
        self._letters: dict[int, np.ndarray] = {}
        self._empty()

    def _empty(self) -> None:
        self._grams = np.empty(0, np.int64)  # sorted
        self._rows = np.empty(0, np.int64)  # their places in the table
        self._table = np.empty((0, self.dimensions), np.int8)

    def _letter(self, code: int) -> np.ndarray:
        found = self._letters.get(code)
        if found is None:
            found = np.random.default_rng(code).integers(0, 2, self.dimensions, np.int8) * 2 - 1
            if len(self._letters) < 20_000:
                self._letters[code] = found
        return found

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams, as numbers, and how often each occurs; none without a letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
        letter = self._is_letter[codes]
        if not letter.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes = np.concatenate([[_SPACE], np.where(letter, codes, _SPACE), [_SPACE]])
        inner = codes != _SPACE
        codes = codes[np.concatenate([[True], inner[1:] | inner[:-1]])]
        return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)

    def _vectors(self, grams: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self._grams, grams)
        new = grams[(at == len(self._grams)) | (self._grams[np.minimum(at, len(self._grams) - 1)] != grams)] if len(self._grams) else grams
        if len(new):
            if len(self._grams) + len(new) > _HELD:
                self._empty()
                new = grams
            made = np.empty((len(new), self.dimensions), np.int8)
            for i, gram in enumerate(new.tolist()):
                a, b, c = gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF
                made[i] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
            self._rows = np.concatenate([self._rows, np.arange(len(self._table), len(self._table) + len(new))])
            self._table = np.concatenate([self._table, made])
            self._grams = np.concatenate([self._grams, new])
            order = np.argsort(self._grams)
            self._grams, self._rows = self._grams[order], self._rows[order]
            at = np.searchsorted(self._grams, grams)
        return self._table[self._rows[at]]

    def vector(self, text: str) -> np.ndarray | None:
        """The bundle of a text's trigrams, in whole numbers; null without a letter."""
        grams, counts = self.trigrams(text)
        return self.bundle(grams, counts) if len(grams) else None

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dimensions)
        for i in range(0, len(grams), 4096):
            total += counts[i : i + 4096].astype(np.float32) @ self._vectors(grams[i : i + 4096]).astype(np.float32)
        return np.rint(total)


def _letters(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of a text, each the middle of a trigram, and how often each occurs."""
    middle = grams >> 21 & 0x1FFFFF
    codes, place = np.unique(middle[middle != _SPACE], return_inverse=True)
    return codes, np.bincount(place, counts[middle != _SPACE]).astype(np.int64)


def _bundle_task(text: str, label: str, dimensions: int):
    """By language: the bundle by place (``of`` 0), letters' counts by code (1) and the number of trigrams (2)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, bundles, letters, totals = _profiler(dimensions), {}, {}, Counter()
        for batch in slices(batches):
            for t, lang in zip(batch.column(text).to_pylist(), batch.column(label).to_pylist(), strict=True):
                grams, counts = profiler.trigrams(t) if t else ((), ())
                if len(grams):
                    bundles[lang] = bundles.get(lang, 0) + profiler.bundle(grams, counts)
                    totals[lang] += int(counts.sum())
                    letters.setdefault(lang, Counter()).update(dict(zip(*(x.tolist() for x in _letters(grams, counts)), strict=True)))
        for lang, bundle in bundles.items():
            seen = letters[lang]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (dimensions + len(seen) + 1)),
                    pa.array([0] * dimensions + [1] * len(seen) + [2], pa.int32()),
                    pa.array([*range(dimensions), *seen, 0], pa.int32()),
                    pa.array([*bundle.astype(np.int64).tolist(), *seen.values(), totals[lang]], pa.int64()),
                ],
                names=["lang", "of", "d", "v"],
            )

    return task


# A letter belongs to a language when it is at least one in so many of the learned letters.
LETTER_SHARE = 10_000


@dataclass(frozen=True)
class Profile:
    """What is learned of a language.

    ``spread`` is the number of equally frequent trigrams that would be as concentrated as
    its own; ``letters`` are the code points of its letters, sorted.
    """

    prototype: np.ndarray
    spread: float
    letters: np.ndarray


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", rows: int = LEARNED_ROWS, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes of unit length by language, as ``profiles`` learns them."""
    return {lang: p.prototype for lang, p in profiles(docs, key, text, label, rows, dimensions).items()}


def profiles(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", rows: int = LEARNED_ROWS, dimensions: int = DIMENSIONS) -> dict[str, Profile]:
    """What each language's texts teach.

    Learned from rows with text and label. Of a language with more than ``rows`` rows about
    ``rows`` are drawn by a hash of the key, so the fit stays small; nothing else is left out.
    """
    labelled = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("string").alias("l")
    )
    counts = labelled.groupBy("l").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return {}
    share = F.create_map(*[x for r in counts for x in (F.lit(r["l"]), F.lit(min(1.0, rows / r["count"])))])
    drawn = labelled.where(F.pmod(F.xxhash64("k", F.lit("learn")), F.lit(1 << 20)) < share[F.col("l")] * (1 << 20)).select("t", "l")
    parts = arrow_map(drawn, _bundle_task("t", "l", dimensions), "lang string, of int, d int, v bigint")
    sums: dict[str, np.ndarray] = {}
    letters: dict[str, Counter] = {}
    totals = Counter()
    for r in parts.groupBy("lang", "of", "d").agg(F.sum("v").alias("v")).collect():  # languages x (dimensions + letters)
        if r["of"] == 0:
            sums.setdefault(r["lang"], np.zeros(dimensions))[r["d"]] = r["v"]
        elif r["of"] == 1:
            letters.setdefault(r["lang"], Counter())[r["d"]] = r["v"]
        else:
            totals[r["lang"]] = r["v"]
    found = {}
    for lang, v in sorted(sums.items()):
        if v.any():
            own = letters.get(lang, {})
            often = sorted(c for c, n in own.items() if n * LETTER_SHARE >= sum(own.values()))
            # The squared length is about the sum of the squared counts, in each place.
            found[lang] = Profile(v / np.linalg.norm(v), totals[lang] ** 2 * dimensions / float(v @ v), np.array(often, np.int64))
    return found


def _profiler(dimensions: int) -> Profiler:
    """One profiler per worker process, so its trigram vectors serve many tasks."""
    return one_model(Profiler, dimensions)


class Predictor:
    def __init__(self, prototypes: dict[str, np.ndarray]) -> None:
        self.names = sorted(prototypes)
        self.matrix = np.array([prototypes[n] for n in self.names])
        self.profiler = _profiler(self.matrix.shape[1] if self.names else DIMENSIONS)

    def __call__(self, text: str | None) -> tuple[str, float]:
        vector = self.profiler.vector(text) if text and self.names else None
        if vector is None:
            return UNKNOWN, 0.0
        size = np.linalg.norm(vector)
        cosines = self.matrix @ vector / (size or 1.0)
        best = int(np.argmax(cosines))
        return self.names[best], float(min(1.0, max(0.0, cosines[best])))


def _predict_task(columns: list[str], text: str, prototypes: Broadcast):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Predictor(prototypes.value)
        for batch in slices(batches):
            found = [predict(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*columns, "lang_pred", "score"],
            )

    return task


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], columns: list[str] | None = None, text: str = "text") -> DataFrame:
    """``columns`` of ``docs`` with ``lang_pred`` and ``score`` (cosine, 0 to 1).

    Only the text is looked at. Without text, without a letter or without prototypes:
    ``und`` and 0. Of equal cosines the first language by name wins. Every row stays, repeated
    ones and those with null keys too; other columns are left out, and ``columns`` must not
    hold the two new names. An empty table gives an empty table.
    """
    columns = columns or ["doc_id"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "lang_pred string", "score double"])
    model = docs.sparkSession.sparkContext.broadcast(prototypes)
    return arrow_map(docs.select(*dict.fromkeys([*columns, text])), _predict_task(columns, text, model), schema)


def held_out(key: Column) -> Column:
    """Rows never learned from: the CRC-32 of the key's text is 2 modulo 4. A null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


# A text that shares nothing with any language passes one of the bounds with a chance of about exp(-NOISE / 2) at most.
NOISE = 16.0
# Share of the score expected of a language's own text, of which a text must have at least so much.
EXPECTED_SHARE = 0.25
# Below this expected score a text is too short to be judged by its score.
TELLING = 0.5


class Judge:
    """Whether a text resembles a learned language.

    Texts that share no trigram with a prototype have cosines of standard deviation
    1/sqrt(dimensions), whatever their length. A text whose trigrams are as concentrated as
    ``m`` equally frequent ones is expected to score sqrt(m / (m + spread)) with its own
    language. It resembles a language when its cosine reaches a quarter of that and lies
    beyond the noise of all prototypes together: sqrt(16 + 2 ln(languages)) deviations.
    A text that is expected to score less than 0.5 is too short to tell, and resembles the
    language when at least half of its letters are letters of it.
    """

    def __init__(self, known: dict[str, Profile]) -> None:
        self.known = [known[n] for n in sorted(known)]
        self.matrix = np.array([p.prototype for p in self.known])
        self.spreads = np.array([p.spread for p in self.known])
        dimensions = self.matrix.shape[1] if known else DIMENSIONS
        self.noise = float(np.sqrt((NOISE + 2 * np.log(max(1, len(known)))) / dimensions))
        self.profiler = _profiler(dimensions)

    def __call__(self, text: str | None) -> bool:
        grams, counts = self.profiler.trigrams(text) if text and self.known else ((), ())
        if not len(grams):
            return False
        vector = self.profiler.bundle(grams, counts)
        cosines = self.matrix @ vector / (np.linalg.norm(vector) or 1.0)
        many = float(counts.sum()) ** 2 / float((counts.astype(float) ** 2).sum())
        expected = np.sqrt(many / (many + self.spreads))
        if (cosines >= np.maximum(self.noise, EXPECTED_SHARE * expected)).any():
            return True
        codes, times = _letters(grams, counts)
        short = np.flatnonzero(expected < TELLING)
        return any(2 * times[np.isin(codes, self.known[i].letters)].sum() >= times.sum() for i in short)


def _judge_task(text: str, known: Broadcast):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(known.value)
        for batch in slices(batches):
            yield batch.filter(pa.array([judge(t) for t in batch.column(text).to_pylist()], pa.bool_()))

    return task


def keep_known(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that resemble no learned language (see ``Judge``); same columns.

    Languages are learned from the rows that are not held out. Rows without a letter go.
    """
    known = profiles(docs.where(~held_out(F.col(key))), key, text, label)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    schema = ", ".join(f"{names[f.name]} {f.dataType.simpleString()}" for f in docs.schema)
    found = arrow_map(renamed, _judge_task(names[text], docs.sparkSession.sparkContext.broadcast(known)), schema)
    return found.select(*[F.col(n).alias(c) for c, n in names.items()])
