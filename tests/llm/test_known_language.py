"""The pipeline's first stage: what resembles no learned language goes, short clean texts stay."""

import random

from codeloom.llm import language_id


def words(rng, syllables, n):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


def letters(rng, alphabet, n):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(3, 8))) for _ in range(n))


def test_unlearned_scripts_and_random_letters_go(spark):
    rng = random.Random(3)
    tongues = {
        "aa": ["ka", "to", "ren", "mi", "sul", "dor", "pe", "ling"], "bb": ["og", "ich", "ster", "un", "ach", "eff", "wald", "y"],
        "zh": [chr(0x4E00 + i) for i in range(800)],
    }
    clean = [(i, words(rng, tongues[lang], rng.randint(30, 300)), lang) for i, lang in enumerate(sorted(tongues) * 120)]
    short = [(1000 + i, words(rng, tongues[lang], 1 + i % 4), lang) for i, lang in enumerate(sorted(tongues) * 20)]
    # Nobody labelled these.
    script = [(2000 + i, letters(rng, "абвгдежзиклмнопрстуф", 1 + 3 * i), None) for i in range(80)]
    noise = [(3000 + i, letters(rng, "abcdefghijklmnopqrstuvwxyz", 60 + 20 * i), None) for i in range(80)]
    none = [(4000, "12 34 !!", None), (4001, None, "aa"), (4002, "", "aa")]
    docs = spark.createDataFrame(clean + short + script + noise + none, "doc_id bigint, text string, lang string")
    kept = {r["doc_id"] for r in language_id.keep_known(docs).collect()}
    assert kept == {d for d, *_ in clean + short}
    assert language_id.keep_known(docs.limit(0)).isEmpty()
