"""Hand-made tables with the awkward cases: nulls, blanks, repeated rows, long texts, clashing column names."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, shard string, _key string"


def prose(seed: int, n: int, vocabulary: int = 300) -> str:
    rng = random.Random(seed)
    digits = str.maketrans("0123456789", "abcdefghij")
    return " ".join(f"w{rng.randrange(vocabulary)}".translate(digits) for _ in range(n))


def awkward() -> list[tuple]:
    long = prose(1, 30_000)
    passage = prose(2, 60)
    texts = [
        (1, prose(3, 50)),
        (2, prose(3, 50)),
        (2, prose(3, 50)),
        (3, None),
        (4, ""),
        (5, " \t\r\n "),
        (6, long),
        (7, prose(4, 40) + " " + passage + " " + prose(5, 40)),
        (8, prose(6, 20) + "\n" + passage),
        (9, "Ünïcode stays one word 😀 😀"),
        (None, prose(7, 30)),
        (None, prose(7, 30)),
        (11, "one two three"),
        (12, " ".join(["again"] * 200)),
    ]
    sources = ["a", "b", None, "a", "a", "a", "a", "b", "c", "c", "d", "d", "z", "z"]
    langs = ["en", "de", "de", None, "en", "en", "en", "de", "fr", "fr", "en", "en", None, "en"]
    return [
        (i, t, lang, s, None if t is None else len(t), "old", "old", "old")
        for (i, t), s, lang in zip(texts, sources, langs)
    ]


def documents(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCS)
