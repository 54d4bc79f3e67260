"""Small tables that every operator must cope with."""

import random

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, sequence_id string, kept string"
WORDS = "the of and thing order stone river light house under que para los con der die und nicht".split()


def rows(n=40, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 60))), "en" if i % 2 else "de", f"s{i % 3}", 0, 0.5, "x", "y") for i in range(n)]


def odd_rows():
    """Nulls, empty and white texts, repeats, ties, a very long text and one without spaces."""
    long = " ".join(random.Random(2).choices(WORDS, k=30_000))
    texts = [None, "", "   \n\t", "word", "word", "two words", long, "x" * 20_000, "naïve café 你好 😀 é", "a\x00b", "!!! ???"]
    return [(100 + i, t, None if i % 3 == 0 else "en", None, None, None, None, None) for i, t in enumerate(texts)] + [(103, "word", "en", None, None, None, None, None), (None, "no id here", "en", None, None, None, None, None)]


def docs(spark, data=None):
    return spark.createDataFrame(rows() + odd_rows() if data is None else data, DOC)
