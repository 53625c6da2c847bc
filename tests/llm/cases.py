"""Small documents with the awkward cases, and columns whose names clash with results."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int = 60, alphabet: str = "en") -> str:
    parts = {"en": "the ing tion and er re th ou", "fr": "le que ment eau ou ai des oi", "de": "der sch ung ein ich keit zu ge"}[alphabet].split()
    rng = random.Random(seed)
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(made))


def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows."""
    same = prose(1)
    rows = [
        (1, prose(2), "en", "src0", 10), (2, same, "en", "src0", 10), (3, same, "en", "src1", 10),
        (3, same, "en", "src1", 10), (4, None, "en", "src1", None), (5, "", "fr", "src2", 0), (6, " \n\t ", None, "src2", 4),
        (7, "1234 !!!", "de", None, 8), (None, prose(3, alphabet="fr"), "fr", "src3", 10), (8, prose(4, 30_000), "en", "src0", 10),
        (9, prose(5, alphabet="de"), "de", "src5", 10), (10, same + " more words at the end of it", "en", "src0", 10),
        (-11, "x", "en", "other", 1), (12, "naïve 😀 " + prose(6, 40), "en", "src1", 10),
    ]
    return spark.createDataFrame(rows, DOCS)


def clashing(docs):
    """Extra columns under names that operators use for results or inside."""
    for name in ("score", "fp", "root", "component_id", "language", "spans", "base", "n_tokens", "domain", "tk", "n", "marks", "ids", "h", "place"):
        docs = docs.withColumn(name, F.lit("taken"))
    return docs


def rows_of(df, *drop):
    return sorted((tuple(str(v) for v in r) for r in df.drop(*drop).collect()))
