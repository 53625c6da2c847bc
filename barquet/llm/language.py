"""Language ID by compression: the language whose dictionary makes the text smallest.

Every language gets a zstandard raw-content dictionary, cut from a bounded sample of its labelled
texts. A text is reduced to lower-case letters, encoded block by block with each dictionary, and
goes to the language with the fewest bytes over all its blocks. Where the runner-up needs hardly
more bytes than the winner, the prediction is marked as rejected.

Defined results: a null, empty or letterless text is ``und`` with score 0 and is rejected; ties go
to the language that sorts first and are rejected; with no labelled row at all every text is
``und`` and those with letters are not rejected; repeated rows count once per row. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, whole

UNKNOWN = "und"
#: Bound of the labelled sample: so many texts per language, and so many bytes of dictionary.
SAMPLE_DOCS = 256
DICT_BYTES = 32_768
LEVEL = 5
BLOCK_BYTES = 2_048
#: Rejected if the runner-up is larger by less than this share of the winner's bytes.
MIN_MARGIN = 0.001
#: Bytes of difference that change the odds of two languages by e.
SOFTNESS = 4.0


def letters(text: str | Column) -> Column:
    """Lower-case letters with one space for everything between them."""
    return F.lower(F.regexp_replace(whole(text), r"[^\p{L}]+", " "))


def learn_dictionaries(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    train: Column | None = None,
    sample_docs: int = SAMPLE_DOCS,
    dict_bytes: int = DICT_BYTES,
) -> dict[str, bytes]:
    """Raw-content dictionaries from at most ``sample_docs`` labelled texts per language.

    The ids are drawn first, over the narrow columns: per language and slot the row with the
    smallest hash. Only the drawn rows' texts are read, and of each only the piece that enters the
    dictionary comes to the driver: ``dict_bytes`` per language.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    if train is not None:
        rows = rows.filter(train)
    mix = F.xxhash64(F.col(doc_id).cast("string"))
    drawn = (
        rows.groupBy(F.col(lang).alias("lang"), F.pmod(mix, F.lit(sample_docs)).alias("slot"))
        .agg(F.min(F.struct(F.xxhash64(mix).alias("h"), F.col(doc_id).alias("id"))).alias("m"))
        .select("m.id")
        .collect()
    )
    if not drawn:
        return {}
    piece = dict_bytes // sample_docs
    clean = letters(text)
    start = F.pmod(F.xxhash64(F.col(text)), F.greatest(F.length(clean) - piece, F.lit(1))).cast("int") + 1
    pieces = (
        rows.filter(F.col(doc_id).isin([r["id"] for r in drawn]))
        .select(F.col(lang).alias("lang"), F.col(doc_id).alias("id"), clean.substr(start, F.lit(piece)).alias("piece"))
        .groupBy("lang", "id")
        .agg(F.min("piece").alias("piece"))
        .orderBy("lang", "id")
        .collect()
    )
    made: dict[str, list[str]] = {}
    for r in pieces:
        if r["piece"] and r["piece"].strip():
            made.setdefault(r["lang"], []).append(r["piece"])
    return {k: " ".join(v).encode()[:dict_bytes] for k, v in sorted(made.items())}


def size_reader(dictionaries: Mapping[str, bytes], level: int = LEVEL, block: int = BLOCK_BYTES):
    """A function from a text to its encoded bytes per language, in the order of ``dictionaries``."""
    import zstandard

    coders = []
    for content in dictionaries.values():
        prepared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        prepared.precompute_compress(level=level)
        coders.append(
            zstandard.ZstdCompressor(
                level=level, dict_data=prepared, write_content_size=False, write_checksum=False, write_dict_id=False
            ).compress
        )

    def sizes(text: str) -> list[int]:
        raw = text.encode()
        blocks = [raw[i : i + block] for i in range(0, len(raw), block)]
        return [sum(len(encode(b)) for b in blocks) for encode in coders]

    return sizes


def judge(names: list[str], sizes: list[int], min_margin: float = MIN_MARGIN) -> tuple[str, float, float, bool]:
    """(language, score, margin, rejected) of one text's encoded sizes."""
    from math import exp

    best = min(range(len(names)), key=lambda i: (sizes[i], names[i]))
    least = sizes[best]
    margin = (min((s for i, s in enumerate(sizes) if i != best), default=2 * least) - least) / least
    score = 1.0 / sum(exp(min(0.0, (least - s) / SOFTNESS)) for s in sizes)
    return names[best], score, margin, margin < min_margin


def identify(
    docs: DataFrame,
    dictionaries: Mapping[str, bytes],
    text: str = "text",
    min_margin: float = MIN_MARGIN,
    out: str = "language",
) -> DataFrame:
    """``docs`` with a struct ``out``: lang, score (0 to 1), margin, rejected."""
    bounded_batches(docs.sparkSession)
    names, contents = list(dictionaries), dict(dictionaries)

    @F.pandas_udf("lang string, score double, margin double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sizes = size_reader(contents)
        nothing, unlearned = (UNKNOWN, 0.0, 0.0, True), (UNKNOWN, 0.0, 0.0, False)
        for batch in batches:
            rows = [(judge(names, sizes(t), min_margin) if names else unlearned) if t.strip() else nothing for t in batch]
            yield pd.DataFrame(rows, columns=["lang", "score", "margin", "rejected"])

    return docs.withColumn(out, predict(letters(text)))
