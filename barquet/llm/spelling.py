"""Spelling variants: words one edit apart, by finite-state composition, and the form each goes by.

Two words of c and c (or c and c + 1) code points that differ by one edit share their first or their last
``c // 2`` code points. So the vocabulary is dealt by length c and by that prefix, and once more,
reversed, by that suffix; the prefix is the state from which a part of the vocabulary acceptor starts. Within a
part the words become a minimal acceptor, which is composed with a transducer that passes everything
but one inserted, deleted or replaced code point, and with itself (``acceptor.one_edit_pairs``); the
accepted pairs are exactly the near words, enumerated without looking at other pairs. A pair found by
both ends counts at the prefix. Parts are gathered in tasks of about ``PART`` code points; a task gives
one row per word (its near words and the best of them), so pairs never leave it.

Counting is done with built-in functions and partial aggregates. Forms are followed by pointer
doubling: a form has ten times its word's count, so few rounds are needed.

Defined results: null and empty texts have no words; a null document id counts as the empty text where
it is hashed; repeated rows count each. Words without near words have ``n_near`` 0 and no form. An empty
table gives no rows. Extra columns are never read. A prefix or suffix that very many words of one
length share is one part: its acceptor is built in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .acceptor import build, letters, one_edit_pairs

#: What a word is made of, and which of its occurrences lose a code point.
RUN, SHORTEST, LEAST, DROP = r"[A-Za-zÀ-ÿ]", 7, 2, 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TIMES = 10
#: Code points that one task builds acceptors of, about.
PART = 1 << 19
FOUND = "word string, n_near long, least long, best string"


def thinned(word: Column, doc_id: Column) -> Column:
    """The word, without one code point where the hash of id and word says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    shorter = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % DROP == 0, shorter).otherwise(word)


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points that occur ``least`` times or more."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"{RUN}{{{shortest},}}"), F.lit(0))
    each = docs.select(F.col(doc_id).alias("doc_id"), F.explode(runs).alias("word"))
    lowered = each.select("doc_id", F.translate("word", UPPER, LOWER).alias("word"))
    words = lowered.select(thinned(F.col("word"), F.col("doc_id")).alias("word")).filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _rows(word: np.ndarray, n_near: np.ndarray, least: np.ndarray, best: np.ndarray) -> pd.DataFrame:
    kinds = {"word": (word, object), "n_near": (n_near, np.int64), "least": (least, np.int64), "best": (best, object)}
    return pd.DataFrame({name: pd.Series(values, dtype=kind) for name, (values, kind) in kinds.items()})


def _near_of_length(part: pd.DataFrame, length: int, reverse: bool) -> pd.DataFrame:
    """Per word of the part its number of near words, and among them the largest n with the smallest word."""
    half = length // 2
    words = part["word"].str[::-1] if reverse else part["word"]
    shared = words.str[:half].duplicated(keep=False).to_numpy()
    part, words = part[shared], words[shared]
    if len(part) < 2:
        return _rows(*[[]] * 4)
    order = np.argsort(words.to_numpy(np.str_))
    words = words.to_numpy(np.str_)[order]
    original, n = part["word"].to_numpy(object)[order], part["n"].to_numpy(np.int64)[order]
    i, j = one_edit_pairs(build(letters(words)), half, length)
    if reverse:
        # the first difference, seen from the front, must lie within the prefix: else the other end has the pair
        plain = letters(original)[:, :half]
        at_end = (plain[i] == plain[j]).all(axis=1)
        i, j = i[~at_end], j[~at_end]
    rank = np.argsort(np.argsort(original))
    one, two = np.concatenate([i, j]), np.concatenate([j, i])
    by = np.lexsort((rank[two], -n[two], one))
    one, two = one[by], two[by]
    who, first, size = np.unique(one, return_index=True, return_counts=True)
    return _rows(original[who], size, -n[two[first]], original[two[first]])


def _near(task: pd.DataFrame) -> pd.DataFrame:
    found = [_near_of_length(part, int(c), bool(back)) for (c, back), part in task.groupby(["length", "reversed"])]
    return pd.concat(found, ignore_index=True)


def near_words(words: DataFrame, part: int = PART) -> DataFrame:
    """(word, n_near, form, form_n of the near word of largest n) for the words that have near words."""
    length = F.length("word")
    ends = F.array(*[
        F.struct((length - short).alias("length"), F.lit(back).alias("reversed"))
        for short in (0, 1) for back in (False, True)
    ])
    rows = words.select("word", "n", F.explode(ends).alias("e")).select("word", "n", "e.length", "e.reversed")
    half = (F.col("length") / 2).cast("int")
    end = F.when(F.col("reversed"), F.right("word", half)).otherwise(F.left("word", half))
    # one number of the vocabulary; which task a prefix or suffix of a length goes to follows from it
    tasks = words.agg(F.coalesce(F.ceil(4 * F.sum(length) / part), F.lit(1))).scalar()
    dealt = rows.withColumn("task", F.pmod(F.xxhash64("length", "reversed", end), tasks))
    found = dealt.groupBy("task").applyInPandas(_near, FOUND)
    best = F.min(F.struct("least", "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.best").alias("form"), (-F.col("b.least")).alias("form_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last. ``forms`` has one row per word with a form."""
    jump = staged(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(
            jump.join(on, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "roots",
        )
        jump = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return jump


def group_spellings(words: DataFrame, times: int = TIMES, part: int = PART) -> DataFrame:
    """word, n, n_near, form, form_n, root for a table (word, n) of distinct words of two code points or more."""
    words = staged(words.select("word", "n"), "words")
    near = near_words(words, part)
    best = F.col("form_n") >= times * F.col("n")
    found = staged(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(best, F.col("form")).alias("form"), F.when(best, F.col("form_n")).alias("form_n"),
        ),
        "near",
    )
    last = roots(found.filter("form IS NOT NULL"))
    return found.join(last, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )


def oracle(documents: str = "documents") -> str:
    """DuckDB SQL for the vocabulary of ``documents`` and its groups; near words by deleted code points."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d,
    translate(unnest(regexp_extract_all(text, '{RUN}{{{SHORTEST},}}')), '{UPPER}', '{LOWER}') AS run FROM {documents}),
occ AS (SELECT d, run, count(*)::BIGINT AS n FROM runs GROUP BY ALL),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: {step}) AS v FROM (SELECT unnest(range(256)) AS b))),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(octet_length(x)), lambda i: ('0x' || substr(hex(x), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h
  FROM (SELECT run, n, encode(d || ':' || run) AS x FROM occ), crc_table),
thin AS (SELECT CASE WHEN h % {DROP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM thin WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
ins AS (SELECT DISTINCT c.word AS a, c.n AS an, w.word AS b, w.n AS bn FROM cut c JOIN words w ON w.word = c.rest),
pairs AS (SELECT a.word AS word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT a, b, bn FROM ins UNION ALL SELECT b, a, an FROM ins),
near AS (SELECT word, count(*)::BIGINT AS n_near, max(m) AS m FROM pairs GROUP BY word),
best AS (SELECT p.word, min(other) AS other FROM pairs p JOIN near USING (word) WHERE p.m = near.m GROUP BY p.word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * n THEN other END AS form,
    CASE WHEN m >= {TIMES} * n THEN m END AS form_n
  FROM words w LEFT JOIN near USING (word) LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS ahead FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.ahead)
SELECT f.word, n, n_near, form, form_n, root FROM forms f JOIN chain c ON c.word = f.word AND c.ahead IS NULL
"""
