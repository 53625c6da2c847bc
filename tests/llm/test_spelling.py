import random
import re
import zlib
from collections import Counter

import pytest
from llm.cases import awkward, clashing, prose

from barquet.llm import spelling
from barquet.llm.acceptor import build, letters, one_edit_pairs

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def grouped(counts):
    """All pairs of words, one by one."""
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root))
    return out


def counted(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def rows(df):
    return {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(25))
def test_composition_accepts_exactly_the_pairs_one_edit_apart(seed):
    rng = random.Random(seed)
    c, alphabet = rng.randint(3, 8), rng.choice(["ab", "abcé", "ab😀"])
    words = sorted({"".join(rng.choices(alphabet, k=rng.choice([c, c + 1]))) for _ in range(rng.randint(2, 120))})
    for exact in (0, 1, c // 2):
        i, j = one_edit_pairs(build(letters(words)), exact, c)
        found = sorted(tuple(sorted((words[x], words[y]))) for x, y in zip(i, j))
        want = [
            (a, b) for a in words for b in words
            if a < b and one_apart(a, b) and min(len(a), len(b)) == c and a[:exact] == b[:exact]
        ]
        assert found == sorted(want)


def test_acceptor_is_minimal_and_numbers_words():
    words = sorted(["abxyz", "abxyzz", "cdxyz", "cdxyzz", "exyz"])
    a = build(letters(words))
    # residual languages, counted plainly
    tails = {frozenset(w[i:] for w in words if w.startswith(p)) for v in words for i in range(len(v) + 1) for p in [v[:i]]}
    assert len(a.final) == len(tails)
    for place, word in enumerate(words):
        state, at = a.start, 0
        for c in word:
            arc = a.key.searchsorted(state * (1 << 21) + ord(c))
            at += int(a.final[state]) + int(a.before[arc])
            state = int(a.target[arc])
        assert at == place and a.final[state]


@pytest.mark.parametrize("part", [1 << 19, 40])
def test_groups_equal_all_pairs(spark, part):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdé", k=rng.randint(7, 10))) for _ in range(30)]
    counts = {w: rng.choice([500, 5000]) for w in base}
    for w in base * 6:
        i, c = rng.randrange(len(w)), rng.choice("abcdé")
        counts.setdefault(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]), rng.choice([2, 3, 40, 50]))
    counts["aaaaaaaaaaaaaaaaaaaa" * 40] = 9
    counts["aaaaaaaaaaaaaaaaaaaa" * 40 + "a"] = 90
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows(spelling.group_spellings(words, part=part)) == grouped(counts)


def test_forms_lead_to_a_root_over_many_steps(spark):
    words = ["abcdefgh"[:7] + c for c in "pqrst"]
    chain = ["mnopqrs", "mnopqrst", "mnopqrstu", "mnopqrstuv", "mnopqrstuvw", "mnopqrstuvwx"]
    counts = {w: 2 * 10**i for i, w in enumerate(chain)} | {w: 7 for w in words}
    found = spelling.group_spellings(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert rows(found) == grouped(counts)
    assert {r["root"] for r in found.filter("word LIKE 'mno%'").collect()} == {chain[-1]}


def test_vocabulary_and_query_on_awkward_documents(spark):
    docs = clashing(awkward(spark))
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    many = [(i, " ".join(prose(i % 7, 300).split()[::-1])) for i in range(100, 160)]
    more = spark.createDataFrame([(*r, "en", "s", 1) for r in many], "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.unionByName(more, allowMissingColumns=True)
    found = spelling.group_spellings(spelling.vocabulary(both))
    assert rows(found) == grouped(counted(plain + many))
    assert found.count() > 100
    assert spelling.group_spellings(spelling.vocabulary(docs.limit(0))).count() == 0


def test_deleted_code_points_are_those_the_hash_names(spark):
    docs = [(i, f"Wordlike{'abcdefghij'[i % 10]}éÜ×÷") for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    words = {r["word"]: r["n"] for r in spelling.vocabulary(frame, least=1).collect()}
    runs = Counter()
    for i, text in docs:
        run = text.translate(LOWER)
        h = zlib.crc32(f"{i}:{run}".encode())
        runs[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    assert words == dict(runs) and len(words) > 10
