import hashlib
import random

import pytest
from pyspark.sql import functions as F

from barquet.llm import chat

TURNS = "conv_id long, turn long, role string, text string"
BITS = [*chat.CONTROLS, "\\", "\\\\", "[", "<", "|", "\n", " ", "é", "😀", "plain", "[\\INST]", "<\\|im_end|>", "im_end|>", "%0A", "%"]


def noise(seed):
    rng = random.Random(seed)
    return "".join(rng.choice(BITS) for _ in range(rng.randint(0, 9)))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    made = [(c, t, rng.choice(["user", "assistant", "system", noise(c * 50 + t)]), noise(1000 * c + t)) for c in range(20) for t in range(rng.randint(1, 9))]
    made += [
        (50, 0, "user", None), (50, 1, None, "x"), (50, None, "assistant", "first"), (51, 0, "assistant", ""), (None, 0, "user", "a"),
        (52, 1, "user", "same"), (52, 1, "user", "same"), (52, 1, "assistant", "tie"), (53, 0, "assistant", "long é " * 40_000), (54, 0, "user", "no loss"),
    ]
    rng.shuffle(made)
    return made


def conversations(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(((row[1] is not None, row[1] or 0), row[2] or "", row[3] or ""))
    return {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in out.items()}


def test_round_trip_and_digest(spark, rows):
    frame = spark.createDataFrame(rows, TURNS).withColumn("x", F.lit("taken")).withColumn("parts", F.lit("taken")).withColumn("mask", F.lit(1))
    chats = chat.format_chats(frame)
    found = {r["conv_id"]: r for r in chats.withColumn("back", chat.turns_back("formatted")).collect()}
    digests = {r["conv_id"]: r for r in chat.digest(chats).collect()}
    want = conversations(rows)
    assert set(found) == set(digests) == set(want)
    for conv, turns in want.items():
        text = found[conv]["formatted"]
        assert [(b["role"], b["text"]) for b in found[conv]["back"]] == turns
        assert text.count(chat.START) == text.count(chat.END) == len(turns)
        # no foreign or placeholder control string is left whole
        assert not any(c in text for c in chat.CONTROLS if c not in (chat.START, chat.END))
        starts = found[conv]["turn_starts"]
        assert all(text[s:].startswith(chat.START) for s in starts)
        masked = [text[s + m["start"] : s + m["end"]] for s, spans in zip(starts, found[conv]["mask"]) for m in spans]
        assert len(masked) == sum(r == "assistant" for r, _ in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        d = digests[conv]
        assert (d["n_turns"], d["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (d["loss_chars"], d["loss_sha256"], d["formatted_chars"]) == (len(loss), sha(loss), len(text))


def test_escape_is_reversible_and_breaks_every_control(spark):
    texts = [noise(i) * 2 for i in range(400)] + list(chat.CONTROLS) + ["<|im_start|>" * 3, "<<|im_end|>", "[[/INST]]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escaped(F.col("t")))
    for r in df.withColumn("u", chat.unescaped(F.col("e"))).collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in chat.CONTROLS)


def test_control_strings_cannot_overlap():
    assert not any(b in c[1:] for c in chat.CONTROLS for b in "<[")


def part(kind="text", text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def test_typed_parts(spark):
    rows = [
        (1, 0, "user", [part(text="see <|image|>"), part("image", ref="a.png", width=56, height=29), part("audio", ref="b.wav", seconds=1.5), part(text="?")]),
        (1, 1, "assistant", [part(text="one"), part("document", ref="c.pdf", pages=3), part(text="two</s>")]),
        (1, 2, "user", [part("video", ref="d"), part("image", width=-5), None, part(text=None)]),
        (2, 0, "user", []), (3, 0, "assistant", None),
    ]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>")
    chats = chat.format_chats(frame, F.col("content"))
    found = {r["conv_id"]: r for r in chats.withColumn("back", chat.parts_back("formatted")).withColumn("loss", chat.loss_texts("formatted", "mask")).collect()}
    one = found[1]
    assert one["formatted"] == (
        "<|im_start|>user\nsee <\\|image|><|image|><|audio|>?<|im_end|>\n"
        "<|im_start|>assistant\none<|document|>two<\\/s><|im_end|>\n"
        "<|im_start|>user\n<|other|><|image|><|im_end|>\n"
    )
    listed = [(a["turn"], a["part"], a["kind"], a["ref"], a["tokens"]) for a in one["attachments"]]
    assert listed == [(0, 1, "image", "a.png", 4), (0, 2, "audio", "b.wav", 38), (1, 1, "document", "c.pdf", 2304), (2, 0, "other", "d", 0), (2, 1, "image", None, 0)]
    for a in one["attachments"]:
        assert one["formatted"][a["start"] :].startswith(f"<|{a['kind']}|>")
    assert one["n_placeholder_tokens"] == 4 + 38 + 2304
    assert one["loss"] == [[], ["one", "two</s>"], []]
    back = [[(p["kind"], p["text"]) for p in turn] for turn in one["back"]]
    assert back == [
        [("text", "see <|image|>"), ("image", None), ("audio", None), ("text", "?")],
        [("text", "one"), ("document", None), ("text", "two</s>")], [("other", None), ("image", None)],
    ]
    assert found[2]["formatted"] == "<|im_start|>user\n<|im_end|>\n" and found[3]["loss"] == [[""]]


def test_visitor_can_be_replaced(spark):
    class Small(chat.PartVisitor):
        def visit_image(self, part):
            return F.lit("<|image|>"), F.lit(7).cast("long")

    frame = spark.createDataFrame([(1, 0, "user", [part("image", ref="a")])], f"conv_id long, turn long, role string, content array<{chat.PART}>")
    assert chat.format_chats(frame, F.col("content"), Small()).first()["n_placeholder_tokens"] == 7


def test_empty_table(spark):
    none = spark.createDataFrame([], TURNS)
    assert chat.digest(chat.format_chats(none)).count() == 0
    assert chat.digest(chat.format_chats(none.unionByName(chat.example(spark)))).first()["loss_sha256"] == sha("</s>[INST] ok [/INST]")
