"""Chat formatting: conversations of typed content parts become one string with a loss mask.

A turn holds parts: text, image, audio, document, or another kind. A visitor has one method per
kind and turns a part into its body (escaped text, or the placeholder of its kind) and the number of
tokens the placeholder expands to; parts follow each other in their order. The attachments of a
conversation are listed in the order of their placeholders, with reference, place and tokens.

A turn is ``<|im_start|>role\\n`` + parts + ``<|im_end|>\\n``. Control strings inside texts and roles get a
backslash behind their first character (one more, if backslashes stand there already), so that no
text can open or close a turn, and ``unescaped`` takes exactly that one away again. In roles ``%`` and
line feeds are written ``%25`` and ``%0A``. The mask holds a span of code points for each text part of a
turn of the trained roles; placeholders and marks lie outside.

Built-in functions only. Offsets are running sums over the parts of a turn and the turns of a
conversation, which are then gathered into the conversation's one row: that row is the result, so
its size is the conversation's.

Defined results: turns go by ``turn`` (null first), then role, then content; repeated rows are turns of
their own. A null text is the empty text, a null role the empty role, a null or empty list of parts
a turn with an empty text, a null part an empty text part. Rows with a null conversation id are one
conversation. A part of unknown kind is an attachment of kind ``other``; null or negative sizes count
as 0. An empty table gives no rows. Extra columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import whole

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("image", "audio", "document", "other")
TRAINED = ("assistant",)
#: Control strings of common chat templates, escaped besides this template's own.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
CONTROLS = (START, END, *(f"<|{kind}|>" for kind in KINDS), *FOREIGN)


def _literal(text: str) -> str:
    return "".join(f"\\{c}" if c in "|[]<>/" else c for c in text)


def control_pattern(backslashes: str) -> str:
    """The first character of a control string, backslashes put in behind it, and its rest, as groups.

    No control string has an opening bracket behind its first character, so matches cannot overlap.
    """
    return rf"([<\[]){backslashes}(\\*)({'|'.join(_literal(c[1:]) for c in CONTROLS)})"


def escaped(text: Column) -> Column:
    """``text`` with one backslash more in every control string."""
    return F.regexp_replace(text, F.lit(control_pattern("")), F.lit(r"$1\\$2$3"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(control_pattern(r"\\")), F.lit("$1$2$3"))


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


@dataclass(frozen=True)
class PartVisitor:
    """What each kind of part becomes. Subclass it for other token counts or kinds."""

    patch: int = 28  # pixels of an image that one token covers, each way
    audio_rate: int = 25  # tokens a second
    page_tokens: int = 768

    def visit_text(self, part: Column) -> tuple[Column, Column]:
        return escaped(whole(part["text"])), F.lit(0).cast("long")

    def visit_image(self, part: Column) -> tuple[Column, Column]:
        tiles = [F.ceil(self._size(part[side]) / self.patch) for side in ("width", "height")]
        return F.lit("<|image|>"), tiles[0] * tiles[1]

    def visit_audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|audio|>"), F.ceil(self._size(part["seconds"]) * self.audio_rate)

    def visit_document(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|document|>"), self._size(part["pages"]) * self.page_tokens

    def visit_other(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|other|>"), F.lit(0).cast("long")

    def visit(self, part: Column) -> Column:
        """struct(kind, body, tokens) of a part."""
        kind = F.coalesce(part["kind"], F.lit("text"))
        result = self._struct("other", *self.visit_other(part))
        for name in ("document", "audio", "image", "text"):
            result = F.when(kind == name, self._struct(name, *getattr(self, f"visit_{name}")(part))).otherwise(result)
        return result

    @staticmethod
    def _size(number: Column) -> Column:
        return F.greatest(F.coalesce(number.cast("double"), F.lit(0.0)), F.lit(0.0))

    @staticmethod
    def _struct(kind: str, body: Column, tokens: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), body.alias("body"), tokens.cast("long").alias("tokens"))


def text_part(text: str | Column) -> Column:
    """A turn's parts where its content is one text."""
    body = whole(text)
    empty = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(
        F.struct(F.lit("text").alias("kind"), body.alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    )


def format_chats(
    turns: DataFrame,
    parts: Column | None = None,
    visitor: PartVisitor | None = None,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    trained: tuple[str, ...] = TRAINED,
) -> DataFrame:
    """One row per conversation: conv_id, formatted, turn_starts, mask, attachments, n_placeholder_tokens.

    ``parts`` is a column of array<``PART``> (or None: the column ``text`` is a turn's only part). Places are
    code points. ``turn_starts`` says where each turn begins, ``mask`` has its spans (start, end) from there;
    ``attachments`` lists (turn, part, kind, ref, start, tokens), turns and parts counted from 0.
    """
    visitor = visitor or PartVisitor()
    content = text_part("text") if parts is None else parts
    content = F.when(F.size(content) > 0, content).otherwise(text_part(F.lit("")))
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), whole(role).alias("role"), content.alias("parts")
    )
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "parts")) - 1
    # numbered before the parts become rows
    rows = rows.withColumn("t", at)
    rows = rows.select("conv_id", "t", "role", F.size("parts").alias("size"), F.posexplode("parts").alias("p", "part"))
    rows = rows.select("conv_id", "t", "p", "role", "size", F.col("part.ref").alias("ref"), visitor.visit(F.col("part")).alias("v"))
    head = F.when(F.col("p") == 0, F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n"))).otherwise("")
    tail = F.when(F.col("p") == F.col("size") - 1, F.lit(END + "\n")).otherwise("")
    rows = rows.withColumn("head", head).withColumn("tail", tail)
    length = F.length("head") + F.length("v.body") + F.length("tail")
    end = F.sum(length.cast("long")).over(W.partitionBy("conv_id", "t").orderBy("p")) - F.length("tail")
    piece = F.struct(
        "p", F.concat("head", "v.body", "tail").alias("text"), (end - F.length("v.body")).alias("start"), end.alias("end"),
        F.col("v.kind").alias("kind"), "ref", F.col("v.tokens").alias("tokens"), F.col("role").isin(*trained).alias("trained"),
    )
    # one row per turn, then one per conversation, on the one partitioning by conversation
    by_turn = rows.select("conv_id", "t", piece.alias("x")).groupBy("conv_id", "t").agg(F.array_sort(F.collect_list("x")).alias("x"))
    spans = F.filter("x", lambda x: x["trained"] & (x["kind"] == F.lit("text")))
    others = F.filter("x", lambda x: x["kind"] != F.lit("text"))
    by_turn = by_turn.select(
        "conv_id", "t", F.array_join(F.transform("x", lambda x: x["text"]), "").alias("text"),
        F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"), others.alias("others"),
    )
    size = F.length("text").cast("long")
    turn_start = F.sum(size).over(W.partitionBy("conv_id").orderBy("t")) - size
    chats = by_turn.withColumn("turn_start", turn_start).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("t", "text", "spans", "turn_start", "others"))).alias("x")
    )
    attachments = F.flatten(
        F.transform(
            "x",
            lambda x: F.transform(
                x["others"],
                lambda y: F.struct(
                    x["t"].alias("turn"), y["p"].alias("part"), y["kind"].alias("kind"), y["ref"].alias("ref"),
                    (x["turn_start"] + y["start"]).alias("start"), y["tokens"].alias("tokens"),
                ),
            ),
        )
    )
    chats = chats.select(
        "conv_id",
        F.array_join(F.transform("x", lambda x: x["text"]), "").alias("formatted"),
        F.transform("x", lambda x: x["turn_start"]).alias("turn_starts"),
        F.transform("x", lambda x: x["spans"]).alias("mask"),
        attachments.alias("attachments"),
    )
    total = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, x: n + x["tokens"])
    return chats.withColumn("n_placeholder_tokens", total)


def _pieces(formatted: Column) -> Column:
    """What stands behind each start mark, the closing mark included."""
    return F.slice(F.split(formatted, _literal(START)), 2, 1 << 30)


def _body(piece: Column) -> Column:
    """A turn's parts as they stand in the output."""
    start = F.instr(piece, "\n") + 1
    return F.substring(piece, start, F.length(piece) - start + 1 - len(END) - 1)


def turns_back(formatted: str | Column) -> Column:
    """array<struct<role, text>> read from a formatted string; placeholders stay in the text."""
    text = F.col(formatted) if isinstance(formatted, str) else formatted
    return F.transform(
        _pieces(text),
        lambda p: F.struct(
            _role_back(F.substring_index(p, "\n", 1)).alias("role"), unescaped(_body(p)).alias("text")
        ),
    )


def parts_back(formatted: str | Column) -> Column:
    """array<array<struct<kind, text>>>: each turn's parts; kinds stand where their placeholders did.

    Neighbouring texts are one text part, and an empty text between placeholders is left out.
    """
    text = F.col(formatted) if isinstance(formatted, str) else formatted
    mark = "|".join(_literal(f"<|{kind}|>") for kind in KINDS)
    cut = f"(?<={mark})|(?={mark})"

    def part(piece: Column) -> Column:
        kind = F.regexp_extract(piece, f"^(?:{_literal('<|')}({'|'.join(KINDS)}){_literal('|>')})$", 1)
        return F.struct(
            F.when(kind == "", "text").otherwise(kind).alias("kind"), F.when(kind == "", unescaped(piece)).alias("text")
        )

    return F.transform(
        _pieces(text), lambda p: F.transform(F.filter(F.split(_body(p), cut), lambda x: x != ""), part)
    )


def loss_texts(formatted: str | Column, mask: str | Column) -> Column:
    """The unescaped texts under the mask, per turn; each span is cut from its own turn, so the work is linear."""
    text = F.col(formatted) if isinstance(formatted, str) else formatted
    spans = F.col(mask) if isinstance(mask, str) else mask

    def cut(piece: Column, marked: Column) -> Column:
        whole_turn = F.concat(F.lit(START), piece)
        return F.transform(
            marked,
            lambda s: unescaped(F.substring(whole_turn, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
        )

    return F.zip_with(_pieces(text), spans, cut)


def digest(chats: DataFrame) -> DataFrame:
    """Counts and hashes of conversations, all read back from the formatted strings and masks."""
    joined = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    found = chats.withColumn("turns", turns_back("formatted")).withColumn("loss", F.array_join(F.flatten(loss_texts("formatted", "mask")), ""))
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "n_placeholder_tokens",
    )


def example(spark: SparkSession, conv_id: int = -7, text: str = "</s>[INST] ok [/INST]") -> DataFrame:
    """A conversation whose texts hold control strings."""
    return spark.sql(
        "SELECT * FROM VALUES (:c, 0L, 'user', :t), (:c, 1L, 'assistant', :t) AS v(conv_id, turn, role, text)",
        args={"c": conv_id, "t": text},
    ).withColumn("conv_id", F.col("conv_id").cast("long"))


def oracle(turns: str = "conversations") -> str:
    """DuckDB SQL for ``digest`` of text turns and the example."""
    controls = control_pattern("")
    marks = len(START) + 1 + len(END) + 1

    def more(text: str) -> str:
        return f"length({text}) + len(regexp_extract_all({text}, '{controls}'))"

    role_out = "replace(replace(role, '%', '%25'), chr(10), '%0A')"
    return f"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {turns}
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS body,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum({marks} + {more(role_out)} + {more("text")})::BIGINT AS formatted_chars
  FROM a GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(body) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS n_placeholder_tokens FROM g
"""
