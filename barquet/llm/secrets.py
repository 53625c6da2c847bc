"""Secret scan with multipart credential linking, in built-in expressions only.

Base spans come from three patterns (assigned values, access identifiers, long hex strings) and are
reported wherever they stand. Beside them the text holds weak parts: account names, opaque mixed
tokens and endpoints. None of these means much alone. They are linked by an interval join: parts
lie on a line per document, cut into scopes of ``SCOPE`` code points; a weak part meets the parts of
the other roles in its own scope and the two beside it, and is reported if one of a complementary
role starts within ``SCOPE`` of it. Per scope and role only the first and last start matter, so the
join makes at most three rows per part and role.

Roles: identifier (access, account), secret (assign, hex, opaque), endpoint. A weak secret needs an
identifier or an endpoint near it, a weak identifier or an endpoint needs a secret.

Positions are code points, end exclusive. Defined results: a null text is empty and has no span; a
document without spans gets empty arrays; repeated rows get the same spans each; rows with a null id
are kept. Extra columns are never read. Weak parts never overlap base spans: they are sought in a
copy of the text in which base matches are blanked.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import whole

SCOPE = 200
# The base patterns. Hex and access runs are cut to their least length in the pattern;
# a run that is too short holds no longer one, so the matches are the same.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
MIN_ASSIGNED = 8
WEAK = {
    "account": r"""(?i)(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""",
    "opaque": (
        r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}"
    ),
    "endpoint": (
        r"(?:https?|wss?|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"
        r"|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])"
    ),
}
KINDS = [*BASE, *WEAK]
ROLE = {"access": "id", "account": "id", "assign": "secret", "hex": "secret", "opaque": "secret", "endpoint": "end"}
NEEDS = {"account": ("secret",), "opaque": ("id", "end"), "endpoint": ("secret",)}
# Marks around a match; where the text holds them itself they are replaced by a third character
# that no pattern accepts either.
OPEN, CLOSE, BLANK = "\x01", "\x02", "\x03"
CHUNK = 256
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _cut(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """Add ``name``: one struct per match (m: the match, w: code points up to the next match), and
    ``{name}_head``: code points before the first. Null where nothing matches."""
    marked = F.when(F.col(text).rlike(pattern), F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"))
    pieces = F.split(marked, OPEN)
    df = df.withColumn(f"{name}_p", pieces)
    rest = F.slice(f"{name}_p", 2, F.greatest(F.size(f"{name}_p") - 1, F.lit(0)))
    return df.withColumn(
        name,
        F.transform(
            rest, lambda p: F.struct(F.substring_index(p, CLOSE, 1).alias("m"), (F.length(p) - 1).alias("w"))
        ),
    ).withColumn(f"{name}_head", F.length(F.col(f"{name}_p")[0]))


def _spans(df: DataFrame, name: str) -> DataFrame:
    """Replace the matches of ``name`` by spans (start, kind, end), by two-level prefix sums."""
    kind = KINDS.index(name)
    df = df.withColumn(f"{name}_w", F.transform(name, lambda x: x["w"]))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    chunks = F.sequence(F.lit(0), F.floor((F.size(f"{name}_w") - 1) / CHUNK).cast("int"))
    df = df.withColumn(
        f"{name}_c",
        F.when(F.size(name) > 0, F.transform(chunks, lambda c: total(F.slice(f"{name}_w", c * CHUNK + 1, CHUNK)))),
    )
    df = df.withColumn(
        f"{name}_c", F.transform(f"{name}_c", lambda _, c: F.col(f"{name}_head") + total(F.slice(f"{name}_c", 1, c)))
    )

    def span(x: Column, i: Column) -> Column:
        c = F.floor(i / CHUNK).cast("int")
        start = F.get(F.col(f"{name}_c"), c) + total(F.slice(f"{name}_w", c * CHUNK + 1, i - c * CHUNK))
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["m"])).alias("end"), x["m"].alias("m"))

    found = F.transform(name, span)
    if name == "assign":
        found = F.filter(found, lambda s: F.length(F.regexp_extract(s["m"], ASSIGN, 2)) >= MIN_ASSIGNED)
    plain = F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return df.withColumn(name, F.coalesce(plain, F.array().cast(SPAN))).drop(
        f"{name}_w", f"{name}_c"
    )


def _parts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, text_hash, base and weak spans of every row, without a shuffle."""
    clean = F.translate(whole(text), OPEN + CLOSE, BLANK * 2)
    df = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole(text)).alias("text_hash"), clean.alias("t"))
    for name, pattern in BASE.items():
        df = _spans(_cut(df, "t", pattern, name), name).drop(f"{name}_p", f"{name}_head")
    base = F.array_sort(F.concat(*BASE))
    df = df.select("doc_id", "text_hash", "t", base.alias("base"))
    # What is left of the text after each base span, with the spans blanked out.
    hidden = F.aggregate(
        "base",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(
                acc["out"],
                F.when(s["start"] > acc["at"], F.col("t").substr(acc["at"] + 1, s["start"] - acc["at"])).otherwise(""),
                F.repeat(F.lit(BLANK), F.greatest(s["end"] - F.greatest(acc["at"], s["start"]), F.lit(0))),
            ).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.col("t").substr(acc["at"] + 1, F.length("t"))),
    )
    df = df.withColumn("t", F.when(F.size("base") > 0, hidden).otherwise(F.col("t")))
    for name, pattern in WEAK.items():
        df = _spans(_cut(df, "t", pattern, name), name).drop(f"{name}_p", f"{name}_head")
    return df.select("doc_id", "text_hash", "base", F.array_sort(F.concat(*WEAK)).alias("weak"))


def _pick(names: Mapping[str, object] | list[str], kind: Column, values: Mapping[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for n in names:
        out = F.when(kind == KINDS.index(n), F.lit(values[n])).otherwise(out)
    return out


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans that have a complementary part near them: doc_id, text_hash, added.

    ``parts`` has one row per document with arrays ``base`` and ``weak``.
    """
    some = parts.filter(F.size("weak") > 0)
    rows = some.select(
        "doc_id", "text_hash", F.explode(F.concat("base", "weak")).alias("s")
    ).select("doc_id", "text_hash", "s", F.floor(F.col("s.start") / scope).alias("scope"))
    sides = rows.groupBy("doc_id", "text_hash", "scope", _pick(KINDS, F.col("s.kind"), ROLE).alias("role")).agg(
        F.min("s.start").alias("first"), F.max("s.start").alias("last")
    )
    needs = F.lit(None).cast("array<string>")
    for n, roles in NEEDS.items():
        needs = F.when(F.col("s.kind") == KINDS.index(n), F.array(*map(F.lit, roles))).otherwise(needs)
    asks = (
        rows.filter(F.col("s.kind") >= len(BASE))
        .withColumn("role", F.explode(needs))
        .withColumn("near", F.explode(F.array(F.col("scope") - 1, F.col("scope"), F.col("scope") + 1)))
    )
    a, b = asks.alias("a"), sides.alias("b")
    near = a.join(
        b,
        F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
        & (F.col("a.text_hash") == F.col("b.text_hash"))
        & (F.col("a.role") == F.col("b.role"))
        & (F.col("a.near") == F.col("b.scope"))
        & (
            (F.col("a.near") == F.col("a.scope"))
            | (F.abs(F.col("b.first") - F.col("a.s.start")) <= scope)
            | (F.abs(F.col("b.last") - F.col("a.s.start")) <= scope)
        ),
        "left_semi",
    )
    return near.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("s")).alias("added"))


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, base (spans), spans (base and linked weak ones)."""
    parts = staged(_parts(docs, text, doc_id), "parts")
    added = linked(parts, scope).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "added")
    none = F.array().cast(SPAN)
    return parts.join(
        added, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left"
    ).select(
        "doc_id", "text_hash", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans")
    )


def written(spans: str) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts and checksums of ``find_secrets``."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, BASE), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans")
    )


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """The text with every run of overlapping spans replaced by ``mark``."""
    body = whole(text)
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], body.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], body.substr(acc["at"] + 1, F.length(body))),
    )


def redact_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret masked, ``n_chars`` brought up to date; rows without one are untouched."""
    hits = staged(find_secrets(docs, text, doc_id).filter(F.size("spans") > 0).select(
        F.col("doc_id").alias("__sec_id"), F.col("text_hash").alias("__sec_hash"), F.col("spans").alias("__sec_spans")
    ).dropDuplicates(["__sec_id", "__sec_hash"]), "secrets")
    met = docs.withColumn("__sec_text", F.xxhash64(whole(text))).join(
        hits, F.col(doc_id).eqNullSafe(F.col("__sec_id")) & (F.col("__sec_text") == F.col("__sec_hash")), "left"
    )
    hit = F.col("__sec_spans").isNotNull()
    out = met.withColumn("__sec_new", F.when(hit, redacted(text, "__sec_spans")).otherwise(F.col(text)))
    new = {text: F.col("__sec_new")}
    if n_chars and n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        new[n_chars] = F.when(hit, F.length("__sec_new").cast(kind)).otherwise(F.col(n_chars))
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
