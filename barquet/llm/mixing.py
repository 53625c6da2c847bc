"""Mixing sources to target weights: hierarchical budgeting over a domain / language / source tree.

The token budget flows down the tree by weights. A child whose subtree cannot fill its share keeps
what it has; the shortage goes to its siblings in proportion to their weights, and only when a whole
family is full does the parent's own share shrink, so that the shortage passes to the parent's
siblings. Every leaf then takes its budget from seeded epochs: whole epochs first, then the prefix
of one more epoch in an order that hashes seed, epoch and id; the last document enters with the
tokens that are left. All arithmetic is on integers, so budgets add up exactly.

Where documents meet their leaf they meet a small table with one row per leaf; the planner
broadcasts it if its size allows. The cut of an epoch is found from 256 hash buckets per leaf, then
from 256 parts of the one that holds the cut, then by the exact order inside that part, so no leaf
has to fit in a task.

Defined results: null domain, language or source is the name ``none``; a null or empty text has no
tokens and is in no prefix; a name without a weight has ``DEFAULT_WEIGHT``, weight 0 leaves a subtree
out; a null id is the empty id; repeated rows of one id and size are one step of the order, and at
the cut share what is left evenly (rounded down). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged

TREE = ("domain", "lang", "source")
DEFAULT_WEIGHT = 1
BYTES_PER_TOKEN = 4
MISSING = "none"
#: The cut of an epoch is narrowed by hex digits of the order's hash: so many at a time, so often.
CUT_DIGITS = 2
CUT_LEVELS = 2


@dataclass(frozen=True)
class Plan:
    """Weights per level and name (whole numbers), share of the corpus' tokens, epochs at most, seed."""

    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    share_percent: int = 100
    epochs: int = 4
    seed: int = 7


def domain_of(source: str = "source", domains: int = 4) -> Column:
    """The demonstration tree's domains: the number at the end of the source's name, modulo ``domains``."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), (F.when(number == "", "0").otherwise(number).cast("long") % domains).cast("string"))


def token_estimate(text: str = "text") -> Column:
    """Tokens of a text, taken as one for every four bytes begun."""
    return F.expr(f"(coalesce(octet_length(`{text}`), 0) + {BYTES_PER_TOKEN - 1}) div {BYTES_PER_TOKEN}")


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("decimal(18,0)")


def fill(nodes: DataFrame, parent: Sequence[str], child: str) -> DataFrame:
    """Share ``budget`` (equal within a family) among siblings by ``weight`` up to ``cap``.

    Siblings are taken by capacity per weight: while the next one cannot use its share of what is
    left, it is full; the others divide the rest, and single leftover tokens go in that order.
    """
    family = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = family.orderBy(order_key(), child)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    zero = F.lit(0).cast("decimal(38,0)")
    step = nodes.select(
        "*",
        F.coalesce(F.sum("cap").over(before), zero).cast("decimal(20,0)").alias("_used"),
        F.sum("weight").over(after).cast("decimal(18,0)").alias("_open"),
    ).withColumn("_full", F.col("cap") * F.col("_open") <= F.col("weight") * (F.col("budget") - F.col("_used")))
    rest = step.select(
        "*",
        (F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(family), zero))
        .cast("decimal(20,0)")
        .alias("_rest"),
        F.sum(F.when(~F.col("_full"), F.col("weight"))).over(family).cast("decimal(18,0)").alias("_share"),
    ).withColumn(
        "_got",
        F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("cast(weight * _rest div _share as decimal(20,0))")),
    )
    left = F.col("budget") - F.sum("_got").over(family)
    turn = F.row_number().over(W.partitionBy(*parent, "_full").orderBy(order_key(), child))
    return (
        rest.withColumn("_left", left)
        .withColumn("_turn", turn)
        .withColumn("got", (F.col("_got") + F.when(~F.col("_full") & (F.col("_turn") <= F.col("_left")), 1).otherwise(0)).cast("decimal(20,0)"))
        .drop("_used", "_open", "_full", "_rest", "_share", "_got", "_left", "_turn")
    )


def order_key() -> Column:
    return F.col("cap").cast("double") / F.col("weight").cast("double")


def leaf_budgets(docs: DataFrame, plan: Plan) -> DataFrame:
    """One row per leaf: domain, lang, source, n_docs, tokens (one epoch), budget.

    ``docs`` has domain, lang, source and n_tokens.
    """
    leaves = staged(
        docs.groupBy(*TREE).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens")), "leaves"
    )
    usable = leaves
    for level in TREE:
        usable = usable.withColumn(f"w_{level}", _weight(level, plan.weights.get(level, {})))
    usable = usable.filter("tokens > 0 and w_domain > 0 and w_lang > 0 and w_source > 0").withColumn(
        "cap", (F.col("tokens") * plan.epochs).cast("decimal(20,0)")
    )
    whole = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("decimal(20,0)").alias("all"))
    wanted = F.expr(f"cast(all * {int(plan.share_percent)} div 100 as decimal(20,0))")
    budget = whole.select(wanted.alias("budget"))
    level = usable.groupBy("domain").agg(F.sum("cap").cast("decimal(20,0)").alias("cap"), F.max("w_domain").alias("weight"))
    most = level.agg(F.sum("cap").cast("decimal(20,0)").alias("cap")).select(F.coalesce("cap", F.lit(0)).alias("cap"))
    # one number each: scalar subqueries
    level = level.withColumn("budget", F.least(budget.scalar(), most.scalar()).cast("decimal(20,0)"))
    domains = fill(level, [], "domain").select("domain", F.col("got").alias("budget"))
    langs = usable.groupBy("domain", "lang").agg(
        F.sum("cap").cast("decimal(20,0)").alias("cap"), F.max("w_lang").alias("weight")
    )
    langs = fill(langs.join(domains, "domain"), ["domain"], "lang").select("domain", "lang", F.col("got").alias("budget"))
    sources = usable.select(*TREE, "cap", F.col("w_source").alias("weight")).join(langs, ["domain", "lang"])
    got = fill(sources, ["domain", "lang"], "source").select(*TREE, F.col("got").cast("long").alias("budget"))
    return leaves.join(got, list(TREE), "left").select(
        *TREE, "n_docs", "tokens", F.coalesce("budget", F.lit(0)).cast("long").alias("budget")
    )


def epoch_key(plan: Plan, epoch: str = "full_epochs", doc_id: str = "doc_key") -> Column:
    """Place of a document in its leaf's epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(plan.seed)), F.col(epoch).cast("string"), F.col(doc_id)))


def leaf_cuts(docs: DataFrame, plan: Plan) -> DataFrame:
    """One row per leaf: full_epochs, and the key of the row at which the next epoch's prefix ends.

    ``docs`` has domain, lang, source, doc_key and n_tokens. ``cut`` is null where the prefix is empty;
    rows with a key below it are in the prefix whole, rows at it with ``cut_tokens`` each.
    """
    budgets = staged(
        leaf_budgets(docs, plan)
        .withColumn("full_epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)))
        .withColumn("rest", F.col("budget") - F.col("full_epochs") * F.col("tokens")),
        "budgets",
    )
    keyed = (
        docs.filter("n_tokens > 0")
        .join(budgets.filter("rest > 0").select(*TREE, "full_epochs", "rest"), list(TREE))
        .withColumn("place", epoch_key(plan))
        .withColumn("base", F.lit(0).cast("long"))
    )
    for level in range(CUT_LEVELS):
        # the bucket of the next hex digits that the cut falls into; the window sees one row a bucket
        bucket = F.substring("place", 1 + CUT_DIGITS * level, CUT_DIGITS).alias("bucket")
        sums = keyed.groupBy(*TREE, bucket).agg(
            F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"), F.max("base").alias("base")
        )
        along = W.partitionBy(*TREE).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        edge = staged(
            sums.withColumn("upto", F.col("base") + F.sum("n").over(along))
            .filter("upto - n < rest and rest <= upto")
            .select(*TREE, "bucket", (F.col("upto") - F.col("n")).alias("base")),
            "edge",
        )
        keyed = keyed.drop("base").withColumn("bucket", bucket).join(edge, [*TREE, "bucket"]).drop("bucket")
    steps = (
        keyed.groupBy(*TREE, "place", "doc_key", "n_tokens")
        .agg(F.count(F.lit(1)).alias("m"), F.max("rest").alias("rest"), F.max("base").alias("base"))
    )
    inside = W.partitionBy(*TREE).orderBy("place", "doc_key", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    ends = (
        steps.withColumn("before", F.col("base") + F.coalesce(F.sum(F.col("m") * F.col("n_tokens")).over(inside), F.lit(0)))
        .filter("before < rest and rest <= before + m * n_tokens")
        .select(*TREE, F.struct("place", "doc_key", "n_tokens").alias("cut"), F.expr("(rest - before) div m").alias("cut_tokens"))
    )
    return budgets.join(ends, list(TREE), "left")


def tree_columns(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", domain: Column | None = None) -> dict[str, Column]:
    """The columns the tree and the epochs are built from, by name."""
    return {
        "domain": F.coalesce(domain if domain is not None else domain_of(), F.lit(MISSING)),
        "lang": F.coalesce("lang", F.lit(MISSING)),
        "source": F.coalesce("source", F.lit(MISSING)),
        "doc_key": F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
        "n_tokens": token_estimate(text).cast("long"),
    }


def mix(docs: DataFrame, plan: Plan, text: str = "text", doc_id: str = "doc_id", domain: Column | None = None) -> DataFrame:
    """One row per document that takes part: doc_id, tree, n_tokens, full_epochs, prefix_tokens."""
    made = tree_columns(docs, text, doc_id, domain)
    narrow = staged(docs.select(F.col(doc_id).alias("doc_id"), *[c.alias(n) for n, c in made.items()]), "tokens")
    cuts = staged(leaf_cuts(narrow, plan), "cuts")
    met = narrow.join(cuts.select(*TREE, "full_epochs", "cut", "cut_tokens"), list(TREE))
    key = F.struct(epoch_key(plan).alias("place"), "doc_key", "n_tokens")
    prefix = F.when(key < F.col("cut"), F.col("n_tokens")).when(key == F.col("cut"), F.col("cut_tokens")).otherwise(0)
    return (
        met.withColumn("prefix_tokens", prefix)
        .filter("n_tokens > 0 and (full_epochs > 0 or prefix_tokens > 0)")
        .select("doc_id", *TREE, "n_tokens", "full_epochs", "prefix_tokens")
    )


def select_documents(docs: DataFrame, plan: Plan, text: str = "text", doc_id: str = "doc_id", domain: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix takes, whole and once each, with their own columns.

    Texts are not shuffled: each row meets its leaf's cut and decides for itself.
    """
    made = tree_columns(docs, text, doc_id, domain)
    names = {n: f"__mix_{n}" for n in made}
    narrow = staged(docs.select(*[c.alias(n) for n, c in made.items()]), "tokens")
    cuts = staged(leaf_cuts(narrow, plan), "cuts").select(
        *[F.col(c).alias(f"__leaf_{c}") for c in TREE],
        F.struct("full_epochs", "cut", "cut_tokens").alias("__leaf"),
    )
    wide = docs.select("*", *[c.alias(names[n]) for n, c in made.items()])
    on = [F.col(names[c]) == F.col(f"__leaf_{c}") for c in TREE]
    met = wide.join(cuts, on).withColumn("__leaf_epoch", F.col("__leaf.full_epochs"))
    place = epoch_key(plan, "__leaf_epoch", names["doc_key"])
    key = F.struct(place.alias("place"), F.col(names["doc_key"]).alias("doc_key"), F.col(names["n_tokens"]).alias("n_tokens"))
    taken = (F.col(names["n_tokens"]) > 0) & (
        (F.col("__leaf.full_epochs") > 0)
        | F.coalesce(key < F.col("__leaf.cut"), F.lit(False))
        | F.coalesce((key == F.col("__leaf.cut")) & (F.col("__leaf.cut_tokens") > 0), F.lit(False))
    )
    return met.filter(taken).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(plan: Plan, domains: int = 4) -> str:
    """The same selection of table ``documents`` as DuckDB SQL."""

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN {level} = '{n}' THEN {int(w)}" for n, w in plan.weights.get(level, {}).items())
        return f"CASE {cases} ELSE {DEFAULT_WEIGHT} END" if cases else str(DEFAULT_WEIGHT)

    def filled(name: str, nodes: str, parent: str, child: str) -> str:
        family = f"PARTITION BY {parent}" if parent else ""
        keys = f"{parent}, " if parent else ""
        order = "ORDER BY cap::DOUBLE / weight::DOUBLE, " + child
        return f"""
{name}_a AS (SELECT *, coalesce(sum(cap) OVER ({family} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  sum(weight) OVER ({family} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM {nodes}),
{name}_b AS (SELECT *, cap::HUGEINT * open <= weight::HUGEINT * (budget - used) AS is_full FROM {name}_a),
{name}_c AS (SELECT *, budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({family}), 0) AS rest,
  sum(CASE WHEN NOT is_full THEN weight END) OVER ({family}) AS share FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN is_full THEN cap::HUGEINT ELSE (weight::HUGEINT * rest) // share END AS base FROM {name}_c),
{name} AS (SELECT {keys}{child}, base + CASE WHEN NOT is_full AND
    row_number() OVER (PARTITION BY {keys}is_full {order}) <= budget - sum(base) OVER ({family}) THEN 1 ELSE 0 END AS budget
  FROM {name}_d)"""

    key = "md5(concat('{0}:', full_epochs, ':', doc_key))".format(plan.seed)
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce('d' || (coalesce(TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS BIGINT), 0) % {domains}), '{MISSING}') AS domain,
    coalesce(lang, '{MISSING}') AS lang, coalesce(source, '{MISSING}') AS source, coalesce(doc_id::VARCHAR, '') AS doc_key,
    (coalesce(strlen(text), 0) + {BYTES_PER_TOKEN - 1})::BIGINT // {BYTES_PER_TOKEN} AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM docs GROUP BY ALL),
usable AS (SELECT *, tokens * {plan.epochs} AS cap FROM
  (SELECT *, {weight("domain")} AS w_domain, {weight("lang")} AS w_lang, {weight("source")} AS w_source FROM leaves)
  WHERE tokens > 0 AND w_domain > 0 AND w_lang > 0 AND w_source > 0),
top AS (SELECT least((SELECT sum(tokens) FROM leaves) * {plan.share_percent} // 100, (SELECT sum(cap) FROM usable)) AS budget),
n1 AS (SELECT domain, sum(cap) AS cap, max(w_domain) AS weight, (SELECT budget FROM top) AS budget FROM usable GROUP BY domain),
{filled("f1", "n1", "", "domain")},
n2 AS (SELECT u.domain, u.lang, sum(cap) AS cap, max(w_lang) AS weight, max(f1.budget) AS budget
  FROM usable u JOIN f1 USING (domain) GROUP BY ALL),
{filled("f2", "n2", "domain", "lang")},
n3 AS (SELECT u.domain, u.lang, u.source, cap, w_source AS weight, f2.budget FROM usable u JOIN f2 USING (domain, lang)),
{filled("f3", "n3", "domain, lang", "source")},
budgets AS (SELECT domain, lang, source, (f3.budget // tokens)::BIGINT AS full_epochs, (f3.budget % tokens)::BIGINT AS rest
  FROM leaves JOIN f3 USING (domain, lang, source) WHERE tokens > 0),
keyed AS (SELECT d.*, full_epochs, rest, {key} AS place FROM docs d JOIN budgets USING (domain, lang, source) WHERE n_tokens > 0),
steps AS (SELECT domain, lang, source, place, doc_key, n_tokens, count(*) AS m, max(rest) AS rest FROM keyed GROUP BY ALL),
placed AS (SELECT *, coalesce(sum(m * n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_key, n_tokens
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM steps),
taken AS (SELECT *, CASE WHEN before + m * n_tokens < rest THEN n_tokens WHEN before < rest THEN (rest - before) // m ELSE 0 END AS prefix_tokens FROM placed)
SELECT k.doc_id, k.domain, k.lang, k.source, k.n_tokens, k.full_epochs, t.prefix_tokens::BIGINT AS prefix_tokens
FROM keyed k JOIN taken t USING (domain, lang, source, place, doc_key, n_tokens)
WHERE k.full_epochs > 0 OR t.prefix_tokens > 0
"""
