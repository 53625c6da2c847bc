"""News queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barquet.functions import columns as fn
from barquet.operators import news as nw
from barquet.plans.registry import query, rounded
from barquet.plans.views import define, with_views as sql
from barquet.sources.bridge import bars_hour, news

# The documents are invented prose: frequent word parts stand in for the usual keywords.
UP, DOWN = ("record", "thatin", "on the"), ("miss", "rewh", "of,")


def _scorer(title):
    return fn.keyword_sentiment(title, UP, DOWN)


define(
    "scored",
    """SELECT market, ticker, id, provider, published_at, CASE WHEN up THEN 0.7 WHEN dn THEN -0.7 ELSE 0.0 END AS score, CASE WHEN up OR dn THEN 0.7 ELSE 0.2 END AS confidence
FROM (SELECT *, contains(lower(title), 'record') OR contains(lower(title), 'thatin') OR contains(lower(title), 'on the') AS up,
 contains(lower(title), 'miss') OR contains(lower(title), 'rewh') OR contains(lower(title), 'of,') AS dn FROM news)""",
    ("news",),
)
define(
    "known",
    """SELECT h.market, h.ticker, h.ts, s.published_at, s.score, s.confidence, power(0.5, (epoch_us(h.ts) - epoch_us(s.published_at)) / 86400e6 / 3.0) AS w
FROM hours h JOIN scored s ON s.market = h.market AND s.ticker = h.ticker AND s.published_at <= h.ts AND s.published_at >= h.ts - INTERVAL 7 DAY""",
    ("hours", "scored"),
)


def _items(spark, sf):
    return nw.scored_once(news(spark, sf), _scorer)


@query("sc8_keyword_sentiment", sql("scored", "SELECT id, CAST(score AS DOUBLE) AS score, CAST(confidence AS DOUBLE) AS confidence FROM scored"))
def sc8(spark, sf):
    return news(spark, sf).withColumn("s", _scorer(F.col("title"))).select("id", "s.score", "s.confidence")


@query(
    "sc9_score_once",
    sql("scored", "SELECT market, ticker, provider, id, delivery, CAST(score AS DOUBLE) AS score, CAST(confidence AS DOUBLE) AS confidence FROM scored CROSS JOIN (SELECT unnest([1, 2]) AS delivery)"),
)
def sc9(spark, sf):
    twice = news(spark, sf).withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    return rounded(nw.scored_once(twice, _scorer).select("market", "ticker", "provider", "id", "delivery", "score", "confidence"))


@query(
    "ud4_pandas_scorer",
    sql("news", """SELECT id, CASE WHEN up THEN 0.7e0 WHEN dn THEN -0.7e0 ELSE 0e0 END AS score, CASE WHEN up OR dn THEN 0.7e0 ELSE 0.2e0 END AS confidence FROM (SELECT id, regexp_matches(lower(title), 'beats|surge|jumps|record|upgrade') AS up,
regexp_matches(lower(title), 'miss|plunge|falls|downgrade|probe|lawsuit') AS dn FROM news)"""),
)
def ud4(spark, sf):
    scorer = nw.pandas_scorer(nw.keyword_frame)
    items = nw.scored_once(news(spark, sf), scorer)
    return items.select("id", "score", "confidence")


@query(
    "sc6_half_life",
    sql("news", "SELECT id, round(power(0.5, greatest(0, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(published_at)) / 86400e6) / 3.0), 10) AS weight FROM news"),
)
def sc6(spark, sf):
    age = (F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros("published_at")) / 86400e6
    return rounded(news(spark, sf).select("id", fn.half_life_weight(age).alias("weight")), 10)


@query(
    "jn6_news_range",
    sql("known", "SELECT market, ticker, ts, count(*) AS n_items, min(published_at) AS oldest, max(published_at) AS newest FROM known GROUP BY market, ticker, ts"),
)
def jn6(spark, sf):
    return rounded(nw.news_windows(_items(spark, sf), bars_hour(spark, sf)).select("market", "ticker", "ts", "n_items", "oldest", "newest"))


@query(
    "sc7_news_signal",
    sql("known", """SELECT 'news' AS source, market, ticker, ts, round(greatest(-1, least(1, sum(score * w * confidence) / sum(w * confidence))), 8) + 0.0 AS score,
round(least(1, max(w * confidence)), 8) AS confidence, CAST(count(*) AS DOUBLE) AS n_items FROM known GROUP BY market, ticker, ts"""),
)
def sc7(spark, sf):
    out = nw.news_signal(_items(spark, sf), bars_hour(spark, sf))
    return rounded(out.select("source", "market", "ticker", "ts", "score", "confidence", F.col("features")["n_items"].alias("n_items")))
