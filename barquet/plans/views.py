"""DuckDB versions of the bridge views, as common table expressions for the oracle queries."""

from __future__ import annotations

KEY = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"

VIEWS: dict[str, str] = {
    "lines": f"""
SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'NASDAQ' ELSE 'KOSPI' END AS market,
       'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS ticker,
       'S' || CAST(l_suppkey AS VARCHAR) AS supplier,
       CAST(l_shipdate AS DATE) AS d, l_extendedprice / l_quantity AS px, l_quantity AS qty,
       l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, {KEY} AS k
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "bars": """
SELECT market, ticker, CASE WHEN market = 'NASDAQ' THEN 'USD' ELSE 'KRW' END AS currency, d,
       arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close,
       CAST(sum(qty) AS BIGINT) AS volume
FROM lines GROUP BY market, ticker, d""",
    "sbars": """
SELECT market, supplier AS ticker, CASE WHEN market = 'NASDAQ' THEN 'USD' ELSE 'KRW' END AS currency, d,
       arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close,
       CAST(sum(qty) AS BIGINT) AS volume
FROM lines GROUP BY market, supplier, d""",
    "ticks": """
SELECT CASE WHEN length(event_type) % 2 = 0 THEN 'NASDAQ' ELSE 'KOSPI' END AS market,
       event_type AS ticker, ts, event_id, user_id, value AS px FROM events""",
    "hours": """
SELECT market, ticker, CASE WHEN market = 'NASDAQ' THEN 'USD' ELSE 'KRW' END AS currency,
       date_trunc('hour', ts) AS ts,
       arg_min(px, row(ts, event_id)) AS open, max(px) AS high, min(px) AS low,
       arg_max(px, row(ts, event_id)) AS close, count(*) AS volume
FROM ticks GROUP BY market, ticker, date_trunc('hour', ts)""",
    "numbered": """
SELECT *, (d - DATE '1970-01-01') AS n FROM bars""",
    "edited": """
SELECT market, ticker, currency, d, n,
       CASE WHEN n % 101 = 5 THEN NULL ELSE open END AS open,
       CASE WHEN n % 31 = 2 THEN 1 - 1e-8 ELSE 1 END * CASE WHEN n % 53 = 7 THEN low * 0.5 ELSE high END AS high,
       CASE WHEN n % 89 = 4 THEN -low ELSE low END AS low,
       CASE WHEN n % 97 = 3 THEN NULL ELSE close END AS close,
       CASE WHEN n % 43 = 1 THEN 0 WHEN n % 47 = 1 THEN NULL ELSE volume END AS volume
FROM numbered""",
    "dirty": """
SELECT market, ticker, currency, d, open, high, low, close, volume,
       CASE WHEN c = 1 AND n % 122 = 0 THEN n * 2 - 7 ELSE n * 2 + c END AS ingest_seq
FROM (SELECT *, 0 AS c FROM edited UNION ALL SELECT *, 1 AS c FROM edited WHERE n % 61 = 0)""",
    "cal": """
SELECT market, d, row_number() OVER (PARTITION BY market ORDER BY d) - 1 AS i
FROM (SELECT DISTINCT market, d FROM bars)""",
    "macro": """
SELECT CAST(ts AS DATE) AS d, round(avg(value), 6) AS val, 'EVENT_MEAN' AS series_id
FROM events GROUP BY 1""",
    "macro_long": """
SELECT DATE '1995-01-02' + CAST((d - (SELECT min(d) FROM macro)) * 80 AS INTEGER) AS d, val FROM macro""",
    "calm": """
SELECT market, ticker, currency, d, round(power(open, 0.03) * 100, 6) AS open, round(power(high, 0.03) * 100, 6) AS high,
       round(power(low, 0.03) * 100, 6) AS low, round(power(close, 0.03) * 100, 6) AS close, volume FROM bars""",
    "calmh": """
SELECT market, ticker, currency, ts, round(power(open, 0.03) * 100, 6) AS open, round(power(high, 0.03) * 100, 6) AS high,
       round(power(low, 0.03) * 100, 6) AS low, round(power(close, 0.03) * 100, 6) AS close, volume FROM hours""",
    "orders_by_nation": """
SELECT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS ticker,
       CASE WHEN c_nationkey % 2 = 0 THEN 'NASDAQ' ELSE 'KOSPI' END AS market,
       CAST(o_orderdate AS DATE) AS od, o_custkey % 4 AS lot, o_totalprice
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "cuts": """
SELECT *, CAST(date_trunc('quarter', od) AS DATE) AS s0,
       CAST(date_trunc('quarter', od) + INTERVAL 3 MONTH AS DATE) AS s1, '10-Q' AS form
FROM orders_by_nation WHERE month(od) <= 9
UNION ALL
SELECT *, CAST(date_trunc('year', od) AS DATE), CAST(date_trunc('year', od) + INTERVAL 6 MONTH AS DATE), '10-H'
FROM orders_by_nation WHERE month(od) <= 6
UNION ALL
SELECT *, CAST(date_trunc('year', od) AS DATE), CAST(date_trunc('year', od) + INTERVAL 12 MONTH AS DATE), '10-K'
FROM orders_by_nation""",
    "points": """
SELECT ticker, market, s0 AS start, s1 - 1 AS period_end, CAST(s1 + CAST(20 + lot * 13 AS INTEGER) AS DATE) AS filed,
       form, year(s0) AS fy, round(sum(o_totalprice), 2) AS val
FROM cuts GROUP BY ticker, market, s0, s1, lot, form""",
    "kinds": """
SELECT list_sort(list(DISTINCT event_type)) AS ks FROM events""",
    "news": """
SELECT id, ticker, title, published_at, provider,
       CASE WHEN length(ticker) % 2 = 0 THEN 'NASDAQ' ELSE 'KOSPI' END AS market
FROM (SELECT CAST(doc_id AS VARCHAR) AS id,
             ks[1 + (length(source) + ascii(reverse(source))) % len(ks)] AS ticker, text AS title,
             make_timestamp(CAST((1704067200 + floor(doc_id * 2592000 / n)) * 1000000 AS BIGINT)) AS published_at,
             source AS provider
      FROM documents, (SELECT count(*) AS n FROM documents), kinds)""",
    "funding": """
SELECT event_type AS coin, epoch_ms(ts) AS epoch_ms, (value - m) / 1000.0 AS rate
FROM events, (SELECT round(avg(value), 6) AS m FROM events)""",
}

NEEDS: dict[str, tuple[str, ...]] = {
    "bars": ("lines",),
    "sbars": ("lines",),
    "hours": ("ticks",),
    "numbered": ("bars",),
    "edited": ("numbered",),
    "dirty": ("edited",),
    "cal": ("bars",),
    "macro_long": ("macro",),
    "calm": ("bars",),
    "calmh": ("hours",),
    "cuts": ("orders_by_nation",),
    "points": ("cuts",),
    "news": ("kinds",),
}


def define(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    """Add a view that several oracle queries share."""
    VIEWS[name] = sql
    NEEDS[name] = needs


def with_views(views: str, body: str) -> str:
    """Prefix ``body`` with the named views and what they need. The body may add CTEs with a leading comma."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in views.split():
        add(name)
    body = body.strip()
    head = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n].strip()})" for n in ordered)
    if not ordered:
        return body
    return f"WITH {head}\n{body}"
