"""The derived market tables as SQL, for the side that Spark is compared with."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["bars"] = """
SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day,
  arg_min(l_extendedprice / l_quantity,
    row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS close,
  sum(l_quantity) AS volume,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS amount
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""

VIEWS["fills"] = """
SELECT CAST(l_partkey AS VARCHAR) AS symbol, l_shipdate AS ts, CAST(l_shipdate AS DATE) AS day,
  l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
  l_quantity AS quantity,
  CASE WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END AS qty,
  l_extendedprice / l_quantity AS price
FROM lineitem"""

VIEWS["last_price"] = """
SELECT symbol, price FROM (SELECT symbol, price,
  row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM fills)
WHERE rn = 1"""

VIEWS["sentiment_raw"] = """
SELECT CAST(user_id AS VARCHAR) AS symbol, ts, event_id,
  CASE event_type WHEN 'purchase' THEN 'news' WHEN 'click' THEN 'social' WHEN 'view' THEN 'search'
    WHEN 'signup' THEN 'forum' ELSE 'other' END AS source,
  greatest(least(1 - value / 50, 1), -1) AS score,
  0.5 + CAST(event_id % 50 AS DOUBLE) / 100 AS confidence
FROM events"""

VIEWS["first_of_source"] = """
SELECT symbol, day, source, score, confidence FROM (
  SELECT symbol, CAST(ts AS DATE) AS day, source, score, confidence,
    row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE), source ORDER BY ts, event_id) AS rn
  FROM sentiment_raw WHERE source <> 'other') WHERE rn = 1"""

VIEWS["weights"] = """
SELECT * FROM (VALUES ('news', 0.40::DOUBLE), ('social', 0.35::DOUBLE), ('search', 0.15::DOUBLE),
  ('forum', 0.10::DOUBLE)) AS t(source, w)"""

VIEWS["composite"] = """
SELECT symbol, day, sum(score * w) / sum(w) AS score, avg(confidence) AS confidence, count(*) AS n_sources,
  max(CASE WHEN source = 'news' THEN score END) AS news, max(CASE WHEN source = 'social' THEN score END) AS social,
  max(CASE WHEN source = 'search' THEN score END) AS search, max(CASE WHEN source = 'forum' THEN score END) AS forum
FROM first_of_source JOIN weights USING (source) GROUP BY symbol, day"""

VIEWS["last_of_source"] = """
SELECT symbol, day, source, score, confidence, coalesce(w, 0) AS w FROM (
  SELECT symbol, CAST(ts AS DATE) AS day, source, score, confidence,
    row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE), source ORDER BY ts DESC, event_id DESC) AS rn
  FROM sentiment_raw) LEFT JOIN weights USING (source) WHERE rn = 1"""

VIEWS["totals"] = """
SELECT symbol, day,
  greatest(least(CASE WHEN sum(w) > 0 THEN sum(score * w) / sum(w) ELSE sum(score * w) END * 5, 5), -5) AS total,
  avg(confidence) AS mean_confidence
FROM last_of_source GROUP BY symbol, day"""

VIEWS["numbered_totals"] = """
SELECT symbol, day, total, mean_confidence, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n FROM totals"""

VIEWS["smooth"] = """
SELECT symbol, n, total AS ema FROM numbered_totals WHERE n = 1
UNION ALL
SELECT t.symbol, t.n, 0.2 * t.total + 0.8 * s.ema FROM smooth s JOIN numbered_totals t
  ON t.symbol = s.symbol AND t.n = s.n + 1"""

VIEWS["mood0"] = """
SELECT symbol, t.day, t.n, t.total, t.mean_confidence, s.ema,
  coalesce(s.ema - lag(s.ema) OVER (PARTITION BY symbol ORDER BY t.day), 0) AS roc,
  avg(s.ema) OVER w30 AS mean, stddev_pop(s.ema) OVER w30 AS std, min(s.ema) OVER w30 AS min, max(s.ema) OVER w30 AS max,
  CASE WHEN stddev_pop(s.ema) OVER w29 >= 0.01
    THEN (s.ema - avg(s.ema) OVER w29) / stddev_pop(s.ema) OVER w29 ELSE 0 END AS z_score
FROM smooth s JOIN numbered_totals t USING (symbol, n)
WINDOW w30 AS (PARTITION BY symbol ORDER BY t.day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
  w29 AS (PARTITION BY symbol ORDER BY t.day ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING)"""

VIEWS["mood"] = """
SELECT *, CASE WHEN n < 10 THEN abs(ema) ELSE abs(z_score) END AS extreme_value,
  CASE WHEN n < 10 THEN abs(ema) >= 2.0 ELSE abs(z_score) >= 1.5 END AS is_extreme,
  CASE WHEN ema <= -3 THEN 'extreme_bearish' WHEN ema <= -1.5 THEN 'bearish' WHEN ema >= 3 THEN 'extreme_bullish'
    WHEN ema >= 1.5 THEN 'bullish' ELSE 'neutral' END AS label
FROM mood0"""

VIEWS["mood_now"] = """
SELECT symbol, ema AS mood, roc, is_extreme, extreme_value, mean_confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM mood) WHERE rn = 1"""

VIEWS["brand_mood"] = """
SELECT symbol, day, greatest(least(CASE WHEN sum(w) > 0 THEN sum(score * w) / sum(w) ELSE sum(score * w) END * 5, 5), -5) AS score
FROM (SELECT symbol, day, source, score, coalesce(w, 0) AS w FROM (
  SELECT 'Brand#' || CAST(1 + CAST(symbol AS BIGINT) % 25 AS VARCHAR) AS symbol,
    CAST(ts AS DATE) - 8400 AS day, source, score,
    row_number() OVER (PARTITION BY CAST(symbol AS BIGINT) % 25, CAST(ts AS DATE), source ORDER BY ts DESC, event_id DESC) AS rn
  FROM sentiment_raw) LEFT JOIN weights USING (source) WHERE rn = 1) GROUP BY 1, 2"""

# --- vendor tables ----------------------------------------------------------

VIEWS["hot_rank"] = """
SELECT (CASE WHEN p_partkey % 2 = 0 THEN 'SH' ELSE 'SZ' END) || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS code,
  p_partkey AS rank FROM part WHERE p_partkey % 3 <> 1"""

VIEWS["spot"] = """
SELECT lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS code, CAST(p_partkey % 11 - 5 AS DOUBLE) AS change_pct,
  CAST(p_size * 400000 AS DOUBLE) AS volume FROM part"""

VIEWS["per_part"] = """
SELECT lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS code, l_partkey,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS net,
  sum(l_tax * l_extendedprice) AS tax FROM lineitem GROUP BY l_partkey"""

VIEWS["margin"] = """
SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, CAST(floor(abs(c_acctbal) * 2000) AS DOUBLE) AS balance FROM customer"""

VIEWS["social"] = """
SELECT symbol, raw_symbol, pct, chg, CASE WHEN pct > 0.9 THEN (CASE WHEN chg < -2 THEN -0.6 WHEN chg > 2 THEN 0.6 ELSE 0.3 END)
  WHEN pct < 0.1 THEN 0.0 ELSE pct * 0.2 END AS score, least(pct, 0.8) AS confidence
FROM (SELECT substr(h.code, 3) AS symbol, h.code AS raw_symbol,
  1 - CAST(row_number() OVER (ORDER BY rank) - 1 AS DOUBLE) / count(*) OVER () AS pct, coalesce(s.change_pct, 0) AS chg
  FROM hot_rank h LEFT JOIN spot s ON substr(h.code, 3) = s.code)"""

VIEWS["news"] = """
SELECT symbol, ratio, change, has, greatest(least(0.6 * ratio + 0.4 * change, 1), -1) AS score,
  CASE WHEN has THEN 0.7 ELSE 0.4 END AS confidence
FROM (SELECT coalesce(d.code, n.code) AS symbol, coalesce(d.net / (abs(d.net) + 1e-8), 0) AS ratio,
  coalesce(n.change, 0) AS change, d.code IS NOT NULL AS has
  FROM (SELECT * FROM per_part WHERE l_partkey % 2 = 0) d
  FULL JOIN (SELECT lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS code, CAST(p_partkey % 13 - 6 AS DOUBLE) / 100 AS change
    FROM part WHERE p_partkey % 5 <> 0) n ON d.code = n.code)"""

VIEWS["drift"] = """
SELECT code, greatest(least((balance - 10000000) / (10000000 + 1e-8), 1), -1) AS drift FROM margin"""

VIEWS["forum"] = """
SELECT symbol, ratio, drift, greatest(least(0.6 * ratio + 0.4 * drift, 1), -1) AS score FROM (
  SELECT coalesce(f.code, m.code) AS symbol, coalesce(f.net / (abs(f.net) + abs(f.tax) + 1e-8), 0) AS ratio,
    coalesce(m.drift, 0) AS drift FROM per_part f FULL JOIN drift m ON f.code = m.code)"""

VIEWS["search"] = """
SELECT symbol, drift, ratio, greatest(least(0.6 * drift + 0.4 * (ratio - 1), 1), -1) AS score FROM (
  SELECT coalesce(m.code, s.code) AS symbol, coalesce(m.drift, 0) AS drift,
    coalesce(greatest(least(s.volume / (10000000 + 1e-8), 10), 0.1), 1) AS ratio
  FROM drift m FULL JOIN spot s ON m.code = s.code)"""

# --- companies --------------------------------------------------------------

VIEWS["fundamentals"] = """
SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_brand AS sector,
  CASE WHEN p_size % 10 <> 0 THEN CAST(p_size AS DOUBLE) END AS pe_ratio, CAST(p_size + 1 AS DOUBLE) AS pe_ttm,
  CAST(p_partkey % 40 AS DOUBLE) / 10 AS pb_ratio, CAST(p_partkey % 7 AS DOUBLE) / 100 AS dividend_yield,
  CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) / 20 END AS peg_ratio,
  CASE WHEN p_partkey % 11 = 0 THEN -(p_retailprice / p_size) ELSE p_retailprice / p_size END AS eps,
  p_retailprice / 10 AS book_value_per_share, CAST(p_partkey % 30 AS DOUBLE) / 100 AS roe FROM part"""

VIEWS["reports"] = """
SELECT symbol, sector, DATE '2000-03-31' + CAST(q * 91 AS INTEGER) AS day, pe_ttm, dividend_yield, peg_ratio,
  pe_ratio + (CAST(symbol AS BIGINT) * q) % 7 AS pe_ratio, pb_ratio + CAST(q AS DOUBLE) / 10 AS pb_ratio
FROM fundamentals, (VALUES (0), (1), (2), (3)) AS t(q)"""

_GAP = "CASE WHEN {own} > 0 AND {peer} > 0 THEN {own} / {peer} - 1 ELSE 0 END"
_DIV = "CASE WHEN {peer} > 0 THEN {own} / {peer} - 1 WHEN {own} > 0 THEN 1 ELSE 0 END"


def gap(own: str, peer: str) -> str:
    return _GAP.format(own=own, peer=peer)


def div_gap(own: str, peer: str) -> str:
    return _DIV.format(own=own, peer=peer)


_V = "(-({pe}) * 0.40 + -({pb}) * 0.25 + ({dv}) * 0.15 + -({pg}) * 0.20)"


def market_v(pe: str = "coalesce(nullif(pe_ratio, 0), nullif(pe_ttm, 0), 0)") -> str:
    return _V.format(
        pe=gap(pe, "15.0"), pb=gap("coalesce(pb_ratio, 0)", "2.0"),
        dv=div_gap("coalesce(dividend_yield, 0)", "0.02"), pg=gap("peg_ratio", "1.5"),
    )


def v_label(v: str) -> str:
    return (
        f"CASE WHEN {v} >= 0.30 THEN 'deeply_undervalued' WHEN {v} >= 0.10 THEN 'undervalued' "
        f"WHEN {v} >= -0.10 THEN 'fair_value' WHEN {v} >= -0.30 THEN 'overvalued' ELSE 'deeply_overvalued' END"
    )


VIEWS["market_value"] = f"SELECT *, {market_v()} AS v FROM fundamentals"

VIEWS["medians"] = """
SELECT sector, median(pe_ratio) AS pe_ratio, median(pb_ratio) AS pb_ratio, median(dividend_yield) AS dividend_yield,
  median(peg_ratio) AS peg_ratio FROM fundamentals GROUP BY sector"""

VIEWS["names"] = """
SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_name AS name FROM part WHERE p_partkey % 3 <> 0"""

# --- positions, requests, signals, equity -----------------------------------

VIEWS["held"] = """
SELECT symbol, entry_type, entry_price, CASE WHEN entry_type = 'BUY' THEN entry_price * 0.92 ELSE entry_price * 1.08 END AS stop_loss,
  CASE WHEN entry_type = 'BUY' THEN entry_price * 1.15 ELSE entry_price * 0.85 END AS take_profit
FROM (SELECT symbol, CASE WHEN (p_partkey // 4) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS entry_type,
  price * (1 + CAST(p_partkey % 41 - 20 AS DOUBLE) / 100) AS entry_price
  FROM part JOIN last_price ON symbol = CAST(p_partkey AS VARCHAR) WHERE p_partkey % 4 = 0)"""

VIEWS["positions"] = """
SELECT CAST(p_partkey AS VARCHAR) AS symbol, CAST((p_partkey % 60 - 9) * 100 AS BIGINT) AS quantity, p_retailprice AS avg_cost,
  p_retailprice * (1 + CAST(p_partkey % 25 - 12 AS DOUBLE) / 100) AS current_price FROM part WHERE p_partkey % 3 = 0"""

VIEWS["requests"] = """
SELECT request_id, symbol, side, CASE kind WHEN '2' THEN 'limit' WHEN '3' THEN 'stop' WHEN '4' THEN 'stop_limit' ELSE 'market' END AS order_type,
  quantity, CASE WHEN kind IN ('2', '4') AND request_id % 7 <> 0 THEN total / 1000 END AS price,
  CASE WHEN kind IN ('3', '4') AND request_id % 9 <> 0 THEN total / 1000 - 2 END AS stop_price, balance
FROM (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS symbol,
  CASE WHEN o_orderstatus = 'O' THEN 'buy' ELSE 'sell' END AS side, substr(o_orderpriority, 1, 1) AS kind,
  CAST(o_orderkey % 200 - 3 AS BIGINT) AS quantity, o_totalprice AS total, c_acctbal * 4 AS balance
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

VIEWS["signals"] = """
SELECT run, symbol, signal_type, ts, source, strength, confidence, entry_price, id,
  CASE WHEN id % 5 <> 0 THEN CASE WHEN signal_type <> 'SELL' THEN entry_price * 0.92 ELSE entry_price * 1.08 END END AS stop_loss,
  CASE WHEN id % 5 <> 0 THEN CASE WHEN signal_type <> 'SELL' THEN entry_price * 1.15 ELSE entry_price * 0.85 END END AS take_profit,
  CASE WHEN id % 11 = 0 THEN 0.03::DOUBLE END AS position_size, low / 50 - 1 AS sentiment_score,
  CASE WHEN id % 4 <> 0 THEN CAST(id % 21 - 10 AS DOUBLE) / 20 END AS valuation_score,
  'reason ' || CAST(id % 3 AS VARCHAR) AS reason
FROM (SELECT CAST(ts AS DATE) AS run, CAST(user_id AS VARCHAR) AS symbol, event_type AS source, max(event_id) AS id,
  max(ts) AS ts, min(value) AS low, least(100, max(value)) AS strength,
  0.2 + CAST(max(event_id) % 80 AS DOUBLE) / 100 AS confidence, CAST(10 + max(event_id) % 90 AS DOUBLE) AS entry_price,
  CASE WHEN max(event_id) % 10 = 0 THEN 'EXIT_LONG' WHEN max(event_id) % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS signal_type
  FROM events GROUP BY 1, 2, 3)"""

VIEWS["equity"] = """
SELECT date, 1e9 + (sum(cents) OVER (ORDER BY date) - row_number() OVER (ORDER BY date) * mean) / 100 AS equity
FROM (SELECT *, CAST(sum(cents) OVER () AS DOUBLE) / count(*) OVER () AS mean FROM (
  SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS cents
  FROM orders GROUP BY 1))"""


def sql(body: str, **extra: str) -> str:
    """``body`` with a WITH clause for every view it (or ``extra``) mentions."""
    texts = {**VIEWS, **extra}
    order = list(texts)
    wanted: set[str] = set()

    def visit(text: str, me: str | None) -> None:
        words = set(re.findall(r"[a-z_0-9]+", text))
        for n in order:
            if n in words and n != me and n not in wanted and _is_table(n, text):
                wanted.add(n)
                visit(texts[n], n)

    visit(body, None)
    used = [n for n in order if n in wanted]
    if not used:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({texts[n]})" for n in used) + "\n" + body


def _is_table(name: str, text: str) -> bool:
    return re.search(rf"(FROM|JOIN)\s+{name}\b", text) is not None
