"""Valuation and ranked verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentifold.functions import value as fv
from sentifold.plans import valuation as pv
from sentifold.plans import verdict as pd
from sentifold.sources.store import verdict_csv

from .case import Case, day, rounded, rq
from .views import _V, div_gap, gap, market_v, sql, v_label

PEERED = {
    "peered": """SELECT f.*, m.pe_ratio AS peer_pe, m.pb_ratio AS peer_pb, m.dividend_yield AS peer_div, m.peg_ratio AS peer_peg
      FROM fundamentals f JOIN medians m ON f.sector = m.sector""",
    "relative": f"""SELECT *, {gap('pe_ratio', 'peer_pe')} AS relative_pe, {gap('pb_ratio', 'peer_pb')} AS relative_pb,
      {div_gap('dividend_yield', 'peer_div')} AS dividend_diff, {gap('peg_ratio', 'peer_peg')} AS relative_peg FROM peered""",
    "scored": "SELECT *, "
    + _V.format(pe="relative_pe", pb="relative_pb", dv="dividend_diff", pg="relative_peg")
    + " AS v FROM relative",
}


def _fewer_sectors(t):
    """Medians without one sector, so that some companies are rejected."""
    return pv.sector_medians(t.fundamentals).filter("sector <> 'Brand#3'")


def _verdict_sql(n: int, bottom: bool, scale: float) -> str:
    low = "ASC" if bottom else "DESC"
    agree = "s < 0 AND v > 0" if bottom else "s > 0 AND v < 0"
    side = "BUY" if bottom else "SELL"
    v100 = "greatest(least((v + 0.5) * 100, 100), 0)"
    v_side = v100 if bottom else f"(100 - {v100})"
    return sql(
        f"""SELECT symbol, coalesce(name, symbol) AS name, {rq('s')} AS sentiment_score, {rq('v')} AS valuation_score,
          {rq(f'greatest(least((s + 5) * 10, 100), 0) * 0.5 + {v_side} * 0.5')} AS combined_score,
          CASE WHEN {agree} THEN '{side}' ELSE 'HOLD' END AS verdict, pe_ratio, {rq('pb_ratio')} AS pb_ratio,
          {rq('dividend_yield')} AS dividend_yield, {rq('peg_ratio')} AS peg_ratio,
          {rq(f'CASE WHEN {agree} THEN least(0.9, 0.5 + abs(s) * 0.1 + abs(v)) ELSE 0.5 END')} AS confidence
          FROM picked JOIN market_value USING (symbol) LEFT JOIN names USING (symbol)""",
        picked=f"""SELECT symbol, score * {scale} AS s FROM (SELECT symbol, score,
          row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM composite) WHERE rn = 1
          ORDER BY score {low}, symbol LIMIT {n}""",
    )


def verdict_case(name: str, covers: str, n: int, bottom: bool, scale: float) -> Case:
    return Case(
        name, covers,
        lambda t: rounded(pd.verdicts(t.composite, t.fundamentals, t.names, n, bottom, mood_scale=scale)),
        _verdict_sql(n, bottom, scale),
    )


def _report(t):
    """The text report: its decimals, and that each text lies within half a digit of its number."""
    rows = pd.verdicts(t.composite, t.fundamentals, t.names, 10)
    texts = {"sentiment": ("sentiment_score", 4), "valuation": ("valuation_score", 4), "combined": ("combined_score", 2)}
    report = verdict_csv(rows).select(
        "symbol", "name", "verdict", "confidence", *(F.col(c).alias(f"{n}_text") for n, (c, _) in texts.items())
    )
    both = report.join(rows.select("symbol", *(c for c, _ in texts.values())), "symbol")
    return both.select(
        "symbol", "name", "verdict", "confidence",
        *(F.length(F.substring_index(f"{n}_text", ".", -1)).cast("bigint").alias(f"{n}_decimals") for n in texts),
        *((F.abs(F.col(f"{n}_text").cast("double") - F.col(c)) <= 0.50001 * 10.0**-d).alias(f"{n}_near") for n, (c, d) in texts.items()),
    )


CASES = [
    Case(
        "sector_medians", "D20", lambda t: rounded(pv.sector_medians(t.fundamentals)),
        sql(f"""SELECT sector, {rq('pe_ratio')} AS pe_ratio, {rq('pb_ratio')} AS pb_ratio, {rq('dividend_yield')} AS dividend_yield,
          {rq('peg_ratio')} AS peg_ratio FROM medians"""),
    ),
    Case(
        "valuation_batch", "K4, C5, H16, H17, H18",
        lambda t: rounded(pv.value_companies(t.fundamentals, pv.sector_medians(t.fundamentals))[0].select(
            "symbol", "sector", "v", "label", "relative_pe", "relative_pb", "dividend_diff", "relative_peg",
            *(F.col("parts")[k].alias(f"part_{k.lower()}") for k in ("PE", "PB", "dividend", "PEG")))),
        sql(f"""SELECT symbol, sector, {rq('v')} AS v, {v_label('v')} AS label, {rq('relative_pe')} AS relative_pe, {rq('relative_pb')} AS relative_pb,
          {rq('dividend_diff')} AS dividend_diff, {rq('relative_peg')} AS relative_peg, {rq('-relative_pe * 0.40')} AS part_pe,
          {rq('-relative_pb * 0.25')} AS part_pb, {rq('dividend_diff * 0.15')} AS part_dividend, {rq('-relative_peg * 0.20')} AS part_peg
          FROM scored""", **PEERED),
    ),
    Case(
        "valuation_rejects", "C5, K4", lambda t: pv.value_companies(t.fundamentals, _fewer_sectors(t))[1],
        sql("SELECT symbol, sector FROM fundamentals WHERE sector = 'Brand#3'"),
    ),
    Case(
        "market_valuation", "H19", lambda t: rounded(pv.market_valuation(t.fundamentals).select("symbol", "v", "v_label")),
        sql(f"SELECT symbol, {rq('v')} AS v, {v_label('v')} AS v_label FROM market_value"),
    ),
    Case(
        "valuation_trend", "E17",
        lambda t: rounded(pv.valuation_history(t.reports).select("symbol", F.to_date("ts").alias("day"), "v", "trend")),
        sql(f"""SELECT symbol, {day()} AS day, {rq('v')} AS v,
          {rq('CASE WHEN row_number() OVER w > 2 THEN v - lag(v) OVER w END')} AS trend
          FROM (SELECT *, {market_v()} AS v FROM reports) WINDOW w AS (PARTITION BY symbol ORDER BY day)"""),
    ),
    Case(
        "intrinsic_values", "K5, H20", lambda t: rounded(pv.intrinsic_values(t.fundamentals, pv.sector_medians(t.fundamentals), 0.05)),
        sql(f"""SELECT symbol, {rq('ipe')} AS intrinsic_pe, {rq('ipb')} AS intrinsic_pb, {rq('ig')} AS intrinsic_gordon, {rq('iv')} AS intrinsic_value,
          {rq('CASE WHEN price > 0 THEN iv / price - 1 END')} AS discount_to_intrinsic FROM (
          SELECT *, (coalesce(ipe, 0) + coalesce(ipb, 0) + coalesce(ig, 0))
            / nullif(CAST(ipe IS NOT NULL AS INT) + CAST(ipb IS NOT NULL AS INT) + CAST(ig IS NOT NULL AS INT), 0) AS iv FROM (
          SELECT symbol, CASE WHEN eps > 0 AND peer_pe > 0 THEN eps * peer_pe END AS ipe,
            CASE WHEN book_value_per_share > 0 AND peer_pb > 0 THEN book_value_per_share * peer_pb END AS ipb,
            CASE WHEN dividend_yield > 0 THEN dividend_yield * book_value_per_share * (1 + 0.03) / (0.05::DOUBLE - 0.03::DOUBLE) END AS ig,
            CASE WHEN pe_ratio > 0 AND eps > 0 THEN pe_ratio * eps WHEN pb_ratio > 0 AND book_value_per_share > 0
              THEN pb_ratio * book_value_per_share END AS price FROM peered))""", **PEERED),
    ),
    Case(
        "intrinsic_values_default_rate", "H20",
        lambda t: rounded(pv.intrinsic_values(t.fundamentals, pv.sector_medians(t.fundamentals)).select("symbol", "intrinsic_gordon", "intrinsic_value"), 9),
        sql(f"""SELECT symbol, CAST(NULL AS DOUBLE) AS intrinsic_gordon, {rq('''(coalesce(ipe, 0) + coalesce(ipb, 0))
            / nullif(CAST(ipe IS NOT NULL AS INT) + CAST(ipb IS NOT NULL AS INT), 0)''', 9)} AS intrinsic_value FROM (
          SELECT symbol, CASE WHEN eps > 0 AND peer_pe > 0 THEN eps * peer_pe END AS ipe,
            CASE WHEN book_value_per_share > 0 AND peer_pb > 0 THEN book_value_per_share * peer_pb END AS ipb FROM peered)""", **PEERED),
    ),
    Case(
        "valuation_points", "H32",
        lambda t: rounded(t.fundamentals.select("symbol", fv.value_points(F.col("pe_ratio"), F.col("pb_ratio"), F.col("roe")).alias("points"))),
        sql(f"""SELECT symbol, {rq('''CASE WHEN nullif(pe_ratio, 0) < 15 THEN 0.2 WHEN pe_ratio > 30 THEN -0.2 ELSE 0 END
          + CASE WHEN nullif(pb_ratio, 0) < 1.5 THEN 0.15 WHEN pb_ratio > 4 THEN -0.15 ELSE 0 END
          + CASE WHEN roe > 0.15 THEN 0.1 ELSE 0 END::DOUBLE''')} AS points FROM fundamentals"""),
    ),
    Case(
        "latest_composite_rows", "C8", lambda t: rounded(pd.latest_by_semi_join(t.composite.select("symbol", "day", "score"))),
        sql(f"""SELECT symbol, {day()} AS day, {rq('score')} AS score FROM composite
          WHERE (symbol, composite.day) IN (SELECT (symbol, max(c.day)) FROM composite c GROUP BY symbol)"""),
    ),
    Case(
        "top_sentiment", "F1", lambda t: rounded(pd.extreme_symbols(t.composite, 25, bottom=False)),
        sql(f"""SELECT symbol, {rq('score')} AS sentiment_score FROM (SELECT symbol, score,
          row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM composite) WHERE rn = 1 ORDER BY score DESC, symbol LIMIT 25"""),
    ),
    Case(
        "bottom_sentiment", "F2", lambda t: rounded(pd.extreme_symbols(t.composite, 25)),
        sql(f"""SELECT symbol, {rq('score')} AS sentiment_score FROM (SELECT symbol, score,
          row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM composite) WHERE rn = 1 ORDER BY score, symbol LIMIT 25"""),
    ),
    verdict_case("verdict_bottom", "K12, F2, F3, C9, C11, H28, H29, H30", 10, True, 1.0),
    verdict_case("verdict_top", "K12, F1, F3, C9, C11, H28, H29, H30", 10, False, 1.0),
    verdict_case("verdict_bottom_scaled", "K12, H28", 100, True, 5.0),
    verdict_case("verdict_top_scaled", "K12, H28", 100, False, 5.0),
    Case(
        "verdict_report", "A14", lambda t: _report(t),
        sql("""SELECT symbol, coalesce(name, symbol) AS name, CASE WHEN s < 0 AND v > 0 THEN 'BUY' ELSE 'HOLD' END AS verdict,
              printf('%.2f', CASE WHEN s < 0 AND v > 0 THEN least(0.9, 0.5 + abs(s) * 0.1 + abs(v)) ELSE 0.5 END) AS confidence,
              4::BIGINT AS sentiment_decimals, 4::BIGINT AS valuation_decimals, 2::BIGINT AS combined_decimals,
              true AS sentiment_near, true AS valuation_near, true AS combined_near
              FROM picked JOIN market_value USING (symbol) LEFT JOIN names USING (symbol)""",
            picked="""SELECT symbol, score AS s FROM (SELECT symbol, score,
              row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM composite) WHERE rn = 1
              ORDER BY score, symbol LIMIT 10"""),
    ),
    Case(
        "verdict_strength", "H27",
        lambda t: rounded(t.composite.select("symbol", "day", fv.verdict_strength(F.col("score")).alias("strength"))),
        sql(f"""SELECT symbol, {day()} AS day, CASE WHEN abs(score) >= 0.7 THEN 'STRONG' WHEN abs(score) >= 0.4 THEN 'MODERATE'
          ELSE 'WEAK' END AS strength FROM composite"""),
    ),
]
