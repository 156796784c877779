"""Queries of prices, as-of joins and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import trade as t
from ledgerlark.operators import asof, labels
from ledgerlark.plans.feature_queries import WIDE
from ledgerlark.plans.tables import Book, rounded
from ledgerlark.sources.shared import written

book = Book()

SPAN = """sp AS (SELECT ticker, min(transaction_date) - 10 AS lo, max(transaction_date) + 40 AS hi FROM trades GROUP BY ticker),
    seen AS (SELECT p.ticker, p.date, p.close FROM daily_prices p JOIN sp USING (ticker) WHERE p.date BETWEEN lo AND hi)"""
CLOSES = f"""{SPAN}, c0 AS (SELECT r.*, s.close AS txn_close FROM trades r ASOF LEFT JOIN seen s ON r.ticker = s.ticker AND r.transaction_date >= s.date),
    c1 AS (SELECT r.*, s.close AS future_close FROM c0 r ASOF LEFT JOIN seen s ON r.ticker = s.ticker AND r.transaction_date + 30 <= s.date)"""
RETURNS = f"""{CLOSES}, b0 AS (SELECT r.*, s.close AS b0 FROM c1 r ASOF LEFT JOIN benchmark_prices s ON r.transaction_date >= s.date),
    b1 AS (SELECT r.*, s.close AS b1 FROM b0 r ASOF LEFT JOIN benchmark_prices s ON r.transaction_date + 30 <= s.date),
    r0 AS (SELECT *, (future_close - txn_close) / nullif(txn_close, 0) AS forward_return, (b1 - b0) / nullif(b0, 0) AS benchmark_return, {WIDE} AS dir FROM b1),
    rr AS (SELECT *, forward_return - benchmark_return AS abnormal_return, (forward_return - benchmark_return) * dir AS signed FROM r0),
    pl AS (SELECT *, CAST(coalesce(signed >= 0.05, false) AS INT) AS price_signal FROM rr)"""
EVENTS = """ea AS (SELECT r.*, s.announcement_date AS eb FROM {src} r ASOF LEFT JOIN earnings s ON r.ticker = s.ticker AND r.transaction_date >= s.announcement_date),
    eb AS (SELECT r.*, s.announcement_date AS ef FROM ea r ASOF LEFT JOIN earnings s ON r.ticker = s.ticker AND r.transaction_date <= s.announcement_date),
    ec AS (SELECT r.*, s.action_date AS nf FROM eb r ASOF LEFT JOIN enforcement s ON r.ticker = s.ticker AND r.transaction_date <= s.action_date),
    ev AS (SELECT *, CAST(coalesce(least(datediff('day', eb, transaction_date), datediff('day', transaction_date, ef)) <= 30, false) AS INT) AS earnings_proximity_flag,
           CAST(coalesce(datediff('day', transaction_date, nf) <= 365, false) AS INT) AS enforcement_followup_flag FROM ec)"""
ROUTINE = """k AS (SELECT DISTINCT coalesce(insider_cik, 'nan') AS who, month(transaction_date) AS m, year(transaction_date) AS y FROM trades WHERE transaction_code IN ('P', 'S')),
    ro AS (SELECT a.who, a.m, a.y FROM k a JOIN k b ON a.who = b.who AND a.m = b.m AND b.y = a.y - 1 JOIN k c ON a.who = c.who AND a.m = c.m AND c.y = a.y - 2)"""
FINAL = """fl AS (SELECT e.*, e.transaction_code IN ('P', 'S') AS om, ro.who IS NOT NULL AS routine FROM ev e LEFT JOIN ro ON e.transaction_code IN ('P', 'S') AND coalesce(e.insider_cik, 'nan') = ro.who AND month(e.transaction_date) = ro.m AND year(e.transaction_date) = ro.y),
    f1 AS (SELECT *, price_signal + earnings_proximity_flag + enforcement_followup_flag AS label_source_count, CASE WHEN NOT om THEN -1 WHEN routine THEN 0 ELSE 1 END AS cohen_label,
           CASE WHEN om AND has_plan = 1 THEN 1 ELSE 0 END AS plan_override FROM fl),
    f2 AS (SELECT *, CASE WHEN NOT om THEN -1 WHEN plan_override = 1 THEN 0 ELSE cohen_label END AS final_label FROM f1),
    labeled AS (SELECT *, CAST(final_label = 1 AS INT) AS informed_label, CAST(final_label = 0 AS INT) AS routine_label,
           CASE final_label WHEN 1 THEN 'opportunistic' WHEN 0 THEN 'routine' ELSE 'uncertain' END AS label_name, CASE WHEN final_label = -1 THEN 'uncertain' WHEN plan_override = 1 THEN 'high' ELSE 'medium' END AS label_confidence FROM f2)"""
PLANNED = "tp AS (SELECT *, CAST(has_10b5_1_plan OR contains(lower(coalesce(footnote_text, '')), '10b5-1') AS INT) AS has_plan FROM trades)"
LABELED = f"{PLANNED}, {RETURNS.replace('FROM trades r', 'FROM tp r')}, {EVENTS.format(src='pl')}, {ROUTINE}, {FINAL}"
LABEL_COLUMNS = ("price_signal", "earnings_proximity_flag", "enforcement_followup_flag", "label_source_count", "cohen_label", "plan_override", "final_label", "informed_label", "routine_label", "label_name", "label_confidence")


#: What labels are made of.
LABELLED_BY = ("row_id", "ticker", "insider_cik", "transaction_date", "transaction_code", "has_plan", "footnote_has_plan")


def labeled(tables):
    """Labels of all trades.  What they are made of is written once, as spans, days, calendars and series are read several times."""
    trades = t.add_text_features(tables.trades).select(*LABELLED_BY)
    return labels.build_labels(*[written(x, "labelled_by") for x in (trades, tables.daily_prices, tables.benchmark_prices, tables.earnings, tables.enforcement)])


@book.add(f"{CLOSES} SELECT row_id, round(txn_close, 8) AS txn_close, round(future_close, 8) AS future_close FROM c1")
def j01_j02_close_and_future_close(tables):
    out = asof.close_on_trade(tables.trades, tables.daily_prices)
    return rounded(out.select("row_id", "txn_close", "future_close"), txn_close=8, future_close=8)


P28_SQL = """fi AS (SELECT ticker, min(transaction_date) AS lo FROM trades GROUP BY ticker), seen AS (SELECT p.* FROM daily_prices p JOIN fi USING (ticker) WHERE p.date >= lo),
    c AS (SELECT r.*, s.close AS c FROM trades r ASOF LEFT JOIN seen s ON r.ticker = s.ticker AND r.transaction_date >= s.date)
    SELECT row_id, round(c, 8) AS close_price_on_txn_date, round(CASE WHEN transaction_code = 'M' AND coalesce(total_value, 0) = 0 AND c IS NOT NULL THEN shares * c ELSE total_value END, 6) AS total_value FROM c"""


@book.add(P28_SQL)
def j03_p28_c05_price_enrichment(tables):
    out = asof.enrich_with_prices(tables.trades, tables.daily_prices)
    return rounded(out.select("row_id", "close_price_on_txn_date", "total_value"), close_price_on_txn_date=8, total_value=6)


@book.add(f"{EVENTS.format(src='trades')} SELECT row_id, earnings_proximity_flag, enforcement_followup_flag FROM ev")
def j04_j05_event_proximity(tables):
    near = asof.nearest_event(tables.trades, tables.earnings, "announcement_date", labels.PROXIMITY, "earnings_proximity_flag")
    return asof.event_ahead(near, tables.enforcement, "action_date", labels.LOOKAHEAD, "enforcement_followup_flag").select("row_id", "earnings_proximity_flag", "enforcement_followup_flag")


@book.add("""b0 AS (SELECT r.*, s.close AS b0 FROM trades r ASOF LEFT JOIN benchmark_prices s ON r.transaction_date >= s.date)
    SELECT r.row_id, round(b0, 8) AS bench_close, round(s.close, 8) AS bench_target_close FROM b0 r ASOF LEFT JOIN benchmark_prices s ON r.transaction_date + 30 <= s.date""")
def j07_benchmark_series(tables):
    own = tables.trades.withColumn("target", F.date_add("transaction_date", 30))
    out = asof.as_of(own, "transaction_date", tables.benchmark_prices, None, "date", "close", "bench_close")
    out = asof.as_of(out, "target", tables.benchmark_prices, None, "date", "close", "bench_target_close", forward=True)
    return rounded(out.select("row_id", "bench_close", "bench_target_close"), bench_close=8, bench_target_close=8)


@book.add("""sp AS (SELECT ticker, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM daily_prices GROUP BY ticker),
    j AS (SELECT sp.ticker, sp.date, p.close FROM sp LEFT JOIN daily_prices p USING (ticker, date))
    SELECT ticker, date, round(last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 8) AS ffill,
           round(first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 8) AS bfill FROM j""")
def w08_daily_fill(tables):
    return rounded(asof.daily_fill(tables.daily_prices), ffill=8, bfill=8)


@book.add(f"""{RETURNS} SELECT row_id, round(forward_return, 5) AS forward_return, round(benchmark_return, 5) AS benchmark_return, round(abnormal_return, 5) AS abnormal_return,
    CASE WHEN round(signed, 5) = 0 THEN 0 ELSE round(signed, 5) END AS signed_abnormal_return, price_signal FROM pl""")
def p23_price_labels(tables):
    out = labels.add_price_labels(tables.trades, tables.daily_prices, tables.benchmark_prices)
    cols = ("forward_return", "benchmark_return", "abnormal_return", "signed_abnormal_return")
    return rounded(out.select("row_id", *cols, "price_signal"), **{c: 5 for c in cols})


@book.add(f"{ROUTINE} SELECT r.row_id, ro.who IS NOT NULL AS is_routine FROM trades r LEFT JOIN ro ON r.insider_cik = ro.who AND month(r.transaction_date) = ro.m AND year(r.transaction_date) = ro.y WHERE r.transaction_code IN ('P', 'S')")
def w06_j17_routine_calendar(tables):
    return labels.routine_trades(tables.trades.filter("transaction_code in ('P', 'S')")).select("row_id", "is_routine")


@book.add(f"{LABELED} SELECT row_id, CASE WHEN round(signed, 5) = 0 THEN 0 ELSE round(signed, 5) END AS signed_abnormal_return, {', '.join(LABEL_COLUMNS)} FROM labeled")
def c03_p22_labels(tables):
    return rounded(labeled(tables).select("row_id", "signed_abnormal_return", *LABEL_COLUMNS), signed_abnormal_return=5)


@book.add(f"""{LABELED}, s AS (SELECT count(*) AS n, count(forward_return) AS f, count(benchmark_return) AS b, count(*) FILTER (final_label = 1) AS o, count(*) FILTER (final_label = 0) AS r, count(*) FILTER (final_label = -1) AS u,
      CAST(sum(price_signal) AS BIGINT) AS ps, CAST(sum(earnings_proximity_flag) AS BIGINT) AS es, CAST(sum(enforcement_followup_flag) AS BIGINT) AS ns,
      count(*) FILTER (label_source_count = 0) AS s0, count(*) FILTER (label_source_count = 1) AS s1, count(*) FILTER (label_source_count = 2) AS s2, count(*) FILTER (label_source_count = 3) AS s3 FROM labeled)
    SELECT n AS "rows", f AS forward_return_rows, round(100 * f / n, 2) AS forward_return_pct, b AS benchmark_return_rows, round(100 * b / n, 2) AS benchmark_return_pct, o AS opportunistic_rows, round(100 * o / n, 2) AS opportunistic_pct,
      r AS routine_rows, round(100 * r / n, 2) AS routine_pct, u AS uncertain_rows, round(100 * u / n, 2) AS uncertain_pct, ps AS price_signal_rows, es AS earnings_proximity_flag_rows, ns AS enforcement_followup_flag_rows,
      s0 AS sources_0_rows, s1 AS sources_1_rows, s2 AS sources_2_rows, s3 AS sources_3_rows,
      concat_ws('; ', CASE WHEN 100 * f / n < 90 THEN 'price coverage below 90 %' END, CASE WHEN 100 * o / n < 1 THEN 'opportunistic share below 1 %' WHEN 100 * o / n > 40 THEN 'opportunistic share above 40 %' END,
        CASE WHEN es = 0 THEN 'no earnings confirmations' END, CASE WHEN ns = 0 THEN 'no enforcement confirmations' END) AS recommendations FROM s""")
def a13_a14_label_summary(tables):
    return labels.label_summary(labeled(tables))


GRID_SQL = f"""{LABELED}, g AS (SELECT * FROM (VALUES (0.02), (0.05), (0.1)) a(abnormal_threshold), (VALUES (1), (2), (3)) b(confidence_sources_required)),
    gr AS (SELECT CAST(abnormal_threshold AS DOUBLE) AS abnormal_threshold, confidence_sources_required, count(*) AS n,
      count(*) FILTER (CAST(coalesce(signed >= CAST(abnormal_threshold AS DOUBLE), false) AS INT) + earnings_proximity_flag + enforcement_followup_flag >= confidence_sources_required) AS i, count(forward_return) AS c FROM labeled, g GROUP BY 1, 2),
    gg AS (SELECT abnormal_threshold, confidence_sources_required, n AS "rows", i AS informed_rows, round(100 * i / n, 4) AS informed_pct, round(100 * c / n, 4) AS coverage_pct FROM gr)"""


@book.add(f"{GRID_SQL} SELECT * FROM gg")
def a15_calibration_grid(tables):
    return labels.calibration_grid(tables.spark, labeled(tables), (0.02, 0.05, 0.1), (1, 2, 3))


@book.add(f"""{GRID_SQL} SELECT *, round(abs(informed_pct - 12.5) + 0.2 * greatest(0, 95 - coverage_pct), 6) AS score FROM gg
    ORDER BY CAST(informed_pct BETWEEN 5 AND 20 AS INT) DESC, score, coverage_pct DESC, abnormal_threshold, confidence_sources_required LIMIT 1""")
def a16_calibration_choice(tables):
    return labels.recommend(labels.calibration_grid(tables.spark, labeled(tables), (0.02, 0.05, 0.1), (1, 2, 3)), 5, 20)


@book.add("""m AS (SELECT ticker AS v, count(*) AS n FROM trades WHERE row_id % 3 <> 0 GROUP BY 1 ORDER BY n DESC, v LIMIT 1)
    SELECT row_id, CASE WHEN row_id % 3 = 0 THEN (SELECT v FROM m) ELSE ticker END AS pricing_ticker FROM trades""")
def p18_a30_pricing_ticker(tables):
    own = tables.trades.withColumn("issuer_ticker", F.when(F.col("row_id") % 3 != 0, F.col("ticker")))
    return labels.with_pricing_ticker(own).select("row_id", "pricing_ticker")
