"""Queries of the feature stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import trade as t
from ledgerlark.operators import history
from ledgerlark.plans.tables import Book, Tables, rounded, sql_list

book = Book()

DIR = f"CASE WHEN transaction_code IN {sql_list(t.FEATURE_BUY)} THEN 1 WHEN transaction_code IN {sql_list(t.FEATURE_SELL)} THEN -1 ELSE 0 END"
WIDE = f"CASE WHEN transaction_code IN {sql_list(t.LABEL_BUY)} THEN 1 WHEN transaction_code IN {sql_list(t.LABEL_SELL)} THEN -1 ELSE 0 END"
BUCKET = "CASE WHEN coalesce(total_value, 0) < 0 THEN 'nan' WHEN coalesce(total_value, 0) <= 1e5 THEN 'tiny' WHEN total_value <= 5e5 THEN 'small' WHEN total_value <= 2e6 THEN 'medium' WHEN total_value <= 1e7 THEN 'large' ELSE 'mega' END"
BUCKET_NO = f"CASE {BUCKET} WHEN 'nan' THEN 0 WHEN 'tiny' THEN 1 WHEN 'small' THEN 2 WHEN 'medium' THEN 3 WHEN 'large' THEN 4 ELSE 5 END"
TEXT = "lower(concat_ws(' ', insider_role, coalesce(officer_title, '')))"
SENIOR = "CASE " + " ".join(f"WHEN contains({TEXT}, '{w}') THEN {n}" for w, n in t.SENIORITY) + " ELSE 1 END"


def hits(phrases) -> str:
    return "CASE WHEN length(coalesce(footnote_text, '')) < 10 THEN 0 ELSE " + " + ".join(f"CAST(contains(lower(footnote_text), '{p}') AS INT)" for p in phrases) + " END"


DAY = "datediff('day', DATE '1970-01-01', transaction_date)"
DIRECTED = f"f AS (SELECT *, {DIR} AS dir, coalesce(total_value, 0) * {DIR} AS signed_value, {DAY} AS d FROM trades)"
HIST = "w AS (PARTITION BY insider_cik ORDER BY transaction_date, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

#: Expressions of the feature matrix over f (trades with dir, signed_value, d), by column.
TRADE_SQL = {
    "log_shares": "round(ln(1 + shares), 6)", "log_total_value": "round(ln(1 + coalesce(total_value, 0)), 6)", "log_shares_owned_after": "round(ln(1 + shares_owned_after), 6)",
    "total_value_is_imputed": "CAST(coalesce(total_value, 0) = 0 AND transaction_code IN ('M', 'A') AS INT)", "trade_direction": "dir",
    "is_buy": "CAST(dir = 1 AS INT)", "is_sell": "CAST(dir = -1 AS INT)", "is_open_market_buy": "CAST(is_open_market AND dir = 1 AS INT)", "is_open_market_sell": "CAST(is_open_market AND dir = -1 AS INT)",
    "signed_value": "round(signed_value, 4)", "days_to_filing": "CAST(greatest(datediff('day', transaction_date, filing_date), 0) AS INT)",
    "pct_position_traded": "round(CASE WHEN shares + shares_owned_after > 0 THEN shares / (shares + shares_owned_after) ELSE 0 END, 6)",
    "value_bucket": BUCKET, "value_bucket_num": BUCKET_NO, "txn_day_of_week": "CAST(isodow(transaction_date) - 1 AS INT)", "txn_month": "CAST(month(transaction_date) AS INT)", "txn_quarter": "CAST(quarter(transaction_date) AS INT)",
}
ROLE_SQL = {
    "role_seniority": SENIOR,
    **{f"is_{s}": f"CAST(contains(lower(insider_role), '{s}') OR contains(lower(coalesce(officer_title, '')), 'chief {w}') AS INT)" for s, w in (("ceo", "executive"), ("cfo", "financial"), ("coo", "operating"))},
    "is_director_only": "CAST(lower(insider_role) = 'director' AND NOT is_officer AS INT)",
}
R, I = hits(t.ROUTINE_PHRASES), hits(t.INFORMED_PHRASES)
TEXT_SQL = {
    "footnote_length": "length(trim(coalesce(footnote_text, '')))", "footnote_has_plan": r"CAST(regexp_matches(lower(coalesce(footnote_text, '')), '10b5[-\s]?1') AS INT)",
    "footnote_routine_hits": R, "footnote_informed_hits": I, "footnote_has_option": f"CAST(({hits(t.OPTION_PHRASES)}) > 0 AS INT)",
    "footnote_routine_score": f"round(CASE WHEN length(coalesce(footnote_text, '')) < 10 OR ({R}) + ({I}) = 0 THEN 0.5 ELSE ({R}) / (({R}) + ({I})) END, 6)",
    "has_plan": r"CAST(has_10b5_1_plan OR regexp_matches(lower(coalesce(footnote_text, '')), '10b5[-\s]?1') AS INT)",
}
PAST_SQL = {
    "insider_total_trades": "count(*) OVER w", "insider_avg_trade_value": "round(coalesce(avg(CASE WHEN total_value > 0 THEN total_value END) OVER w, 0) + 1e-6, 3)",
    "insider_buy_count": "CAST(coalesce(sum(CAST(is_open_market AND dir = 1 AS INT)) OVER w, 0) AS BIGINT)", "insider_sell_count": "CAST(coalesce(sum(CAST(is_open_market AND dir = -1 AS INT)) OVER w, 0) AS BIGINT)",
    "insider_tenure_days": "datediff('day', min(transaction_date) OVER (PARTITION BY insider_cik), transaction_date)",
}


def trailing_sql(d: int) -> dict[str, str]:
    w = f"OVER (PARTITION BY insider_cik ORDER BY d RANGE BETWEEN {d} PRECEDING AND 1 PRECEDING)"
    return {
        f"trades_{d}d": f"2 * count(*) {w}", f"buy_count_{d}d": f"CAST(coalesce(sum(CAST(dir = 1 AS INT)) {w}, 0) AS BIGINT)",
        f"sell_count_{d}d": f"CAST(coalesce(sum(CAST(dir = -1 AS INT)) {w}, 0) AS BIGINT)", f"net_value_{d}d": f"round(coalesce(CAST(sum(CAST(signed_value AS DECIMAL(20,4))) {w} AS DOUBLE), 0), 3)",
    }


TRAILING_SQL = {k: v for d in history.TRAILING_DAYS for k, v in trailing_sql(d).items()}


def select(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


def directed(tables: Tables) -> DataFrame:
    return t.add_direction(tables.trades)


def cents(df: DataFrame) -> DataFrame:
    """Signed values as decimals, so that sums do not depend on order."""
    return df.withColumn("signed_value", F.col("signed_value").cast("decimal(20,4)"))


def off_half(df: DataFrame) -> DataFrame:
    """Means of cents moved off the halves that engines round to either side."""
    return df.withColumn("insider_avg_trade_value", F.col("insider_avg_trade_value") + 1e-6)


def round_money(df: DataFrame) -> DataFrame:
    return df.withColumns({f"net_value_{d}d": F.round(F.col(f"net_value_{d}d").cast("double"), 3) for d in history.TRAILING_DAYS})


@book.add(f"""{DIRECTED}, x AS (SELECT ticker, CAST(sum(CAST(signed_value AS DECIMAL(20,4))) OVER (PARTITION BY insider_cik ORDER BY d RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING) AS DECIMAL(38,4)) AS net FROM f)
    SELECT ticker, count(*) AS trades, round(CAST(sum(coalesce(net, 0)) AS DOUBLE), 2) AS net_30d FROM x GROUP BY ticker""")
def slice_trailing_net_by_ticker(tables):
    rows = history.trailing_windows(cents(directed(tables)), days=(30,))
    return rows.groupBy("ticker").agg(F.count("*").alias("trades"), F.round(F.sum(F.col("net_value_30d").cast("decimal(38,4)")).cast("double"), 2).alias("net_30d"))


@book.add(f"{DIRECTED} SELECT row_id, {select(TRADE_SQL)} FROM f")
def p04_p10_trade_features(tables):
    df = t.add_trade_features(tables.trades)
    return rounded(df.select("row_id", *TRADE_SQL), log_shares=6, log_total_value=6, log_shares_owned_after=6, signed_value=4, pct_position_traded=6)


@book.add(f"SELECT row_id, {select(ROLE_SQL)} FROM trades")
def p11_role_features(tables):
    return t.add_role_features(tables.trades).select("row_id", *ROLE_SQL)


@book.add(f"SELECT row_id, {select(TEXT_SQL)} FROM trades")
def p12_p16_text_features(tables):
    return rounded(t.add_text_features(tables.trades).select("row_id", *TEXT_SQL), footnote_routine_score=6)


@book.add(f"SELECT row_id, {WIDE} AS label_direction, {DIR} AS feature_direction FROM trades")
def p19_label_direction(tables):
    return tables.trades.select("row_id", t.direction(t.normal_code(F.col("transaction_code")), t.LABEL_BUY, t.LABEL_SELL).alias("label_direction"), t.direction(F.col("transaction_code")).alias("feature_direction"))


@book.add(f"{DIRECTED} SELECT row_id, {select(TRAILING_SQL)}, round(2 * count(*) OVER (PARTITION BY insider_cik ORDER BY d RANGE BETWEEN 90 PRECEDING AND 1 PRECEDING) / 90, 6) AS trade_frequency_90d FROM f")
def w01_w05_trailing_windows(tables):
    rows = round_money(history.trailing_windows(cents(directed(tables))))
    return rounded(rows.select("row_id", *TRAILING_SQL, "trade_frequency_90d"), trade_frequency_90d=6)


@book.add(f"""{DIRECTED}, x AS (SELECT row_id, {select(PAST_SQL)} FROM f WINDOW {HIST})
    SELECT *, round(CASE WHEN insider_buy_count + insider_sell_count > 0 THEN insider_buy_count / (insider_buy_count + insider_sell_count) ELSE 0.5 END, 6) AS insider_buy_sell_ratio FROM x""")
def w02_expanding_history(tables):
    rows = history.expanding_history(directed(tables)).select("row_id", *PAST_SQL, "insider_buy_sell_ratio")
    return rounded(off_half(rows), insider_avg_trade_value=3, insider_buy_sell_ratio=6)


@book.add(f"""f AS (SELECT *, {WIDE} AS dir FROM trades), x AS (SELECT row_id, CAST(sum(CAST(is_open_market AND dir = 1 AS INT)) OVER w AS BIGINT) AS b, CAST(sum(CAST(is_open_market AND dir = -1 AS INT)) OVER w AS BIGINT) AS s FROM f WINDOW {HIST})
    SELECT row_id, coalesce(b, 0) AS insider_buy_count, coalesce(s, 0) AS insider_sell_count FROM x""")
def w02_expanding_history_wide_codes(tables):
    return history.expanding_history(t.add_direction(tables.trades, t.LABEL_BUY, t.LABEL_SELL)).select("row_id", "insider_buy_count", "insider_sell_count")


@book.add(f"""{DIRECTED}, g AS (SELECT *, coalesce(datediff('day', lag(transaction_date) OVER v, transaction_date), 0) AS days_since_last_trade, CASE WHEN dir = 0 OR lag(dir) OVER v IS DISTINCT FROM dir THEN 1 ELSE 0 END AS start FROM f WINDOW v AS (PARTITION BY insider_cik ORDER BY transaction_date, row_id)),
    h AS (SELECT *, sum(start) OVER (PARTITION BY insider_cik ORDER BY transaction_date, row_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT row_id, days_since_last_trade, CASE WHEN dir = 0 THEN 1 ELSE row_number() OVER (PARTITION BY insider_cik, run ORDER BY transaction_date, row_id) END AS consecutive_direction FROM h""")
def w03_w04_recency_and_streak(tables):
    return history.recency_and_streak(directed(tables)).select("row_id", "days_since_last_trade", F.col("consecutive_direction").cast("long").alias("consecutive_direction"))


J6_SQL = f"""{DIRECTED}, j AS (
      SELECT a.row_id, count(b.row_id) AS o, count(CASE WHEN a.dir <> 0 AND b.dir = a.dir THEN 1 END) AS s, count(CASE WHEN a.dir <> 0 AND b.dir = -a.dir THEN 1 END) AS p
      FROM f a LEFT JOIN f b ON a.ticker = b.ticker AND b.is_open_market AND a.insider_cik <> b.insider_cik AND b.d BETWEEN a.d - 3 AND a.d + 3 GROUP BY a.row_id)"""


@book.add(f"{J6_SQL} SELECT row_id, o AS other_insiders_72h, s AS same_dir_insiders_72h, p AS opp_dir_insiders_72h, round(s / greatest(o, 1), 6) AS coordination_score, CAST(s >= 2 AS INT) AS cluster_flag FROM j")
def j06_w09_nearby_insiders(tables):
    out = history.nearby_insiders(directed(tables))
    return rounded(out.select("row_id", "other_insiders_72h", "same_dir_insiders_72h", "opp_dir_insiders_72h", "coordination_score", "cluster_flag"), coordination_score=6)


@book.add(f"{J6_SQL} SELECT row_id, o AS other_insiders_72h, s AS same_dir_insiders_72h, p AS opp_dir_insiders_72h FROM j")
def j06_nearby_insiders_join_form(tables):
    return history.nearby_insiders_by_join(directed(tables))


C2_COLUMNS = [c for c in (*history.ID_COLUMNS, *history.NUMERIC, *history.CATEGORICAL)]
_ALL = TRADE_SQL | ROLE_SQL | TEXT_SQL | PAST_SQL | TRAILING_SQL
_SIMPLE = {k: v for k, v in _ALL.items() if k in history.NUMERIC + history.CATEGORICAL}


@book.add(f"""{J6_SQL}, g AS (SELECT *, coalesce(datediff('day', lag(transaction_date) OVER v, transaction_date), 0) AS days_since_last_trade, CASE WHEN dir = 0 OR lag(dir) OVER v IS DISTINCT FROM dir THEN 1 ELSE 0 END AS start FROM f WINDOW v AS (PARTITION BY insider_cik ORDER BY transaction_date, row_id)),
    h AS (SELECT *, sum(start) OVER (PARTITION BY insider_cik ORDER BY transaction_date, row_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
    k AS (SELECT row_id, ticker, insider_cik, transaction_date, transaction_code, is_open_market, is_derivative, days_since_last_trade,
          CASE WHEN dir = 0 THEN 1 ELSE row_number() OVER (PARTITION BY insider_cik, run ORDER BY transaction_date, row_id) END AS consecutive_direction,
          {select(_SIMPLE)}, {PAST_SQL['insider_buy_count']} AS nb, {PAST_SQL['insider_sell_count']} AS ns FROM h WINDOW {HIST})
    SELECT k.* EXCLUDE (nb, ns), round(CASE WHEN nb + ns > 0 THEN nb / (nb + ns) ELSE 0.5 END, 6) AS insider_buy_sell_ratio, round(trades_90d / 90, 6) AS trade_frequency_90d,
           o AS other_insiders_72h, s AS same_dir_insiders_72h, round(s / greatest(o, 1), 6) AS coordination_score, CAST(s >= 2 AS INT) AS cluster_flag FROM k JOIN j USING (row_id)""")
def c02_feature_matrix(tables):
    out = history.model_matrix(tables.trades, history.NUMERIC + history.CATEGORICAL, *history.ID_COLUMNS, exact=cents)
    out = history.features_only(history.drop_unused(round_money(out))).withColumns({"signed_value": F.round(F.col("signed_value").cast("double"), 4), "consecutive_direction": F.col("consecutive_direction").cast("long")})
    return rounded(off_half(out), log_shares=6, log_total_value=6, log_shares_owned_after=6, pct_position_traded=6, insider_avg_trade_value=3, insider_buy_sell_ratio=6,
                   trade_frequency_90d=6, coordination_score=6, footnote_routine_score=6)


@book.add("""SELECT row_id, split_part(insider_cik || '.0', '.', 1) AS plain_cik, CASE WHEN row_id % 5 = 0 THEN substr(md5(insider_name), 1, 20) ELSE insider_cik END AS cache_key,
    upper(trim(' ' || lower(ticker) || ' ')) AS ticker, trim(regexp_replace(regexp_replace(lower(coalesce(footnote_text, '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS note FROM trades""")
def p17_p30_p36_normalised_names(tables):
    own = tables.trades
    cik = F.when(F.col("row_id") % 5 != 0, F.col("insider_cik"))
    return own.select("row_id", t.plain_cik(F.concat("insider_cik", F.lit(".0"))).alias("plain_cik"), t.cache_key(cik, F.col("insider_name")).alias("cache_key"),
                      t.normal_ticker(F.concat(F.lit(" "), F.lower("ticker"), F.lit(" "))).alias("ticker"), t.normal_text(F.coalesce("footnote_text", F.lit(""))).alias("note"))
