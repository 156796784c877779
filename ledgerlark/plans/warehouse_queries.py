"""Queries of profiles, cleaning and the star schema."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators import profile, warehouse
from ledgerlark.plans.tables import Book
from ledgerlark.sources.shared import scratch, written
from ledgerlark.streaming import incremental

book = Book()

AS_OF = dt.date(2001, 6, 1)
PROFILED = ("ticker", "insider_role", "officer_title", "transaction_code", "is_open_market", "is_derivative", "has_10b5_1_plan", "footnote_text", "shares", "price_per_share", "total_value", "shares_owned_after", "transaction_date", "filing_date")
NUMERIC = ("shares", "price_per_share", "total_value", "shares_owned_after")
TEXTUAL = ("ticker", "insider_role", "officer_title", "transaction_code", "footnote_text")
DIRTY = f"dirty AS (SELECT {', '.join(PROFILED)} FROM trades UNION ALL SELECT {', '.join(PROFILED)} FROM trades WHERE row_id % 100 = 0)"
KINDS = "kinds AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {ord(c)}, '{d}', {'NULL' if b is None else str(b).lower()})" for c, d, _, _, b, _ in warehouse.TRANSACTION_TYPES
) + ") v(code, type_key, description, buy))"
KEY60 = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
CALENDAR = (dt.date(1995, 1, 1), dt.date(2001, 12, 31))
FACT = f"""{KINDS}, fact AS (SELECT row_id AS trade_id, accession_number, {KEY60.format("'company|' || issuer_cik")} AS company_key, {KEY60.format("'insider|' || insider_cik")} AS insider_key,
    CAST(strftime(transaction_date, '%Y%m%d') AS INT) AS time_key, type_key AS transaction_type_key, transaction_date, filing_date, shares, price_per_share, total_value, ticker, issuer_cik, insider_cik, insider_name, insider_role, has_10b5_1_plan, buy, description
    FROM trades LEFT JOIN kinds ON code = transaction_code)"""
M = "CAST({} AS DECIMAL(20,4))"
BUY, SELL = "coalesce(buy, false)", "coalesce(NOT buy, false)"


def total(side: str, value: str) -> str:
    return f"round(CAST(sum(CASE WHEN {side} THEN coalesce({M.format(value)}, 0) ELSE 0 END) AS DOUBLE), 4)"


def dirty(tables) -> DataFrame:
    own = tables.trades
    return own.select(*PROFILED).unionAll(own.filter("row_id % 100 = 0").select(*PROFILED))


def star(tables):
    trades = tables.trades
    kinds, time = warehouse.dim_transaction_type(tables.spark), warehouse.dim_time(tables.spark, *CALENDAR)
    company, insider = warehouse.dim_company(trades), warehouse.dim_insider(trades)
    # The dimensions are those of all trades.
    return warehouse.facts(trades, None, None, time, kinds), company, insider, time, kinds


def loaded_facts(tables) -> DataFrame:
    """The facts of :func:`star`, written once for their loads."""
    return written(star(tables)[0], "facts")


KINDS_OF = {c: "string" for c in TEXTUAL} | {c: "double" for c in NUMERIC} | {c: "boolean" for c in ("is_open_market", "is_derivative", "has_10b5_1_plan")} | {c: "date" for c in ("transaction_date", "filing_date")}
PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS name, '{KINDS_OF[c]}' AS dtype, count(*) AS \"rows\", count(*) - count({c}) AS missing, round(100 * (count(*) - count({c})) / count(*), 4) AS missing_pct, count(DISTINCT {c}) AS distinct_values FROM dirty"
    for c in PROFILED
)


@book.add(f"{DIRTY} {PROFILE_SQL}".replace(f"{DIRTY} SELECT", f"{DIRTY} SELECT", 1))
def a01_column_profile(tables):
    return profile.column_profile(dirty(tables))


@book.add(f"{DIRTY} SELECT name, \"rows\", missing, true AS within FROM ({PROFILE_SQL})")
def a01_a06_incremental_profile(tables):
    """Profiles kept by filing year, those of later years added afterwards; distinct values are within the sketches' error of the exact ones."""
    own, year = dirty(tables), F.year("filing_date")
    kept = profile.profile_sketches(own.filter(year < 1998), year).unionByName(profile.profile_sketches(own.filter(F.coalesce(year, F.lit(9999)) >= 1998), year))
    exact = profile.column_profile(own).select("name", F.col("distinct_values").alias("exact"))
    near = F.abs(F.col("distinct_values") - F.col("exact")) <= profile.SKETCH_ERROR * F.col("exact")
    return profile.united_profile(kept).join(exact, "name").select("name", "rows", "missing", near.alias("within"))


def moments(c: str) -> str:
    return f"""SELECT '{c}' AS name, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75, max({c}) AS max,
      round(sum(power({c} - m, 3)) / count({c}) / power(any_value(s), 3), 6) AS skewness, round(sum(power({c} - m, 4)) / count({c}) / power(any_value(s), 4) - 3, 6) AS kurtosis
      FROM dirty, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM dirty)"""


@book.add(f"{DIRTY} " + " UNION ALL ".join(moments(c) for c in NUMERIC))
def a02_a03_numeric_summary(tables):
    out = profile.numeric_summary(dirty(tables))
    return out.withColumns({c: F.round(c, n) for c, n in (("mean", 4), ("std", 4), ("skewness", 6), ("kurtosis", 6))})


@book.add(f"{DIRTY} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS name, count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers, count({c}) AS present,
        round(100 * count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) / count({c}), 4) AS outlier_pct FROM dirty, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM dirty)"""
    for c in NUMERIC))
def a04_iqr_outliers(tables):
    return profile.iqr_outliers(dirty(tables))


_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value FROM dirty" for c in (*TEXTUAL, "is_open_market", "is_derivative", "has_10b5_1_plan"))


@book.add(f"""{DIRTY}, cells AS ({_CELLS}), n AS (SELECT name, value, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY 1, 2)
    SELECT name, value, n, CAST(row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS INT) AS place FROM n QUALIFY place <= 10""")
def a05_top_values(tables):
    return profile.top_values(dirty(tables))


@book.add(f"{DIRTY}, u AS (SELECT DISTINCT * FROM dirty) SELECT (SELECT count(*) FROM dirty) AS \"rows\", count(*) AS distinct_rows, (SELECT count(*) FROM dirty) - count(*) AS duplicate_rows FROM u")
def a06_duplicate_rows(tables):
    return profile.duplicate_rows(dirty(tables))


@book.add(f"{DIRTY} SELECT transaction_code, count(*) AS n, (SELECT min(transaction_date) FROM dirty) AS date_min, (SELECT max(transaction_date) FROM dirty) AS date_max FROM dirty GROUP BY 1")
def a07_distribution_and_dates(tables):
    own = dirty(tables)
    return profile.value_distribution(own, "transaction_code").crossJoin(profile.date_range(own))  # one row


_NAMES = "coalesce(string_agg(name, ', ' ORDER BY name) FILTER ({}), '')"


@book.add(f"""{DIRTY}, p AS ({PROFILE_SQL}), u AS (SELECT DISTINCT * FROM dirty),
    s AS (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM u) AS dup, count(*) FILTER (transaction_date > DATE '{AS_OF}') AS ft, count(*) FILTER (filing_date > DATE '{AS_OF}') AS ff, count(*) FILTER (price_per_share > 10000) AS hi,
      count(*) FILTER (price_per_share < 0) AS np, count(*) FILTER (shares < 0) AS ns, count(*) FILTER (total_value < 0) AS nv, 100 * avg(CAST(has_10b5_1_plan AS INT)) AS plan,
      (SELECT 100 * max(c) / sum(c) FROM (SELECT count(*) AS c FROM dirty WHERE transaction_code IS NOT NULL GROUP BY transaction_code)) AS top FROM dirty),
    o AS (SELECT round(100 * count(*) FILTER (price_per_share < a - 1.5 * (b - a) OR price_per_share > b + 1.5 * (b - a)) / count(price_per_share), 4) AS price_outlier_pct FROM dirty, (SELECT quantile_cont(price_per_share, 0.25) AS a, quantile_cont(price_per_share, 0.75) AS b FROM dirty)),
    c AS (SELECT {_NAMES.format('missing_pct > 50')} AS mostly_missing, {_NAMES.format('distinct_values = 1')} AS constant, {_NAMES.format("distinct_values > 0.9 * rows AND dtype = 'string'")} AS high_cardinality,
      {_NAMES.format("missing_pct > 20 AND name NOT IN ('footnote_text', 'officer_title')")} AS to_impute FROM p)
    SELECT n AS "rows", dup AS duplicate_rows, mostly_missing, constant, high_cardinality, price_outlier_pct,
      array_to_string(list_filter([CASE WHEN dup > 0 THEN dup || ' duplicate rows' END, CASE WHEN mostly_missing <> '' THEN 'more than half missing: ' || mostly_missing END, CASE WHEN constant <> '' THEN 'constant: ' || constant END,
        CASE WHEN ff > 0 THEN ff || ' future filing_date' END, CASE WHEN ft > 0 THEN ft || ' future transaction_date' END, CASE WHEN np > 0 THEN np || ' negative price_per_share' END, CASE WHEN ns > 0 THEN ns || ' negative shares' END,
        CASE WHEN nv > 0 THEN nv || ' negative total_value' END, CASE WHEN hi > 0 THEN hi || ' prices above 10000' END], lambda x: x IS NOT NULL), '; ') AS warnings,
      array_to_string(list_filter([CASE WHEN dup > 0 THEN 'remove duplicate rows' END, CASE WHEN to_impute <> '' THEN 'impute: ' || to_impute END, CASE WHEN price_outlier_pct > 5 THEN 'winsorise price_per_share' END,
        CASE WHEN top > 70 THEN 'stratify by transaction_code' END, CASE WHEN plan < 5 THEN 'review plan parsing' END], lambda x: x IS NOT NULL), '; ') AS recommendations FROM s, c, o""")
def a08_warnings(tables):
    """The whole report."""
    rep = profile.quality_report(dirty(tables), AS_OF)
    return rep.select("rows", "duplicate_rows", "price_outlier_pct", *[F.array_join(c, ", ").alias(c) for c in ("mostly_missing", "constant", "high_cardinality")], *[F.array_join(c, "; ").alias(c) for c in ("warnings", "recommendations")])


@book.add(f"""{DIRTY}, u AS (SELECT DISTINCT * REPLACE (coalesce(transaction_date, filing_date) AS transaction_date) FROM dirty),
    c AS (SELECT quantile_cont(price_per_share, [0.01, 0.99]) FILTER (price_per_share > 0) AS p, quantile_cont(shares, [0.01, 0.99]) FILTER (shares > 0) AS s, quantile_cont(total_value, [0.01, 0.99]) FILTER (total_value > 0) AS v FROM u)
    SELECT ticker, transaction_code, transaction_date, round(CASE WHEN price_per_share > 0 THEN greatest(least(price_per_share, p[2]), p[1]) ELSE price_per_share END, 8) AS price_per_share,
      round(CASE WHEN shares > 0 THEN greatest(least(shares, s[2]), s[1]) ELSE shares END, 8) AS shares, round(CASE WHEN total_value > 0 THEN greatest(least(total_value, v[2]), v[1]) ELSE total_value END, 8) AS total_value
    FROM u, c WHERE NOT coalesce(price_per_share < 0 AND NOT is_derivative, false)""")
def a09_clean(tables):
    out = profile.clean(dirty(tables))
    return out.select("ticker", "transaction_code", "transaction_date", *[F.round(c, 8).alias(c) for c in ("price_per_share", "shares", "total_value")])


@book.add(f"""{DIRTY}, u AS (SELECT DISTINCT * FROM dirty) SELECT ticker, insider_role, count(*) AS n, round(CAST(sum(CAST(shares AS DECIMAL(20,4))) AS DOUBLE), 4) AS shares FROM u GROUP BY 1, 2""")
def c01_p38_p39_preflight(tables):
    own = dirty(tables).withColumn("source", F.lit("one value"))
    ready = profile.preflight(own.drop("price_per_share"), dt.date(2030, 1, 1))
    assert "source" not in ready.columns
    return ready.join(profile.clean(own.select("ticker", "insider_role").distinct(), "none"), ["ticker", "insider_role"]).groupBy("ticker", "insider_role").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("shares").cast("decimal(20,4)")).cast("double"), 4).alias("shares"))


@book.add(f"""{DIRTY}, u AS (SELECT DISTINCT * REPLACE (coalesce(transaction_date, filing_date) AS transaction_date) FROM dirty),
    o AS (SELECT 100 * count(*) FILTER (price_per_share < a - 1.5 * (b - a) OR price_per_share > b + 1.5 * (b - a)) / count(price_per_share) > 5 AS cap FROM dirty, (SELECT quantile_cont(price_per_share, 0.25) AS a, quantile_cont(price_per_share, 0.75) AS b FROM dirty)),
    c AS (SELECT quantile_cont(price_per_share, [0.01, 0.99]) FILTER (price_per_share > 0) AS p, quantile_cont(shares, [0.01, 0.99]) FILTER (shares > 0) AS s FROM u)
    SELECT ticker, transaction_code, transaction_date, round(CASE WHEN cap AND price_per_share > 0 THEN greatest(least(price_per_share, p[2]), p[1]) ELSE price_per_share END, 8) AS price_per_share,
      round(CASE WHEN cap AND shares > 0 THEN greatest(least(shares, s[2]), s[1]) ELSE shares END, 8) AS shares FROM u, c, o WHERE NOT coalesce(price_per_share < 0 AND NOT is_derivative, false)""")
def c01_preflight_of_all_columns(tables):
    """The gate and the capping with the prices in; a column of one value goes."""
    ready = profile.preflight(dirty(tables).withColumn("source", F.lit("one value")), dt.date(2030, 1, 1))
    assert "source" not in ready.columns
    return ready.select("ticker", "transaction_code", "transaction_date", *[F.round(c, 8).alias(c) for c in ("price_per_share", "shares")])


D1_SQL = f"""d AS (SELECT CAST(unnest(generate_series(DATE '{CALENDAR[0]}', DATE '{CALENDAR[1]}', INTERVAL 1 DAY)) AS DATE) AS date)
    SELECT CAST(strftime(date, '%Y%m%d') AS INT) AS time_key, date, CAST(year(date) AS INT) AS year, CAST(quarter(date) AS INT) AS quarter, CAST(month(date) AS INT) AS month, CAST(weekofyear(date) AS INT) AS week_of_year, CAST(dayofweek(date) AS INT) AS day_of_week,
      CAST(day(date) AS INT) AS day_of_month, rpad(dayname(date), 9, ' ') AS day_name, rpad(monthname(date), 9, ' ') AS month_name, dayofweek(date) IN (0, 6) AS is_weekend,
      date = last_day(date) AND month(date) IN (3, 6, 9, 12) AS is_quarter_end, date = last_day(date) AS is_month_end FROM d WHERE date NOT IN (SELECT transaction_date FROM trades WHERE insider_role = 'CEO')"""


@book.add(D1_SQL)
def d01_dim_time(tables):
    known = tables.trades.filter("insider_role = 'CEO'").select(F.col("transaction_date").alias("date")).distinct()
    return warehouse.dim_time(tables.spark, *CALENDAR, known=known)


@book.add(f"{KINDS} SELECT transaction_code, description, count(*) AS trades FROM trades LEFT JOIN kinds ON code = transaction_code GROUP BY 1, 2")
def d02_j08_types_of_trades(tables):
    kinds = warehouse.dim_transaction_type(tables.spark)
    return tables.trades.join(F.broadcast(kinds), F.col("transaction_code") == F.col("code"), "left").groupBy("transaction_code", "description").agg(F.count("*").alias("trades"))


@book.add(f"""SELECT insider_cik AS cik, arg_max(insider_name, (filing_date, row_id)) AS name, arg_max(insider_role, (filing_date, row_id)) AS typical_role, min(transaction_date) AS first_seen, {KEY60.format("'insider|' || insider_cik")} AS insider_key FROM trades GROUP BY insider_cik""")
def d03_j19_dim_insider(tables):
    own = tables.trades
    old = warehouse.dim_insider(own.filter("transaction_date < date'1998-01-01'"))
    return warehouse.dim_insider(own, known=old).select("cik", "name", "typical_role", F.least("first_seen", "first_seen").alias("first_seen"), "insider_key")


@book.add(f"{FACT} SELECT trade_id, company_key, insider_key, time_key, transaction_type_key, transaction_date FROM fact")
def s23_j08_facts(tables):
    return star(tables)[0].select("trade_id", "company_key", "insider_key", "time_key", "transaction_type_key", "transaction_date")


@book.add(f"""{FACT} SELECT company_key, arg_max(ticker, (filing_date, trade_id)) AS ticker, count(*) AS total_trades, count(DISTINCT insider_key) AS unique_insiders, count(*) FILTER ({BUY}) AS total_buys, count(*) FILTER ({SELL}) AS total_sells,
      {total(BUY, 'total_value')} AS value_bought, {total(SELL, 'total_value')} AS value_sold, round(CAST(sum({M.format('total_value')}) AS DOUBLE) / count(total_value) + 1e-6, 3) AS avg_trade_value FROM fact GROUP BY company_key""")
def a10_j10_company_activity(tables):
    fact, company, _, _, kinds = star(tables)
    return warehouse.company_activity(company, fact, kinds).withColumn("avg_trade_value", F.round(F.col("avg_trade_value") + 1e-6, 3))


@book.add(f"""{FACT} SELECT insider_key, count(*) AS total_trades, count(*) FILTER ({BUY}) AS total_buys, count(*) FILTER ({SELL}) AS total_sells, {total(BUY, 'total_value')} AS value_bought, {total(SELL, 'total_value')} AS value_sold,
      round(CAST(sum({M.format('total_value')}) AS DOUBLE) / count(total_value) + 1e-6, 2) AS avg_value, min(transaction_date) AS first_date, max(transaction_date) AS last_date FROM fact GROUP BY insider_key""")
def a11_j16_insider_statistics(tables):
    fact, _, insider, _, kinds = star(tables)
    out = warehouse.update_insiders(insider, warehouse.insider_statistics(fact, kinds))
    return out.select("insider_key", "total_trades", "total_buys", "total_sells", "value_bought", "value_sold", F.round(F.col("avg_value") + 1e-6, 2).alias("avg_value"), "first_date", "last_date")


#: The daily summary of a table of facts.
DAILY = f"""SELECT company_key, transaction_date AS date, count(*) FILTER ({BUY}) AS total_insider_buys, {total(BUY, 'shares')} AS total_shares_bought, {total(BUY, 'total_value')} AS total_value_bought,
      round(CAST(sum(CASE WHEN {BUY} THEN {M.format('price_per_share')} END) AS DOUBLE) / count(*) FILTER ({BUY}) + 1e-6, 2) AS avg_buy_price, count(*) FILTER ({SELL}) AS total_insider_sells, {total(SELL, 'shares')} AS total_shares_sold, {total(SELL, 'total_value')} AS total_value_sold,
      round(CAST(sum(CASE WHEN {SELL} THEN {M.format('price_per_share')} END) AS DOUBLE) / count(*) FILTER ({SELL}) + 1e-6, 2) AS avg_sell_price, count(DISTINCT insider_key) AS num_unique_insiders_trading,
      round(CAST(sum(CASE WHEN {BUY} THEN {M.format('shares')} WHEN {SELL} THEN -{M.format('shares')} ELSE 0 END) AS DOUBLE), 4) AS net_shares,
      round(CAST(sum(CASE WHEN {BUY} THEN coalesce({M.format('total_value')}, 0) WHEN {SELL} THEN -coalesce({M.format('total_value')}, 0) ELSE 0 END) AS DOUBLE), 4) AS net_value,
      round((count(*) FILTER ({BUY}) - count(*) FILTER ({SELL})) / count(*), 6) AS net_sentiment_score FROM {{}} GROUP BY 1, 2"""


@book.add(f"{FACT} {DAILY.format('fact')}")
def a12_j11_daily_summary(tables):
    fact, _, _, _, kinds = star(tables)
    return rounded_prices(warehouse.daily_summary(fact, kinds))


def rounded_prices(daily: DataFrame) -> DataFrame:
    return daily.withColumns({c: F.round(F.col(c) + 1e-6, 2) for c in ("avg_buy_price", "avg_sell_price")})


@book.add(f"""{FACT}, c AS (SELECT company_key, arg_max(ticker, (filing_date, trade_id)) AS t FROM fact GROUP BY 1), i AS (SELECT insider_key, arg_max(insider_name, (filing_date, trade_id)) AS n, arg_max(insider_role, (filing_date, trade_id)) AS r FROM fact GROUP BY 1)
    SELECT trade_id, t AS ticker, n AS insider_name, r AS typical_role, transaction_date AS trade_date, description AS transaction_type, shares AS shares_traded, round(price_per_share, 8) AS price_per_share, total_value, has_10b5_1_plan
    FROM fact JOIN c USING (company_key) JOIN i USING (insider_key) WHERE total_value >= 100000 AND filing_date >= DATE '{AS_OF}' - 30 ORDER BY total_value DESC, trade_id""")
def o01_j09_recent_high_value(tables):
    fact, company, insider, time, kinds = star(tables)
    return warehouse.recent_high_value(fact, company, insider, time, kinds, AS_OF).withColumn("price_per_share", F.round("price_per_share", 8))


@book.add(f"""{FACT}, stored AS (SELECT * FROM fact WHERE trade_id % 2 = 0), inc AS (SELECT *, CASE WHEN trade_id % 10 = 1 THEN NULL ELSE price_per_share END AS p FROM fact WHERE trade_id % 3 = 0 OR trade_id % 2 = 1)
    SELECT trade_id FROM inc WHERE p IS NULL UNION ALL SELECT min(trade_id) AS trade_id FROM inc WHERE p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.accession_number = inc.accession_number AND s.insider_key = inc.insider_key AND
      s.transaction_date = inc.transaction_date AND s.shares = inc.shares AND s.price_per_share = inc.p AND s.filing_date = inc.filing_date) GROUP BY accession_number, insider_key, transaction_date, shares, p, filing_date""")
def j15_insert_new(tables):
    fact = star(tables)[0]
    incoming = fact.filter("trade_id % 3 = 0 or trade_id % 2 = 1").withColumn("price_per_share", F.when(F.col("trade_id") % 10 != 1, F.col("price_per_share")))
    return warehouse.insert_new(fact.filter("trade_id % 2 = 0"), incoming).select("trade_id")


LOADED_YEARS = (1996, 2000)
#: The facts of :func:`load_in_parts`: of equal keys the first that was loaded.
LOADED = f"""{FACT}, loaded AS (SELECT * FROM fact WHERE year(filing_date) BETWEEN {LOADED_YEARS[0]} AND {LOADED_YEARS[1]}
    QUALIFY row_number() OVER (PARTITION BY accession_number, insider_key, transaction_date, shares, price_per_share, filing_date ORDER BY trade_id % 2, trade_id) = 1)"""


def loads(rows: DataFrame, by: str) -> list[DataFrame]:
    """Two disjoint loads and a third that repeats rows of both."""
    return [rows.filter(f"{by} % 2 = 0"), rows.filter(f"{by} % 2 = 1"), rows.filter(f"{by} % 3 = 0")]


@book.add(f"{LOADED} SELECT CAST(year(filing_date) AS INT) AS filing_year, count(*) AS trades, CAST(sum(trade_id % 1000003) AS BIGINT) AS ids, round(CAST(sum({M.format('total_value')}) AS DOUBLE), 2) AS total_value, count(DISTINCT company_key) AS companies FROM loaded GROUP BY 1")
def d04_d05_facts_by_year(tables):
    """Loaded in two halves and then in part again: both halves are kept and nothing is doubled."""
    path = scratch(tables.spark, "facts")
    for part in loads(loaded_facts(tables), "trade_id"):
        warehouse.merge_facts(part, path, years=LOADED_YEARS)
    warehouse.compact_facts(tables.spark, path)
    return tables.spark.read.parquet(path).groupBy("filing_year").agg(
        F.count("*").alias("trades"), F.sum(F.col("trade_id") % 1000003).alias("ids"), F.round(F.sum(F.col("total_value").cast("decimal(20,4)")).cast("double"), 2).alias("total_value"),
        F.count_distinct("company_key").alias("companies"),
    )


@book.add(f"{LOADED} {DAILY.format('loaded')}")
def a12_j15_streamed_trade_summary(tables):
    """Trades as a stream: two runs over new files, the second of which brings late rows, and a third that repeats rows of both."""
    base, kinds = scratch(tables.spark, "stream"), warehouse.dim_transaction_type(tables.spark)
    fact = loaded_facts(tables)
    out = None
    for part in loads(fact, "trade_id"):
        part.write.mode("append").parquet(f"{base}/in")
        read = tables.spark.readStream.schema(fact.schema).parquet(f"{base}/in")
        out = incremental.summarise_trades(read, base, kinds, LOADED_YEARS)
    return rounded_prices(out)


#: The tables of the warehouse as SQL, and the kinds of their columns: a number, a text or a truth.
WAREHOUSE = {
    "dim_transaction_type": ("SELECT code, type_key, description, buy AS is_buy_equivalent FROM kinds", {"code": "text", "type_key": "number", "description": "text", "is_buy_equivalent": "truth"}),
    "dim_time": (
        f"SELECT CAST(strftime(date, '%Y%m%d') AS INT) AS time_key, CAST(date AS VARCHAR) AS date, quarter(date) AS quarter, weekofyear(date) AS week_of_year, monthname(date) AS month_name, dayofweek(date) IN (0, 6) AS is_weekend FROM (SELECT CAST(unnest(generate_series(DATE '{CALENDAR[0]}', DATE '{CALENDAR[1]}', INTERVAL 1 DAY)) AS DATE) AS date)",
        {"time_key": "number", "date": "text", "quarter": "number", "week_of_year": "number", "is_weekend": "truth"},
    ),
    "dim_company": ("SELECT issuer_cik AS cik, arg_max(ticker, (filing_date, trade_id)) AS ticker, any_value(company_key) AS company_key FROM fact GROUP BY 1", {"cik": "text", "ticker": "text", "company_key": "number"}),
    "dim_insider": (
        f"""SELECT f.*, s.* EXCLUDE (k) FROM (SELECT insider_key, any_value(insider_cik) AS cik, any_value(insider_name) AS name, coalesce(min(transaction_date) FILTER (trade_id % 2 = 0), min(transaction_date)) AS first_seen FROM fact GROUP BY 1) f LEFT JOIN (SELECT insider_key AS k, count(*) AS total_trades, count(*) FILTER ({BUY}) AS total_buys,
        {total(SELL, 'total_value')} AS value_sold, CAST(max(transaction_date) AS VARCHAR) AS last_date FROM loaded GROUP BY 1) s ON k = insider_key""",
        {"insider_key": "number", "cik": "text", "name": "text", "first_seen": "text", "total_trades": "number", "total_buys": "number", "value_sold": "number", "last_date": "text"},
    ),
    "fact_trades": (
        "SELECT trade_id, accession_number, company_key, insider_key, time_key, transaction_type_key, transaction_date, filing_date, shares AS shares_traded, total_value, has_10b5_1_plan, is_amendment, footnote_text FROM loaded JOIN (SELECT row_id AS rid, is_amendment, footnote_text FROM trades) ON rid = trade_id",
        {"trade_id": "number", "accession_number": "text", "company_key": "number", "insider_key": "number", "time_key": "number", "transaction_type_key": "number", "transaction_date": "text", "filing_date": "text", "shares_traded": "number",
         "total_value": "number", "has_10b5_1_plan": "truth", "is_amendment": "truth", "footnote_text": "text"},
    ),
    "company_activity": (
        f"""SELECT c.company_key, ticker, coalesce(total_trades, 0) AS total_trades, coalesce(unique_insiders, 0) AS unique_insiders, coalesce(value_bought, 0) AS value_bought FROM (SELECT company_key, arg_max(ticker, (filing_date, trade_id)) AS ticker FROM fact GROUP BY 1) c
        LEFT JOIN (SELECT company_key AS k, count(*) AS total_trades, count(DISTINCT insider_key) AS unique_insiders, {total(BUY, 'total_value')} AS value_bought FROM loaded GROUP BY 1) ON k = company_key""",
        {"company_key": "number", "ticker": "text", "total_trades": "number", "unique_insiders": "number", "value_bought": "number"},
    ),
    "daily_summary": (
        f"""SELECT company_key, transaction_date AS date, count(*) FILTER ({BUY}) AS total_insider_buys, {total(SELL, 'shares')} AS total_shares_sold, {total(BUY, 'total_value')} AS total_value_bought, count(DISTINCT insider_key) AS num_unique_insiders_trading FROM loaded GROUP BY 1, 2""",
        {"company_key": "number", "date": "text", "total_insider_buys": "number", "total_shares_sold": "number", "total_value_bought": "number", "num_unique_insiders_trading": "number"},
    ),
}
MEASURES = {
    "number": ("sum(CAST({} AS DECIMAL(38,4)))", lambda c: F.sum(F.col(c).cast("decimal(38,4)"))),
    "text": ("sum(CAST('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 8) AS BIGINT))", lambda c: F.sum(F.conv(F.substring(F.md5(F.col(c).cast("string")), 1, 8), 16, 10).cast("long"))),
    "truth": ("count(*) FILTER ({})", lambda c: F.count_if(F.col(c))),
}


def contents_sql() -> str:
    """A row for each column of each table: its values that are there, and the sum of them or of their hashes."""
    ctes = ", ".join(f"{n}_t AS ({body})" for n, (body, _) in WAREHOUSE.items())
    rows = [f"SELECT '{n}' AS name, '{c}' AS col, count({c}) AS present, CAST({MEASURES[kind][0].format(c)} AS DOUBLE) AS total FROM {n}_t" for n, (_, cols) in WAREHOUSE.items() for c, kind in cols.items()]
    return f"{LOADED}, {ctes} {' UNION ALL '.join(rows)}"


@book.add(contents_sql())
def c06_warehouse_load(tables):
    """All tables of the warehouse by content, after two disjoint loads and one that repeats rows of both.

    An insider's first date is that of the load that brought the insider.
    """
    folder = scratch(tables.spark, "warehouse")
    for part in loads(written(tables.trades, "trades"), "row_id"):
        warehouse.load_warehouse(part, folder, *CALENDAR, years=LOADED_YEARS)
    found = []
    for name, (_, columns) in WAREHOUSE.items():
        cells = [F.struct(F.lit(c).alias("col"), F.count(c).alias("present"), MEASURES[kind][1](c).cast("double").alias("total")) for c, kind in columns.items()]
        found.append(tables.spark.read.parquet(f"{folder}/{name}").agg(F.array(*cells).alias("cells")).select(F.lit(name).alias("name"), F.explode("cells").alias("c")).select("name", "c.*"))
    return reduce(DataFrame.unionByName, found)
