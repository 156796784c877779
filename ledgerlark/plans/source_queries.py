"""Queries of sources: documents, payloads and merges made from the driver tables and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import trade as t
from ledgerlark.operators import evaluate
from ledgerlark.sources import filings, market
from ledgerlark.sources.shared import scratch
from ledgerlark.plans.tables import Book
from ledgerlark.streaming import incremental

book = Book()
#: Items of one ticker and day in the feeds of c04.
LINKS_A_DAY = 3


def filing_texts(tables) -> DataFrame:
    """A filing in an SGML wrapper for each order and supplier, with all its trades as transactions."""
    tag = lambda n, v: F.concat(F.lit(f"<{n}><value>"), v.cast("string"), F.lit(f"</value></{n}>"))
    plain = lambda n, v: F.concat(F.lit(f"<{n}>"), F.coalesce(v.cast("string"), F.lit("")), F.lit(f"</{n}>"))
    wrap = lambda n, *parts: F.concat(F.lit(f"<{n}>"), *parts, F.lit(f"</{n}>"))
    own = tables.trades
    cents = F.col("price_per_share").cast("decimal(20,6)")
    txn = F.concat(
        tag("securityTitle", F.lit("Common")), tag("transactionDate", F.date_format("transaction_date", "yyyy-MM-dd")), wrap("transactionCoding", plain("transactionCode", F.col("transaction_code"))),
        wrap("transactionAmounts", tag("transactionShares", F.col("shares").cast("int")), tag("transactionPricePerShare", cents)),
        wrap("postTransactionAmounts", tag("sharesOwnedFollowingTransaction", F.col("shares_owned_after").cast("int"))),
    )
    rows = own.withColumns({"_nd": F.when(~F.col("is_derivative"), wrap("nonDerivativeTransaction", txn)), "_d": F.when(F.col("is_derivative"), wrap("derivativeTransaction", txn))})
    flag = lambda c: F.when(c, "1").otherwise("0")
    by = ("accession_number", "ticker", "issuer_cik", "insider_cik", "insider_name", "officer_title", "is_director", "is_officer", "is_amendment")
    docs = rows.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("_nd")), "").alias("nd"), F.array_join(F.array_sort(F.collect_list("_d")), "").alias("d"), F.max("filing_date").alias("signed"),
                                 F.max("footnote_text").alias("note"))
    xml = wrap(
        "ownershipDocument", plain("documentType", F.when(F.col("is_amendment"), "4/A").otherwise("4")),
        wrap("issuer", plain("issuerCik", F.col("issuer_cik")), plain("issuerName", F.col("ticker")), plain("issuerTradingSymbol", F.col("ticker"))),
        wrap("reportingOwner", wrap("reportingOwnerId", plain("rptOwnerCik", F.col("insider_cik")), plain("rptOwnerName", F.col("insider_name"))),
             wrap("reportingOwnerRelationship", plain("isDirector", flag(F.col("is_director"))), plain("isOfficer", flag(F.col("is_officer"))), plain("officerTitle", F.col("officer_title")))),
        wrap("nonDerivativeTable", F.col("nd")), wrap("derivativeTable", F.col("d")),
        F.lit("<footnotes><footnote id=\"F1\">"), F.coalesce("note", F.lit("")), F.lit("</footnote></footnotes>"), wrap("ownerSignature", plain("signatureDate", F.date_format("signed", "yyyy-MM-dd"))),
    )
    text = F.concat(F.lit("<SEC-DOCUMENT>\n<TYPE>4\n<XML>\n"), xml, F.lit("\n</XML>\n</SEC-DOCUMENT>"))
    return docs.select(F.concat(F.lit("/filings/"), "ticker", F.lit("/"), "accession_number", F.lit(".txt")).alias("path"), text.alias("text"))


FILED = "g AS (SELECT accession_number AS a, ticker AS k, officer_title AS o, max(filing_date) AS filed, coalesce(max(footnote_text), '') AS note FROM trades GROUP BY 1, 2, 3)"


@book.add(f"""{FILED} SELECT accession_number, ticker, issuer_cik, insider_cik, insider_name, insider_role, filed AS filing_date, contains(lower(note), '10b5-1') AS has_10b5_1_plan, note AS footnote_text, is_amendment, transaction_date,
      transaction_code, shares, round(CAST(price_per_share AS DECIMAL(20,6)), 3)::DOUBLE AS price, is_open_market, is_derivative, shares_owned_after, count(*) AS n
      FROM trades JOIN g ON accession_number = a AND ticker = k AND officer_title IS NOT DISTINCT FROM o GROUP BY ALL""")
def s01_s06_filings_to_transactions(tables):
    out = filings.parse_to_trades(filing_texts(tables))
    return out.groupBy("accession_number", "ticker", "issuer_cik", "insider_cik", "insider_name", "insider_role", "filing_date", "has_10b5_1_plan", "footnote_text", "is_amendment", "transaction_date", "transaction_code",
                       "shares", F.round(F.col("price_per_share").cast("decimal(20,6)"), 3).cast("double").alias("price"), "is_open_market", "is_derivative", "shares_owned_after").agg(F.count("*").alias("n"))


@book.add("""SELECT ticker, date, round(close, 8) AS close FROM daily_prices""")
def s12_chart_payloads(tables):
    p = tables.daily_prices.withColumn("x", F.struct(F.unix_seconds(F.col("date").cast("timestamp")).alias("s"), F.col("close").alias("c")))
    lists = p.groupBy("ticker").agg(F.array_sort(F.collect_list("x")).alias("x"))
    payload = F.to_json(F.struct(F.col("x.s").alias("timestamp"), F.col("x.c").alias("close")))
    return market.chart_prices(lists.select("ticker", payload.alias("payload"))).withColumn("close", F.round("close", 8))


@book.add("""o AS (SELECT ticker, date, close, 0 AS s FROM daily_prices WHERE day(date) <= 20 UNION ALL SELECT ticker, date, close + 1, 1 FROM daily_prices WHERE day(date) >= 11)
    SELECT ticker, date, round(arg_max(close, s), 8) AS close FROM o GROUP BY 1, 2""")
def s09_s10_w07_merge_prices(tables):
    text = tables.daily_prices.select("ticker", F.date_format("date", "MM/dd/yyyy").alias("date"), F.col("close").cast("string").alias("close"))
    p = market.clean_prices(text)
    new = p.filter(F.dayofmonth("date") >= 11).withColumn("close", F.col("close") + 1)
    return market.merge_prices(p.filter(F.dayofmonth("date") <= 20), new).select("ticker", "date", F.round("close", 8).alias("close"))


REQUESTS = "rq AS (SELECT ticker, min(transaction_date) + 100 AS s, max(transaction_date) - CAST(CAST(substr(ticker, 2) AS INT) % 40 AS INT) AS e FROM trades GROUP BY 1), r2 AS (SELECT ticker, s, least(e, DATE '2001-06-01') AS e FROM rq)"


def requests(tables) -> DataFrame:
    off = (F.substring("ticker", 2, 20).cast("int") % 40).cast("int")
    return tables.trades.groupBy("ticker").agg(F.date_add(F.min("transaction_date"), 100).alias("start"), F.max("transaction_date").alias("e")).select("ticker", "start", F.date_sub("e", off).alias("end"))


@book.add(f"{REQUESTS} SELECT p.ticker, count(*) AS n, min(date) AS first, max(date) AS last FROM daily_prices p JOIN r2 USING (ticker) WHERE date BETWEEN s AND e GROUP BY 1")
def s11_price_range(tables):
    return market.price_range(tables.daily_prices, requests(tables), dt.date(2001, 6, 1)).groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@book.add(f"""{REQUESTS}, h AS (SELECT ticker, min(date) AS first, max(date) AS last FROM daily_prices WHERE CAST(substr(ticker, 2) AS INT) % 3 > 0 GROUP BY 1)
    SELECT r2.ticker, first, last, first IS NULL OR s < first OR e > last + 5 AS stale FROM r2 LEFT JOIN h USING (ticker)""")
def s11_price_coverage(tables):
    some = tables.daily_prices.filter("cast(substring(ticker, 2) as int) % 3 > 0")
    return market.coverage(some, requests(tables), dt.date(2001, 6, 1))


@book.add("""x AS (SELECT ticker, announcement_date, row_number() OVER (PARTITION BY ticker ORDER BY announcement_date DESC) AS n FROM earnings)
    SELECT ticker, announcement_date, lpad(substr(ticker, 2), 10, '0') AS cik FROM x WHERE n <= 3""")
def s13_w10_filing_index(tables):
    return market.filing_dates(filing_payloads(tables), most=3).withColumn("cik", market.padded_cik(F.substring("ticker", 2, 20)))


def filing_payloads(tables) -> DataFrame:
    """A feed for each ticker, of its earnings dates under two forms, one of which counts."""
    e = tables.earnings.withColumn("x", F.struct(F.date_format("announcement_date", "yyyy-MM-dd").alias("d"), F.lit("10-Q").alias("f")))
    noise = e.withColumn("x", F.struct(F.col("x.d"), F.lit("8-K").alias("f")))
    lists = e.unionByName(noise).groupBy("ticker").agg(F.reverse(F.array_sort(F.collect_list("x"))).alias("x"))
    return lists.select("ticker", F.to_json(F.struct(F.col("x.f").alias("form"), F.col("x.d").alias("filingDate"))).alias("payload"))


@book.add("SELECT DISTINCT ticker, announcement_date FROM earnings")
def s14_calendar_dates(tables):
    text = tables.earnings.select(F.lower("ticker").alias("ticker"), F.concat(F.date_format("announcement_date", "yyyy-MM-dd"), F.lit(" 16:00:00")).alias("value"))
    return market.calendar_dates(text.unionAll(text).unionAll(text.select("ticker", F.lit("n/a").alias("value"))))


@book.add("""SELECT DISTINCT ticker, announcement_date, CASE WHEN year(announcement_date) >= 1998 THEN 'new' ELSE 'old' END AS origin FROM earnings""")
def s16_s17_event_upsert(tables):
    e = tables.earnings
    old = e.filter("year(announcement_date) <= 1999").withColumn("origin", F.lit("old"))
    new = e.filter("year(announcement_date) >= 1998").select(F.lower("ticker").alias("ticker"), "announcement_date").withColumn("origin", F.lit("new"))
    return market.upsert_events(old, new, ("ticker", "announcement_date"))


ALIASES = """al0 AS (SELECT 'T' || s_suppkey AS ticker, lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)) AS a FROM supplier JOIN benchmark ON s_suppkey % 40 = item_id % 40),
    al1 AS (SELECT ticker, trim(regexp_replace(regexp_replace(a, '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS alias FROM al0 UNION SELECT 'T' || s_suppkey, 't' || s_suppkey FROM supplier), al AS (SELECT DISTINCT * FROM al1 WHERE length(alias) >= 3),
    it AS (SELECT doc_id, text || CASE WHEN doc_id % 10 = 0 THEN ' T' || (doc_id % 7 + 1) ELSE '' END AS text FROM documents),
    nt AS (SELECT doc_id, ' ' || trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) || ' ' AS n, string_split(regexp_replace(upper(text), '[^A-Z0-9_]+', ' ', 'g'), ' ') AS u FROM it)"""


@book.add(f"""{ALIASES}, ba AS (SELECT doc_id, ticker, min(alias) AS alias FROM nt JOIN al ON contains(n, ' ' || alias || ' ') GROUP BY 1, 2), bt AS (SELECT doc_id, 'T' || s_suppkey AS ticker FROM nt JOIN supplier ON list_contains(u, 'T' || s_suppkey))
    SELECT doc_id, ticker, CASE WHEN bt.ticker IS NOT NULL THEN 'ticker:' || ticker ELSE 'alias:' || alias END AS matched_by FROM ba FULL JOIN bt USING (doc_id, ticker)""")
def j12_s18_ticker_mentions(tables):
    tickers = tables.supplier.select(F.concat(F.lit("T"), "s_suppkey").alias("ticker"))
    first = F.split("text", " ")
    raw = tables.supplier.join(tables.benchmark, F.col("s_suppkey") % 40 == F.col("item_id") % 40).select(F.concat(F.lit("t"), "s_suppkey").alias("ticker"), F.concat_ws(" ", first[0], first[1]).alias("alias"))
    items = tables.documents.select("doc_id", F.concat("text", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit(" T"), (F.col("doc_id") % 7 + 1).cast("string"))).otherwise("")).alias("text"))
    return market.match_tickers(items, market.alias_table(raw, tickers), tickers, key="doc_id")


@book.add("""SELECT ticker, action_date, count(*) AS n FROM enforcement GROUP BY 1, 2""")
def s15_c04_enforcement_items(tables):
    e, feeds = tables.enforcement, news_feeds(tables)
    found = market.news_items(feeds.select("text"))
    tickers = e.select("ticker").distinct()
    named = market.match_tickers(found.withColumn("item_id", F.xxhash64("title", "action_date")), market.alias_table(tickers.select("ticker", F.col("ticker").alias("alias")), tickers), tickers, text="title")
    return found.withColumn("item_id", F.xxhash64("title", "action_date")).join(named, "item_id").groupBy("ticker", "action_date").agg(F.count("*").alias("n"))


def news_feeds(tables, links: int = 1) -> DataFrame:
    """A feed for each ticker: its actions, with several links of a day if asked for, and items that aren't any or have no date."""
    e = tables.enforcement
    several = e.select("ticker", "action_date", F.explode(F.sequence(F.lit(0), F.lit(links - 1))).alias("k"))
    said = F.concat("ticker", F.lit(" charged with fraud"), *([F.lit(" "), F.col("k").cast("string")] if links > 1 else []))
    link = F.concat_ws("/", F.lit("https://news.example"), "ticker", F.date_format("action_date", "yyyyMMdd"), F.col("k").cast("string"))
    items = several.select("ticker", said.alias("title"), F.lit("A settlement").alias("description"), F.date_format("action_date", "EEE, d MMM yyyy 12:00:00 'GMT'").alias("pubDate"), link.alias("link"))
    noise = items.withColumns({"title": F.lit("weather"), "description": F.lit("sunny")}).unionByName(items.withColumn("pubDate", F.lit("soon")))
    item = F.concat(F.lit("<item><title>"), "title", F.lit("</title><description>"), "description", F.lit("</description><pubDate>"), "pubDate", F.lit("</pubDate><link>"), "link", F.lit("</link></item>"))
    return items.unionByName(noise).withColumn("i", item).groupBy("ticker").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list("i"), ""), F.lit("</channel></rss>")).alias("text"))


@book.add(f"""SELECT DISTINCT 'earnings' AS kind, ticker, announcement_date AS date, NULL::VARCHAR AS source_title, NULL::VARCHAR AS source_link, NULL::VARCHAR AS matched_by FROM earnings
    UNION ALL SELECT DISTINCT 'enforcement', ticker, action_date, ticker || ' charged with fraud ' || k, 'https://news.example/' || ticker || '/' || strftime(action_date, '%Y%m%d') || '/' || k, 'ticker:' || ticker FROM enforcement, (SELECT unnest(range({LINKS_A_DAY})) AS k)
    UNION ALL SELECT DISTINCT 'enforcement', ticker, action_date, NULL, '', NULL FROM enforcement WHERE year(action_date) <= 1996""")
def c04_event_build(tables):
    """Half of the earnings is stored, half of it comes from a calendar, and all from feeds; the actions come from feeds, several links a day."""
    e, early = tables.earnings, F.year("announcement_date") <= 1997
    tickers = tables.enforcement.select("ticker").distinct()
    calendar = e.filter(~early).select("ticker", F.date_format("announcement_date", "yyyy-MM-dd").alias("value"))
    earnings, enforcement = market.build_events(
        filing_payloads(tables), calendar, news_feeds(tables, LINKS_A_DAY).select("text"), tickers.select("ticker", F.col("ticker").alias("alias")), tickers,
        e.filter(early).select("ticker", "announcement_date"), tables.enforcement.filter("year(action_date) <= 1996").select("ticker", "action_date"),
    )
    told = ("source_title", "source_link", "matched_by")
    one = lambda df, kind, date, *also: df.select(F.lit(kind).alias("kind"), "ticker", F.col(date).alias("date"), *also)
    return one(enforcement, "enforcement", "action_date", *told).unionByName(one(earnings, "earnings", "announcement_date"), allowMissingColumns=True)


@book.add("SELECT row_id, TRY_CAST(replace(replace('$' || CAST(CAST(shares AS BIGINT) AS VARCHAR) || ',0', ',', ''), '$', '') AS DOUBLE) AS amount, transaction_date AS d FROM trades")
def s03_lenient_parsing(tables):
    forms = F.when(F.col("row_id") % 3 == 0, F.date_format("transaction_date", "yyyy-MM-dd")).when(F.col("row_id") % 3 == 1, F.date_format("transaction_date", "MM/dd/yyyy")).otherwise(F.date_format("transaction_date", "yyyyMMdd"))
    return tables.trades.select("row_id", t.lenient_double(F.concat(F.lit("$ "), F.col("shares").cast("bigint").cast("string"), F.lit(",0"))).alias("amount"), t.lenient_date(forms).alias("d"))


@book.add("SELECT dataset_split, count(*) AS n, round(avg(prob), 5) AS mean_score FROM (SELECT prob, CASE WHEN year(transaction_date) <= 1998 THEN 'train' WHEN year(transaction_date) = 1999 THEN 'val' ELSE 'test' END AS dataset_split FROM scored WHERE year(transaction_date) <= 2000) GROUP BY 1")
def s19_s20_o04_saved_splits(tables):
    base = scratch(tables.spark, "splits")
    market.save_table(evaluate.time_split(tables.scored, 1998, 2000), base, by=("dataset_split",))
    return tables.spark.read.parquet(base).groupBy("dataset_split").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 5).alias("mean_score"))


@book.add("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(20,4))) AS DOUBLE), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def a12_streamed_daily_summary(tables):
    return incremental.daily_summary_stream(tables.spark, f"{tables.sf_dir}/events.parquet")
