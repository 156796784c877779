"""Star schema over the trades: dimensions, facts, statistics and views."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.sources.shared import stored, swap, written

# Transaction codes (code, description, category, open market, buy-equivalent, derivative).
TRANSACTION_TYPES = (
    ("P", "Open Market Purchase", "Open Market", True, True, False),
    ("S", "Open Market Sale", "Open Market", True, False, False),
    ("A", "Award/Grant of Securities", "Grant/Award", False, True, False),
    ("D", "Disposition to Issuer", "Disposition", False, False, False),
    ("F", "Payment of Exercise Price or Tax Liability", "Tax/Exercise", False, False, False),
    ("I", "Discretionary Transaction", "Discretionary", False, None, False),
    ("M", "Exercise of Derivative Security", "Exercise", False, None, True),
    ("C", "Conversion of Derivative Security", "Conversion", False, None, True),
    ("E", "Expiration of Short Derivative Position", "Expiration", False, None, True),
    ("H", "Expiration of Long Derivative Position", "Expiration", False, None, True),
    ("O", "Exercise of Out-of-Money Derivative", "Exercise", False, None, True),
    ("X", "Exercise of In-the-Money Derivative", "Exercise", False, None, True),
    ("G", "Gift", "Other", False, None, False),
    ("L", "Small Acquisition", "Other", False, True, False),
    ("W", "Acquisition or Disposition by Will/Laws", "Other", False, None, False),
    ("Z", "Deposit into Voting Trust", "Other", False, None, False),
    ("J", "Other Acquisition or Disposition", "Other", False, None, False),
    ("K", "Equity Swap or Similar Instrument", "Derivative", False, None, True),
    ("U", "Disposition pursuant to tender offer", "Tender", False, False, False),
    ("V", "Transaction Voluntarily Reported Early", "Other", False, None, False),
)
CALENDAR = (dt.date(2019, 1, 1), dt.date(2026, 12, 31))
#: Tasks that write a year of facts.
PARTS_A_YEAR = 16
FACT_YEARS = (2019, 2026)
FACT_KEY = ("accession_number", "insider_key", "transaction_date", "shares_traded", "price_per_share", "filing_date")
#: What filings tell besides; null where the trades have no such column.
FACT_DETAILS = {
    "acquired_disposed": "string", "direct_indirect": "string", "is_amendment": "boolean", "security_title": "string", "conversion_price": "double",
    "exercise_date": "date", "expiration_date": "date", "underlying_shares": "double", "footnote_text": "string", "xml_path": "string",
}
HIGH_VALUE, RECENT_DAYS = 100_000, 30


def dim_time(spark: SparkSession, start=CALENDAR[0], end=CALENDAR[1], known: DataFrame | None = None) -> DataFrame:
    """One row a day; days that ``known`` has are skipped.  Sunday is day 0."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))
    if known is not None:
        days = days.join(known.select("date"), "date", "left_anti")
    d = F.col("date")
    dow = F.dayofweek(d) - 1
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("time_key"), "date", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"),
        F.weekofyear(d).alias("week_of_year"), dow.alias("day_of_week"), F.dayofmonth(d).alias("day_of_month"),
        F.rpad(F.date_format(d, "EEEE"), 9, " ").alias("day_name"), F.rpad(F.date_format(d, "MMMM"), 9, " ").alias("month_name"),
        dow.isin(0, 6).alias("is_weekend"), (d == F.last_day(F.add_months(F.trunc(d, "quarter"), 2))).alias("is_quarter_end"), (d == F.last_day(d)).alias("is_month_end"),
    )


def dim_transaction_type(spark: SparkSession) -> DataFrame:
    """20 codes."""
    schema = "code string, description string, category string, is_open_market boolean, is_buy_equivalent boolean, is_derivative boolean"
    return spark.createDataFrame(TRANSACTION_TYPES, schema).withColumn("type_key", F.ascii("code"))


def surrogate(*parts) -> Column:
    """Key that needs no sequence: 60 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def dim_company(trades: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row for each issuer_cik; the latest ticker counts, and new rows beat ``known`` ones."""
    new = trades.filter("issuer_cik is not null").groupBy(F.col("issuer_cik").alias("cik")).agg(F.max_by("ticker", F.struct("filing_date", "row_id")).alias("ticker"))
    new = new.withColumn("company_key", surrogate(F.lit("company"), "cik"))
    return new if known is None else merge_dimension(known, new, "cik")


def dim_insider(trades: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row for each insider, by cik or, without one, by name; the latest role counts and the first date stays."""
    key = F.coalesce("insider_cik", F.concat(F.lit("name:"), F.substring(F.md5("insider_name"), 1, 20)))
    order = F.struct("filing_date", "row_id")
    new = (
        trades.withColumn("cik", key).filter("cik is not null").groupBy("cik")
        .agg(F.max_by("insider_name", order).alias("name"), F.max_by("insider_role", order).alias("typical_role"), F.min("transaction_date").alias("first_seen"))
        .withColumn("insider_key", surrogate(F.lit("insider"), "cik"))
    )
    return new if known is None else merge_dimension(known, new, "cik", keep=("first_seen",))


def merge_dimension(known: DataFrame, new: DataFrame, key: str, keep=()) -> DataFrame:
    """Full outer merge by key; columns of ``new`` win where they have a value, those in ``keep`` stay."""
    k, n = known.alias("k"), new.alias("n")
    joined = k.join(n, F.col(f"k.{key}") == F.col(f"n.{key}"), "full_outer")
    pick = lambda c: F.coalesce(f"k.{c}", f"n.{c}") if c in (key, *keep) or c.endswith("_key") else F.coalesce(f"n.{c}", f"k.{c}")
    return joined.select(*[pick(c).alias(c) for c in new.columns])


def facts(trades: DataFrame, company: DataFrame | None, insider: DataFrame | None, time: DataFrame, kinds: DataFrame) -> DataFrame:
    """Trades with the keys of their dimensions.

    The date is the transaction's, else the filing's; a trade whose date the
    calendar lacks goes, one with an unknown code stays without type.  Keys of
    companies and insiders are hashes, so a dimension is joined only to leave
    out trades that it lacks; None stands for one that has all of them, and
    then no rows are exchanged.
    """
    who = F.coalesce("insider_cik", F.concat(F.lit("name:"), F.substring(F.md5("insider_name"), 1, 20)))
    dated = trades.withColumns({"_date": F.coalesce("transaction_date", "filing_date"), "_who": who, "_code": F.upper(F.trim("transaction_code"))})
    dated = (
        dated.join(F.broadcast(time.select(F.col("date").alias("_date"), "time_key")), "_date")  # one row a day
        .join(F.broadcast(kinds.select(F.col("code").alias("_code"), F.col("type_key").alias("transaction_type_key"))), "_code", "left")  # 20 rows
    )
    if company is None:
        dated = dated.filter("issuer_cik is not null").withColumn("company_key", surrogate(F.lit("company"), "issuer_cik"))
    else:
        dated = dated.join(company.select(F.col("cik").alias("issuer_cik"), "company_key"), "issuer_cik")
    if insider is None:
        dated = dated.filter("_who is not null").withColumn("insider_key", surrogate(F.lit("insider"), "_who"))
    else:
        dated = dated.join(insider.select(F.col("cik").alias("_who"), "insider_key"), "_who")
    return dated.select(
        F.col("row_id").alias("trade_id"), "accession_number", "company_key", "insider_key", "time_key", "transaction_type_key", F.col("_date").alias("transaction_date"),
        "filing_date", F.col("shares").alias("shares_traded"), "price_per_share", "total_value", "shares_owned_after", "has_10b5_1_plan", "is_derivative",
        *[(F.col(c) if c in trades.columns else F.lit(None)).cast(kind).alias(c) for c, kind in FACT_DETAILS.items()],
    )


def insert_new(stored: DataFrame, incoming: DataFrame, key=FACT_KEY, dealt_by=()) -> DataFrame:
    """Rows of ``incoming`` to insert.  Equal keys are inserted once and not if stored; a key with a null is like no other.

    Stored keys and incoming rows are one union, exchanged once: by the key,
    or by the columns ``dealt_by``, which both have and which follow from it.
    """
    by = [*dict.fromkeys([*dealt_by, *key])]
    both = incoming.withColumn("_new", F.lit(True)).unionByName(stored.select(*by).withColumn("_new", F.lit(False)), allowMissingColumns=True)
    if dealt_by:
        both = both.repartition(*dealt_by)
    first = F.row_number().over(Window.partitionBy(*by).orderBy("_new", "trade_id")) == 1
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    return both.withColumn("_first", first).filter(F.col("_new") & (F.col("_first") | ~whole)).select(*incoming.columns)


def merge_facts(facts_: DataFrame, path: str, years=FACT_YEARS, parts: int = PARTS_A_YEAR) -> DataFrame:
    """Insert facts into a table by filing year; other years are not taken.  Returns the inserted facts.

    A load adds the rows whose keys are not stored, so loads of different rows
    keep all and a load that runs again adds none; one that was cut off is run
    again.  Only years of the load are read.  ``facts_`` is read twice, once
    for its dates alone; rows are exchanged once, to the ``parts`` tasks that
    write a year.
    """
    spark = facts_.sparkSession
    dated = facts_.withColumn("filing_year", F.year("filing_date")).filter(F.col("filing_year").between(*years))
    known, there = stored(spark, path), set()
    if known is None:
        known = spark.createDataFrame([], dated.schema)
    else:
        there = set(known.inputFiles())
        known = known.filter(F.col("filing_year").isin([r[0] for r in dated.select("filing_year").distinct().collect()]))  # one a year
    placed = lambda df: df.withColumn("_part", F.pmod(F.xxhash64(*FACT_KEY), F.lit(parts)))
    new = insert_new(placed(known), placed(dated), dealt_by=("filing_year", "_part")).drop("_part")
    new.write.mode("append").partitionBy("filing_year").parquet(path)
    added = [f for f in spark.read.schema(dated.schema).parquet(path).inputFiles() if f not in there]  # ``parts`` a year
    return spark.read.schema(dated.schema).option("basePath", path).parquet(*added) if added else spark.createDataFrame([], dated.schema)


def compact_facts(spark: SparkSession, path: str, parts: int = PARTS_A_YEAR) -> None:
    """Rewrite the facts in at most ``parts`` files a year, after many small loads; the files of a year are read together, so no rows are exchanged."""
    facts_ = stored(spark, path)
    years = [r[0] for r in facts_.select("filing_year").distinct().collect()]  # one a year
    if years:
        swap(reduce(DataFrame.unionByName, [facts_.filter(F.col("filing_year") == y).coalesce(parts) for y in years]), path, ("filing_year",))


def load_warehouse(trades: DataFrame, folder: str, first_day, last_day, years=FACT_YEARS) -> None:
    """Add ``trades``, which are read several times, to the warehouse in ``folder``, which starts empty.

    Dimensions are merged by key, facts inserted unless known; statistics and
    summaries are made anew for the companies, insiders and days that the new
    facts touch.  Tables other than the facts are replaced by renaming.
    """
    spark = trades.sparkSession
    at = lambda name: f"{folder}/{name}"
    got = lambda name: stored(spark, at(name))
    swap(dim_transaction_type(spark), at("dim_transaction_type"))
    days = got("dim_time")
    fresh = dim_time(spark, first_day, last_day, known=days)
    swap(fresh if days is None else days.unionByName(fresh), at("dim_time"))
    swap(dim_company(trades, got("dim_company")), at("dim_company"))
    insiders = got("dim_insider")
    named = dim_insider(trades, insiders)
    kinds, time, company = got("dim_transaction_type"), got("dim_time"), got("dim_company")
    new = merge_facts(facts(trades, None, None, time, kinds), at("fact_trades"), years)
    fact = got("fact_trades")
    touched = lambda *by: fact.join(new.select(*by).distinct(), list(by), "left_semi")
    if insiders is not None:  # statistics of before go on where a load has none
        old = [c for c in insiders.columns if c not in named.columns]
        named = named.join(insiders.select("insider_key", *old), "insider_key", "left")
    swap(update_insiders(named, insider_statistics(touched("insider_key"), kinds)), at("dim_insider"))
    active = company_activity(company, touched("company_key"), kinds)
    before = got("company_activity")
    if before is not None:
        seen = active.join(before.select("company_key", F.lit(True).alias("_old")), "company_key", "left").filter("total_trades > 0 or _old is null").drop("_old")
        active = upsert(before, seen, ["company_key"]).drop("ticker").join(company.select("company_key", "ticker"), "company_key").select(active.columns)
    swap(active, at("company_activity"))
    daily, before = daily_summary(touched("company_key", "transaction_date"), kinds), got("daily_summary")
    swap(daily if before is None else upsert(before, daily, ["company_key", "date"]), at("daily_summary"))


def _sides(fact: DataFrame, kinds: DataFrame) -> tuple[DataFrame, Column, Column]:
    typed = fact.join(F.broadcast(kinds.select(F.col("type_key").alias("transaction_type_key"), "is_buy_equivalent", "description")), "transaction_type_key", "left")
    buy = F.coalesce(F.col("is_buy_equivalent"), F.lit(False))
    return typed, buy, F.coalesce(~F.col("is_buy_equivalent"), F.lit(False))


def _money(c) -> Column:
    return F.col(c).cast("decimal(20,4)")


def _total(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value).otherwise(F.lit(0).cast("decimal(20,4)")))


def company_activity(company: DataFrame, fact: DataFrame, kinds: DataFrame) -> DataFrame:
    """Every company, also those without trades."""
    typed, buy, sell = _sides(fact, kinds)
    per = typed.groupBy("company_key").agg(
        F.count("*").alias("total_trades"), F.count_distinct("insider_key").alias("unique_insiders"), F.count_if(buy).alias("total_buys"), F.count_if(sell).alias("total_sells"),
        _total(buy, _money("total_value")).alias("value_bought"), _total(sell, _money("total_value")).alias("value_sold"), F.avg(_money("total_value")).alias("avg_trade_value"),
    )
    counts = ("total_trades", "unique_insiders", "total_buys", "total_sells")
    joined = company.join(per, "company_key", "left")
    return joined.select("company_key", "ticker", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
                         *[F.round(F.coalesce(c, F.lit(0)).cast("double"), 4).alias(c) for c in ("value_bought", "value_sold")], F.col("avg_trade_value").cast("double").alias("avg_trade_value"))


def insider_statistics(fact: DataFrame, kinds: DataFrame) -> DataFrame:
    """Totals of each insider."""
    typed, buy, sell = _sides(fact, kinds)
    return typed.groupBy("insider_key").agg(
        F.count("*").alias("total_trades"), F.count_if(buy).alias("total_buys"), F.count_if(sell).alias("total_sells"),
        F.round(_total(buy, _money("total_value")).cast("double"), 4).alias("value_bought"), F.round(_total(sell, _money("total_value")).cast("double"), 4).alias("value_sold"),
        F.avg(_money("total_value")).cast("double").alias("avg_value"), F.min("transaction_date").alias("first_date"), F.max("transaction_date").alias("last_date"),
    )


def update_insiders(insider: DataFrame, stats: DataFrame) -> DataFrame:
    """The dimension with new statistics where there are any."""
    old = [c for c in insider.columns if c in stats.columns and c != "insider_key"]
    s = stats.select("insider_key", *[F.col(c).alias(f"_{c}") for c in stats.columns if c != "insider_key"])
    joined = insider.join(s, "insider_key", "left")
    fresh = [F.coalesce(f"_{c}", c).alias(c) if c in old else F.col(f"_{c}").alias(c) for c in stats.columns if c != "insider_key"]
    return joined.select(*[c for c in insider.columns if c not in old], *fresh)


def daily_summary(fact: DataFrame, kinds: DataFrame, date=None) -> DataFrame:
    """By company and date, of one date or of all."""
    typed, buy, sell = _sides(fact if date is None else fact.filter(F.col("transaction_date") == F.lit(date)), kinds)
    n = F.count("*")
    d = lambda c: F.round(c.cast("double"), 4)
    net = lambda c: F.sum(F.when(buy, _money(c)).when(sell, -_money(c)).otherwise(F.lit(0).cast("decimal(20,4)")))
    return typed.groupBy("company_key", F.col("transaction_date").alias("date")).agg(
        F.count_if(buy).alias("total_insider_buys"), d(_total(buy, _money("shares_traded"))).alias("total_shares_bought"), d(_total(buy, _money("total_value"))).alias("total_value_bought"),
        F.avg(F.when(buy, _money("price_per_share"))).cast("double").alias("avg_buy_price"),
        F.count_if(sell).alias("total_insider_sells"), d(_total(sell, _money("shares_traded"))).alias("total_shares_sold"), d(_total(sell, _money("total_value"))).alias("total_value_sold"),
        F.avg(F.when(sell, _money("price_per_share"))).cast("double").alias("avg_sell_price"), F.count_distinct("insider_key").alias("num_unique_insiders_trading"),
        d(net("shares_traded")).alias("net_shares"), d(net("total_value")).alias("net_value"), F.round((F.count_if(buy) - F.count_if(sell)) / n, 6).alias("net_sentiment_score"),
    )


def upsert(stored: DataFrame, fresh: DataFrame, key) -> DataFrame:
    """Rows of ``fresh`` and those of ``stored`` whose key it lacks."""
    return stored.join(fresh.select(*key), list(key), "left_anti").unionByName(fresh, allowMissingColumns=True)


def recent_high_value(fact: DataFrame, company: DataFrame, insider: DataFrame, time: DataFrame, kinds: DataFrame, as_of) -> DataFrame:
    """Trades of ``HIGH_VALUE`` and more filed in the ``RECENT_DAYS`` before ``as_of``, the largest first."""
    recent = fact.filter((F.col("total_value") >= HIGH_VALUE) & (F.col("filing_date") >= F.date_sub(F.lit(as_of), RECENT_DAYS)))
    typed, _, _ = _sides(recent, kinds)
    return (
        typed.join(company, "company_key").join(insider, "insider_key").join(F.broadcast(time.select("time_key", F.col("date").alias("trade_date"))), "time_key")
        .select("trade_id", "ticker", F.col("name").alias("insider_name"), "typical_role", "trade_date", F.col("description").alias("transaction_type"),
                "shares_traded", "price_per_share", "total_value", "has_10b5_1_plan")
        .orderBy(F.desc("total_value"), "trade_id")
    )
