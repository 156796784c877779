"""Prices and dated events: files and payloads to tables, merges, and items matched to tickers."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ledgerlark.functions import trade as t
from ledgerlark.sources.shared import written

STALE_AFTER = 5
# Words of which an item on enforcement has one, and forms that tell of earnings.
ENFORCEMENT_WORDS = ("litigation", "charges", "charged", "settlement", "settled", "fraud", "insider trading", "enforcement")
EARNINGS_FORMS = ("10-Q", "10-K", "10-Q/A", "10-K/A")
SHORTEST_ALIAS = 3
#: Tickers of an alias that go together, about, and answers of a task.
TICKERS_A_LIST, MADE_ROWS = 1024, 2_000_000
#: Mentions in a text up to which each goes with the others, and bits in which known words are marked (1 MB).
FEW, KNOWN_BITS = 64, 1 << 23


def _typed(raw: DataFrame, schema: str) -> DataFrame:
    """Columns of ``schema`` by name; those that ``raw`` lacks, and values that don't fit, are null."""
    fields = StructType.fromDDL(schema)
    return raw.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


def read_typed(spark: SparkSession, path: str, schema: str, required=(), kind: str = "csv") -> DataFrame:
    """A table with a given schema, by the names of the file's columns; columns that must be there are checked."""
    raw = spark.read.option("header", True).format(kind).load(path)
    if missing := [c for c in required if c not in raw.columns]:
        raise ValueError(f"missing columns: {missing}")
    return _typed(raw, schema)


def read_optional(spark: SparkSession, path: str, date_col: str) -> DataFrame:
    """(ticker, date_col) of a CSV; a folder that is not there is an empty table; bad dates go."""
    from pyspark.errors import AnalysisException

    schema = f"ticker string, {date_col} date"
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    if not {"ticker", date_col} <= set(raw.columns):
        return spark.createDataFrame([], schema)
    return raw.select(F.upper(F.trim("ticker")).alias("ticker"), t.lenient_date(F.col(date_col)).alias(date_col)).filter(F.col(date_col).isNotNull())


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """One file for each ticker, named <TICKER>_daily_prices.csv."""
    raw = spark.read.schema("date string, close string").option("header", True).csv(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_daily_prices\.csv$", 1)
    return clean_prices(raw.select(F.upper(name).alias("ticker"), "date", "close"))


def clean_prices(raw: DataFrame) -> DataFrame:
    """Numbers and dates, without rows that lack one."""
    close = F.col("close").try_cast("double")
    date = t.lenient_date(F.substring(F.trim("date"), 1, 10))
    return raw.select("ticker", date.alias("date"), F.when(~F.isnan(close), close).alias("close")).filter("date is not null and close is not null")


def keep_last(df: DataFrame, key, order: Column) -> DataFrame:
    """Of rows with equal keys the last in ``order``."""
    w = Window.partitionBy(*key).orderBy(order.desc_nulls_last())
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge_prices(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both, new closes before old ones."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    return keep_last(both, ("ticker", "date"), F.struct("_src", "close")).drop("_src")


def write_prices(prices: DataFrame, path: str) -> None:
    """By ticker, replacing only the tickers there are."""
    prices.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(path)


def price_range(prices: DataFrame, requests: DataFrame, today) -> DataFrame:
    """Prices between start and end (at most ``today``) of each (ticker, start, end)."""
    wanted = requests.withColumn("end", F.least("end", F.lit(today)))
    return prices.join(wanted, "ticker").filter("date between start and end").select("ticker", "date", "close")


def coverage(prices: DataFrame, requests: DataFrame, today) -> DataFrame:
    """For each request, first and last price and whether they fall short of it."""
    have = prices.groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    end = F.least("end", F.lit(today))
    stale = F.col("first").isNull() | (F.col("start") < F.col("first")) | (end > F.date_add("last", STALE_AFTER))
    return requests.join(have, "ticker", "left").select("ticker", "first", "last", stale.alias("stale"))


def chart_prices(payloads: DataFrame) -> DataFrame:
    """(ticker, payload), a JSON of parallel arrays of seconds and closes, to (ticker, date, close)."""
    p = F.from_json("payload", "timestamp array<long>, close array<double>")
    rows = payloads.select("ticker", F.explode(F.arrays_zip(p["timestamp"].alias("s"), p["close"].alias("c"))).alias("x"))
    return rows.select("ticker", F.timestamp_seconds("x.s").cast("date").alias("date"), F.col("x.c").alias("close")).filter("close is not null and date is not null")


def csv_prices(rows: DataFrame, start, end) -> DataFrame:
    """(ticker, Date, Close) as text to prices of a range."""
    out = clean_prices(rows.select("ticker", F.col("Date").alias("date"), F.col("Close").alias("close")))
    return out.filter(F.col("date").between(F.lit(start), F.lit(end)))


def filing_dates(payloads: DataFrame, most: int = 60) -> DataFrame:
    """(ticker, payload), a JSON of parallel arrays of forms and dates, to the first ``most`` earnings dates of each in the order of the feed."""
    p = F.from_json("payload", "form array<string>, filingDate array<string>")
    rows = payloads.select("ticker", F.posexplode(F.arrays_zip(p["form"].alias("f"), p["filingDate"].alias("d"))).alias("at", "x")).filter(F.col("x.f").isin(*EARNINGS_FORMS))
    w = Window.partitionBy("ticker").orderBy("at")
    return rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select("ticker", t.lenient_date(F.col("x.d")).alias("announcement_date")).filter("announcement_date is not null")


def padded_cik(cik: Column) -> Column:
    """S13."""
    return F.lpad(t.plain_cik(cik), 10, "0")


def calendar_dates(events: DataFrame) -> DataFrame:
    """(ticker, value) as text to distinct dates."""
    date = t.lenient_date(F.substring(F.trim("value"), 1, 10))
    return events.select(F.upper(F.trim("ticker")).alias("ticker"), date.alias("announcement_date")).filter("announcement_date is not null").distinct()


def news_items(feeds: DataFrame) -> DataFrame:
    """(text), RSS documents, to items on enforcement with a date: title, description, link, action_date (UTC)."""
    item = "struct<title:string,description:string,pubDate:string,link:string>"
    rows = feeds.select(F.explode(F.from_xml("text", f"channel struct<item:array<{item}>>")["channel"]["item"]).alias("i")).select("i.*")
    return enforcement_items(rows)


def enforcement_items(items: DataFrame) -> DataFrame:
    """Items that have a word of ``ENFORCEMENT_WORDS`` and a readable date."""
    text = F.lower(F.concat_ws(" ", "title", "description"))
    named = functools.reduce(lambda a, b: a | b, [text.contains(w) for w in ENFORCEMENT_WORDS])
    bare = F.regexp_replace(F.trim("pubDate"), r"^[A-Za-z]{3},\s*", "")
    when = F.try_to_timestamp(F.regexp_replace(bare, r"\s(GMT|UT|UTC)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z")).cast("date")
    return items.filter(named).withColumn("action_date", when).filter("action_date is not null").select("title", "description", "link", "action_date")


def upsert_events(old: DataFrame, new: DataFrame, key) -> DataFrame:
    """Both tables, rows of ``new`` before those of ``old`` with an equal key; tickers in upper case, keys trimmed, rows without a date left out."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    dates = [c for c in key if c.endswith("_date")]
    tidy = both.withColumns({c: F.upper(F.trim(c)) if c == "ticker" else F.trim(F.coalesce(c, F.lit(""))) for c in key if c not in dates})
    for c in dates:
        tidy = tidy.filter(F.col(c).isNotNull())
    return keep_last(tidy, key, F.struct("_src", *[c for c in tidy.columns if c != "_src"])).drop("_src")


def build_events(payloads: DataFrame, calendar: DataFrame, feeds: DataFrame, aliases: DataFrame, tickers: DataFrame, earnings: DataFrame, enforcement: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C4: (earnings, enforcement): what is stored, with the dates of filings and calendars, and with the news items that name a ticker.

    An item is matched by its title and description.  An action keeps its
    item's title and link and what matched; items of one day with different
    links are different actions.
    """
    announced = filing_dates(payloads).unionByName(calendar_dates(calendar))
    items = news_items(feeds).select(F.trim("title").alias("source_title"), F.trim("link").alias("source_link"), "action_date", F.trim(F.concat_ws(" ", "title", "description")).alias("text"))
    items = items.withColumn("item_id", F.xxhash64("text", "source_link", "action_date")).dropDuplicates(["item_id"])
    named = match_tickers(items, alias_table(aliases, tickers), tickers)
    acted = items.join(named, "item_id").select("ticker", "action_date", "source_title", "source_link", "matched_by")
    return upsert_events(earnings, announced, ("ticker", "announcement_date")), upsert_events(enforcement, acted, ("ticker", "action_date", "source_link"))


def alias_table(aliases: DataFrame, tickers: DataFrame) -> DataFrame:
    """(ticker, alias) of wanted tickers, normalised; each ticker is an alias of itself, and short ones go."""
    own = tickers.select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
    given = aliases.select(F.upper(F.trim("ticker")).alias("ticker"), t.normal_text(F.col("alias")).alias("alias")).join(own, "ticker", "left_semi")
    return given.unionByName(own.select("ticker", F.lower("ticker").alias("alias"))).filter(F.length("alias") >= SHORTEST_ALIAS).distinct()


def _may_be(words: DataFrame, word: str) -> Column:
    """Whether the column ``word`` may be among ``words``: bits of their hashes, of a fixed size, so that few other words are exchanged."""
    h = F.pmod(F.xxhash64(word), F.lit(KNOWN_BITS))
    at, place = F.shiftright(h, 6).cast("int"), F.pmod(h, F.lit(64)).cast("int")
    marked = words.select(at.alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    every = words.sparkSession.range(KNOWN_BITS // 64).select(F.col("id").cast("int").alias("at")).join(marked, "at", "left")
    bits = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"]).alias("bits")).scalar()
    return F.getbit(F.get(bits, at), place) == 1


def _mentions(items: DataFrame, aliases: DataFrame, tickers: DataFrame, text: str, key: str, most_words: int) -> DataFrame:
    """(key, had, named): the aliases that stand in a text, in their order, and the tickers that do."""
    words = F.split(t.normal_text(F.col(text)), " ")
    n = F.size("w")
    runs = [F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.array_join(F.slice("w", i + 1, k), " "))).otherwise(F.array().cast("array<string>")) for k in range(1, most_words + 1)]  # noqa: B023
    alias = aliases.select("alias").distinct()
    grams = items.select(F.col(key), words.alias("w")).select(key, F.explode(F.array_distinct(F.concat(*runs))).alias("alias")).filter(_may_be(alias, "alias"))
    upper = F.split(F.regexp_replace(F.upper(text), r"[^A-Z0-9_]+", " "), " ")
    called = items.select(F.col(key), F.explode(F.array_distinct(upper)).alias("ticker")).filter(_may_be(tickers, "ticker"))
    # Merged, as the words of all texts are not for a broadcast.
    had, named = (x.hint("merge").join(y, c, "left_semi") for x, y, c in ((grams, alias, "alias"), (called, tickers, "ticker")))
    both = had.withColumn("ticker", F.lit(None).cast("string")).unionByName(named.withColumn("alias", F.lit(None).cast("string")))
    return both.groupBy(key).agg(F.array_sort(F.collect_set("alias")).alias("had"), F.collect_set("ticker").alias("named"))


def match_tickers(items: DataFrame, aliases: DataFrame, tickers: DataFrame, text: str = "text", key: str = "item_id", most_words: int | None = None) -> DataFrame:
    """(key, ticker, matched_by): tickers that stand in an item as a word, else by an alias as a phrase, the least alias.

    Texts become runs of up to ``most_words`` words (those of the longest
    alias), which meet aliases by equality, so the work grows with the texts
    and not with texts times aliases.  An alias that stands in a text goes
    with the lesser ones there, and its tickers with their lesser aliases: a
    ticker counts where the two have none in common.  So each answer is made
    once, where an alias meets the lists of its tickers, and is not exchanged.
    Texts of more than ``FEW`` mentions get the least alias by grouping, as
    their mentions would be told too often.  Where ``most_words`` is given,
    longer aliases are an error.
    """
    aliases = written(aliases.distinct(), "aliases")
    tickers = written(tickers.select(F.upper(F.trim("ticker")).alias("ticker")).filter("ticker is not null").distinct(), "tickers")
    longest = aliases.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    most_words = most_words or longest
    if longest > most_words:
        raise ValueError(f"an alias has {longest} words, more than {most_words}")
    said = written(_mentions(items, aliases, tickers, text, key, most_words), "mentions")
    few, many = (said.filter(cond) for cond in (F.size("had") + F.size("named") <= FEW, F.size("had") + F.size("named") > FEW))
    told = lambda alias: F.concat(F.lit("alias:"), alias).alias("matched_by")
    by_name = lambda df: df.select(key, F.explode("named").alias("ticker")).select(key, "ticker", F.concat(F.lit("ticker:"), "ticker").alias("matched_by"))

    # Hits of an alias are dealt so that no task makes many more rows than others.
    hits = few.select(key, "named", "had", F.posexplode("had").alias("at", "alias"))
    of = aliases.groupBy("alias").agg(F.count("*").alias("n"), F.ceil(F.count("*") / TICKERS_A_LIST).alias("lists"))
    made = written(hits.groupBy("alias").agg(F.count("*").alias("hits")).join(of, "alias").select("alias", (F.col("hits") * F.col("n")).alias("rows"), "lists"), "hits")
    deals = made.withColumn("deals", F.ceil(F.col("rows") / MADE_ROWS))
    parts = max(1, *map(int, (made.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] / MADE_ROWS, made.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = hits.join(deals.select("alias", "deals"), "alias").select("alias", F.pmod(F.xxhash64(key), "deals").alias("deal"), key, "named", F.slice("had", F.lit(1), F.col("at")).alias("lesser"))
    held = aliases.groupBy("ticker").agg(F.array_sort(F.collect_list("alias")).alias("all")).select("ticker", "all", F.posexplode("all").alias("at", "alias"))
    held = held.join(deals, "alias").select("alias", "deals", F.pmod(F.xxhash64("ticker"), "lists").alias("list"), F.struct("ticker", F.slice("all", F.lit(1), F.col("at")).alias("lesser")).alias("x"))
    lists = held.groupBy("alias", "list", "deals").agg(F.collect_list("x").alias("xs")).select("alias", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"), "xs")
    met = dealt.repartition(parts, "alias", "deal").join(lists.repartition(parts, "alias", "deal"), ["alias", "deal"])
    kept = F.filter("xs", lambda x: ~F.arrays_overlap(x["lesser"], F.col("lesser")) & ~F.array_contains("named", x["ticker"]))
    by_alias = met.select(key, "alias", F.explode(F.transform(kept, lambda x: x["ticker"])).alias("ticker")).select(key, "ticker", told(F.col("alias")))

    bags = aliases.join(of, "alias").withColumn("list", F.pmod(F.xxhash64("ticker"), "lists")).groupBy("alias", "list").agg(F.collect_list("ticker").alias("tickers"))
    opened = many.select(key, F.explode("had").alias("alias")).join(bags, "alias").select(key, "alias", "tickers").unionByName(many.select(key, F.lit(None).cast("string").alias("alias"), F.col("named").alias("tickers")))
    opened = opened.repartition(key).select(key, "alias", F.explode("tickers").alias("ticker"))
    least = opened.groupBy(key, "ticker").agg(F.min("alias").alias("alias"), F.max(F.col("alias").isNull()).alias("named")).filter("not named").select(key, "ticker", told(F.col("alias")))
    return by_alias.unionByName(by_name(said)).unionByName(least)


def union_tables(spark: SparkSession, paths, schema: str) -> DataFrame:
    """Tables of several paths by column name; columns that one lacks are null."""
    tables = [_typed(spark.read.option("header", True).csv(p), schema) for p in paths]
    return functools.reduce(DataFrame.unionByName, tables)


def save_table(df: DataFrame, path: str, kind: str = "parquet", by=()) -> None:
    """S20."""
    df.write.mode("overwrite").option("header", True).partitionBy(*by).format(kind).save(path)


def save_report(report: DataFrame, path: str) -> None:
    """A report of few rows as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)


def save_model(model, path: str) -> None:
    """S22."""
    model.write().overwrite().save(path)
