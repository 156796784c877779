"""As-of joins of trades with prices and dated events.

An as-of join is a union of both sides and a running last (or first) value by
key and date, within stretches of a year: a key with very many rows is many
tasks, and each stretch starts from the last value before it.  Several series
of prices and events share one union of narrow rows, whose answers depend on
key and date alone and are joined to the trades once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRICE_MARGIN = 10
#: Days of a stretch, and the first and last stretch, which also hold all earlier and later dates.
STRETCH, FIRST_STRETCH, LAST_STRETCH = 365, -30, 130


@dataclass
class Series:
    """What is looked up: ``value`` of the last row of ``right`` on or before the date plus ``ahead`` days, or of the first on or after it."""

    name: str
    right: DataFrame
    date: str
    value: str
    forward: bool = False
    ahead: int = 0


def as_of_all(left: DataFrame, key: str, date: str, series: Sequence[Series]) -> DataFrame:
    """(key, date, a column for each series): the answers for each key and date of ``left``, without nulls, once.

    All series and dates are one union, exchanged once.  A small table has
    what each stretch of a key begins with: a row for each year at most.
    """
    stretch = F.greatest(F.lit(FIRST_STRETCH), F.least(F.lit(LAST_STRETCH), F.floor(F.col("_d") / STRETCH).cast("int")))
    aheads = sorted({s.ahead for s in series})
    asked = left.filter(F.col(key).isNotNull() & F.col(date).isNotNull()).select(F.col(key).alias("_key"), F.col(date).alias("_date")).distinct()
    points = F.explode(F.array(*[F.struct((F.unix_date("_date") + a).alias("_d"), F.lit(a).alias("_ahead")) for a in aheads]))
    both = asked.select("_key", "_date", points.alias("p")).select("_key", "_date", "p.*", F.lit(1).alias("_rank"))
    # Series of the same values are one table of marks.
    sources = {}
    for k, s in enumerate(series):
        sources.setdefault((id(s.right), s.date, s.value), []).append((k, s))
    for same in sources.values():
        s = same[0][1]
        marks = s.right.select(F.col(key).alias("_key"), F.unix_date(s.date).alias("_d"), *[F.col(s.value).alias(f"_v{k}") for k, _ in same], F.lit(0).alias("_rank"))
        there = F.col("_key").isNotNull() & F.col("_d").isNotNull() & F.col(f"_v{same[0][0]}").isNotNull()
        both = both.unionByName(marks.filter(there), allowMissingColumns=True)
    both = both.withColumn("_s", stretch)
    ends = both.groupBy("_key", "_s").agg(*[(F.min_by if s.forward else F.max_by)(f"_v{k}", F.when(F.col(f"_v{k}").isNotNull(), F.col("_d"))).alias(f"_e{k}") for k, s in enumerate(series)])
    there = Window.partitionBy("_key")
    before = there.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    after = there.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_key", "_s", *[F.last(f"_e{k}", ignorenulls=True).over(after if s.forward else before).alias(f"_c{k}") for k, s in enumerate(series)])
    rows = Window.partitionBy("_key", "_s")
    up = rows.orderBy("_d", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    down = rows.orderBy(F.desc("_d"), "_rank").rowsBetween(Window.unboundedPreceding, 0)
    within = both.select("_key", "_date", "_ahead", "_rank", "_s", *[F.last(f"_v{k}", ignorenulls=True).over(down if s.forward else up).alias(f"_w{k}") for k, s in enumerate(series)])
    joined = within.filter("_rank = 1").join(ends, ["_key", "_s"])
    found = [F.max(F.when(F.col("_ahead") == s.ahead, F.coalesce(f"_w{k}", f"_c{k}"))).alias(s.name) for k, s in enumerate(series)]
    return joined.groupBy(F.col("_key").alias(key), F.col("_date").alias(date)).agg(*found)


def with_series(left: DataFrame, key: str, date: str, series: Sequence[Series]) -> DataFrame:
    """``left`` with a column for each series."""
    return left.join(as_of_all(left, key, date, series), [key, date], "left").select(*left.columns, *[s.name for s in series])


def as_of(left: DataFrame, date: str, right: DataFrame, key: str | None, right_date: str, value: str, name: str, forward: bool = False) -> DataFrame:
    """``left`` with ``name``: ``value`` of the last row of ``right`` on or before ``date``, or with ``forward`` of the first on or after it.

    Without ``key`` all rows share one series: then ``right`` must be one
    value a day, and it is joined through a calendar of its days.
    """
    if key is None:
        return _as_of_series(left, date, right, right_date, value, name, forward)
    return with_series(left, key, date, [Series(name, right, right_date, value, forward)])


def _as_of_series(left: DataFrame, date: str, right: DataFrame, right_date: str, value: str, name: str, forward: bool) -> DataFrame:
    """Each day of the series answers for the days up to the next one; the series is small and joined by day."""
    known = right.filter(F.col(value).isNotNull() & F.col(right_date).isNotNull()).groupBy(F.col(right_date).alias("_on")).agg(F.max(value).alias(name))
    w = Window.orderBy("_on")
    step = F.date_add(F.lag("_on").over(w), 1) if forward else F.date_sub(F.lead("_on").over(w), 1)
    known = known.withColumn("_step", F.coalesce(step, F.col("_on")))
    days = known.withColumn("_day", F.explode(F.sequence("_step", "_on") if forward else F.sequence("_on", "_step")))
    ends = known.agg(F.max(F.struct("_on", name)).alias("l"), F.min(F.struct("_on", name)).alias("f"))
    # One row a day.
    joined = left.join(F.broadcast(days.select("_day", F.col(name).alias("_v"))), left[date] == F.col("_day"), "left").crossJoin(F.broadcast(ends))
    edge = F.when(F.col(date) < F.col("f._on"), F.col(f"f.{name}")) if forward else F.when(F.col(date) > F.col("l._on"), F.col(f"l.{name}"))
    return joined.withColumn(name, F.coalesce("_v", edge)).drop("_day", "_v", "l", "f")


def price_series(trades: DataFrame, prices: DataFrame, horizon: int) -> list[Series]:
    """txn_close on or before the trade, future_close on or after the trade and ``horizon`` days.

    Prices count from ``PRICE_MARGIN`` days before the ticker's first trade to
    as many after its last target date.
    """
    span = trades.groupBy("ticker").agg(
        F.date_sub(F.min("transaction_date"), PRICE_MARGIN).alias("_from"), F.date_add(F.max("transaction_date"), horizon + PRICE_MARGIN).alias("_to")
    )
    seen = prices.join(span, "ticker").filter("date between _from and _to").select("ticker", "date", "close")
    return [Series("txn_close", seen, "date", "close"), Series("future_close", seen, "date", "close", forward=True, ahead=horizon)]


def close_on_trade(trades: DataFrame, prices: DataFrame, horizon: int = 30) -> DataFrame:
    """``trades`` with the closes of :func:`price_series`."""
    return with_series(trades, "ticker", "transaction_date", price_series(trades, prices, horizon))


def close_on_date(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """close_price_on_txn_date, from prices no older than the ticker's first trade."""
    first = trades.groupBy("ticker").agg(F.min("transaction_date").alias("_first"))
    seen = prices.join(first, "ticker").filter("date >= _first").select("ticker", "date", "close")
    return as_of(trades, "transaction_date", seen, "ticker", "date", "close", "close_price_on_txn_date")


def backfill_value(trades: DataFrame) -> DataFrame:
    """An exercise without value gets shares times the close."""
    empty = F.coalesce(F.col("total_value"), F.lit(0.0)) == 0
    value = F.when((F.upper(F.trim("transaction_code")) == "M") & empty & F.col("close_price_on_txn_date").isNotNull(), F.col("shares") * F.col("close_price_on_txn_date"))
    return trades.withColumn("total_value", F.coalesce(value, "total_value"))


def enrich_with_prices(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """C5."""
    return backfill_value(close_on_date(trades, prices))


def event_series(events: DataFrame, event_date: str, before: str | None, after: str) -> list[Series]:
    """The last event of the ticker on or before a day, as ``before`` if it is named, and the first on or after it, as ``after``."""
    back = [Series(before, events, event_date, event_date)] if before else []
    return [*back, Series(after, events, event_date, event_date, forward=True)]


def is_near(before: str, after: str, days: int) -> Column:
    """1 where an event lies within ``days`` of the trade, before or after."""
    gap = F.least(F.datediff("transaction_date", before), F.datediff(after, "transaction_date"))
    return F.coalesce(gap <= days, F.lit(False)).cast("int")


def is_ahead(after: str, days: int) -> Column:
    """1 where an event follows within ``days``, both ends included."""
    return F.coalesce(F.datediff(after, "transaction_date") <= days, F.lit(False)).cast("int")


def nearest_event(trades: DataFrame, events: DataFrame, event_date: str, days: int, name: str) -> DataFrame:
    """``trades`` with :func:`is_near` as ``name``."""
    both = with_series(trades, "ticker", "transaction_date", event_series(events, event_date, "_before", "_after"))
    return both.withColumn(name, is_near("_before", "_after", days)).drop("_before", "_after")


def event_ahead(trades: DataFrame, events: DataFrame, event_date: str, days: int, name: str) -> DataFrame:
    """``trades`` with :func:`is_ahead` as ``name``."""
    return with_series(trades, "ticker", "transaction_date", event_series(events, event_date, None, "_after")).withColumn(name, is_ahead("_after", days)).drop("_after")


def daily_fill(prices: DataFrame) -> DataFrame:
    """One row a day of each ticker's span: the close carried forward, and the next close carried back.

    Days are filled between neighbouring prices, so a ticker's days need no
    window: only its prices do, and these in stretches of a year.
    """
    known = prices.filter("ticker is not null and date is not null").groupBy("ticker", "date").agg(F.max("close").alias("close"))
    span = known.groupBy("ticker").agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    priced = known.filter("close is not null")
    stretch = F.floor(F.unix_date("date") / STRETCH).cast("int")
    # The first day and price of each stretch, told to the stretch before: a row for each year of a ticker.
    firsts = priced.groupBy("ticker", stretch.alias("_s")).agg(F.min("date").alias("_first"), F.min_by("close", "date").alias("_first_close"))
    there = Window.partitionBy("ticker").orderBy("_s")
    firsts = firsts.select("ticker", "_s", F.lead("_first").over(there).alias("_next_first"), F.lead("_first_close").over(there).alias("_next_close"))
    w = Window.partitionBy("ticker", "_s").orderBy("date")
    steps = priced.withColumn("_s", stretch).withColumns({"_next": F.lead("date").over(w), "_close": F.lead("close").over(w)}).join(firsts, ["ticker", "_s"])
    steps = steps.select("ticker", "date", "close", F.coalesce("_next", "_next_first").alias("_next"), F.when(F.col("_next").isNotNull(), F.col("_close")).otherwise(F.col("_next_close")).alias("_close"))
    # Days from a price to the one before the next; those after the last price and before the first come from the span.
    steps = steps.join(span, "ticker")
    last = F.coalesce(F.date_sub("_next", 1), F.col("_to"))
    filled = steps.select("ticker", F.explode(F.sequence("date", last)).alias("_day"), "date", "close", "_close").select(
        "ticker", F.col("_day").alias("date"), F.col("close").alias("ffill"), F.when(F.col("_day") == F.col("date"), F.col("close")).otherwise(F.col("_close")).alias("bfill")
    )
    lead_in = priced.groupBy("ticker").agg(F.min("date").alias("_first"), F.min_by("close", "date").alias("bfill"))
    early = span.join(lead_in, "ticker", "left").filter("_first is null or _first > _from")
    until = F.coalesce(F.date_sub("_first", 1), F.col("_to"))
    early = early.select("ticker", F.explode(F.sequence("_from", until)).alias("date"), F.lit(None).cast(dict(prices.dtypes)["close"]).alias("ffill"), "bfill")
    return filled.unionByName(early)
