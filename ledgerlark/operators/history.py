"""Features from an insider's own history and from trades near in time.

What lies around a day is added up in stretches of days of a ticker or an
insider, whose ends the stretch beside sees too.  What depends on the order of
single trades runs in stretches of a year of an insider; a small table carries
the sums, the last trade and the open streak of the stretches before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.sources.shared import spread

TRAILING_DAYS = (7, 30, 90)
NEAR_DAYS = 3
#: Days of a stretch; rows without a date are the first one.
STRETCH, UNDATED = 365, -1_000_000
#: Days of a ticker that are looked at together, and the first number of a place of rows that have none.
NEAR_STRETCH, LONE = 90, 1 << 40
CLUSTER_FROM = 2
#: Rows of an insider from which the feature matrix takes them by stretches, and rows of a task of its exchanges.
LONG_HISTORY, TASK_ROWS = 100_000, 500_000


def day(date: Column) -> Column:
    return F.unix_date(date)


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def _with_day(trades: DataFrame) -> DataFrame:
    return trades.withColumn("_day", day(F.col("transaction_date")))


def _with_copies(rows: DataFrame, key: str, blocks: Column, own: Column) -> DataFrame:
    """``rows`` in each of their ``blocks`` as ``key``; in blocks other than ``own`` they are copies for their neighbours, told by a false _own."""
    # There is always a block.  A plain explode would test that in the join below, whose code then gets too long to be compiled.
    return rows.withColumn("_blocks", blocks).withColumn(key, F.explode_outer("_blocks")).withColumn("_own", F.col(key) == own).drop("_blocks")


def _stretch(ahead: int = 0) -> Column:
    """The stretch of the day that is ``ahead`` days after _day."""
    return F.coalesce(F.floor((F.col("_day") + ahead) / STRETCH), F.lit(UNDATED))


def _signed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("signed_value", F.coalesce("total_value", F.lit(0.0)) * F.col("trade_direction"))


def _trailing(rows: DataFrame, days=TRAILING_DAYS, stretch=_stretch, parts=(), signed=None) -> DataFrame:
    """W1 and W5 for rows with _day, as _s the stretch of their insider, and the trailing features; ``signed`` may add signed values once rows are exchanged.

    Rows of the last days of a stretch are also seen by the next one, with
    what the sums need alone.  Sums are differences of sums that grow by a day
    at a time within a stretch.
    """
    copied = _with_copies(rows, "_s", F.array_distinct(F.array(stretch(), stretch(max(days)))), stretch())
    needed = ("insider_cik", "_day", "_s", "_own", "trade_direction", "total_value" if signed else "signed_value")
    copied = copied.select(*[c if c in needed else F.when(F.col("_own"), F.col(c)).alias(c) for c in copied.columns])
    # Exchanged by name, as the windows' own exchange would also carry what they add up.
    copied = copied.repartition(*parts, "insider_cik", "_s")
    copied = signed(copied) if signed else copied
    d = F.col("trade_direction")
    sums = {"n": F.lit(1), "buys": flag(d == 1), "sells": flag(d == -1), "net": F.col("signed_value")}
    by = Window.partitionBy("insider_cik", "_s").orderBy("_day")
    upto = lambda c, k: F.coalesce(F.sum(sums[c]).over(by.rangeBetween(Window.unboundedPreceding, -k)), F.lit(0))
    within = lambda c, k: upto(c, 1) - upto(c, k + 1)
    cols = {}
    for k in days:
        cols |= {f"trades_{k}d": 2 * within("n", k), f"buy_count_{k}d": within("buys", k), f"sell_count_{k}d": within("sells", k), f"net_value_{k}d": within("net", k)}
    return copied.select("*", *[x.alias(c) for c, x in cols.items()]).filter("_own").drop("_own")


def trailing_windows(trades: DataFrame, days=TRAILING_DAYS) -> DataFrame:
    """Counts and net value of the days before a trade, the same day left out.

    trades_{d}d is twice the number of earlier rows.  Rows without insider or
    date are left out.
    """
    known = _with_day(trades.filter("insider_cik is not null and transaction_date is not null"))
    return with_frequency(_trailing(known, days).select(*trades.columns, *trailing_names(days)), days)


def trailing_names(days=TRAILING_DAYS) -> list[str]:
    return [f"{c}_{d}d" for d in days for c in ("trades", "buy_count", "sell_count", "net_value")]


def with_frequency(df: DataFrame, days=TRAILING_DAYS) -> DataFrame:
    return df.withColumn("trade_frequency_90d", F.col("trades_90d") / 90) if 90 in days else df


def _stretched(trades: DataFrame) -> DataFrame:
    return trades.filter("insider_cik is not null").withColumn("_s", F.coalesce(F.floor(day(F.col("transaction_date")) / STRETCH), F.lit(UNDATED)))


def in_order():
    """Trades of an insider and stretch, ties in the order of row_id."""
    return Window.partitionBy("insider_cik", "_s").orderBy("transaction_date", "row_id")


def _parts() -> dict[str, Column]:
    """What W2 adds up, by name."""
    om, positive = F.coalesce(F.col("is_open_market"), F.lit(False)), F.when(F.col("total_value") > 0, F.col("total_value"))
    d = F.col("trade_direction")
    return {"_n": F.lit(1), "_value": positive, "_valued": flag(positive.isNotNull()), "_buys": flag(om & (d == 1)), "_sells": flag(om & (d == -1))}


def _runs(rows: DataFrame) -> DataFrame:
    """Rows with _new where a run of a direction begins in their stretch, and _run, its number."""
    w, d = in_order(), F.col("trade_direction")
    new = F.coalesce((F.lag(d).over(w) != d) | (d == 0), F.lit(True)).cast("int")
    return rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _told(stretches: DataFrame, cols: dict[str, Column]) -> DataFrame:
    return stretches.select(F.col("insider_cik").alias("_who"), F.col("_s").alias("_at"), *[x.alias(c) for c, x in cols.items()])


def _join_carried(rows: DataFrame, carried: DataFrame) -> DataFrame:
    return rows.join(carried, (rows["insider_cik"] == carried["_who"]) & (rows["_s"] == carried["_at"])).drop("_who", "_at")


def _sums_before(stretches: DataFrame) -> dict[str, Column]:
    """What W2 carries to a stretch, of a table with a row for each insider and stretch."""
    all_of = Window.partitionBy("insider_cik")
    earlier = all_of.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    return {f"_c{c}": F.sum(c).over(earlier) for c in _parts()} | {"_c_first": F.min("_first").over(all_of)}


def _with_open_runs(stretches: DataFrame) -> DataFrame:
    """Such a table with _goes_on, and _open, the length of the run that a stretch ends in.

    The first run of a stretch goes on from the stretch before if that ended
    in the same direction: the open run of a stretch is its last one, or,
    where it is one run that goes on, the sum with those before.
    """
    all_of = Window.partitionBy("insider_cik").orderBy("_s")
    before = F.lag("_last_dir").over(all_of)
    stretches = stretches.withColumn("_goes_on", F.coalesce((before == F.col("_first_dir")) & (before != 0), F.lit(False)))
    stretches = stretches.withColumn("_chain", F.sum(F.when(F.col("_goes_on") & (F.col("_runs") == 1), 0).otherwise(1)).over(all_of.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy("insider_cik", "_chain").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    return stretches.withColumn("_open", F.sum("_open").over(chain))


def _runs_before() -> dict[str, Column]:
    """What W3 and W4 carry to a stretch."""
    all_of = Window.partitionBy("insider_cik").orderBy("_s")
    return {"_c_last": F.lag("_last").over(all_of), "_c_on": F.when(F.col("_goes_on"), F.lag("_open").over(all_of)).otherwise(0)}


def _run_stretches(narrow: DataFrame, sums: dict[str, Column] | None = None) -> DataFrame:
    """(insider_cik, _s, first and last direction, open run, runs, last date, and sums) of rows with their stretch."""
    added = [F.sum(x).alias(c) for c, x in (sums or {}).items()]
    lengths = _runs(narrow).groupBy("insider_cik", "_s", "_run").agg(
        F.count("*").alias("_length"), F.max("trade_direction").alias("_dir"), F.max("transaction_date").alias("_last"), F.min("transaction_date").alias("_first"), *added
    )
    return lengths.groupBy("insider_cik", "_s").agg(
        F.min_by("_dir", "_run").alias("_first_dir"), F.max_by("_dir", "_run").alias("_last_dir"), F.max_by("_length", "_run").alias("_open"), F.max("_run").alias("_runs"),
        F.max("_last").alias("_last"), F.min("_first").alias("_first"), *[F.sum(c).alias(c) for c in sums or {}],
    )


def _with_sums(rows: DataFrame) -> DataFrame:
    """Rows with the sums of W2 over the rows of their stretch before them."""
    past = in_order().rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({f"_w{c}": F.sum(x).over(past) for c, x in _parts().items()})


def _expanded(joined: DataFrame) -> DataFrame:
    """W2 from the sums within and before a stretch."""
    so_far = lambda c: F.coalesce(F.col(f"_c{c}"), F.lit(0)) + F.coalesce(F.col(f"_w{c}"), F.lit(0))
    bought, sold = F.col("insider_buy_count"), F.col("insider_sell_count")
    return (
        joined.withColumns({
            "insider_total_trades": so_far("_n").cast("int"),
            "insider_avg_trade_value": F.when(so_far("_valued") > 0, so_far("_value") / so_far("_valued")).otherwise(0.0),
            "insider_buy_count": so_far("_buys"),
            "insider_sell_count": so_far("_sells"),
            "insider_tenure_days": F.datediff("transaction_date", "_c_first"),
        })
        .withColumn("insider_buy_sell_ratio", F.when(bought + sold > 0, bought / (bought + sold)).otherwise(0.5))
        .drop(*[f"_{k}{c}" for k in "cw" for c in _parts()], "_c_first")
    )


def expanding_history(trades: DataFrame) -> DataFrame:
    """What an insider had done in all rows before this one, ties in the order of row_id."""
    rows = _stretched(trades)
    stretches = rows.groupBy("insider_cik", "_s").agg(*[F.sum(x).alias(c) for c, x in _parts().items()], F.min("transaction_date").alias("_first"))
    return _expanded(_join_carried(_with_sums(rows), _told(stretches, _sums_before(stretches)))).drop("_s")


def _with_streak(rows: DataFrame) -> DataFrame:
    """Rows of _runs with _row, their number in the stretch, _within, that in the run, and _lag, the date before."""
    w = in_order()
    numbered = rows.withColumns({"_row": F.row_number().over(w), "_lag": F.lag("transaction_date").over(w)})
    began = F.max(F.when(F.col("_new") == 1, F.col("_row"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("_within", F.col("_row") - began + 1)


def _streaked(joined: DataFrame) -> DataFrame:
    """W3 and W4 from the runs within and before a stretch."""
    streak = F.col("_within") + F.when(F.col("_run") == 1, F.col("_c_on")).otherwise(0)
    last = F.when(F.col("_row") == 1, F.col("_c_last")).otherwise(F.col("_lag"))
    return joined.withColumns({
        "days_since_last_trade": F.coalesce(F.datediff("transaction_date", last), F.lit(0)),
        "consecutive_direction": F.when(F.col("trade_direction") == 0, 1).otherwise(streak).cast("int"),
    }).drop("_new", "_run", "_row", "_lag", "_within", "_c_last", "_c_on")


def recency_and_streak(trades: DataFrame) -> DataFrame:
    """Days since the insider's previous row, and how long the direction has been the same.

    A direction of 0 never makes a streak.
    """
    rows = _stretched(trades)
    stretches = _with_open_runs(_run_stretches(rows.select("insider_cik", "_s", "transaction_date", "row_id", "trade_direction")))
    return _streaked(_join_carried(_with_streak(_runs(rows)), _told(stretches, _runs_before()))).drop("_s")


def _nearby(rows: DataFrame, days: int = NEAR_DAYS, parts=()) -> DataFrame:
    """Rows with ``_day`` and _any, _buys and _sells: open-market rows of other insiders in their ticker around the day, 0 without ticker or day.

    Rows around in the ticker less rows around of the insider, both in
    ``NEAR_STRETCH`` days of the ticker; rows at its ends are also seen by the
    stretch beside it.  So no pairs are made, no task holds a ticker, and rows
    are exchanged once.
    """
    placed = F.col("_day").isNotNull() & F.col("ticker").isNotNull()
    om, d = F.coalesce(F.col("is_open_market"), F.lit(False)) & placed, F.col("trade_direction")
    at = lambda k: F.floor((F.col("_day") + k) / NEAR_STRETCH)
    # Rows without a place are alone; a hash spreads them.
    own = F.when(placed, at(0)).otherwise(F.pmod(F.xxhash64("row_id"), F.lit(1 << 20)) + LONE)
    here = F.col("_here")
    copied = _with_copies(rows.withColumn("_here", own), "_near", F.when(om, F.array_distinct(F.transform(F.array(*map(F.lit, (0, -days, days))), at))).otherwise(F.array(here)), here).drop("_here")
    copied = copied.repartition(*parts, "ticker", "_near")  # as in _trailing
    counted = {"_any": flag(om), "_buys": flag(om & (d == 1)), "_sells": flag(om & (d == -1))}
    around = lambda *by: Window.partitionBy("ticker", "_near", *by).orderBy("_day").rangeBetween(-days, days)
    of_all = copied.withColumns({f"_all{c}": F.sum(x).over(around()) for c, x in counted.items()})
    of_own = of_all.withColumns({c: F.when(placed, F.col(f"_all{c}") - F.sum(x).over(around("insider_cik"))).otherwise(0) for c, x in counted.items()})
    return of_own.filter("_own").drop("_near", "_own", *[f"_all{c}" for c in counted])


def with_nearby(df: DataFrame) -> DataFrame:
    """The features that follow from _any, _buys and _sells."""
    d = F.col("trade_direction")
    same = F.when(d == 1, F.col("_buys")).when(d == -1, F.col("_sells")).otherwise(0)
    opposite = F.when(d == 1, F.col("_sells")).when(d == -1, F.col("_buys")).otherwise(0)
    return df.withColumns({
        "other_insiders_72h": F.col("_any"), "same_dir_insiders_72h": same, "opp_dir_insiders_72h": opposite,
        "coordination_score": same / F.greatest("_any", F.lit(1)), "cluster_flag": (same >= CLUSTER_FROM).cast("int"),
    }).drop("_any", "_buys", "_sells")


def nearby_insiders(trades: DataFrame, days: int = NEAR_DAYS) -> DataFrame:
    """Open-market rows of other insiders in the same ticker within ``days`` either way.

    Rows without insider or ticker are left out; rows without a date have no one near.
    """
    known = _with_day(trades.filter("insider_cik is not null and ticker is not null"))
    return with_nearby(_nearby(known, days).select(*trades.columns, "_any", "_buys", "_sells"))


def nearby_insiders_by_join(trades: DataFrame, days: int = NEAR_DAYS) -> DataFrame:
    """J6 as a range join on (ticker, bucket of days): what the window form is tested and timed against."""
    width = 2 * days + 1
    known = trades.filter("insider_cik is not null and ticker is not null and transaction_date is not null")
    own = known.select("row_id", "ticker", "insider_cik", "trade_direction", day(F.col("transaction_date")).alias("d"))
    peer = own.join(known.filter("is_open_market").select("row_id"), "row_id", "left_semi")
    left = own.withColumn("bucket", F.explode(F.array_distinct(F.array(*[F.floor((F.col("d") + k) / width) for k in (-days, days)]))))
    right = peer.withColumn("bucket", F.floor(F.col("d") / width)).select(
        F.col("ticker").alias("t"), "bucket", F.col("insider_cik").alias("p"), F.col("d").alias("pd"), F.col("trade_direction").alias("dir")
    )
    pairs = left.join(right, (left.ticker == right.t) & (left.bucket == right.bucket) & (F.abs(F.col("d") - F.col("pd")) <= days) & (F.col("p") != F.col("insider_cik")))
    own_dir = F.col("trade_direction")
    counts = pairs.groupBy("row_id").agg(
        F.count("*").alias("other_insiders_72h"),
        F.count_if((own_dir != 0) & (F.col("dir") == own_dir)).alias("same_dir_insiders_72h"),
        F.count_if((own_dir != 0) & (F.col("dir") == -own_dir)).alias("opp_dir_insiders_72h"),
    )
    return own.select("row_id").join(counts, "row_id", "left").na.fill(0)


def _long_histories(trades: DataFrame) -> tuple[int, list[str]]:
    """Rows that have an insider, and the insiders of more than ``LONG_HISTORY`` of them, of whom there are few."""
    counts = trades.filter("insider_cik is not null").groupBy("insider_cik").agg(F.count("*").alias("n"))
    one = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.collect_list(F.when(F.col("n") > LONG_HISTORY, F.col("insider_cik")))).first()
    return one[0], sorted(one[1])


def _carried(trades: DataFrame, which: Column) -> DataFrame:
    """What W2, W3 and W4 carry to each stretch of the insiders for whom ``which`` holds."""
    narrow = _stretched(trades.filter(which)).select("insider_cik", "_s", "transaction_date", "row_id", "trade_direction", "is_open_market", "total_value")
    stretches = _with_open_runs(_run_stretches(narrow, _parts()))
    return _told(stretches, _sums_before(stretches) | _runs_before())


def with_history(trades: DataFrame, exact=None) -> DataFrame:
    """All features of the past and of others around, for trades with direction that have an insider, a ticker and a date; ``exact`` may make signed values decimals for the sums.

    The rows are exchanged twice, by stretches of their ticker and by their
    insider, without signed values, which follow from the others; features of single trades are best added afterwards, as rows
    travel with all their columns.  Insiders are counted first: only those of
    long histories are told by stretches, for which rows are copied and what
    earlier stretches carry is made.
    """
    rows = _with_day(trades.drop("signed_value").filter("insider_cik is not null"))
    signed = (lambda df: exact(_signed(df))) if exact else _signed
    n, long = _long_histories(trades)
    parts, in_stretches = spread(trades.sparkSession, n, TASK_ROWS), F.col("insider_cik").isin(long)
    stretch = (lambda ahead=0: F.when(in_stretches, _stretch(ahead)).otherwise(UNDATED)) if long else lambda ahead=0: F.lit(UNDATED)
    placed = _with_streak(_runs(_with_sums(_trailing(_nearby(rows, parts=parts), stretch=stretch, parts=parts, signed=signed))))
    # Dates ascend, so the first one so far is the first one.
    placed = placed.withColumn("_w_first", F.min("transaction_date").over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    if long:
        told = _carried(trades, in_stretches)
        joined = placed.join(told, (placed["insider_cik"] == told["_who"]) & (placed["_s"] == told["_at"]), "left").drop("_who", "_at")
    else:
        joined = placed.withColumns({f"_c{c}": F.lit(0) for c in _parts()} | {"_c_first": F.lit(None).cast("date"), "_c_last": F.lit(None).cast("date"), "_c_on": F.lit(0)})
    joined = joined.withColumns({"_c_first": F.coalesce("_c_first", "_w_first"), "_c_on": F.coalesce("_c_on", F.lit(0))}).drop("_w_first")
    ordered = _streaked(_expanded(joined))
    return with_frequency(with_nearby(ordered.filter("ticker is not null and transaction_date is not null").drop("_day", "_s")))


def feature_matrix(trades: DataFrame, exact=None) -> DataFrame:
    """All features of every trade that has an insider, a ticker and a date; ``exact`` may make signed values decimals for the sums."""
    from ledgerlark.functions import trade as t

    return t.add_text_features(t.add_role_features(t.add_trade_features(with_history(t.add_direction(trades), exact))))


#: Columns of a trade that features of other trades need.
SHARED = ("row_id", "ticker", "insider_cik", "transaction_date", "is_open_market", "total_value", "trade_direction", "signed_value")
#: What stands for the texts of a trade among its features.
WORDED = (
    "role_seniority", "is_ceo", "is_cfo", "is_coo", "is_director_only", "footnote_length", "footnote_has_plan", "footnote_routine_hits", "footnote_informed_hits",
    "footnote_has_option",
)


def model_matrix(trades: DataFrame, features, *keep: str, wanted: str = "true", exact=None) -> DataFrame:
    """``keep`` and ``features`` of the trades for which ``wanted`` holds, as :func:`feature_matrix` has them.

    All trades count in the features of others, but those that are not wanted
    travel with what others need alone, and texts as numbers.
    """
    from ledgerlark.functions import trade as t

    own = t.add_direction(t.add_text_counts(t.add_role_features(trades)))
    carried = [c for c in (*trades.columns, *WORDED) if c not in SHARED]
    rows = own.select(*SHARED, *[F.when(F.expr(wanted), F.col(c)).alias(c) for c in carried])
    return t.add_text_scores(t.add_trade_features(with_history(rows, exact).filter(wanted))).select(*dict.fromkeys([*keep, *features]))


# Columns of the feature matrix.
ID_COLUMNS = ("row_id", "ticker", "insider_cik", "transaction_date", "transaction_code")
DROPPED = ("xml_path", "footnote_text", "issuer_name", "is_amendment", "accession_number")
NUMERIC = tuple(
    "log_shares log_total_value log_shares_owned_after total_value_is_imputed trade_direction signed_value days_to_filing pct_position_traded "
    "txn_day_of_week txn_month txn_quarter role_seniority is_ceo is_cfo is_coo is_director_only is_open_market is_derivative has_plan "
    "insider_total_trades insider_avg_trade_value insider_buy_sell_ratio insider_tenure_days trades_7d trades_30d trades_90d buy_count_7d sell_count_7d "
    "buy_count_30d sell_count_30d buy_count_90d sell_count_90d net_value_7d net_value_30d net_value_90d days_since_last_trade consecutive_direction "
    "trade_frequency_90d other_insiders_72h same_dir_insiders_72h coordination_score cluster_flag footnote_length footnote_has_plan "
    "footnote_routine_score footnote_routine_hits footnote_informed_hits footnote_has_option value_bucket_num".split()
)
CATEGORICAL = ("value_bucket",)
MODEL_LEAKS = frozenset(
    "future_close forward_return benchmark_return abnormal_return signed_abnormal_return price_signal earnings_proximity_flag enforcement_followup_flag "
    "has_plan footnote_has_plan footnote_routine_score footnote_routine_hits footnote_informed_hits footnote_has_option informed_label routine_label "
    "cohen_label plan_override".split()
)
MODEL_FEATURES = tuple(c for c in NUMERIC if c not in MODEL_LEAKS)
# Groups of features that an ablation leaves out.
FEATURE_GROUPS = {
    "trade": tuple("log_shares log_total_value log_shares_owned_after total_value_is_imputed signed_value pct_position_traded value_bucket_num trade_direction".split()),
    "temporal": (*(f"{c}_{d}d" for c in ("trades", "buy_count", "sell_count", "net_value") for d in TRAILING_DAYS), "days_since_last_trade", "consecutive_direction", "trade_frequency_90d"),
    "insider_profile": tuple("role_seniority is_ceo is_cfo is_coo is_director_only insider_total_trades insider_avg_trade_value insider_buy_sell_ratio insider_tenure_days".split()),
    "network": ("other_insiders_72h", "same_dir_insiders_72h", "coordination_score", "cluster_flag"),
    "timing": ("txn_day_of_week", "txn_month", "txn_quarter", "days_to_filing"),
    "text": ("footnote_length",),
    "market_context": ("is_open_market", "is_derivative", "total_value_is_imputed"),
}


def drop_unused(df: DataFrame) -> DataFrame:
    """P24."""
    return df.drop(*DROPPED)


def features_only(df: DataFrame) -> DataFrame:
    """Ids and the features that are there."""
    return df.select([c for c in (*ID_COLUMNS, *NUMERIC, *CATEGORICAL) if c in df.columns])
