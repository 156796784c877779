"""Labels of trades: returns after the trade, events near it and calendar routine."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.functions import trade as t
from ledgerlark.operators import asof

HORIZON, THRESHOLD, PROXIMITY, LOOKAHEAD = 30, 0.05, 30, 365
EXCLUDED = ("M", "A", "F", "G", "D")


def with_pricing_ticker(trades: DataFrame) -> DataFrame:
    """issuer_ticker, missing ones filled by its most frequent value; without any, ticker."""
    if "issuer_ticker" not in trades.columns:
        return trades.withColumn("pricing_ticker", t.normal_ticker(F.col("ticker")))
    own = t.normal_ticker(F.col("issuer_ticker"))
    mode = most_frequent(trades.select(own.alias("v")), "v").withColumnRenamed("v", "_mode")
    return trades.join(F.broadcast(mode), how="left").withColumn("pricing_ticker", F.coalesce(own, "_mode", t.normal_ticker(F.col("ticker")))).drop("_mode")


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, of several the smallest; one row, none for a column of nulls."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    return counts.orderBy(F.desc("_n"), column).limit(1).select(column)


def focus(trades: DataFrame, path: str) -> DataFrame:
    """P20: where a file is named for one of several tickers, only that ticker's rows."""
    wanted = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].upper().split("_FORM4")[0]
    found = trades.agg(F.max(F.col("ticker") == wanted), F.min("ticker") < F.max("ticker"), F.max(F.col("ticker").isNull())).first()
    return trades.filter(F.col("ticker") == wanted) if found[0] and (found[1] or found[2]) else trades


def add_price_labels(trades: DataFrame, prices: DataFrame, benchmark: DataFrame, horizon: int = HORIZON, threshold: float = THRESHOLD) -> DataFrame:
    """Returns to the horizon, less the benchmark's, and the signal."""
    return _price_labels(_near_trades(trades, asof.price_series(trades, prices, horizon), benchmark, horizon), horizon, threshold)


def _near_trades(trades: DataFrame, series: list[asof.Series], benchmark: DataFrame, horizon: int) -> DataFrame:
    """``trades`` with the series and the benchmark on the day (_b0) and at the horizon (_b1), all looked up by ticker and day and joined once."""
    found = asof.as_of_all(trades, "ticker", "transaction_date", series)
    names = [*(s.name for s in series), "_b0", "_b1"]
    # A day of the benchmark is known without a ticker.
    loose = trades.filter("ticker is null").select(F.lit(None).cast("string").alias("ticker"), "transaction_date").distinct()
    found = found.unionByName(loose, allowMissingColumns=True)
    found = asof.as_of(found, "transaction_date", benchmark, None, "date", "close", "_b0")
    found = asof.as_of(found.withColumn("_target", F.date_add("transaction_date", horizon)), "_target", benchmark, None, "date", "close", "_b1", forward=True)
    found = found.select(F.col("ticker").alias("_t"), F.col("transaction_date").alias("_on"), *names)
    same = F.col("ticker").eqNullSafe(F.col("_t")) & (F.col("transaction_date") == F.col("_on"))
    return trades.join(found, same, "left").select(*trades.columns, *names)


def _price_labels(priced: DataFrame, horizon: int, threshold: float) -> DataFrame:
    back = lambda a, b: F.try_divide(F.col(b) - F.col(a), F.col(a))
    sign = F.col("trade_direction") if "trade_direction" in priced.columns else t.direction(t.normal_code(F.col("transaction_code")), t.LABEL_BUY, t.LABEL_SELL)
    return (
        priced.withColumn("trade_direction", sign)
        .withColumns({"forward_return": back("txn_close", "future_close"), "benchmark_return": back("_b0", "_b1")})
        .withColumn("abnormal_return", F.col("forward_return") - F.col("benchmark_return"))
        .withColumn("signed_abnormal_return", F.col("abnormal_return") * F.col("trade_direction"))
        .withColumns({"price_signal": F.coalesce(F.col("signed_abnormal_return") >= threshold, F.lit(False)).cast("int"), "label_horizon_days": F.lit(horizon)})
        .drop("_b0", "_b1")
    )


def plan_flag(df: DataFrame) -> Column:
    """P21."""
    flags = [F.coalesce(F.col(c).cast("int") == 1, F.lit(False)) for c in ("has_plan", "footnote_has_plan") if c in df.columns]
    return (F.greatest(*flags, F.lit(False)) if flags else F.lit(False)).cast("int")


def _calendar(trades: DataFrame) -> DataFrame:
    return trades.withColumns({"_who": F.coalesce("insider_cik", F.lit("nan")), "_month": F.month("transaction_date"), "_year": F.year("transaction_date")})


def routine_months(trades: DataFrame) -> DataFrame:
    """(_who, _month, _year) in which an insider traded who had in this month of both years before."""
    years = _calendar(trades).filter("transaction_date is not null").select("_who", "_month", "_year").distinct()
    w = Window.partitionBy("_who", "_month").orderBy("_year")
    known = years.withColumn("is_routine", (F.lag("_year", 1).over(w) == F.col("_year") - 1) & (F.lag("_year", 2).over(w) == F.col("_year") - 2))
    return known.filter("is_routine")


def routine_trades(trades: DataFrame) -> DataFrame:
    """``trades`` (P and S) with ``is_routine``: the insider traded in this month of both years before.

    A missing insider is one insider named 'nan'.
    """
    joined = _calendar(trades).join(routine_months(trades), ["_who", "_month", "_year"], "left")
    return joined.withColumn("is_routine", F.coalesce("is_routine", F.lit(False))).drop("_who", "_month", "_year")


def combine_signals(trades: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Source count, calendar label of open-market trades, plan override, final label and its names.

    ``base`` has the same trades where ``trades`` are costly to compute; the calendar is read from it.
    """
    for c in ("price_signal", "earnings_proximity_flag", "enforcement_followup_flag"):
        if c not in trades.columns:
            trades = trades.withColumn(c, F.lit(0))
    code = t.normal_code(F.col("transaction_code"))
    om = F.coalesce(code.isin(*t.OPEN_MARKET), F.lit(False))
    months = routine_months((base or trades).filter(om))
    joined = _calendar(trades.withColumn("_om", om)).join(months, ["_who", "_month", "_year"], "left").drop("_who", "_month", "_year")
    marked = joined.withColumn("is_routine", F.col("_om") & F.coalesce("is_routine", F.lit(False)))
    override = F.when(F.col("_om"), plan_flag(trades)).otherwise(0)
    none = ~F.col("_om") | F.coalesce(code.isin(*EXCLUDED), F.lit(False))
    final = F.col("final_label")
    return (
        marked.withColumns({
            "label_source_count": sum((F.coalesce(F.col(c), F.lit(0)).cast("int") for c in ("price_signal", "earnings_proximity_flag", "enforcement_followup_flag")), F.lit(0)),
            "cohen_label": F.when(none, -1).when(F.col("is_routine"), 0).otherwise(1),
            "plan_override": override,
        })
        .withColumn("final_label", F.when(none, -1).when(F.col("plan_override") == 1, 0).otherwise(F.col("cohen_label")))
        .withColumns({
            "informed_label": (final == 1).cast("int"), "routine_label": (final == 0).cast("int"),
            "label_name": F.when(final == 1, "opportunistic").when(final == 0, "routine").otherwise("uncertain"),
            "label_confidence": F.when(final == -1, "uncertain").when(F.col("plan_override") == 1, "high").otherwise("medium"),
        })
        .drop("_om", "is_routine")
    )


def build_labels(trades: DataFrame, prices: DataFrame, benchmark: DataFrame, earnings: DataFrame, enforcement: DataFrame, horizon: int = HORIZON,
                 threshold: float = THRESHOLD, proximity: int = PROXIMITY, lookahead: int = LOOKAHEAD) -> DataFrame:
    """Prices, earnings and enforcement actions of a ticker are looked up together, and joined to the trades once."""
    events = [*asof.event_series(earnings, "announcement_date", "_before", "_after"), *asof.event_series(enforcement, "action_date", None, "_ahead")]
    near = _near_trades(trades, [*asof.price_series(trades, prices, horizon), *events], benchmark, horizon)
    flags = {"earnings_proximity_flag": asof.is_near("_before", "_after", proximity), "enforcement_followup_flag": asof.is_ahead("_ahead", lookahead)}
    return combine_signals(_price_labels(near.withColumns(flags).drop("_before", "_after", "_ahead"), horizon, threshold), trades)


def label_summary(labeled: DataFrame) -> DataFrame:
    """One row of counts, shares and recommendations."""
    n = F.count("*")
    pct = lambda x: F.when(n > 0, F.round(100 * x / n, 2)).otherwise(0.0)
    one = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    cov, bench = F.count("forward_return"), F.count("benchmark_return")
    opp = one(F.col("final_label") == 1)
    signals = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("price_signal", "earnings_proximity_flag", "enforcement_followup_flag")}
    advice = F.array_compact(F.array(
        F.when(100 * cov / n < 90, "price coverage below 90 %"),
        F.when(100 * opp / n < 1, "opportunistic share below 1 %").when(100 * opp / n > 40, "opportunistic share above 40 %"),
        F.when(signals["earnings_proximity_flag"] == 0, "no earnings confirmations"),
        F.when(signals["enforcement_followup_flag"] == 0, "no enforcement confirmations"),
    ))
    return labeled.agg(
        n.alias("rows"), cov.alias("forward_return_rows"), pct(cov).alias("forward_return_pct"), bench.alias("benchmark_return_rows"), pct(bench).alias("benchmark_return_pct"),
        opp.alias("opportunistic_rows"), pct(opp).alias("opportunistic_pct"), one(F.col("final_label") == 0).alias("routine_rows"),
        pct(one(F.col("final_label") == 0)).alias("routine_pct"), one(F.col("final_label") == -1).alias("uncertain_rows"), pct(one(F.col("final_label") == -1)).alias("uncertain_pct"),
        *[x.alias(f"{c}_rows") for c, x in signals.items()],
        *[one(F.col("label_source_count") == k).alias(f"sources_{k}_rows") for k in range(4)], F.array_join(advice, "; ").alias("recommendations"),
    )


def calibration_grid(spark, labeled: DataFrame, thresholds, source_counts) -> DataFrame:
    """For each threshold and number of sources asked for, how many trades count as informed.

    A trade is informed when enough of its three signals agree, the price
    signal being taken at the threshold.
    """
    cuts = sorted({float(x) for x in thresholds})
    grid = spark.createDataFrame([(k + 1, a, int(b)) for k, a in enumerate(cuts) for b in source_counts], "_at int, abnormal_threshold double, confidence_sources_required int")
    others = (F.coalesce("earnings_proximity_flag", F.lit(0)) + F.coalesce("enforcement_followup_flag", F.lit(0))).alias("_others")
    narrow = labeled.select(F.col("signed_abnormal_return").cast("double").alias("_r"), "forward_return", others)
    per = lambda rows: rows.groupBy("_above", "_others").agg(F.count("*").alias("n"), F.count("forward_return").alias("c"))
    placed = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_r", outputCol="_above", handleInvalid="keep").transform(narrow.filter("_r is not null"))
    # Rows are counted between thresholds first; what is left has a few rows for each threshold.
    counts = per(placed).unionByName(per(narrow.filter("_r is null").withColumn("_above", F.lit(0.0))))
    informed = F.col("_others") + (F.col("_above") >= F.col("_at")).cast("int") >= F.col("confidence_sources_required")
    return (
        counts.crossJoin(F.broadcast(grid))
        .groupBy("abnormal_threshold", "confidence_sources_required")
        .agg(F.sum("n").alias("rows"), F.sum(F.when(informed, F.col("n")).otherwise(0)).alias("informed_rows"), F.sum("c").alias("covered"))
        .select("abnormal_threshold", "confidence_sources_required", "rows", "informed_rows",
                F.round(100 * F.col("informed_rows") / F.col("rows"), 4).alias("informed_pct"), F.round(100 * F.col("covered") / F.col("rows"), 4).alias("coverage_pct"))
    )


def recommend(grid: DataFrame, low: float, high: float) -> DataFrame:
    """The setting nearest the middle of the band, those inside first, with a penalty for coverage below 95 %."""
    score = F.abs(F.col("informed_pct") - (low + high) / 2) + 0.2 * F.greatest(F.lit(0.0), 95 - F.col("coverage_pct"))
    inside = F.col("informed_pct").between(low, high).cast("int")
    return grid.withColumn("score", F.round(score, 6)).orderBy(inside.desc(), "score", F.desc("coverage_pct"), "abnormal_threshold", "confidence_sources_required").limit(1)
