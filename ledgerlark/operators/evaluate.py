"""Evaluation of scores: metrics, sweeps, rules of fuzzy membership, group tables and tests of difference."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.functions.trade import OPEN_MARKET, col_or, normal_code
from ledgerlark.operators import quantiles

# Weights of the fuzzy memberships, and sectors by ticker of two analyses where they differ.
FUZZY_WEIGHTS = {"near_earnings": 0.30, "position_size": 0.25, "no_plan": 0.25, "coordination": 0.10, "filing_lag": 0.10}
FLAG_FROM = 0.5
OTHER_SECTOR = "Other"


def model_rows(df: DataFrame, labeled: bool = True) -> DataFrame:
    """Open-market rows, with a label of 0 or 1."""
    rows = df.filter(F.coalesce(normal_code(F.col("transaction_code")).isin(*OPEN_MARKET), F.lit(False)))
    return rows.filter(F.coalesce(F.col("final_label").try_cast("int").isin(0, 1), F.lit(False))) if labeled else rows


def time_split(df: DataFrame, train_to: int = 2022, test: int = 2024) -> DataFrame:
    """Model rows with their split by year: train, val for the year after, test for the year after that."""
    year = F.year("transaction_date")
    split = F.when(year <= train_to, "train").when(year == test - 1, "val").when(year == test, "test")
    return model_rows(df).withColumn("dataset_split", split).filter("dataset_split is not null")


def memberships(df: DataFrame) -> DataFrame:
    """Five memberships, the weighted score and its flag."""
    num = lambda c, d=0.0: F.coalesce(col_or(df, c, d).try_cast("double"), F.lit(d))
    month, pct, near, lag = num("txn_month"), num("pct_position_traded"), num("other_insiders_72h"), num("days_to_filing")
    plan = F.coalesce(col_or(df, "has_plan", 1).try_cast("double"), F.lit(1.0))
    parts = {
        "near_earnings": F.when(month.isin(1, 4, 7, 10), 1.0).when(month.isin(2, 5, 8, 11), 0.5).otherwise(0.0),
        "position_size": F.when(pct >= 0.10, 1.0).when(pct > 0.01, (pct - 0.01) / 0.09).otherwise(0.0),
        "no_plan": F.when(plan == 0, 1.0).otherwise(0.0),
        "coordination": F.when(near >= 3, 1.0).when(near > 0, near / 3).otherwise(0.0),
        "filing_lag": F.when(lag > 5, 1.0).when(lag > 1, (lag - 1) / 4).otherwise(0.0),
    }
    score = sum((F.col(f"m_{k}") * w for k, w in FUZZY_WEIGHTS.items()), F.lit(0.0))
    out = df.withColumns({f"m_{k}": v for k, v in parts.items()})
    return out.withColumn("fuzzy_score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).withColumn("fuzzy_flag", (F.round("fuzzy_score", 9) >= FLAG_FROM).cast("int"))


def baskets(df: DataFrame, median: DataFrame) -> DataFrame:
    """row_id and the items that hold; ``median`` is the one-row table of A29."""
    num = lambda c, d=0.0: F.coalesce(col_or(df, c, d).try_cast("double"), F.lit(d))
    items = {
        "large_trade": num("pct_position_traded") > 0.05, "near_earnings": num("txn_month").isin(1, 4, 7, 10), "sell_transaction": num("trade_direction", 1.0) == -1,
        "senior_insider": num("role_seniority") >= 4, "coordinated": num("other_insiders_72h") >= 2,
        "large_dollar": F.coalesce(num("log_total_value") > F.col("median"), F.lit(False)), "late_filing": num("days_to_filing") > 2, "opportunistic": F.col("final_label") == 1,
    }
    listed = F.array_compact(F.array(*[F.when(cond, name) for name, cond in items.items()]))
    return df.crossJoin(F.broadcast(median)).select("row_id", "final_label", listed.alias("items"))  # one row


def median_of(df: DataFrame, column: str) -> DataFrame:
    """One row."""
    found = quantiles.selected(df, {column: F.col(column)}, [0.5])[column][0]
    return df.sparkSession.range(1).select(F.lit(found).cast("double").alias("median"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, predicted: Column, label: str = "final_label", by=()) -> DataFrame:
    """Counts, precision, recall and F1 (0 where they divide by zero), for each group of ``by``."""
    y, p = F.col(label) == 1, F.coalesce(predicted, F.lit(False))
    tp, fp, fn, tn = F.count_if(y & p), F.count_if(~y & p), F.count_if(y & ~p), F.count_if(~y & ~p)
    counted = (df.groupBy(*by) if by else df.groupBy()).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    t, f, n = F.col("tp"), F.col("fp"), F.col("fn")
    r6 = lambda c, name: F.round(c, 6).alias(name)
    return counted.select(*by, "tp", "fp", "fn", "tn", r6(_ratio(t, t + f), "precision"), r6(_ratio(t, t + n), "recall"), r6(_ratio(2 * t, 2 * t + f + n), "f1"))


def _steps(df: DataFrame, score: str, label: str, by, times: str | None = None) -> DataFrame:
    """Cumulative true and false positives at each distinct score, the highest first.

    Rows are counted by score before the window.  Scores are cut into ranges
    of about as many distinct ones; a window runs inside each range, and one
    over the totals of the few ranges.  A row counts as often as its ``times`` says.
    """
    number = lambda cond: F.sum(F.when(cond, F.col(times)).otherwise(0)) if times else F.count_if(cond)
    per = df.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("threshold")).agg(number(F.col(label) == 1).alias("p"), number(F.col(label) != 1).alias("n"))
    # The counts are exchanged once: the plan reads them again for the cuts, which are one row.
    cuts = per.agg(F.array_distinct(F.percentile_approx(F.col("threshold").cast("double"), [i / RANGES for i in range(1, RANGES)])).alias("_cuts"))
    per = per.crossJoin(F.broadcast(cuts)).withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c >= F.col("threshold"))), F.lit(0))).drop("_cuts")
    totals = per.groupBy(*by, "_range").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    group = by or [F.lit(0)]  # without groups, at most RANGES rows
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *by, F.col("_range").alias("_r"), F.coalesce(F.sum("_p").over(earlier), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_fp"),
        F.sum("_p").over(Window.partitionBy(*group)).alias("positives"),
    ).withColumnsRenamed({c: f"_by_{c}" for c in by})
    down = Window.partitionBy(*by, "_range").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_range") == F.col("_r"))
    run = per.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down)}).join(totals, same)
    return run.withColumns({"tp": F.col("tp") + F.col("_tp"), "fp": F.col("fp") + F.col("_fp")})


def pr_curve(df: DataFrame, score: str = "prob", label: str = "final_label", by=()) -> DataFrame:
    """Precision and recall at each distinct score."""
    s = _steps(df, score, label, list(by))
    return s.select(*by, "threshold", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(_ratio(F.col("tp"), F.col("positives")), 6).alias("recall"))


def average_precision(df: DataFrame, score: str = "prob", label: str = "final_label", by=(), times: str | None = None) -> DataFrame:
    """The sum of precision over steps of recall, equal scores together; null where one class is missing.  A row counts as often as its ``times`` says."""
    s = _steps(df, score, label, list(by), times)
    step = F.col("p") / F.col("positives") * F.col("tp") / (F.col("tp") + F.col("fp"))
    found = s.groupBy(*by).agg(F.sum(F.when(F.col("positives") > 0, step)).alias("ap"), F.sum("n").alias("neg"))
    return found.select(*by, F.when(F.col("neg") > 0, F.round("ap", 6)).alias("average_precision"))


def threshold_sweep(df: DataFrame, thresholds, score: str = "prob", label: str = "final_label") -> DataFrame:
    """Metrics at each threshold in one pass; the best is first by F1, then the lowest threshold.

    Each row falls between two thresholds, found by binary search, and what a
    threshold flags is the sum over the ranges above it, so the work for a row
    hardly grows with the number of thresholds.  A row without score is not flagged.
    """
    cuts = sorted({float(t) for t in thresholds})
    narrow = df.select(F.col(score).cast("double").alias("_s"), (F.coalesce(F.col(label) == 1, F.lit(False))).alias("_y"))
    placed = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_s", outputCol="_above", handleInvalid="keep").transform(narrow.filter("_s is not null"))
    known = placed.groupBy(F.col("_above").cast("int").alias("_above")).agg(F.count_if("_y").alias("p"), F.count_if(~F.col("_y")).alias("n"))
    lost = narrow.agg(F.count_if("_y").alias("positives"))
    # As many rows as thresholds from here on.
    grid = df.sparkSession.createDataFrame([(k + 1, t) for k, t in enumerate(cuts)], "_above int, threshold double")
    down = Window.orderBy(F.desc("_above")).rowsBetween(Window.unboundedPreceding, 0)
    ranged = grid.join(known, "_above", "full").na.fill(0, ["p", "n"])
    s = ranged.select("threshold", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp")).filter("threshold is not null").crossJoin(F.broadcast(lost))  # one row
    s = s.select("threshold", "tp", "fp", (F.col("positives") - F.col("tp")).alias("fn"))
    f1 = _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return s.withColumn("f1", F.round(f1, 6)).orderBy(F.desc("f1"), "threshold")


def class_weights(df: DataFrame, label: str = "final_label") -> DataFrame:
    """Class counts, priors and the weight of a positive."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(pos.alias("positives"), neg.alias("negatives")).withColumns({
        "prior_1": F.round(F.col("positives") / (F.col("positives") + F.col("negatives")), 6),
        "scale_pos_weight": F.round(F.try_divide(F.col("negatives"), F.col("positives")), 6),
    })


def separation(df: DataFrame, features, label: str = "final_label", k: int = 20) -> DataFrame:
    """Difference of class means in units of the pooled deviation, the ``k`` largest."""
    cells = df.select(label, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features])).alias("c")).select(label, "c.*")
    side = lambda y: F.when(F.col(label) == y, F.col("v"))
    s = cells.groupBy("feature").agg(F.avg(side(1)).alias("mean_1"), F.avg(side(0)).alias("mean_0"), F.var_samp(side(1)).alias("v1"), F.var_samp(side(0)).alias("v0"))
    gap = F.try_divide(F.abs(F.col("mean_1") - F.col("mean_0")), F.sqrt((F.col("v1") + F.col("v0")) / 2))
    return s.select("feature", F.round("mean_1", 4).alias("mean_1"), F.round("mean_0", 4).alias("mean_0"), F.round(gap, 4).alias("separation")).orderBy(F.desc_nulls_last("separation"), "feature").limit(k)


def complementarity(df: DataFrame, a: Column, b: Column, label: str = "final_label") -> DataFrame:
    """Positives that both flags find, one of them or none, and F1 of each and of either."""
    y = F.col(label) == 1
    f1 = lambda p: F.round(_ratio(2 * F.count_if(y & p), F.count_if(y) + F.count_if(p)), 6)
    return df.agg(F.count_if(y & a & b).alias("both"), F.count_if(y & a & ~b).alias("only_a"), F.count_if(y & ~a & b).alias("only_b"), F.count_if(y & ~a & ~b).alias("neither"),
                  f1(a).alias("f1_a"), f1(b).alias("f1_b"), f1(a | b).alias("f1_either"))


#: Ranges of scores, each with a window of its own.
RANGES = 64
#: Steps of the integrals of Student's t, and how far they reach, in deviations.
P_STEPS, P_REACH = 2000, 14.0


def student_p(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t: the share of the integral of cos(x)^(dof - 1) beyond atan(|t| / sqrt(dof)), by Simpson's rule."""
    end, start = F.least(F.lit(math.pi / 2), P_REACH / F.sqrt(dof)), F.atan(F.abs(t) / F.sqrt(dof))
    weight = lambda k: F.when((k == 0) | (k == P_STEPS), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
    height = lambda x: F.exp((dof - 1) * F.log(F.greatest(F.cos(x), F.lit(1e-300))))

    def integral(low: Column) -> Column:
        steps = F.sequence(F.lit(0), F.lit(P_STEPS))
        return F.aggregate(steps, F.lit(0.0), lambda a, k: a + weight(k) * height(low + (end - low) * k / P_STEPS)) * F.greatest(end - low, F.lit(0.0))

    return F.when(t.isNotNull() & dof.isNotNull(), integral(start) / integral(F.lit(0.0)))


def welch(df: DataFrame, value: str, flag: Column, by=(), least: int = 2) -> DataFrame:
    """Welch's t and its degrees of freedom for each group with ``least`` rows on either side."""
    side = lambda y: F.when(flag if y else ~flag, F.col(value).cast("double"))
    s = (df.groupBy(*by) if by else df.groupBy()).agg(*[f(side(y)).alias(f"{n}{y}") for y in (1, 0) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    s = s.filter((F.col("n1") >= least) & (F.col("n0") >= least))
    e1, e0 = F.col("var1") / F.col("n1"), F.col("var0") / F.col("n0")
    t = F.try_divide(F.col("mean1") - F.col("mean0"), F.sqrt(e1 + e0))
    dof = F.try_divide((e1 + e0) * (e1 + e0), e1 * e1 / (F.col("n1") - 1) + e0 * e0 / (F.col("n0") - 1))
    return s.select(*by, "n1", "n0", F.round("mean1", 6).alias("mean1"), F.round("mean0", 6).alias("mean0"), F.round(F.col("mean1") - F.col("mean0"), 6).alias("difference"),
                    F.round(t, 6).alias("t"), F.round(dof, 4).alias("dof"))


def with_p(tests: DataFrame) -> DataFrame:
    """``tests`` with p and stars."""
    out = tests.withColumn("p", F.round(student_p(F.col("t"), F.col("dof")), 6))
    return out.withColumn("stars", F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise(""))


def with_sector(df: DataFrame, sectors: DataFrame, ticker: str = "ticker") -> DataFrame:
    """``df`` with the sector of its ticker, from a table (ticker, sector); unknown and missing tickers are in 'Other'."""
    known = sectors.select(F.upper(F.trim("ticker")).alias("_t"), F.col("sector")).dropDuplicates(["_t"])
    return df.join(known, F.upper(F.trim(ticker)) == F.col("_t"), "left").drop("_t").withColumn("sector", F.coalesce("sector", F.lit(OTHER_SECTOR)))


def mean_scores(df: DataFrame, by: str, score: str = "fuzzy_score") -> DataFrame:
    """Rows and mean score of each code or label."""
    return df.groupBy(by).agg(F.round(F.avg(F.col(score).cast("decimal(12,8)")).cast("double"), 5).alias("mean_score"), F.count("*").alias("n"))


def group_rates(df: DataFrame, by: str, flag: Column, score: str = "prob", label: str = "final_label") -> DataFrame:
    """Rows, flag rate, mean score, label rate and tickers of each group."""
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(flag).alias("flagged"), F.round(F.avg(flag.cast("int")), 3).alias("flag_rate"), F.round(F.avg(F.col(score).cast("decimal(20,6)")).cast("double"), 3).alias("mean_score"),
        F.round(F.avg((F.col(label) == 1).cast("int")), 3).alias("label_rate"), F.count_distinct("ticker").alias("tickers"),
    )


def flag_pivot(df: DataFrame, rows: str, columns: Column, values, flag: Column) -> DataFrame:
    """Mean flag by group and by each of ``values``."""
    return df.withColumn("_c", columns).groupBy(rows).pivot("_c", list(values)).agg(F.round(F.avg(flag.cast("int")), 3))


def histogram(df: DataFrame, value: str, by, low: float, high: float, bins: int) -> DataFrame:
    """Rows of each bin and group; 0 and ``bins`` + 1 lie outside."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, F.width_bucket(value, F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def five_numbers(df: DataFrame, value: str, by) -> DataFrame:
    """Minimum, quartiles and maximum of each group."""
    return quantiles.by_group(df, value, by, [0.0, 0.25, 0.5, 0.75, 1.0]).select(*by, *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("low", "q25", "median", "q75", "high"))])


def insider_profiles(df: DataFrame, features, label: str = "final_label") -> DataFrame:
    """Mean features and informed rate of each insider."""
    return df.filter("insider_cik is not null").groupBy("insider_cik").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in features], F.avg((F.col(label) == 1).cast("int")).alias("informed_rate"))


def min_max(df: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """``column`` scaled by the range of ``train``, between 0 and 1; all 0 without a range."""
    ends = train.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = (F.col(column) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return df.crossJoin(F.broadcast(ends)).withColumn(f"{column}_scaled", F.coalesce(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))).drop("_lo", "_hi")
