"""Queries of scores, metrics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import trade as t
from ledgerlark.operators import evaluate, history, labels, models
from ledgerlark.plans.feature_queries import TRADE_SQL
from ledgerlark.plans.label_queries import labeled
from ledgerlark.plans.tables import Book, rounded
from ledgerlark.sources.shared import written

book = Book()


def predicted():
    return F.col("prob") >= 0.5

SECTOR = "sec AS (SELECT concat('T', CAST(s_suppkey AS STRING)) AS ticker, n_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey), ss AS (SELECT s.*, coalesce(sector, 'Other') AS sector FROM scored s LEFT JOIN sec USING (ticker))"


def with_sector(tables) -> DataFrame:
    sectors = tables.supplier.join(F.broadcast(tables.nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("T"), "s_suppkey").alias("ticker"), F.col("n_name").alias("sector"))
    return evaluate.with_sector(tables.scored, sectors)


FUZZY = """fz AS (SELECT row_id, transaction_code, CASE WHEN month(transaction_date) IN (1, 4, 7, 10) THEN 1.0::DOUBLE WHEN month(transaction_date) IN (2, 5, 8, 11) THEN 0.5 ELSE 0 END AS ne,
      CASE WHEN shares + shares_owned_after > 0 THEN shares / (shares + shares_owned_after) ELSE 0 END AS pct, CASE WHEN has_10b5_1_plan OR contains(lower(coalesce(footnote_text, '')), '10b5-1') THEN 0.0::DOUBLE ELSE 1 END AS np,
      greatest(datediff('day', transaction_date, filing_date), 0) AS lag FROM trades),
    fs AS (SELECT row_id, transaction_code, 0.30::DOUBLE * ne + 0.25::DOUBLE * CASE WHEN pct >= 0.10::DOUBLE THEN 1 WHEN pct > 0.01::DOUBLE THEN (pct - 0.01::DOUBLE) / 0.09::DOUBLE ELSE 0 END + 0.25::DOUBLE * np + 0.10::DOUBLE * CASE WHEN lag > 5 THEN 1 WHEN lag > 1 THEN (lag - 1) / 4 ELSE 0 END AS s FROM fz)"""


def fuzzy(tables) -> DataFrame:
    return evaluate.memberships(t.add_text_features(t.add_trade_features(tables.trades)))


@book.add(f"{FUZZY} SELECT row_id, round(s, 6) AS fuzzy_score, CAST(round(s, 9) >= 0.5 AS INT) AS fuzzy_flag FROM fs")
def p31_p32_fuzzy_scores(tables):
    return rounded(fuzzy(tables).select("row_id", "fuzzy_score", "fuzzy_flag"), fuzzy_score=6)


@book.add(f"{FUZZY} SELECT transaction_code, round(CAST(avg(CAST(s AS DECIMAL(12,8))) AS DOUBLE), 5) AS mean_score, count(*) AS n FROM fs GROUP BY 1")
def a22_mean_score_by_code(tables):
    return evaluate.mean_scores(fuzzy(tables), "transaction_code")


@book.add(f"{FUZZY} SELECT final_label, round(CAST(avg(CAST(s AS DECIMAL(12,8))) AS DOUBLE), 5) AS mean_score, count(*) AS n FROM fs JOIN (SELECT row_id, final_label FROM scored) USING (row_id) GROUP BY 1")
def a22_mean_score_by_label(tables):
    return evaluate.mean_scores(fuzzy(tables).join(tables.scored.select("row_id", "final_label"), "row_id"), "final_label")


CONF = "count(*) FILTER (final_label = 1 AND p) AS tp, count(*) FILTER (final_label <> 1 AND p) AS fp, count(*) FILTER (final_label = 1 AND NOT p) AS fn, count(*) FILTER (final_label <> 1 AND NOT p) AS tn"
RATES = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"


@book.add(f"c AS (SELECT transaction_code, {CONF} FROM (SELECT *, prob >= 0.5 AS p FROM scored) GROUP BY 1) SELECT *, {RATES} FROM c")
def a23_p40_confusion(tables):
    return evaluate.confusion(tables.scored, predicted(), by=("transaction_code",))


STEPS = """st AS (SELECT prob AS threshold, count(*) FILTER (final_label = 1) AS p, count(*) FILTER (final_label <> 1) AS n FROM scored GROUP BY 1),
    cu AS (SELECT *, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(n) OVER (ORDER BY threshold DESC) AS fp, sum(p) OVER () AS pos FROM st)"""


@book.add(f"{STEPS} SELECT round(sum(p / pos * tp / (tp + fp)), 6) AS average_precision FROM cu")
def a24_average_precision(tables):
    return evaluate.average_precision(tables.scored)


@book.add(f"{STEPS} SELECT threshold, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall FROM cu")
def a25_pr_curve(tables):
    return evaluate.pr_curve(tables.scored)


@book.add("""g AS (SELECT unnest(range(5, 100, 5)) / 100 AS threshold), c AS (SELECT threshold, count(*) FILTER (final_label = 1 AND prob >= threshold) AS tp, count(*) FILTER (final_label <> 1 AND prob >= threshold) AS fp, count(*) FILTER (final_label = 1 AND NOT prob >= threshold) AS fn FROM scored, g GROUP BY 1)
    SELECT *, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c""")
def a26_threshold_sweep(tables):
    return evaluate.threshold_sweep(tables.scored, [k / 100 for k in range(5, 100, 5)])


@book.add("c AS (SELECT count(*) FILTER (final_label = 1) AS positives, count(*) FILTER (final_label = 0) AS negatives FROM scored) SELECT *, round(positives / (positives + negatives), 6) AS prior_1, round(negatives / positives, 6) AS scale_pos_weight FROM c")
def a27_class_weights(tables):
    return evaluate.class_weights(tables.scored)


@book.add("""c AS (SELECT final_label, unnest([{'f': 'month', 'v': month(transaction_date)::DOUBLE}, {'f': 'prob', 'v': prob}]) AS u FROM scored), s AS (SELECT u.f AS feature, avg(u.v) FILTER (final_label = 1) AS m1, avg(u.v) FILTER (final_label = 0) AS m0, var_samp(u.v) FILTER (final_label = 1) AS v1, var_samp(u.v) FILTER (final_label = 0) AS v0 FROM c GROUP BY 1)
    SELECT feature, round(m1, 4) AS mean_1, round(m0, 4) AS mean_0, round(abs(m1 - m0) / sqrt((v1 + v0) / 2), 4) AS separation FROM s""")
def a28_feature_separation(tables):
    return evaluate.separation(tables.scored.withColumn("month", F.month("transaction_date")), ("month", "prob"))


@book.add("SELECT round(quantile_cont(ln(1 + coalesce(total_value, 0)), 0.5), 6) AS median FROM trades WHERE year(transaction_date) <= 1999")
def a29_train_median(tables):
    return rounded(evaluate.median_of(t.add_trade_features(tables.trades.filter("year(transaction_date) <= 1999")), "log_total_value"), median=6)


@book.add("""c AS (SELECT *, final_label = 1 AS y, prob >= 0.5 AS a, month(transaction_date) IN (1, 4, 7, 10) AS b FROM scored)
    SELECT count(*) FILTER (y AND a AND b) AS "both", count(*) FILTER (y AND a AND NOT b) AS only_a, count(*) FILTER (y AND NOT a AND b) AS only_b, count(*) FILTER (y AND NOT a AND NOT b) AS neither,
      round(2 * count(*) FILTER (y AND a) / (count(*) FILTER (y) + count(*) FILTER (a)), 6) AS f1_a, round(2 * count(*) FILTER (y AND b) / (count(*) FILTER (y) + count(*) FILTER (b)), 6) AS f1_b,
      round(2 * count(*) FILTER (y AND (a OR b)) / (count(*) FILTER (y) + count(*) FILTER (a OR b)), 6) AS f1_either FROM c""")
def a31_p34_complementarity(tables):
    return evaluate.complementarity(tables.scored, predicted(), F.month("transaction_date").isin(1, 4, 7, 10))


WELCH = """{cte} w AS (SELECT {by}count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n0, avg(v) FILTER (f) AS m1, avg(v) FILTER (NOT f) AS m0, var_samp(v) FILTER (f) AS v1, var_samp(v) FILTER (NOT f) AS v0 FROM (SELECT *, month(transaction_date) AS v, prob >= 0.5 AS f FROM {src}) {group})
    SELECT {by}n1, n0, round(m1, 6) AS mean1, round(m0, 6) AS mean0, round(m1 - m0, 6) AS difference, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t,
      round(power(v1 / n1 + v0 / n0, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1)), 4) AS dof FROM w WHERE n1 >= {least} AND n0 >= {least}"""


@book.add(WELCH.format(cte="", by="", src="scored", group="", least=2))
def a32_welch_test(tables):
    return evaluate.welch(tables.scored.withColumn("v", F.month("transaction_date")), "v", predicted())


@book.add(WELCH.format(cte=SECTOR + ",", by="sector, ", src="ss", group="GROUP BY sector", least=10))
def a33_p29_welch_by_sector(tables):
    return evaluate.welch(with_sector(tables).withColumn("v", F.month("transaction_date")), "v", predicted(), by=("sector",), least=10)


@book.add(f"""{SECTOR}, te AS ({WELCH.format(cte="", by="sector, ", src="ss", group="GROUP BY sector", least=10).replace(" w AS", "WITH w AS", 1)}),
    g AS (SELECT *, least(pi() / 2, {evaluate.P_REACH} / sqrt(dof)) AS z, atan(abs(t) / sqrt(dof)) AS o FROM te),
    i AS (SELECT *, list_sum(list_transform(range(0, {evaluate.P_STEPS + 1}), lambda k: CASE WHEN k IN (0, {evaluate.P_STEPS}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp((dof - 1) * ln(greatest(cos(z * k / {evaluate.P_STEPS}), 1e-300))))) * z AS whole,
      list_sum(list_transform(range(0, {evaluate.P_STEPS + 1}), lambda k: CASE WHEN k IN (0, {evaluate.P_STEPS}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp((dof - 1) * ln(greatest(cos(o + (z - o) * k / {evaluate.P_STEPS}), 1e-300))))) * greatest(z - o, 0) AS tail FROM g),
    q AS (SELECT *, round(tail / whole, 6) AS p FROM i)
    SELECT sector, n1, n0, mean1, mean0, difference, t, dof, p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM q""")
def a33_welch_by_sector_with_p(tables):
    return evaluate.with_p(evaluate.welch(with_sector(tables).withColumn("v", F.month("transaction_date")), "v", predicted(), by=("sector",), least=10))


@book.add(f"""{SECTOR} SELECT sector, count(*) AS n, count(*) FILTER (prob >= 0.5) AS flagged, round(count(*) FILTER (prob >= 0.5) / count(*), 3) AS flag_rate, round(avg(prob), 3) AS mean_score,
    round(count(*) FILTER (final_label = 1) / count(*), 3) AS label_rate, count(DISTINCT ticker) AS tickers FROM ss GROUP BY 1""")
def a19_a34_sector_rates(tables):
    return evaluate.group_rates(with_sector(tables), "sector", predicted())


@book.add(f"""{SECTOR} SELECT sector, round(avg(CAST(prob >= 0.5 AS INT)) FILTER (year(transaction_date) = 1999), 3) AS "1999", round(avg(CAST(prob >= 0.5 AS INT)) FILTER (year(transaction_date) = 2000), 3) AS "2000" FROM ss GROUP BY 1""")
def a20_sector_year_pivot(tables):
    return evaluate.flag_pivot(with_sector(tables), "sector", F.year("transaction_date"), (1999, 2000), predicted())


@book.add("SELECT ticker, count(*) FILTER (prob < 0.5) AS unflagged, count(*) FILTER (prob >= 0.5) AS flagged FROM scored GROUP BY 1")
def a21_ticker_flag_counts(tables):
    counts = tables.scored.withColumn("f", predicted().cast("int")).groupBy("ticker").pivot("f", [0, 1]).count()
    return counts.na.fill(0).select("ticker", F.col("0").alias("unflagged"), F.col("1").alias("flagged"))


@book.add("SELECT final_label, CAST(least(floor(prob * 10) + 1, 11) AS BIGINT) AS bin, count(*) AS n FROM scored GROUP BY 1, 2")
def a35_score_histogram(tables):
    return evaluate.histogram(tables.scored, "prob", ("final_label",), 0, 1, 10)


@book.add("SELECT final_label, min(prob) AS low, round(quantile_cont(prob, 0.25), 6) AS q25, round(quantile_cont(prob, 0.5), 6) AS median, round(quantile_cont(prob, 0.75), 6) AS q75, max(prob) AS high FROM scored GROUP BY 1")
def a35_five_numbers(tables):
    return evaluate.five_numbers(tables.scored, "prob", ("final_label",))


@book.add("SELECT row_id, CASE WHEN year(transaction_date) <= 1998 THEN 'train' WHEN year(transaction_date) = 1999 THEN 'val' ELSE 'test' END AS dataset_split FROM scored WHERE year(transaction_date) <= 2000")
def p26_p35_time_split(tables):
    return evaluate.time_split(tables.scored, train_to=1998, test=2000).select("row_id", "dataset_split")


@book.add("e AS (SELECT min(prob) AS lo, max(prob) AS hi FROM scored WHERE year(transaction_date) <= 1998 AND prob BETWEEN 0.2 AND 0.7) SELECT row_id, round(least(greatest((prob - lo) / (hi - lo), 0), 1), 6) AS prob_scaled FROM scored, e")
def p41_min_max(tables):
    own = tables.scored
    return rounded(evaluate.min_max(own, own.filter("year(transaction_date) <= 1998 and prob between 0.2 and 0.7"), "prob").select("row_id", "prob_scaled"), prob_scaled=6)


@book.add("""m AS (SELECT avg(shares) AS a, stddev_pop(shares) AS b, avg(shares_owned_after) AS c, stddev_pop(shares_owned_after) AS d FROM trades WHERE year(transaction_date) <= 1998)
    SELECT row_id, round((shares - a) / b, 6) AS shares, round((shares_owned_after - c) / d, 6) AS shares_owned_after FROM trades, m""")
def m01_p25_standard_scale(tables):
    own = models.numeric(tables.trades, ("shares", "shares_owned_after"), "row_id", "transaction_date")
    return rounded(models.standard_scale(own, own.filter("year(transaction_date) <= 1998"), ("shares", "shares_owned_after")).select("row_id", "shares", "shares_owned_after"), shares=6, shares_owned_after=6)


NB_FEATURES = ("month", "code")


@book.add("""x AS (SELECT *, CAST(month(transaction_date) AS DOUBLE) AS a, CAST(row_id % 97 + final_label * 7 AS DOUBLE) AS b FROM scored), tr AS (SELECT * FROM x WHERE year(transaction_date) <= 1998),
    f AS (SELECT ln(count(*) FILTER (final_label = 1) / count(*)) AS p1, ln(count(*) FILTER (final_label = 0) / count(*)) AS p0, 1e-9 * greatest(var_pop(a), var_pop(b)) AS e,
      avg(a) FILTER (final_label = 1) AS a1, avg(a) FILTER (final_label = 0) AS a0, avg(b) FILTER (final_label = 1) AS b1, avg(b) FILTER (final_label = 0) AS b0,
      var_pop(a) FILTER (final_label = 1) AS va1, var_pop(a) FILTER (final_label = 0) AS va0, var_pop(b) FILTER (final_label = 1) AS vb1, var_pop(b) FILTER (final_label = 0) AS vb0 FROM tr),
    l AS (SELECT row_id, p1 - 0.5 * ln(2 * pi() * (va1 + e)) - power(a - a1, 2) / (2 * (va1 + e)) - 0.5 * ln(2 * pi() * (vb1 + e)) - power(b - b1, 2) / (2 * (vb1 + e))
      - (p0 - 0.5 * ln(2 * pi() * (va0 + e)) - power(a - a0, 2) / (2 * (va0 + e)) - 0.5 * ln(2 * pi() * (vb0 + e)) - power(b - b0, 2) / (2 * (vb0 + e))) AS o FROM x, f)
    SELECT row_id, round(1 / (1 + exp(-o)), 6) AS prob FROM l""")
def m03_naive_bayes(tables):
    own = tables.scored.withColumns({"month": F.month("transaction_date").cast("double"), "code": (F.col("row_id") % 97 + F.col("final_label") * 7).cast("double")})
    return rounded(models.naive_bayes(own.filter("year(transaction_date) <= 1998"), own, NB_FEATURES).select("row_id", "prob"), prob=6)


BASKET = f"""bf AS (SELECT s.final_label, t.*, {TRADE_SQL['pct_position_traded']} AS pct, {TRADE_SQL['days_to_filing']} AS lag, ln(1 + coalesce(total_value, 0)) AS lv, CASE WHEN t.transaction_code = 'S' THEN -1 ELSE 0 END AS dd
      FROM trades t JOIN (SELECT row_id AS rid, final_label FROM scored) s ON t.row_id = s.rid),
    md AS (SELECT quantile_cont(lv, 0.5) AS m FROM bf), bk AS (SELECT row_id, final_label, list_filter([CASE WHEN pct > 0.05 THEN 'large_trade' END, CASE WHEN month(transaction_date) IN (1, 4, 7, 10) THEN 'near_earnings' END, CASE WHEN dd = -1 THEN 'sell_transaction' END,
      CASE WHEN insider_role IN ('CEO', 'CFO', 'COO') OR contains(lower(coalesce(officer_title, '')), 'president') THEN 'senior_insider' END, CASE WHEN lv > m THEN 'large_dollar' END, CASE WHEN lag > 2 THEN 'late_filing' END, CASE WHEN final_label = 1 THEN 'opportunistic' END], lambda z: z IS NOT NULL) AS items FROM bf, md)"""


BASKET_COLUMNS = ("row_id", "final_label", "pct_position_traded", "txn_month", "trade_direction", "role_seniority", "log_total_value", "days_to_filing")


def basket_table(tables) -> DataFrame:
    """The baskets of labelled trades; the trades are joined and written once, for their median, the rules and the scores."""
    own = t.add_role_features(t.add_trade_features(tables.trades)).join(tables.scored.select("row_id", "final_label"), "row_id")
    own = written(own.select(*BASKET_COLUMNS), "baskets")
    return evaluate.baskets(own, evaluate.median_of(own, "log_total_value"))


@book.add(f"{BASKET} SELECT row_id, array_to_string(items, ',') AS items FROM bk")
def p33_baskets(tables):
    return basket_table(tables).select("row_id", F.array_join("items", ",").alias("items"))


ITEMS = ("large_trade", "near_earnings", "sell_transaction", "senior_insider", "large_dollar", "late_filing")


MASK = " + ".join(f"CASE WHEN list_contains(items, '{x}') THEN {1 << k} ELSE 0 END" for k, x in enumerate(ITEMS))


def rule_sql() -> str:
    pick = "it AS (SELECT * FROM (VALUES " + ", ".join(f"('{x}', {1 << k})" for k, x in enumerate(ITEMS)) + ") v(item, bit))"
    named = ", ".join(f"CASE WHEN mask & {1 << k} > 0 THEN '{x}' END" for k, x in enumerate(ITEMS))
    return f"""{BASKET}, {pick}, mk AS (SELECT {MASK} AS have, list_contains(items, 'opportunistic') AS y, count(*) AS n FROM bk GROUP BY 1, 2),
    an AS (SELECT unnest(range(1, {1 << len(ITEMS)})) AS mask), tt AS (SELECT sum(n) AS n, sum(n) FILTER (y) AS p FROM mk),
    ru AS (SELECT mask, sum(mk.n) AS a, coalesce(sum(mk.n) FILTER (y), 0) AS c FROM an JOIN mk ON have & mask = mask GROUP BY 1)
    SELECT array_to_string(list_sort(list_filter([{named}], lambda z: z IS NOT NULL)), ',') AS antecedent, round(c / a, 6) AS confidence, round(c / a / (p / n), 6) AS lift, round(c / n, 6) AS support FROM ru, tt WHERE c / n >= 0.03 AND c / a >= 0.4"""


@book.add(rule_sql())
def m08_association_rules(tables):
    rules = models.association_rules(basket_table(tables), confidence=0.4)
    return rules.select(F.array_join("antecedent", ",").alias("antecedent"), *[F.round(c, 6).alias(c) for c in ("confidence", "lift", "support")])


@book.add(f"""{rule_sql().rsplit('SELECT array_to_string', 1)[0].rstrip()}, good AS (SELECT mask, c / a AS confidence FROM ru, tt WHERE c / n >= 0.03 AND c / a >= 0.4),
    hv AS (SELECT row_id, final_label, {MASK} AS have FROM bk)
    SELECT row_id, any_value(final_label) AS final_label, round(coalesce(max(confidence), 0), 6) AS prob FROM hv LEFT JOIN good ON have & mask = mask GROUP BY 1""")
def m09_rule_scores(tables):
    own = basket_table(tables)
    return models.rule_scores(own, models.association_rules(own, confidence=0.4)).withColumn("prob", F.round("prob", 6))


@book.add("""SELECT insider_cik, round(avg(prob) + 1e-7, 5) AS mean_score, round(avg(month(transaction_date)) + 1e-7, 5) AS mean_month, round(count(*) FILTER (final_label = 1) / count(*), 6) AS informed_rate FROM scored GROUP BY 1""")
def a17_j18_insider_profiles(tables):
    out = evaluate.insider_profiles(tables.scored.withColumn("month", F.month("transaction_date")), ("prob", "month"))
    return out.select("insider_cik", F.round(F.col("prob") + 1e-7, 5).alias("mean_score"), F.round(F.col("month") + 1e-7, 5).alias("mean_month"), F.round("informed_rate", 6).alias("informed_rate"))


PROFILE = ("shares", "total_value", "pct_position_traded", "days_to_filing")


def model_table(tables) -> DataFrame:
    """Open-market trades with all features that don't leak the label, and the synthetic label, one row a trade."""
    kept = ("row_id", "insider_cik", "transaction_date", "final_label")
    own = history.model_matrix(tables.labelled, MODEL_FEATURES, *kept, wanted="final_label is not null")
    return written(models.numeric(own, MODEL_FEATURES, *kept), "model_table")


MODEL_FEATURES = history.MODEL_FEATURES


def splits(tables):
    own = model_table(tables)
    year = F.year("transaction_date")
    return own.filter(year <= 1998), own.filter(year == 1999), own.filter(year >= 2000)


@book.add()
def m02_m13_boosted_trees(tables):
    train, val, test = splits(tables)
    model = models.fit_boosted(train, val, MODEL_FEATURES)
    return models.score(model, test, MODEL_FEATURES).select("row_id", "final_label", "prob", "flag")


@book.add()
def m02_grid_search(tables):
    train, val, _ = splits(tables)
    return models.grid_search(train, val, MODEL_FEATURES)[1]


@book.add()
def m04_isolation_forest(tables):
    train, _, test = splits(tables)
    return models.isolation_scores(test, models.isolation_trees(train, MODEL_FEATURES), MODEL_FEATURES)


def anomalies(tables) -> list[DataFrame]:
    """The scores of the training, validation and test rows by one forest, each written once."""
    parts = splits(tables)
    forest = written(models.isolation_trees(parts[0], MODEL_FEATURES), "forest")
    return [written(models.isolation_scores(x, forest, MODEL_FEATURES), "anomalies") for x in parts]


@book.add()
def m04_p41_scaled_scores(tables):
    train, _, test = anomalies(tables)
    return models.scaled_anomalies(test, train)


@book.add()
def m04_contamination_grid(tables):
    train, val, _ = anomalies(tables)
    return models.contamination_grid(train, val)


@book.add()
def m05_surrogate_importance(tables):
    train, _, test = splits(tables)
    scored = models.isolation_scores(test, models.isolation_trees(train, MODEL_FEATURES), MODEL_FEATURES, keep=("row_id", "final_label", *MODEL_FEATURES))
    return models.surrogate_importance(scored, MODEL_FEATURES)


def profiles(tables) -> DataFrame:
    return written(evaluate.insider_profiles(model_table(tables), MODEL_FEATURES), "profiles")


@book.add()
def m06_a18_j14_clusters(tables):
    own = model_table(tables)
    clustered, _ = models.clustered_profiles(written(evaluate.insider_profiles(own, MODEL_FEATURES), "profiles"), MODEL_FEATURES)
    return models.map_back(own, clustered, models.cluster_rates(clustered)).select("row_id", "insider_cik", "cluster", "prob")


@book.add()
def m07_principal_components(tables):
    return models.principal_components(profiles(tables).na.fill(0.0), MODEL_FEATURES).select("insider_cik", "pc1", "pc2")


@book.add()
def m10_ablation(tables):
    return models.ablation(*splits(tables), history.FEATURE_GROUPS, MODEL_FEATURES)


@book.add()
def m11_walk_forward(tables):
    return models.walk_forward(model_table(tables), MODEL_FEATURES, (1996, 1997, 1998))


@book.add()
def m12_permutation_importance(tables):
    train, val, test = splits(tables)
    return models.permutation_importance(models.fit_boosted(train, val, MODEL_FEATURES), test, MODEL_FEATURES)


@book.add()
def c07_labels_to_metrics(tables):
    """Features, labels, split and closed-form scores of the trades themselves, with their metrics."""
    own = labeled(tables).select("row_id", "final_label", "transaction_code")
    rows = history.recency_and_streak(t.add_role_features(t.add_trade_features(tables.trades))).drop("transaction_code").join(own, "row_id")
    ready = models.numeric(evaluate.model_rows(rows), PROFILE, "row_id", "transaction_date", "final_label")
    scored = models.naive_bayes(ready.filter("year(transaction_date) <= 1998"), ready.filter("year(transaction_date) >= 2000"), PROFILE)
    return evaluate.average_precision(scored).crossJoin(evaluate.confusion(scored, predicted()))  # one row each
