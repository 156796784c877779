"""Small rows that pin the quirks of the feature and label operators."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import trade as t
from ledgerlark.operators import asof, history, labels
from ledgerlark.sources import market
from ledgerlark.sources.driver_tables import domain

D = dt.date(2020, 1, 1)


def day(n):
    return D + dt.timedelta(days=n)


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])


def test_direction_sets_disagree_on_purchases(spark):
    df = spark.createDataFrame([("P",), ("A",), ("M",), ("S",), ("F",), ("G",)], "c string")
    got = [(r.a, r.b) for r in df.select(t.direction(F.col("c")).alias("a"), t.direction(F.col("c"), t.LABEL_BUY, t.LABEL_SELL).alias("b")).collect()]
    assert got == [(0, 1), (1, 1), (1, 1), (-1, -1), (-1, -1), (0, 0)]


@pytest.mark.parametrize("value, name", [(None, "tiny"), (0.0, "tiny"), (1e5, "tiny"), (1e5 + 1, "small"), (2e6, "medium"), (2e6 + 1, "large"), (1e8, "mega"), (-1.0, "nan")])
def test_value_buckets_are_right_closed(spark, value, name):
    row = spark.createDataFrame([(value,)], "v double").select(t.value_bucket(F.col("v")).alias("b")).withColumn("n", t.value_bucket_number(F.col("b"))).first()
    assert row.b == name and row.n == {"nan": 0, "tiny": 1, "small": 2, "medium": 3, "large": 4, "mega": 5}[name]


def test_vice_president_counts_as_president(spark):
    df = spark.createDataFrame([("Officer", "Senior Vice President"), ("Officer", "VP"), ("Director", None), ("x", "General Counsel"), ("CEO", "x")], "r string, title string")
    assert [r[0] for r in df.select(t.seniority(F.col("r"), F.col("title"))).collect()] == [4, 2, 1, 3, 6]


def test_days_to_filing(spark):
    df = spark.createDataFrame([(day(5), day(1)), (day(1), day(5)), (None, day(1))], "f date, d date")
    assert [r[0] for r in df.select(t.days_to_filing(F.col("f"), F.col("d"))).collect()] == [4, 0, None]


def test_short_footnotes_are_neutral(spark):
    df = spark.createDataFrame([("rsu",), (None,), ("RSU withholding on open market",), ("nothing of note here",)], "footnote_text string")
    got = t.add_text_features(df).select("footnote_routine_hits", "footnote_informed_hits", "footnote_routine_score", "footnote_length", "has_plan").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0.5, 3, 0), (0, 0, 0.5, 0, 0), (2, 1, 2 / 3, 30, 0), (0, 0, 0.5, 20, 0)]


def test_lenient_parsing(spark):
    df = spark.createDataFrame([("2020-01-02", "$1,234.5"), ("01/02/2020", " 7 "), ("20200102", "x"), ("no", None)], "d string, n string")
    got = df.select(t.lenient_date(F.col("d")), t.lenient_double(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(dt.date(2020, 1, 2), 1234.5), (dt.date(2020, 1, 2), 7.0), (dt.date(2020, 1, 2), None), (None, None)]


def trades(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, insider_cik string, ticker string, transaction_date date, trade_direction int, is_open_market boolean, total_value double")
    return df.withColumn("signed_value", F.col("total_value") * F.col("trade_direction"))


def test_trailing_windows_leave_out_the_day_and_count_twice(spark):
    rows = [(1, "a", "T", day(0), 1, True, 5.0), (2, "a", "T", day(0), -1, True, 7.0), (3, "a", "T", day(7), 1, True, 1.0), (4, "a", "T", day(8), 1, True, 1.0), (5, None, "T", day(8), 1, True, 1.0)]
    got = {r.row_id: (r.trades_7d, r.buy_count_7d, r.sell_count_7d, r.net_value_7d) for r in history.trailing_windows(trades(spark, rows)).collect()}
    assert got == {1: (0, 0, 0, 0.0), 2: (0, 0, 0, 0.0), 3: (4, 1, 1, -2.0), 4: (2, 1, 0, 1.0)}


def test_history_counts_earlier_rows_of_the_day(spark):
    rows = [(1, "a", "T", day(0), 1, True, 4.0), (2, "a", "T", day(0), -1, True, None), (3, "a", "T", day(3), 0, False, -1.0)]
    got = {r.row_id: (r.insider_total_trades, r.insider_avg_trade_value, r.insider_buy_sell_ratio, r.insider_tenure_days) for r in history.expanding_history(trades(spark, rows)).collect()}
    assert got == {1: (0, 0.0, 0.5, 0), 2: (1, 4.0, 1.0, 0), 3: (2, 4.0, 0.5, 3)}


def test_streaks(spark):
    dirs = [1, 1, 0, 0, 1, -1, -1, -1]
    rows = [(k, "a", "T", day(k), d, True, 1.0) for k, d in enumerate(dirs)]
    got = {r.row_id: r.consecutive_direction for r in history.recency_and_streak(trades(spark, rows)).collect()}
    assert [got[k] for k in range(8)] == [1, 2, 1, 1, 1, 1, 2, 3]


def test_window_form_equals_join_form(spark, data):
    own = t.add_direction(domain(spark, data, "trades"), t.LABEL_BUY, t.LABEL_SELL)
    cols = ("row_id", "other_insiders_72h", "same_dir_insiders_72h", "opp_dir_insiders_72h")
    a = sorted(tuple(r) for r in history.nearby_insiders(own).select(*cols).collect())
    assert a == sorted(tuple(r) for r in history.nearby_insiders_by_join(own).select(*cols).collect())


def test_as_of_looks_no_further_back_than_the_first_trade(spark):
    own = spark.createDataFrame([(1, "T", day(5)), (2, "T", day(9))], "row_id long, ticker string, transaction_date date")
    prices = spark.createDataFrame([("T", day(4), 1.0), ("T", day(7), 2.0), ("U", day(5), 9.0)], "ticker string, date date, close double")
    assert {r.row_id: r.close_price_on_txn_date for r in asof.close_on_date(own, prices).collect()} == {1: None, 2: 2.0}
    got = {r.row_id: (r.txn_close, r.future_close) for r in asof.close_on_trade(own, prices, horizon=1).collect()}
    assert got == {1: (1.0, 2.0), 2: (2.0, None)}


def test_series_join(spark):
    own = spark.createDataFrame([(k, day(k)) for k in range(6)], "row_id long, transaction_date date")
    series = spark.createDataFrame([(day(1), 1.0), (day(3), 3.0)], "date date, close double")
    back = asof.as_of(own, "transaction_date", series, None, "date", "close", "v")
    ahead = asof.as_of(own, "transaction_date", series, None, "date", "close", "v", forward=True)
    assert [r.v for r in back.orderBy("row_id").collect()] == [None, 1.0, 1.0, 3.0, 3.0, 3.0]
    assert [r.v for r in ahead.orderBy("row_id").collect()] == [1.0, 1.0, 3.0, 3.0, None, None]


def test_routine_needs_both_years_before(spark):
    rows = [(k, w, dt.date(y, 3, 1)) for k, (w, y) in enumerate([("a", 2018), ("a", 2019), ("a", 2020), ("a", 2022), (None, 2018), (None, 2019), (None, 2020)])]
    df = spark.createDataFrame(rows, "row_id long, insider_cik string, transaction_date date")
    assert {r.row_id for r in labels.routine_trades(df).collect() if r.is_routine} == {2, 6}


def test_focus_finds_a_ticker_among_thousands(spark):
    rows = spark.range(5000).select(F.format_string("T%04d", "id").alias("ticker"))
    for wanted in ("T0000", "T2500", "T4999"):
        assert [r.ticker for r in labels.focus(rows, f"/x/{wanted}_form4.csv").collect()] == [wanted]
    assert labels.focus(rows, "/x/other.csv").count() == 5000
    assert labels.focus(rows.limit(0), "/x/T0001.csv").count() == 0


def test_long_aliases_are_matched(spark):
    items = spark.createDataFrame([(1, "shares of the very long name holding company group fell")], "item_id long, text string")
    tickers = spark.createDataFrame([("VLN",)], "ticker string")
    aliases = spark.createDataFrame([("VLN", "very long name holding company group")], "ticker string, alias string")
    assert [(r.item_id, r.ticker) for r in market.match_tickers(items, aliases, tickers).collect()] == [(1, "VLN")]
    with pytest.raises(ValueError):
        market.match_tickers(items, aliases, tickers, most_words=5)


def test_series_are_looked_up_together(spark):
    """Several series, dates and directions in one pass, over years, with keys and days that have nothing, against a plain loop."""
    import datetime as dt
    import random

    from ledgerlark.operators import asof

    rng = random.Random(2)
    day = lambda: dt.date(2015, 1, 1) + dt.timedelta(days=rng.randrange(2500))
    keys = ["a", "b", "c", None]
    marks = {name: [(rng.choice(keys), day() if rng.random() > 0.05 else None, float(k) if rng.random() > 0.1 else None) for k in range(25)] for name in ("p", "q")}
    marks = {n: list({(m[0], m[1]): m for m in rows}.values()) for n, rows in marks.items()}
    asked = [(k, rng.choice([*keys, "d"]), day() if rng.random() > 0.05 else None) for k in range(120)] + [(0, "a", dt.date(2016, 1, 1))] * 3
    left = spark.createDataFrame(asked, "row_id long, key string, on date")
    df = {n: spark.createDataFrame(rows, "key string, day date, v double") for n, rows in marks.items()}
    series = [asof.Series(f"{n}{'f' if f else 'b'}{a}", df[n], "day", "v", f, a) for n in df for f in (False, True) for a in (0, 40)]
    got = sorted(map(tuple, asof.with_series(left, "key", "on", series).collect()), key=str)

    def answer(n, f, a, key, on):
        if key is None or on is None:
            return None
        at = on + dt.timedelta(days=a)
        known = [(d, v) for k, d, v in marks[n] if k == key and d is not None and v is not None and (d >= at if f else d <= at)]
        return (min if f else max)(known, default=(None, None), key=lambda x: x[0])[1]

    assert got == sorted(((*r, *(answer(n, f, a, *r[1:]) for n in df for f in (False, True) for a in (0, 40))) for r in asked), key=str)


def test_days_are_filled_between_prices(spark):
    import datetime as dt

    from ledgerlark.operators import asof

    d = lambda k: dt.date(2019, 12, 1) + dt.timedelta(days=k)
    prices = {"a": {0: None, 3: 1.0, 40: 2.0, 45: None, 800: 3.0, 803: None}, "b": {7: 5.0}, "c": {1: None, 4: None}}
    rows = [(t, d(k), v) for t, own in prices.items() for k, v in own.items()]
    got = {(r.ticker, r.date): (r.ffill, r.bfill) for r in asof.daily_fill(spark.createDataFrame(rows, "ticker string, date date, close double")).collect()}
    want = {}
    for t, own in prices.items():
        known = sorted((k, v) for k, v in own.items() if v is not None)
        for k in range(min(own), max(own) + 1):
            want[t, d(k)] = (next((v for j, v in reversed(known) if j <= k), None), next((v for j, v in known if j >= k), None))
    assert got == want


def test_history_over_stretches(spark):
    """Streaks, recency and expanding history over many years, with runs that go on through whole stretches, against a plain loop."""
    import datetime as dt
    import random

    from ledgerlark.operators import history

    rng = random.Random(4)
    rows = []
    for who in ("a", "b", "c", None):
        direction = 1
        for _ in range(150):
            if rng.random() < 0.1:
                direction = rng.choice([-1, 0, 1])
            date = None if rng.random() < 0.03 else dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(6000) if who != "c" else rng.randrange(5) * 500)
            rows.append([who, date, 0, rng.choice([None, -1.0, 0.0, 2.0, 8.0]), rng.choice([True, False, None])])
    rows.sort(key=lambda r: (str(r[0]), r[1] is not None, r[1] or dt.date(1900, 1, 1)))
    direction = 1
    for r in rows:  # long runs in the order of dates
        direction = rng.choice([-1, 0, 1]) if rng.random() < 0.05 else direction
        r[2] = direction
    made = [(k, *r) for k, r in enumerate(rows)]
    df = spark.createDataFrame(made, "row_id long, insider_cik string, transaction_date date, trade_direction int, total_value double, is_open_market boolean").repartition(5)
    got = {r.row_id: r for r in history.recency_and_streak(history.expanding_history(df)).collect()}
    past, longest = {}, 0
    for k, who, date, d, value, om in sorted(made, key=lambda r: (r[2] is not None, r[2] or dt.date(1900, 1, 1), r[0])):
        if who is None:
            assert k not in got
            continue
        before = past.setdefault(who, [])
        r, values = got[k], [v for *_, v, _ in before if v is not None and v > 0]
        streak = 1
        if d != 0:
            for _, _, other, _, _ in reversed(before):
                if other != d:
                    break
                streak += 1
        longest = max(longest, streak)
        last = before[-1][1] if before else None
        want = (len(before), sum(values) / len(values) if values else 0.0, sum(o == 1 and bool(m) for _, _, o, _, m in before), sum(o == -1 and bool(m) for _, _, o, _, m in before), streak, (date - last).days if date and last else 0)
        assert (r.insider_total_trades, pytest.approx(r.insider_avg_trade_value), r.insider_buy_count, r.insider_sell_count, r.consecutive_direction, r.days_since_last_trade) == want, (k, who)
        before.append((k, date, d, value, om))
    assert longest > 30


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_features_of_the_past_exchange_whole_rows_twice(spark):
    rows = [(n, f"i{n % 3}", f"t{n % 2}", day(n * 7 % 400), 1 - n % 3, n % 4 > 0, 10.0 * n) for n in range(200)] + [(900, "i0", None, day(3), 1, True, 5.0), (901, "i1", "t1", None, -1, True, 7.0)]
    own = trades(spark, rows)
    assert exchanges(history.nearby_insiders(own)) == 1
    assert exchanges(history.trailing_windows(own)) == 1
    assert exchanges(history.with_history(own)) <= 5
    near = {r.row_id: r.other_insiders_72h for r in history.nearby_insiders(own).collect()}
    assert {k: v for k, v in near.items() if k != 901} == {r.row_id: r.other_insiders_72h for r in history.nearby_insiders_by_join(own).collect()} and near[901] == 0
    past = {r.row_id: r for r in history.with_history(own).collect()}
    alone = {r.row_id: r for r in history.recency_and_streak(own).collect()}
    assert set(past) == set(range(200))
    assert all((past[k].days_since_last_trade, past[k].consecutive_direction) == (alone[k].days_since_last_trade, alone[k].consecutive_direction) for k in past)


def carried(df):
    """Columns of the rows that each exchange by hash takes."""
    found = re.findall(r"Exchange hashpartitioning\((.*?)\).*?\n[^\n]*?Project \[(.*?)\]\n", df._jdf.queryExecution().executedPlan().toString())
    return [columns for _, columns in found]


def test_exchanges_carry_no_summands(spark):
    rows = [(n, f"i{n % 3}", f"t{n % 2}", day(n * 7 % 400), 1 - n % 3, n % 4 > 0, 10.0 * n) for n in range(50)]
    own = trades(spark, rows)
    for df in (history.nearby_insiders(own), history.trailing_windows(own)):
        assert carried(df) and not any("_w" in columns for columns in carried(df))


def test_model_matrix_is_the_feature_matrix_of_the_wanted_rows(spark, data):
    from ledgerlark.plans.tables import Tables

    own = Tables(spark, data).labelled
    columns = ["row_id", "final_label", *history.MODEL_FEATURES]
    told = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())
    made = history.model_matrix(own, history.MODEL_FEATURES, "row_id", "final_label", wanted="final_label is not null")
    got = told(made)
    assert got == told(history.feature_matrix(own).filter("final_label is not null")) and 0 < len(got) < own.count()
    assert not any("footnote_text" in columns for columns in carried(made)[-2:])


def test_tickers_of_a_shared_alias_are_opened_where_their_text_is(spark):
    tickers = spark.range(3000).select(F.concat(F.lit("TK"), "id").alias("ticker"))
    aliases = tickers.select("ticker", F.lit("acme corp").alias("alias")).unionByName(tickers.select("ticker", F.lower("ticker").alias("alias")))
    items = spark.createDataFrame([(1, "Acme Corp and TK7"), (2, "nothing"), (3, None)], "item_id long, text string")
    found = market.match_tickers(items, aliases, tickers)
    got = {(r.item_id, r.ticker): r.matched_by for r in found.collect()}
    assert len(got) == 3000 and got[1, "TK7"] == "ticker:TK7" and got[1, "TK8"] == "alias:acme corp"
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(item_id#\w+, ticker#", plan)


def test_reports_and_cleaning_exchange_rows_once(spark):
    from ledgerlark.operators import profile

    nan = float("nan")
    made = [(f"t{n % 30}", "P" if n % 2 else "S", 1.0 + n % 20, 2.0, nan, None, -0.0 if n % 2 else 0.0, f"only{n}", "one" if n % 3 else None) for n in range(60)]
    own = spark.createDataFrame(made * 2, "ticker string, transaction_code string, shares double, price_per_share double, odd double, none string, zero double, single string, partly string")
    report = profile.quality_report(own, day(0))
    assert max(len(re.findall(r"\[", x)) for x in re.findall(r"Expand \[(.*?)\], \[", report._jdf.queryExecution().optimizedPlan().toString())) <= sum(k == "string" for _, k in own.dtypes) + 1
    assert "SortAggregate" not in report._jdf.queryExecution().executedPlan().toString()
    row, exact = report.first(), {r.name: r.distinct_values for r in profile.column_profile(own).collect()}
    assert row.constant == sorted(c for c, n in exact.items() if n == 1) == ["odd", "partly", "price_per_share", "zero"]
    assert row.high_cardinality == [] and profile.quality_report(own.dropDuplicates(), day(0)).first().high_cardinality == ["single"]
    assert profile.drop_constant(own).columns == ["ticker", "transaction_code", "shares", "none", "single"]
    cleaned = profile.clean(own)
    assert cleaned.count() == 60 and "Aggregate" not in cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert {r.shares for r in cleaned.collect()} == {1.0 + n for n in range(20)}


def test_baskets_join_their_trades_once(spark, data):
    from ledgerlark.plans import score_queries
    from ledgerlark.plans.tables import Tables

    plan = score_queries.basket_table(Tables(spark, data))._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan


def test_labels_read_each_series_once(spark, data):
    """Trades are joined with their orders once, and days of the benchmark are not exchanged with rows."""
    from ledgerlark.plans import label_queries
    from ledgerlark.plans.tables import Tables

    made = label_queries.labeled(Tables(spark, data))._jdf.queryExecution()
    assert "lineitem" not in made.optimizedPlan().toString() and "l_orderkey" not in made.optimizedPlan().toString()
    assert "hashpartitioning(_day" not in made.executedPlan().toString()


def test_only_long_histories_are_told_by_stretches(spark, data, monkeypatch):
    """The joined trades are exchanged whole once by ticker and once by insider, in as many tasks as their number asks for."""
    own = domain(spark, data, "trades").withColumn("trade_direction", F.pmod("row_id", F.lit(3)).cast("int") - 1).withColumn("signed_value", F.floor("total_value") * F.col("trade_direction"))
    own = own.withColumn("total_value", F.floor("total_value").cast("double")).withColumn("transaction_date", F.when(F.col("row_id") % 50 > 0, F.col("transaction_date"))).coalesce(1).cache()
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    short = history.with_history(own)
    assert len(re.findall(r"RepartitionByExpression", plan(short))) == 2 and "LeftOuter" not in plan(short)
    want = sorted(map(str, short.collect()))
    monkeypatch.setattr(history, "LONG_HISTORY", 60)
    assert 0 < len(history._long_histories(own)[1]) < own.select("insider_cik").distinct().count()
    monkeypatch.setattr(history, "TASK_ROWS", own.count() / 9)
    mixed = history.with_history(own)
    assert "LeftOuter" in plan(mixed) and sorted(map(str, mixed.select(*short.columns).collect())) == want
    assert re.findall(r"hashpartitioning\(insider_cik#\d+, _s#\d+L?, (\d+)\)", mixed._jdf.queryExecution().executedPlan().toString())[0] == "9"


def test_joined_trades_take_partitions_by_input(spark, data, monkeypatch):
    """the session's number of partitions is fixed, so a task's memory would grow with the input."""
    from ledgerlark.sources import driver_tables

    few = domain(spark, data, "trades")
    monkeypatch.setattr(driver_tables, "JOINED_BYTES", driver_tables.size_of(spark, f"{data}/lineitem.parquet") / 9)
    many = domain(spark, data, "trades")
    assert sorted(set(re.findall(r"hashpartitioning\([lo]_orderkey#\d+L, (\d+)\)", many._jdf.queryExecution().executedPlan().toString()))) == ["9"]
    assert few.count() == many.count() and few.exceptAll(many).isEmpty()


@pytest.mark.parametrize("few", [0, 3, 64])
def test_ticker_answers_are_made_where_an_alias_meets_its_tickers(spark, monkeypatch, few):
    """against plain Python, for texts of few and many mentions and with aliases of many lists; the answers of few are not exchanged."""
    monkeypatch.setattr(market, "FEW", few)
    monkeypatch.setattr(market, "TICKERS_A_LIST", 4)
    monkeypatch.setattr(market, "MADE_ROWS", 10)
    rng = random.Random(5)
    tickers = [f"K{k:02d}" for k in range(30)]
    words = [f"w{k}" for k in range(12)]
    pairs = {(rng.choice(tickers), " ".join(rng.sample(words, rng.choice((1, 2))))) for _ in range(150)}
    texts = [" ".join(rng.choice(words + ["x", "K03", "k05", "x_K07", "K99"]) for _ in range(rng.choice((0, 1, 3, 8, 20)))) for _ in range(60)]
    own = market.alias_table(spark.createDataFrame(list(pairs), "ticker string, alias string"), spark.createDataFrame([(x,) for x in tickers], "ticker string"))
    table = {(r.ticker, r.alias) for r in own.collect()}
    want = {}
    for k, text in enumerate(texts):
        for ticker, alias in sorted(table, key=lambda p: p[1], reverse=True):
            if f" {alias} " in f" {' '.join(''.join(c if c.isalnum() else ' ' for c in text.lower()).split())} ":
                want[k, ticker] = f"alias:{alias}"
        want |= {(k, x): f"ticker:{x}" for x in tickers if x in text.upper().split()}
    found = market.match_tickers(spark.createDataFrame(list(enumerate(texts)), "item_id long, text string"), own, spark.createDataFrame([(x,) for x in tickers], "ticker string"))
    got = [(r.item_id, r.ticker, r.matched_by) for r in found.collect()]
    assert len(got) == len({x[:2] for x in got}) and {x[:2]: x[2] for x in got} == want
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].split("\n")
    at = next(k for k, line in enumerate(plan) if "explode(transform(filter(xs" in line)
    below = plan[at : next(k for k in range(at, len(plan)) if "Join" in plan[k])]
    assert not any("Exchange" in line for line in [*plan[:at], *below])


def test_feature_table_sends_no_texts_or_signed_values_and_its_code_is_compiled(spark, data):
    """Methods of 8000 bytes or more stay interpreted by the virtual machine."""
    from ledgerlark.plans import feature_queries, score_queries
    from ledgerlark.plans.tables import Tables

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tables = Tables(spark, data)
        kept = ("row_id", "insider_cik", "transaction_date", "final_label")
        models_own = score_queries.models.numeric(history.model_matrix(tables.labelled, history.MODEL_FEATURES, *kept, wanted="final_label is not null"), history.MODEL_FEATURES, *kept)
        for df in (models_own, feature_queries.c02_feature_matrix(tables)):
            mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))]
            assert len(sizes) > 5 and max(sizes) < 8000
            sent = carried(df)
            assert not any(c in columns for columns in sent for c in ("signed_value", "footnote_text", "officer_title"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
