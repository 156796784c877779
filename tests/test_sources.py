"""Files and sinks that no query reads or writes."""

import datetime as dt

import pytest
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.sql import functions as F

from ledgerlark.functions import trade as t
from ledgerlark.operators import evaluate, labels, models, profile, warehouse
from ledgerlark.sources import filings, market


def filing(code="P", shares="100", price="2.5"):
    tag = lambda n, v: f"<{n}><value>{v}</value></{n}>"
    return (
        "<ownershipDocument><documentType>4</documentType><issuer><issuerCik>1</issuerCik><issuerName>I</issuerName><issuerTradingSymbol>AB</issuerTradingSymbol></issuer>"
        "<reportingOwner><reportingOwnerId><rptOwnerCik>7</rptOwnerCik><rptOwnerName>N</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isTenPercentOwner>1</isTenPercentOwner></reportingOwnerRelationship></reportingOwner>"
        f"<nonDerivativeTable><nonDerivativeTransaction>{tag('transactionDate', '2020-03-04')}<transactionCoding><transactionCode>{code}</transactionCode></transactionCoding>"
        f"<transactionAmounts>{tag('transactionShares', shares)}{tag('transactionPricePerShare', price)}</transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"
    )


def test_filings_from_files(spark, tmp_path):
    folder = tmp_path / "AB" / "0001"
    folder.mkdir(parents=True)
    (folder / "a.xml").write_text(filing())
    (folder / "b.txt").write_text(f"<SEC-DOCUMENT>\n<TYPE>4\n<XML>\n{filing('S', '3', '4')}\n</XML>\n</SEC-DOCUMENT>")
    (folder / "c.xml").write_text("no filing at all")
    texts = filings.read_filings(spark, str(tmp_path))
    assert texts.count() >= 2
    got = sorted((r.transaction_code, r.shares, r.total_value, r.transaction_date) for r in filings.parse_to_trades(texts).collect())
    assert got == [("P", 100.0, 250.0, dt.date(2020, 3, 4)), ("S", 3.0, 12.0, dt.date(2020, 3, 4))]


def test_a_filing_is_parsed_once(spark):
    option = filing().replace("nonDerivative", "derivative").replace("<transactionAmounts>", "<conversionOrExercisePrice><value>2</value></conversionOrExercisePrice><transactionAmounts>")
    texts = {"a.txt": f"<XML> \n{filing()}\n</XML> <XML>x</XML>", "b.txt": f"text {option} text", "c.txt": f"<XML>{filing()}", "d.txt": "<XML>\n</XML>" + filing("S"), "e.txt": "</XML><XML>", "f.xml": filing("F"), "g.txt": None, "h.txt": ""}
    own = spark.createDataFrame(list(texts.items()), "path string, text string").select("path", F.concat("text", F.lit("")).alias("text"))
    found = filings.parse_to_trades(own)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1
    got = sorted((r.accession_number, r.transaction_code, r.is_derivative, r.is_open_market, r.total_value, r.conversion_price) for r in found.collect())
    assert got == [("a", "P", False, True, 250.0, None), ("b", "P", True, False, 250.0, 2.0), ("c", "P", False, True, 250.0, None), ("d", "S", False, True, 250.0, None), ("f", "F", False, False, 250.0, None)]
    assert sorted(r.path for r in filings.unparsed(own).collect()) == ["e.txt", "g.txt", "h.txt"]


def test_typed_and_optional_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,u\n2,v\n")
    assert [tuple(r) for r in market.read_typed(spark, str(tmp_path / "x.csv"), "a int, b string", ("a",)).orderBy("a").collect()] == [(1, "u"), (2, "v")]
    with pytest.raises(ValueError):
        market.read_typed(spark, str(tmp_path / "x.csv"), "a int", ("c",))
    (tmp_path / "e.csv").write_text("ticker,announcement_date\n ab ,2020-01-02\ncd,never\n")
    assert [tuple(r) for r in market.read_optional(spark, str(tmp_path / "e.csv"), "announcement_date").collect()] == [("AB", dt.date(2020, 1, 2))]
    assert market.read_optional(spark, str(tmp_path / "none.csv"), "announcement_date").count() == 0
    assert market.read_optional(spark, str(tmp_path / "x.csv"), "announcement_date").count() == 0


def test_price_files(spark, tmp_path):
    (tmp_path / "ab_daily_prices.csv").write_text("date,close\n2020-01-02,1.5\n2020-01-03,\nbad,2\n")
    (tmp_path / "CD_daily_prices.csv").write_text("date,close\n01/02/2020,3\n")
    prices = market.read_prices(spark, str(tmp_path / "*.csv"))
    assert sorted(tuple(r) for r in prices.collect()) == [("AB", dt.date(2020, 1, 2), 1.5), ("CD", dt.date(2020, 1, 2), 3.0)]
    market.write_prices(prices, str(tmp_path / "p"))
    market.write_prices(prices.filter("ticker = 'AB'").withColumn("close", F.lit(9.0)), str(tmp_path / "p"))
    assert {(r.ticker, r.close) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("AB", 9.0), ("CD", 3.0)}
    rows = spark.createDataFrame([("AB", "2020-01-02", "1"), ("AB", "2021-01-02", "2"), ("AB", "x", "3")], "ticker string, Date string, Close string")
    assert [r.close for r in market.csv_prices(rows, dt.date(2020, 1, 1), dt.date(2020, 12, 31)).collect()] == [1.0]


def test_unions_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n")
    (tmp_path / "b.csv").write_text("w,k\n3,2\n")
    both = market.union_tables(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv")], "k int, v string, w int")
    assert sorted(map(tuple, both.collect())) == [(1, "x", None), (2, None, 3)]
    market.save_table(both, str(tmp_path / "saved"), by=("k",))
    assert spark.read.parquet(str(tmp_path / "saved")).count() == 2
    market.save_report(both, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    rows = models.assemble(both.select("k").withColumn("k", F.col("k").cast("double")), ["k"])
    market.save_model(KMeans(k=2, seed=1).fit(rows), str(tmp_path / "model"))
    assert len(KMeansModel.load(str(tmp_path / "model")).clusterCenters()) == 2


def test_focus_and_model_rows(spark):
    rows = spark.createDataFrame([("AB", "P", 1), ("CD", "S", 0), ("AB", "M", 1), ("AB", "P", -1)], "ticker string, transaction_code string, final_label int")
    assert labels.focus(rows, "/x/ab_form4.csv").count() == 3 and labels.focus(rows, "/x/zz.csv").count() == 4
    many = spark.range(5000).select(F.concat(F.lit("T"), "id").alias("ticker"))
    assert labels.focus(many, "/x/T4321.csv").count() == 1
    assert evaluate.model_rows(rows).count() == 2 and evaluate.model_rows(rows, labeled=False).count() == 3
    assert t.OPEN_MARKET


def test_gate_blocks_negative_prices_and_future_trades(spark):
    rows = [("A", -1.0, dt.date(2020, 1, 1)), ("B", 2.0, dt.date(2020, 1, 2))]
    df = spark.createDataFrame(rows, "ticker string, price_per_share double, transaction_date date")
    with pytest.raises(profile.QualityError):
        profile.preflight(df, dt.date(2021, 1, 1))
    with pytest.raises(profile.QualityError):
        profile.preflight(df.filter("ticker = 'B'"), dt.date(2020, 1, 1))
    assert profile.preflight(df.filter("ticker = 'B'"), dt.date(2021, 1, 1)).count() == 1


def fact_rows(spark, rows):
    import datetime as dt

    made = [(k, f"A{a}", 1, i, 20200101, 80, dt.date(y, 3, 1), dt.date(y, 3, 2), float(s), p, 1.0, 0.0, False, False) for k, a, i, y, s, p in rows]
    schema = "trade_id long, accession_number string, company_key long, insider_key long, time_key int, transaction_type_key int, transaction_date date, filing_date date, shares_traded double, price_per_share double, total_value double, shares_owned_after double, has_10b5_1_plan boolean, is_derivative boolean"
    return spark.createDataFrame(made, schema)


def test_facts_are_inserted_once(spark, tmp_path):
    """Loads of one year keep each other's rows; known keys are ignored, keys with a null are not; other years are untouched."""
    path = str(tmp_path / "facts")
    ids = lambda: sorted(r.trade_id for r in spark.read.parquet(path).collect())
    assert warehouse.merge_facts(fact_rows(spark, [(1, 1, 1, 2020, 5, 1.0), (2, 2, 1, 2021, 5, 1.0), (3, 3, 1, 2030, 5, 1.0)]), path).count() == 2
    assert warehouse.merge_facts(fact_rows(spark, [(4, 4, 1, 2020, 5, 1.0), (5, 1, 1, 2020, 5, 1.0), (6, 6, 1, 2020, 5, 1.0), (7, 6, 1, 2020, 5, 1.0)]), path).count() == 2
    assert ids() == [1, 2, 4, 6]
    for _ in range(2):
        warehouse.merge_facts(fact_rows(spark, [(8, 1, 1, 2020, 5, None), (1, 1, 1, 2020, 5, 1.0)]), path)
    assert ids() == [1, 2, 4, 6, 8, 8]
    assert warehouse.merge_facts(fact_rows(spark, []), path).count() == 0
    warehouse.compact_facts(spark, path, parts=2)
    assert ids() == [1, 2, 4, 6, 8, 8]


def test_swap_is_undone_where_it_was_cut_off(spark, tmp_path):
    import os

    from ledgerlark.sources import shared

    path = str(tmp_path / "t")
    assert shared.stored(spark, path) is None
    for n in (3, 5):
        shared.swap(spark.range(n) if n == 3 else shared.stored(spark, path).unionByName(spark.range(2)), path)
        assert shared.stored(spark, path).count() == n
    os.rename(path, f"{path}.old")
    assert shared.stored(spark, path).count() == 5


def test_facts_and_their_insertion_exchange_rows_once(spark, data):
    """Keys of dimensions that hold all trades are not joined; stored keys and incoming rows are exchanged as one union."""
    from ledgerlark.plans.tables import Tables
    from ledgerlark.plans.warehouse_queries import star

    tables = Tables(spark, data)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    fact, company, insider, time, kinds = star(tables)
    assert exchanges(fact) == exchanges(tables.trades)
    joined = warehouse.facts(tables.trades, company, insider, time, kinds)
    assert fact.exceptAll(joined).count() == joined.exceptAll(fact).count() == 0
    few = joined.limit(5).collect()
    assert [r.trade_id for r in warehouse.facts(tables.trades, company.filter(F.col("company_key") == few[0].company_key), None, time, kinds).filter(F.col("company_key") != few[0].company_key).collect()] == []
    rows = fact_rows(spark, [(1, 1, 1, 2020, 5, 1.0), (2, 1, 1, 2020, 5, 1.0), (3, 2, 1, 2020, 5, None), (4, 2, 1, 2020, 5, None), (5, 3, 1, 2020, 5, 0.0)])
    stored = fact_rows(spark, [(9, 3, 1, 2020, 5, -0.0), (8, 2, 1, 2020, 5, None)])
    new = warehouse.insert_new(stored, rows)
    assert exchanges(new) == 1 and sorted(r.trade_id for r in new.collect()) == [1, 3, 4]
