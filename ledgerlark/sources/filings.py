"""Filing documents: nested XML, bare or inside an SGML wrapper, to one row for each transaction."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import trade as t

_V = "struct<value:string>"
_TXN = (
    f"struct<securityTitle:{_V},conversionOrExercisePrice:{_V},transactionDate:{_V},transactionCoding:struct<transactionCode:string>,"
    f"transactionAmounts:struct<transactionShares:{_V},transactionPricePerShare:{_V},transactionAcquiredDisposedCode:{_V}>,exerciseDate:{_V},expirationDate:{_V},"
    f"underlyingSecurity:struct<underlyingSecurityShares:{_V}>,postTransactionAmounts:struct<sharesOwnedFollowingTransaction:{_V}>,ownershipNature:struct<directOrIndirectOwnership:{_V}>>"
)
#: The elements of an ownership document that are read.
SCHEMA = (
    "documentType string, periodOfReport string, issuer struct<issuerCik:string,issuerName:string,issuerTradingSymbol:string>, "
    "reportingOwner array<struct<reportingOwnerId:struct<rptOwnerCik:string,rptOwnerName:string>,"
    "reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,isTenPercentOwner:string,isOther:string,officerTitle:string>>>, "
    f"nonDerivativeTable struct<nonDerivativeTransaction:array<{_TXN}>>, derivativeTable struct<derivativeTransaction:array<{_TXN}>>, "
    "footnotes struct<footnote:array<struct<_VALUE:string,_id:string>>>, ownerSignature array<struct<signatureDate:string>>"
)


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every file below ``path``; whole files, read in parallel."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def accession_number(path: Column) -> Column:
    """The first part of the path that looks like one, else the name of the file."""
    found = F.regexp_extract(path, r"(?:^|/)(\d{10}-\d{2}-\d{6})(?=/|$|\.)", 1)
    return F.when(found != "", found).otherwise(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1))


def _between(text: Column, start: str, end: str) -> Column:
    """What stands between the first ``start`` and the next ``end``; null if one of them is missing."""
    parts = F.split(text, re.escape(start), 2)
    after = F.get(parts, F.lit(1))
    return F.when(F.contains(after, F.lit(end)), F.substring_index(after, end, 1))


def ownership_document(path: Column, text: Column) -> Column:
    """The XML of a filing: an .xml file whole, else its first XML block or ownership document; null if there is none."""
    wrapped = F.nullif(F.btrim(_between(text, "<XML>", "</XML>"), F.lit(" \t\n\x0b\f\r")), F.lit(""))
    bare = F.concat(F.lit("<ownershipDocument"), _between(text, "<ownershipDocument", "</ownershipDocument>"), F.lit("</ownershipDocument>"))
    return F.when(F.lower(path).endswith(".xml"), F.nullif(F.trim(text), F.lit(""))).otherwise(F.coalesce(wrapped, bare))


def _true(flag: Column) -> Column:
    return F.coalesce(F.lower(F.trim(flag)).isin("1", "true"), F.lit(False))


def parse_filings(files: DataFrame, today=None) -> DataFrame:
    """One row for each file that parses: header, first owner, transactions and footnotes.

    Other files are left out; ``unparsed`` finds them.
    """
    read = _read(files).filter("d.issuer is not null")
    owner, rel = F.col("d.reportingOwner")[0], F.col("d.reportingOwner")[0]["reportingOwnerRelationship"]
    notes = F.transform(F.coalesce("d.footnotes.footnote", F.array()), lambda n: F.struct(n["_id"].alias("id"), F.trim(F.regexp_replace(n["_VALUE"], r"\s+", " ")).alias("text")))
    signed = t.lenient_date(F.col("d.ownerSignature")[0]["signatureDate"])
    title = F.nullif(F.trim(rel["officerTitle"]), F.lit(""))
    base = read.select(
        accession_number(F.col("path")).alias("accession_number"),
        F.coalesce(signed, t.lenient_date(F.col("d.periodOfReport")), F.lit(today).cast("date") if today else F.current_date()).alias("filing_date"),
        F.col("d.issuer.issuerCik").alias("issuer_cik"), F.col("d.issuer.issuerName").alias("issuer_name"), F.col("d.issuer.issuerTradingSymbol").alias("ticker"),
        owner["reportingOwnerId"]["rptOwnerName"].alias("insider_name"), owner["reportingOwnerId"]["rptOwnerCik"].alias("insider_cik"),
        t.role(_true(rel["isOfficer"]), title, _true(rel["isDirector"]), _true(rel["isTenPercentOwner"])).alias("insider_role"),
        _true(rel["isDirector"]).alias("is_director"), _true(rel["isOfficer"]).alias("is_officer"), _true(rel["isTenPercentOwner"]).alias("is_ten_percent_owner"), title.alias("officer_title"),
        t.plan_in_footnotes(F.map_from_entries(F.transform(notes, lambda n: F.struct(F.coalesce(n["id"], F.lit("")), n["text"])))).alias("has_10b5_1_plan"),
        F.array_join(F.transform(notes, lambda n: n["text"]), " ").alias("footnote_text"),
        F.coalesce(F.col("d.documentType") == "4/A", F.lit(False)).alias("is_amendment"), F.col("path").alias("xml_path"),
        F.coalesce("d.nonDerivativeTable.nonDerivativeTransaction", F.array()).alias("_plain"), F.coalesce("d.derivativeTable.derivativeTransaction", F.array()).alias("_derivative"),
    )
    return base


def _read(files: DataFrame) -> DataFrame:
    # The document comes out of a list, as a filter on a plain column would parse it again.
    document = F.from_xml(ownership_document(F.col("path"), F.col("text")), SCHEMA, {"mode": "PERMISSIVE"})
    return files.select("*", F.explode_outer(F.array(document)).alias("d"))


def unparsed(files: DataFrame) -> DataFrame:
    """Paths of files that hold no readable ownership document."""
    return _read(files).filter("d.issuer is null").select("path")


def transactions(filings: DataFrame) -> DataFrame:
    """One row for each transaction of :func:`parse_filings`; derivative ones have four more columns and fewer flags."""
    base = [c for c in filings.columns if not c.startswith("_")]
    number = lambda c: t.lenient_double(F.col(c))

    told = lambda c, derivative: F.transform(c, lambda x: F.struct(F.lit(derivative).alias("derivative"), x.alias("x")))
    # Both kinds are opened together, so that a file is read once.
    rows = filings.select(*base, F.explode_outer(F.concat(told("_plain", False), told("_derivative", True))).alias("t")).filter("t is not null").select(*base, "t.*")
    derivative = F.col("derivative")
    shares, price = number("x.transactionAmounts.transactionShares.value"), number("x.transactionAmounts.transactionPricePerShare.value")
    strike, code = number("x.conversionOrExercisePrice.value"), F.col("x.transactionCoding.transactionCode")
    plain_only = {"acquired_disposed": F.col("x.transactionAmounts.transactionAcquiredDisposedCode.value"), "direct_indirect": F.col("x.ownershipNature.directOrIndirectOwnership.value")}
    derivative_only = {
        "conversion_price": strike, "exercise_date": t.lenient_date(F.col("x.exerciseDate.value")), "expiration_date": t.lenient_date(F.col("x.expirationDate.value")),
        "underlying_shares": number("x.underlyingSecurity.underlyingSecurityShares.value"),
    }
    return rows.select(
        *base, F.col("x.securityTitle.value").alias("security_title"), t.lenient_date(F.col("x.transactionDate.value")).alias("transaction_date"), code.alias("transaction_code"), shares.alias("shares"),
        price.alias("price_per_share"), F.when(derivative, t.total_value(shares, t.derivative_price(price, strike))).otherwise(t.total_value(shares, price)).alias("total_value"),
        number("x.postTransactionAmounts.sharesOwnedFollowingTransaction.value").alias("shares_owned_after"), derivative.alias("is_derivative"),
        (~derivative & F.coalesce(code.isin(*t.OPEN_MARKET), F.lit(False))).alias("is_open_market"),
        *[F.when(~derivative, v).alias(c) for c, v in plain_only.items()], *[F.when(derivative, v).alias(c) for c, v in derivative_only.items()],
    )


def parse_to_trades(files: DataFrame, today=None) -> DataFrame:
    """Files to transactions."""
    return transactions(parse_filings(files, today))


def ingest(files: DataFrame, prices: DataFrame, path: str | None = None) -> DataFrame:
    """Parse, enrich with closes, and save if there is a path."""
    from ledgerlark.operators.asof import enrich_with_prices

    out = enrich_with_prices(parse_to_trades(files), prices)
    if path:
        out.write.mode("overwrite").parquet(path)
    return out
