"""Column expressions over a trade: amounts, direction, dates, roles, plan and footnotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Transaction codes by their part in the feature stage and in the label stage.
FEATURE_BUY, FEATURE_SELL = ("A", "M"), ("S", "F")
LABEL_BUY, LABEL_SELL = ("A", "M", "P", "L"), ("S", "F", "D", "U")
OPEN_MARKET = ("P", "S")
IMPUTABLE = ("M", "A")
# Value buckets (upper bound, name).
VALUE_BUCKETS = ((1e5, "tiny"), (5e5, "small"), (2e6, "medium"), (1e7, "large"), (float("inf"), "mega"))
# Seniority by the first keyword found.
SENIORITY = (
    ("ceo", 6), ("cfo", 5), ("coo", 4), ("president", 4), ("chief", 4), ("general counsel", 3),
    ("senior vice president", 3), ("vice president", 2), ("officer", 2), ("director", 1),
)
# Phrases counted in footnotes.
ROUTINE_PHRASES = (
    "10b5-1", "10b5 1", "rule 10b", "trading plan", "scheduled vesting", "vesting date", "tax withholding",
    "withholding", "rsu", "restricted stock unit", "performance award",
)
INFORMED_PHRASES = ("open market", "discretionary", "personally", "at market", "direct purchase", "direct sale", "additional shares")
OPTION_PHRASES = ("option", "warrant", "conversion", "convertible", "exercise price")
LEAST_FOOTNOTE = 10


def col_or(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def role(is_officer: Column, title: Column, is_director: Column, is_ten_percent: Column) -> Column:
    """An officer counts only with a title."""
    t = F.upper(title)
    officer = F.coalesce(is_officer, F.lit(False)) & F.coalesce(title != "", F.lit(False))
    return (
        F.when(officer & (t.contains("CEO") | t.contains("CHIEF EXECUTIVE")), "CEO")
        .when(officer & (t.contains("CFO") | t.contains("CHIEF FINANCIAL")), "CFO")
        .when(officer & (t.contains("COO") | t.contains("CHIEF OPERATING")), "COO")
        .when(officer, "Officer")
        .when(F.coalesce(is_director, F.lit(False)), "Director")
        .when(F.coalesce(is_ten_percent, F.lit(False)), "10%_Owner")
        .otherwise("Other")
    )


def total_value(shares: Column, price: Column) -> Column:
    """Null unless both are there and not zero."""
    return F.when((shares != 0) & (price != 0), shares * price)


def derivative_price(price: Column, conversion: Column) -> Column:
    """A price that is null or zero falls back to the conversion price."""
    return F.coalesce(F.nullif(price, F.lit(0.0)), conversion)


def plan_in_footnotes(footnotes: Column) -> Column:
    """Any note of the map names the rule."""
    hit = lambda x: F.lower(x).contains("10b5-1") | F.lower(x).contains("10b-5")
    return F.coalesce(F.exists(F.map_values(footnotes), hit), F.lit(False))


def joined_footnotes(footnotes: Column) -> Column:
    """All notes, in the order of their ids."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(footnotes)), lambda e: e["value"]), " ")


def direction(code: Column, buy=FEATURE_BUY, sell=FEATURE_SELL) -> Column:
    """P5 with the feature codes, P19 with the label codes."""
    return F.when(code.isin(*buy), 1).when(code.isin(*sell), -1).otherwise(0)


def add_log_transforms(df: DataFrame) -> DataFrame:
    """P4."""
    log = lambda c: F.log1p(F.coalesce(c, F.lit(0.0)))
    empty = F.coalesce(F.col("total_value"), F.lit(0.0)) == 0
    return df.withColumns({
        "log_shares": log("shares"), "log_total_value": log("total_value"), "log_shares_owned_after": log("shares_owned_after"),
        "total_value_is_imputed": (empty & F.coalesce(F.col("transaction_code").isin(*IMPUTABLE), F.lit(False))).cast("int"),
    })


def add_direction(df: DataFrame, buy=FEATURE_BUY, sell=FEATURE_SELL) -> DataFrame:
    """Direction, its flags and the signed value.

    With the default codes an open-market purchase has direction 0.
    """
    d = direction(F.col("transaction_code"), buy, sell)
    om = F.coalesce(F.col("is_open_market"), F.lit(False))
    return df.withColumn("trade_direction", d).withColumns({
        "is_buy": (F.col("trade_direction") == 1).cast("int"),
        "is_sell": (F.col("trade_direction") == -1).cast("int"),
        "is_open_market_buy": (om & (F.col("trade_direction") == 1)).cast("int"),
        "is_open_market_sell": (om & (F.col("trade_direction") == -1)).cast("int"),
        "signed_value": F.coalesce("total_value", F.lit(0.0)) * F.col("trade_direction"),
    })


def days_to_filing(filed: Column, traded: Column) -> Column:
    """Never negative; null if a date is missing."""
    days = F.datediff(filed, traded)
    return F.when(days.isNotNull(), F.greatest(days, F.lit(0)))


def position_share(shares: Column, after: Column) -> Column:
    """Share of the position traded, between 0 and 1."""
    s, a = F.coalesce(shares, F.lit(0.0)), F.coalesce(after, F.lit(0.0))
    return F.when(s + a > 0, F.greatest(F.least(s / (s + a), F.lit(1.0)), F.lit(0.0))).otherwise(0.0)


def value_bucket(value: Column) -> Column:
    """Name of the right-closed bucket; zero and null are in the first, a negative value is 'nan'."""
    v = F.coalesce(value, F.lit(0.0))
    out = F.when(v < 0, "nan")
    for top, name in VALUE_BUCKETS:
        out = out.when(v <= top, name)
    return out


def value_bucket_number(bucket: Column) -> Column:
    """1 to 5; 'nan' is 0."""
    out = F.when(bucket == "nan", 0)
    for k, (_, name) in enumerate(VALUE_BUCKETS):
        out = out.when(bucket == name, k + 1)
    return out


def role_text(insider_role: Column, title: Column) -> Column:
    return F.lower(F.concat_ws(" ", insider_role, F.coalesce(title, F.lit(""))))


def seniority(insider_role: Column, title: Column) -> Column:
    """The first keyword of ``SENIORITY`` in role and title counts, so 'vice president' hits 'president'."""
    return _seniority(role_text(insider_role, title))


def _seniority(text: Column) -> Column:
    out = F.when(text.contains(SENIORITY[0][0]), SENIORITY[0][1])
    for word, score in SENIORITY[1:]:
        out = out.when(text.contains(word), score)
    return out.otherwise(1)


def add_role_features(df: DataFrame) -> DataFrame:
    """P11."""
    r, t = F.col("_role"), F.col("_title")
    flag = lambda short, long: (r.contains(short) | t.contains(long)).cast("int")
    # Texts are columns, so that they are made once and not for each keyword.
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    df = df.withColumns({"_role_text": role_text(F.col("insider_role"), F.col("officer_title")), "_role": low("insider_role"), "_title": low("officer_title")})
    return df.withColumns({
        "role_seniority": _seniority(F.col("_role_text")),
        "is_ceo": flag("ceo", "chief executive"), "is_cfo": flag("cfo", "chief financial"), "is_coo": flag("coo", "chief operating"),
        "is_director_only": ((r == "director") & F.coalesce(~F.col("is_officer"), F.lit(False))).cast("int"),
    }).drop("_role_text", "_role", "_title")


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+", ""), r"\s+$", "")


def phrase_hits(text: Column, phrases) -> Column:
    """How many of the phrases occur; 0 in a text below ``LEAST_FOOTNOTE`` characters."""
    return _phrase_hits(F.lower(F.coalesce(text, F.lit(""))), phrases)


def _phrase_hits(low: Column, phrases) -> Column:
    hits = sum((low.contains(p).cast("int") for p in phrases), F.lit(0))
    return F.when(F.length(low) < LEAST_FOOTNOTE, 0).otherwise(hits)


def add_text_counts(df: DataFrame) -> DataFrame:
    """What the text itself is needed for."""
    note = F.coalesce(F.col("footnote_text"), F.lit(""))
    low = F.col("_low_note")  # made once and not for each phrase
    return df.withColumn("_low_note", F.lower(note)).withColumns({
        "footnote_length": F.length(stripped(note)),
        "footnote_has_plan": note.rlike(r"(?i)10b5[-\s]?1").cast("int"),
        "footnote_routine_hits": _phrase_hits(low, ROUTINE_PHRASES),
        "footnote_informed_hits": _phrase_hits(low, INFORMED_PHRASES),
        "footnote_has_option": (_phrase_hits(low, OPTION_PHRASES) > 0).cast("int"),
    }).drop("_low_note")


def add_text_scores(df: DataFrame) -> DataFrame:
    """P15 and the plan flag, from the counts."""
    routine, informed = F.col("footnote_routine_hits"), F.col("footnote_informed_hits")
    score = F.when((F.col("footnote_length") < LEAST_FOOTNOTE) | (routine + informed == 0), 0.5).otherwise(routine / (routine + informed))
    plan = F.coalesce(col_or(df, "has_10b5_1_plan", False).cast("boolean"), F.lit(False)) | (F.col("footnote_has_plan") == 1)
    return df.withColumns({"footnote_routine_score": score, "has_plan": plan.cast("int")})


def add_text_features(df: DataFrame) -> DataFrame:
    """P12-P16."""
    return add_text_scores(add_text_counts(df))


def add_trade_features(df: DataFrame) -> DataFrame:
    """P4-P10."""
    df = add_direction(add_log_transforms(df))
    return df.withColumns({
        "days_to_filing": days_to_filing(F.col("filing_date"), F.col("transaction_date")),
        "pct_position_traded": position_share(F.col("shares"), F.col("shares_owned_after")),
        "value_bucket": value_bucket(F.col("total_value")),
        "txn_day_of_week": F.weekday("transaction_date"), "txn_month": F.month("transaction_date"), "txn_quarter": F.quarter("transaction_date"),
    }).withColumn("value_bucket_num", value_bucket_number(F.col("value_bucket")))


def normal_code(code: Column) -> Column:
    """P17."""
    return F.upper(F.trim(code))


def normal_ticker(ticker: Column) -> Column:
    """Words for nothing become null."""
    t = F.upper(F.trim(ticker))
    return F.when(~t.isin("", "NAN", "NONE", "NULL"), t)


def plain_cik(cik: Column) -> Column:
    """Without a decimal part."""
    return F.split_part(cik.cast("string"), F.lit("."), F.lit(1))


def cache_key(cik: Column, name: Column) -> Column:
    """The cik, else 20 characters of a hash of the name."""
    missing = cik.isNull() | F.lower(cik).isin("", "nan")
    return F.when(~missing, plain_cik(cik)).otherwise(F.substring(F.md5(name), 1, 20))


def normal_text(text: Column) -> Column:
    """P30."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9 ]", " "), r" +", " "))


def normal_tickers(tickers: Column) -> Column:
    """Trimmed, upper case, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.transform(tickers, lambda t: F.upper(F.trim(t)))))


def lenient_date(text: Column) -> Column:
    """S3."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd")])


def lenient_double(text: Column) -> Column:
    """S3."""
    return F.regexp_replace(text, r"[,$\s]", "").try_cast("double")


def finite_or_zero(value: Column) -> Column:
    """P25: what is no finite number is 0."""
    v = value.try_cast("double")
    return F.when(F.abs(v) < float("inf"), v).otherwise(0.0)  # nan is above all numbers
