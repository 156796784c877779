"""Temperature mixing of sources, in DataFrame and SQL functions only.

Source token shares are raised to an exponent between 0 (all sources alike)
and 1 (as they are).  Bisection finds the exponent that meets a target entropy
without a source repeating beyond a limit.  The normalised weights then become
token budgets, and every source spends its budget on permuted blocks of its
documents: whole passes first, then the blocks and documents that still fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORDS = r"[^\x20\x09-\x0D]+"
BISECTIONS = 40
#: Documents that a block of a source holds at most on average, up to MAX_BLOCKS.
ROWS_A_BLOCK, MIN_BLOCKS, MAX_BLOCKS = 50_000, 16, 65_536


def blocks_for(rows: int) -> int:
    return max(MIN_BLOCKS, min(MAX_BLOCKS, -(-rows // ROWS_A_BLOCK)))


def _bisected(good_below: bool, holds) -> Column:
    """End of the interval [0, 1] where ``holds(exponent)`` stops or starts."""
    step = lambda s, _: F.when(
        holds((s["lo"] + s["hi"]) / 2) == F.lit(good_below), F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi"))
    ).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi")))
    end = "lo" if good_below else "hi"
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, step, lambda s: s[end])


def source_weights(sources: DataFrame, entropy_share: float, max_repetition: float, budget_tokens: int | None = None) -> DataFrame:
    """Weights and budgets for (source, tokens), one row per source with tokens.

    The exponent is the largest whose weights have at least ``entropy_share``
    of the entropy of equal weights; if a source would repeat more than
    ``max_repetition`` times, the smallest that keeps to the limit.  Where
    even an exponent of one repeats more, it is one, and the budgets are cut
    to the limit.  No budget means as many tokens as there are.
    """
    total = F.aggregate("ts", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    budget = F.lit(budget_tokens).cast("long") if budget_tokens is not None else total
    one = (
        sources.filter("tokens > 0")
        .agg(F.sort_array(F.collect_list(F.struct("source", "tokens"))).alias("ts"))
        .withColumn("total", total)
        .withColumn("budget", budget)
        .withColumn("ps", F.transform("ts", lambda x: x["tokens"] / F.col("total")))
    )
    sum_of = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def entropy(a: Column) -> Column:
        norm = sum_of(F.transform("ps", lambda p: F.pow(p, a)))
        return F.log(norm) - a * sum_of(F.transform("ps", lambda p: F.pow(p, a) * F.log(p))) / norm

    def repetition(a: Column) -> Column:
        norm = sum_of(F.transform("ps", lambda p: F.pow(p, a)))
        return F.array_max(F.transform("ps", lambda p: F.pow(p, a - 1))) / norm * F.col("budget") / F.col("total")

    varied = lambda a: entropy(a) >= F.lit(float(entropy_share)) * F.log(F.size("ps").cast("double"))
    within = lambda a: repetition(a) <= F.lit(float(max_repetition))
    by_entropy = F.when(varied(F.lit(1.0)), 1.0).otherwise(_bisected(True, varied))
    by_limit = F.when(within(F.lit(0.0)), 0.0).otherwise(_bisected(False, within))
    solved = one.filter(F.size("ts") > 0).withColumn("exponent", F.round(F.greatest(by_entropy, by_limit), 6))
    weighted = solved.withColumn("norm", sum_of(F.transform("ps", lambda p: F.pow(p, F.col("exponent")))))
    share = F.pow(F.col("t.tokens") / F.col("total"), F.col("exponent")) / F.col("norm")
    return weighted.select("exponent", "total", "budget", "norm", F.explode("ts").alias("t")).select(
        F.col("t.source").alias("source"),
        F.col("t.tokens").alias("source_tokens"),
        "exponent",
        share.alias("weight"),
        F.least(F.floor(share * F.col("budget")), F.floor(F.col("t.tokens") * F.lit(float(max_repetition)))).alias("source_budget"),
    )


def plan(docs: DataFrame, entropy_share: float = 0.95, max_repetition: float = 4.0, budget_tokens: int | None = None,
         seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(``docs`` with keys, schedule): which blocks are used in which pass.

    The first table is ``docs`` with _source, _block, _tokens.  The schedule
    has one row for each use of a block: source, block, epoch, block_time (when
    in the mix, 0 to 1), cut (null: the whole block; else only documents whose
    key does not exceed it), weight and exponent.
    """
    n = blocks_for(docs.count())
    ident = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    keyed = docs.select(
        "*",
        F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("_source"),
        (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/block/"), ident)), 1, 8), 16, 10).cast("long") % n).alias("_block"),
        F.regexp_count(F.coalesce(docs[text_col].cast("string"), F.lit("")), F.lit(WORDS)).cast("long").alias("_tokens"),
    )
    narrow = keyed.select("_source", "_block", "_tokens", ident.alias("_ident"))
    blocks = narrow.groupBy(F.col("_source").alias("source"), F.col("_block").alias("block")).agg(F.sum("_tokens").alias("tokens"))
    weights = source_weights(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), entropy_share, max_repetition, budget_tokens)
    order = Window.partitionBy("source", "epoch").orderBy("block_key", "block")
    uses = (
        blocks.join(weights, "source")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor(F.col("source_budget") / F.col("source_tokens")).cast("int"))))
        .withColumn("block_key", F.md5(F.concat_ws("/", F.lit(seed), "source", "epoch", "block")))
        .withColumn("upto", F.sum("tokens").over(order))
        .withColumn("left_over", F.col("source_budget") - F.col("epoch") * F.col("source_tokens"))
        .filter(F.col("upto") - F.col("tokens") < F.col("left_over"))
        .withColumn("block_time", (F.col("epoch") * F.col("source_tokens") + F.col("upto") - F.col("tokens")) / F.col("source_budget"))
    )
    # The one block of a source where its budget ends: documents by key while they fit.
    last = uses.filter("upto > left_over").select("source", "block", "epoch", (F.col("left_over") - F.col("upto") + F.col("tokens")).alias("room"))
    key = F.md5(F.concat_ws("/", F.lit(seed), "epoch", "_ident"))
    inside = narrow.join(last, (F.col("_source") == F.col("source")) & (F.col("_block") == F.col("block"))).withColumn("key", key)
    by_key = Window.partitionBy("source", "block", "epoch").orderBy("key")
    cuts = (
        inside.withColumn("upto", F.sum("_tokens").over(by_key))
        .groupBy("source", "block", "epoch")
        .agg(F.coalesce(F.max(F.when(F.col("upto") <= F.col("room"), F.col("key"))), F.lit("")).alias("cut"))
    )
    schedule = uses.join(cuts, ["source", "block", "epoch"], "left").select("source", "block", "epoch", "block_time", "cut", "weight", "exponent")
    return keyed, schedule


def mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", **params) -> DataFrame:
    """Uses of documents: ``docs`` and _source, _tokens, epoch, block_time, weight, exponent, use_key.

    A document has a row for each pass that takes it; those that no budget
    reaches have none.  In the order of (block_time, use_key) the sources
    interleave by weight.  Parameters: those of :func:`plan`.

    Defined cases: a null text or one without words has no tokens and is taken
    with its block; a null source is the source ''; a source without tokens
    has no budget and is left out; rows that repeat an id are taken together;
    a null id counts as the text ''; an empty table gives an empty table.
    Columns of ``docs`` with the names of added columns are replaced.
    """
    if clash := {"_source", "_block", "_tokens", "epoch", "block_time", "weight", "exponent", "use_key"} & set(docs.columns):
        docs = docs.drop(*clash)
    keyed, schedule = plan(docs, seed=seed, id_col=id_col, **params)
    schedule = schedule.withColumnsRenamed({"source": "_s", "block": "_b"})
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return (
        keyed.join(schedule, (F.col("_source") == F.col("_s")) & (F.col("_block") == F.col("_b")))
        .withColumn("use_key", F.md5(F.concat_ws("/", F.lit(seed), "epoch", ident)))
        .filter("cut is null or use_key <= cut")
        .drop("_s", "_b", "cut", "_block")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """``docs`` as the mix uses them, in the order of the mix, with the columns of ``docs`` as they are, whatever their names."""
    whole = docs.select(*dict.fromkeys([id_col, text_col, source_col]), F.struct("*").alias("_document"))
    used = mix(whole, id_col=id_col, text_col=text_col, source_col=source_col, **params)
    return used.repartitionByRange("block_time", "use_key").sortWithinPartitions("block_time", "use_key").select("_document.*")
