"""Spelling variants of words by asymmetric chunks.

Of two words, one contributes two disjoint chunks, its halves, and the other
its positional grams of the same size: one edit leaves one of the chunks
whole, shifted by one place at most.  Words are joined where a chunk equals a
gram within that shift and the pairs are verified.  Where many words share a
chunk, the half that the edit is in is cut in two again, as one edit leaves
one of its quarters whole too, and so on: no key keeps more pairs than its
words account for, and none is dropped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, discard, settle

#: Fixed values of the word pattern: runs of Latin letters.
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A word's form is at least so many times as frequent.
FORM_TIMES = 5
#: One run in so many loses a code point, by hash of row and run.
TYPO_IN = 199
#: Candidates of a key for each of its words; keys with more are cut finer.
PAIRS_A_WORD = 32
#: Distinct words and their characters that a task counts before it hands them on.
COUNTED, COUNTED_CHARACTERS = 1 << 17, 1 << 23

_FOLD = str.maketrans(UPPER, UPPER.lower())


def word_counts(docs: DataFrame, typo_in: int = TYPO_IN) -> DataFrame:
    """(word, n) of (_id string, _text), a word perhaps in several rows; words below ``LEAST_LENGTH`` are left out."""
    run = re.compile(RUN)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        size = 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                seed = zlib.crc32(f"{name.as_py() or ''}:".encode())
                for raw, n in Counter(run.findall(text.as_py() or "")).items():
                    if len(raw) < LEAST_LENGTH:
                        continue
                    word = raw.lower() if raw.isascii() else raw.translate(_FOLD)
                    h = zlib.crc32(word.encode(), seed)
                    if h % typo_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    if word not in found:
                        size += len(word)
                    found[word] += n
                if len(found) > COUNTED or size > COUNTED_CHARACTERS:
                    yield told()
                    found.clear()
                    size = 0
        yield told()

    return docs.mapInArrow(count, "word string, n long")


#: What a row stands for at its key: the chunks of the shorter word, the grams of the longer one, or both for words of one length.
CHUNKS, GRAMS, BOTH = 1, 2, 3


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (word, len, shift, side, low, high) with key: the hash of all but the open span of the word.

    ``len`` is the chunks' word's length, ``shift`` the other's surplus; the
    open span [low, high) of the chunks' word is where the edit may be.  What
    follows it stands ``shift`` further on in the grams' word.
    """
    after = F.col("high") + F.when(F.col("side") == GRAMS, F.col("shift")).otherwise(0) + 1
    return rows.withColumn("key", F.xxhash64("len", "shift", "low", "high", F.substring("word", F.lit(1), F.col("low")), F.substring("word", after, F.length("word"))))


def chunks_and_grams(words: DataFrame) -> DataFrame:
    """(word, len, shift, side, low, high, key): the two chunks of each word, and its grams for words as long and shorter by one.

    Of the grams within a shift of one, those are taken whose shift an edit
    can leave: the first chunk's in its place, the second's shifted by the
    difference of the lengths.
    """
    n = F.length("word")
    role = lambda length, shift, side: F.struct(length.alias("len"), F.lit(shift).alias("shift"), F.lit(side).alias("side"))
    roles = words.select("word", F.explode(F.array(role(n, 0, BOTH), role(n, 1, CHUNKS), role(n - 1, 1, GRAMS))).alias("r")).select("word", "r.*")
    half = F.floor(F.col("len") / 2).cast("int")
    span = lambda a, b: F.struct(a.alias("low"), b.alias("high"))
    both = F.array(span(half, F.col("len")), span(F.lit(0), half))
    return _keyed(roles.withColumn("s", F.explode(both)).select("word", "len", "shift", "side", "s.low", "s.high"))


def _finer(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    span = lambda a, b: F.struct(a.alias("low"), b.alias("high"))
    cut = rows.withColumn("s", F.explode(F.array(span(F.col("low"), middle), span(middle, F.col("high")))))
    return _keyed(cut.select("word", "len", "shift", "side", "s.low", "s.high"))


def near_words(words: DataFrame) -> DataFrame:
    """(a, b): the pairs of distinct words one edit apart, each once.

    A key at which the edit has one place left is not cut on: as many words
    share it as there are letters, or pairs of letters.
    """
    spark, written, found = words.sparkSession, [], []
    rows = settle(chunks_and_grams(words.select("word")), "chunks", written)
    while True:
        counts = rows.groupBy("key").agg(F.count_if(F.col("side") != GRAMS).alias("c"), F.count_if(F.col("side") != CHUNKS).alias("g"), F.count("*").alias("k"))
        many = F.col("c") * F.col("g") > PAIRS_A_WORD * F.col("k")
        live = counts.filter("c > 0 and g > 0 and k > 1").select("key", many.alias("many"))
        marked = settle(rows.join(live, "key").withColumn("open", F.col("many") & (F.col("high") - F.col("low") > 1)), "chunks", written)
        small = marked.filter("not open")
        chunks = small.filter(F.col("side") != GRAMS).select("key", F.col("word").alias("a"), F.col("side").alias("a_side"))
        grams = small.filter(F.col("side") != CHUNKS).select("key", F.col("word").alias("b"))
        near = chunks.join(grams, "key").filter(((F.col("a_side") == CHUNKS) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
        found.append(settle(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near", written))
        rest = marked.filter("open")
        if rest.isEmpty():
            break
        rows = settle(_finer(rest), "chunks", written)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = settle(pairs.distinct(), "pairs")
    discard(spark, written)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of the forms that follow from each word; steps double each round."""
    spark, written = forms.sparkSession, []
    ends = settle(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots", written)
    while not ends.filter("moved").isEmpty():
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = settle(ends.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots", written)
    kept = written.pop()
    discard(spark, written)
    return spark.read.schema("word string, root string").parquet(kept)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo_in: int = TYPO_IN) -> DataFrame:
    """One row per word of the corpus: word, form, root, n, n_near, form_n.

    Words are the runs of Latin letters of whole texts in lower case (A-Z
    only), after one run in ``typo_in`` has lost a code point by hash of the
    row's id and the run, with ``LEAST_LENGTH`` code points and ``LEAST_COUNT``
    occurrences.  ``n_near`` counts the words one edit apart, ``form`` is the
    most frequent of these (ties: the first in code-point order) if it occurs
    ``FORM_TIMES`` as often, ``root`` is where forms lead to.  Defined cases: a
    null text has no words, a null id hashes as an empty one, rows that repeat
    an id or a text count each; an empty table, or one without such words,
    gives an empty table; other columns are not looked at.
    """
    own = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    words = word_counts(own, typo_in).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)
    words = settle(words, "words")
    pairs = near_words(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    known = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    joined = words.join(best, "word", "left").withColumn("best_n", -F.col("best.less"))
    formed = F.coalesce(F.col("best_n") >= FORM_TIMES * F.col("n"), F.lit(False))
    marked = settle(joined.select(
        "word", F.when(formed, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best_n")).alias("form_n"),
    ), "marked")
    ends = roots(marked.filter("form is not null").select("word", "form"))
    return marked.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
