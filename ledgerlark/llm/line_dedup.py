"""Near-duplicate lines by a deletion-neighbourhood join.

Lines are sequences of words, and lines of very few words sequences of
characters.  The neighbourhood of a line within an edit bound of one element
is the line with one element taken out, at each place, and the whole line with
a gap at each place; variants become hashed keys, equal keys
meet, and the edit distance is verified on the elements.  A line goes if an
earlier line lies within the bound.  Only the earliest line of a key is
compared with, so a key that many lines share makes no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle

#: Lines of fewer words are compared by characters: of two words or one, the bound of one word may change half the line or all of it.
LEAST_WORDS = 3
#: Of these, lines of fewer characters are only compared whole, for the same reason.
LEAST_CHARACTERS = 4

SPACE = " \t\n\x0b\x0c\r"


def _trimmed(line: Column) -> Column:
    return F.btrim(F.lower(line), F.lit(SPACE))


def _words(line: Column) -> Column:
    """Words in lower case; a line without words gives one empty word."""
    return F.split(_trimmed(line), r"[\x20\x09-\x0D]+")


def _elements(words: Column) -> Column:
    """The sequence that is compared: words, or the characters of a line of few words, marked as no word can be."""
    characters = F.transform(F.split(F.array_join(words, " "), ""), lambda c: F.concat(F.lit("\n"), c))
    return F.when((F.size(words) >= LEAST_WORDS) | (words == F.array(F.lit(""))), words).otherwise(characters)


def _text_hash(text_col: str) -> Column:
    """With the id it names a row: many rows may have a null id, or one id."""
    return F.xxhash64(F.coalesce(text_col, F.lit("")))


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each line: _id, _text_h (hash of the text), _pos, n (elements), h (hash of the elements), halves (hashes of its first and last halves).

    Two lines within one element of each other share their first or their last
    k elements, where k is half the elements of the shorter; halves has both for the
    two lengths that k can have.
    """
    lines = docs.select(F.col(id_col).alias("_id"), _text_hash(text_col).alias("_text_h"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("_pos", "_line"))
    worded = lines.select("_id", "_text_h", "_pos", _words(F.col("_line")).alias("words")).select("_id", "_text_h", "_pos", _elements(F.col("words")).alias("words"))
    n = F.when(F.col("words") == F.array(F.lit("")), 0).otherwise(F.size("words"))
    k = lambda d: F.floor((F.col("n") + d) / 2).cast("int")
    half = lambda side, d: F.xxhash64(F.lit(side), k(d), F.slice("words", 1, k(d)) if side == "head" else F.slice("words", F.col("n") - k(d) + 1, k(d)))
    halves = F.array(*[half(side, d) for side in ("head", "tail") for d in (-1, 0)])
    enough = F.col("n") >= F.when(F.startswith(F.get("words", F.lit(0)), F.lit("\n")), LEAST_CHARACTERS).otherwise(LEAST_WORDS)
    return worded.withColumn("n", n).select("_id", "_text_h", "_pos", "n", F.xxhash64("words").alias("h"), F.when(enough, halves).alias("halves"))


def lines_with_partners(lines: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, place, words) of each distinct line that shares a half with another line; the others have no near copy.

    Words are read again from the rows where such lines stand first, so that
    texts without them are not taken apart.
    """
    half = lines.filter("halves is not null").select("h", F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("half")
    partners = half.join(shared, "half", "left_semi").select("h").distinct()
    first = lines.filter("halves is not null").groupBy("h").agg(F.min(F.struct("_id", "_pos", "_text_h")).alias("place")).join(partners, "h", "left_semi")
    wanted = first.groupBy(F.col("place._id").alias("_id"), F.col("place._text_h").alias("_text_h")).agg(F.collect_list(F.struct(F.col("place._pos").alias("_pos"), "h")).alias("_wanted"))
    texts = docs.select(F.col(id_col).alias("_own"), _text_hash(text_col).alias("_own_h"), F.split(F.coalesce(text_col, F.lit("")), "\n").alias("_lines"))
    found = texts.join(wanted, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_h") == F.col("_text_h"))).select("_id", "_lines", F.explode("_wanted").alias("w"))
    read = found.select("w.h", F.struct("_id", "w._pos").alias("place"), _elements(_words(F.get("_lines", F.col("w._pos")))).alias("words"))
    return read.filter(F.xxhash64("words") == F.col("h")).dropDuplicates(["h"])


def _without(words: Column, at: Column) -> Column:
    return F.concat(F.slice(words, 1, at), F.slice(words, at + 2, F.greatest(F.size(words) - at - 1, F.lit(0))))


def near_lines(own: DataFrame) -> DataFrame:
    """(h, first): for each line with an earlier one within one word, its hash and the earliest place of such a line.

    ``own``: h (hash of the words), words, place; one row for each line.  A
    variant's key is the place of the gap with hashes of what stands before
    and after it, from running XORs over the words, so a line of n words costs
    n steps and not n squared.
    """
    by_line = Window.partitionBy("h")
    words = own.select("h", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    from_start, from_end = F.xxhash64("at", "word"), F.xxhash64(F.col("n") - F.col("at"), "word")
    spans = words.select("h", "n", "at", from_start.alias("own_start"), from_end.alias("own_end")).select(
        "h", "n", "at", "own_start", "own_end",
        F.coalesce(F.bit_xor("own_start").over(by_line.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.bit_xor("own_end").over(by_line).alias("all_after"),
        F.bit_xor("own_end").over(by_line.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
    )
    after = F.col("all_after").bitwiseXOR(F.col("upto"))
    # How a key came about is its place and, in the last bit, whether the element there was taken out.
    variant = lambda key, at, cut: F.struct(key.alias("key"), (2 * at + cut).alias("how"))
    taken = variant(F.xxhash64("at", "before", after), F.col("at"), 1)
    whole = variant(F.xxhash64("at", "before", after.bitwiseXOR(F.col("own_end"))), F.col("at"), 0)
    at_end = variant(F.xxhash64("n", F.col("before").bitwiseXOR(F.col("own_start")), F.lit(0).cast("long")), F.col("n"), 0)
    last = F.when(F.col("at") == F.col("n") - 1, F.array(taken, whole, at_end)).otherwise(F.array(taken, whole))
    keys = spans.select("h", F.explode(last).alias("v")).select("h", "v.key", "v.how")
    # Most keys belong to one line; only the others get the places of their lines.
    shared = keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("key")
    found = settle(keys.join(shared, "key", "left_semi").join(own.select("h", "place"), "h"), "shared")
    # All lines of a key are within one word of each other, so the earliest is the one that counts for each.
    earliest = found.groupBy("key").agg(F.min(F.struct("place", "h", "how")).alias("e"))
    at, cut = (lambda how: F.floor(how / 2).cast("int")), (lambda how: how % 2 == 1)
    met = found.join(earliest, "key").filter("e.place < place").select(
        "h", at(F.col("how")).alias("at"), cut(F.col("how")).alias("cut"), F.col("e.h").alias("eh"), at(F.col("e.how")).alias("eat"), cut(F.col("e.how")).alias("ecut"), F.col("e.place").alias("eplace")
    )
    rest = lambda w, at, cut: F.when(F.col(cut), _without(F.col(w), F.col(at))).otherwise(F.col(w))
    left, right = own.select("h", F.col("words").alias("w")), own.select(F.col("h").alias("eh"), F.col("words").alias("ew"))
    checked = met.join(left, "h").join(right, "eh").filter(rest("w", "at", "cut") == rest("ew", "eat", "ecut"))
    return checked.groupBy("h").agg(F.min("eplace").alias("first"))


def _marked_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text_h, _pos, h, keep, first): every line, its hash and the earliest line that it repeats."""
    lines = settle(line_table(docs, id_col, text_col), "lines")
    place = F.struct(F.col("_id"), F.col("_pos"))
    narrow = lines.select("_id", "_text_h", "_pos", "h", "n")
    known = narrow.filter("n > 0").groupBy("h").agg(F.min(place).alias("place"))
    near = near_lines(settle(lines_with_partners(lines, docs, id_col, text_col), "partners"))
    known = known.join(near, "h", "left").select("h", F.least("place", F.coalesce("first", "place")).alias("first"))
    keep = F.coalesce((F.col("n") == 0) | (F.col("first") >= place), F.lit(True))
    return narrow.join(known, "h", "left").select("_id", "_text_h", "_pos", "h", keep.alias("keep"), "first")


def near_line_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line: id_col, pos, keep, first_id, first_pos.

    Lines compare by their words in lower case.  A line goes when the same
    line, or one that differs in one word (changed, added or left out), stands
    earlier; lines of fewer than ``LEAST_WORDS`` words differ in one character
    instead, from ``LEAST_CHARACTERS`` characters, and are compared with such
    lines only.  Earlier means in a row of smaller id, or higher in the same
    row.  It does not matter whether the earlier line goes too.  first_id and first_pos are the earliest such line.  Lines without
    words stay.  Defined cases: a null text is one empty line; a null id comes
    before all others; rows that repeat an id and a text repeat its places:
    they are marked alike and do not count as earlier; an empty table gives an
    empty table; other columns are not looked at.
    """
    found, gone = _marked_lines(docs, id_col, text_col), ~F.col("keep")
    return found.select(F.col("_id").alias(id_col), F.col("_pos").alias("pos"), "keep",
                        F.when(gone, F.col("first._id")).alias("first_id"), F.when(gone, F.col("first._pos")).alias("first_pos"))


def drop_near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that :func:`near_line_marks` drops; rows keep their other columns, and a null text stays null.

    Of rows that repeat an id with other texts, each loses its own lines only.
    """
    marks = _marked_lines(docs, id_col, text_col).filter("not keep")
    gone = marks.groupBy(F.col("_id").alias("_gone_id"), F.col("_text_h").alias("_gone_h")).agg(F.collect_set("_pos").alias("_gone"))
    own_h = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["_gone_id"]) & (own_h == gone["_gone_h"]), "left")
    cleaned = F.array_join(F.filter(F.split(docs[text_col], "\n"), lambda line, i: ~F.array_contains(gone["_gone"], i)), "\n")
    return joined.select(*[F.when(gone["_gone"].isNull(), docs[c]).otherwise(cleaned).alias(c) if c == text_col else docs[c] for c in docs.columns])
