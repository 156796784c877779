"""Toxicity scores from subword bags.

A word is the bag of its character n-grams and itself, hashed to buckets with
an embedding each.  A document averages the embeddings of its words' bags; a
linear softmax on the average gives the score.  Embeddings and softmax are
trained together in numpy on a bounded sample of labelled rows.  An unseen
misspelling shares most n-grams, and so most of its vector, with the word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed

BUCKETS, WIDTH = 1 << 16, 8
SHORTEST, LONGEST = 3, 5
#: GAIN, RARITY and EPOCHS have the best mean average precision of 24 settings on rows split off the training rows.
#: The average of word vectors is multiplied by this, so that one word in many counts.
GAIN = 4000.0
#: Power of a subword's rarity (0 to 1, by the documents that hold it) in its weight.
RARITY = 2.0
EPOCHS, BATCH, RATE = 10, 64, 0.5
#: Bound of the labelled sample, for each class.
MAX_TOXIC, MAX_CLEAN = 2000, 4000
#: Bound of the sample in distinct subwords of its texts, 8 bytes each.
MAX_ENTRIES = 24_000_000
CACHED_WORDS = 400_000
#: Texts whose new words are hashed together, and words in one piece of that.
TEXTS_AT_ONCE, WORDS_AT_ONCE = 256, 20_000

_U = np.uint64
_PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], _U)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, owners): of each word, in lower case, the buckets of itself and of its character n-grams, with repeats.

    Memory grows with the characters given, about 100 bytes for each.
    """
    marked = [f"<{w.lower()}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - (ends - sizes)[owner]
    whole = np.add.reduceat(mixed(codes + place.astype(_U) * _PLACES[0]), ends - sizes) if words else codes
    hashes, owners = [whole], [np.arange(len(words))]
    for n in range(SHORTEST, LONGEST + 1):
        at = np.flatnonzero(sizes[owner] - place >= n)
        hashes.append(sum((codes[at + k] * _PLACES[k] for k in range(n)), np.full(len(at), n, _U)))
        owners.append(owner[at])
    return (mixed(np.concatenate(hashes)) % _U(BUCKETS)).astype(np.int32), np.concatenate(owners)


class SubwordBags:
    """Averaged subword embeddings under a linear softmax of two classes."""

    def __init__(self, embeddings: np.ndarray, softmax: np.ndarray, bias: np.ndarray, rarity: np.ndarray):
        self.embeddings, self.softmax, self.bias, self.rarity, self.cache = embeddings, softmax, bias, rarity, {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    @staticmethod
    def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sparse average: buckets and their shares."""
        words = Counter(text.split())
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        grams, owner = subwords(list(words))
        times = np.fromiter(words.values(), np.float64, len(words))
        share = (GAIN * times / times.sum() / np.bincount(owner))[owner]
        at, where = np.unique(grams, return_inverse=True)
        return at, np.bincount(where, share).astype(np.float32)

    @classmethod
    def trained(cls, texts: list[str], labels: list[int], seed: int = 7) -> SubwordBags:
        """The model of whole texts and their labels."""
        return cls.fitted([cls.bag(t) for t in texts], labels, seed)

    @classmethod
    def fitted(cls, bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 7) -> SubwordBags:
        """Adagrad on both layers together; without labels of both classes, the score is their share."""
        rng = np.random.default_rng(seed)
        y = np.asarray(labels, np.int64)
        rate = (y.sum() + 0.5) / (len(y) + 1)
        e = np.zeros((BUCKETS, WIDTH), np.float32)  # subwords never seen stay neutral
        w, b = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.log([1 - rate, rate]).astype(np.float32)
        rarity = np.ones(BUCKETS, np.float32)
        model = cls(e, w, b, rarity)
        if len(set(labels)) < 2:
            return model
        sizes = np.array([len(at) for at, _ in bags])
        ends = np.cumsum(sizes)
        every, share = np.concatenate([at for at, _ in bags]), np.concatenate([x for _, x in bags])
        del bags
        seen = np.bincount(every, minlength=BUCKETS)
        rarity[:] = (np.log((len(sizes) + 1) / (seen + 1)) / np.log(len(sizes) + 1)) ** RARITY
        share = share * rarity[every]
        ge, gw, gb = np.full(BUCKETS, 1e-2, np.float32), np.full_like(w, 1e-2), np.full_like(b, 1e-2)
        for epoch in range(EPOCHS):
            order, rate = rng.permutation(len(sizes)), RATE / (1 + epoch)
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                # Entries of the batch's bags, bag by bag.
                n = sizes[part]
                row = np.repeat(np.arange(len(part)), n)
                pick = np.arange(n.sum()) + np.repeat(ends[part] - np.cumsum(n), n)
                at, x = every[pick], share[pick][:, None]
                full = np.flatnonzero(n)
                h = np.zeros((len(part), WIDTH), np.float32)
                h[full] = np.add.reduceat(x * e[at], (np.cumsum(n) - n)[full]) if len(full) else 0
                z = h @ w + b
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(part)), y[part]] -= 1
                p /= len(part)
                dh, dw, db = p @ w.T, h.T @ p, p.sum(0)
                sort = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[sort], prepend=-1))
                used = at[sort][first]
                de = np.add.reduceat((x * dh[row])[sort], first) if len(first) else np.zeros((0, WIDTH), np.float32)
                ge[used] += (de * de).mean(1)
                e[used] -= rate * de / np.sqrt(ge[used])[:, None]
                gw += dw * dw
                w -= rate * dw / np.sqrt(gw)
                gb += db * db
                b -= rate * db / np.sqrt(gb)
        return model

    def packed(self) -> list[bytes]:
        return [x.astype("<f4").tobytes() for x in (self.embeddings, self.softmax, self.bias, self.rarity)]

    @classmethod
    def unpacked(cls, parts: list[bytes]) -> SubwordBags:
        e, w, b, rarity = (np.frombuffer(bytes(x), "<f4").copy() for x in parts)
        return cls(e.reshape(BUCKETS, WIDTH), w.reshape(WIDTH, 2), b, rarity)

    def learn_words(self, words: set[str]) -> None:
        """Remember the mean of each word's subwords, projected on the difference of the classes."""
        towards = (self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0]) * self.rarity).astype(np.float64)
        new = list(words)
        for i in range(0, len(new), WORDS_AT_ONCE):
            part = new[i : i + WORDS_AT_ONCE]
            grams, owner = subwords(part)
            self.cache.update(zip(part, (np.bincount(owner, towards[grams]) / np.bincount(owner)).tolist()))

    def logit(self, text: str | None) -> float:
        return next(self.logits([text]))

    def logits(self, texts: Iterable[str | None]) -> Iterator[float]:
        """Softmax is linear, so a document's logit is the mean of its words' logits."""
        bias, cache = float(self.bias[1] - self.bias[0]), self.cache
        texts = iter(texts)
        while split := [(t or "").split() for t in islice(texts, TEXTS_AT_ONCE)]:
            used = set().union(*split)
            missing = used - cache.keys()
            if len(cache) + len(missing) > CACHED_WORDS:
                cache.clear()
                missing = used
            if missing:
                self.learn_words(missing)
            for words in split:
                yield (GAIN * sum(map(cache.__getitem__, words)) / len(words) if words else 0.0) + bias


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """(turn, text, toxic): whole texts of at most so many labelled rows of each class, chosen by a hash of the id."""
    known = labels.filter("toxic in (0, 1)").select(F.col(id_col).alias("_id"), "toxic").distinct()
    take = lambda y, n: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
    chosen = take(1, max_toxic).unionByName(take(0, max_clean))
    # At most max_toxic + max_clean rows of two numbers.
    rows = docs.join(F.broadcast(chosen), docs[id_col] == F.col("_id"))
    return rows.select(F.xxhash64("_id").alias("turn"), F.coalesce(docs[text_col], F.lit("")).alias("text"), "toxic")


def fit(docs: DataFrame, labels: DataFrame, held_out, max_entries: int = MAX_ENTRIES, **params) -> SubwordBags:
    """Train on labelled rows outside ``held_out`` (a condition on the labels).

    Texts become bags where they lie.  The bags of the bounded sample meet in
    one task, which takes them in the order of their hash up to
    ``max_entries`` subwords in all and trains; only the weights, of fixed
    size, reach the driver.  The sample may hold a larger share of toxic rows
    than all labels do; the bias is put back to the share among all of them.
    """
    known = labels.filter(~F.coalesce(held_out, F.lit(True)))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                turn, text, toxic = batch.slice(i, 64).columns
                found = [SubwordBags.bag(t.as_py()) for t in text]
                cols = [pa.array([x[k].astype(t).tobytes() for x in found], pa.binary()) for k, t in ((0, "<i4"), (1, "<f4"))]
                yield pa.RecordBatch.from_arrays([turn, toxic.cast(pa.int32()), *cols], ["turn", "toxic", "buckets", "shares"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, labels_, entries = [], [], 0
        for batch in batches:
            for toxic, at, share in zip(*(batch.column(k) for k in (1, 2, 3))):
                at, share = np.frombuffer(at.as_py(), "<i4"), np.frombuffer(share.as_py(), "<f4")
                entries += len(at)
                if entries > max_entries:
                    break
                sample.append((at, share))
                labels_.append(toxic.as_py())
        model = SubwordBags.fitted(sample, labels_)
        yield pa.RecordBatch.from_pydict({"weights": [model.packed()], "toxic": [sum(labels_)], "rows": [len(labels_)]}, pa.schema(
            [("weights", pa.list_(pa.binary())), ("toxic", pa.int64()), ("rows", pa.int64())]
        ))

    hashed = training_rows(docs, known, **params).mapInArrow(bags, "turn long, toxic int, buckets binary, shares binary")
    trained = hashed.repartition(1).sortWithinPartitions("turn", "toxic", "buckets").mapInArrow(train, "weights array<binary>, toxic long, rows long").first()
    if trained is None:  # no row, and so no task
        return SubwordBags.trained([], [])
    model = SubwordBags.unpacked(trained["weights"])
    everywhere = dict(known.filter("toxic in (0, 1)").groupBy("toxic").count().collect())
    odds = lambda toxic, clean: np.log((toxic + 0.5) / (clean + 0.5))
    model.bias[1] += odds(everywhere.get(1, 0), everywhere.get(0, 0)) - odds(trained["toxic"], trained["rows"] - trained["toxic"])
    return model


def scores(docs: DataFrame, model: SubwordBags, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for every row: the probability of label 1 from the whole text.

    Defined cases: a null or empty text, or one of white space, gets the score
    of an empty bag; a null id is passed on; repeated rows score alike; a very
    long text counts whole; an empty table gives an empty table; other columns
    are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x WIDTH numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            z = np.fromiter(m.logits(t.as_py() for t in batch.column(1)), np.float64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(score, f"`{id_col}` {kind}, score double")


def clean_documents(docs: DataFrame, model: SubwordBags, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with their columns, that score below ``threshold``.  Cases as in :func:`scores`.

    Texts are scored where they lie, in one pass without a shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = np.log(threshold / (1 - threshold))
        for batch in batches:
            yield batch.filter(pa.array([z < limit for z in sent.value.logits(t.as_py() for t in batch.column(at))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
