"""Masked pseudo-likelihood of documents under a window network.

Every token is predicted from the two tokens on either side.  The network
sums an embedding for each neighbour and its place and ends in a two-level
softmax (the token's class, then the token in its class).  It is trained in
numpy by the tasks, group by group of documents, and averaged over the groups
of a round before the next round goes on.  A word outside the network's vocabulary
has the probability of its rest token times the word's share of that token in
the corpus, from the counts of all words, so the probabilities of all words of
the corpus add up to one.  A document's score is the sum of the conditional
log-probabilities of all its words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Tokens: the most frequent words of the corpus, then hashed rest classes, then the edge of a text.
CLASSES, MEMBERS, WIDTH = 32, 32, 16
REST_CLASSES = 2
OFFSETS = (-2, -1, 1, 2)
VOCABULARY = CLASSES * MEMBERS
FREQUENT = VOCABULARY - REST_CLASSES * MEMBERS
EDGE = VOCABULARY
#: Rows that are scored at once, rows of a training step, and rounds of averaging.
BATCH, STEP, RATE, ROUNDS = 8192, 2048, 0.15, 4
#: Where the sums of squared gradients start.
FIRST_SQUARES = 1e-6
#: Pieces in which weights travel to be averaged.
PIECES = 64
#: Tokens that a task holds before it computes on them.
AT_ONCE = 1 << 16
CACHED_WORDS = 600_000
#: Text of one group of documents.
GROUP_BYTES = 1 << 23


def word_hash(word: str) -> int:
    """A word's 64-bit name in tables, that of ``xxhash64`` in SQL."""
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 42)
    return h - (1 << 64) if h >> 63 else h


class Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def coded_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_group, _turn, _id, codes, at, h, n): every text as numbers of words, and the words of each group of documents.

    Documents are dealt by hash of id and text to groups of about
    ``GROUP_BYTES`` of text, ``ROUNDS`` groups at least, so the groups don't
    depend on the partitions of ``docs``.  A row of a document holds its words'
    numbers within the group in ``codes`` (32 bits each); a row of a word
    (codes null) holds its number ``at``, its hash and its count in the group.
    Texts are split here and nowhere else.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    size = own.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    turn = F.xxhash64("_id", "_text")
    dealt = own.select(F.pmod(turn, F.lit(max(ROUNDS, -(-size // GROUP_BYTES)))).alias("_group"), turn.alias("_turn"), "_id", "_text")
    kind = docs.schema[id_col].dataType.simpleString()
    return settle(dealt.groupBy("_group").applyInArrow(coded_group, f"_group long, _turn long, _id {kind}, codes binary, at int, h long, n long"), "coded")


def coded_group(table: pa.Table) -> pa.Table:
    """The rows of :func:`coded_texts` of one group."""
    table = table.take(np.argsort(table.column("_turn").to_numpy(), kind="stable"))
    numbers, codes, count = Numbers(), [], np.zeros(0, np.int64)
    for text in table.column("_text"):
        words = (text.as_py() or "").lower().split()
        own = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        codes.append(own.tobytes())
        if len(numbers) > len(count):
            count = np.concatenate([count, np.zeros(max(len(count), len(numbers) - len(count)), np.int64)])
        at, times = np.unique(own, return_counts=True)
        count[at] += times
    n, d = len(numbers), len(table)
    none = lambda k, t: pa.nulls(k, t)
    ids = table.column("_id").combine_chunks()
    return pa.table({
        "_group": pa.array([table.column("_group")[0].as_py()] * (d + n), pa.int64()),
        "_turn": pa.chunked_array([table.column("_turn").combine_chunks(), none(n, pa.int64())]),
        "_id": pa.chunked_array([ids, none(n, ids.type)]),
        "codes": pa.chunked_array([pa.array(codes, pa.binary()), none(n, pa.binary())]),
        "at": pa.chunked_array([none(d, pa.int32()), pa.array(range(n), pa.int32())]),
        "h": pa.chunked_array([none(d, pa.int64()), pa.array(map(word_hash, numbers), pa.int64())]),
        "n": pa.chunked_array([none(d, pa.int64()), pa.array(count[:n])]),
    })


def word_counts(coded: DataFrame) -> DataFrame:
    """(h, n): every word of the corpus and its count."""
    return settle(coded.filter("at is not null").groupBy("h").agg(F.sum("n").alias("n")), "words")


def frequent_words(counts: DataFrame) -> tuple[list[int], list[int], int]:
    """(hashes of the ``FREQUENT`` most frequent words, their counts, all words)."""
    top = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    return [r.h for r in top], [r.n for r in top], counts.agg(F.sum("n")).first()[0] or 0


def word_shares(coded: DataFrame, counts: DataFrame, words: Words) -> DataFrame:
    """(_of, at, h, share): for each word of a group, named ``_of`` here, the log of the share that it has of its token in the corpus.

    It is 0 for words of the vocabulary; a word that ``counts`` lacks counts as
    seen once.  Only the totals of the rest tokens, of fixed number, reach the
    driver.
    """
    spark = counts.sparkSession
    known = F.broadcast(spark.createDataFrame([(h,) for h in words.known], "h long"))  # at most FREQUENT rows
    bucket = F.pmod("h", F.lit(VOCABULARY - FREQUENT))
    own = coded.filter("at is not null").select(F.col("_group").alias("_of"), "at", "h")
    rest = counts.join(known, "h", "left_anti")
    totals = F.broadcast(spark.createDataFrame(rest.groupBy(bucket.alias("_bucket")).agg(F.sum("n").alias("_total")).collect(), "_bucket long, _total long"))
    joined = own.join(known, "h", "left_anti").join(counts, "h", "left").join(totals, bucket == F.col("_bucket"), "left")
    share = F.log(F.coalesce("n", F.lit(1)) / F.greatest(F.coalesce("_total", F.lit(1)), F.lit(1)))
    return joined.select("_of", "at", "h", share.alias("share")).unionByName(own.join(known, "h", "left_semi").withColumn("share", F.lit(0.0)))


class Words(dict):
    """Token ids of texts: a frequent word's rank, or a hashed rest token.  Remembers the words it has met."""

    def __init__(self, frequent: list[int]):
        super().__init__()
        self.known = {h: i for i, h in enumerate(frequent)}

    def __reduce__(self):
        return Words, (list(self.known),)

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = word_hash(word)
        token = self.known.get(h, FREQUENT + h % (VOCABULARY - FREQUENT))
        self[word] = token
        return token

    def ids(self, text: str) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int16, len(words))

    def tokens(self, h: np.ndarray) -> np.ndarray:
        """Token ids of words by their hashes."""
        rest = (FREQUENT + h % (VOCABULARY - FREQUENT)).astype(np.int16)
        if not self.known:
            return rest
        hashes, ids = np.fromiter(self.known, np.int64, len(self.known)), np.fromiter(self.known.values(), np.int16, len(self.known))
        order = np.argsort(hashes)
        at = np.minimum(np.searchsorted(hashes[order], h), len(order) - 1)
        return np.where(hashes[order][at] == h, ids[order][at], rest)


class WindowNetwork:
    """Weights: embeddings by offset, class softmax, member softmax of each class."""

    SHAPES = ((len(OFFSETS), VOCABULARY + 1, WIDTH), (WIDTH, CLASSES), (CLASSES,), (CLASSES, WIDTH, MEMBERS), (CLASSES, MEMBERS))

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        parts = []
        for shape in self.SHAPES:
            size = int(np.prod(shape))
            parts.append(flat[at : at + size].reshape(shape))
            at += size
        self.embed, self.up, self.bias, self.member, self.member_bias = parts

    @classmethod
    def started(cls, counts: list[int], total: int, seed: int = 11) -> WindowNetwork:
        """Small random embeddings; biases from the corpus counts, so that training starts at the unigram model."""
        net = cls(np.zeros(sum(int(np.prod(s)) for s in cls.SHAPES), np.float32))
        rng = np.random.default_rng(seed)
        net.embed[:] = rng.normal(0, 0.05, net.embed.shape)
        net.up[:] = rng.normal(0, 0.05, net.up.shape)
        net.member[:] = rng.normal(0, 0.05, net.member.shape)
        share = np.full(VOCABULARY, max(total - sum(counts), 1) / (VOCABULARY - FREQUENT))
        share[:FREQUENT] = 0.5
        share[: len(counts)] = counts
        by_class = share.reshape(CLASSES, MEMBERS)
        net.bias[:] = np.log(by_class.sum(1) / share.sum())
        net.member_bias[:] = np.log(by_class / by_class.sum(1, keepdims=True))
        return net

    def forward(self, around: np.ndarray, target: np.ndarray):
        """Log-probabilities of ``target`` (sorted by class) and what the gradients need."""
        h = self.embed[0][around[0]]
        for o in range(1, len(OFFSETS)):
            h = h + self.embed[o][around[o]]
        kind, member = target // MEMBERS, target % MEMBERS
        z = h @ self.up + self.bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        norm = p.sum(1, keepdims=True)
        rows = np.arange(len(target))
        log_p = z[rows, kind] - np.log(norm[:, 0])
        p /= norm
        edges = np.searchsorted(kind, np.arange(CLASSES + 1))
        q = np.empty((len(target), MEMBERS), h.dtype)
        for c in range(CLASSES):
            a, b = edges[c], edges[c + 1]
            if a < b:
                q[a:b] = h[a:b] @ self.member[c] + self.member_bias[c]
        q -= q.max(1, keepdims=True)
        logit = q[rows, member]
        q = np.exp(q)
        norm = q.sum(1, keepdims=True)
        log_p = log_p + logit - np.log(norm[:, 0])
        q /= norm
        return log_p, h, p, q, kind, member, edges

    def train(self, around: np.ndarray, target: np.ndarray, squares: np.ndarray) -> None:
        """One Adagrad step on a batch sorted by class."""
        _, h, p, q, kind, member, edges = self.forward(around, target)
        rows = np.arange(len(target))
        p[rows, kind] -= 1
        q[rows, member] -= 1
        grad = WindowNetwork(np.zeros_like(self.flat))
        grad.up[:], grad.bias[:] = h.T @ p, p.sum(0)
        dh = p @ self.up.T
        for c in range(CLASSES):
            a, b = edges[c], edges[c + 1]
            if a < b:
                grad.member[c], grad.member_bias[c] = h[a:b].T @ q[a:b], q[a:b].sum(0)
                dh[a:b] += q[a:b] @ self.member[c].T
        for o in range(len(OFFSETS)):
            order = np.argsort(around[o], kind="stable")
            ids = around[o][order]
            first = np.flatnonzero(np.diff(ids, prepend=np.int16(-1)))
            grad.embed[o][ids[first]] = np.add.reduceat(dh[order], first)
        grad.flat /= len(target)
        squares += grad.flat * grad.flat
        self.flat -= RATE * grad.flat / np.sqrt(squares)

    def scores(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        out = np.empty(len(target))
        for a in range(0, len(target), BATCH):
            order = np.argsort(target[a : a + BATCH] // MEMBERS, kind="stable")
            out[a : a + BATCH][order] = self.forward(around[:, a : a + BATCH][:, order], target[a : a + BATCH][order])[0]
        return out


def stream(texts: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """(neighbours by offset, targets, tokens of each text) in portions of about ``AT_ONCE`` tokens, whole texts each."""
    edge = np.full(max(OFFSETS), EDGE, np.int16)
    parts, sizes = [edge], []

    def portion():
        flat = np.concatenate(parts)
        at = np.flatnonzero(flat != EDGE)
        return np.stack([flat[at + o] for o in OFFSETS]), flat[at], sizes

    held = 0
    for ids in texts:
        parts += [ids, edge]
        sizes.append(len(ids))
        held += len(ids) + 1
        if held >= AT_ONCE:
            yield portion()
            parts, sizes, held = [edge], [], 0
    if sizes:
        yield portion()


def decoded(codes: Iterable[bytes], token: np.ndarray) -> Iterator[np.ndarray]:
    """The texts of one group as token ids, from the token of each of its words."""
    return (token[np.frombuffer(c, np.int32)] for c in codes)


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of one ``_group``, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        group = batch.column("_group").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for a, b in zip(edges, edges[1:]):
            if held and a < b and held[-1].column("_group")[-1].as_py() != group[a]:
                yield pa.Table.from_batches(held)
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def trained_on(group: pa.Table, words: Words, flat: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(weights, squares, tokens): the network after one pass over a group of :func:`coded_texts`, in the order of ``_turn``."""
    docs = group.filter(pc.is_valid(group.column("codes")))
    docs = docs.take(np.argsort(docs.column("_turn").to_numpy(), kind="stable"))
    rows = group.filter(pc.is_valid(group.column("at")))
    token = np.empty(len(rows), np.int16)
    token[rows.column("at").to_numpy()] = words.tokens(rows.column("h").to_numpy())
    own, squares, seen, rng = WindowNetwork(flat.copy()), squares.copy(), 0, np.random.default_rng(5)
    for around, target, _ in stream(decoded(docs.column("codes").to_pylist(), token)):
        order = rng.permutation(len(target))
        for a in range(0, len(order), STEP):
            at = order[a : a + STEP]
            at = at[np.argsort(target[at] // MEMBERS, kind="stable")]
            own.train(around[:, at], target[at], squares)
        seen += len(target)
    return own.flat, squares, seen


def train(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", coded: DataFrame | None = None, counts: DataFrame | None = None) -> tuple[Words, WindowNetwork]:
    """Vocabulary and network from every text of ``docs``, whose :func:`coded_texts` and word counts may be known.

    The groups are dealt to the rounds.  In a round each of its groups trains
    a copy of the network over all its tokens, and the copies are averaged,
    weighted by their tokens; the next round goes on from there.  A task adds
    up the copies of its groups and hands them on in pieces, so one piece has
    as many rows as there are tasks.  Only the averaged weights, of fixed
    size, and the frequent words reach the driver.  The result depends on the
    rows, not on their partitions.
    """
    if coded is None:
        coded = coded_texts(docs, id_col, text_col)
    if counts is None:
        counts = word_counts(coded)
    frequent, often, total = frequent_words(counts)
    words, net = Words(frequent), WindowNetwork.started(often, total)
    squares, spark = np.full_like(net.flat, FIRST_SQUARES), docs.sparkSession
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((words, net.flat, squares))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            added, tokens = np.zeros((2, len(sent.value[1]))), 0  # noqa: B023
            for group in groups_of(batches):
                flat, squared, seen = trained_on(group, *sent.value)  # noqa: B023
                added += np.stack([flat, squared]).astype(np.float64) * seen
                tokens += seen
            pieces = [x.tobytes() for x in np.array_split(added, PIECES, axis=1)] if tokens else []
            cols = [pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary()), pa.array([tokens] * len(pieces), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["piece", "added", "tokens"])

        def mean(rows: pd.DataFrame) -> pd.DataFrame:
            added = sum(np.frombuffer(x) for x in rows["added"]) / rows["tokens"].sum()
            return pd.DataFrame({"piece": [rows["piece"].iloc[0]], "mean": [added.tobytes()]})

        own = coded.filter(F.pmod("_group", F.lit(rounds)) == turn).select("_group", "_turn", "codes", "at", "h")
        trained = own.repartition("_group").sortWithinPartitions("_group").mapInArrow(part, "piece int, added binary, tokens long")
        found = trained.groupBy("piece").applyInPandas(mean, "piece int, mean binary").orderBy("piece").collect()
        sent.destroy()
        if found:
            flat, squares = np.concatenate([np.frombuffer(bytes(r["mean"])).reshape(2, -1) for r in found], axis=1).astype(np.float32)
            net = WindowNetwork(flat.copy())
    return words, net


def pseudo_likelihood(docs: DataFrame, words: Words, net: WindowNetwork, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, log_likelihood, mean_log_likelihood) for every row, by the network alone.

    The sum over all tokens of log P(token | two tokens on either side); words
    outside the vocabulary count as their rest token.
    Defined cases: a null or empty text has no tokens, a sum of 0 and a null
    mean; a very long text is scored whole; repeated rows score alike; a null
    id is passed on; an empty table gives an empty table; other columns are
    not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast((words, net.flat))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_words, flat = sent.value
        own = WindowNetwork(flat)
        for batch in batches:
            done = 0
            for around, target, sizes in stream(own_words.ids(t.as_py() or "") for t in batch.column(1)):
                total = np.concatenate([[0.0], np.cumsum(own.scores(around, target))])
                ends = np.cumsum(sizes)
                sums = total[ends] - total[ends - sizes]
                means = [s / n if n else None for s, n in zip(sums, sizes)]
                ids = batch.column(0).slice(done, len(sizes))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(sums), pa.array(means, pa.float64())], ["id", "n", "s", "m"]).rename_columns([id_col, "n_tokens", "log_likelihood", "mean_log_likelihood"])
                done += len(sizes)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, log_likelihood double, mean_log_likelihood double")


def word_likelihood(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns of :func:`pseudo_likelihood` for every row of ``docs``, by a network trained on them and the shares of all their words.

    The sum over all words of log P(word | two words on either side), which
    for a word outside the vocabulary is log P(rest token) plus the log of the
    word's share of that token.  Each group of documents meets the shares of
    its own words only.  The defined cases are those of
    :func:`pseudo_likelihood`.
    """
    coded = coded_texts(docs, id_col, text_col)
    counts = word_counts(coded)
    words, net = train(docs, rounds, id_col, text_col, coded, counts)
    sent = docs.sparkSession.sparkContext.broadcast((words, net.flat))

    def run(texts: pa.Table, own: pa.Table) -> pa.Table:
        own_words, flat = sent.value
        at = own.column("at").to_numpy()
        token, share = np.empty(len(at), np.int16), np.empty(len(at))
        token[at], share[at] = own_words.tokens(own.column("h").to_numpy()), own.column("share").to_numpy()
        network, codes = WindowNetwork(flat), texts.column("codes").to_pylist()
        sizes, sums = [], []
        for around, target, some in stream(decoded(codes, token)):
            total = np.concatenate([[0.0], np.cumsum(network.scores(around, target))])
            ends = np.cumsum(some)
            sizes += some
            sums += (total[ends] - total[ends - some]).tolist()
        sums = [s + float(share[np.frombuffer(c, np.int32)].sum()) for s, c in zip(sums, codes)]
        means = [s / n if n else None for s, n in zip(sums, sizes)]
        return pa.table([texts.column("_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array(means, pa.float64())], [id_col, "n_tokens", "log_likelihood", "mean_log_likelihood"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = coded.filter("codes is not null").select("_group", "_id", "codes")
    together = texts.groupBy("_group").cogroup(word_shares(coded, counts, words).groupBy("_of"))
    return together.applyInArrow(run, f"`{id_col}` {kind}, n_tokens long, log_likelihood double, mean_log_likelihood double")
