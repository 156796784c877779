"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of 5-word shingles.  Independent trees branch the sets by
chosen minwise tokens: a node's sets are dealt to children by minwise values
until nodes are small, and small nodes are compared exhaustively.  Minwise
values rule out pairs that are far from the threshold; what they leave is
confirmed on the full sets.  Links become connected components as they are
found, and a node whose sets lie in one component needs no more comparing, so
groups of close copies, which branching does not make smaller, fall away once
a few of their links are known.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, mixed, settle

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Minwise values of a set, a pool from which the levels of all trees choose.
N_HASHES = 60
#: A pair at the threshold meets in one tree with probability 0.75 at the root
#: and 1 - (1 - 0.75)^2 at each deeper level: 0.54 a tree in a small node of
#: the last level, and 12 trees miss it with less than one in 10,000; in small
#: nodes of the root, where most nodes are small, with less than one in ten
#: million.
TREES, LEVELS, BRANCHES = 12, 6, 2
SMALL_NODE = 48
#: Deeper nodes are small up to this size.
SMALL_DEEPER = 384
#: Equal minwise values that a pair needs to be confirmed: a pair at the
#: threshold has 45 of 60 on average, and fewer than 29 in less than one case of 100,000.
ALIKE = 29
#: Sets of a large root node that stand in each of its parts.
PIVOTS = 4
#: Large nodes of so many trees are compared in parts before they branch.
PART_TREES = 3
#: A large node with so few sets outside its largest component does not branch on.
OUTSIDE = 512
#: Shingles of the sets of a large node in one group: of those outside its largest component, and of all.
ASKED_SHINGLES, TOLD_SHINGLES = 1 << 18, 1 << 19
#: Parts that a set plays in a group: it is compared with all, all are compared with it, or both.
ASKED, TOLD = 1, 2
#: Bytes of text that the hashing takes at once.
SLICE_BYTES = 2 << 20
#: Words of more bytes are hashed one by one: the rolling hash is safe for short ones only.
LONG_WORD = 128

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_WORD_WEIGHTS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], _U)
_SIDES = np.random.default_rng(20240229).integers(1, 1 << 63, (2, N_HASHES), dtype=np.uint64) * _U(2) + _U(1)


class _Powers:
    """Powers of the odd base and of its inverse modulo 2^64, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            for name, x in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, x, _U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_powers = _Powers()


def _shingles(data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; ``bounds`` are the texts' byte bounds in ``data``."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inner = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], inner])
    after = np.concatenate([inner, [False]])
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    up, down = _powers.upto(len(data))
    total = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], dtype=_U)])
    words = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0x2545F4914F6CDD1D))
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        words[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes())
    fives = np.zeros(max(0, len(words) - SHINGLE + 1), _U)
    for k in range(SHINGLE):
        fives += words[k : k + len(fives)] * _WORD_WEIGHTS[k]
    fives = mixed(fives + _U(SHINGLE))
    firsts = np.searchsorted(starts, bounds)
    for a, z in zip(firsts[:-1], firsts[1:]):
        if z - a >= SHINGLE:
            own = np.sort(fives[a : z - SHINGLE + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif z > a:
            yield mixed(np.sum(words[a:z] * _WORD_WEIGHTS[: z - a], keepdims=True, dtype=_U) + _U(z - a))
        else:
            yield np.zeros(0, _U)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sets of each text of an Arrow column; a null text has an empty one.

    Words are runs of bytes other than 9-13 and 32, lower-cased in A-Z only,
    so shingles do not depend on locale or Unicode tables.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        yield from _shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def minwise(own: np.ndarray) -> np.ndarray:
    """The minwise values of a set, ``N_HASHES`` numbers of 32 bits."""
    least = np.full(N_HASHES, np.iinfo(np.uint64).max, _U)
    for i in range(0, len(own), 1 << 14):
        least = np.minimum(least, ((own[i : i + (1 << 14), None] ^ _SIDES[0]) * _SIDES[1]).min(0))
    return (least >> _U(32)).astype(np.uint32).view(np.int32)


SKETCH = "_id long, n_shingles long, set_a long, set_b long, minwise binary"


def sketches(docs: DataFrame) -> DataFrame:
    """(_id, n_shingles, set_a, set_b, minwise) for (_id, _text); set_a and set_b name the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, mins = [], [], [], []
            for own in shingle_sets(batch.column(1)):
                n.append(len(own))
                a.append(np.sum(own, dtype=_U))
                b.append(np.sum(mixed(own ^ _U(0x5851F42D4C957F2D)), dtype=_U))
                mins.append(minwise(own).tobytes())
            cols = [pa.array(np.array(x, _U).view(np.int64)) for x in (n, a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(mins, pa.binary())], ["_id", "n_shingles", "set_a", "set_b", "minwise"])

    return docs.mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame) -> DataFrame:
    """(_id, _set) for (_id, _text): the sorted hashes of all shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                own = [x.view(np.int64) for x in shingle_sets(part.column(1))]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(own)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["_id", "_set"])

    return docs.mapInArrow(run, "_id long, _set array<long>")


def roots(reps: DataFrame) -> DataFrame:
    """(tree, node, _id, parent): every set in the root nodes of all trees, by one minwise value a tree."""
    value = lambda t: F.substring("minwise", t * (4 * N_HASHES // TREES) + 1, F.lit(4))
    nodes = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, value(t)))
    return reps.select("_id", F.posexplode(nodes).alias("tree", "node")).select("tree", "node", "_id", F.lit(None).cast("long").alias("parent"))


def children(large: DataFrame, reps: DataFrame, level: int) -> DataFrame:
    """(tree, node, _id, parent): the sets of large nodes dealt to children by ``BRANCHES`` minwise values that the node chooses; parent is its size."""
    chosen = lambda j: F.pmod(F.xxhash64("node", F.lit(level), j), F.lit(N_HASHES)).cast("int")
    nodes = F.transform(
        F.sequence(F.lit(0), F.lit(BRANCHES - 1)), lambda j: F.xxhash64("node", F.lit(level), j, F.substring("minwise", 4 * chosen(j) + 1, F.lit(4)))
    )
    return large.join(reps.select("_id", "minwise"), "_id").select("tree", F.explode(nodes).alias("node"), "_id", F.col("size").alias("parent"))


def with_size(members: DataFrame) -> DataFrame:
    """(tree, node, _id, parent, size) of nodes of several sets."""
    sizes = members.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
    return members.join(sizes, "node")


def parts_of(large: DataFrame) -> DataFrame:
    """(node, _id): large nodes of the first trees cut by hash to parts of a small node's size, with the node's pivots in every part."""
    own = large.filter(F.col("tree") < PART_TREES).withColumn("parts", F.ceil(F.col("size") / SMALL_NODE))
    dealt = own.select("node", F.pmod(F.xxhash64("_id", F.lit("part")), "parts").alias("part"), "_id")
    least = [F.min(F.struct(F.xxhash64("_id", F.lit(k)).alias("h"), "_id"))["_id"] for k in range(PIVOTS)]
    pivots = own.groupBy("node", "parts").agg(F.array_distinct(F.array(*least)).alias("ids"))
    spread = pivots.select("node", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select("node", "part", F.explode("ids").alias("_id"))
    return dealt.unionByName(spread).select(F.xxhash64("node", "part").alias("node"), "_id").distinct()


def with_components(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` with the component of their _id, which is _id itself where no link is known."""
    known = parts.select(F.col("id").alias("_id"), F.col("component").alias("_known"))
    return rows.join(known, "_id", "left").withColumn("component", F.coalesce("_known", "_id")).drop("_known")


def undecided(rows: DataFrame) -> DataFrame:
    """(node, _id, component): of such rows, those of nodes whose sets lie in several components."""
    several = rows.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    return rows.join(several.select("node"), "node", "left_semi")


def _find(root: dict[int, int], k: int) -> int:
    while (up := root.get(k, k)) != k:
        root[k] = k = root.get(up, up)
    return k


def _forest(ids: np.ndarray, size: np.ndarray, drawn: np.ndarray) -> list[tuple[int, int, int]]:
    """(a, b, equal minwise values) of the most alike pairs of a node, a < b, that connect all that may be linked."""
    equal = (drawn[:, None, :] == drawn[None, :, :]).sum(2, dtype=np.int16)
    near = np.minimum(size[:, None], size[None, :]) * 100 >= PERCENT * np.maximum(size[:, None], size[None, :])
    i, j = np.nonzero(np.triu((equal >= ALIKE) & near, 1))
    root: dict[int, int] = {}
    forest = []
    for n, a, b in sorted((-int(equal[x, y]), *sorted((int(ids[x]), int(ids[y])))) for x, y in zip(i, j)):
        if (p := _find(root, a)) != (q := _find(root, b)):
            root[max(p, q)] = min(p, q)
            forest.append((a, b, -n))
    return forest


def alike(nodes: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b, equal): of each small node (node, _id), pairs whose minwise values and sizes allow a link, fewer than it has sets.

    They are the most alike ones, and connect all sets of the node that such
    pairs connect, so every set that may have a link in the node is in a pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            members, bounds = rows.flatten(), np.concatenate([[0], np.cumsum(rows.value_lengths().to_numpy())])
            ids, size = (members.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            drawn = np.frombuffer(b"".join(members.field(2).to_pylist()), np.int32).reshape(-1, N_HASHES)
            found = [x for i, j in zip(bounds[:-1], bounds[1:]) for x in _forest(ids[i:j], size[i:j], drawn[i:j])]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], ["a", "b", "equal"])

    placed = nodes.join(reps, "_id")
    whole = placed.groupBy("node").agg(F.collect_list(F.struct("_id", "n_shingles", "minwise")).alias("members"))
    return whole.select("members").filter(F.size("members") > 1).mapInArrow(run, "a long, b long, equal long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose full sets are linked."""
    side = lambda c: sets.select(F.col("_id").alias(c), F.col("_set").alias(f"{c}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    similar = 100 * both >= PERCENT * (F.size("a_set") + F.size("b_set") - both)
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").filter(similar).select("a", "b").distinct()


def with_outside(rows: DataFrame) -> DataFrame:
    """Rows of large nodes (tree, node, _id, parent, component) where undecided, with size, top (largest component) and outside (sets not in it)."""
    counts = rows.groupBy("node", "component").agg(F.count("*").alias("n"))
    tops = counts.groupBy("node").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("component", F.struct("n", -F.col("component"))).alias("top"))
    return rows.join(tops.filter("size > most").select("node", "size", "top", (F.col("size") - F.col("most")).alias("outside")), "node")


def blocks_of(wide: DataFrame, reps: DataFrame) -> DataFrame:
    """(group, node, _id, component, role): large nodes as groups of bounded size, in which every set outside the largest component meets every set."""
    own = wide.join(reps.select("_id", F.col("n_shingles").alias("n")), "_id").withColumn("out", F.col("component") != F.col("top"))
    cuts = own.groupBy("node").agg(
        F.ceil(F.sum(F.when(F.col("out"), F.col("n"))) / ASKED_SHINGLES).alias("blocks"), F.ceil(F.sum("n") / TOLD_SHINGLES).alias("pieces")
    )
    dealt = own.join(cuts, "node").select(
        "*", F.pmod(F.xxhash64("_id", F.lit("block")), "blocks").alias("block"), F.pmod(F.xxhash64("_id", F.lit("piece")), "pieces").alias("piece")
    )
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    told = dealt.select("node", "_id", "component", F.lit(TOLD).alias("role"), "piece", upto("blocks").alias("block"))
    asked = dealt.filter("out").select("node", "_id", "component", F.lit(ASKED).alias("role"), "block", upto("pieces").alias("piece"))
    return told.unionByName(asked).select(F.xxhash64("node", "block", "piece").alias("group"), "node", "_id", "component", "role")


def links_in_groups(groups: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): confirmed links between the components of each group, enough to connect all that are linked.

    ``groups``: group, node, _id, component, role.  Two sets that meet in
    several nodes are compared in the least of these only.
    """

    def compare(rows: pa.Table) -> pa.Table:
        ids, component, role, size = (rows.column(c).to_numpy() for c in ("_id", "component", "role", "n_shingles"))
        node = rows.column("node")[0].as_py()
        drawn = np.frombuffer(b"".join(rows.column("minwise").to_pylist()), np.int32).reshape(-1, N_HASHES)
        homes = [np.asarray(x, np.int64) for x in rows.column("homes").to_pylist()]
        sets = rows.column("_set").combine_chunks()
        flat, bounds = sets.flatten().to_numpy().view(_U), np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
        ask = np.flatnonzero(role & ASKED)
        earlier = np.full((len(ask), max((len(homes[k]) for k in ask), default=1)), node)
        for x, k in enumerate(ask):
            earlier[x, : len(homes[k])] = homes[k]
        asked_ids, asked_drawn, asked_size, now = ids[ask], drawn[ask], size[ask], component[ask].copy()
        root: dict[int, int] = {}
        found = []
        for k in np.flatnonzero(role & TOLD):
            own = _find(root, int(component[k]))
            open_ = np.flatnonzero((now != own) & (asked_ids != ids[k]) & (np.minimum(asked_size, size[k]) * 100 >= PERCENT * np.maximum(asked_size, size[k])))
            open_ = open_[(asked_drawn[open_] == drawn[k]).sum(1) >= ALIKE]
            if len(before := homes[k][homes[k] < node]) and len(open_):
                open_ = open_[~np.isin(earlier[open_], before).any(1)]
            for i in range(0, len(open_), 256):
                part = open_[i : i + 256]
                parts = [flat[bounds[x] : bounds[x + 1]] for x in ask[part]]
                values, mine = np.concatenate(parts), flat[bounds[k] : bounds[k + 1]]
                at = np.searchsorted(mine, values)
                at[at == len(mine)] = 0
                both = np.add.reduceat((mine[at] == values).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]]))
                for x in part[100 * both >= PERCENT * (asked_size[part] + size[k] - both)]:
                    if (other := _find(root, int(now[x]))) != own:
                        found.append((int(ids[k]), int(asked_ids[x])))
                        root[other] = own
                        now[now == other] = own
        return pa.table({c: pa.array([x[i] for x in found], pa.int64()) for i, c in enumerate("ab")})

    homes = groups.select("_id", "node").distinct().groupBy("_id").agg(F.array_sort(F.collect_set("node")).alias("homes"))
    placed = groups.join(homes, "_id").join(reps, "_id").join(sets, "_id")
    return placed.groupBy("group").applyInArrow(compare, "a long, b long")


def linked_parts(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Components (id, component) of the links between ``reps`` (_id, n_shingles, minwise); ``texts`` (_id, _text) has their texts."""
    spark, written = reps.sparkSession, []
    keep = lambda df, label: settle(df, label, written)
    ends = lambda pairs: pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct()
    placed = lambda rows: keep(with_components(rows, parts), "placed")

    sized = keep(with_size(roots(reps)), "roots")
    small, large = sized.filter(F.col("size") <= SMALL_NODE), sized.filter(F.col("size") > SMALL_NODE)
    # The same sets meet in many trees.
    same = small.groupBy("node").agg(F.array_sort(F.collect_set("_id")).alias("ids")).filter(F.size("ids") > 1).select("ids").distinct()
    small = keep(same.select(F.xxhash64("ids").alias("node"), F.explode("ids").alias("_id")), "small")
    pairs = keep(alike(small.unionByName(parts_of(large)), reps), "pairs")
    near = keep(ends(pairs), "near")
    sets = keep(full_sets(texts.join(near, "_id", "left_semi")), "sets")
    links = keep(confirmed(pairs, sets), "links")
    parts = components(links)

    # Large nodes of several components branch on, unless their sets are so alike that branching doesn't part them.
    deeper, wide = [], []
    for level in range(2, LEVELS + 2):
        if large.isEmpty():
            break
        state = keep(with_outside(placed(large.select("tree", "node", "_id", "parent"))), "large")
        alike_all = (F.col("outside") <= OUTSIDE) | F.coalesce(2 * F.col("size") > F.col("parent"), F.lit(False)) | F.lit(level > LEVELS)
        wide.append(state.filter(alike_all).select("node", "_id", "component", "top"))
        if level > LEVELS:
            break
        sized = keep(with_size(children(state.filter(~alike_all), reps, level)), "nodes")
        deeper.append(sized.filter(F.col("size") <= SMALL_DEEPER).select("node", "_id"))
        large = sized.filter(F.col("size") > SMALL_DEEPER)

    # What is still open, on full sets: small nodes of several components, as far as minwise values allow links, and large ones.
    open_nodes = [small.join(near, "_id", "left_semi").select("node", "_id")]
    if deeper:
        nodes = reduce(DataFrame.unionByName, deeper)
        also = ends(alike(undecided(placed(nodes)).select("node", "_id"), reps))
        open_nodes.append(nodes.join(also, "_id", "left_semi").select("node", "_id"))
    rows = undecided(placed(reduce(DataFrame.unionByName, open_nodes)))
    groups = rows.select(F.col("node").alias("group"), "node", "_id", "component", F.lit(ASKED | TOLD).alias("role"))
    if wide:
        groups = groups.unionByName(blocks_of(reduce(DataFrame.unionByName, wide), reps))
    groups = keep(groups, "groups")
    new = keep(groups.select("_id").distinct().join(near, "_id", "left_anti"), "near")
    if not new.isEmpty():
        sets = sets.unionByName(keep(full_sets(texts.join(new, "_id", "left_semi")), "sets"))
    more = keep(links_in_groups(groups, reps, sets), "links")
    if not more.isEmpty():
        parts = components(links.unionByName(more))
    discard(spark, written)
    return parts


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id, kept.

    ``component_id`` is the smallest id that links reach, the row's own
    included; ``kept`` marks the row that has it.  Defined cases: a null text,
    an empty one or one of white space has an empty set, links with nothing
    and is kept; a text of fewer than five words is one shingle; a null id is
    never linked and is kept; rows that repeat an id and its text are marked
    alike, rows that repeat an id with other texts each by the own text; an
    empty table gives an empty table; other columns are not looked at.
    """
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    drawn = settle(sketches(own), "sketches")
    named = drawn.filter("n_shingles > 0 and _id is not null")
    # Equal sets are one class; only its least id goes on.
    classes = named.groupBy("set_a", "set_b", "n_shingles").agg(F.min("_id").alias("rep"), F.first("minwise").alias("minwise"))
    classes = settle(classes, "classes")
    parts = linked_parts(classes.select(F.col("rep").alias("_id"), "n_shingles", "minwise"), own)
    known = classes.join(parts, classes.rep == parts.id, "left").select("set_a", "set_b", F.col("n_shingles").alias("_n"), F.coalesce("component", "rep").alias("component"))
    same = (drawn.set_a == known.set_a) & (drawn.set_b == known.set_b) & (drawn.n_shingles == known._n) & drawn._id.isNotNull()
    return drawn.drop("minwise").join(known, same, "left").select(
        F.col("_id").alias(id_col),
        "n_shingles",
        F.coalesce("component", "_id").alias("component_id"),
        F.coalesce(F.col("_id") == F.coalesce("component", "_id"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`near_copies` keeps, with all their columns."""
    dropped = near_copies(docs, id_col, text_col).filter("not kept").select(F.col(id_col).alias("_gone"))
    return docs.join(dropped, docs[id_col] == dropped["_gone"], "left_anti")
