"""Merkle manifest of a dataset as a tree of SHA-256 midstates.

A node's children are hashed as hexadecimal text, so each child fills one
64-byte block of SHA-256 exactly and the state before each child slot is eight
words.  Parents retain a copy of that state for every slot.  Folding a
replaced leaf resumes the retained state of its slot with the replacement and
the siblings to its right only; what stands on its left is in the state.

Trees are cut to blocks of 3^``LEVELS`` leaves.  A block's levels are hashed in
one task, many nodes at once, and its root is a leaf of the next pass, so a
tree of n leaves takes log3 n / LEVELS passes, and no task holds more than a
block, however many rows a tree has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

ARITY, LEVELS = 3, 7
#: Leaves that a task hashes at once.
AT_ONCE = 1 << 15
#: Lanes of one call of the compression, whose working set then stays in the processor's cache.
LANES = 1 << 12
_U = np.uint32


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _root_bits(p: int, cube: bool) -> int:
    """The first 32 bits after the point of the square or cube root of ``p``."""
    if not cube:
        return isqrt(p << 64) & 0xFFFFFFFF
    lo, hi = 0, 1 << 40
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if mid**3 <= p << 96 else (lo, mid)
    return lo & 0xFFFFFFFF


START = np.array([_root_bits(p, False) for p in _primes(8)], _U)
_ROUND = [_U(_root_bits(p, True)) for p in _primes(64)]


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> _U(n)) | (x << _U(32 - n))


def compressed(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256 states (8, n) after blocks of 16 words (16, n), by FIPS 180-4."""
    if state.shape[1] > LANES:
        cuts = range(0, state.shape[1], LANES)
        return np.concatenate([compressed(state[:, i : i + LANES], block[:, i : i + LANES]) for i in cuts], 1)
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turned(x, 7) ^ _turned(x, 18) ^ (x >> _U(3))) + w[t - 7] + (_turned(y, 17) ^ _turned(y, 19) ^ (y >> _U(10))))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        new = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + (w[t] + _ROUND[t])
        h, g, f, e = g, f, e, d + new
        d, c, b, a = c, b, a, new + (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & (b | c)) | (b & c))  # noqa: PLW0642
    return state + np.stack([a, b, c, d, e, f, g, h])


def absorbed(state: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """States (n, 8) after the hexadecimal text of digests (n, 8 words)."""
    raw = np.ascontiguousarray(digests, ">u4").view(np.uint8)
    nibbles = np.stack([raw >> 4, raw & 15], 2).reshape(len(raw), 64)
    text = np.ascontiguousarray(nibbles + np.where(nibbles < 10, 48, 87).astype(np.uint8))
    return compressed(np.ascontiguousarray(state.T), np.ascontiguousarray(text.view(">u4").T.astype(_U))).T


def finished(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 8) of messages of so many whole blocks, from their states."""
    last = np.zeros((16, len(state)), _U)
    last[0], last[15] = 1 << 31, np.asarray(blocks) * 512
    return compressed(np.ascontiguousarray(state.T), last).T


def words(digests: list[bytes]) -> np.ndarray:
    """Binary digests as rows of eight words."""
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 8).astype(_U)


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, ">u4").view(np.uint8).reshape(len(x), 32)


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of eight words as binary digests."""
    return pa.array([row.tobytes() for row in _bytes(x)], pa.binary())


def height(n: Column, most: int) -> Column:
    """Levels above ``n`` leaves until one node is left, at most ``most``."""
    return sum((F.when(n > ARITY**k, 1).otherwise(0) for k in range(most)), F.lit(0))


def hashed_levels(block: np.ndarray, place: np.ndarray, digest: np.ndarray, levels: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The levels of many blocks together, from their leaves: (block, place, digest, retained state, has a parent).

    ``levels`` has the number of levels by block.  Rows are ordered by block
    and place.  A node without a parent in its block is the block's root.
    """
    level = 0
    while len(block):
        state = np.zeros((len(block), 8), _U)
        up = levels[block] > level
        own = np.flatnonzero(up)
        first = own[place[own] % ARITY == 0]
        size = np.diff(np.append(np.flatnonzero(place[own] % ARITY == 0), len(own)))
        now = np.repeat(START[None], len(first), 0)
        for slot in range(ARITY):
            has = size > slot
            state[first[has] + slot] = now[has]
            now[has] = absorbed(now[has], digest[first[has] + slot])
        yield block, place, digest, state, up
        block, place, digest = block[first], place[first] // ARITY, finished(now, size)
        level += 1


def _build(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.asarray(batch.column(4).value_lengths(), np.int64)
        lot = np.cumsum(sizes) // AT_ONCE
        for k in np.unique(lot):
            part = batch.take(pa.array(np.flatnonzero(lot == k)))
            n, rows = np.asarray(part.column(4).value_lengths(), np.int64), part.column(4).flatten()
            block, place = np.repeat(np.arange(len(n)), n), rows.field(0).to_numpy() % span
            order = np.lexsort((place, block))
            nodes, states, roots = [[] for _ in n], [[] for _ in n], np.zeros((len(n), 8), _U)
            for b, _, digest, state, up in hashed_levels(block, place[order], words(rows.field(1).to_pylist())[order], part.column(3).to_numpy()):
                roots[b[~up]] = digest[~up]
                b, digest, state = b[up], _bytes(digest[up]), _bytes(state[up])
                edges = np.searchsorted(b, np.arange(len(n) + 1))
                for i in np.unique(b):
                    nodes[i].append(digest[edges[i] : edges[i + 1]].tobytes())
                    states[i].append(state[edges[i] : edges[i + 1]].tobytes())
            joined = [pa.array([b"".join(x) for x in lists], pa.binary()) for lists in (nodes, states)]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(n, pa.int32()), *joined, _binary(roots)], ["tree", "block", "n", "levels", "leaves", "nodes", "states", "root"])


BLOCK = "tree string, block long, n long, levels int, leaves int, nodes binary, states binary, root binary"


@dataclass
class Forest:
    """Trees as tables of blocks of ``span`` leaves, a table for each pass from the leaves up, and ``roots`` (tree, digest)."""

    passes: list[DataFrame]
    roots: DataFrame
    span: int


def build(leaves: DataFrame, label: str, levels: int = LEVELS) -> Forest:
    """The forest of ``leaves`` (tree string, pos long from 0, n long leaves of the tree, digest binary).

    Only whether another pass is needed reaches the driver.
    """
    passes, roots, rows, span = [], [], leaves, ARITY**levels
    while True:
        each = rows.groupBy("tree", F.floor(F.col("pos") / span).alias("block"), "n").agg(F.collect_list(F.struct("pos", "digest")).alias("rows"))
        n_blocks = F.ceil(F.col("n") / span)
        made = settle(each.select("tree", "block", "n", height(F.col("n"), levels).cast("int").alias("levels"), "rows").mapInArrow(lambda x: _build(x, span), BLOCK), label)
        passes.append(made)
        roots.append(made.filter(n_blocks == 1).select("tree", F.col("root").alias("digest")))
        rows = made.filter(n_blocks > 1).select("tree", F.col("block").alias("pos"), n_blocks.cast("long").alias("n"), F.col("root").alias("digest"))
        if rows.isEmpty():
            break
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return Forest(passes, out, span)


#: Bytes of a level of a path: the slot, the number of children, the retained state and up to two siblings.
STEP = 2 + 32 + 32 * (ARITY - 1)


def _block_paths(leaves: int, levels: int, nodes: bytes, states: bytes) -> np.ndarray:
    """(leaves, levels, STEP): the way up of every leaf of a block."""
    out, place, count, base = np.zeros((leaves, levels, STEP), np.uint8), np.arange(leaves), leaves, 0
    digest, state = (np.frombuffer(x, np.uint8).reshape(-1, 32) for x in (nodes, states))
    for k in range(levels):
        first = place // ARITY * ARITY
        slot, size = place - first, np.minimum(ARITY, count - first)
        out[:, k, 0], out[:, k, 1], out[:, k, 2:34] = slot, size, state[base + place]
        for j in range(ARITY - 1):
            has = np.flatnonzero(size > j + 1)
            other = first[has] + j + (j >= slot[has])
            out[has, k, 34 + 32 * j : 66 + 32 * j] = digest[base + other]
        base, place, count = base + count, place // ARITY, -(-count // ARITY)
    return out


def paths(passes: list[DataFrame], span: int) -> DataFrame | None:
    """(tree, pos, path): the way up of each leaf of the first of ``passes``, through all of them; None without passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, block, *own in zip(*(c.to_pylist() for c in batch.columns)):
                steps = _block_paths(*own)
                pos = pa.array(np.arange(len(steps)) + block * span, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(steps), pa.string()), pos, pa.array([x.tobytes() for x in steps], pa.binary())], ["tree", "pos", "path"])

    above = None
    for made in reversed(passes):
        own = made.select("tree", "block", "leaves", "levels", "nodes", "states").mapInArrow(run, "tree string, pos long, path binary")
        if above is not None:
            upper = above.select("tree", F.col("pos").alias("block"), F.col("path").alias("upper"))
            own = own.withColumn("block", F.floor(F.col("pos") / span)).join(upper, ["tree", "block"], "left")
            own = own.select("tree", "pos", F.concat("path", F.coalesce("upper", F.lit(b""))).alias("path"))
        above = own
    return above


def climbed(digest: np.ndarray, steps: np.ndarray, proof: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests (n, 8) after the levels of ``steps`` (n, levels, STEP), and states of the siblings' hash; ``told`` counts its blocks and is changed."""
    for k in range(steps.shape[1]):
        at = steps[:, k]
        slot, size = at[:, 0].astype(np.int64), at[:, 1].astype(np.int64)
        word = lambda i: np.ascontiguousarray(at[:, i : i + 32]).view(">u4").astype(_U)  # noqa: B023, E731
        state = absorbed(word(2), digest)
        for j in range(ARITY - 1):
            sibling = word(34 + 32 * j)
            has = size > j + 1
            proof[has] = absorbed(proof[has], sibling[has])
            told[has] += 1
            right = has & (j >= slot)
            state[right] = absorbed(state[right], sibling[right])
        digest = finished(state, size)
    return digest, proof


def fold(rows: DataFrame, forest: Forest, above: DataFrame, carried: dict[str, str]) -> DataFrame:
    """(tree, *carried, folded, proof, subroot, root): the root that each replaced leaf leads to, and the hash of its siblings.

    ``rows``: tree, pos, replacement (a digest) and the carried columns, by
    name and type; each leaf is replaced by itself, and in one row at most.
    ``above`` (tree, path, subroot, root) leads on from the trees' roots.
    """
    span, upper = forest.span, paths(forest.passes[1:], forest.span)
    blocks = forest.passes[0].select("tree", "block", "leaves", "levels", "nodes", "states")
    if upper is not None:
        blocks = blocks.join(upper.select("tree", F.col("pos").alias("block"), "path"), ["tree", "block"], "left")
    else:
        blocks = blocks.withColumn("path", F.lit(None).cast("binary"))
    blocks = blocks.join(above.select("tree", F.col("path").alias("top"), "subroot", "root"), "tree").withColumn("top", F.concat(F.coalesce("path", F.lit(b"")), "top"))
    asked = rows.groupBy("tree", F.floor(F.col("pos") / span).alias("block")).agg(F.collect_list(F.struct("pos", "replacement", *carried)).alias("rows"))
    both = asked.join(blocks, ["tree", "block"]).select("tree", "rows", "leaves", "levels", "nodes", "states", "top", "subroot", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                part = batch.slice(i, 1)
                own = part.column(1).flatten()
                tree, _, *block, top, subroot, root = (None if c is part.column(1) else c[0].as_py() for c in part.columns)
                at = own.field(0).to_numpy() % span
                proof, told = np.repeat(START[None], len(own), 0), np.zeros(len(own), np.int64)
                digest = words(own.field(1).to_pylist())
                digest, proof = climbed(digest, _block_paths(*block)[at], proof, told)
                rest = np.frombuffer(top, np.uint8).reshape(1, -1, STEP)
                digest, proof = climbed(digest, np.repeat(rest, len(own), 0), proof, told)
                kept = [own.field(2 + k) for k in range(len(carried))]
                ends = [pa.array([x] * len(own), pa.binary()) for x in (subroot, root)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(own), pa.string()), *kept, _binary(digest), _binary(finished(proof, told)), *ends], ["tree", *carried, "folded", "proof", "subroot", "root"]
                )

    kinds = ", ".join(f"{name} {kind}" for name, kind in carried.items())
    return both.mapInArrow(run, f"tree string, {kinds}, folded binary, proof binary, subroot binary, root binary")


def ranked(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with pos, their place within ``tree`` by ``order``, and n, the tree's number of rows.

    Rows are sorted by ranges over all tasks; places come from their place in
    the range and the counts of the ranges before, so no tree is in one task.
    """
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = settle(dealt, label).withColumn("_part", F.shiftright("_at", 33))
    runs = dealt.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("tree")
    runs = runs.select("tree", "_part", (F.sum("_n").over(whole.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_before"), F.sum("_n").over(whole).alias("n"))
    return dealt.join(runs, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_before")).drop("_at", "_part", "_before")


def field(value: Column, text: bool) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; ``-`` if null."""
    value = value if text else value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


FIELDS = {"doc_id": False, "source": True, "lang": True, "n_chars": False, "text": True}


def leaf_hash(text: Column) -> Column:
    """The digest of a row of documents with this text."""
    return F.unhex(F.sha2(F.concat(*(field(text if c == "text" else F.col(c), kind) for c, kind in FIELDS.items())).cast("binary"), 256))


def manifest(docs: DataFrame, replaced_text: Column, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, lang, n_chars, text): its place in the manifest, and the fold of its replacement.

    Each row is a leaf of its source's tree, ordered by doc_id; the sources'
    roots, ordered by source, are the leaves of the root's tree.  The leaf with
    ``replaced_text`` for its text is folded up to the root.  Returns doc_id,
    leaf, subroot, root, proof_sha256, folded_root and verified.  Defined
    cases: a null source is a source of its own and comes first, a null id
    comes first within its source; rows that repeat an id are leaves of their
    own, ordered by their digests; null fields hash as ``-`` and stay apart
    from empty ones; a single leaf is its tree's root; an empty table gives an
    empty table; other columns are not looked at.
    """
    own = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"), leaf_hash(F.col("text")).alias("digest"),
        leaf_hash(replaced_text).alias("replacement"), F.monotonically_increasing_id().alias("_tie"),
    )
    leaves = settle(own, "leaves")
    placed = settle(ranked(leaves, ["doc_id", "digest", "_tie"], "sorted").drop("_tie"), "placed")
    sources = build(placed.select("tree", "pos", "n", "digest"), "blocks", levels)
    tops = ranked(sources.roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), ["source"], "subroots")
    top = build(tops.select("tree", "pos", "n", "digest"), "top", levels)
    # The top tree alone has the empty name, and so one root.
    root = F.broadcast(top.roots.select("tree", F.col("digest").alias("root")))
    above = tops.join(paths(top.passes, top.span), ["tree", "pos"]).join(root, "tree")
    above = settle(above.select(F.col("source").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "above")
    carried = {"doc_id": "bigint", "digest": "binary"}
    folded = fold(placed.select("tree", "pos", "replacement", *carried), sources, above, carried)
    text = lambda c: F.lower(F.hex(c))
    return folded.select(
        "doc_id", text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), text("proof").alias("proof_sha256"),
        text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
