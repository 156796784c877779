"""Near-duplicate vectors by lattice hashing.

Every table projects a vector on eight random directions and decodes the
result to the nearest point of the E8 lattice: its home cell.  It also visits
the neighbouring cells that lie nearest.  Two vectors meet where one visits
the other's home, and pairs that meet are verified by their cosine in double
precision.  Cells are compared as matrices in tasks of bounded size; what
leaves a task is a number of links for each vector and the edges of a
spanning forest, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, mixed, settle

THRESHOLD = 0.9
#: A pair at the threshold meets in one table with probability 0.5 at least (a
#: half by simulation at 64 dimensions), so it is missed by all with 1 in 1000 at most.
TABLES, PROBES = 10, 8
#: Width of a cell, in units of the length that eight of a unit vector's dimensions have on average.
WIDTH = 0.48
#: Rows of one side of a comparison; larger cells are cut to pieces that meet each other in tasks of their own.
PIECE = 2048
#: Rows of small cells that share a task.
SHARED = 4096
LATTICE = 8
SEED = 20240311
_U = np.uint64
#: Cosines so near to the threshold are computed again without rounding of sums.
_CLOSE = 1e-9


def _grid(x: np.ndarray, bits: int) -> np.ndarray:
    """``x`` in multiples of 2^-bits: products of such numbers add up without rounding, in any order."""
    return np.rint(x * (1 << bits)) / (1 << bits)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    near = np.rint(x)
    off = x - near
    odd = near.sum(-1).astype(np.int64) & 1 == 1
    worst = np.abs(off).argmax(-1)[..., None]
    step = np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0) * odd[..., None]
    np.put_along_axis(near, worst, np.take_along_axis(near, worst, -1) + step, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The E8 lattice points nearest to points of eight coordinates: the better one of D8 and of D8 shifted by a half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(-1) <= ((x - half) ** 2).sum(-1))[..., None], whole, half)


@cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of the lattice."""
    found = []
    for i, j in combinations(range(LATTICE), 2):
        for signs in product((1.0, -1.0), repeat=2):
            found.append(np.zeros(LATTICE))
            found[-1][[i, j]] = signs
    found += [np.array(x) for x in product((0.5, -0.5), repeat=LATTICE) if sum(v < 0 for v in x) % 2 == 0]
    return np.array(found)


@cache
def _directions(dim: int) -> np.ndarray:
    """Orthonormal directions of all tables, side by side, drawn for the dimension."""
    rng = np.random.default_rng([SEED, dim])
    wide = max(dim, LATTICE)
    drawn = [np.linalg.qr(rng.normal(size=(wide, LATTICE)))[0][:dim] for _ in range(TABLES)]
    return _grid(np.concatenate(drawn, 1), 20)


@cache
def _weights(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, 1]).integers(1, 1 << 63, (TABLES, LATTICE), dtype=np.uint64) * _U(2) + _U(1)


def cells(unit: np.ndarray) -> np.ndarray:
    """Hashes of the cells (vector, table, 1 + PROBES) of unit vectors, the home cell first.

    They depend on the vector alone, not on those beside it.
    """
    dim, out = unit.shape[1], np.zeros((len(unit), TABLES, 1 + PROBES), np.int64)
    width, around = WIDTH * math.sqrt(LATTICE / max(dim, LATTICE)), neighbours()
    hashed = lambda points: ((2 * points).astype(np.int64).view(_U) * _weights(dim)[:, None, :]).sum(-1, dtype=_U)
    for i in range(0, len(unit), 256):
        at = (_grid(unit[i : i + 256], 20) @ _directions(dim)).reshape(-1, TABLES, LATTICE) / width
        home = nearest_e8(at)
        towards = _grid(at - home, 30) @ around.T
        nearest = np.argpartition(-towards, PROBES, axis=-1)[..., :PROBES]
        points = np.concatenate([home[:, :, None], home[:, :, None] + around[nearest]], 2)
        out[i : i + 256] = mixed(hashed(points)).view(np.int64)
    return out


def _matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    """Vectors of one dimension as doubles; they are kept as floats where that loses nothing."""
    return np.array([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64) for v in vectors], np.float64).reshape(len(vectors), dim)


def _units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def packed(rows: DataFrame) -> DataFrame:
    """(_id, dim, vector) for (_id, _vec array<double>); dim is 0 for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            values = lists.flatten().fill_null(math.nan).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            dims, vectors = np.zeros(len(batch), np.int32), [b""] * len(batch)
            for dim in np.unique(sizes[sizes > 0]):
                own = np.flatnonzero(sizes == dim)
                m = values[starts[own][:, None] + np.arange(dim)] + 0.0
                good = np.isfinite(m).all(1) & (m != 0).any(1)
                own, m = own[good], m[good]
                with np.errstate(over="ignore"):
                    narrow = m.astype(np.float32)
                exact = (narrow == m).all(1)
                dims[own] = dim
                for k, row, short, fits in zip(own, m, narrow, exact):
                    vectors[k] = short.tobytes() if fits else row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims), pa.array(vectors, pa.binary())], ["_id", "dim", "vector"])

    return rows.mapInArrow(run, "_id long, dim int, vector binary")


def entries(classes: DataFrame) -> DataFrame:
    """(rep, h, table, cell, home): the home cell and the visited cells of each vector (rep, h, dim, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, h, dim = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for d in np.unique(dim):
                for own in np.array_split(np.flatnonzero(dim == d), 1 + len(dim) // 2048):
                    at = cells(_units(_matrix(batch.column(3).take(pa.array(own)).to_pylist(), d)))
                    each = TABLES * (1 + PROBES)
                    table = np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), 1 + PROBES), len(own))
                    home = np.tile(np.arange(1 + PROBES) == 0, TABLES * len(own))
                    cols = [np.repeat(rep[own], each), np.repeat(h[own], each), table, at.ravel()]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(home)], ["rep", "h", "table", "cell", "home"])

    return classes.select("rep", "h", "dim", "vector").mapInArrow(run, "rep long, h long, table int, cell long, home boolean")


def dealt(found: DataFrame) -> DataFrame:
    """Entries dealt to tasks: (group, rep, h, table, cell, home, told, asked).

    In each task every told vector (one at home) is compared with every asked
    one of its cell.  Cells in which nothing can meet are left out; small ones
    share tasks, large ones are cut to pieces, each of which meets all others.
    """
    tally = found.groupBy("table", "cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("n")).filter("homes > 0 and n > 1")
    shares = 1 + found.count() // SHARED
    cut = lambda n: F.ceil(F.col(n) / PIECE)
    rows = found.join(tally, ["table", "cell"]).select(*found.columns, cut("homes").alias("told_pieces"), cut("n").alias("asked_pieces"))
    small = (F.col("told_pieces") == 1) & (F.col("asked_pieces") == 1)
    one = rows.filter(small).select(F.pmod(F.xxhash64("cell"), F.lit(shares)).alias("group"), *found.columns, F.col("home").alias("told"), F.lit(True).alias("asked"))
    piece = lambda n: F.pmod(F.xxhash64("rep", "h", F.lit(n)), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    large = rows.filter(~small)
    told = large.filter("home").select(*found.columns, piece("told_pieces").alias("p"), upto("asked_pieces").alias("q"), F.lit(True).alias("told"), F.lit(False).alias("asked"))
    asked = large.select(*found.columns, piece("asked_pieces").alias("q"), upto("told_pieces").alias("p"), F.lit(False).alias("told"), F.lit(True).alias("asked"))
    many = told.unionByName(asked).select(F.xxhash64("table", "cell", "p", "q").alias("group"), *found.columns, "told", "asked")
    return one.unionByName(many)


def _first_meeting(a: np.ndarray, b: np.ndarray, reach: np.ndarray, table: int, cell: int) -> np.ndarray:
    """Which of the pairs (a, b) of indexes into ``reach`` meet in this cell of this table and in none before.

    A pair may meet in the homes of both: then the one with the smaller hash counts.
    """
    meets = lambda x, y, t: (reach[x, t] == reach[y, t, :1]).any(1)
    left = np.ones(len(a), bool)
    for t in range(table):
        on = np.flatnonzero(left)
        left[on] = ~(meets(a[on], b[on], t) | meets(b[on], a[on], t))
    on = np.flatnonzero(left)
    x, y = a[on], b[on]
    other = np.where(reach[x, table, 0] == cell, reach[y, table, 0], reach[x, table, 0])
    both = meets(x, y, table) & meets(y, x, table)
    left[on] = ~both | (cell <= other)
    return left


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Pairs out of (a, b), indexes below n, that connect all that these connect."""
    label, kept = np.arange(n), []
    while len(a):
        _, one = np.unique(label[a], return_index=True)
        root = list(range(n))
        for i in one:
            x, y = int(label[a[i]]), int(label[b[i]])
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                kept.append((int(a[i]), int(b[i])))
        step = np.array(root)
        while (step[step] != step).any():
            step = step[step]
        label = step[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return kept


def _linked(m: np.ndarray, unit: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a and b, indexes of vectors, that have the threshold's cosine at least."""
    cosine = unit[a] @ unit[b].T
    i, j = np.nonzero(cosine >= THRESHOLD - _CLOSE)
    good = np.ones(len(i), bool)
    for k in np.flatnonzero(cosine[i, j] <= THRESHOLD + _CLOSE):
        x, y = (v / np.abs(v).max() for v in (m[a[i[k]]], m[b[j[k]]]))
        good[k] = math.fsum(x * y) >= THRESHOLD * math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y))
    return a[i[good]], b[j[good]]


def links(groups: DataFrame) -> DataFrame:
    """(a, h, n, b): n more links of the vector (a, h), or an edge (a, b), for entries dealt to tasks with m, dim and vector.

    A pair counts where it meets first.  Where both are at home each is told
    about the other in turn; a visitor counts along with the one it visits.
    """

    def compare(rows: pa.Table) -> pa.Table:
        rep, h, table, cell, home, told, asked, many, dim = (
            rows.column(c).to_numpy() for c in ("rep", "h", "table", "cell", "home", "told", "asked", "m", "dim")
        )
        vectors = rows.column("vector").to_pylist()
        order = np.lexsort((cell, table, dim))
        change = (np.diff(cell[order]) != 0) | (np.diff(table[order]) != 0) | (np.diff(dim[order]) != 0)
        counts: dict[tuple[int, int], int] = {}
        edges: list[tuple[int, int]] = []
        for own in np.split(order, np.flatnonzero(change) + 1):
            a, b = np.flatnonzero(told[own]), np.flatnonzero(asked[own])
            if not len(a) or len(own) < 2:
                continue
            m = _matrix([vectors[k] for k in own], int(dim[own[0]]))
            unit = _units(m)
            x, y = _linked(m, unit, a, b)
            apart = (rep[own[x]] != rep[own[y]]) | (h[own[x]] != h[own[y]])
            x, y = x[apart], y[apart]
            if not len(x):
                continue
            with_links, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            reach = cells(unit[with_links])
            first = np.concatenate([
                _first_meeting(at[i : min(i + 50_000, len(x))], at[len(x) + i : len(x) + min(i + 50_000, len(x))], reach, int(table[own[0]]), int(cell[own[0]]))
                for i in range(0, len(x), 50_000)
            ])
            x, y = x[first], y[first]
            more = np.bincount(x, many[own[y]], len(own)) + np.bincount(y, np.where(home[own[y]], 0, many[own[x]]), len(own))
            for k in np.flatnonzero(more):
                key = (int(rep[own[k]]), int(h[own[k]]))
                counts[key] = counts.get(key, 0) + int(more[k])
            edges += [(int(rep[own[i]]), int(rep[own[j]])) for i, j in _forest(x, y, len(own))]
        none = [None] * len(edges)
        return pa.table({
            "a": pa.array([k[0] for k in counts] + [e[0] for e in edges], pa.int64()), "h": pa.array([k[1] for k in counts] + none, pa.int64()),
            "n": pa.array([*counts.values()] + none, pa.int64()), "b": pa.array([None] * len(counts) + [e[1] for e in edges], pa.int64()),
        })

    return groups.groupBy("group").applyInArrow(compare, "a long, h long, n long, b long")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row: id_col, n_links, component_id, kept.

    ``n_links`` counts the other rows whose vectors are linked directly; equal
    vectors are one class, whose members are linked with each other and with
    all that the class is linked with.  ``component_id`` is the least id that
    links reach, the own one included.  Defined cases: null, empty and zero
    vectors and those with null or non-finite components link with nothing;
    vectors of different dimensions are never linked; a row with a null id
    links with nothing and is kept; rows that repeat an id are rows like all
    others, each by its own vector; an empty table gives an empty table; other
    columns are not looked at.
    """
    spark, written = rows.sparkSession, []
    keep = lambda df, label: settle(df, label, written)
    own = packed(rows.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_vec")))
    own = own.withColumn("dim", F.when(F.col("_id").isNull(), 0).otherwise(F.col("dim")))
    own = keep(own.withColumns({"h": F.xxhash64("vector"), "h2": F.xxhash64("dim", "vector")}), "vectors")
    classes = own.filter("dim > 0").groupBy("h", "h2", "dim").agg(F.min("_id").alias("rep"), F.count("*").alias("m"), F.first("vector").alias("vector"))
    classes = keep(classes, "classes")
    placed = dealt(keep(entries(classes), "entries")).join(classes.select("rep", "h", "m", "dim", "vector"), ["rep", "h"])
    found = keep(links(placed), "links")
    counts = found.filter("n is not null").groupBy(F.col("a").alias("rep"), "h").agg(F.sum("n").alias("n"))
    parts = components(found.filter("b is not null").select("a", "b")).select(F.col("id").alias("rep"), "component")
    told = classes.drop("vector").join(counts, ["rep", "h"], "left").join(parts, "rep", "left").select(
        "h", "h2", "dim", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    marked = keep(own.drop("vector").join(told, ["h", "h2", "dim"], "left"), "marked")
    discard(spark, written[:-1])
    return marked.select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "_id").alias("component_id"),
        F.coalesce(F.col("_id") == F.coalesce("component", "_id"), F.lit(True)).alias("kept"),
    )
