"""Lattice hashing, spelling variants and the Merkle manifest against brute force."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import lattice_dedup, merkle, spelling
from ledgerlark.llm.queries import QUERIES

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


# Lattice hashing

VECTORS = "vec_id long, embedding array<double>, label int, h long, n string, cell long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], VECTORS)


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute_links(rows):
    """(id, n_links, component, kept) of each row."""
    unit = [np.array(v) / np.abs(v).max() if i is not None and usable(v) else None for i, v in rows]
    unit = [u if u is None else u / np.linalg.norm(u) for u in unit]
    n, root = [0] * len(rows), {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            if unit[x] is not None and unit[y] is not None and len(unit[x]) == len(unit[y]) and unit[x] @ unit[y] >= 0.9:
                n[x], n[y] = n[x] + 1, n[y] + 1
                a, b = find(rows[x][0]), find(rows[y][0])
                root[max(a, b)] = min(a, b)
    return sorted(((i, n[k], i if unit[k] is None else find(i), unit[k] is None or find(i) == i) for k, (i, _) in enumerate(rows)), key=str)


def found_links(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def around(rng, base, cosine, n):
    noise = rng.normal(size=(n, len(base)))
    noise -= np.outer(noise @ base, base) / (base @ base)
    return cosine * base + np.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise, axis=1)[:, None] * np.linalg.norm(base)


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, own = [], rng.normal(size=(120, 64))
    for k, base in enumerate(own):
        rows.append(base)
        rows += [*around(rng, base, 0.97, 3 * (k % 3))]
    rows += [own[0]] * 5 + [3 * own[1], -own[2]]
    rows = [(7 * i % 10007 + 3, [float(x) for x in v]) for i, v in enumerate(rows)]
    assert found_links(lattice_dedup.near_vectors(vectors(spark, rows).repartition(5))) == brute_links(rows)


def test_links_in_pieces(spark, monkeypatch):
    """A dense group is cut to pieces of 16 that meet each other; each pair counts once."""
    monkeypatch.setattr(lattice_dedup, "PIECE", 16)
    monkeypatch.setattr(lattice_dedup, "SHARED", 64)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([around(rng, np.ones(16), 0.985, 150), rng.normal(size=(50, 16))]))]
    assert found_links(lattice_dedup.near_vectors(vectors(spark, rows))) == brute_links(rows)


def test_link_edges(spark):
    rows = [
        (1, None), (2, []), (3, [0.0] * 8), (4, [1.0, None] + [0.0] * 6), (5, [float("nan")] + [1.0] * 7), (6, [float("inf")] + [1.0] * 7),
        (7, [1.0] * 8), (8, [2.0] * 8), (None, [1.0] * 8), (9, [1.0] * 8), (9, [1.0] * 8), (10, [1.0] * 4), (11, [1e300] * 4), (12, [-0.0, 1.0]), (13, [0.0, 1.0]), (14, [1e-300, 0.0]), (15, [5.0]), (15, [-5.0]),
    ]
    got = found_links(lattice_dedup.near_vectors(vectors(spark, rows)))
    assert got == brute_links(rows)
    empty = lattice_dedup.near_vectors(vectors(spark, rows).limit(0))
    assert empty.columns == ["vec_id", "n_links", "component_id", "kept"] and not empty.collect()


def test_recall_at_the_threshold():
    """Of pairs at cosine 0.9, all but one in 500 meet in a table, where either visits the home of the other."""
    rng = np.random.default_rng(7)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = np.array([around(rng, v, 0.9, 1)[0] for v in a])
    x, y = lattice_dedup.cells(a), lattice_dedup.cells(b / np.linalg.norm(b, axis=1)[:, None])
    met = (x == y[..., :1]) | (y == x[..., :1])
    assert met.any((1, 2)).mean() > 0.998
    assert np.array_equal(lattice_dedup.cells(a[100:101]), x[100:101])  # whatever stands beside a vector


def test_nearest_lattice_points():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8)) * 2
    near = lattice_dedup.nearest_e8(x)
    whole = (2 * near) % 2 == 0
    assert (whole.all(1) | ~whole.any(1)).all() and (near.sum(1) % 2 == 0).all()
    assert len(lattice_dedup.neighbours()) == 240
    others = near[:, None] + lattice_dedup.neighbours()[None]
    assert (((x[:, None] - others) ** 2).sum(2).min(1) >= ((x - near) ** 2).sum(1) - 1e-12).all()


# Spelling variants

WORDS = "doc_id long, text string, word string, n string, form long"


def brute_variants(rows, typo_in=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % typo_in == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    near = defaultdict(set)
    by_variant = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            by_variant[k, w[:k] + w[k + 1 :]].add(w)
            if (shorter := w[:k] + w[k + 1 :]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in by_variant.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, k in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 5 * k:
            form[w] = best
    rows = []
    for w, k in n.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, k, len(near[w]), n.get(form.get(w))))
    return sorted(rows)


def found_variants(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def spelling_docs(spark, rows):
    return spark.createDataFrame([(i, t, "w", "n", 1) for i, t in rows], WORDS)


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    letters = "abcdeéçÉ"
    words = ["".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(60)]
    for _ in range(200):
        w = list(rng.choice(words))
        at = rng.randrange(len(w))
        w[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "É"])
        words.append("".join(w))
    rows = []
    for k, w in enumerate(words):
        for _ in range(rng.choice([1, 5, 6, 30, 160])):
            rows.append((rng.randrange(40), f"{w.upper() if rng.random() < 0.3 else w}, 12 {rng.choice(words)}"))
    assert found_variants(spelling.variants(spelling_docs(spark, rows), typo_in=11)) == brute_variants(rows, 11)


def test_variants_of_a_dense_chunk(spark, monkeypatch):
    """Thousands of words share each half, so keys are cut until one place is left; forms chain."""
    rng = random.Random(4)
    words = {f"common{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in ["", *"abcdefgh"]} | {f"{a}{b}{c}ending" for a in "abcdefgh" for b in "abcdefgh" for c in ["", *"xyz"]}
    rows = [(k, " ".join([w] * rng.choice([5, 5, 25, 125, 625]))) for k, w in enumerate(sorted(words))]
    cut = []
    finer = spelling._finer
    monkeypatch.setattr(spelling, "_finer", lambda rows: cut.append(1) or finer(rows))
    monkeypatch.setattr(spelling, "PAIRS_A_WORD", 4)
    assert found_variants(spelling.variants(spelling_docs(spark, rows))) == brute_variants(rows)
    assert len(cut) > 1


def test_variant_edges(spark):
    rows = [(None, "abcdefg " * 9), (1, None), (2, ""), (3, "short tiny " * 9), (4, "ABCDEFG abcdefh× " * 3), (4, "ABCDEFG abcdefh× " * 3), (5, "y" * 50_000 + " "), (6, ("z" * 3000 + " ") * 5 + ("z" * 2999 + "y ") * 30)]
    assert found_variants(spelling.variants(spelling_docs(spark, rows))) == brute_variants(rows)
    empty = spelling.variants(spelling_docs(spark, rows).limit(0))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and not empty.collect()


# Merkle manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos string, root long, digest string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    tell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*map(tell, (*row[:4], text)))


def climb(nodes):
    """The levels of a tree, from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def brute_manifest(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in by_source[s].sort(key=lambda x: x[:3]) or by_source[s]]) for s in names}
    top = climb([trees[s][-1][0] for s in names]) if names else []
    out = []
    for at, s in enumerate(names):
        for k, (_, _, own, r) in enumerate(by_source[s]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            fold, siblings = leaf(r, r[4].replace("\n", "")) if tampered else own, []
            for levels, place in ((trees[s], k), (top, at)):
                for level in levels[:-1]:
                    run = level[place // 3 * 3 : place // 3 * 3 + 3]
                    siblings += run[: place % 3] + run[place % 3 + 1 :]
                    fold = sha(*run[: place % 3], fold, *run[place % 3 + 1 :])
                    place //= 3
            out.append((r[0], own, trees[s][-1][0], top[-1][0], sha(*siblings), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def found_manifest(spark, rows, **settings):
    docs = spark.createDataFrame([(*r, "t", "p", 1, "d") for r in rows], DOCS).repartition(5)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = merkle.manifest(docs, F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text")), **settings)
    return sorted(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def documents(n, sources, seed=1):
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n), n)
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([i, None]), rng.choice([f"a\nb {i}", f"é{i}", None, ""])) for i in ids]


@pytest.mark.parametrize("n, sources", [(1, ["a"]), (1, [None]), (4, ["a"]), (40, ["a", "b", None, "", "é", "z", "Z"]), (120, [f"s{k}" for k in range(29)]), (28, ["a", "b"])])
def test_manifest_equals_brute_force(spark, n, sources):
    rows = documents(n, sources, n)
    assert found_manifest(spark, rows) == brute_manifest(rows)


def test_manifest_of_several_passes(spark):
    """Blocks of nine leaves: 300 leaves of one source take three passes, and its root's tree two."""
    rows = documents(300, ["hot"], 2) + [(-k, f"s{k}", None, None, "x\ny") for k in range(1, 14)]
    assert found_manifest(spark, rows, levels=2) == brute_manifest(rows)


def test_manifest_edges(spark):
    rows = [(1, "a", "en", 3, "x\n"), (1, "a", "en", 3, "x\n"), (1, "a", "en", 4, "y"), (None, "a", None, None, None), (None, None, "-", 0, "1:-"), (2, "", "", 0, ""), (3, "a", "en", 1, "long\n" * 60_000)]
    assert found_manifest(spark, rows) == brute_manifest(rows)
    assert found_manifest(spark, []) == []


def test_compression_equals_the_library():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 1 << 32, (50, 8), dtype=np.uint64).astype(np.uint32)
    text = [merkle._bytes(digests[k : k + 1])[0].tobytes().hex() for k in range(50)]
    one = merkle.absorbed(np.repeat(merkle.START[None], 50, 0), digests)
    two = merkle.absorbed(one, digests[::-1])
    for state, n in ((one, 1), (two, 2)):
        got = merkle.finished(state, np.full(50, n))
        assert [merkle._bytes(got[k : k + 1])[0].tobytes().hex() for k in range(50)] == [sha(text[k], *[text[49 - k]] * (n - 1)) for k in range(50)]


def test_registered_queries(spark, data):
    import pyarrow.parquet as pq

    docs = pq.read_table(f"{data}/documents.parquet").to_pylist()
    rows = [(d["doc_id"], d["source"], d["lang"], d["n_chars"], d["text"]) for d in docs]
    got = QUERIES["op13_merkle_manifest"](spark, data)
    assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows)
    assert found_variants(QUERIES["op12_spelling_variants"](spark, data)) == brute_variants([(d["doc_id"], d["text"]) for d in docs])
    embeddings = pq.read_table(f"{data}/embeddings.parquet").to_pylist()
    assert found_links(QUERIES["op11_lattice_near_dedup"](spark, data)) == brute_links([(e["vec_id"], e["embedding"]) for e in embeddings])
