"""Exact, near and line deduplication against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerlark.llm import exact_dedup, line_dedup, near_dedup
from ledgerlark.llm.common import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, fp long, kept string"  # extra columns with clashing names


def table(spark, rows):
    return spark.createDataFrame([(i, t, "xx", 1, "old") for i, t in rows], SCHEMA)


def edge_rows():
    return [(1, None), (2, ""), (3, "A b"), (4, "a B"), (5, "É x"), (6, "é x"), (7, "one two three four"), (8, "long " * 30_000), (9, "LONG " * 30_000), (None, "a b"), (3, "A b"), (10, "  \t ")]


def near_rows(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(25):
        base = rng.choices(words, k=rng.randint(3, 60))
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows) * 3 + 5, " ".join(own)))
    rng.shuffle(rows)
    return rows


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_exact_copies(spark):
    rows = edge_rows()
    got = exact_dedup.exact_copies(table(spark, rows)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(FOLD)].append(i)
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep if len(ids) > 1 else i, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    kept = exact_dedup.deduplicate(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "fp", "kept"]
    assert {r.doc_id for r in kept.collect()} == {w[0] for w in want if w[3]}
    assert exact_dedup.exact_copies(table(spark, []).limit(0)).count() == 0


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    parts = [rng.choice(values, 300) for _ in range(4)]
    filters = [exact_dedup.CountingQuotientFilter.of_counts(*np.unique(p, return_counts=True)) for p in parts]
    whole = exact_dedup.CountingQuotientFilter.merged([exact_dedup.CountingQuotientFilter.loaded(*f.dumped()) for f in filters])
    fps, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (whole.fingerprints() == fps).all() and (whole.counts == counts).all()
    again, many = whole.repeated()
    assert (again == fps[counts > 1]).all() and (many == counts[counts > 1]).all()


def test_fingerprint_collisions_are_verified(spark, monkeypatch):
    """With one fingerprint for all texts, the bytes alone decide."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "xxhash64", lambda *a: F.lit(7).cast("long"))
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_copies(table(spark, [(1, "a"), (2, "b"), (3, "A")])).collect()}
    assert got == {1: 3, 2: 2, 3: 3}


def test_shingle_sets():
    texts = [None, "", "a", "A b\tc", "x " * 4, "é É b c d e", "a b c d e f", "w" * 100_000, "a b c d e " * 2000]
    assert [len(x) for x in near_dedup.shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]


@pytest.mark.parametrize("sizes", [{}, {"SMALL_NODE": 2, "SMALL_DEEPER": 3, "OUTSIDE": 0}, {"SMALL_NODE": 3, "SMALL_DEEPER": 3, "OUTSIDE": 1, "ASKED_SHINGLES": 100, "TOLD_SHINGLES": 150, "LEVELS": 2}])
def test_near_copies(spark, monkeypatch, sizes):
    """Also with tiny nodes, so that branching, parts and groups of large nodes do the work."""
    for name, value in sizes.items():
        monkeypatch.setattr(near_dedup, name, value)
    rows = near_rows() + [(1, None), (2, ""), (3, " \t"), (None, "w1 w2 w3 w4 w5"), (4, "w1"), (900, "W1")]
    got = near_dedup.near_copies(table(spark, rows)).collect()
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {i: len(shingles(t)) for i, t in rows if i is not None}
    assert len(got) == len(rows)


def dense_rows(n, seed=3):
    """Copies of one text with more and more words changed, some of them below the threshold to all others, and texts that share a long passage only."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(5000)]
    base, passage = rng.choices(words, k=150), rng.choices(words, k=40)
    rows = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((k * 2 + 1, " ".join(own)))
        rows.append((k * 2 + 2, " ".join(rng.choices(words, k=60) + passage + rng.choices(words, k=20))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"SMALL_DEEPER": 48, "OUTSIDE": 2, "ASKED_SHINGLES": 2000, "TOLD_SHINGLES": 3000}])
def test_near_copies_in_large_nodes(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(near_dedup, name, value)
    rows = dense_rows(150)
    want = brute_components(rows)
    assert 150 < len(set(want.values())) < 240  # a large component, texts near it, and others
    assert {r.doc_id: r.component_id for r in near_dedup.near_copies(table(spark, rows)).collect()} == want


def test_chain_of_drifting_copies(spark):
    """Each text is near the next one only, and their ids jump about."""
    words = [f"c{k}" for k in range(500)]
    ids = random.Random(9).sample(range(1000), 60)
    rows = [(i, " ".join(words[4 * k : 4 * k + 60])) for k, i in enumerate(ids)]
    want = brute_components(rows)
    assert set(want.values()) == {min(ids)}
    assert {r.doc_id: r.component_id for r in near_dedup.near_copies(table(spark, rows)).collect()} == want


def test_near_copies_recall_on_a_query_set(spark, data):
    """Every document whose id is divisible by 20, against all."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.component_id for r in near_dedup.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in docs}
    links = [(i, j) for i in sets if i % 20 == 0 and sets[i] for j in sets if j != i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert all(got[i] == got[j] for i, j in links)


def test_near_copies_of_nothing(spark):
    assert near_dedup.near_copies(table(spark, []).limit(0)).count() == 0


def test_keep_one(spark):
    rows = near_rows(2)
    kept = near_dedup.keep_one(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "fp", "kept"]
    assert {r.doc_id for r in kept.collect()} == set(brute_components(rows).values())


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (None, 3), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def hostile_path():
    return [(0, 120)] + [(k, k - 1) for k in range(120, 61, -1)]


def random_path(n):
    ids = random.Random(1).sample(range(10**9), n)
    return list(zip(ids[:-1], ids[1:]))


@pytest.mark.parametrize("edges,rounds", [(hostile_path(), 12), (random_path(2000), 22), ([(0, k) for k in range(1, 3000)], 1), ([(9999, k) for k in range(3000)], 12)])
def test_components_take_few_rounds_whatever_the_ids(spark, monkeypatch, edges, rounds):
    from ledgerlark.llm import common

    seen = []
    settle = common.settle
    monkeypatch.setattr(common, "settle", lambda df, label, written=None: seen.append(label) or settle(df, label, written))
    got = common.components(spark.createDataFrame(edges, "a long, b long"), few=0).collect()
    ids = {x for e in edges for x in e}
    assert {r.id for r in got} == ids and {r.component for r in got} == {min(ids)}
    assert seen.count("joined") <= rounds


def test_components_by_rounds_and_by_one_task_agree(spark):
    rng = random.Random(6)
    edges = spark.createDataFrame([(rng.randrange(3000), rng.randrange(3000)) for _ in range(1200)], "a long, b long")
    by = [{r.id: r.component for r in components(edges, few).collect()} for few in (0, 200, 1 << 14)]
    assert by[0] == by[1] == by[2] and len(by[0]) > 1000
    assert components(edges.limit(0)).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, 6, 7), (2, "A", 5, 6, 7)], "doc_id long, text string, _sha string, _sha_own string, _keep long")
    assert [tuple(r) for r in exact_dedup.deduplicate(df).collect()] == [(2, "A", "5", "6", 7)]
    df = spark.createDataFrame([(1, "a b c d", 5), (2, "a b c d", 6)], "doc_id long, text string, _gone long")
    assert [tuple(r) for r in near_dedup.keep_one(df).collect()] == [(1, "a b c d", 5)]
    assert sorted(tuple(r) for r in line_dedup.drop_near_lines(df).collect()) == [(1, "a b c d", 5), (2, "", 6)]
    assert line_dedup.near_line_marks(df.limit(0)).count() == 0


def test_rows_that_repeat_an_id_lose_their_own_lines_only(spark):
    rows = [(1, "one two three four"), (2, "one two three five"), (2, "something else altogether here")]
    assert sorted(r.text for r in line_dedup.drop_near_lines(table(spark, rows)).collect()) == ["", "one two three four", "something else altogether here"]


def test_lines_of_few_words_compare_by_characters(spark):
    rows = [(1, "colour"), (2, "color"), (3, "home page"), (4, "home paga"), (5, "homepage"), (6, "abc"), (7, "abd"), (8, "home site"), (9, "x y z"), (10, "xyz!")]
    got = {r.doc_id: r.first_id for r in line_dedup.near_line_marks(table(spark, rows)).collect() if not r.keep}
    assert got == {2: 1, 4: 3, 5: 3}


def within_one(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def near_by_words_or_characters(a, b):
    few = [len(x) < line_dedup.LEAST_WORDS for x in (a, b)]
    if all(few):
        a, b = " ".join(a), " ".join(b)
        return a == b or min(len(a), len(b)) >= line_dedup.LEAST_CHARACTERS and within_one(list(a), list(b))
    return a == b or not any(few) and within_one(a, b)


def test_near_lines(spark):
    rng = random.Random(4)
    words = [f"v{k}" for k in range(50)]
    bases = [rng.choices(words, k=rng.randint(2, 14)) for _ in range(12)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            own = list(rng.choice(bases))
            act, at = rng.randrange(5), rng.randrange(len(own))
            if act == 0:
                own[at] = rng.choice(words)
            elif act == 1:
                del own[at]
            elif act == 2:
                own.insert(at, rng.choice(words))
            elif act == 3:
                own.append(rng.choice(words))
            lines.append(" ".join(own).upper() if rng.random() < 0.2 else "  ".join(own))
        rows.append((d, "\n".join(lines)))
    rows += [(50, None), (51, "\n\n"), (52, "z " * 5000)]
    every = [(i, p, line.lower().split()) for i, t in rows for p, line in enumerate((t or "").split("\n"))]
    want = {}
    for i, p, w in every:
        close = near_by_words_or_characters
        earlier = [(j, q) for j, q, v in every if w and (j, q) < (i, p) and close(w, v)]
        want[i, p] = min(earlier, default=None)
    got = {(r.doc_id, r.pos): (r.first_id, r.first_pos) if not r.keep else None for r in line_dedup.near_line_marks(table(spark, rows)).collect()}
    assert got == want
    cleaned = {r.doc_id: r.text for r in line_dedup.drop_near_lines(table(spark, rows)).collect()}
    for i, t in rows:
        assert cleaned[i] == (None if t is None else "\n".join(line for p, line in enumerate(t.split("\n")) if want[i, p] is None))


def test_short_lines_have_near_copies(spark):
    rows = [(1, "terms of use and more for all"), (2, "terms of use and less for all"), (3, "one two three four five six seven"), (4, "one two three four five six seven eight"),
            (5, "a b c"), (6, "a x c"), (7, "a b c d"), (8, "home page"), (9, "home site"), (10, "home page here")]
    got = {r.doc_id: r.first_id for r in line_dedup.near_line_marks(table(spark, rows)).collect() if not r.keep}
    assert got == {2: 1, 4: 3, 6: 5, 7: 5}


def test_lines_of_rows_without_an_id(spark):
    """Rows with a null id come first and share their places; each loses its own lines, told by its text."""
    base = "the quiet harbour keeps nine small boats"
    rows = [(None, f"{base} number {k}\nown line of row {k} with words {k * 7} and {k * k}\n{base} number x{k % 2}") for k in range(9)] + [(1, f"{base} number x\nkept")]
    df = table(spark, rows)
    marks = line_dedup.near_line_marks(df).collect()
    gone = sorted((r.doc_id is not None, r.pos) for r in marks if not r.keep)
    assert gone == [(False, 2)] * 9 + [(True, 0)]
    assert sorted(r.text for r in line_dedup.drop_near_lines(df).collect()) == sorted([t.rsplit("\n", 1)[0] for i, t in rows if i is None] + ["kept"])
