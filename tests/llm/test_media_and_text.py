"""Media columns, packing, mixing, revisits, extraction and the trained scores."""

import datetime as dt
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import html_extract, lm_score, media, mixing, packing, queries, toxicity, warc

TOKENIZER = queries.word_tokenizer_path()


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 9) for i, t, s in rows], "doc_id long, text string, source string, epoch int")


EDGE = [(1, None, "a"), (2, "", "a"), (3, "Ünïcode ß text 123!", None), (4, "word " * 9000, "b"), (None, "no id", "b"), (3, "Ünïcode ß text 123!", None), (5, "x" * 3000, "c")]


def test_wav_round_trip(spark, data):
    kept = documents(spark, EDGE).select("doc_id", media.payload(F.col("text")).alias("payload"))
    rows = media.with_features(media.with_wav(kept)).collect()
    assert len(rows) == len(EDGE)
    for r, (_, text, _) in zip(sorted(rows, key=lambda r: str(r.samples)), sorted(EDGE, key=lambda x: str(bytearray(padded(x[1]))))):
        assert bytes(r.samples) == padded(text) and r.sample_rate == media.RATE
        assert media.wav_samples(bytes(r.media))[0] == padded(text)


def padded(text):
    raw = (text or "").encode()
    return raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))


def test_peaks_of_a_tone():
    t = np.arange(8 * media.FRAME)
    tone = (128 + 100 * np.sin(2 * np.pi * 20 * t / media.FRAME)).astype(np.uint8)
    marks = media.fingerprint(tone.tobytes())
    assert len(marks) and {(m >> 20) & 0xFFF for m in marks.tolist()} == {20} and {(m >> 8) & 0xFFF for m in marks.tolist()} == {20}
    assert (marks == media.fingerprint(tone.tobytes())).all()
    long = np.tile(tone, 300)  # more frames than are transformed at once
    assert len(media.spectral_peaks(long)[0]) == -(-(len(long) - media.FRAME) // media.HOP) + 1


def test_short_recordings_have_fingerprints_of_their_own():
    rng = random.Random(8)
    for size in (192, 384, 576):
        marks = {tuple(media.fingerprint(bytes(rng.choices(range(32, 123), k=size))).tolist()) for _ in range(200)}
        assert len(marks) == 200 and all(marks)
    assert len(media.fingerprint(b"")) == 0 and len(media.fingerprint(bytes(rng.choices(range(256), k=media.FRAME))))


def test_peaks_of_both_bands_are_paired():
    t = np.arange(8 * media.FRAME)
    chord = lambda low, high: (128 + 60 * np.sin(2 * np.pi * low * t / media.FRAME) + 50 * np.sin(2 * np.pi * high * t / media.FRAME)).astype(np.uint8).tobytes()
    pairs = {((m >> 20) & 0xFFF, (m >> 8) & 0xFFF, m & 0xFF) for m in media.fingerprint(chord(5, 20)).tolist()}
    assert pairs == {(5, 20, 0)} | {(a, b, d) for a in (5, 20) for b in (5, 20) for d in (1, 2)}
    one_frame = media.fingerprint(chord(5, 20)[: media.FRAME])
    assert [((m >> 20) & 0xFFF, (m >> 8) & 0xFFF, m & 0xFF) for m in one_frame.tolist()] == [(5, 20, 0)]


def test_op2_columns(spark, data):
    for r in queries.op2_media_columns(spark, data).limit(20).collect():
        assert r.payload_bytes % 192 == 0 and r.payload_bytes >= max(r.n_bytes, 192) and len(r.media_sha256) == 64
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op2_media_columns(spark, data).collect():
        raw = padded(docs[r.doc_id])
        assert r.payload_sha256 == hashlib.sha256(raw).hexdigest() and r.tail_crc32 == zlib.crc32(raw[-16:])


def test_words_encode_like_the_tokenizer():
    own = packing.WordTokenizer(TOKENIZER)
    rng = random.Random(5)
    letters = "abcXYZéÉßñÑ ÿŸİıſǅ'.,!?#$%&*<|>-_0123½²ªº́̈­​　\xa0\x85\x1c\x00中文日本αΣςЖ🙂\n\t"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["it's We'Re i'm'd 'S", "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|>", "x" * 500, "Ab" * 150 + "é"]
    for t in texts:
        assert list(own.encode(t)) == own.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def check_packing(pieces, texts):
    own = packing.WordTokenizer(TOKENIZER).tokenizer
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for doc_id, text in texts.items():
        ids = np.array(own.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for p in sorted(by_doc.pop(doc_id), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert not by_doc
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0


def test_packing_is_whole_and_without_padding(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    check_packing(packing.pack(docs.repartition(5), TOKENIZER).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_packing_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "word " * 9000, "b"), (None, "no id", "b")]
    check_packing(packing.pack(documents(spark, rows), TOKENIZER).collect(), {i: t for i, t, _ in rows})
    twice = packing.pack(documents(spark, rows[2:3] * 2), TOKENIZER).collect()
    assert sum(p.length for p in twice) == 2 * twice[0].doc_tokens
    assert packing.pack(documents(spark, rows).limit(0), TOKENIZER).count() == 0


def test_mixing_keeps_to_budgets(spark):
    rows = [(k, "w " * (1 + k % 7), "big" if k % 10 else f"s{k % 30}") for k in range(600)]
    used = mixing.mix(documents(spark, rows), entropy_share=0.9, max_repetition=3.0).collect()
    tokens = defaultdict(int)
    for _, text, s in rows:
        tokens[s] += len(text.split())
    spent = defaultdict(int)
    for r in used:
        spent[r._source] += r._tokens
    p = np.array([tokens[s] for s in sorted(tokens)], float)
    q = (p / p.sum()) ** used[0].exponent
    q /= q.sum()
    # The entropy asked for, unless the limit on repetition stops short of it.
    assert -(q * np.log(q)).sum() >= 0.9 * np.log(len(q)) - 1e-4 or (q * p.sum() / p).max() > 3 - 1e-3
    assert (q * p.sum() / p).max() <= 3 + 1e-6
    for s, w in zip(sorted(tokens), q):
        budget = min(int(w * p.sum()), 3 * tokens[s])
        assert budget - 7 <= spent[s] <= budget
        passes = defaultdict(set)
        for r in used:
            if r._source == s:
                assert r.doc_id not in passes[r.epoch]
                passes[r.epoch].add(r.doc_id)
        assert all(len(passes[e]) == sum(x[2] == s for x in rows) for e in passes if e < max(passes))


def test_mixing_edge_rows(spark):
    got = mixing.mix(documents(spark, EDGE), entropy_share=0.5, max_repetition=2.0).collect()
    assert {r.doc_id for r in got} <= {1, 2, 3, 4, 5, None}
    assert mixing.mix(documents(spark, EDGE).limit(0)).count() == 0
    assert mixing.mixed_documents(documents(spark, EDGE)).columns == ["doc_id", "text", "source", "epoch"]


def test_mixing_keeps_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 9, 0.5), (2, "c d", "s", 8, 0.25)], "doc_id long, text string, source string, epoch int, weight double")
    assert {tuple(r) for r in mixing.mixed_documents(docs).collect()} == {tuple(r) for r in docs.collect()}


def test_header_names_in_any_case(spark):
    rows = [(1, "http://a.com", dt.datetime(2024, 1, 1), "response", {"ETag": '"1"', "etag": "other"}, "p", 1), (2, "http://a.com", dt.datetime(2024, 1, 2), "revisit", {"Etag": '"1"'}, None, 2),
            (2, "http://a.com", dt.datetime(2024, 1, 2), "revisit", {"Etag": '"1"'}, None, 2)]
    df = spark.createDataFrame(rows, "record_id long, url string, captured timestamp, kind string, headers map<string,string>, payload_ref string, status long")
    assert [(r.record_id, r.status, r.headers) for r in warc.resolve_revisits(df).collect()] == [(2, "resolved", {"etag": '"1"'})] * 2


def test_revisits(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [
        (1, "http://www.A.com:80/x/?b=2&a=1#f", at(1), "response", {"etag": '"1"', "date": "d1", "content-type": "t"}, "p1"),
        (2, "https://a.com/x?a=1&b=2&utm_source=q", at(2), "response", {"etag": '"2"', "last-modified": "m", "content-type": "t"}, "p2"),
        (3, "http://a.com/x?a=1&b=2", at(2), "revisit", {"etag": 'W/"1"', "date": "d3", "content-type": "no"}, None),
        (4, "http://a.com/x?a=1&b=2", at(3), "revisit", {"etag": '"1"'}, None),
        (5, "http://a.com/x?a=1&b=2", at(4), "revisit", {"last-modified": "m"}, None),
        (6, "http://a.com/x?a=1&b=2", at(5), "revisit", None, None),
        (7, "http://b.com", at(5), "revisit", {"etag": '"1"'}, None),
        (8, "http://a.com/x?a=1&b=2", None, "revisit", {"etag": '"2"'}, None),
        (9, None, at(1), "metadata", {}, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, captured timestamp, kind string, headers map<string,string>, payload_ref string")
    for stretches in (64, 2, 1):
        got = {r.record_id: (r.status, r.refers_to, r.payload_ref, r.headers) for r in warc.resolve_revisits(df, stretches).collect()}
        assert got == {
            3: ("resolved", 1, "p1", {"etag": 'W/"1"', "date": "d3", "content-type": "t"}), 4: ("mismatch", 2, None, None),
            5: ("resolved", 2, "p2", {"etag": '"2"', "last-modified": "m", "content-type": "t"}), 6: ("unvalidated", 2, None, None),
            7: ("orphan", None, None, None), 8: ("orphan", None, None, None),
        }
    assert warc.resolve_revisits(df.limit(0)).count() == 0


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body><nav><a>Home</a></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; more</h1><p>One\n  two<br>three<p>Four &copy; <b>five</b><form><input>Search</form><aside>side</aside><div id="comments">a comment</div></article><footer>end</footer></body></html>"""


def alone(page):
    return html_extract.main_text(html_extract.blocks_of(page), {})


def test_main_text():
    assert alone(PAGE) == "Head & more\n\nOne two three\n\nFour © five"
    assert [alone(x) for x in ("", "<p>alone", "<!-- x", "<article")] == ["", "alone", "", ""]


def test_a_head_without_end_tag_holds_no_content():
    assert alone("<html><head><title>T</title><body><article><p>text</article>") == "text"
    assert alone("<html><head><title>T</title><meta charset=x><p>text") == "text"
    assert alone("<head><title>T</title>plain words") == "plain words"
    assert alone("<head><title>T</title><style>p{}</style></head><p>text") == "text"


def test_parts_of_an_article_stay():
    assert alone('<article><div class="post-header"><h1>Title</h1></div><p>some <span class="alert">important words</span> here</p></article>') == "Title\n\nsome important words here"
    assert alone('<article><p>text</p><div class="related-posts">no</div><div class="notice">no</div><section class="comments">no</section><footer>no</footer></article>') == "text"
    assert alone('<div class="page-header">no</div><div class="entry-content"><p>text</p></div><div class="sidebar">no</div>') == "text"


@pytest.mark.parametrize("page, want", [
    ('<form id="aspnetForm"><article><p>real text', "real text"), ('<div class="layout has-sidebar"><article><p>real', "real"), ('<div class="page no-sidebar"><main><p>real', "real"),
    ('<div class="content-with-sidebar"><p>real', "real"), ('<div class="search-page"><article><p>real', "real"), ('<div class="legal-news"><article><p>real', "real"), ('<div class="legal-news"><p>real', "real"),
    ('<aside><article><p>no</article></aside><p>real', "real"), ('<section id="comments"><article class="comment"><p>no</article></section><p>real', "real"),
    ('<article><p>a</p><div class="share-price"><p>Price rose</div><section class="related-work"><p>Others', "a\n\nPrice rose\n\nOthers"),
    ('<article><p>a</p><ol class="commentlist"><li>no</ol><div class="commentForm">no</div><div class="admin">b', "a\n\nb"),
    ('<div class="social-share-buttons">no</div><div class="ad-300x250">no</div><div id="cookieNotice">no</div><p>real', "real"),
    ('<main><h1>T</h1><article><p>a</article><section><h2>More stories</h2><ul><li><a href=x>one story</a><li><a href=y>two</a></ul></section></main>', "T\n\na"),
    ('<main><article><p>a</article><h2>Sources</h2><p>See the <a href=x>report</a> of the board for all the figures.</main>', "a\n\nSources\n\nSee the report of the board for all the figures."),
    ('<div class="sidebar"><p>few words', ""), ('<div class="sidebar"><p>' + "word " * 50, ("word " * 50).strip()), ("<nav>" + "word " * 50, ""),
])
def test_wrappers_and_compounds(page, want):
    """An article comes back inside a wrapper that looks like furniture, class words count as whole words, and a page with text isn't emptied."""
    assert alone(page) == want


def read_pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extract.extract(df).collect()}


def own_words(k, n=20):
    return " ".join(f"u{k}x{j}" for j in range(n))


SHARED = "subscribe to our weekly letter and never miss any of the news again"


@pytest.mark.parametrize("n", [3, 64, 65, 200])
def test_site_boilerplate_goes_without_markup_whatever_the_size_of_the_host(spark, n):
    rows = [(k, f"http://h.com/{k}", f"<body><div>{SHARED}</div><div>{own_words(k)}</div></body>") for k in range(n)]
    rows += [(n + k, f"http://h.com/rare{k}", f"<div>{own_words(n + k)}</div><p>{' '.join(f'r{j}' for j in range(12))}</p>") for k in range(2)]  # on two pages of the host
    rows += [(n + 2, "http://other.com/", f"<div>{SHARED}</div>")]
    got = read_pages(spark, rows)
    assert got == {k: own_words(k) for k in range(n + 2)} | {n + 2: SHARED}
    assert read_pages(spark, rows[::-1]) == got


def test_long_shared_substrings_are_cut_out_of_blocks(spark):
    rows = [(k, f"http://h.com/{k}", f"<p>{own_words(k, 30)} {SHARED}</p><p>{own_words(50 + k)}</p>") for k in range(4)]
    assert read_pages(spark, rows) == {k: f"{own_words(k, 30)}\n\n{own_words(50 + k)}" for k in range(4)}


def test_repeated_suffixes_against_brute_force(spark):
    rng = random.Random(3)
    texts = [[" ".join(f"t{rng.randrange(3)}" for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 4))] for _ in range(12)]
    rows = [(k, "http://h.com/", "".join(f"<p>{t}</p>" for t in x)) for k, x in enumerate(texts)]
    seen = defaultdict(set)
    streams = [[w for t in x for w in [None, *t.split(" ")]] + [None] for x in texts]
    for k, s in enumerate(streams):
        for i in range(len(s) - html_extract.RUN + 1):
            seen[tuple(s[i : i + html_extract.RUN])].add(k)
    got = read_pages(spark, rows)
    some = 0
    for k, s in enumerate(streams):
        hit = [any(len(seen[tuple(s[j : j + html_extract.RUN])]) > 1 for j in range(max(0, i - html_extract.RUN + 1), i + 1) if j + html_extract.RUN <= len(s)) for i in range(len(s))]
        at, want = 1, []
        for t in texts[k]:
            words = t.split(" ")
            own = [w for w, h in zip(words, hit[at : at + len(words)]) if not h]
            if len(words) - len(own) < html_extract.COVERED * len(words):
                want.append(" ".join(own))
            at += len(words) + 1
        if want and len(want) == len(texts[k]):  # no block goes as a whole, so the page can't count as a copy
            some += 1
            assert got[k] == "\n\n".join(want)
    assert some > 2


def test_copies_of_a_page_keep_their_content(spark):
    page = lambda k, more: f"<div>{SHARED}</div><div>{own_words(k, 60)}</div><p>{more}</p>"
    rows = [(k, f"http://h.com/{k}", page(k, f"m{k}")) for k in range(6)] + [(7, "http://h.com/7", page(99, "print")), (8, "http://h.com/8", page(99, "share")), (9, "http://h.com/9", page(99, "share"))]
    got = read_pages(spark, rows)
    assert all(own_words(99, 60) in got[k] and SHARED not in got[k] for k in (7, 8, 9))
    marked = [(k, f"http://h.com/{k}", f"<article><p>{own_words(1)}</p></article>") for k in range(30)] + [(30 + k, f"http://i.com/{k}", f"<article><p>{own_words(k)}</p><p>{SHARED}</p></article>") for k in range(25)]
    got = read_pages(spark, marked)
    assert all(got[k] == own_words(1) for k in range(30)) and all(got[30 + k] == own_words(k) for k in range(25))


def test_repeated_rows_are_one_page(spark):
    """A paragraph that a page of 22 rows and one other page share stays: it stands on two pages."""
    page = lambda k: f"<article><p>{SHARED}</p><p>{own_words(k)}</p></article>"
    rows = [(k, "http://h.com/1", page(1)) for k in range(22)] + [(22, "http://h.com/2", page(2))]
    assert read_pages(spark, rows) == {k: f"{SHARED}\n\n{own_words(2 if k == 22 else 1)}" for k in range(23)}


@pytest.mark.parametrize("n", [3, 4, 19, 20, 30])
def test_site_blocks_inside_articles_whatever_the_size_of_the_host(spark, n):
    rows = [(k, f"http://h.com/{k}", f"<article><p>{own_words(k)}</p><p>{SHARED}</p></article>") for k in range(n)]
    rows += [(n + k, f"http://mirror.com/{k}", f"<article><p>{own_words(99)}</p><p>printed {k}</p></article>") for k in range(n)]  # one article on all pages
    got = read_pages(spark, rows)
    assert got == {k: own_words(k) for k in range(n)} | {n + k: f"{own_words(99)}\n\nprinted {k}" for k in range(n)}


def test_teasers_beside_an_article_that_pages_share_go(spark):
    teaser = "how the quiet harbour town became a place that everyone wants to see"
    rows = [(k, f"http://h.com/{k}", f"<main><article><p>{own_words(k)}</p></article><h2>More</h2><p>{teaser}</p><p>{own_words(50 + k)}</p></main>") for k in range(3)]
    assert read_pages(spark, rows) == {k: f"{own_words(k)}\n\n{own_words(50 + k)}" for k in range(3)}


def test_extract_rows(spark):
    rows = [(1, "http://h.com/1", PAGE), (1, "http://h.com/1", PAGE), (2, None, None), (3, "http://www.h.com/2", ""), (None, "x", "<article>y</article>"), (None, "x", "<article>y</article>")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.n_chars, len(r.text)) for r in html_extract.extract(df).collect()))
    assert [g[0] for g in got] == [0, 0, 1, 1, 2, 3] and all(a == b for _, a, b in got) and got[0][1] == 1 and got[4][1] == got[5][1] == 0
    assert html_extract.extract(df.limit(0)).count() == 0


def test_toxicity_generalises_to_misspellings():
    rng = random.Random(0)
    syllables = ["ka", "lo", "mi", "ne", "pu", "ra", "si", "to", "ve", "zu"]
    plain, bad = ["".join(rng.choices(syllables, k=3)) for _ in range(1000)], ["idiotic", "moronic", "trashy", "scummy", "pathetic"]
    texts = [" ".join(rng.choices(plain, k=60) + (rng.choices(bad, k=3) if k % 10 == 0 else [])) for k in range(800)]
    model = toxicity.SubwordBags.trained(texts, [int(k % 10 == 0) for k in range(800)])
    fresh = [" ".join(rng.choices(plain, k=60)) for _ in range(40)]
    assert np.mean([model.logit(t) > 0 for t in fresh]) < 0.1
    assert np.mean([model.logit(t + " idi0tic morronic") > model.logit(t) + 2 for t in fresh]) > 0.9
    assert np.isfinite([model.logit(""), model.logit(" "), model.logit("x" * 100_000)]).all()


def test_toxicity_rows(spark):
    model = toxicity.SubwordBags.trained(["a b", "bad bad"] * 20, [0, 1] * 20)
    docs = documents(spark, EDGE)
    got = toxicity.scores(docs, model).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.clean_documents(documents(spark, [(1, "a b", "s"), (2, "bad bad", "s"), (3, None, "s")]), model, 0.5)
    empty = toxicity.scores(documents(spark, [(3, None, "s"), (4, "", "s"), (5, " ", "s")]), model).collect()
    assert len({r.score for r in empty}) == 1 and empty[0].score == pytest.approx(0.5)  # half of the training texts
    assert {r.doc_id for r in kept.collect()} == {1}
    assert toxicity.scores(docs.limit(0), model).count() == 0 and toxicity.clean_documents(docs.limit(0), model, 0.5).count() == 0
    labels = spark.createDataFrame([(1, 1), (4, 0), (99, 1)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels).count() == 2
    assert 0 < toxicity.SubwordBags.trained([], []).bias[1] - toxicity.SubwordBags.trained([], []).bias[0] + 1


def test_toxicity_scores_against_a_plain_loop(spark):
    """Score of the whole text, word by word and n-gram by n-gram."""
    texts = ["the cat sat", "you idiot", "idiots all around", "a fine day"] * 12
    model = toxicity.SubwordBags.trained(texts, [0, 1, 1, 0] * 12)
    for text in [*texts[:4], "idiotic cat", "", "day day day"]:
        z = model.bias.astype(float).copy()
        words = text.split()
        for w in words:
            buckets, _ = toxicity.subwords([w])
            mean = sum(model.rarity[k] * model.embeddings[k].astype(float) for k in buckets) / len(buckets)
            z += toxicity.GAIN * mean @ model.softmax / len(words)
        assert model.logit(text) == pytest.approx(z[1] - z[0], rel=1e-4, abs=1e-4)


def test_toxicity_training_on_an_executor(spark):
    rows = [(k, "plain words here" if k % 4 else "bad bad words", "s") for k in range(80)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(80)] + [(200, 1), (1, 1)], "doc_id long, toxic int")
    docs, held = documents(spark, rows), F.col("doc_id") >= 60
    model = toxicity.fit(docs, labels, held)
    scores = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    assert all((scores[k] > 0.3) == (k % 4 == 0) for k in range(60, 80))
    few = toxicity.fit(docs, labels, held, max_entries=40)
    assert np.abs(few.embeddings).sum() != np.abs(model.embeddings).sum()
    nothing = toxicity.fit(docs, labels.limit(0), held)
    assert {r.score for r in toxicity.scores(docs, nothing).collect()} == {0.5}


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = lm_score.WindowNetwork.started([5, 3], 100)
    net.flat[:] = rng.normal(0, 0.3, len(net.flat))
    net64 = lm_score.WindowNetwork(net.flat.astype(np.float64))
    target = np.sort(rng.integers(0, lm_score.VOCABULARY, 30))
    around = rng.integers(0, lm_score.VOCABULARY, (4, 30))
    probs = net64.forward(around, target)[0]
    assert (probs < 0).all()
    before = net64.flat.copy()
    squares = np.ones_like(before)
    net64.train(around, target, squares)
    step = before - net64.flat
    for k in rng.choice(np.flatnonzero(np.abs(step) > 1e-7), 20):
        up = before.copy()
        up[k] += 1e-5
        slope = -(lm_score.WindowNetwork(up).forward(around, target)[0].mean() - lm_score.WindowNetwork(before).forward(around, target)[0].mean()) / 1e-5
        assert slope == pytest.approx(step[k] / lm_score.RATE, rel=0.02, abs=1e-5)


def test_pseudo_likelihood(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    words, net = lm_score.train(docs)
    rows = {r.doc_id: r for r in lm_score.pseudo_likelihood(docs.unionAll(spark.createDataFrame([(-1, None), (-2, "the"), (-2, "the")], docs.schema)), words, net).collect()}
    assert rows[-1].n_tokens == 0 and rows[-1].log_likelihood == 0 and rows[-1].mean_log_likelihood is None
    some = docs.limit(5).collect()
    for r in some:  # token by token, without batches
        ids = words.ids(r.text)
        wide = np.concatenate([[lm_score.EDGE] * 2, ids, [lm_score.EDGE] * 2])
        total = sum(float(net.forward(np.array([[wide[k + 2 + o]] for o in lm_score.OFFSETS]), np.array([ids[k]]))[0][0]) for k in range(len(ids)))
        assert rows[r.doc_id].n_tokens == len(ids) and rows[r.doc_id].log_likelihood == pytest.approx(total, rel=1e-4)
    frequent, counts, n = lm_score.frequent_words(lm_score.word_counts(lm_score.coded_texts(docs)))
    start = lm_score.WindowNetwork.started(counts, n)
    untrained = lm_score.pseudo_likelihood(docs, words, start).agg(F.sum("log_likelihood")).first()[0]
    assert sum(r.log_likelihood for r in rows.values() if r.doc_id >= 0) > untrained


def test_every_word_has_its_own_probability(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "GROUP_BYTES", 5000)
    common = [f"c{k}" for k in range(lm_score.FREQUENT)]
    rest = [f"r{k}" for k in range(400)]
    rows = [(k, " ".join(common)) for k in range(6)] + [(100 + k, " ".join([*rest[: 200 + k], "tail\u00a0end"])) for k in range(4)] + [(7, None), (None, "r1 r1 once"), (8, ""), (9, "r1"), (9, "r1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in lm_score.word_likelihood(docs, rounds=0).collect():
        got[r.doc_id].append(r)
    count = defaultdict(int)
    for _, t in rows:
        for w in (t or "").lower().split():
            count[w] += 1
    words, net = lm_score.train(docs, 0, counts=spark.createDataFrame([(lm_score.word_hash(w), n) for w, n in count.items()], "h long, n long"))
    by_token = defaultdict(int)
    for w in count:
        if lm_score.word_hash(w) not in words.known:
            by_token[words[w]] += count[w]
    assert sum(by_token.values()) > 500 and len(by_token) > 30
    plain = {(r.doc_id, r.n_tokens): r.log_likelihood for r in lm_score.pseudo_likelihood(docs, words, net).collect()}
    assert sum(map(len, got.values())) == len(rows) and len(got[9]) == 2 and got[7][0].log_likelihood == 0 and got[8][0].mean_log_likelihood is None
    for i, t in rows:
        own = (t or "").lower().split()
        share = sum(np.log(count[w] / by_token[words[w]]) for w in own if lm_score.word_hash(w) not in words.known)
        for r in got[i]:
            assert r.n_tokens == len(own) and r.log_likelihood == pytest.approx(plain[i, len(own)] + share, rel=1e-6, abs=1e-6)


def test_op1_scores_rest_words_by_their_counts(spark, data, monkeypatch):
    got = {r.doc_id: r.log_likelihood for r in queries.op1_pseudo_likelihood(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    words, net = lm_score.train(docs)
    alone = {r.doc_id: r.log_likelihood for r in lm_score.pseudo_likelihood(docs, words, net).collect()}
    rare = {r.doc_id for r in docs.collect() if any(lm_score.word_hash(w) not in words.known for w in (r.text or "").lower().split())}
    assert rare and set(got) == set(alone) and all(got[i] < alone[i] for i in rare)


def test_likelihood_of_the_rows_not_of_their_partitions(spark, data, monkeypatch):
    monkeypatch.setattr(lm_score, "GROUP_BYTES", 20_000)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    scores = [{r.doc_id: r for r in lm_score.word_likelihood(docs.repartition(n)).collect()} for n in (1, 8)]
    assert scores[0].keys() == scores[1].keys()
    for i, r in scores[0].items():
        assert r.n_tokens == scores[1][i].n_tokens and r.log_likelihood == pytest.approx(scores[1][i].log_likelihood, rel=1e-5, abs=1e-3)


def test_likelihood_of_an_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, _group int")
    assert lm_score.word_likelihood(empty).collect() == []
    rows = spark.createDataFrame([(1, "a b c a", 5, 1, "x"), (2, None, 5, 1, "x")], "doc_id long, text string, _group int, at int, _id string")
    got = {r.doc_id: r for r in lm_score.word_likelihood(rows).collect()}
    assert got[1].n_tokens == 4 and got[1].log_likelihood < 0 and got[2].mean_log_likelihood is None


def test_real_texts_score_above_their_words_in_another_order(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").filter("size(split(text, ' ')) >= 20")
    words, net = lm_score.train(docs)
    rng, rows = np.random.default_rng(3), docs.collect()
    mixed = spark.createDataFrame([(r.doc_id, " ".join(rng.permutation(r.text.split()).tolist())) for r in rows], "doc_id long, text string")
    real, other = ({r.doc_id: r.mean_log_likelihood for r in lm_score.pseudo_likelihood(d, words, net).collect()} for d in (docs, mixed))
    gaps = np.array([real[i] - other[i] for i in real])
    print("above", (gaps > 0).mean(), "gap", gaps.mean())
    assert (gaps > 0).mean() >= 0.95


def test_packing_hands_few_texts_to_python_and_forgets_old_words(spark, monkeypatch):
    """Texts come in small batches, and words beyond the bound go in two generations with the same ids."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with packing.rows_at_once(spark, 3):
        sizes = spark.range(10, numPartitions=1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert max(r.n for r in sizes) == 3 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    text = " ".join(f"word{k % 7} other{k}" for k in range(40))
    want = packing.WordTokenizer(TOKENIZER).encode(text).tolist()
    monkeypatch.setattr(packing, "CACHED_WORDS", 9)
    words = packing.WordTokenizer(TOKENIZER)
    assert words.encode(text).tolist() == want and len(words) <= 9 and words.earlier
