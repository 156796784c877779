"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_extract, lattice_dedup, line_dedup, lm_score, media, merkle, mixing, near_dedup, packing, spelling, toxicity, warc

#: Parameters that the queries and the pipeline share.
TOXIC_FROM = 0.3
ENTROPY_SHARE, MAX_REPETITION = 0.95, 4.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out(id_col: str = "doc_id"):
    """A quarter of the rows by hash of the id; a row without one is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.word_likelihood(docs)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), media.payload(F.col("text")).alias("payload"))
    read = media.with_features(media.with_wav(kept))
    n = F.octet_length("samples")
    marks = F.array_join("fingerprint", ",")
    return read.select(
        "doc_id",
        "n_bytes",
        n.cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.lit("peak-pairs"), F.size("fingerprint"), F.sha2(marks, 256)).alias("feature"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"))


def capture_records(pages: DataFrame) -> DataFrame:
    """A full response and a later revisit for each page.

    The validators of the revisits vary with the page: the same etag as a weak
    one, another etag, only last-modified, or none.
    """
    start = F.lit(1_704_067_200) + F.col("page_id") * 60
    stamp = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm:ss")
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    later = start + 86_400 * (1 + F.col("page_id") % 5)
    full = F.struct(
        (F.col("page_id") * 2).alias("record_id"), F.timestamp_seconds(start).alias("captured"), F.lit("response").alias("kind"),
        F.create_map(F.lit("etag"), etag, F.lit("last-modified"), stamp(start - 3600), F.lit("content-type"), F.lit("text/html"), F.lit("date"), stamp(start)).alias("headers"),
        F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("payload_ref"),
    )
    case = F.col("page_id") % 4
    again = F.struct(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.timestamp_seconds(later).alias("captured"), F.lit("revisit").alias("kind"),
        F.map_filter(
            F.create_map(
                F.lit("etag"), F.when(case == 0, F.concat(F.lit("W/"), etag)).when(case == 1, F.lit('"other"')),
                F.lit("last-modified"), F.when(case == 2, stamp(start - 3600)), F.lit("date"), stamp(later),
                F.lit("content-length"), F.lit("0"), F.lit("expires"), stamp(later + 600),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("headers"),
        F.lit(None).cast("string").alias("payload_ref"),
    )
    return pages.select("url", F.explode(F.array(full, again)).alias("r")).select("url", "r.*")


def op4_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(capture_records(table(spark, sf_dir, "pages")))
    entry = F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select(
        "record_id", "canonical", F.unix_timestamp("captured").alias("captured_s"), "refers_to", "payload_ref",
        F.array_join(F.array_sort(entry), ";").alias("headers"), "status",
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer_path())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = line_dedup.near_line_marks(table(spark, sf_dir, "documents"))
    dropped = F.array_sort(F.collect_list(F.when(~F.col("keep"), F.struct("pos", "first_id", "first_pos"))))
    per_doc = marks.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("keep").alias("n_kept"), dropped.alias("d"))
    return per_doc.select(
        "doc_id", "n_lines", "n_kept", F.col("d.pos").alias("dropped_lines"), F.col("d.first_id").alias("earlier_doc_ids"), F.col("d.first_pos").alias("earlier_lines")
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = mixing.mix(table(spark, sf_dir, "documents"), entropy_share=ENTROPY_SHARE, max_repetition=MAX_REPETITION)
    return used.select(
        "doc_id", F.col("_source").alias("source"), F.col("_tokens").alias("tokens"), "epoch",
        F.round("weight", 9).alias("weight"), "exponent", F.round("block_time", 9).alias("block_time"), "use_key",
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_copies(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out())
    scored = toxicity.scores(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; half of the rows, by hash of doc_id, are tampered with by deleting line ends."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    without_ends = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    return merkle.manifest(table(spark, sf_dir, "documents"), F.when(tampered, without_ends).otherwise(F.col("text")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pseudo_likelihood, op2_media_columns, op3_exact_dedup, op4_revisit_resolution, op5_packing,
        op6_line_dedup, op7_source_mixing, op8_near_dedup, op9_toxicity, op10_html_extraction, op11_lattice_near_dedup,
        op12_spelling_variants, op13_merkle_manifest,
    )
}

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: CRC-32 of a text's UTF-8 bytes in SQL, from the table of its polynomial, which must stand in a relation ``crc`` as ``t``.
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc_sql(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(hex(encode({text}))) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, crc.t[xor(c & 255, b) + 1])), 4294967295)"""


def leaf_sql(text: str) -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    return f"sha256({' || '.join(part(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


ORACLES = {
    "op12_spelling_variants": f"""
        WITH RECURSIVE {CRC_TABLE},
        runs AS (SELECT doc_id, translate(run, '{UP}', '{LOW}') AS low, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{spelling.RUN}')) AS run FROM documents) GROUP BY 1, 2),
        hashed AS (SELECT low, n, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || low")} AS h FROM runs, crc WHERE length(low) >= {spelling.LEAST_LENGTH}),
        counted AS (SELECT CASE WHEN h % {spelling.TYPO_IN} = 0 THEN substr(low, 1, CAST(h % length(low) AS BIGINT)) || substr(low, CAST(h % length(low) AS BIGINT) + 2) ELSE low END AS word, n FROM hashed),
        w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM counted WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY 1 HAVING sum(n) >= {spelling.LEAST_COUNT}),
        v AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS short FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
        pairs AS (SELECT a.word, b.word AS other FROM v a JOIN v b ON a.i = b.i AND a.short = b.short AND a.word <> b.word
          UNION SELECT v.word, w.word FROM v JOIN w ON short = w.word UNION SELECT w.word, v.word FROM v JOIN w ON short = w.word),
        near AS (SELECT pairs.word, other, n AS other_n FROM pairs JOIN w ON other = w.word),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other COLLATE C) AS other, max(other_n) AS other_n FROM near GROUP BY 1),
        formed AS (SELECT w.word, CASE WHEN other_n >= {spelling.FORM_TIMES} * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {spelling.FORM_TIMES} * n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
        up(word, last) AS (SELECT word, word FROM formed UNION ALL SELECT up.word, f.form FROM up JOIN formed f ON up.last = f.word WHERE f.form IS NOT NULL),
        ends AS (SELECT up.word, up.last AS root FROM up JOIN formed f ON up.last = f.word WHERE f.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE {CRC_TABLE},
        d AS (SELECT *, {leaf_sql('text')} AS leaf, coalesce({crc_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0, false) AS tampered FROM documents, crc),
        own AS (SELECT doc_id, coalesce('=' || source, '') AS tree, leaf, CASE WHEN tampered THEN {leaf_sql("replace(text, chr(10), '')")} ELSE leaf END AS changed FROM d),
        placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM own),
        t(level, tree, pos, n, digest) AS (SELECT 0, tree, pos, n, leaf FROM placed UNION ALL
          SELECT level + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY level, tree, pos // 3, n),
        subs AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree COLLATE C) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
        s(level, pos, n, digest) AS (SELECT 0, pos, n, subroot FROM subs UNION ALL
          SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM s WHERE n > 1 GROUP BY level, pos // 3, n),
        -- Runs of siblings: of a source's tree, and, after all of its levels, of the sources' tree.
        runs AS (SELECT tree, level, pos // 3 AS run, list(digest ORDER BY pos) AS digests FROM t WHERE n > 1 GROUP BY 1, 2, 3 UNION ALL
          SELECT '/', level, pos // 3, list(digest ORDER BY pos) FROM s WHERE n > 1 GROUP BY 2, 3),
        f(doc_id, key, tree, level, pos, cur, siblings) AS (
          SELECT doc_id, tree || ':' || pos, tree, 0, pos, changed, '' FROM placed UNION ALL
          SELECT doc_id, key, CASE WHEN r.tree IS NULL THEN '/' ELSE f.tree END, CASE WHEN r.tree IS NULL THEN 0 ELSE f.level + 1 END, CASE WHEN r.tree IS NULL THEN subs.pos ELSE f.pos // 3 END,
            CASE WHEN r.tree IS NULL THEN cur ELSE sha256(array_to_string(list_transform(digests, lambda x, i: CASE WHEN i = f.pos % 3 + 1 THEN cur ELSE x END), '')) END,
            siblings || CASE WHEN r.tree IS NULL THEN '' ELSE array_to_string(list_filter(digests, lambda x, i: i <> f.pos % 3 + 1), '') END
          FROM f LEFT JOIN runs r ON r.tree = f.tree AND r.level = f.level AND r.run = f.pos // 3 LEFT JOIN subs ON subs.tree = f.tree WHERE r.tree IS NOT NULL OR f.tree <> '/'),
        ended AS (SELECT key, arg_max(cur, (tree = '/', level)) AS folded_root, arg_max(siblings, (tree = '/', level)) AS siblings FROM f GROUP BY 1)
        SELECT doc_id, leaf, subroot, (SELECT digest FROM s WHERE n = 1) AS root, sha256(siblings) AS proof_sha256, folded_root, folded_root = (SELECT digest FROM s WHERE n = 1) AS verified
        FROM placed JOIN subs USING (tree) JOIN ended ON key = tree || ':' || placed.pos""",
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UP}', '{LOW}')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op4_revisit_resolution": r"""
        WITH p AS (
          SELECT page_id, url, html, 1704067200 + page_id * 60 AS s, 1704067200 + page_id * 60 + 86400 * (1 + page_id % 5) AS l,
                 regexp_replace(regexp_replace(coalesce(url, ''), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://(www\.)?', '') AS bare
          FROM pages),
        parts AS (
          SELECT *, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', '') AS host,
                 regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
                 list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|fbclid|gclid|ref)='))) AS q
          FROM p),
        c AS (SELECT *, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical,
                 '"' || md5(coalesce(html, '')) || '"' AS etag, strftime(to_timestamp(s - 3600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS modified FROM parts),
        v AS (SELECT page_id, canonical, l, CASE page_id % 4 WHEN 0 THEN 'W/' || etag WHEN 1 THEN '"other"' END AS etag, CASE WHEN page_id % 4 = 2 THEN modified END AS modified,
                 strftime(to_timestamp(l) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS date, strftime(to_timestamp(l + 600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS expires FROM c),
        j AS (
          SELECT v.*, r.page_id AS rid, r.etag AS retag, r.modified AS rmodified,
                 coalesce(regexp_replace(v.etag, '^W/', '') = r.etag, v.modified = r.modified) AS same
          FROM v ASOF LEFT JOIN (SELECT page_id, canonical, s, etag, modified FROM c) r ON v.canonical = r.canonical AND v.l > r.s),
        st AS (SELECT *, CASE WHEN rid IS NULL THEN 'orphan' WHEN same IS NULL THEN 'unvalidated' WHEN same THEN 'resolved' ELSE 'mismatch' END AS status FROM j)
        SELECT page_id * 2 + 1 AS record_id, canonical, l AS captured_s, rid * 2 AS refers_to,
               CASE WHEN status = 'resolved' THEN 'page/' || rid END AS payload_ref,
               CASE WHEN status = 'resolved' THEN 'content-type=text/html;date=' || date || ';etag=' || coalesce(etag, retag) || ';expires=' || expires || ';last-modified=' || coalesce(modified, rmodified) END AS headers,
               status
        FROM st""",
    "op7_source_mixing": rf"""
        WITH RECURSIVE n AS (SELECT greatest({mixing.MIN_BLOCKS}, least({mixing.MAX_BLOCKS}, CAST(ceil(count(*) / {mixing.ROWS_A_BLOCK}) AS BIGINT))) AS n FROM documents),
        d AS (
          SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS ident, doc_id, coalesce(source, '') AS source,
                 CAST('0x' || substr(md5('mix/block/' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % (SELECT n FROM n) AS block,
                 CAST(len(regexp_extract_all(coalesce(text, ''), '{mixing.WORDS}')) AS BIGINT) AS tokens
          FROM documents),
        b AS (SELECT source, block, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY 1, 2),
        s AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS t FROM b GROUP BY 1 HAVING sum(tokens) > 0),
        tot AS (SELECT CAST(sum(t) AS BIGINT) AS total, max(t) / sum(t) AS top, list(t / (SELECT sum(t) FROM s) ORDER BY source, t) AS ps FROM s),
        f AS (SELECT *, ln(CAST(len(ps) AS DOUBLE)) * {ENTROPY_SHARE} AS want FROM tot),
        e(i, lo, hi) AS (
          SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
          UNION ALL
          SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
            SELECT i, lo, hi, (lo + hi) / 2 AS mid,
                   ln(list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2)))) - (lo + hi) / 2 * list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2) * ln(p))) / list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))) >= want AS ok
            FROM e, f WHERE i < {mixing.BISECTIONS})),
        r(i, lo, hi) AS (
          SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
          UNION ALL
          SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
            SELECT i, lo, hi, (lo + hi) / 2 AS mid,
                   list_max(list_transform(ps, lambda p: pow(p, (lo + hi) / 2 - 1))) / list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))) <= {MAX_REPETITION} AS ok
            FROM r, f WHERE i < {mixing.BISECTIONS})),
        x AS (
          SELECT total, ps, round(greatest(
                   CASE WHEN -list_sum(list_transform(ps, lambda p: p * ln(p))) >= want THEN CAST(1 AS DOUBLE) ELSE (SELECT lo FROM e WHERE i = {mixing.BISECTIONS}) END,
                   CASE WHEN list_max(list_transform(ps, lambda p: 1 / p)) / len(ps) <= {MAX_REPETITION} THEN CAST(0 AS DOUBLE) ELSE (SELECT hi FROM r WHERE i = {mixing.BISECTIONS}) END), 6) AS a
          FROM f),
        w AS (
          SELECT source, t, a AS exponent, pow(t / total, a) / list_sum(list_transform(ps, lambda p: pow(p, a))) AS weight,
                 CAST(least(floor(pow(t / total, a) / list_sum(list_transform(ps, lambda p: pow(p, a))) * total), floor(t * {MAX_REPETITION})) AS BIGINT) AS budget
          FROM s, x),
        u0 AS (SELECT w.*, b.block, b.tokens, unnest(range(0, CAST(floor(budget / t) AS BIGINT) + 1)) AS epoch FROM b JOIN w USING (source)),
        u1 AS (SELECT *, budget - epoch * t AS rest,
                 CAST(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY md5('mix/' || source || '/' || epoch || '/' || block), block) AS BIGINT) AS upto FROM u0),
        u AS (SELECT *, (epoch * t + upto - tokens) / budget AS block_time FROM u1 WHERE upto - tokens < rest),
        k AS (SELECT d.doc_id, d.source, d.tokens, u.epoch, u.weight, u.exponent, u.block_time, u.rest - u.upto + u.tokens AS room, u.upto > u.rest AS cut, u.block,
                 md5('mix/' || u.epoch || '/' || d.ident) AS use_key FROM d JOIN u ON d.source = u.source AND d.block = u.block),
        z AS (SELECT *, sum(tokens) OVER (PARTITION BY source, block, epoch ORDER BY use_key) AS run FROM k),
        y AS (SELECT *, max(CASE WHEN run <= room THEN use_key END) OVER (PARTITION BY source, block, epoch) AS last_key FROM z)
        SELECT doc_id, source, tokens, CAST(epoch AS INTEGER) AS epoch, round(weight, 9) AS weight, exponent, round(block_time, 9) AS block_time, use_key
        FROM y WHERE NOT cut OR use_key <= coalesce(last_key, '')""",
}
