"""Resolution of WARC revisit records that say "not modified".

An as-of join by canonical URL finds the latest earlier full response of each
revisit, checks its validators and merges the headers that a 304 may update.
It is a union with a running last value; long histories of one URL are split
by time, and each stretch starts from the last response before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Query parameters that name no other resource.
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|ref)="
#: Headers that a 304 response updates in the stored one; all others stay.
UPDATED = ("cache-control", "content-location", "date", "expires", "vary", "etag", "last-modified")
#: Stretches of time over all captures.
STRETCHES = 64


def canonical_url(url: Column) -> Column:
    """Scheme and www dropped, host in lower case, no default port, fragment, tracking or slash at the end; parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://(www\.)?", "")
    place = F.regexp_extract(bare, r"^([^?]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(place, r"^([^/]*)", 1)), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(place, r"^[^/]*(.*)$", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def lower_names(headers: Column) -> Column:
    """Headers with names in lower case; of names that differ in case only, the first counts."""
    names = F.transform(F.map_keys(headers), F.lower)
    first = F.filter(F.map_entries(headers), lambda e, i: F.array_position(names, F.lower(e["key"])) == i + 1)
    return F.map_from_entries(F.transform(first, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def resolve_revisits(records: DataFrame, stretches: int = STRETCHES) -> DataFrame:
    """One row for each revisit of ``records``.

    ``records``: record_id long, url string, captured timestamp, kind string
    ('response', 'revisit', other kinds are ignored), headers
    map<string,string> with names in any case, payload_ref string (where the
    body lies).  Returns record_id, canonical, captured, refers_to (record_id
    of the latest full response strictly earlier), payload_ref, headers (its
    headers, those in ``UPDATED`` taken from the revisit where it has them)
    and status: 'resolved', 'mismatch' (a validator that both have differs),
    'unvalidated' (no validator in common) or 'orphan' (no earlier response).
    Only resolved rows have a payload_ref and merged headers.

    An etag decides alone, compared weakly; else last-modified does.  Defined
    cases: of responses of one time the largest record_id counts; a null time
    or kind takes no part as a response, and a revisit without time is an
    orphan; null or absent headers are empty; repeated revisits are resolved
    each; an empty table gives an empty table; extra columns are ignored.
    """
    empty = F.create_map().cast("map<string,string>")
    own = records.filter("kind in ('response', 'revisit')").select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "captured", "kind",
        lower_names(F.coalesce("headers", empty)).alias("headers"), "payload_ref",
    )
    own = own.filter("kind = 'revisit' or captured is not null")
    bounds = own.agg(F.percentile_approx("captured", [i / stretches for i in range(1, stretches)], 10_000).alias("b")).first()["b"] or []
    cuts = F.array(*[F.lit(x) for x in sorted(set(bounds))]) if bounds else F.array().cast("array<timestamp>")
    own = own.withColumn("stretch", F.size(F.filter(cuts, lambda c: F.col("captured") > c)))
    answer = F.when(F.col("kind") == "response", F.struct("captured", "record_id", "headers", "payload_ref"))
    later = Window.partitionBy("canonical").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each URL and stretch: the last response before the stretch.
    carried = (
        own.groupBy("canonical", "stretch")
        .agg(F.max_by(answer, F.when(F.col("kind") == "response", F.struct("captured", "record_id"))).alias("last"))
        .select("canonical", "stretch", F.last("last", ignorenulls=True).over(later).alias("before"))
        .filter("before is not null")
    )
    strictly = Window.partitionBy("canonical", "stretch").orderBy(F.col("captured").asc_nulls_first(), "rank", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # At one time revisits come first, so that only earlier responses count.
    near = own.withColumn("rank", (F.col("kind") == "response").cast("int")).withColumn("within", F.last(answer, ignorenulls=True).over(strictly))
    found = (
        near.filter("kind = 'revisit'")
        .join(carried, ["canonical", "stretch"], "left")
        .withColumn("r", F.when(F.col("captured").isNotNull(), F.coalesce("within", "before")))
    )
    header = lambda c, n: F.element_at(c, F.lit(n))
    tag = lambda c: F.regexp_replace(header(c, "etag"), "^W/", "")
    same = F.coalesce(tag("headers") == tag("r.headers"), header("headers", "last-modified") == header("r.headers", "last-modified"))
    status = F.when(F.col("r").isNull(), "orphan").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch")
    fresh = F.map_filter("headers", lambda k, _: k.isin(*UPDATED))
    merged = F.map_concat(F.map_filter("r.headers", lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    ok = F.col("status") == "resolved"
    return found.withColumn("status", status).select(
        "record_id", "canonical", "captured", F.col("r.record_id").alias("refers_to"),
        F.when(ok, F.col("r.payload_ref")).alias("payload_ref"), F.when(ok, merged).alias("headers"), "status",
    )
