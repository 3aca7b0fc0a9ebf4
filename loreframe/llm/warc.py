"""Not-modified revisits of web archives, resolved to the response they stand for.

A revisit record says that a page had not changed since an earlier capture and holds no payload. It is
joined as-of to the latest earlier full response of its canonical URL; its validators are checked and the
headers that a 304 may update are merged over those of the response.

The as-of join is two-level: inside time slices of bounded size per URL the last response is carried
along, between slices one row per URL and slice is. So one URL with a third of all records spreads over
many tasks. Payloads are not moved, a resolved record names the response that has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from loreframe.session import written


SLICE = 50_000  # records of a time slice, on average

# Header fields that a not-modified response updates (public HTTP semantics).
UPDATED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical_url(url: Column) -> Column:
    """Host and path in one form: scheme, user, default port, fragment and tracking fields dropped.

    Null stays null; what has no ``://`` is only cut at the fragment.
    """
    plain = F.regexp_replace(url, "#.*$", "")
    rest = F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, "^([^/?]*)", 1), "^.*@|:(80|443)$", ""))
    path = F.regexp_extract(rest, "^[^/?]*([^?]*)", 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = F.regexp_extract(rest, "\\?(.*)$", 1)
    fields = F.array_sort(F.filter(F.split(query, "&"), lambda f: (f != "") & ~f.rlike("^(utm_[a-z]+|fbclid|gclid)=")))
    tail = F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(F.lit(""))
    return F.when(plain.contains("://"), F.concat(host, path, tail)).otherwise(plain)


def _etag(headers: str) -> Column:
    return F.regexp_replace(F.element_at(headers, "etag"), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records(record_id, kind, uri, at, status, headers, digest)``.

    ``kind`` is ``response`` or ``revisit`` (others are ignored), ``headers`` a map with lower-case names,
    ``digest`` that of the payload. Returns record_id, url, at, response_id, state, headers, digest.

    A full response has status 200 and a time and URL. Of responses at one time the largest record_id is
    the latest; one at the very time of the revisit is not earlier. ``state``:

    * ``no_response``: none is earlier, or the revisit has no URL or time; headers are the revisit's own
    * ``mismatch``: entity tag (weak comparison), modification date or digest contradict; not merged
    * ``unverified``: neither side has a validator in common; not merged
    * ``resolved``: at least one agrees and none contradicts; the response's headers with those of UPDATED
      taken from the revisit, and the response's digest

    A null map counts as empty. Repeated rows are resolved each for itself. Other columns are ignored.
    """
    seen = records.where("kind in ('response', 'revisit')").select(
        "record_id",
        (F.col("kind") == "revisit").alias("revisit"),
        canonical_url(F.col("uri")).alias("url"),
        "at",
        "status",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
        "digest",
    )
    seen = written(seen, "captures")
    timed = seen.where("url is not null and at is not null")
    timed = timed.where("revisit or status = 200").select("record_id", "revisit", "url", "at")
    second = F.unix_micros(F.col("at").cast("timestamp"))
    slices = max(1, timed.count() // SLICE)
    steps = [k / slices for k in range(1, slices)]
    cuts = sorted(set(timed.select(second.cast("double").alias("s")).approxQuantile("s", steps, 0.25 / slices))) if steps else []
    edges = F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>")
    cut = timed.withColumn("slice", F.size(F.filter(edges, lambda e: e < second)))
    response = F.when(~F.col("revisit"), F.struct("at", F.col("record_id").alias("id")))
    inside = W.partitionBy("url", "slice").orderBy("at", F.col("revisit").desc(), "record_id")
    local = cut.withColumn("near", F.last(response, ignorenulls=True).over(inside)).where("revisit")
    tails = cut.groupBy("url", "slice").agg(F.max(response).alias("tail"))
    before = W.partitionBy("url").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = tails.select("url", "slice", F.last("tail", ignorenulls=True).over(before).alias("carried"))
    found = local.join(carried, ["url", "slice"]).select(
        "record_id", "url", "at", F.coalesce(F.col("near.id"), F.col("carried.id")).alias("response_id")
    )
    old = seen.where("not revisit and status = 200 and record_id is not null").select(
        F.col("record_id").alias("response_id"), F.col("headers").alias("old_headers"), F.col("digest").alias("old_digest")
    )
    old = old.dropDuplicates(["response_id"])
    matched = found.select("record_id", "url", "at", "response_id").distinct()
    revisits = seen.where("revisit").alias("r").join(
        matched.alias("f"),
        F.col("r.record_id").eqNullSafe(F.col("f.record_id")) & (F.col("r.url") == F.col("f.url")) & (F.col("r.at") == F.col("f.at")),
        "left",
    )
    both = revisits.select("r.*", "f.response_id").join(old, "response_id", "left")
    checks = F.array(
        _etag("headers") == _etag("old_headers"),
        F.element_at("headers", "last-modified") == F.element_at("old_headers", "last-modified"),
        F.col("digest") == F.col("old_digest"),
    )
    judged = both.withColumn("checks", checks).withColumn(
        "state",
        F.when(F.col("old_headers").isNull(), "no_response")
        .when(F.array_contains("checks", False), "mismatch")
        .when(F.array_contains("checks", True), "resolved")
        .otherwise("unverified"),
    )
    fresh = F.map_filter("headers", lambda k, v: k.isin(UPDATED))
    kept = F.map_filter("old_headers", lambda k, v: ~F.array_contains(F.map_keys(F.col("fresh")), k))
    merged = judged.withColumn("fresh", fresh).withColumn(
        "merged", F.when(F.col("state") == "resolved", F.map_concat(kept, "fresh")).otherwise(F.col("headers"))
    )
    return merged.select(
        "record_id",
        "url",
        "at",
        F.when(F.col("old_headers").isNotNull(), F.col("response_id")).alias("response_id"),
        "state",
        F.col("merged").alias("headers"),
        F.when(F.col("state") == "resolved", F.col("old_digest")).otherwise(F.col("digest")).alias("digest"),
    )
