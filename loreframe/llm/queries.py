"""The registered queries of the operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loreframe.llm.best_fit import pack_best_fit
from loreframe.llm.fill_middle import fill_in_middle, restored
from loreframe.llm.fingerprints import fingerprint_edits, near_classes
from loreframe.llm.jaccard_join import near_duplicate_classes
from loreframe.llm.language_id import held_out, identify, learn
from loreframe.llm.lexical_search import search
from loreframe.llm.mixing import mix_sizes
from loreframe.llm.packing import pack, word_ids
from loreframe.llm.pii import BASE, find_pii, span_text
from loreframe.llm.token_counts import piece_counter, token_counts
from loreframe.llm.topk_hamming import sign_code, top_k
from loreframe.llm.url_filters import judge_urls
from loreframe.llm.warc import resolve_revisits
from loreframe.session import prepare, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _query(name: str, table: str, sql: str | None = None):
    def wrap(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


DIMENSIONS, NEAREST = 64, 10


@_query(
    "op1_hamming_topk",
    "embeddings",
    f"""
    WITH coded AS (
      SELECT DISTINCT vec_id, list_transform(range({DIMENSIONS}), lambda i: coalesce(embedding[i + 1] > 0, false)) AS code
      FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
    scored AS (
      SELECT q.vec_id AS query_id, q.code AS q, c.vec_id, CAST(list_sum(list_transform(range({DIMENSIONS}),
             lambda i: CAST(q.code[i + 1] <> c.code[i + 1] AS INTEGER))) AS INTEGER) AS distance
      FROM coded q, coded c WHERE q.vec_id % 100 = 0),
    ranked AS (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, q ORDER BY distance, vec_id) AS INTEGER) AS rank,
             vec_id, distance FROM scored)
    SELECT * FROM ranked WHERE rank <= {NEAREST}""",
)
def op1(vectors: DataFrame) -> DataFrame:
    """The 10 nearest sign codes of every vector whose id is divisible by 100, against all vectors."""
    codes = vectors.select(F.col("vec_id").alias("id"), sign_code("embedding", DIMENSIONS).alias("code"))
    queries = codes.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    return top_k(codes, queries, NEAREST).withColumnRenamed("id", "vec_id")


def word_encoder():
    return word_ids(public_tokenizers.path("word_bpe_49k.json"))


def count_pieces():
    return piece_counter(public_tokenizers.path("piece_bpe_32k.model"))


@_query("op2_pack", "documents")
def op2(docs: DataFrame) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens, each document closed by id 1."""
    return pack(docs, word_encoder, end_id=1, window=2048)


@_query("op3_ngram_jaccard", "documents")
def op3(docs: DataFrame) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of 0.9 or more on three-word shingles."""
    return near_duplicate_classes(docs, size=3, percent=90)


@_query("op4_language_id", "documents")
def op4(docs: DataFrame) -> DataFrame:
    """Predicted language of every document, learned from those not held out."""
    out = held_out(F.col("doc_id"))
    prototypes = learn(docs.where(~out))
    return identify(docs, prototypes, ["doc_id"]).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@_query("op5_mix_sources", "documents")
def op5(docs: DataFrame) -> DataFrame:
    """How many words the mix takes of each document."""
    mixed = mix_sizes(docs, weights=(3, 1, 2), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@_query("op6_token_counts", "documents")
def op6(docs: DataFrame) -> DataFrame:
    """Token counts of every document under the piece model, and whether they pass 4096."""
    return token_counts(docs, count_pieces, limit=4096)


@_query("op7_fingerprints", "documents")
def op7(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and its edited text; the class of near copies and how many others are in it."""
    marks = written(fingerprint_edits(docs), "fingerprints")
    return marks.join(near_classes(marks.select("doc_id", "fingerprint"), similarity=0.9), "fingerprint")


def captures(pages: DataFrame) -> DataFrame:
    """Web archive records of pages: each page is captured once and revisited twice.

    The first revisit names the entity tag and asks for a new expiry; for every seventh page the tag has
    changed. The second has only a modification date.
    """
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60)
    digest = F.md5(F.coalesce("html", F.lit("")))
    modified = F.date_format(at, "yyyy-MM-dd")
    base = pages.select("page_id", "url", at.alias("at"), digest.alias("digest"), modified.alias("modified"))

    def record(kind: str, shift: int, wait: int, status: int, digest_: F.Column, headers: dict) -> DataFrame:
        fields = [x for k, v in headers.items() for x in (F.lit(k), v)]
        return base.select(
            (F.col("page_id") * 3 + shift).alias("record_id"),
            F.lit(kind).alias("kind"),
            F.col("url").alias("uri"),
            (F.col("at") + F.make_dt_interval(secs=F.lit(wait))).alias("at"),
            F.lit(status).alias("status"),
            F.create_map(*fields).alias("headers"),
            digest_.alias("digest"),
        )

    tag = F.concat(F.lit('"'), F.col("digest"), F.lit('"'))
    changed = F.when(F.col("page_id") % 7 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
    first = {"etag": tag, "last-modified": F.col("modified"), "content-type": F.lit("text/html"), "expires": F.lit("0")}
    nothing = F.lit(None).cast("string")
    return (
        record("response", 0, 0, 200, F.col("digest"), first)
        .union(record("revisit", 1, 3600, 304, nothing, {"etag": changed, "expires": F.lit("3600"), "server": F.lit("a")}))
        .union(record("revisit", 2, 86400, 304, nothing, {"last-modified": F.col("modified")}))
    )


_CANONICAL = r"""
      CASE WHEN plain LIKE '%://%' THEN
        lower(regexp_replace(regexp_replace(regexp_extract(rest, '^([^/?]*)', 1), '^.*@', ''), ':(80|443)$', ''))
        || CASE WHEN regexp_extract(rest, '^[^/?]*([^?]*)', 1) = '' THEN '/' ELSE regexp_extract(rest, '^[^/?]*([^?]*)', 1) END
        || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END
      ELSE plain END"""


@_query(
    "op8_warc_revisits",
    "pages",
    rf"""
    WITH base AS (
      SELECT page_id, url, 1700000000 + page_id * 60 AS ts, md5(coalesce(html, '')) AS digest,
             strftime(make_timestamp((1700000000 + page_id * 60) * 1000000), '%Y-%m-%d') AS modified FROM pages),
    parts AS (
      SELECT *, regexp_replace(url, '#.*$', '', 's') AS plain FROM base),
    rests AS (
      SELECT *, regexp_replace(plain, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM parts),
    urls AS (
      SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
             lambda f: f <> '' AND NOT regexp_matches(f, '^(utm_[a-z]+|fbclid|gclid)='))) AS fields FROM rests),
    canon AS (SELECT *, {_CANONICAL} AS c FROM urls),
    visits AS (
      SELECT page_id * 3 + 1 AS record_id, c, ts + 3600 AS ts,
             CASE WHEN page_id % 7 = 0 THEN '"changed"' ELSE '"' || digest || '"' END AS etag, NULL AS modified FROM canon
      UNION ALL SELECT page_id * 3 + 2, c, ts + 86400, NULL, modified FROM canon),
    ranked AS (
      SELECT v.*, r.page_id, r.digest AS old_digest, r.modified AS old_modified,
             row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC NULLS LAST, r.page_id DESC) AS i
      FROM visits v LEFT JOIN canon r ON v.c = r.c AND r.ts < v.ts),
    judged AS (
      SELECT *, CASE WHEN page_id IS NULL THEN 'no_response'
                WHEN coalesce(etag <> '"' || old_digest || '"', false) OR coalesce(modified <> old_modified, false) THEN 'mismatch'
                ELSE 'resolved' END AS state
      FROM ranked WHERE i = 1)
    SELECT record_id, c AS url, page_id * 3 AS response_id, state,
           CASE WHEN state <> 'resolved' THEN CASE WHEN etag IS NULL THEN NULL ELSE '3600' END
                WHEN etag IS NULL THEN '0' ELSE '3600' END AS expires,
           CASE WHEN state = 'resolved' THEN 'text/html' END AS content_type,
           CASE WHEN state = 'resolved' THEN old_digest END AS digest
    FROM judged""",
)
def op8(pages: DataFrame) -> DataFrame:
    """Every revisit among the captures of all pages with the response it stands for."""
    found = resolve_revisits(captures(pages))
    return found.select(
        "record_id",
        "url",
        "response_id",
        "state",
        F.element_at("headers", "expires").alias("expires"),
        F.element_at("headers", "content-type").alias("content_type"),
        "digest",
    )


def _propagation_sql(rounds: int, damping: float) -> str:
    """Trust t along links and distrust d against them, beside p and q from seeds of 1 at every host."""
    keep, steps = 1 - damping, []
    for i in range(rounds):
        steps.append(
            f"""s{i + 1} AS MATERIALIZED (
      SELECT s0.host, {keep} * s0.t + {damping} * coalesce(x.t, 0) AS t, {keep} * s0.d + {damping} * coalesce(x.d, 0) AS d,
             {keep} + {damping} * coalesce(x.p, 0) AS p, {keep} + {damping} * coalesce(x.q, 0) AS q
      FROM s0 LEFT JOIN (SELECT e.dst AS host, sum(s.t * e.a) AS t, sum(s.d * e.b) AS d, sum(s.p * e.a) AS p, sum(s.q * e.b) AS q
                         FROM s{i} s JOIN steps e ON s.host = e.src GROUP BY 1) x ON x.host = s0.host)"""
        )
    return ",\n".join(steps)


@_query(
    "op9_url_filter",
    "pages",
    rf"""
    WITH named AS MATERIALIZED (
      SELECT page_id, html,
             translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    ruled AS MATERIALIZED (
      SELECT page_id, host, path, CASE
        WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM named),
    verdicts AS MATERIALIZED (
      SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled
      FROM ruled),
    hrefs AS (
      SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''),
             '<[aA][ \t\r\n][^>]*?[hH][rR][eE][fF][ ]*=[ ]*["'']?([^"'' >]*)', 1)) AS target FROM named),
    links AS MATERIALIZED (
      SELECT src, CASE WHEN starts_with(target, '//') THEN lower(regexp_extract(target, '^//([^/?#]*)', 1))
             WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN lower(regexp_extract(target, '^.*?://([^/?#]*)', 1))
             ELSE src END AS dst, count(*) AS n FROM hrefs GROUP BY 1, 2),
    seeds AS (
      SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS t, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS d
      FROM verdicts GROUP BY 1),
    s0 AS MATERIALIZED (
      SELECT host, coalesce(t, 0) AS t, coalesce(d, 0) AS d, 1.0 AS p, 1.0 AS q
      FROM (SELECT host FROM seeds UNION SELECT src FROM links UNION SELECT dst FROM links) LEFT JOIN seeds USING (host)),
    counted AS MATERIALIZED (
      SELECT src, dst, sum(n) AS n FROM (SELECT src, dst, n FROM links UNION ALL SELECT host, host, 1 FROM s0) GROUP BY 1, 2),
    steps AS MATERIALIZED (
      SELECT src, dst, sum(a) AS a, sum(b) AS b FROM (
        SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS a, 0.0 AS b FROM counted
        UNION ALL SELECT dst, src, 0.0, n / sum(n) OVER (PARTITION BY dst) FROM counted) GROUP BY 1, 2),
    {_propagation_sql(12, 0.85)}
    SELECT page_id, v.host, path, rule, coalesce(ruled, CASE WHEN round(d / q, 9) > greatest(0.5, round(t / p, 9)) THEN 'block' ELSE 'allow' END) AS verdict
    FROM verdicts v JOIN s12 USING (host)""",
)
def op9(pages: DataFrame) -> DataFrame:
    """Verdict on the URL of every page, by rules and where none fits by propagation over host links."""
    return judge_urls(pages, RULES, damping=0.85, rounds=12, least=0.5)


@_query("op10_pii", "documents")
def op10(docs: DataFrame) -> DataFrame:
    """Personal data in every document: counts of the base kinds, and all spans."""
    found = find_pii(docs.select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda x: x["kind"].isin(BASE))
    counts = [F.size(F.filter("spans", partial(lambda k, x: x["kind"] == k, kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


@_query(
    "op11_fill_in_middle",
    "documents",
    """
    WITH drawn AS (
      SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
             sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    numbers AS (
      SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM drawn),
    cuts AS (
      SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
    parts AS (
      SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM cuts)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(t) AS restored_sha256 FROM parts""",
)
def op11(docs: DataFrame) -> DataFrame:
    """Every document in its fill-in-middle form, and the text rebuilt from that, by their digests."""
    made = fill_in_middle(docs)
    back = restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


RANKED = 10


def _two_tables(name: str, first: str, second: str, sql: str):
    def wrap(fn: Callable[[DataFrame, DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            read = prepare(spark).read
            return fn(*(read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in (first, second)))

        QUERIES[name] = run
        ORACLES[name] = sql
        return fn

    return wrap


_TERMS = r"""string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@_two_tables(
    "op12_lexical_search",
    "documents",
    "benchmark",
    f"""
    WITH doc_terms AS MATERIALIZED (
      SELECT doc_id, i, term, count(*) AS tf
      FROM (SELECT doc_id, row_number() OVER () AS i, unnest({_TERMS}) AS term FROM documents) WHERE term <> '' GROUP BY ALL),
    lengths AS MATERIALIZED (SELECT i, CAST(sum(tf) AS BIGINT) AS n FROM doc_terms GROUP BY i),
    corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
                FROM (SELECT term, count(*) AS df FROM doc_terms GROUP BY term), corpus),
    item_terms AS (
      SELECT DISTINCT item_id, j, term
      FROM (SELECT item_id, row_number() OVER () AS j, unnest({_TERMS}) AS term FROM benchmark) WHERE term <> ''),
    scored AS (
      SELECT q.item_id, q.j, d.doc_id, d.i,
             CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS BIGINT) AS score
      FROM item_terms q JOIN doc_terms d USING (term) JOIN weights USING (term) JOIN lengths USING (i), corpus GROUP BY ALL),
    ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY item_id, j ORDER BY score DESC, doc_id) AS INTEGER) AS rank
      FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {RANKED}""",
)
def op12(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The 10 highest-scoring documents of every benchmark item."""
    return search(docs, items, RANKED)


@_query("op13_best_fit", "documents")
def op13(docs: DataFrame) -> DataFrame:
    """Pieces of all documents in few sequences of at most 4096 tokens, each document closed by id 1."""
    return pack_best_fit(docs, word_encoder, end_id=1, window=4096)
