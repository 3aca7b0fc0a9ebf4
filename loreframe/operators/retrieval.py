"""Hybrid retrieval in batch: terms, vector and keyword channels, fusion, rerank, parent context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from loreframe.functions import text as tx
from loreframe.functions.constants import DOMAIN_WORDS, MAX_TERMS, MIN_SCORE, RRF_K, TOP_K
from loreframe.operators import vectorcells
from loreframe.operators.patternsearch import pattern_topk
from loreframe.session import written


# --- terms -------------------------------------------------------------------------------------


def alias_matches(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, alias row, matched names): alias rows with a name contained in the query.

    Containment becomes an equi join on a short anchor: every name is keyed by its first three
    characters and every query by its distinct 1- to 3-grams; ``contains`` then verifies.
    """
    active = aliases.filter("status = 'active'").select(
        F.col("id").alias("alias_id"),
        F.struct(F.col("updated_at"), F.col("id")).alias("alias_order"),
        F.coalesce(tx.strip("canonical"), F.lit("")).alias("canonical"),
        tx.clean_items(F.coalesce("aliases", F.array().cast("array<string>"))).alias("aliases"),
    )
    names = active.select(
        "alias_id", F.posexplode(F.concat(F.array("canonical"), "aliases")).alias("pos", "name")
    ).filter("name <> ''").withColumn("anchor", F.substring("name", 1, 3))
    text = tx.compact(F.col("query"))
    grams = F.array_distinct(F.concat(*[ngrams(F.col("text"), n) for n in (1, 2, 3)]))
    keyed = queries.select("query_id", text.alias("text")).select(
        "query_id", "text", F.explode(grams).alias("anchor")
    )
    found = (
        keyed.join(names, "anchor")
        .filter(F.contains("text", "name"))
        .groupBy("query_id", "alias_id")
        .agg(F.sort_array(F.collect_set(F.struct("pos", "name"))).alias("hits"))
    )
    matched = F.transform(
        F.filter("hits", lambda h: h["pos"] > 0), lambda h: h["name"]
    )
    return found.join(active, "alias_id").select(
        "query_id",
        "alias_id",
        "alias_order",
        "canonical",
        matched.alias("matched_aliases"),
        F.filter(
            F.concat(matched, F.array("canonical"), "aliases"), lambda n: n != ""
        ).alias("names"),
    )


def keyword_terms(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, query, terms): error codes, alias names, domain words, Latin tokens; first 20."""
    extra = (
        alias_matches(queries, aliases)
        .groupBy("query_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("alias_order", "names")), asc=False).alias("rows")
        )
        .select("query_id", F.flatten(F.transform("rows", lambda r: r["names"])).alias("alias_terms"))
    )
    text = tx.compact(F.col("query"))
    prior = F.array_distinct(
        F.concat(
            tx.error_codes(text),
            F.coalesce("alias_terms", F.array().cast("array<string>")),
            tx.keywords_in(text, DOMAIN_WORDS),
        )
    )
    return (
        queries.select("query_id", "query")
        .join(extra, "query_id", "left")
        .select(
            "query_id",
            "query",
            F.slice(tx.append_tokens(prior, tx.latin_tokens(text)), 1, MAX_TERMS).alias("terms"),
        )
    )


# --- channels ----------------------------------------------------------------------------------


def _vector_rows(live: DataFrame) -> DataFrame:
    return live.filter(F.col("embedding").isNotNull()).select("id", F.lit(0).cast("long").alias("tie"), "embedding")


def vector_topk(queries: DataFrame, live: DataFrame, k: int, min_score: float = MIN_SCORE, **kw) -> DataFrame:
    """Exact cosine top-k over live rows."""
    return vectorcells.exact_topk(queries, _vector_rows(live), k, min_score, **kw)


def vector_topk_coded(queries: DataFrame, live: DataFrame, k: int, min_score: float = MIN_SCORE, **kw) -> DataFrame:
    """Approximate cosine top-k: candidates by coded residuals, exact scores."""
    rows = _vector_rows(live)
    candidates = vectorcells.coded_candidates(queries, rows, k, min_score, **kw)
    return vectorcells.rescored(candidates, queries, rows, k, min_score)


def _lexical_queries(terms: DataFrame) -> DataFrame:
    phrase = tx.strip("query")
    words = tx.clean_items("terms")
    return (
        terms.select("query_id", phrase.alias("phrase"), words.alias("terms"))
        .filter("phrase <> ''")
        .withColumn("terms", F.when(F.size("terms") > 0, F.col("terms")).otherwise(F.array("phrase")))
    )


def keyword_topk(terms: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """Exact additive keyword top-k; one pass over the texts for all queries together."""
    rows = live.select(
        "id",
        F.unix_micros(F.col("updated_at").cast("timestamp")).alias("tie"),
        "source_title",
        "search_text",
        "content",
    )
    return pattern_topk(_lexical_queries(terms), rows, k)


def keyword_topk_indexed(terms: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """The same result through a trigram index, for few and selective queries.

    Every pattern is looked up by the rarest of its trigrams; candidates are then verified and
    scored by the exact rule. Patterns that are shorter than a trigram or hold LIKE wildcards
    cannot use the index, so queries with such a pattern take the scanning form.
    """
    asked = _lexical_queries(terms)
    unindexable = F.exists(
        F.array_append(F.col("terms"), F.col("phrase")),
        lambda p: (F.length(p) < 3) | p.rlike(r"[%_\\]"),
    )
    scan = terms.join(asked.filter(unindexable).select("query_id"), "query_id", "left_semi")
    by_index = asked.filter(~unindexable)
    patterns = by_index.select(
        "query_id",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit(True).alias("is_phrase"), F.lower("phrase").alias("p"))),
                F.transform(
                    "terms", lambda t: F.struct(F.lit(False).alias("is_phrase"), F.lower(t).alias("p"))
                ),
            )
        ).alias("x"),
    ).select("query_id", "x.is_phrase", "x.p")

    wanted = patterns.select("p").distinct().select("p", F.explode(trigrams(F.col("p"))).alias("gram"))
    texts = live.select(
        "id", "updated_at",
        *[F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("source_title", "search_text", "content")],
    )
    body = F.concat_ws("\n", "source_title", "search_text", "content")
    postings = (
        texts.select("id", body.alias("body"))
        .filter(F.length("body") >= 3)
        .select("id", F.explode(trigrams(F.col("body"))).alias("gram"))
        .join(wanted.select("gram").distinct(), "gram", "left_semi")
    )
    frequency = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    anchor = (
        wanted.join(frequency, "gram", "left")
        .groupBy("p")
        .agg(
            F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("gram"))).alias("a")
        )
        .filter("a.df > 0")
        .select("p", F.col("a.gram").alias("gram"))
    )
    fields = ("source_title", "search_text", "content")
    candidates = anchor.join(postings, "gram").groupBy("id").agg(F.collect_set("p").alias("ps"))
    match = (
        texts.join(candidates, "id")
        .select(
            "id",
            "updated_at",
            F.explode(
                F.transform(
                    "ps",
                    lambda p: F.struct(
                        p.alias("p"), *[F.contains(F.col(c), p).alias(f"in_{c}") for c in fields]
                    ),
                )
            ).alias("m"),
        )
        .select("id", "updated_at", "m.*")
        .filter("in_source_title or in_search_text or in_content")
    )
    scored = patterns.join(match, "p").select(
        "query_id",
        "id",
        "updated_at",
        sum(
            F.when(
                F.col(f"in_{c}"), F.when(F.col("is_phrase"), F.lit(w)).otherwise(F.lit(t))
            ).otherwise(F.lit(0.0))
            for c, w, t in (
                ("source_title", 0.45, 0.18), ("search_text", 0.35, 0.12), ("content", 0.20, 0.06)
            )
        ).alias("part"),
    )
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("updated_at"), F.asc("id"))
    indexed = (
        scored.groupBy("query_id", "id")
        .agg(F.round(F.sum("part"), 9).alias("score"), F.max("updated_at").alias("updated_at"))
        .filter("score > 0")
        .withColumn("rank", F.row_number().over(best).cast("long"))
        .filter(F.col("rank") <= k)
        .select("query_id", "id", "score", "rank")
    )
    return indexed.unionByName(keyword_topk(scan, live, k))


def ngrams(c, n: int):
    """Every run of ``n`` characters, by one overlapping pattern pass.

    Nothing is indexed inside a lambda: the optimizer may inline a column there and evaluate it once
    per element.
    """
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=({'.' * n}))"), 1)


def trigrams(c):
    """Distinct character trigrams."""
    return F.array_distinct(ngrams(c, 3))


def vector_topk_lsh(
    queries: DataFrame, live: DataFrame, k: int, min_score: float = MIN_SCORE,
    bucket_length: float = 0.8, tables: int = 8,
) -> DataFrame:
    """Approximate vector top-k: random-projection buckets on unit vectors, exact rescore.

    Wide buckets hold a good part of all rows, so pairs are not joined: blocks of queries meet parts of the rows, and
    rows that share a bucket with a query are scored there, the best ``k`` of a part leave it.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def unit(df, key, col):
        v = df.filter(F.col(col).isNotNull()).select(
            F.col(key).alias("key"), array_to_vector(F.col(col).cast("array<double>")).alias("raw")
        )
        return Normalizer(inputCol="raw", outputCol="unit", p=2.0).transform(v).select("key", "unit")

    rows, asked = unit(live, "id", "embedding"), unit(queries, "query_id", "query_embedding")
    model = BucketedRandomProjectionLSH(
        inputCol="unit", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=42
    ).fit(rows)

    def hashed(df, label):
        buckets = F.array(*[vector_to_array(F.get("hashes", F.lit(i)))[0].cast("int") for i in range(tables)])
        return written(model.transform(df).select("key", vector_to_array("unit").alias("unit"), buckets.alias("buckets")).distinct(), label)

    rows, asked = hashed(rows, "lsh_rows"), hashed(asked, "lsh_queries")
    hits = vectorcells.bucket_hits(asked, rows, k, min_score).where(F.col("score") >= min_score)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    ranked = hits.select("query_id", "id", "score").withColumn("rank", F.row_number().over(best).cast("long"))
    return ranked.filter(F.col("rank") <= k)


# --- fusion ------------------------------------------------------------------------------------


FACT = ["fact_rank", "fact_chunk_id", "fact_id", "fact_type", "fact_score"]


def channel(hits: DataFrame, name: str, order: int) -> DataFrame:
    """Mark ranked hits with their channel; facts may bring several rows per (query, id)."""
    return hits.select(
        "query_id", "id", "rank", "score", F.lit(name).alias("channel"), F.lit(order).alias("ord")
    )


def fact_channel(expanded: DataFrame, order: int) -> DataFrame:
    """The channel of rows that found facts lead to, a row for each fact at its best rank, for ``fuse(..., keep_matches=True)``."""
    place = F.struct(F.col("fact_rank"), -F.col("fact_score"))
    each = expanded.groupBy("query_id", "id", "fact_chunk_id").agg(F.min_by(F.struct(*FACT), place).alias("match"))
    return each.select(
        "query_id", "id", F.col("match.fact_rank").alias("rank"), F.col("match.fact_score").alias("score"),
        F.lit("kg").alias("channel"), F.lit(order).alias("ord"), "match",
    )


def fuse(channels: list[DataFrame], k: int, keep_first_seen: bool = False, keep_matches: bool = False) -> DataFrame:
    """Reciprocal rank fusion: one vote per (query, row, channel), best rank of the channel.

    ``keep_matches`` adds ``kg_matches``, every fact that led to the row by (rank, fact row), empty where none did.
    """
    hits = channels[0]
    for other in channels[1:]:
        hits = hits.unionByName(other, allowMissingColumns=keep_matches)
    best = F.min(F.struct(F.col("rank"), (-F.col("score")).alias("neg"))).alias("best")
    details = [F.collect_list("match").alias("matches")] if keep_matches else []
    votes = hits.groupBy("query_id", "id", "channel", "ord").agg(best, *details)
    if keep_matches:
        details = [F.sort_array(F.flatten(F.collect_list("matches"))).alias("kg_matches")]

    def score_of(name):
        return F.max(F.when(F.col("channel") == name, -F.col("best.neg")))

    fused = votes.groupBy("query_id", "id").agg(
        F.round(F.sum(1.0 / (RRF_K + F.col("best.rank"))), 9).alias("fused_score"),
        score_of("vector").alias("vector_score"),
        score_of("keyword").alias("keyword_score"),
        score_of("kg").alias("kg_score"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("ord", "channel"))), lambda x: x["channel"]),
            ",",
        ).alias("channels"),
        F.min(F.struct(F.col("ord"), F.col("best.rank").alias("r"))).alias("first_seen"),
        *details,
    )
    order = W.partitionBy("query_id").orderBy(
        F.desc("fused_score"),
        F.desc(F.coalesce("vector_score", F.lit(-1.0))),
        F.desc(F.coalesce("keyword_score", F.lit(-1.0))),
        F.asc("first_seen"),
        F.asc("id"),
    )
    ranked = fused.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
    return ranked if keep_first_seen else ranked.drop("first_seen")


def rerank_merge(
    candidates: DataFrame, provider: DataFrame, k: int, input_size: int | None = None
) -> DataFrame:
    """Merge provider order into fused order.

    ``candidates``: query_id, id, rank (1-based). ``provider``: query_id, position, index (0-based).
    Applied only where there are more than ``k`` candidates; invalid and repeated indexes are
    dropped and the rest is filled up in fused order.
    """
    sized = candidates.join(
        candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id"
    )
    offered = F.least(F.col("n"), F.lit(input_size)) if input_size else F.col("n")
    valid = provider.groupBy("query_id", "index").agg(F.min("position").alias("position"))
    joined = sized.withColumn("index", F.col("rank") - 1).join(valid, ["query_id", "index"], "left")
    accepted = F.when((F.col("n") > k) & (F.col("index") < offered), F.col("position"))
    placed = joined.withColumn("provider_position", accepted)
    order = W.partitionBy("query_id").orderBy(
        F.asc_nulls_last("provider_position"), F.asc("rank")
    )
    per_query = W.partitionBy("query_id")
    return (
        placed.withColumn("rerank_used", F.max(F.col("provider_position").isNotNull()).over(per_query))
        .withColumn("final_rank", F.row_number().over(order).cast("long"))
        .filter(F.col("final_rank") <= k)
        .drop("n", "index", "position", "provider_position")
    )


def candidate_limit(k: int = TOP_K, rerank_input: int = 0) -> int:
    return max(2 * k, k, rerank_input)


def hybrid_channels(
    queries: DataFrame, aliases: DataFrame, live: DataFrame, k: int = TOP_K, rerank_input: int = 0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Terms plus the two ranked channels of a hybrid run."""
    limit = candidate_limit(k, rerank_input)
    terms = keyword_terms(queries, aliases)
    return terms, vector_topk(queries, live, limit), keyword_topk(terms, live, limit)


def hybrid_topk(
    queries: DataFrame,
    aliases: DataFrame,
    live: DataFrame,
    k: int = TOP_K,
    provider=None,
    rerank_input: int = 0,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Whole pipeline for a batch of queries; ``provider(candidates)`` gives rerank positions."""
    limit = candidate_limit(k, rerank_input)
    _, vector, keyword = hybrid_channels(queries, aliases, live, k, rerank_input)
    channels = [channel(vector, "vector", 0), channel(keyword, "keyword", 1)]
    if facts is not None:
        channels.append(channel(facts, "kg", 2))
    fused = fuse(channels, limit)
    if provider is None:
        return fused.filter(F.col("rank") <= k)
    merged = rerank_merge(fused, provider(fused), k, rerank_input or None)
    return merged.drop("rank").withColumnRenamed("final_rank", "rank")


def hybrid_run(
    queries: DataFrame,
    terms: DataFrame,
    live: DataFrame,
    facts: DataFrame,
    k: int = TOP_K,
    provider=None,
    rerank_input: int = 0,
) -> dict[str, DataFrame]:
    """A whole run with its steps kept: ``vector``, ``keyword``, ``kg``, ``fused`` and ``result``.

    ``facts(query_id, id, rank, score)`` are the rows that found facts lead to, a row for each fact. A query without
    a vector has the other two channels. ``result`` holds the best ``k`` rows in the order of
    ``provider(fused)`` where it applies, else of the fusion, with ``fused_rank`` and ``rerank_used``. Vector, keyword
    and fused rows are written, as the result and the trace both read them.
    """
    limit = candidate_limit(k, rerank_input)
    asked = queries.filter("query_embedding is not null")
    steps = {
        "vector": written(vector_topk(asked, live, limit), "vector"),
        "keyword": written(keyword_topk(terms, live, limit), "keyword"),
        "kg": facts,
    }
    fused = written(fuse([channel(hits, name, i) for i, (name, hits) in enumerate(steps.items())], limit), "fused")
    if provider is None:
        ordered = fused.filter(F.col("rank") <= k).withColumns({"fused_rank": F.col("rank"), "rerank_used": F.lit(False)})
    else:
        merged = rerank_merge(fused, provider(fused), k, rerank_input or None)
        ordered = merged.withColumnsRenamed({"rank": "fused_rank", "final_rank": "rank"})
    return {**steps, "fused": fused, "result": ordered}


def hybrid_trace(queries: DataFrame, run: dict[str, DataFrame], parents: DataFrame) -> DataFrame:
    """What each step of a run brought each query, counted from its rows; queries without any stay with zeros."""
    steps = {**run, "parent": parents}
    rows = None
    for name, hits in steps.items():
        ids = hits.select("query_id", "id").distinct() if name == "kg" else hits.select("query_id")
        one = ids.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    counts = rows.groupBy("query_id").agg(
        *[F.sum(F.when(F.col("step") == name, F.col("n")).otherwise(0)).alias(f"{name}_count") for name in steps]
    )
    reranked = run["result"].groupBy("query_id").agg(F.max("rerank_used").alias("rerank_used"))
    traced = queries.select("query_id", "query").join(counts, "query_id", "left").join(reranked, "query_id", "left")
    return traced.fillna(0, [f"{name}_count" for name in steps]).fillna(False, ["rerank_used"])


def parent_context(
    candidates: DataFrame, rows: DataFrame, files: DataFrame, import_chunks: DataFrame, status="usable"
) -> DataFrame:
    """Parents of hit children, re-gated, once per query, without those already candidates."""
    from loreframe.operators.gates import live_documents

    children = rows.filter("chunk_level <> 'parent' and parent_chunk_id is not null").select(
        F.col("id").alias("child_id"), "parent_chunk_id", "source_type", "source_id", "source_chunk_id"
    )
    wanted = (
        candidates.select("query_id", F.col("id").alias("child_id"))
        .join(children, "child_id")
        .select(
            "query_id", F.col("parent_chunk_id").alias("id"), "source_type", "source_id", "source_chunk_id"
        )
        .distinct()
    )
    parents = rows.filter(
        (F.col("chunk_level") == "parent")
        & (F.col("status") == status)
        & (F.col("embedding_status") == "ready")
    )
    documents = live_documents(parents.filter("source_type = 'document'"), files, import_chunks)
    gated = documents.unionByName(parents.filter("source_type <> 'document'"))
    return (
        wanted.join(gated, ["id", "source_type", "source_id", "source_chunk_id"])
        .join(candidates.select("query_id", "id"), ["query_id", "id"], "left_anti")
        .withColumn("score", F.lit(1.0))
    )
