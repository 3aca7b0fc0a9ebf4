"""Model-assisted batch steps: injected callables with deterministic defaults, stored-answer parsing."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loreframe.functions import text as tx
from loreframe.functions.constants import INTENTS

EmbedFn = Callable[[list[str]], list]
ScoreFn = Callable[[list[str], list[str]], list[float]]


def hashed_ngrams(texts: list[str], dims: int = 64) -> list[np.ndarray]:
    """Unit-norm hashed character trigrams: the default embedder, same result on every machine."""
    out = []
    for text in texts:
        v = np.zeros(dims, dtype=np.float32)
        for i in range(max(len(text) - 2, 1)):
            h = zlib.crc32(text[i : i + 3].encode())
            v[h % dims] += 1.0 if h & 0x10000 else -1.0
        norm = float(np.linalg.norm(v))
        out.append(v / norm if norm else v)
    return out


def term_overlap(queries: list[str], documents: list[str]) -> list[float]:
    """Share of the query's words found in the document: the default rerank score."""
    scores = []
    for q, d in zip(queries, documents):
        words = set(q.lower().split())
        scores.append(len(words & set(d.lower().split())) / len(words) if words else 0.0)
    return scores


def embed_rows(
    rows: DataFrame, text: str, embed: EmbedFn = hashed_ngrams, model: str = "hashed-ngrams", batch: int = 256
) -> DataFrame:
    """Adds embedding, model, dimensions and error; a failing batch is retried row by row."""
    out = rows.select("id", F.col(text).alias("__text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                texts = part["__text"].tolist()
                try:
                    vectors, errors = list(embed(texts)), [None] * len(texts)
                except Exception:  # noqa: BLE001  a model callable may raise anything
                    vectors, errors = [], []
                    for one in texts:
                        try:
                            vectors.append(embed([one])[0])
                            errors.append(None)
                        except Exception as e:  # noqa: BLE001
                            vectors.append(None)
                            errors.append(str(e)[:500])
                yield pd.DataFrame(
                    {
                        "id": part["id"].tolist(),
                        "embedding": [None if v is None else np.asarray(v, dtype=np.float32) for v in vectors],
                        "embedding_model": model,
                        "embedding_dimensions": [0 if v is None else len(v) for v in vectors],
                        "embedding_error": errors,
                    }
                )

    return out.mapInPandas(
        run,
        "id string, embedding array<float>, embedding_model string, embedding_dimensions int, embedding_error string",
    )


def rerank_scores(pairs: DataFrame, score: ScoreFn = term_overlap) -> DataFrame:
    """(query_id, index, position) for (query_id, query, index, content); failures give no row."""
    from pyspark.sql import Window as W

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                values = score(pdf["query"].tolist(), pdf["content"].tolist())
            except Exception:  # noqa: BLE001
                continue
            yield pd.DataFrame({"query_id": pdf["query_id"], "index": pdf["index"], "score": values})

    scored = pairs.select("query_id", "query", "index", "content").mapInPandas(
        run, "query_id long, index long, score double"
    )
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("index"))
    return scored.withColumn("position", (F.row_number().over(best) - 1).cast("long"))


def fenced_object(c: Column) -> Column:
    """The JSON object of an answer, inside a code fence or bare."""
    s = tx.strip(c)
    inside = F.regexp_extract(s, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(inside != "", inside).otherwise(s)


def parse_questions(answer: Column, limit: int = 5) -> Column:
    """First distinct questions of a stored answer."""
    listed = F.from_json(F.get_json_object(fenced_object(answer), "$.questions"), "array<string>")
    return F.slice(F.array_distinct(tx.clean_items(F.coalesce(listed, F.array().cast("array<string>")))), 1, limit)


CANDIDATE = "question:string,answer:string,similar_questions:array<string>,category:string,tags:array<string>,confidence:string,source_excerpt:string"


def parse_candidates(answers: DataFrame) -> DataFrame:
    """(chunk_id, n, question, answer, ...) with defaults; items without both texts are dropped."""
    items = F.from_json(
        F.get_json_object(fenced_object(F.col("answer")), "$.candidates"), f"array<struct<{CANDIDATE}>>"
    )
    empty = F.array().cast("array<string>")
    return (
        answers.select("chunk_id", F.posexplode(items).alias("n", "c"))
        .select(
            "chunk_id",
            F.col("n").cast("long").alias("n"),
            tx.strip("c.question").alias("question"),
            tx.strip("c.answer").alias("answer"),
            tx.clean_items(F.coalesce("c.similar_questions", empty)).alias("similar_questions"),
            tx.none_if_blank(F.col("c.category")).alias("category"),
            tx.clean_items(F.coalesce("c.tags", empty)).alias("tags"),
            F.coalesce(tx.none_if_blank(F.col("c.confidence")), F.lit("medium")).alias("confidence"),
            tx.strip(F.coalesce("c.source_excerpt", F.lit(""))).alias("source_excerpt"),
        )
        .filter("question <> '' and answer <> ''")
    )


def intent_with_fallback(rules: DataFrame, answers: DataFrame) -> DataFrame:
    """Model answers replace the rule result only where the rules are not sure and the answer is valid."""
    parsed = answers.select("id", "answer", F.from_json("answer", "intent string, confidence string, query_rewrite string").alias("m"))
    valid = F.coalesce(F.nullif("m.intent", F.lit("")), F.lit("faq_exact"))
    good = parsed.filter(F.json_object_keys("answer").isNotNull()).select(
        "id", valid.alias("model_intent"), F.coalesce(F.nullif("m.confidence", F.lit("")), F.lit("medium")).alias("model_confidence")
    ).filter(F.col("model_intent").isin(INTENTS))
    use = (F.col("confidence") != "high") & F.col("model_intent").isNotNull()
    return rules.join(good, "id", "left").select(
        "id",
        F.when(use, F.col("model_intent")).otherwise(F.col("intent")).alias("intent"),
        F.when(use, F.col("model_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        use.alias("from_model"),
    )
