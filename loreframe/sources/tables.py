"""Canonical tables derived from the given parquet tables.

``Tables(spark, sf_dir)`` gives each canonical table as a lazy DataFrame. Nothing is collected and
nothing is cached: a query reads only the columns it needs from the parquet files.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loreframe.functions import text as tx
from loreframe.functions.constants import ENTITY_TYPES
from loreframe.session import prepare

NOW = "2024-01-31 00:00:00"


def now() -> Column:
    return F.expr(f"timestamp_ntz'{NOW}'")


def minus_seconds(seconds: Column) -> Column:
    return F.expr(f"timestamp_ntz'{NOW}'") - F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def strings(*values) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]).cast("array<string>")


# Tables whose rows are expensive to process (long texts, vectors).
TEXT_TABLES = ("documents", "pages", "embeddings")
SMALL_INPUT_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input too small to be split; a large input keeps its own splits.

    A parquet file is only split at row groups, so a small table is one task whatever the split
    size. Columns are still pruned below the exchange.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= SMALL_INPUT_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


class Tables:
    """Raw and canonical tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            self._raw[name] = spread(df) if name in TEXT_TABLES else df
        return self._raw[name]

    # --- traffic -------------------------------------------------------------------------------

    @cached_property
    def query_events(self) -> DataFrame:
        return query_events(self.raw("events"))

    # --- files and chunks ----------------------------------------------------------------------

    @cached_property
    def import_files(self) -> DataFrame:
        return (
            self.raw("documents")
            .groupBy(F.col("source").alias("id"))
            .agg(F.max("doc_id").alias("last_doc"))
            .select(
                "id",
                F.concat("id", F.lit(".md")).alias("original_name"),
                F.lit("markdown").alias("file_type"),
                F.lit("markdown_chat").alias("parser"),
                F.when(F.col("id").endswith("3"), "manual").otherwise("naive").alias("chunker_type"),
                F.lit("needs_review").alias("status"),
                (F.col("id") == "src7").alias("is_disabled"),
                minus_seconds(F.col("last_doc")).alias("updated_at"),
            )
        )

    @cached_property
    def import_chunks(self) -> DataFrame:
        docs = self.raw("documents").select("doc_id", "text", "lang", "source")
        labels = self.raw("labels")
        none = F.lit(None).cast("string")

        def block(text, section, page, kind):
            return F.struct(
                text.alias("text"), section.alias("section_title"), page.cast("int").alias("page_number"), kind.alias("block_type")
            )

        blocks = F.array(
            block(F.concat(F.lit("  "), "text", F.lit(" ")), F.concat(F.lit("A > "), "lang"), F.col("doc_id") % 9, none),
            block(F.lit("   "), F.lit("B"), F.lit(1), F.lit("text")),
            block(F.col("source"), none, F.lit(None), F.lit("table")),
        )
        return docs.join(labels, "doc_id", "left").select(
            F.concat(F.lit("chunk_"), F.col("doc_id").cast("string")).alias("id"),
            F.col("source").alias("file_id"),
            F.col("doc_id").alias("chunk_index"),
            F.col("text").alias("source_text"),
            F.when(F.col("doc_id") % 7 == 3, "`. `\\n").when(F.col("doc_id") % 7 == 5, "").otherwise("\\n").alias("children_delimiter"),
            F.when(F.col("doc_id") % 11 == 4, blocks).otherwise(F.slice(blocks, 1, 0)).alias("source_blocks"),
            strings(F.col("lang")).alias("section_path"),
            F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 50 + 1).cast("int")).alias(
                "page_start"
            ),
            F.when(F.col("doc_id") % 4 > 1, (F.col("doc_id") % 50 + 2).cast("int")).alias(
                "page_end"
            ),
            F.lit("text").alias("block_type"),
            strings(F.col("source"), F.col("lang")).alias("keywords"),
            F.when(F.col("doc_id") % 5 == 0, strings(F.concat(F.lit("What is in "), "source", F.lit("?"))))
            .otherwise(F.array().cast("array<string>"))
            .alias("questions"),
            F.when(F.col("quality") == 0, "needs_review").otherwise("usable").alias(
                "retrieval_status"
            ),
            F.when(F.col("doc_id") % 3 == 0, "generated").otherwise("pending").alias("status"),
            F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_disabled"),
        )

    @cached_property
    def document_chunk_rows(self) -> DataFrame:
        """Searchable rows: one child row per document, with the vector of its number where there is one."""
        docs = self.raw("documents").select("doc_id", "text", "lang", "source")
        vec = self.raw("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
        labels = self.raw("labels").select("doc_id", "quality")
        d = F.col("doc_id").cast("string")
        title = F.concat("source", F.lit(".md"))
        return (
            docs.join(vec, "doc_id", "left")
            .join(labels, "doc_id", "left")
            .select(
                F.concat(F.lit("kc_"), d).alias("id"),
                F.lit("document").alias("source_type"),
                F.col("source").alias("source_id"),
                F.concat(F.lit("chunk_"), d).alias("source_chunk_id"),
                F.lit("child").alias("chunk_level"),
                title.alias("source_title"),
                F.col("text").alias("content"),
                F.concat(title, F.lit("\n"), "lang", F.lit("\n"), "text").alias("search_text"),
                F.when(F.col("quality") == 0, "needs_review").otherwise("usable").alias("status"),
                F.when(F.col("doc_id") % 17 == 0, "stale").otherwise("ready").alias(
                    "embedding_status"
                ),
                minus_seconds(F.col("doc_id")).alias("updated_at"),
                F.col("embedding"),
            )
        )

    @cached_property
    def faq_documents(self) -> DataFrame:
        t = self.raw("benchmark")
        cut = F.instr("text", ".")
        i = F.col("item_id")
        question = F.when(cut > 0, F.expr("substring(text, 1, instr(text, '.'))")).otherwise(
            F.col("text")
        )
        answer = F.when(cut > 0, F.trim(F.expr("substring(text, instr(text, '.') + 1)"))).otherwise("")
        return t.select(
            F.concat(F.lit("faq_"), i.cast("string")).alias("id"),
            question.alias("question"),
            F.when(i % 2 == 0, strings(F.lower(question)))
            .otherwise(F.array().cast("array<string>"))
            .alias("question_variants"),
            answer.alias("answer"),
            F.when(i % 4 == 1, "billing")
            .when(i % 4 == 2, "report")
            .when(i % 4 == 3, "account")
            .alias("category"),
            F.slice(F.split("text", " "), 1, 2).alias("tags"),
            F.element_at(strings("high", "medium", "low"), (i % 3 + 1).cast("int")).alias(
                "confidence"
            ),
            F.when(i % 5 == 0, "needs_review")
            .when(i % 5 == 1, "disabled")
            .otherwise("usable")
            .alias("status"),
            F.element_at(strings("ready", "stale", "pending"), (i % 3 + 1).cast("int")).alias(
                "embedding_status"
            ),
            minus_seconds(i * 60).alias("updated_at"),
            minus_seconds(i * 3600).alias("created_at"),
            i.alias("item_id"),
        )

    @cached_property
    def faq_chunk_rows(self) -> DataFrame:
        """One searchable row per FAQ, with the vector of the same number where there is one."""
        f = self.faq_documents
        vec = self.raw("embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
        return f.join(vec, "item_id", "left").select(
            F.concat(F.lit("kc_faq_"), "id").alias("id"),
            F.lit("faq").alias("source_type"),
            F.col("id").alias("source_id"),
            F.lit(None).cast("string").alias("source_chunk_id"),
            F.lit("chunk").alias("chunk_level"),
            F.col("question").alias("source_title"),
            F.concat(F.lit("问题："), "question", F.lit("\n答案："), "answer").alias("content"),
            F.concat_ws("\n", "question", F.nullif("answer", F.lit("")), "category").alias(
                "search_text"
            ),
            F.col("status"),
            F.col("embedding_status"),
            F.col("updated_at"),
            F.col("embedding"),
        )

    @cached_property
    def knowledge_chunks(self) -> DataFrame:
        return self.document_chunk_rows.unionByName(self.faq_chunk_rows)

    # --- questions -----------------------------------------------------------------------------

    @cached_property
    def queries(self) -> DataFrame:
        vec = self.raw("embeddings").select("vec_id", "embedding")
        docs = self.raw("documents").select(F.col("doc_id").alias("vec_id"), "text")
        return vec.join(docs, "vec_id").select(
            F.col("vec_id").alias("query_id"),
            F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("query"),
            F.col("embedding").alias("query_embedding"),
        )

    @cached_property
    def retrieval_aliases(self) -> DataFrame:
        t = self.raw("benchmark")
        i = F.col("item_id")
        words = F.split("text", " ")
        return t.select(
            F.concat(F.lit("alias_"), i.cast("string")).alias("id"),
            F.lower(F.get(words, F.lit(0))).alias("canonical"),
            F.slice(words, 2, 2).alias("aliases"),
            F.when(i % 4 == 0, "disabled").otherwise("active").alias("status"),
            minus_seconds(i).alias("updated_at"),
        )

    # --- candidates and jobs -------------------------------------------------------------------

    @cached_property
    def import_candidates(self) -> DataFrame:
        turns = self.raw("conversations")
        asked = turns.filter("role = 'user'").select(
            "conv_id", "turn", F.col("text").alias("question")
        )
        said = turns.filter("role = 'assistant'").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
        )
        c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
        return asked.join(said, ["conv_id", "turn"]).select(
            F.concat(F.lit("cand_"), c, F.lit("_"), t).alias("id"),
            F.concat(F.lit("chunk_"), c).alias("chunk_id"),
            "question",
            "answer",
            F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, "saved")
            .when((F.col("conv_id") + F.col("turn")) % 4 == 1, "ignored")
            .otherwise("pending")
            .alias("status"),
            minus_seconds(F.col("conv_id") * 100 + F.col("turn")).alias("created_at"),
        )

    @cached_property
    def job_items(self) -> DataFrame:
        names = strings("queued", "processing", "generated", "skipped", "failed")
        return self.raw("documents").select(
            F.concat(F.lit("job_"), "source").alias("job_id"),
            F.concat(F.lit("chunk_"), F.col("doc_id").cast("string")).alias("chunk_id"),
            F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")).alias("status"),
        )

    @cached_property
    def parse_jobs(self) -> DataFrame:
        d = F.col("doc_id")
        return self.raw("documents").select(
            F.concat(F.lit("pj_"), d.cast("string")).alias("id"),
            F.col("source").alias("file_id"),
            F.element_at(
                strings("completed", "failed", "queued", "processing", "completed"),
                (d % 5 + 1).cast("int"),
            ).alias("status"),
            F.concat(
                F.lit('{"extracted_pages": '), (d % 13).cast("string"),
                F.lit(', "total_pages": '), (d % 9).cast("string"), F.lit("}"),
            ).alias("progress"),
            minus_seconds((d * 37 % 1000) * 60).alias("created_at"),
            minus_seconds((d * 37 % 1000) * 60 - 30).alias("next_attempt_at"),
        )

    @cached_property
    def kg_jobs(self) -> DataFrame:
        d = F.col("doc_id")
        return self.raw("documents").select(
            F.concat(F.lit("kgj_"), d.cast("string")).alias("id"),
            F.lit("document").alias("source_type"),
            F.col("source").alias("source_id"),
            F.element_at(
                strings("completed", "failed", "completed", "queued", "completed", "failed", "completed"),
                (d % 7 + 1).cast("int"),
            ).alias("status"),
            minus_seconds((d * 53 % 1000) * 60).alias("created_at"),
        )

    @cached_property
    def kg_job_items(self) -> DataFrame:
        """Extraction items per enabled chunk, with the locator and text hash seen when planned."""
        d = F.col("doc_id")
        return self.raw("documents").select(
            F.concat(F.lit("kgjob_"), "source").alias("job_id"),
            F.col("source").alias("file_id"),
            F.concat(F.lit("chunk_"), d.cast("string")).alias("chunk_id"),
            d.alias("chunk_order"),
            F.when(d % 29 == 0, F.sha2(F.concat(F.lit("old "), "text"), 256))
            .otherwise(F.sha2("text", 256))
            .alias("source_fingerprint"),
            F.when(d % 31 == 0, strings("moved")).otherwise(strings(F.col("lang"))).alias(
                "section_path"
            ),
            F.when((d % 20 < 10) | (d % 3 != 0), "mapped").otherwise("queued").alias("status"),
        )

    # --- chat ----------------------------------------------------------------------------------

    @cached_property
    def chat_messages(self) -> DataFrame:
        k = F.get_json_object("props", "$.k")
        return self.raw("events").select(
            F.col("user_id").alias("channel"),
            F.col("event_id").alias("pos"),
            F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz").alias("sent_at"),
            F.when(F.col("event_type") == "signup", "[系统]")
            .otherwise(F.col("event_type"))
            .alias("speaker"),
            F.when(F.col("event_type") == "view", "收到")
            .when(F.col("event_type") == "error", F.concat(F.lit("退款 报告 "), k))
            .otherwise(F.concat("event_type", F.lit(" "), k))
            .alias("content"),
        )

    # --- graph ---------------------------------------------------------------------------------

    @cached_property
    def kg_entities(self) -> DataFrame:
        def node(table, prefix, key, name, kind, description):
            k = F.col(key).cast("long")
            return self.raw(table).select(
                F.concat(F.lit(f"kg_ent_{prefix}"), k.cast("string")).alias("id"),
                F.col(name).alias("name"),
                F.lit(kind).alias("entity_type"),
                strings(F.lower(name)).alias("aliases"),
                description.alias("description"),
                F.when(k % 13 == 0, "disabled")
                .when(k % 11 == 0, "needs_review")
                .otherwise("usable")
                .alias("status"),
                (F.lit(0.5) + (k % 5) / 10).alias("confidence"),
                (k % 3).alias("review_revision"),
                minus_seconds(k).alias("updated_at"),
                k.alias("key"),
            )

        no = F.lit("")
        return (
            node("region", "r", "r_regionkey", "r_name", ENTITY_TYPES[0], no)
            .unionByName(node("nation", "n", "n_nationkey", "n_name", ENTITY_TYPES[4], no))
            .unionByName(node("supplier", "s", "s_suppkey", "s_name", ENTITY_TYPES[3], no))
            .unionByName(node("part", "p", "p_partkey", "p_name", ENTITY_TYPES[1], F.col("p_type")))
        )

    @cached_property
    def kg_relations(self) -> DataFrame:
        def edge(df, prefix, a, b, head, tail, kind):
            x, y = F.col(a).cast("long"), F.col(b).cast("long")
            return df.select(
                F.concat(
                    F.lit(f"kg_rel_{prefix}"), x.cast("string"), F.lit("_"), y.cast("string")
                ).alias("id"),
                F.concat(F.lit(f"kg_ent_{head}"), x.cast("string")).alias("head_entity_id"),
                F.lit(kind).alias("relation_type"),
                F.concat(F.lit(f"kg_ent_{tail}"), y.cast("string")).alias("tail_entity_id"),
                F.concat(F.lit(f"{kind} "), (x % 10).cast("string")).alias("description"),
                F.when((x + y) % 7 == 0, "needs_review").otherwise("usable").alias("status"),
                (F.lit(0.5) + ((x + y) % 5) / 10).alias("confidence"),
                ((x + y) % 3).alias("review_revision"),
                minus_seconds((x * 7 + y) % 86400).alias("updated_at"),
            )

        pairs = self.raw("lineitem").select("l_partkey", "l_suppkey").distinct()
        return (
            edge(self.raw("nation"), "n", "n_nationkey", "n_regionkey", "n", "r", "belongs_to")
            .unionByName(
                edge(self.raw("supplier"), "s", "s_suppkey", "s_nationkey", "s", "n", "belongs_to")
            )
            .unionByName(edge(pairs, "p", "l_partkey", "l_suppkey", "p", "s", "available_for"))
        )

    @cached_property
    def kg_evidence(self) -> DataFrame:
        o, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
        excerpt = F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))
        lines = self.raw("lineitem").select(
            F.concat_ws(
                "_", F.lit("kg_ev_l"), o.cast("string"), F.col("l_linenumber").cast("string"),
                p.cast("string"), s.cast("string"),
            ).alias("id"),
            F.lit(None).cast("string").alias("entity_id"),
            F.concat(F.lit("kg_rel_p"), p.cast("string"), F.lit("_"), s.cast("string")).alias(
                "relation_id"
            ),
            F.lit("document").alias("source_type"),
            F.concat(F.lit("src"), (o % 20).cast("string")).alias("source_id"),
            F.concat(F.lit("chunk_"), (o % 1000).cast("string")).alias("source_chunk_id"),
            excerpt.alias("excerpt"),
            F.col("l_linenumber").cast("long").alias("char_start"),
            (F.col("l_linenumber") + F.length(excerpt)).cast("long").alias("char_end"),
            F.col("l_shipdate").alias("created_at"),
        )
        owners = self.kg_entities.select("id", "key", "name")
        faq = owners.select(
            F.concat(F.lit("kg_ev_"), "id").alias("id"),
            F.col("id").alias("entity_id"),
            F.lit(None).cast("string").alias("relation_id"),
            F.lit("faq").alias("source_type"),
            F.concat(F.lit("faq_"), (F.col("key") % 40).cast("string")).alias("source_id"),
            F.lit(None).cast("string").alias("source_chunk_id"),
            F.col("name").alias("excerpt"),
            F.lit(0).cast("long").alias("char_start"),
            F.length("name").cast("long").alias("char_end"),
            minus_seconds(F.col("key")).alias("created_at"),
        )
        return lines.unionByName(faq)

    # --- extraction results --------------------------------------------------------------------

    @cached_property
    def map_entities(self) -> DataFrame:
        """Map results: one entity per distinct capitalised word of a document."""
        words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0))
        types = strings(*ENTITY_TYPES)
        return (
            self.raw("documents")
            # outer, as the planner would look for the words once more to leave out texts without any
            .select("doc_id", "source", "text", F.posexplode_outer(words).alias("pos", "name"))
            .filter("name is not null")
            .select(
                F.concat(F.lit("kgjob_"), "source").alias("job_id"),
                F.col("doc_id").alias("chunk_order"),
                F.col("pos").cast("long").alias("pos"),
                F.col("name"),
                F.element_at(types, (F.length("name") % 6 + 1).cast("int")).alias("entity_type"),
                strings(F.lower("name"), F.upper("name")).alias("aliases"),
                F.concat("name", F.lit(" in "), "source").alias("description"),
                (F.lit(0.5) + (F.col("doc_id") % 5) / 10).alias("confidence"),
                F.col("name").alias("excerpt"),
                (F.expr("locate(name, text)") - 1).cast("long").alias("char_start"),
                (F.expr("locate(name, text)") - 1 + F.length("name")).cast("long").alias("char_end"),
            )
        )

    @cached_property
    def map_relations(self) -> DataFrame:
        """Map results: each entity of a document related to the next one.

        Some tails have another type than their entity, so that the relation lacks an end.
        """
        words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0))
        kinds = strings("belongs_to", "requires", "causes")
        types = strings(*ENTITY_TYPES)
        pairs = F.zip_with(
            F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))),
            F.filter("w", lambda _, i: i > 0),
            lambda a, b: F.struct(a.alias("head"), b.alias("tail")),
        )
        place = F.col("doc_id") + F.col("i")
        return (
            self.raw("documents")
            .withColumn("w", words)
            .select("doc_id", "source", F.posexplode_outer(pairs).alias("i", "p"))
            .filter("p is not null")
            .select(
                F.concat(F.lit("kgjob_"), "source").alias("job_id"),
                F.col("doc_id").alias("chunk_order"),
                F.col("p.head").alias("head_name"),
                F.element_at(types, (F.length("p.head") % 6 + 1).cast("int")).alias("head_type"),
                F.element_at(kinds, (place % 3 + 1).cast("int")).alias("relation_type"),
                F.col("p.tail").alias("tail_name"),
                F.element_at(
                    types, ((F.length("p.tail") + F.when(place % 13 == 7, 1).otherwise(0)) % 6 + 1).cast("int")
                ).alias("tail_type"),
                F.concat("p.head", F.lit(" - "), "p.tail").alias("description"),
                (F.lit(0.5) + (F.col("doc_id") % 5) / 10).alias("confidence"),
            )
        )

    # --- evaluation ----------------------------------------------------------------------------

    @cached_property
    def eval_cases(self) -> DataFrame:
        v = F.col("query_id")
        return self.queries.select(
            F.concat(F.lit("case_"), v.cast("string")).alias("id"),
            v.alias("query_id"),
            F.col("query").alias("question"),
            F.when(v % 6 == 5, F.array().cast("array<string>"))
            .when(v % 7 == 0, strings(F.concat(F.lit("src"), (v % 20).cast("string"))))
            .otherwise(
                strings(
                    F.concat(F.lit("kc_"), v.cast("string")),
                    F.concat(F.lit("kc_"), (v + 1).cast("string")),
                    F.concat(F.lit("kc_kg_entity_"), v.cast("string")),
                )
            )
            .alias("expected_source_ids"),
            F.when(v % 5 == 4, "disabled").otherwise("active").alias("status"),
            minus_seconds(v).alias("updated_at"),
        )

    @cached_property
    def eval_runs(self) -> DataFrame:
        v = F.col("vec_id")
        grid = self.raw("embeddings").select("vec_id").select(
            "vec_id",
            F.explode(F.array(F.lit(1), F.lit(2))).alias("s"),
        ).select("vec_id", "s", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
        ids = F.transform(
            F.sequence(F.lit(0), F.lit(4)),
            lambda i: F.concat(
                F.lit("kc_"), (v + F.col("n") * F.col("s") - 2 + i).cast("string")
            ),
        )
        return grid.filter(~((v % 10 == 3) & (F.col("s") == 2))).select(
            F.concat_ws(
                "_", F.lit("run"), v.cast("string"), F.col("s").cast("string"),
                F.col("n").cast("string"),
            ).alias("id"),
            F.concat(F.lit("case_"), v.cast("string")).alias("case_id"),
            F.when(F.col("s") == 1, "retrieval_hybrid_v1")
            .otherwise("retrieval_hybrid_v1_kg_debug")
            .alias("strategy"),
            F.when(v % 9 == 0, 1).otherwise(2).alias("contract_version"),
            F.when(v % 8 == 1, F.array().cast("array<string>")).otherwise(ids).alias(
                "retrieved_ids"
            ),
            F.concat(F.lit("src"), (v % 20).cast("string")).alias("retrieved_source"),
            minus_seconds(v * 10 + F.col("n") * F.when(v % 2 == 0, 3).otherwise(-3)).alias(
                "created_at"
            ),
        )


def query_events(events: DataFrame) -> DataFrame:
    """Query log rows from raw events; works on a batch or a stream."""
    k = F.get_json_object("props", "$.k").cast("long")
    q = F.concat("event_type", F.lit(" item "), (k % 25).cast("string"))
    ids = F.transform(
        F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: i < k % 4),
        lambda i: F.concat(F.lit("kc_"), ((k + 7 * i) % 100).cast("string")),
    )
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.when(k % 2 == 1, F.concat(F.lit("  "), F.upper(q), F.lit(" "))).otherwise(q).alias("query"),
        F.col("event_type").alias("intent"),
        (k % 4).alias("hit_count"),
        F.when(k % 4 > 0, F.least(F.col("value") / 100, F.lit(1.0))).alias("top_score"),
        F.when(k % 10 == 0, F.concat(ids, strings(""))).otherwise(ids).alias("retrieved_chunk_ids"),
        (k % 2 == 0).alias("rerank_used"),
        F.floor(F.col("value") * 10).cast("long").alias("latency_ms"),
        F.when(F.col("user_id") % 2 == 0, "mcp").otherwise("web").alias("requester_type"),
        F.when(F.col("user_id") % 11 == 0, F.lit("  "))
        .otherwise(F.col("user_id").cast("string"))
        .alias("requester_id"),
    )
