"""Strict parsing of stored extraction answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loreframe.functions import text as tx
from loreframe.functions.constants import ENTITY_TYPES, RELATION_TYPES

ENTITY = (
    "name:string,entity_type:string,aliases:array<string>,description:string,confidence:double,"
    "evidence:array<struct<excerpt:string>>"
)
RELATION = (
    "head:string,head_type:string,relation_type:string,tail:string,tail_type:string,description:string,"
    "confidence:double,evidence:array<struct<excerpt:string>>"
)
TOP_FIELDS = ["entities", "relations"]
ENTITY_FIELDS = ["name", "entity_type", "aliases", "description", "confidence", "evidence"]
RELATION_FIELDS = [
    "head", "head_type", "relation_type", "tail", "tail_type", "description", "confidence", "evidence",
]


def _exact(obj: Column, fields: list[str]) -> Column:
    """The object has exactly these fields."""
    keys, wanted = F.json_object_keys(obj), F.array(*[F.lit(f) for f in fields])
    return F.coalesce((F.size(keys) == len(fields)) & (F.size(F.array_except(keys, wanted)) == 0), F.lit(False))


def _bad_evidence(evidence: Column, text: Column) -> Column:
    return F.when(F.coalesce(F.size(evidence), F.lit(0)) < 1, True).otherwise(
        F.exists(evidence, lambda e: tx.blank(e["excerpt"]) | ~F.contains(text, F.coalesce(e["excerpt"], F.lit(""))))
    )


def parse_extractions(responses: DataFrame) -> DataFrame:
    """(job_id, chunk_order, reject, kind, id, name, char_start, char_end) of stored answers.

    ``responses``: job_id, chunk_order, answer, source_text. One bad item rejects its whole answer;
    a relation's missing endpoints are added as entities. All rules are columns, no shuffle.
    """
    body = tx.strip_fence(F.col("answer"))
    raw = responses.withColumn("body", body).withColumn(
        "raw_entities", F.from_json(F.get_json_object("body", "$.entities"), "array<string>")
    ).withColumn("raw_relations", F.from_json(F.get_json_object("body", "$.relations"), "array<string>"))
    parsed = raw.withColumns(
        {
            "entities": F.from_json(F.get_json_object("body", "$.entities"), f"array<struct<{ENTITY}>>"),
            "relations": F.from_json(F.get_json_object("body", "$.relations"), f"array<struct<{RELATION}>>"),
        }
    )
    text = F.col("source_text")

    def bad_number(c):
        return c.isNull() | F.isnan(c) | ~c.between(0.0, 1.0)

    ids = F.transform("entities", lambda e: F.concat_ws("|", tx.name_key(e["name"]), e["entity_type"]))
    facts = F.transform(
        "relations",
        lambda r: F.concat_ws(
            "|", tx.name_key(r["head"]), r["head_type"], r["relation_type"], tx.name_key(r["tail"]), r["tail_type"]
        ),
    )
    reject = (
        F.when(~_exact(F.col("body"), TOP_FIELDS), "fields")
        .when(F.col("entities").isNull() | F.col("relations").isNull(), "not_lists")
        .when(F.exists("raw_entities", lambda e: ~_exact(e, ENTITY_FIELDS)), "entity_fields")
        .when(F.exists("raw_relations", lambda r: ~_exact(r, RELATION_FIELDS)), "relation_fields")
        .when(F.exists("entities", lambda e: tx.blank(e["name"]) | ~e["entity_type"].isin(ENTITY_TYPES)), "entity_value")
        .when(
            F.exists(
                "relations",
                lambda r: tx.blank(r["head"]) | tx.blank(r["tail"]) | ~r["relation_type"].isin(RELATION_TYPES)
                | ~r["head_type"].isin(ENTITY_TYPES) | ~r["tail_type"].isin(ENTITY_TYPES),
            ),
            "relation_value",
        )
        .when(
            F.exists("entities", lambda e: bad_number(e["confidence"]))
            | F.exists("relations", lambda r: bad_number(r["confidence"])),
            "confidence",
        )
        .when(
            F.exists("entities", lambda e: _bad_evidence(e["evidence"], text))
            | F.exists("relations", lambda r: _bad_evidence(r["evidence"], text)),
            "evidence",
        )
        .when((F.size(F.array_distinct("ids")) < F.size("ids")) | (F.size(F.array_distinct("facts")) < F.size("facts")), "duplicate")
    )
    # each step is a column of its own: written out again inside a lambda or a filter it would run for every element
    checked = parsed.withColumns({"ids": ids, "facts": facts}).withColumn("reject", reject)

    def item(kind, name, entity_type, excerpt):
        return F.struct(
            kind.alias("kind"), tx.entity_id(name, entity_type).alias("id"), tx.strip(name).alias("name"),
            entity_type.alias("entity_type"), excerpt.alias("excerpt"),
        )

    good = F.col("reject").isNull()
    own = F.transform(
        "entities", lambda e: item(F.lit("entity"), e["name"], e["entity_type"], F.get(e["evidence"], F.lit(0))["excerpt"])
    )
    ends = F.flatten(
        F.transform(
            "relations",
            lambda r: F.array(
                item(F.lit("endpoint"), r["head"], r["head_type"], F.get(r["evidence"], F.lit(0))["excerpt"]),
                item(F.lit("endpoint"), r["tail"], r["tail_type"], F.get(r["evidence"], F.lit(0))["excerpt"]),
            ),
        )
    )
    found = checked.select(
        "job_id", "chunk_order", "reject", "source_text", F.when(good, own).alias("own"), F.when(good, ends).alias("ends")
    )
    # few ends have no entity of their own; only these are compared with each other
    missing = F.array_except(F.transform("ends", lambda x: x["id"]), F.transform("own", lambda x: x["id"]))
    found = found.withColumn("missing", missing)
    added = F.array_distinct(F.filter("ends", lambda x: F.array_contains("missing", x["id"])))
    found = found.withColumn("items", F.concat("own", added))
    # places are looked up before the rows multiply, so a text is not copied for each of them
    placed = F.transform(
        "items",
        lambda x: F.struct(
            x["kind"].alias("kind"), x["id"].alias("id"), x["name"].alias("name"),
            F.position(x["excerpt"], text).alias("at"), F.length(x["excerpt"]).alias("n"),
        ),
    )
    none = F.lit(None).cast("struct<kind:string,id:string,name:string,at:int,n:int>")
    rows = found.select(
        "job_id", "chunk_order", "reject", F.explode(F.when(good, placed).otherwise(F.array(none))).alias("x")
    )
    return rows.select(
        "job_id", "chunk_order", "reject", "x.kind", "x.id", "x.name",
        (F.col("x.at") - 1).cast("long").alias("char_start"),
        (F.col("x.at") - 1 + F.col("x.n")).cast("long").alias("char_end"),
    )
