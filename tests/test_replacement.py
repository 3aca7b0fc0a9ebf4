"""Replacing a source's extraction and a file's parse, against small tables worked out by hand."""

import pytest
from pyspark.sql import functions as F

from loreframe.operators import replacement as rp

ENTITY = "id string, name string, entity_type string, aliases array<string>, description string, status string, confidence double, review_revision long, updated_at int"
RELATION = "id string, head_entity_id string, relation_type string, tail_entity_id string, description string, status string, confidence double, review_revision long, updated_at int"
EVIDENCE = "id string, entity_id string, relation_id string, source_type string, source_id string, source_chunk_id string"


@pytest.fixture
def graph(spark):
    def entity(i, revision=4):
        return (i, i.upper(), "t", [], "old", "usable", 0.5, revision, 0)

    entities = spark.createDataFrame([entity(i) for i in "abcd"], ENTITY)
    relations = spark.createDataFrame(
        [("r1", "a", "uses", "b", "old", "usable", 0.5, 2, 0), ("r2", "c", "uses", "d", "old", "usable", 0.5, 2, 0)], RELATION
    )
    evidence = spark.createDataFrame(
        [
            ("e1", "a", None, "document", "f", "f1"), ("e2", "b", None, "document", "g", "g1"),
            ("e3", None, "r2", "document", "g", "g1"), ("e4", None, "r1", "document", "f", "f2"),
            ("e5", "a", None, "faq", "f", None), ("e6", "c", None, "document", "g", "g1"),
        ],
        EVIDENCE,
    )
    return rp.Graph(entities, relations, evidence)


def found(spark, entities=(), relations=(), evidence=()):
    return rp.Graph(
        spark.createDataFrame(list(entities), "id string, name string, entity_type string, aliases array<string>, description string, status string, confidence double"),
        spark.createDataFrame(list(relations), "id string, head_entity_id string, relation_type string, tail_entity_id string, description string, status string, confidence double"),
        spark.createDataFrame(list(evidence), EVIDENCE),
    )


def state(df):
    return {r["id"]: (r["description"], r["status"], r["review_revision"], r["live_count"], r["updated_at"]) for r in df.collect()}


def scope(spark, *rows, chunk=False):
    return spark.createDataFrame(list(rows), "source_type string, source_id string" + (", source_chunk_id string" if chunk else ""))


UNTOUCHED = ("old", "usable", 4, None, 0)


def test_new_extraction(spark, graph):
    def new(i, d="new"):
        return (i, i, "t", ["x"], d, "needs_review", 0.9)

    got = rp.replace_snapshot(
        graph, scope(spark, ("document", "f"), ("document", "f"), (None, None)),
        found(
            spark,
            [new("b"), new("z"), new("z", "a second row of one id")],
            [("r3", "b", "uses", "z", "new", "needs_review", 0.9), ("r1", "q", "other", "q", "new", "needs_review", 0.9)],
            [("n1", None, "r3", "document", "f", "f1"), ("n2", "z", None, "document", "f", "off"), ("e2", "z", None, "document", "f", "f1")],
        ),
        lambda e: e.where("coalesce(source_chunk_id, '') <> 'off'"), F.lit(9),
    )
    assert {r["id"]: r["entity_id"] for r in got.evidence.collect()} == {"e2": "b", "e3": None, "e5": "a", "e6": "c", "n1": None, "n2": "z"}
    assert state(got.entities) == {
        "a": ("old", "needs_review", 5, 1, 9), "b": ("new", "needs_review", 5, 1, 9), "c": UNTOUCHED, "d": UNTOUCHED,
        "z": ("a second row of one id", "disabled", 1, 0, 9),
    }
    assert state(got.relations) == {
        "r1": ("new", "disabled", 3, 0, 9), "r2": ("old", "usable", 2, None, 0), "r3": ("new", "needs_review", 1, 1, 9),
    }
    ends = {r["id"]: (r["head_entity_id"], r["relation_type"]) for r in got.relations.collect()}
    assert ends == {"r1": ("a", "uses"), "r2": ("c", "uses"), "r3": ("b", "uses")}


def test_only_some_chunks(spark, graph):
    got = rp.replace_snapshot(graph, scope(spark, ("document", "f", "f2"), chunk=True), found(spark), lambda e: e, F.lit(9))
    assert {r["id"] for r in got.evidence.collect()} == {"e1", "e2", "e3", "e5", "e6"}
    assert all(s == UNTOUCHED for s in state(got.entities).values())
    assert state(got.relations)["r1"] == ("old", "disabled", 3, 0, 9)


def test_nothing_to_replace(spark, graph):
    got = rp.replace_snapshot(graph, scope(spark, ("faq", "g")), found(spark), lambda e: e, F.lit(9))
    assert [t.drop("live_count").exceptAll(b).count() for t, b in zip(got, graph)] == [0, 0, 0]
    empty = rp.Graph(*[t.limit(0) for t in graph])
    assert [t.count() for t in rp.replace_snapshot(empty, scope(spark), found(spark), lambda e: e, F.lit(9))] == [0, 0, 0]


def test_reparse(spark, graph):
    chunks = spark.createDataFrame([("f1", "f", 1), ("f2", "f", 2), ("g1", "g", 1)], "id string, file_id string, page int")
    parsed = spark.createDataFrame([("f9", "f"), ("f1", "f"), ("x", "elsewhere")], "id string, file_id string")
    rows = spark.createDataFrame([("k1", "document", "f"), ("k2", "faq", "f"), ("k3", "document", "g")], "id string, source_type string, source_id string")
    files = spark.createDataFrame([("f",), ("h",), (None,)], "id string")

    def live(evidence, after):
        return evidence.join(after.select(F.col("id").alias("source_chunk_id")), "source_chunk_id", "left_semi")

    got = rp.reparse(files, chunks, parsed, rows, graph, live, F.lit(9))
    assert {(r["id"], r["page"]) for r in got.chunks.collect()} == {("f9", None), ("f1", None), ("g1", 1)}
    assert {r["id"] for r in got.rows.collect()} == {"k2", "k3"}
    assert {r["id"] for r in got.graph.evidence.collect()} == {"e2", "e3", "e5", "e6"}
    assert state(got.graph.entities)["a"] == ("old", "disabled", 5, 0, 9)
    assert state(got.graph.relations)["r1"] == ("old", "disabled", 3, 0, 9)
    assert {tuple(r) for r in got.files.collect()} == {("f", "needs_review", 2), ("h", "needs_review", 0)}
