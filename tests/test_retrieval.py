"""Fusion, rerank, block top-k and the indexed form against plain Python."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loreframe.operators import patternsearch, retrieval as rt, vectorcells
from loreframe.operators.scorers import LikePattern, PatternSet


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id string, rank long, score double")


def test_fusion_adds_votes_and_keeps_first_seen_order(spark):
    v = rt.channel(hits(spark, [(1, "a", 1, 0.9), (1, "b", 2, 0.8)]), "vector", 0)
    k = rt.channel(hits(spark, [(1, "b", 1, 0.5), (1, "c", 2, 0.4)]), "keyword", 1)
    rows = rt.fuse([v, k], 10).orderBy("rank").collect()
    assert [r.id for r in rows] == ["b", "a", "c"]
    assert rows[0].channels == "vector,keyword"
    assert abs(rows[0].fused_score - round(1 / 62 + 1 / 61, 9)) < 1e-12


def test_one_fact_vote_per_row_with_its_best_rank(spark):
    kg = rt.channel(hits(spark, [(1, "a", 5, 0.2), (1, "a", 2, 0.7), (1, "a", 2, 0.9)]), "kg", 2)
    r = rt.fuse([kg], 5).first()
    assert abs(r.fused_score - round(1 / 62, 9)) < 1e-12 and r.kg_score == 0.9


def test_rerank_fills_up_and_skips_small_sets(spark):
    c = spark.createDataFrame([(1, f"d{i}", i) for i in range(1, 6)] + [(2, "x", 1), (2, "y", 2)], "query_id long, id string, rank long")
    p = spark.createDataFrame([(1, 0, 3), (1, 1, 3), (1, 2, 99), (1, 3, -1), (1, 4, 1), (2, 0, 1)], "query_id long, position long, index long")
    rows = rt.rerank_merge(c, p, 3).orderBy("query_id", "final_rank").collect()
    assert [r.id for r in rows if r.query_id == 1] == ["d4", "d2", "d1"]
    assert [r.id for r in rows if r.query_id == 2] == ["x", "y"]
    assert {r.query_id: r.rerank_used for r in rows} == {1: True, 2: False}


def vector_tables(spark, rows, queries):
    r = [(f"r{i}", i % 3, None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)]
    q = [(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(queries)]
    return (
        spark.createDataFrame(q, "query_id long, query_embedding array<float>"),
        spark.createDataFrame(r, "id string, tie long, embedding array<float>"),
    )


def brute_vectors(rows, queries, k, least):
    unit = lambda v: np.asarray(v, np.float32).astype(float) / np.linalg.norm(np.asarray(v, np.float32).astype(float))
    out = []
    for qi, q in enumerate(queries):
        if q is None or not np.any(q):
            continue
        scored = [(-round(float(unit(r) @ unit(q)), 9), -(i % 3), f"r{i}") for i, r in enumerate(rows) if r is not None and np.any(r)]
        best = sorted(x for x in scored if -x[0] >= least)[:k]
        out += [(qi, x[2], n) for n, x in enumerate(best, 1)]
    return out


def grouped(rng, groups, each, width=16, spread=0.05):
    centres = rng.normal(size=(groups, width))
    return [centres[i % groups] + spread * rng.normal(size=width) for i in range(groups * each)]


@pytest.mark.parametrize("unit_bytes,per_block", [(8 << 20, 2048), (128 * 20, 7), (128 * 3, 3)])
@pytest.mark.parametrize("kind,least", [("spread", -1.0), ("groups", 0.35), ("copies", 0.9)])
def test_vector_cells_equal_brute_force(spark, unit_bytes, per_block, kind, least):
    rng = np.random.default_rng(5)
    rows = {
        "spread": lambda: list(rng.normal(size=(300, 16))),
        "groups": lambda: grouped(rng, 12, 25),
        "copies": lambda: grouped(rng, 2, 20) + [np.ones(16)] * 150,  # half of all rows in one place
    }[kind]() + [None, np.zeros(16)]
    queries = rows[::11] + [rng.normal(size=16), None, np.zeros(16)]
    q, r = vector_tables(spark, rows, queries)
    got = vectorcells.exact_topk(q, r.repartition(4), 6, least, per_block=per_block, unit_bytes=unit_bytes)
    assert sorted((x.query_id, x.id, x["rank"]) for x in got.collect()) == sorted(
        (a, b, c) for a, b, c in brute_vectors(rows, queries, 6, least)
    )


def test_a_cell_keeps_few_scores_at_a_time():
    """Only pairs that can be among the best are ordered; no table of all pairs of a cell is held."""
    rng = np.random.default_rng(8)
    rows, queries = rng.normal(size=(4096, 32)).astype(np.float32), rng.normal(size=(2048, 32)).astype(np.float32)
    lists = lambda m: pa.array(list(m), pa.list_(pa.float32()))
    asked = pa.table({"query_id": np.arange(2048), "query_embedding": lists(queries), "bound": np.full(2048, 0.3)})
    offered = pa.table({"id": [f"r{i:04d}" for i in range(4096)], "tie": np.arange(4096) % 3, "embedding": lists(rows)})
    tracemalloc.start()
    got = vectorcells._score_cell(5)(asked, offered)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1)[:, None]
    scores = np.round(unit(queries) @ unit(rows).T, 9)
    want = {
        (q, f"r{i:04d}") for q, s in enumerate(scores) for _, _, i in sorted((-s[i], -(i % 3), i) for i in np.flatnonzero(s >= 0.3))[:5]
    }
    assert {(q, i) for q, i in zip(got.column("query_id").to_pylist(), got.column("id").to_pylist())} == want


def test_groups_leave_most_rings_unread(spark):
    rows = grouped(np.random.default_rng(2), 40, 50)
    q, r = vector_tables(spark, rows, rows[::17])
    seen = vectorcells.ring_visits(q, r, 5, 0.35, unit_bytes=128 * 50).collect()
    assert len(seen) == len(rows[::17]) and seen[0].rows == 2000 and seen[0].rings > 30
    assert np.mean([x.rows_read / x.rows for x in seen]) < 0.15


def test_coded_search_finds_nine_of_ten(spark):
    rng = np.random.default_rng(4)
    for rows in (list(rng.normal(size=(1500, 64))), grouped(rng, 30, 50, 64, 0.6)):
        q, r = vector_tables(spark, rows, rows[::10])
        exact = {(x.query_id, x.id) for x in vectorcells.exact_topk(q, r, 5, 0.35).collect()}
        candidates = vectorcells.coded_candidates(q, r, 5, 0.35, unit_bytes=512 * 200)
        found = {(x.query_id, x.id): x.score for x in vectorcells.rescored(candidates, q, r, 5, 0.35).collect()}
        assert len(exact & found.keys()) >= 0.9 * len(exact)
        assert candidates.count() <= 0.05 * len(rows) * len(rows[::10])


def test_no_vectors(spark):
    q, r = vector_tables(spark, [None, np.zeros(4)], [np.ones(4)])
    assert vectorcells.exact_topk(q, r, 3, -1.0).collect() == []
    assert vectorcells.exact_topk(q, r.limit(0), 3, -1.0).collect() == []
    assert vectorcells.exact_topk(q.limit(0), vector_tables(spark, [np.ones(4)], [])[1], 3, -1.0).collect() == []


def lexical(spark, seed=3):
    rnd = random.Random(seed)
    words = ["the", "report", "Error", "a_b", "100%", "export", "报告", "é", "x1"]
    docs = [
        (f"d{i:02d}", " ".join(rnd.choices(words, k=2)), " ".join(rnd.choices(words, k=6)), " ".join(rnd.choices(words, k=4)), i % 5)
        for i in range(40)
    ]
    rows = spark.createDataFrame(docs, "id string, source_title string, search_text string, content string, n int").withColumn(
        "updated_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, n, 0)")
    )
    qs = [(i, " ".join(rnd.choices(words, k=2)), rnd.sample(words, 3)) for i in range(12)] + [(99, " ", ["the"]), (98, "report", [])]
    return docs, rows, qs, spark.createDataFrame(qs, "query_id long, query string, terms array<string>")


def contains(text, pattern):
    import re

    rx = "".join({"%": ".*", "_": "."}.get(c) or re.escape(c) for c in pattern.lower())
    return re.search(rx, text.lower(), re.S) is not None


def brute(docs, qs, k):
    out = {}
    for qid, query, terms in qs:
        if not query.strip():
            continue
        scored = []
        for d in docs:
            s = 0.0
            for field, wp, wt in ((d[1], 0.45, 0.18), (d[2], 0.35, 0.12), (d[3], 0.20, 0.06)):
                s += wp * contains(field, query.strip())
                s += sum(wt * contains(field, t) for t in (terms or [query.strip()]))
            if s > 0:
                scored.append((-round(s, 9), -d[4], d[0]))
        out[qid] = [x[2] for x in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("block,warm_up,cells", [(16 << 20, 64, 1 << 21), (3000, 2, 50), (1, 1, 7)])
def test_keyword_forms_equal_brute_force(spark, monkeypatch, block, warm_up, cells):
    monkeypatch.setattr(patternsearch, "BLOCK_BYTES", block)
    monkeypatch.setattr(patternsearch, "WARM_UP", warm_up)
    monkeypatch.setattr(patternsearch, "CELLS", cells)
    docs, rows, qs, terms = lexical(spark)
    want = brute(docs, qs, 5)
    forms = [rt.keyword_topk(terms, rows.repartition(7), 5)] if block > 1 else [rt.keyword_topk(terms.limit(5), rows, 5)]
    if block > 3000:
        forms.append(rt.keyword_topk_indexed(terms, rows, 5))
    asked = {r.query_id for r in (terms if block > 1 else terms.limit(5)).collect()}
    for result in forms:
        got = {}
        for r in result.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == {k: v for k, v in want.items() if v and k in asked}


@pytest.mark.parametrize("letters,passes", [(1 << 20, 1), (40, 2)])
def test_blocks_of_queries_share_a_pass_and_rounds_are_exact(spark, monkeypatch, letters, passes):
    """One pass over the texts for all blocks whose patterns fit; the newest rows first, then older ones that must score more."""
    for name, value in {"BLOCK_BYTES": 3000, "GROUP_LETTERS": letters, "FIRST_ROUND": 2, "GROWTH": 2, "DENSE": 64}.items():
        monkeypatch.setattr(patternsearch, name, value)
    tables = []
    plain = patternsearch.written
    monkeypatch.setattr(patternsearch, "written", lambda df, label: tables.append(label) or plain(df, label))
    docs, rows, qs, terms = lexical(spark)
    got = {}
    for r in rt.keyword_topk(terms, rows.repartition(5), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {k: v for k, v in brute(docs, qs, 5).items() if v}
    assert tables.count("best") > 2
    assert tables.count("postings") == 1 if passes == 1 else tables.count("postings") >= passes


def test_patterns_with_wildcards_are_looked_for_where_their_letters_are(monkeypatch):
    words = ["a_b", "x%y", "%", "_", "long name_", "b c", "bc", "\\%"]
    patterns = PatternSet(words)
    asked = []
    search = LikePattern.search
    monkeypatch.setattr(LikePattern, "search", lambda self, text: asked.append(self.anchor) or search(self, text))
    for text in ("acb bc", "b c bc bc", "xx y", "", "a long names 5%", "bc bc bc"):
        asked.clear()
        assert sorted(patterns.found(text)) == [i for i, w in enumerate(words) if search(LikePattern(w), text)]
        assert all(anchor in text for anchor in asked)


def test_bounds_leave_out_rows_without_a_rare_pattern():
    """Rows that hold only what all rows hold are scored while the heaps fill, then no more."""
    asked = patternsearch.Asked(np.array([7]), ["all", "rare"], np.array([0, 0]), np.array([0, 1]), np.array([False, False]))
    scorer = patternsearch.Scorer(asked, np.array([1000, 2]), np.array([18, 18]), np.array([55, 55]), 3)
    for start in range(0, 1000, 10):
        rows = [(r, 0) for r in range(10)] + ([(4, 1)] if start in (500, 600) else [])
        row, pattern = (np.array(x) for x in zip(*rows))
        ids = [f"r{start + i}" for i in range(10)]
        scorer.chunk(row, pattern, np.full(len(rows), 6), ids, [1000 - start - i for i in range(10)])
    assert scorer.scored == 10 + 2
    assert sorted((e[0], e[2]) for e in scorer.heaps.heaps[0]) == [(18, "r0"), (36, "r504"), (36, "r604")]


def test_bounds_of_rows_without_a_title_hit_are_their_own():
    """One row with the pattern in its title, which scores more, keeps no other row a candidate."""
    asked = patternsearch.Asked(np.array([7]), ["all", "rare"], np.array([0, 0]), np.array([0, 1]), np.array([False, False]))
    scorer = patternsearch.Scorer(asked, np.array([1000, 2]), np.array([[18, 18], [36, 0]]), np.array([[55, 55], [100, 0]]), 3)
    for start in range(0, 1000, 10):
        row, pattern = np.arange(10), np.zeros(10, np.int64)
        mask = np.where((start == 900) & (row == 3), 7, 6)
        scorer.chunk(row, pattern, mask, [f"r{start + i}" for i in range(10)], [1000 - start - i for i in range(10)])
    assert scorer.scored == 10 + 1
    assert sorted((e[0], e[2]) for e in scorer.heaps.heaps[0]) == [(18, "r0"), (18, "r1"), (36, "r903")]


def test_a_suffix_is_found_as_by_itself():
    rnd = random.Random(3)
    words = ["ab", "a b", "b\nab", "ba", "a%b", "_a", "b", "aab b"]
    patterns = PatternSet(words)
    for _ in range(300):
        suffix = "".join(rnd.choice("ab \n") for _ in range(rnd.randint(1, 12)))
        text = "".join(rnd.choice("ab \n") for _ in range(rnd.randint(0, 5))) + suffix
        whole, inside = patterns.found_with_suffix(text, suffix)
        assert sorted(whole) == sorted(patterns.found(text)) and sorted(inside) == sorted(patterns.found(suffix))


def test_like_patterns():
    assert LikePattern("a%c").search("xxabbbc") and not LikePattern("a%c").search("ca")
    assert LikePattern("a_c").search("abc") and not LikePattern("a_c").search("ac")
    assert LikePattern("100\\%").search("is 100%") and not LikePattern("100\\%").search("1000")


def test_empty_inputs(spark):
    docs, rows, qs, terms = lexical(spark)
    assert rt.keyword_topk(terms.limit(0), rows, 5).count() == 0
    assert rt.keyword_topk(terms, rows.limit(0), 5).count() == 0


def test_whole_run_and_its_trace(spark):
    """Three channels, a reranked and a plain query, one without a vector and one that finds nothing."""
    live = spark.createDataFrame(
        [(f"r{i}", f"t{i}", f"word{i} common", f"word{i} common", 10 - i, [1.0, float(i)]) for i in range(4)],
        "id string, source_title string, search_text string, content string, updated_at long, embedding array<float>",
    )
    asked = [(1, "common", [1.0, 0.0]), (2, "word3", None), (3, "nowhere", None)]
    queries = spark.createDataFrame(asked, "query_id long, query string, query_embedding array<float>")
    terms = spark.createDataFrame([(q, text, [text]) for q, text, _ in asked], "query_id long, query string, terms array<string>")
    facts = hits(spark, [(2, "r0", 1, 0.9), (2, "r0", 2, 0.8), (2, "r1", 2, 0.8)])
    backwards = lambda fused: fused.select("query_id", (-F.col("rank")).alias("position"), (F.col("rank") - 1).alias("index"))
    run = rt.hybrid_run(queries, terms, live, facts, 3, backwards)
    fused = {(r.query_id, r.rank): r.id for r in run["fused"].collect()}
    result = sorted((r.query_id, r.rank, r.id, r.fused_rank, r.rerank_used) for r in run["result"].collect())
    assert [fused[1, n] for n in (1, 2, 3, 4)] == ["r0", "r1", "r2", "r3"]  # the newest first by words, the nearest by vector
    assert result[:3] == [(1, 1, "r3", 4, True), (1, 2, "r2", 3, True), (1, 3, "r1", 2, True)]
    assert [x[1:] for x in result[3:]] == [(1, "r3", 1, False), (2, "r0", 2, False), (3, "r1", 3, False)]
    parents = spark.createDataFrame([(1, "p")], "query_id long, id string")
    trace = {r.query_id: r for r in rt.hybrid_trace(queries, run, parents).collect()}
    near = sum(1 / np.hypot(1, i) >= rt.MIN_SCORE for i in range(4))
    steps = ("vector", "keyword", "kg", "fused", "result", "parent")
    assert [trace[1][f"{s}_count"] for s in steps] == [near, 4, 0, 4, 3, 1] and trace[1].rerank_used
    assert [trace[2][f"{s}_count"] for s in steps] == [0, 1, 2, 3, 3, 0] and not trace[2].rerank_used
    assert [trace[3][f"{s}_count"] for s in steps] == [0] * 6 and not trace[3].rerank_used
    plain = rt.hybrid_run(queries, terms, live, facts, 3)["result"]
    assert {(r.query_id, r.rank): r.id for r in plain.collect()} == {key: v for key, v in fused.items() if key[1] <= 3}


def test_lsh_equals_the_join_of_buckets(spark):
    """The same hits as joining all pairs that share a bucket, without a row for each pair; zero and repeated rows too."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(90, 4))] + [[0.0] * 4]
    rows = [(f"r{i}", v) for i, v in enumerate(vectors)] + [("r3", vectors[3]), ("none", None)]
    asked = [(i, v) for i, v in enumerate(vectors[60:])]
    live = spark.createDataFrame(rows, "id string, embedding array<float>")
    queries = spark.createDataFrame(asked, "query_id long, query_embedding array<float>")
    found = rt.vector_topk_lsh(queries, live, 5)
    assert "CoGroups" in found._jdf.queryExecution().toString()
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in found.collect()}

    def unit(df, key, col):
        raw = df.where(F.col(col).isNotNull()).select(F.col(key).alias("key"), array_to_vector(F.col(col).cast("array<double>")).alias("raw"))
        return Normalizer(inputCol="raw", outputCol="unit", p=2.0).transform(raw).select("key", "unit")

    a, b = unit(queries, "query_id", "query_embedding"), unit(live, "id", "embedding")
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=0.8, numHashTables=8, seed=42).fit(b)
    pairs = model.approxSimilarityJoin(a, b, 2.0, distCol="d").select("datasetA.key", F.col("datasetB.key").alias("id"), "d").collect()
    want = {}
    for q, _ in asked:
        near = sorted((-round(1 - p["d"] ** 2 / 2, 9), p["id"]) for p in pairs if p["key"] == q)
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate([x for x in near if -x[0] >= 0.35][:5])}
    assert got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-9 for x in got)
