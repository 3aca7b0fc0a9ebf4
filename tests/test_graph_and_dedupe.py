"""Graph steps, duplicates, evaluation, model steps, scale helpers."""

import json
import random
from difflib import SequenceMatcher
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import Row, Window as W, functions as F, types as T

from loreframe import scale
from loreframe.operators import dedupe as dd, evaluation as ev, extraction as ex, gates, graph as kg, lifecycle as lc, models as md, retrieval as rt
from loreframe.plans import graphs
from loreframe.sources.faq_jsonl import read_faq_jsonl
from loreframe.sources.tables import Tables


def test_scale_helpers_equal_plain_windows(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("aab"), i, rnd.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, v int").repartition(6)
    bucket = F.floor(F.col("i") / 16)
    pos = {r.i: r.p for r in scale.dense_position(df, ["g"], bucket, [F.col("i")], "p").collect()}
    run = {r.i: r.s for r in scale.running_sum(df, ["g"], bucket, [F.col("i")], F.col("v"), "s").collect()}
    lag = {r.i: r.l for r in scale.previous_value(df, ["g"], bucket, [F.col("i")], F.col("v"), "l").collect()}
    for g in "ab":
        total, before = 0, None
        for n, (_, i, v) in enumerate([r for r in rows if r[0] == g], 1):
            total += v
            assert (pos[i], run[i], lag[i]) == (n, total, before)
            before = v


@pytest.mark.parametrize("hot", [1 << 20, 20])
def test_rows_of_all_but_hot_groups_move_once(spark, monkeypatch, hot):
    """Positions and excerpts are the same whether a group is hot or not; null and rare groups too."""
    monkeypatch.setattr(scale, "HOT_ROWS", hot)
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), f"e{i:03d}", f"x{rnd.randint(0, 9)}", rnd.randint(0, 30)) for i in range(200)] + [("c", "only", "x", 1)]
    df = spark.createDataFrame(rows, "g string, id string, excerpt string, created_at int").repartition(5)
    placed = scale.position_in_group(df, ["g"], F.floor(F.col("created_at") / 4), [F.col("created_at"), F.col("id")], "p")
    exchanges = placed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges == 1 if hot > 100 else exchanges > 1
    want = {}
    for g in ("a", "b", "c", None):
        for n, r in enumerate(sorted((r[3], r[1]) for r in rows if r[0] == g), 1):
            want[r[1]] = n
    assert {r.id: r.p for r in placed.collect()} == want
    live = df.filter("g is not null").select(F.col("g").alias("entity_id"), F.lit(None).cast("string").alias("relation_id"), "id", "excerpt", "created_at")
    texts = {r.id: r.evidence_text for r in kg.evidence_excerpts(live).collect()}
    for g in ("a", "b", "c"):
        first = {}
        for _, _, excerpt in sorted((r[3], r[1], r[2]) for r in rows if r[0] == g):
            first.setdefault(excerpt)
        assert texts[g] == "\n".join(first)


def test_often_cited_evidence_is_filtered_where_it_is_read(spark):
    """The same rows as the live evidence, without moving them to the chunks; null and repeated keys too."""
    evidence = spark.createDataFrame(
        [("1", "document", "f", "c"), ("1", "document", "f", "c"), ("2", "document", "f", "off"), ("3", "document", "g", "c"), ("4", "document", "f", None),
         ("5", "faq", "q", None), ("6", "faq", "none", None), ("7", "document", "off", "d"), ("8", "other", "f", "c"), ("9", "document", None, "c")],
        "id string, source_type string, source_id string, source_chunk_id string",
    )
    files = spark.createDataFrame([("f", False), ("f", False), ("off", True), ("g", False)], "id string, is_disabled boolean")
    chunks = spark.createDataFrame([("c", "f", False), ("c", "f", False), ("off", "f", True), ("d", "off", False)], "id string, file_id string, is_disabled boolean")
    faqs = spark.createDataFrame([("q", "usable"), ("none", "disabled")], "id string, status string")
    cited = gates.often_cited_evidence(evidence, files, chunks, faqs)
    assert sorted(r.id for r in cited.collect()) == sorted(r.id for r in gates.live_evidence(evidence, files, chunks, faqs).collect()) == ["1", "1", "5"]
    assert "Exchange hashpartitioning" not in cited._jdf.queryExecution().executedPlan().toString()


def test_latest_and_upsert(spark):
    base = spark.createDataFrame([("a", 1, 1, 0), ("b", 1, 1, 0)], "id string, v int, updated_at int, created_at int")
    new = spark.createDataFrame([("a", 2, 2, 9), ("a", 3, 3, 9), ("c", 4, 1, 9)], base.schema)
    got = {r.id: (r.v, r.created_at) for r in lc.upsert(base, new, ["id"], [F.col("updated_at")]).collect()}
    assert got == {"a": (3, 0), "b": (1, 0), "c": (4, 9)}
    assert lc.insert_if_absent(base, new, ["id"]).count() == 3


def graph(spark):
    e = spark.createDataFrame([Row(id=i, entity_type="t", status="disabled" if i == "x" else "usable") for i in "abcdxz"])
    r = spark.createDataFrame(
        [Row(id=f"r{h}{t}", head_entity_id=h, tail_entity_id=t, relation_type="requires", status="usable", updated_at=n) for n, (h, t) in enumerate(["ab", "bc", "cd", "ax"])]
    )
    ev_rows = spark.createDataFrame([("e1", "rab"), ("e2", "rab")], "id string, relation_id string").withColumn("entity_id", F.lit(None).cast("string"))
    return e, r, ev_rows


def test_neighbourhood(spark):
    e, r, live = graph(spark)
    centers = spark.createDataFrame([("a",), ("z",), ("x",), ("nope",)], "id string")
    rows = kg.subgraph(centers, e, r, live, hops=2, limit=10).collect()
    got = {(x.center_id, x.relation_id, x.evidence_count) for x in rows}
    assert got == {("a", "rab", 2), ("a", "rbc", 0), ("z", None, None)}
    one = kg.subgraph(centers, e, r, live, hops=2, limit=1).filter("center_id = 'a'").collect()
    assert [x.relation_id for x in one] == ["rbc"]


def test_neighbourhood_bound_loses_no_edge(spark):
    """A dense random graph with a hub and many equal times, against a plain search; few edges are candidates."""
    rnd, limit = random.Random(7), 20
    names = [f"n{i:03d}" for i in range(60)]
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(2500)] + [("n000", x) for x in names[1:]]
    rows = [(f"r{i:05d}", h, t, rnd.choice([None, *range(300)])) for i, (h, t) in enumerate(pairs) if h != t]
    lone = [("z1", "z2", 5), ("z2", "z3", 5)]
    rows += [(f"s{i}", h, t, at) for i, (h, t, at) in enumerate(lone)]
    names += ["z1", "z2", "z3", "z4"]
    e = spark.createDataFrame([(n, "t", "usable") for n in names], "id string, entity_type string, status string")
    r = spark.createDataFrame(rows, "id string, head_entity_id string, tail_entity_id string, updated_at int")
    r = r.withColumns({"relation_type": F.lit("requires"), "status": F.lit("usable")})
    live = spark.createDataFrame([], "id string, relation_id string, entity_id string")
    got = {}
    for x in kg.subgraph(e.select("id"), e, r, live, hops=2, limit=limit).collect():
        got.setdefault(x.center_id, set()).add(x.relation_id)
    ends = {}
    for i, h, t, at in rows:
        for a, b in ((h, t), (t, h)):
            ends.setdefault(a, []).append((b, (at is None, -(at or 0), i)))
    for c in names:
        near = {c} | {b for b, _ in ends.get(c, [])}
        best = sorted({key for a in near for _, key in ends.get(a, [])})[:limit]
        assert got[c] == ({key[2] for key in best} or {None})
    sides = spark.createDataFrame([(a, key[2], None if key[0] else -key[1]) for a in ends for _, key in ends[a]], "entity_id string, id string, updated_at int")
    own = sides.withColumn("rn", F.row_number().over(W.partitionBy("entity_id").orderBy(*kg.newest_first()))).filter(F.col("rn") <= limit)
    own = own.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("rn", "updated_at", "id"))).alias("own"))
    reached = spark.createDataFrame([(c, a) for c in names for a in {c} | {b for b, _ in ends.get(c, [])}], "center_id string, entity_id string")
    every = reached.join(own, "entity_id").agg(F.sum(F.size("own"))).first()[0]
    assert kg.near_edges(reached, own, limit).count() < 0.15 * every


def test_resolution_rules(spark):
    p = spark.createDataFrame([("j", "e1", "t"), ("j", "e2", "t"), ("j", "e3", "u"), ("j", "e4", "t")], "job_id string, entity_id string, entity_type string")
    g = spark.createDataFrame(
        [("j", "ok", "e1"), ("j", "ok", "e4"), ("j", "mix", "e2"), ("j", "mix", "e3"), ("j", "one", "e9")], "job_id string, group_id string, member_id string"
    )
    got = {r.group_id: r.reason for r in kg.check_resolution(g, p).collect()}
    assert got == {"ok": None, "mix": "mixed_types", "one": "unknown_id"}


def answer(**change):
    entity = {"name": "Login", "entity_type": "feature_ui_action", "aliases": [], "description": "d", "confidence": 0.5, "evidence": [{"excerpt": "Login"}]}
    relation = {
        "head": "Login", "head_type": "feature_ui_action", "relation_type": "requires", "tail": "Account",
        "tail_type": "process_task_object", "description": "", "confidence": 1, "evidence": [{"excerpt": "Login"}],
    }
    body = {"entities": [{**entity, **change.get("entity", {})}], "relations": [{**relation, **change.get("relation", {})}], **change.get("top", {})}
    for key in change.get("drop", []):
        del body["entities"][0][key]
    return "```json\n" + json.dumps(body, ensure_ascii=False) + "\n```"


def test_strict_extraction(spark):
    cases = {
        0: (answer(), None), 1: (answer(top={"x": 1}), "fields"), 2: (answer(drop=["aliases"]), "entity_fields"),
        3: (answer(entity={"entity_type": "planet"}), "entity_value"), 4: (answer(entity={"confidence": 2}), "confidence"),
        5: (answer(entity={"evidence": [{"excerpt": "nowhere"}]}), "evidence"), 6: ("no json", "fields"),
        7: (answer(relation={"relation_type": "likes"}), "relation_value"), 8: (answer(entity={"evidence": []}), "evidence"),
    }
    df = spark.createDataFrame([("j", i, a, "The 👌 Login page") for i, (a, _) in cases.items()], "job_id string, chunk_order long, answer string, source_text string")
    rows = ex.parse_extractions(df).collect()
    assert {r.chunk_order: r.reject for r in rows} == {i: reason for i, (_, reason) in cases.items()}
    good = {(r.kind, r.name, r.char_start, r.char_end) for r in rows if r.chunk_order == 0}
    assert good == {("entity", "Login", 6, 11), ("endpoint", "Account", 6, 11)}


def test_extraction_reads_and_parses_an_answer_once(spark):
    one = json.loads(answer()[8:-4])
    relation = one["relations"][0]
    other = {**relation, "relation_type": "causes"}
    text = "```json\n" + json.dumps({**one, "relations": [relation, other]}) + "\n```"
    df = spark.createDataFrame([("j", 0, text, "Login page"), ("j", 0, text, "Login page"), ("j", 1, "{}", None)], "job_id string, chunk_order long, answer string, source_text string")
    out = ex.parse_extractions(df)
    got = sorted((r.chunk_order, r.reject or "", r.kind or "", r.char_start if r.char_start is not None else -1) for r in out.collect())
    each = [(0, "", "endpoint", 0), (0, "", "entity", 0)]
    assert got == sorted(each * 2 + [(1, "fields", "", -1)])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("LogicalRDD") == 1 and plan.count("from_json") == 4


def texts(n=60, seed=4):
    rnd = random.Random(seed)
    letters = "abcdefghijklmnop"
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(30, 80))) for _ in range(n // 3)]
    out = list(base)
    for b in base:
        for edits in (2, 9):
            chars = list(b)
            for _ in range(edits):
                chars[rnd.randrange(len(chars))] = rnd.choice(letters)
            out.append("".join(chars))
    return out


def test_ratio_bounds_are_safe():
    t = texts()
    for a in t[:25]:
        for b in t:
            want = SequenceMatcher(None, a, b).ratio()
            assert dd.text_ratio(a, b) == (want if want >= dd.NEAR else 0.0)


def test_near_duplicates_equal_brute_force(spark):
    t = texts()
    c = spark.createDataFrame([(f"c{i:02d}", f"k{i}", x, "a") for i, x in enumerate(t[:30])], "id string, chunk_id string, question string, answer string")
    r = spark.createDataFrame([(f"r{i:02d}", None, x, "a") for i, x in enumerate(t[20:])], "id string, chunk_id string, question string, answer string")
    want = {}
    for i, a in enumerate(t[:30]):
        best = (0.0, None)
        for j, b in enumerate(t[20:]):
            s = SequenceMatcher(None, a + "|a", b + "|a").ratio()
            if s >= 0.75 and s > best[0]:
                best = (s, f"r{j:02d}")
        want[f"c{i:02d}"] = (round(best[0], 4), best[1])
    exact = {x.id: (x.score, x.target_id) for x in dd.near_matches(c, r, exact_pairs=True).collect()}
    assert exact == want
    indexed = {x.id: (x.score, x.target_id) for x in dd.near_matches(c, r).collect()}
    assert indexed == want


def long_texts(n=36, seed=5):
    """Texts of few frequent letters, 200 to 700 long, with rare ones in between; two edited forms of every third."""
    rnd = random.Random(seed)
    out = []
    for i in range(n // 3):
        chars = [rnd.choice("abcdef") for _ in range(rnd.randint(230, 700))]
        for at in range(0, len(chars), rnd.choice((40, 90, 200))):
            chars[at] = rnd.choice("uvwxyz")
        out.append("".join(chars))
        cut = rnd.randint(20, 120)
        out.append("".join(chars[:cut] + [rnd.choice("abcdef") for _ in range(rnd.choice((5, 60, 150)))] + chars[cut:]))
        for _ in range(rnd.choice((3, 8, 20))):
            chars[rnd.randrange(len(chars))] = rnd.choice("abcdef")
        out.append("".join(chars))
    return out


def test_near_duplicates_of_long_texts_equal_brute_force(spark):
    t = long_texts()
    cols = "id string, body string"
    left = spark.createDataFrame([(f"c{i:02d}", x) for i, x in enumerate(t)], cols)
    right = spark.createDataFrame([(f"r{i:02d}", x) for i, x in enumerate(t)], cols)
    want = {(f"c{i:02d}", f"r{j:02d}") for i, a in enumerate(t) for j, b in enumerate(t) if SequenceMatcher(None, a, b).ratio() >= dd.NEAR}
    assert len(want) > len(t) + 10
    assert sum(dd._run_length(x)[0] > 0 for x in t) >= 24
    got = {(x.l, x.r) for x in dd._near_pairs(left, right).collect()}
    assert want <= got


def test_unrelated_long_texts_are_no_candidates(spark):
    rnd = random.Random(6)
    syllables = ["th", "an", "er", "on", "he", "in", "re", "ha", "nd", "es", "at", "st", "ou", "ti", "ly", "ble", "you"]
    t = ["".join(rnd.choice(syllables) if rnd.random() > 0.02 else rnd.choice("kqxzjv") for _ in range(400)) for _ in range(40)]
    cols = "id string, body string"
    left = spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(t)], cols)
    right = spark.createDataFrame([(f"r{i}", x) for i, x in enumerate(t)], cols)
    pairs = {(x.l, x.r) for x in dd._near_pairs(left, right).collect()}
    assert {(f"c{i}", f"r{i}") for i in range(40)} <= pairs and len(pairs) < 160  # 1600 by the letters alone


def test_short_texts_match(spark):
    cols = "id string, chunk_id string, question string, answer string"
    c = spark.createDataFrame([("c", "k", "a", "")], cols)
    r = spark.createDataFrame([("r", None, "a", "b")], cols)
    assert [(x.level, x.score, x.target_id) for x in dd.near_matches(c, r).collect()] == [("low", 0.8, "r")]


def test_exact_match_ignores_the_own_chunk(spark):
    cols = "id string, chunk_id string, question string, answer string"
    c = spark.createDataFrame([("c1", "k1", "Q?", "A"), ("c2", "k2", "q", "a!"), ("c3", "k3", "z", "z")], cols)
    r = spark.createDataFrame([("r1", "k1", "q", "a"), ("r2", "k2", "Q", "A")], cols)
    assert {x.id: x.target_id for x in dd.exact_matches(c, r).collect()} == {"c1": "r2", "c2": "r1"}


def test_components_and_shingles(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8)], "id long, anchor long")
    roots = {r.id: r.root for r in dd.components(spark.range(1, 11), links).collect()}
    assert roots == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 10}
    body = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, body), (2, body + " extra"), (3, "other words here " * 9)], "id long, body string")
    assert [(r.id, r.anchor) for r in dd.shingle_pairs(docs).collect()] == [(2, 1)]
    # one band for all: the smallest id is alike to none of the others
    docs = spark.createDataFrame([(0, "w1 w2 w3"), (1, body), (2, body + " extra")], "id long, body string")
    assert (2, 1) in {(r.id, r.anchor) for r in dd.shingle_pairs(docs).collect()}


def chains(seed, chain=14, groups=3):
    """Texts that change a little from one to the next, so that the ends of a chain are unlike."""
    rnd = random.Random(seed)
    out = []
    for _ in range(groups):
        words = [f"w{rnd.randrange(1000)}" for _ in range(60)]
        for _ in range(chain):
            out.append(" ".join(words))
            for _ in range(2):
                words[rnd.randrange(60)] = f"w{rnd.randrange(1000)}"
    rnd.shuffle(out)
    return out


def brute_classes(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {tuple(w)})
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= threshold * len(a | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return dict(enumerate(root))


def test_near_classes_of_one_bucket_equal_all_pairs(spark, monkeypatch):
    """All texts in one bucket: what the classes lose against all pairs, they lose inside a bucket."""
    one = F.pandas_udf(lambda s: pd.Series([[7]] * len(s)), T.ArrayType(T.LongType()))
    monkeypatch.setattr(dd, "band_keys", lambda bands, rows: one)
    t = chains(1, chain=6, groups=2)
    docs = spark.createDataFrame(list(enumerate(t)), "id long, body string")
    _, classes = dd.near_classes(docs)
    want = brute_classes(t)
    assert {r.id: r.root for r in classes.collect()} == want
    assert len(set(want.values())) < len(t) / 2


def test_near_classes_of_a_bucket_of_unlike_texts_take_few_rounds(spark, monkeypatch):
    """The anchors of a round grow as long as its pairs stay bounded; 16 each time took eight rounds here."""
    one = F.pandas_udf(lambda s: pd.Series([[7]] * len(s)), T.ArrayType(T.LongType()))
    monkeypatch.setattr(dd, "band_keys", lambda bands, rows: one)
    cuts, cut = [], dd.cut_lineage
    monkeypatch.setattr(dd, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    docs = [(i, f"a{i} b{i} c{i} d{i}") for i in range(120)] + [(200, "a119 b119 c119 d119"), (201, None), (202, " ")]
    _, classes = dd.near_classes(spark.createDataFrame(docs, "id long, body string"))
    assert {r.id: r.root for r in classes.collect()} == {i: i for i in [*range(120), 201, 202]} | {200: 119}
    assert len(cuts) <= 20


def test_anchors_of_a_round_stay_bounded(spark, monkeypatch):
    """With room for no more pairs a round takes the fewest anchors, and the classes are the same."""
    one = F.pandas_udf(lambda s: pd.Series([[7]] * len(s)), T.ArrayType(T.LongType()))
    monkeypatch.setattr(dd, "band_keys", lambda bands, rows: one)
    monkeypatch.setattr(dd, "ANCHORS", (4, 16))
    monkeypatch.setattr(dd, "PAIRS", 0)
    t = chains(2, chain=5, groups=2)
    _, classes = dd.near_classes(spark.createDataFrame(list(enumerate(t)), "id long, body string"))
    assert {r.id: r.root for r in classes.collect()} == brute_classes(t)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def extraction_tables(spark, folder):
    """Documents of two sources with none, one and several capitalised words."""
    texts = ["Ann met Bob. Ann met Cid", None, "", "none here", "Only one", "Bob Ann Eve", "Ann Bob"]
    rows = [(i, x, "en", f"src{i % 2}", len(x or "")) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet"
    )
    return Tables(spark, str(folder))


def test_words_of_a_text_are_looked_for_once(spark, tmp_path):
    t = extraction_tables(spark, tmp_path)
    assert plan_of(t.map_entities).count("regexp_extract_all") == 1
    assert plan_of(t.map_relations).count("regexp_extract_all") == 1
    names = {(r.chunk_order, r.pos, r["name"]) for r in t.map_entities.collect()}
    assert names == {(0, 0, "Ann"), (0, 1, "Bob"), (0, 2, "Cid"), (4, 0, "Only"), (5, 0, "Bob"), (5, 1, "Ann"), (5, 2, "Eve"),
                     (6, 0, "Ann"), (6, 1, "Bob")}
    pairs = {(r.chunk_order, r.head_name, r.tail_name) for r in t.map_relations.collect()}
    assert pairs == {(0, "Ann", "Bob"), (0, "Bob", "Cid"), (5, "Bob", "Ann"), (5, "Ann", "Eve"), (6, "Ann", "Bob")}


def test_merges_read_the_texts_once(spark, tmp_path):
    """Entities are written once; the rest of the plan reads the texts for the relations alone."""
    t = extraction_tables(spark, tmp_path)
    assert plan_of(graphs.kg_reduce_entities(t)).count("regexp_extract_all") == 0
    merged = graphs.kg_reduce_relations(t)
    assert plan_of(merged).count("regexp_extract_all") == 1
    assert {(r.job_id, r.support) for r in merged.collect()} <= {("kgjob_src0", 1), ("kgjob_src0", 2), ("kgjob_src1", 1)}


def test_fact_hits_are_found_once(spark, monkeypatch):
    """The hits are read for entities, relations and the diagnostics, but searched for once."""
    hits = spark.createDataFrame(
        [(1, "kc_kg_entity_a", "kg_entity", "a", 1, 2.0)],
        "query_id long, id string, source_type string, source_id string, rank long, score double",
    ).mapInArrow(lambda batches: batches, "query_id long, id string, source_type string, source_id string, rank long, score double")
    monkeypatch.setattr(graphs, "fact_hits", lambda t: hits)
    names = "kg_entities kg_relations kg_evidence knowledge_chunks import_files import_chunks faq_documents".split()
    t = SimpleNamespace(**dict.fromkeys(names))
    given = []

    def expand(hits, *tables):
        given.append(hits)
        return hits.select("query_id", F.col("id").alias("fact_chunk_id"), F.lit("x").alias("id"))

    monkeypatch.setattr(graphs.kg, "expand_facts", expand)
    graphs.expanded(t)
    assert "MapInArrow" not in plan_of(given[0])
    found = graphs.kg_fact_diagnostics(t)
    assert "MapInArrow" not in plan_of(found)
    assert [(r.fact_chunk_id, r.expanded_id) for r in found.collect()] == [("kc_kg_entity_a", "x")]


def test_fusion_keeps_every_fact_that_leads_to_a_row(spark):
    """One vote per row at its best fact rank, and the facts themselves by (rank, fact row), each once."""
    fact = "query_id long, id string, source_type string, source_id string, rank long, score double"
    found = [(1, "kc_kg_relation_r", "kg_relation", "r", 1, 0.9), (1, "kc_kg_entity_a", "kg_entity", "a", 2, 0.5), (1, "kc_kg_entity_a", "kg_entity", "a", 4, 0.5)]
    hits = spark.createDataFrame(found, fact)
    entities = spark.createDataFrame([("a", "usable"), ("b", "usable")], "id string, status string")
    relations = spark.createDataFrame([("r", "a", "b", "usable")], "id string, head_entity_id string, tail_entity_id string, status string")
    evidence = spark.createDataFrame(
        [("a", None, "faq", "q", None), (None, "r", "faq", "q", None)],
        "entity_id string, relation_id string, source_type string, source_id string, source_chunk_id string",
    )
    originals = spark.createDataFrame(
        [("kc_q", None), ("part_of_q", "c")], "id string, source_chunk_id string"
    ).selectExpr("*", "'faq' source_type", "'q' source_id", "'chunk' chunk_level", "'usable' status", "'ready' embedding_status")
    files = spark.createDataFrame([], "id string, is_disabled boolean")
    chunks = spark.createDataFrame([], "id string, file_id string, is_disabled boolean")
    faqs = spark.createDataFrame([("q", "usable", "ready")], "id string, status string, embedding_status string")
    expanded = kg.expand_facts(hits, entities, relations, evidence, originals, files, chunks, faqs)
    keyword = rt.channel(spark.createDataFrame([(1, "kc_q", 1, 1.0), (1, "kc_x", 2, 0.4)], "query_id long, id string, rank long, score double"), "keyword", 1)
    rows = rt.fuse([keyword, rt.fact_channel(expanded, 2)], 5, keep_matches=True).orderBy("rank").collect()
    assert [(r.id, r.channels, r.kg_score) for r in rows] == [("kc_q", "keyword,kg", 0.9), ("kc_x", "keyword", None)]
    assert [tuple(m) for m in rows[0].kg_matches] == [
        (1, "kc_kg_relation_r", "r", "kg_relation", 0.9), (2, "kc_kg_entity_a", "a", "kg_entity", 0.5)
    ]
    assert rows[1].kg_matches == []
    assert abs(rows[0].fused_score - round(2 / 61, 9)) < 1e-12


def test_metrics_keep_unlabelled_cases(spark):
    rows = [("s", ["x"], ["a", "x"]), ("s", ["m"], ["a", "b"])]
    df = spark.createDataFrame(rows, "s string, expected_ids array<string>, retrieved_ids array<string>")
    r = ev.metrics(df, ["s"], 3).first()
    assert (r.case_count, r.recall_at_k, r.mrr, r.hit_rate_at_1) == (2, 0.5, 0.25, 0.0)


def test_embedding_failures_stay_per_row(spark):
    def embed(values):
        if any("bad" in v for v in values):
            raise ValueError("bad text")
        return md.hashed_ngrams(values)

    rows = spark.createDataFrame([("1", "good one"), ("2", "bad one"), ("3", "")], "id string, t string")
    got = {r.id: (r.embedding_dimensions, r.embedding_error) for r in md.embed_rows(rows, "t", embed).collect()}
    assert got == {"1": (64, None), "2": (0, "bad text"), "3": (64, None)}


def test_jsonl_rejects(spark, tmp_path):
    good = json.dumps({k: "x" for k in ("id", "question", "answer", "confidence", "status", "embedding_text")})
    (tmp_path / "a.jsonl").write_text("\n".join([good, "", "{broken", "[1]", '{"id": "1"}']))
    rows, rejects = read_faq_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert rows.count() == 1
    reasons = sorted(r.reason.split(":")[0] for r in rejects.collect())
    assert reasons == ["expected JSON object", "invalid JSON", "missing required fields"]


def test_question_answers(spark):
    df = spark.createDataFrame([('x ```json\n{"questions": ["a", " a ", "", "b"]}\n```',), ("nope",), ('{"questions": "x"}',)], "a string")
    assert [r.q for r in df.select(md.parse_questions(F.col("a")).alias("q")).collect()] == [["a", "b"], [], []]
