import random
from collections import Counter

import corpus_pipeline as cp
from loreframe.llm.packing import pack
from loreframe.llm.queries import ORACLES, QUERIES, word_encoder
from tests.llm.helpers import ODD, documents, empty, shingle_set, words
from tests.llm.test_documents import brute_classes
from tests.llm.test_pages import PERSONAL, brute_spans


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_stages_on_awkward_rows(spark, sf):
    docs = documents(spark, ODD + PERSONAL + ["the cat sat on the mat and slept"] * 3 + ["die Katze lag auf der Matte"] * 3)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if name != "packed":
            assert out.columns == cp.COLUMNS
            assert stage(spark, empty(spark), sf).collect() == []
        assert out.count() > 0


def test_stages_equal_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = cp.language_id(spark, docs, sf).collect()
    assert len(kept) == docs.count()  # all are texts of the four languages
    stage1 = spark.createDataFrame(kept, docs.schema)

    classes = brute_classes(kept, 5, 80)
    want = sorted(d for d, n, c in classes if n == 0 or d == c)
    stage2 = cp.near_duplicates(spark, stage1, sf).collect()
    assert sorted(r["doc_id"] for r in stage2) == want
    assert {(r["doc_id"], r["text"]) for r in stage2} <= {(r["doc_id"], r["text"]) for r in kept}

    docs2 = spark.createDataFrame(stage2, docs.schema)
    stage3 = cp.personal_data(spark, docs2, sf).collect()
    old = {r["doc_id"]: r for r in stage2}
    for r in stage3:
        assert brute_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])
        if "[" not in r["text"]:
            assert r["text"] == old[r["doc_id"]]["text"]

    docs3 = spark.createDataFrame(stage3, docs.schema)
    stage4 = cp.mixed(spark, docs3, sf).collect()
    times = Counter(r["doc_id"] for r in stage4)
    assert max(times.values()) <= 2 and set(times) <= set(old)
    share = sum(len(words(r["text"])) for r in stage4) / sum(len(words(r["text"])) for r in stage3)
    assert abs(share - 1.5) < 0.1

    docs4 = spark.createDataFrame(stage4, docs.schema)
    pieces = cp.packed(spark, docs4, sf).collect()
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
    plain = pack(docs4, word_encoder, 1).count()
    assert len(pieces) == plain


def test_language_stage_rejects_what_is_in_no_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*cp.COLUMNS)
    rng = random.Random(11)
    letters = ["abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", "αβγδεζηθικλμνξοπρστυφχψω", "語言是人類最重要的交際工具們利用它來互相流"]
    foreign = [
        "Η γλώσσα είναι ένα σύστημα σημείων που χρησιμοποιούν οι άνθρωποι για να επικοινωνούν μεταξύ τους " * 8,
        "Язык это сложная знаковая система которая соотносит понятийное содержание и типовое звучание " * 8,
        *[" ".join("".join(rng.choice(kind) for _ in range(rng.randint(2, 9))) for _ in range(150)) for kind in letters],
    ]
    junk = [(10**6 + i, t, [None, "en"][i % 2], "s1", len(t)) for i, t in enumerate(foreign)]
    mixed = docs.where("length(text) > 500").orderBy("doc_id").limit(40).collect()
    both = [(2 * 10**6 + i, a["text"] + " " + b["text"], None, "s1", 1) for i, (a, b) in enumerate(zip(mixed, mixed[1:]))]
    rows = spark.createDataFrame(junk + both, docs.schema).union(docs)
    kept = {r["doc_id"] for r in cp.language_id(spark, rows, sf).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} | {r[0] for r in both}


def test_rows_that_share_a_doc_id_are_compared_by_their_texts(spark, sf):
    rng = random.Random(12)
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(60)]
    rows = [(7, t, "en", "s1", 1) for t in own[:20]]  # different texts under one id
    rows += [(-5, own[20], "en", "s1", 1), (3, own[20], "en", "s1", 1), (None, own[20], "en", "s1", 1)]
    rows += [(None, own[21], None, "s1", 1)] * 5 + [(None, own[22], "en", None, 1), (None, own[22], None, "en", 1)]
    rows += [(9, own[23], "en", "s1", 1)] * 4 + [(9, own[24], "en", "s1", 1), (10, own[24] + " more", "en", "s1", 1)]
    rows += [(11, "", "en", "s1", 0)] * 2 + [(None, None, "en", "s1", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = Counter((r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, docs, sf).collect())
    want = Counter([(7, t) for t in own[:20]] + [(-5, own[20]), (None, own[21]), (None, own[22]), (9, own[23]), (9, own[24])])
    assert got == want + Counter({(11, ""): 2, (None, None): 2})


def test_run(spark, sf):
    assert cp.run(spark, sf).count() > 0
    assert shingle_set("a b", 5) == frozenset([(b"a", b"b")])
