"""Column functions on small rows, CJK rules included."""

from pyspark.sql import Row, functions as F

from loreframe.functions import jobs, text as tx
from loreframe.operators import retrieval as rt


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(fn(F.col("v")).alias("r")).first()["r"]


def test_compact_and_truncate(spark):
    assert one(spark, " a \n　 b ", tx.compact) == "a b"
    assert one(spark, None, tx.compact) == ""
    assert one(spark, "abcdefghij", lambda c: tx.truncate(c, 8)) == "abcde..."
    assert one(spark, "abcd  fghij", lambda c: tx.truncate(c, 8)) == "abcd..."
    assert one(spark, "   \n", tx.blank) is True


def test_lists(spark):
    assert one(spark, '[" a ", "", "b,c"]', tx.clean_list) == ["a", "b,c"]
    assert one(spark, "a, b,,c ", tx.clean_list) == ["a", "b", "c"]
    assert one(spark, None, tx.clean_list) == []
    assert one(spark, "a，b;c；d\n e ", tx.split_list) == ["a", "b", "c", "d", "e"]
    assert one(spark, "12", tx.safe_int) == 12
    assert one(spark, "x", tx.safe_int) is None


def test_intents(spark):
    cases = {
        "请告诉我 API Key": ("sensitive_or_forbidden", "high", "refuse"),
        "我的报告现在生成到哪一步": ("realtime_status", "high", "answer_with_retrieval"),
        "登不上怎么办": ("troubleshooting", "high", "answer_with_retrieval"),
        "如何导出团体报告": ("procedure", "high", "answer_with_retrieval"),
        " 你好 ": ("chitchat_or_out_of_scope", "high", "smalltalk"),
        "团体报告包含什么": ("faq_exact", "medium", "answer_with_retrieval"),
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string")
    for r in df.select("q", tx.query_intent(F.col("q")).alias("a")).collect():
        assert (r.a.intent, r.a.confidence, r.a.safety_action) == cases[r.q]


def test_terms_keep_order(spark):
    q = spark.createDataFrame([(1, "登录报错 e-1024 用 TeamReport 和 teamreport"), (2, "   ")], "query_id long, query string")
    a = spark.createDataFrame(
        [
            Row(id="a1", canonical="测评报告", aliases=["TeamReport", "团报"], status="active", updated_at=2),
            Row(id="a2", canonical="登录", aliases=["登陆"], status="active", updated_at=1),
            Row(id="a3", canonical="报错", aliases=[], status="disabled", updated_at=3),
        ]
    )
    rows = {r.query_id: r.terms for r in rt.keyword_terms(q, a).collect()}
    # "teamreport" stays: only upper-cased forms already present are dropped, and "TeamReport" is not one
    assert rows[1] == ["E-1024", "TeamReport", "测评报告", "团报", "登录", "登陆", "报错", "teamreport"] or rows[1][:8] == [
        "E-1024", "TeamReport", "测评报告", "团报", "登录", "登陆", "报错", "e-1024"
    ]
    assert rows[2] == []


def test_error_code_boundaries(spark):
    assert one(spark, "错误E1024码 x AB-12- 7E99 q9", tx.error_codes) == ["AB-12"]
    assert one(spark, "E1024, ab_77x", tx.error_codes) == ["E1024", "AB_77X"]


def test_page_range_and_index(spark):
    df = spark.createDataFrame([(None, None), (3, None), (3, 3), (3, 5)], "a int, b int")
    assert [r.r for r in df.select(tx.page_range(F.col("a"), F.col("b")).alias("r")).collect()] == ["", "3", "3", "3-5"]
    grid = spark.range(0, 40).crossJoin(spark.range(1, 40).withColumnRenamed("id", "c"))
    seen = grid.select(tx.child_index(F.col("id"), F.col("c")).alias("i"))
    assert seen.distinct().count() == seen.count() == seen.filter("i < 0").count()


def test_embedding_transition(spark):
    rows = [("ready", "h", "h"), ("ready", "h", "x"), ("failed", "h", "h"), ("stale", "h", "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "s string, o string, n string")
    got = [r.r for r in df.select(tx.embedding_transition(F.col("s"), F.col("o"), F.col("n")).alias("r")).collect()]
    assert got == ["ready", "stale", "failed", "pending", "pending"]


def test_dedupe_text_folds_and_strips(spark):
    assert one(spark, "退款 通常，多久到账？", tx.dedupe_text) == "退款一般需要多久"
    a = spark.createDataFrame([("退款多久到账？", "通常3天。", "退款需要多久", "一般3天")], "q string, a string, q2 string, a2 string")
    r = a.select(tx.dedupe_signature(F.col("q"), F.col("a")) == tx.dedupe_signature(F.col("q2"), F.col("a2"))).first()[0]
    assert r is True


def test_sentences_and_offsets_beyond_the_basic_plane(spark):
    assert one(spark, "你好。A! b\nc", tx.sentences) == ["你好。", "A!", " b\n", "c"]
    df = spark.createDataFrame([("👌x报告", "报告")], "t string, e string")
    assert df.select(F.expr("locate(e, t) - 1")).first()[0] == 2


def test_file_types_and_progress(spark):
    df = spark.createDataFrame([("A.MD",), ("b.xls",), ("c",), ("d.docx",)], "n string")
    got = [(r.file_type, r.parser) for r in df.select(*jobs.file_type(F.col("n"))).collect()]
    assert got == [("markdown", "markdown_chat"), ("excel", "mineru"), ("unknown", "unsupported"), ("word", "mineru")]
    assert one(spark, '{"extracted_pages": 3, "total_pages": 4}', jobs.progress_percent) == 75
    assert one(spark, '{"extracted_pages": 9, "total_pages": 4}', jobs.progress_percent) == 100
    assert one(spark, "{}", jobs.progress_percent) == 0
