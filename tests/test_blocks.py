"""Readers, chunkers, chat chunks and media context."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loreframe.functions.constants import UNSECTIONED
from loreframe.operators import chat, chunking as ch, knowledge as kn, media
from loreframe.sources import blocks as bl

BLOCK = "file_id string, pos long, text string, block_type string, page_number int, section_title string"


def blocks(spark, rows):
    return spark.createDataFrame(rows, BLOCK)


def test_naive_merge_overshoots_and_marks_mixed(spark):
    b = blocks(spark, [("f", 0, "alpha", "text", 1, "A > B"), ("f", 1, "beta", "table", 2, None), ("f", 2, "gamma", "text", 3, "C")])
    rows = ch.naive_chunks(b, chunk_tokens=9).orderBy("chunk_no").collect()
    assert [(r.text, r.block_type, r.page_start, r.page_end) for r in rows] == [
        ("alpha\nbeta", "mixed", 1, 2), ("gamma", "text", 3, 3)
    ]
    assert [r.section for r in rows] == ["A > B", "C"]


def test_naive_overlap_takes_the_tail(spark):
    b = blocks(spark, [("f", i, c * 10, "text", 1, None) for i, c in enumerate("abc")])
    rows = ch.naive_chunks(b, chunk_tokens=10, overlap_percent=50).orderBy("chunk_no").collect()
    assert rows[0].text == "a" * 10 and rows[1].text == "aaaaa\n" + "b" * 10


def test_delimiters(spark):
    b = blocks(spark, [("f", 0, "one###two### ###three", "text", 1, None)])
    assert [r.text for r in ch.delimiter_chunks(b, ["###"]).orderBy("piece_no").collect()] == ["one", "two", "three"]
    assert kn.delimiter_pattern("\\n") == "\\\n"
    assert kn.delimiter_pattern("`ab``abc`;") .split("|")[-2:] == ["abc", "ab"]
    df = spark.createDataFrame([("a\nb\n\n c",), (" \n",)], "t string")
    got = [r.r for r in df.select(kn.split_keep(F.col("t"), kn.delimiter_pattern("\\n")).alias("r")).collect()]
    assert got == [["a\n", "b\n", " c"], []]


def test_manual_runs(spark):
    b = blocks(spark, [("f", 0, "x", "text", 1, None), ("f", 1, "T", "title", 1, None), ("f", 2, "y", "text", 2, "S"), ("f", 3, "z", "text", 3, "S"), ("f", 4, "w", "text", 4, None)])
    rows = ch.manual_groups(b).orderBy("pos").collect()
    assert [(r.key, r.chunk_no) for r in rows] == [(UNSECTIONED, 0), ("T", 1), ("S", 2), ("S", 2), (UNSECTIONED, 3)]


def test_qa_rows(spark):
    b = blocks(spark, [("f", 0, "lead in", "text", 1, None), ("f", 1, "Q1\tA1", "text", 1, None), ("f", 2, "more", "text", 2, None), ("f", 3, '"Q, 2",A2', "text", 3, None)])
    rows = ch.qa_chunks(b).orderBy("chunk_no").collect()
    assert [(r.question, r.answer, r.page_end) for r in rows] == [("Q1", "A1\nmore", 2), ("Q, 2", "A2", 3)]


def test_table_rows(spark):
    b = blocks(spark, [("f", 0, "| a | b |\n| 1 | |\n| x |\n| 2 | 3 |", "table", 1, None), ("f", 1, "h,h\n1,2", "table", 1, None), ("f", 2, 'p,q\n"1,5",2', "table", 1, None)])
    assert [r.text for r in ch.table_chunks(b).orderBy("pos", "row_index").collect()] == ["- a: 2\n- b: 3", "- p: 1,5\n- q: 2"] or [
        r.text for r in ch.table_chunks(b).orderBy("pos", "row_index").collect()
    ] == ["- a: 1", "- a: 2\n- b: 3", "- p: 1,5\n- q: 2"]


def test_pipeline_reports_unknown_chunkers(spark):
    b = blocks(spark, [("a", 0, "x", "text", 1, None), ("b", 0, "y", "text", 1, None)])
    c = spark.createDataFrame([("a", None), ("b", "magic")], "file_id string, chunker_type string")
    got = {(r.file_id, r.chunker, r.text) for r in ch.chunk_pipeline(b, c).collect()}
    assert got == {("a", "naive", "x"), ("b", "unsupported", "")}


def test_markdown(spark):
    d = spark.createDataFrame([("f", "intro\n# One \r\ntext\n\n##\nmore\n# Two")], "file_id string, markdown string")
    rows = bl.markdown_blocks(d).orderBy("pos").collect()
    assert [(r.text, r.section_title) for r in rows] == [("intro", None), ("# One\ntext", "One"), ("##\nmore", "One"), ("# Two", "Two")]


def test_chat_markdown(spark):
    text = "# t\nskip\n- [2024-01-01 10:00] Ann: hi: there\n  next line\n\n- [2024-01-01 10:05] [系统]: joined\n"
    d = spark.createDataFrame([("f", text)], "file_id string, markdown string")
    rows = bl.chat_messages(d).orderBy("message_no").collect()
    assert [(r.speaker, r.content) for r in rows] == [("Ann", "hi: there\nnext line"), ("[系统]", "joined")]
    assert rows[0].sent_at == datetime(2024, 1, 1, 10, 0)


def test_html(spark):
    df = spark.createDataFrame([("a &lt; b<br/>c</p>x &amp; <b>y</b> < 3", "<TABLE><tr><td> 1 </td><td><i>2</i></td></tr><tr><td></td></tr></TABLE>")], "h string, t string")
    r = df.select(bl.clean_inline(F.col("h")).alias("h"), bl.table_text(F.col("t")).alias("t")).first()
    assert r.h == "a < b\nc\nx & y < 3" and r.t == "1 | 2"


def layout(spark, payload):
    return spark.createDataFrame([("f", json.dumps(payload))], "file_id string, payload string")


def test_layout_shapes_sections_and_assets(spark):
    items = [
        {"type": "title", "text": "Intro", "page_idx": 0, "bbox": [5, 9, 1, 2]},
        {"type": "header", "text": "drop me"},
        {"type": "image", "img_path": " a.png ", "page_idx": 1},
        {"type": "table", "table_body": "<table><tr><td>1</td></tr></table>", "table_caption": ["cap"], "img_path": "t.png"},
        {"type": "text", "text": " "},
        {"type": "list", "list_items": ["x", " ", "y"]},
    ]
    for payload in ({"content_list": items}, {"data": {"result": {"blocks": items}}}, {"a": {"b": {"contents": items}}}):
        rows = bl.layout_blocks(layout(spark, payload)).orderBy("pos").collect()
        assert [(r.block_type, r.text, r.section_title) for r in rows] == [
            ("title", "Intro", "Intro"), ("image", "", "Intro"), ("table", "1\ncap", "Intro"), ("list", "x\ny", "Intro")
        ]
        assert rows[0].position_tag == "@@1\t1.0\t5.0\t2.0\t9.0##"
        assert [r.asset_paths for r in rows] == [{}, {"img_path": "a.png"}, {"table_img_path": "t.png"}, {}]
        assert rows[1].page_number == 2 and rows[3].layoutno == "list-0"


def test_section_stack_and_kb_blocks(spark):
    rows = [
        ("f", 0, "title", "A", 1, 1), ("f", 1, "text", "a1", 1, 1), ("f", 2, "paragraph", "a2", 1, 1), ("f", 3, "title", "B", 3, 1),
        ("f", 4, "text", "b", 1, 1), ("f", 5, "title", "Revision  History", 1, 2), ("f", 6, "text", "gone", 1, 2), ("f", 7, "image", "pic", 1, 2),
        ("f", 8, "title", "C", 1, 3), ("f", 9, "text", "c", 1, 3),
    ]
    b = spark.createDataFrame(rows, "file_id string, pos long, block_type string, text string, level int, page_number int")
    paths = {r.pos: r.section_path for r in ch.section_stack(b).collect()}
    assert paths[4] == ["A", "B"] and paths[9] == ["C"]
    got = [(r.kind, r.text, r.section) for r in ch.kb_blocks(b).orderBy("block_no").collect()]
    assert got == [("text", "a1\n\na2", "A"), ("text", "b", "A > B"), ("figure", "pic", "Revision History"), ("text", "c", "C")]


def test_positions_and_tags(spark):
    df = spark.createDataFrame([("@@2\t30.0\t10.0\t5.0\t1.0##x@@1-3\t1.0\t2.0\t3.0\t4.0##",)], "t string")
    r = df.select(ch.pdf_positions(F.col("t")).alias("p"), ch.strip_tags(F.col("t")).alias("s")).first()
    assert r.p == [[2.0, 10.0, 30.0, 1.0, 5.0], [3.0, 1.0, 2.0, 3.0, 4.0]] and r.s == "x"


def test_media_context(spark):
    rows = [("f", 0, "text", "First one. Second one.", None), ("f", 1, "table", "T", None), ("f", 2, "text", "After one. After two.", None)]
    b = spark.createDataFrame(rows, "file_id string, pos long, block_type string, text string, positions array<array<double>>")
    r = [x for x in media.media_context(b, table_budget=5).collect() if x.pos == 1][0]
    assert (r.context_above, r.context_below) == ("Second one.", "After one.")
    over = [("f", 0, "text", "Aaaa. Bbbb. Cccc. Dddd.", [[1.0, 0.0, 9.0, 0.0, 50.0]]), ("f", 1, "image", "I", [[1.0, 0.0, 9.0, 20.0, 30.0]])]
    r = [x for x in media.media_context(spark.createDataFrame(over, b.schema), image_budget=5).collect() if x.pos == 1][0]
    assert (r.context_above, r.context_below) == ("Bbbb.", "Cccc.")


def test_split_message(spark):
    text = "aaa\nbbb\n" + "c" * 10 + "\ndd"
    df = spark.createDataFrame([(text,), ("  ",), ("short",)], "t string")
    got = [r.r for r in df.select(ch.split_message(F.col("t"), 7).alias("r")).collect()]
    assert got == [["aaa\nbbb", "c" * 7, "ccc\ndd"], ["..."], ["short"]]


CHAT = "channel long, pos long, sent_at timestamp_ntz, speaker string, content string"


def messages(spark, n=400, seed=5):
    rnd, at, rows = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        at += timedelta(minutes=rnd.choice([0, 1, 5, 29, 30, 31, 300]))
        rows.append((i % 3, i, at, "ann", "x" * rnd.randint(1, 90)))
    return rows, spark.createDataFrame(rows, CHAT)


def test_low_value_gap_and_day(spark):
    t = datetime(2024, 1, 1, 10)
    rows = [(1, i, t + timedelta(minutes=m), s, c) for i, (m, s, c) in enumerate(
        [(0, "a", "one"), (20, "a", "收到"), (25, "[系统]", "x"), (30, "a", "two"), (61, "a", "three"), (61 + 24 * 60, "a", "four")])]
    df = spark.createDataFrame(rows, CHAT)
    gaps = chat.gap_sessions(df).orderBy("pos").collect()
    assert [(r.content, r.session) for r in gaps] == [("one", 1), ("two", 1), ("three", 2), ("four", 3)]
    assert chat.build_chunks(chat.day_sessions(df, 1), ["channel", "session"]).count() == 2
    assert chat.build_chunks(chat.day_sessions(df, 99), ["channel", "session"]).count() == 1


def test_day_fold_is_relative_to_the_first_message(spark):
    rows, df = messages(spark)
    got = {r.pos: str(r.session) for r in chat.day_sessions(df, 3).collect()}
    want, start = {}, {}
    for c, pos, at, _, _ in rows:
        if c not in start or (at.date() - start[c]).days >= 3:
            start[c] = at.date()
        want[pos] = str(start[c])
    assert got == want


def test_caps_equal_a_plain_fold(spark):
    rows, df = messages(spark, 700)
    sessions = df.withColumn("session", F.lit(0))
    for cap, chars, block in ((7, 300, 16), (5, 10_000, 8), (1000, 400, 1024), (50, 10_000, 16)):
        got = {r.pos: r.part for r in chat.capped_sessions(sessions, cap, chars, block).collect()}
        state, want = {}, {}
        for c, pos, _, speaker, content in rows:
            n, total, part = state.get(c, (0, 0, 0))
            size = len(speaker) + len(content) + 20
            if n == 0 or n >= cap or total + size > chars:
                n, total, part = 0, 0, part + 1
            state[c] = (n + 1, total + size, part)
            want[pos] = part
        assert got == want


def test_chunks_of_channels_without_a_name_and_of_none(spark):
    """Messages without a channel are one channel, over several blocks; extra columns stay; no rows give no rows."""
    rows, _ = messages(spark, 120)
    rows = [(None if c == 1 else c, *rest, "kept") for c, *rest in rows]
    df = spark.createDataFrame(rows, CHAT + ", extra string")
    got = {r.pos: (r.part, r.extra) for r in chat.chunk_parts(df, None, 7, 4, 10_000, 8).collect()}
    state, want = {}, {}
    for c, pos, at, *_ in rows:
        n, part, first = state.get(c, (0, 0, None))
        if n == 0 or n >= 4 or (at.date() - first).days >= 7:
            n, part, first = 0, part + 1, at.date()
        state[c] = (n + 1, part, first)
        want[pos] = (part, "kept")
    assert got == want
    assert chat.chunk_parts(df.limit(0), 30).count() == 0


def test_chunks_restart_their_window_at_a_cap(spark, monkeypatch):
    rows, df = messages(spark, 500)
    monkeypatch.setattr(chat._chain, "__defaults__", (3,))  # several levels of runs
    for gap, days, cap, chars, block in ((None, 7, 12, 400, 16), (None, 3, 40, 2000, 8), (30, 1, 6, 10_000, 4), (30, 1, 120, 8000, 1024)):
        got = {r.pos: r.part for r in chat.chunk_parts(df, gap, days, cap, chars, block).collect()}
        state, want = {}, {}
        for c, pos, at, speaker, content in rows:
            n, total, part, first, last = state.get(c, (0, 0, 0, None, None))
            size = len(speaker) + len(content) + 20
            apart = n and (at - last > timedelta(minutes=gap) if gap else (at.date() - first).days >= days)
            if n == 0 or n >= cap or total + size > chars or apart:
                n, total, part, first = 0, 0, part + 1, at.date()
            state[c] = (n + 1, total + size, part, first, at)
            want[pos] = part
        assert got == want


def test_nested_payloads(spark):
    said = lambda x: [{"type": "text", "content": x}]
    nested = {"data": {"content_list_v2": [
        [
            {"type": "title", "content": {"title_content": said("One"), "level": 1}},
            {"type": "paragraph", "content": {"paragraph_content": said("first") + [{"content": " half"}]}},
            {"type": "paragraph", "content": {"paragraph_content": said("second")}},
            {"type": "image", "content": {"image_source": {"path": "a.png"}}},
            {"type": "table", "content": {"table_caption": said("cap"), "html": "<table><tr><td>x</td><td>y</td></tr></table>",
                                          "table_footnote": said("foot"), "image_source": {"path": "t.png"}}},
        ],
        [
            {"type": "list", "content": {"list_items": [{"item_content": said("a")}, {"item_content": said("b")}]}},
            {"type": "equation_interline", "content": {"math_content": " E=mc "}, "equation_image_path": "e.png"},
            {"type": "image", "content": {}},
        ],
    ]}}
    flat = {"contents": [{"type": "text", "text": "p9", "page_idx": 8}, {"type": "text", "text": "p2", "page_number": 2}, "x"]}
    df = spark.createDataFrame([(1, json.dumps(nested)), (2, json.dumps(flat)), (3, "no json"), (4, None)], "file_id long, payload string")
    rows = ch.kb_blocks(bl.kb_items(df)).orderBy("file_id", "block_no").collect()
    got = [(r.file_id, r.kind, r.text, r.page_number, {e.key: e.value for e in r.assets}) for r in rows]
    assert got == [
        (1, "text", "first half\n\nsecond", 1, {}),
        (1, "figure", "", 1, {"img_path": "a.png"}),
        (1, "table", "Table: cap\nx | y\nNote: foot", 1, {"table_img_path": "t.png"}),
        (1, "text", "a\nb", 2, {}),
        (1, "formula", "E=mc", 2, {"equation_img_path": "e.png"}),
        (2, "text", "p2", 1, {}),
        (2, "text", "p9", 2, {}),
    ]
    assert {r.section for r in rows if r.file_id == 1} == {"One"}


def test_source_offsets_of_chunks(spark):
    def tag(page, *box):
        return f"@@{page}\t" + "\t".join(f"{x:.1f}" for x in box) + "##"

    a, b, c = tag(1, 0, 9, 2, 3), tag(2, 5, 1, 8, 7), tag(3, 1, 2, 3, 4)
    rows = [
        ("f", 0, 0, a), ("f", 0, 1, b + a), ("f", 0, 2, a), ("f", 0, 3, None), ("f", 1, 4, " "), ("f", 1, 5, None), ("g", 0, 10, c), ("g", 0, 9, "no tag"),
    ]
    df = spark.createDataFrame(rows, "file_id string, chunk_no long, pos long, position_tag string").repartition(3)
    got = {(r.file_id, r.chunk_no): (r.position_tags, r.pdf_positions) for r in ch.source_offsets(df, ["file_id", "chunk_no"]).collect()}
    assert got == {
        ("f", 0): ([a, b + a, a], [[1.0, 0.0, 9.0, 2.0, 3.0], [2.0, 1.0, 5.0, 7.0, 8.0]]),
        ("g", 0): (["no tag", c], [[3.0, 1.0, 2.0, 3.0, 4.0]]),
    }
