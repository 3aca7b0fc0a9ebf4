"""Column functions over text, lists and labels. All of them stay inside Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from loreframe.functions.constants import (
    CHAT_KEYWORDS,
    DEDUPE_FOLDS,
    DEDUPE_PUNCTUATION,
    INTENTS,
    KB_BLOCK_TYPES,
    PROCEDURE_WORDS,
    REALTIME_WHAT,
    REALTIME_WHEN,
    SENSITIVE_WORDS,
    SENTENCE_ENDERS,
    SMALLTALK,
    TROUBLE_WORDS,
    WS,
)


def strip(c: Column) -> Column:
    """Remove every kind of leading and trailing white space (``trim`` drops spaces only)."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+$", "")


def compact(c: Column) -> Column:
    """Collapse white-space runs to one space and strip."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", " "))


def blank(c: Column) -> Column:
    """Null or white space only; stops at the first other character."""
    return ~F.coalesce(c, F.lit("")).rlike(r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]")


def none_if_blank(c: Column) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def truncate(c: Column, limit: int) -> Column:
    """Compact, then cut to ``limit`` characters with a trailing ellipsis."""
    t = compact(c)
    return F.when(
        F.length(t) > limit, F.concat(rstrip(F.substring(t, 1, limit - 3)), F.lit("..."))
    ).otherwise(t)


def clean_items(items: Column) -> Column:
    """Trimmed, non-empty members of an array."""
    return F.filter(F.transform(items, strip), lambda x: F.coalesce(x, F.lit("")) != "")


def clean_list(c: Column, separators: str = ",") -> Column:
    """JSON array or separated text to a list of trimmed, non-empty strings."""
    parsed = F.from_json(c, "array<string>")
    is_array = F.json_array_length(c).isNotNull()
    pieces = F.split(c, f"[{separators}]")
    return clean_items(
        F.coalesce(F.when(is_array, parsed), pieces, F.array().cast("array<string>"))
    )


def split_list(c: Column) -> Column:
    """Split on comma, full-width comma, new line and both semicolons."""
    return clean_items(
        F.coalesce(F.split(c, "[,，\n；;]"), F.array().cast("array<string>"))
    )


def safe_int(c: Column) -> Column:
    return F.try_to_number(c, F.lit("S999999999999999999")).cast("long")


def join_parts(*parts: Column, sep: str = "\n") -> Column:
    """Join scalar and array parts, skipping null and blank ones."""
    return F.array_join(clean_items(F.filter(F.flatten(F.array(*parts)), lambda x: x.isNotNull())), sep)


def one(c: Column) -> Column:
    """Wrap a scalar so it can be joined by :func:`join_parts`."""
    return F.array(c)


def labelled(label: str, value: Column) -> Column:
    """``label + value`` or null when the value is empty; ``concat_ws`` then skips it."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))


def page_range(start: Column, end: Column) -> Column:
    return (
        F.when(start.isNull() & end.isNull(), F.lit(""))
        .when(
            start.isNotNull() & end.isNotNull() & (start != end),
            F.concat(start.cast("string"), F.lit("-"), end.cast("string")),
        )
        .otherwise(F.coalesce(start, end).cast("string"))
    )


def contains_any(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(re.escape(w) for w in words))


def keywords_in(c: Column, words: list[str], limit: int | None = None) -> Column:
    found = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))
    return F.slice(found, 1, limit) if limit else found


def chat_keywords(c: Column) -> Column:
    return keywords_in(c, CHAT_KEYWORDS, 4)


def chunk_keywords(blocks: Column, limit: int = 6) -> Column:
    """First distinct source files, section titles and types of struct(source_file, section_title, block_type)."""
    values = F.flatten(F.transform(blocks, lambda b: F.array(b["source_file"], b["section_title"], b["block_type"])))
    return F.slice(F.array_distinct(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != "")), 1, limit)


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def query_intent(question: Column) -> Column:
    """Ordered rules; the first that matches decides the intent and how to act on it."""
    text = compact(question)

    def rule(intent, confidence, sources, reason, realtime=False, action="answer_with_retrieval"):
        return F.struct(
            F.lit(intent).alias("intent"),
            F.lit(confidence).alias("confidence"),
            _strings(sources).alias("preferred_sources"),
            F.lit(realtime).alias("must_not_answer_realtime"),
            F.lit(action).alias("safety_action"),
            F.lit(reason).alias("reason"),
        )

    both = ["faq", "document"]
    return (
        F.when(
            contains_any(F.lower(text), SENSITIVE_WORDS),
            rule(INTENTS[5], "high", [], "sensitive rule", action="refuse"),
        )
        .when(
            contains_any(text, REALTIME_WHEN) & contains_any(text, REALTIME_WHAT),
            rule(INTENTS[3], "high", both, "realtime rule", realtime=True),
        )
        .when(contains_any(text, TROUBLE_WORDS), rule(INTENTS[2], "high", both, "trouble rule"))
        .when(
            contains_any(text, PROCEDURE_WORDS),
            rule(INTENTS[1], "high", ["document", "faq"], "procedure rule"),
        )
        .when(text.isin(SMALLTALK), rule(INTENTS[4], "high", [], "smalltalk rule", action="smalltalk"))
        .otherwise(rule(INTENTS[0], "medium", both, "default"))
    )


def error_codes(text: Column) -> Column:
    """Upper-cased error codes such as ``E-1024``; boundaries are explicit look-arounds."""
    word = r"[\p{L}\p{N}_]"
    pattern = (
        rf"(?<!{word})[A-Za-z]+[-_]?[0-9]{{2,}}[A-Za-z0-9_-]*(?<=[A-Za-z0-9_])(?!{word})"
    )
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), F.upper)


def latin_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9][A-Za-z0-9_-]{1,}"), 0)


def append_tokens(prior: Column, tokens: Column) -> Column:
    """Add tokens whose upper-cased form is not present yet, in order."""
    return F.aggregate(
        tokens,
        prior,
        lambda acc, t: F.when(
            F.array_contains(acc, F.upper(t)) | F.array_contains(acc, t), acc
        ).otherwise(F.array_append(acc, t)),
    )


def dedupe_text(c: Column) -> Column:
    """Lower, fold common phrases, drop white space and punctuation."""
    folded = F.lower(F.coalesce(c, F.lit("")))
    for source, target in DEDUPE_FOLDS:
        folded = F.replace(folded, F.lit(source), F.lit(target))
    marks = "".join("\\" + m if m in "[]()\\" else m for m in DEDUPE_PUNCTUATION)
    return F.regexp_replace(folded, rf"[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}{marks}]+", "")


def dedupe_signature(question: Column, answer: Column) -> Column:
    return F.sha2(F.concat(dedupe_text(question), F.lit("|"), dedupe_text(answer)), 256)


def faq_embedding_text(
    question: Column, variants: Column, answer: Column, category: Column, tags: Column
) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("标准问题："), strip(F.coalesce(question, F.lit("")))),
        labelled("相似问法：", F.array_join(clean_items(variants), "；")),
        F.concat(F.lit("答案："), strip(F.coalesce(answer, F.lit("")))),
        labelled("分类：", strip(category)),
        labelled("标签：", F.array_join(clean_items(tags), "，")),
    )


def faq_content(question: Column, variants: Column, answer: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("问题："), strip(F.coalesce(question, F.lit("")))),
        labelled("相似问法：", F.array_join(clean_items(variants), "；")),
        F.concat(F.lit("答案："), strip(F.coalesce(answer, F.lit("")))),
    )


def document_embedding_text(
    title: Column,
    section_path: Column,
    page_start: Column,
    page_end: Column,
    block_type: Column,
    keywords: Column,
    questions: Column,
    body: Column,
) -> Column:
    return F.concat_ws(
        "\n",
        labelled("文件：", title),
        labelled("章节：", F.array_join(section_path, " > ")),
        labelled("页码：", page_range(page_start, page_end)),
        labelled("块类型：", block_type),
        labelled("关键词：", F.array_join(keywords, "，")),
        labelled("可能问题：", F.array_join(questions, " / ")),
        F.concat(F.lit("正文："), body),
    )


def content_hash(embedding_text: Column) -> Column:
    """Only equality matters, so the text itself is hashed."""
    return F.sha2(embedding_text, 256)


def name_key(name: Column) -> Column:
    return F.lower(compact(name))


def entity_id(name: Column, entity_type: Column) -> Column:
    return F.concat(
        F.lit("kg_ent_"),
        F.substring(F.sha2(F.concat_ws("\u0001", name_key(name), entity_type), 256), 1, 16),
    )


def relation_id(head: Column, relation_type: Column, tail: Column) -> Column:
    return F.concat(
        F.lit("kg_rel_"),
        F.substring(F.sha2(F.concat_ws("\u0001", head, relation_type, tail), 256), 1, 16),
    )


def child_index(parent: Column, child: Column) -> Column:
    """Pairs (parent, child) into one negative index that never meets a parent's own index."""
    p = F.greatest(parent.cast("long"), F.lit(0).cast("long"))
    c = F.greatest(child.cast("long"), F.lit(0).cast("long"))
    s = p + c
    return -(F.shiftright(s * (s + 1), 1) + c + 1)


def embedding_transition(status: Column, old_hash: Column, new_hash: Column) -> Column:
    same = old_hash.eqNullSafe(new_hash)
    return (
        F.when((status == "ready") & same, F.lit("ready"))
        .when(status == "ready", F.lit("stale"))
        .when(status.isin("stale", "failed") & same, status)
        .otherwise(F.lit("pending"))
    )


def sentences(c: Column) -> Column:
    """Split after every sentence ender; the ender stays with its sentence."""
    e = SENTENCE_ENDERS.replace("\n", r"\n")
    return F.regexp_extract_all(c, F.lit(f"[^{e}]*[{e}]|[^{e}]+$"), 0)


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def kb_block_type(c: Column) -> Column:
    pairs = [F.lit(x) for kv in KB_BLOCK_TYPES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.nullif(c, F.lit("")), F.lit("text"))


def strip_fence(c: Column) -> Column:
    """Body of a fenced code block when the whole answer is one; else the stripped text."""
    s = strip(c)
    body = F.regexp_extract(s, r"(?s)^```(?:json|JSON)?\s*(.*?)\s*```$", 1)
    return F.when(body != "", body).otherwise(s)
