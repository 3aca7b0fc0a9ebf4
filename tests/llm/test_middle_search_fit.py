import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loreframe.llm import best_fit, lexical_search, queries
from loreframe.llm.best_fit import pack_best_fit, plan_best_fit
from loreframe.llm.fill_middle import fill_in_middle, restored
from loreframe.llm.lexical_search import search
from tests.llm.helpers import ODD, documents, empty, near_copies

MARKED = ["has <P> inside", "<M>", "x<S", "<<S>", "S><P", "<", "a<P", "<P<S<M"]


def plain_middle(row):
    text = row["text"] or ""
    h = hashlib.sha256(f"1:{'' if row['doc_id'] is None else row['doc_id']}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if n == 0 or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return row["doc_id"], n, "plain", None, None, text
    if h4 % 100 < 20:
        return row["doc_id"], n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return row["doc_id"], n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fill_in_middle_equals_slicing(spark):
    rng = random.Random(3)
    mixed = ["".join(rng.choice("a<>PSM 漢🙂é\n") for _ in range(rng.randrange(40))) for _ in range(300)]
    docs = documents(spark, ODD + MARKED + mixed + ["long é " * 50_000])
    rows = docs.collect()
    got = fill_in_middle(docs).collect()
    assert Counter(map(tuple, got)) == Counter(map(plain_middle, rows))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    back = fill_in_middle(docs).select("doc_id", restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert Counter(map(tuple, back)) == Counter((r["doc_id"], r["text"] or "") for r in rows)
    assert fill_in_middle(empty(spark)).collect() == []


def test_fill_in_middle_cuts_between_units(spark):
    docs = documents(spark, ["éä x\r\n" * 20, "two words here and more ", "no blank at the end"])
    for r in fill_in_middle(docs, unit=r"\X", plain_percent=0, spm_percent=0).collect():
        assert not re.search("<[PSM]>[́̈]", r["output"])  # no mark is parted from its letter
    words = fill_in_middle(docs, unit=r"\S+\s", plain_percent=0, markers=("[P]", "[S]", "[M]"), seed=9).collect()
    by_text = {r["doc_id"]: r for r in words}
    assert by_text[3]["n"] == 5 and by_text[6]["n"] is None and by_text[6]["form"] == "plain"
    assert re.fullmatch(r"(\[[PSM]\](\S+\s)*){3}", by_text[3]["output"])


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in TERM.findall(text or "")]


def plain_search(docs, items, k):
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for doc, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms if n_terms else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(plain_terms(text)) if t in c
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, doc, -score] += 1
    return out


def items_of(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], "x"), (None, texts[2], "y")]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string")


@pytest.mark.parametrize("block,cells,merged,k", [(1 << 20, 1 << 20, 256, 3), (2000, 64, 1, 1), (1, 7, 2, 10)])
def test_search_equals_plain_scores(spark, monkeypatch, block, cells, merged, k):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    monkeypatch.setattr(lexical_search, "MERGED", merged)
    texts = near_copies(random.Random(block), groups=2, copies=15)
    docs = documents(spark, texts + ODD + ["QUICK\x7fbrown{fox}Été ÉTÉ 漢字"] * 12)
    items = items_of(spark, [*texts[:3], "the quick BROWN fox", "Été", "ÉTÉ w1 w2 w2", None, "", "?!", "unheard of zzz"][: 10 if block > 1 else 6])
    got = search(docs, items, k)
    want = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r)[:2] for r in items.collect()], k)
    assert Counter(map(tuple, got.collect())) == want
    assert got.schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"


def test_search_of_nothing(spark):
    items = items_of(spark, ["a b", "c", "d"])
    assert search(empty(spark), items).collect() == []
    assert search(documents(spark, [None, "", "?"]).where("doc_id is not null"), items).collect() == []
    assert search(documents(spark, ["a b"]), items.limit(0)).collect() == []


def test_sums_beyond_exact_doubles(spark, monkeypatch):
    heaps = lexical_search.Heaps(1, 2)
    heaps.update(np.array([[1 << 60], [(1 << 60) + 1], [0]]), [5, 6, 7])
    heaps.update(np.array([[1 << 60], [1 << 60]]), [4, None])
    assert sorted(heaps.heaps[0]) == [(1 << 60, -4, 4), ((1 << 60) + 1, -6, 6)]


def best_fit_decreasing(lengths, window):
    """Sequences that plain best-fit decreasing opens."""
    gaps, opened = Counter(), 0
    for length in sorted(lengths, reverse=True):
        gap = next((g for g in range(length, window + 1) if gaps[g]), None)
        if gap is None:
            gap, opened = window, opened + 1
        else:
            gaps[gap] -= 1
        gaps[gap - length] += 1
    return opened


def check_plan(plan, lengths, window):
    """Every piece has one place, sequences are gapless and no longer than the window; the number of sequences."""
    seen, spans = Counter(), defaultdict(list)
    for r in plan:
        for i in range(r["n"]):
            seen[r["length"], r["first"] + i] += 1
            spans[r["sequence"] + i // r["per"]].append((r["offset"] + i % r["per"] * r["length"], r["length"]))
    counts = Counter(lengths)
    assert seen == Counter({(length, i): 1 for length, n in counts.items() for i in range(n)})
    for places in spans.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    return len(spans)


@pytest.mark.parametrize("kind,few_runs,ranges", [("spread", 256, 4), ("small", 256, 1), ("few", 256, 4), ("spread", 12, 3), ("thirds", 8, 5)])
def test_best_fit_uses_few_sequences(spark, kind, few_runs, ranges):
    rng, window = random.Random(few_runs + ranges), 48
    lengths = {
        "spread": [min(window, 1 + int(rng.expovariate(0.08))) for _ in range(700)],
        "small": [rng.randrange(1, 5) for _ in range(300)],
        "thirds": [rng.randrange(13, 26) for _ in range(150)],
        "few": [20] * 9 + [15] * 9 + [13] * 9 + [48] * 2 + [1],
    }[kind]
    table = spark.createDataFrame(list(Counter(lengths).items()), "length long, n long")
    used = check_plan(plan_best_fit(table, window, ranges, few_runs).collect(), lengths, window)
    least = -(-sum(lengths) // window)
    assert least <= used <= best_fit_decreasing(lengths, window) * 1.02 + 1


@pytest.mark.parametrize("plan_rows", [1 << 20, 0])
def test_best_fit_pieces_hold_every_token_once(spark, monkeypatch, plan_rows):
    from tokenizers import Tokenizer

    monkeypatch.setattr(best_fit, "PLAN_ROWS", plan_rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = documents(spark, ODD + near_copies(random.Random(8), groups=2, copies=10))
    rows = pack_best_fit(docs, queries.word_encoder, 1, 64, with_ids=True).collect()
    whole = Counter(tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in docs.collect())
    expected = Counter()
    for ids, n in whole.items():
        for k in range(0, len(ids), 64):
            cut = np.array(ids[k : k + 64], "<u4").tobytes()
            expected[k // 64, k, len(cut) // 4, zlib.crc32(cut), cut] += n
    assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in rows) == expected
    spans = defaultdict(list)
    for r in rows:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in spans.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1].tolist()]
        assert sum(n for _, n in places) <= 64
    assert len(spans) <= best_fit_decreasing([r["length"] for r in rows], 64) * 1.02 + 1


def test_best_fit_of_nothing(spark):
    assert pack_best_fit(empty(spark), queries.word_encoder, 1).collect() == []
    one = pack_best_fit(documents(spark, [None]).where("doc_id = 0").limit(1), queries.word_encoder, 1).collect()
    assert [(r["doc_id"], r["length"], r["offset"]) for r in one] == [(0, 1, 0)]
