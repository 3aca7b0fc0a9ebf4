import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loreframe.llm import jaccard_join, mixing, queries
from loreframe.llm.fingerprints import BITS, edited_text, fingerprint_edits, near_classes, radius_for, within_radius
from loreframe.llm.jaccard_join import near_duplicate_classes
from loreframe.llm.language_id import held_out, identify, learn
from loreframe.llm.mixing import mix_sizes, mix_sources, word_count
from loreframe.llm.packing import pack
from loreframe.llm.token_counts import piece_counter, token_counts
from tests.llm.helpers import ODD, documents, empty, near_copies, shingle_set, words


def brute_classes(rows, size, percent):
    sets = [shingle_set(r["text"], size) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r["doc_id"])
    out = []
    for i, r in enumerate(rows):
        ids = [d for d in least[find(i)] if d is not None]
        out.append((r["doc_id"], len(sets[i]), (min(ids) if ids else None) if sets[i] else r["doc_id"]))
    return Counter(out)


@pytest.mark.parametrize("short,reference,block", [(32, 33, 1024), (2, 3, 4), (3, 7, 12)])
@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_classes_equal_all_pairs(spark, monkeypatch, size, percent, short, reference, block):
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard_join, "REFERENCE_FROM", reference)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "FREQUENT_AT", 5)
    docs = documents(spark, near_copies(random.Random(short * size), groups=5, copies=30) + ODD)
    got = near_duplicate_classes(docs, size, percent).collect()
    assert Counter(map(tuple, got)) == brute_classes(docs.collect(), size, percent)


def test_pairs_that_share_a_passage_are_not_compared(spark, monkeypatch):
    """Texts with one passage of three n-grams in common meet in short lists; only near copies are compared by their sets."""
    rng, texts = random.Random(3), []
    for _ in range(20):
        passage = [f"p{rng.randrange(10**6)}" for _ in range(7)]
        for _ in range(10):
            texts.append(" ".join([f"w{rng.randrange(10**6)}" for _ in range(60)] + passage))
    texts += [t.replace(t.split()[5], "other") for t in texts[::40]]
    pairs, written = [], jaccard_join.written

    def counted(df, label):
        table = written(df, label)
        if label == "short":
            pairs.append(table.count())
        return table

    monkeypatch.setattr(jaccard_join, "written", counted)
    docs = documents(spark, texts)
    got = near_duplicate_classes(docs, 5, 80).collect()
    assert Counter(map(tuple, got)) == brute_classes(docs.collect(), 5, 80)
    assert len(pairs) == 1 and 5 <= pairs[0] <= 10


def test_classes_of_nothing(spark):
    assert near_duplicate_classes(empty(spark)).collect() == []
    blank = documents(spark, [None, "", " "]).where("doc_id is not null")
    assert all(r["component_id"] == r["doc_id"] and r["n_shingles"] == 0 for r in near_duplicate_classes(blank).collect())


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_pieces_hold_every_token_once(spark, tokenizer):
    texts = ODD + ["It's <|endoftext|> don't", "İstanbul ﬁne Ω'll", *near_copies(random.Random(1))]
    docs = documents(spark, texts)
    rows = pack(docs, queries.word_encoder, 1, 64, with_ids=True).collect()
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
    place = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    at = [r["sequence_id"] * 64 + r["offset"] for r in place]
    assert at == list(np.cumsum([0, *[r["length"] for r in place]])[:-1])  # no gap, no overlap, all but the last full
    assert all(r["offset"] + r["length"] <= 64 for r in rows)
    whole, stream = [], []
    for r in place:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        if r["start"] == 0:
            stream = []
            whole.append((r["doc_id"], stream))
        assert r["start"] == len(stream) and r["doc_id"] == whole[-1][0]
        stream.extend(r["ids"])
    want = Counter((d["doc_id"], tuple(ids(d["text"]))) for d in docs.collect())
    assert Counter((d, tuple(s)) for d, s in whole) == want
    assert pack(empty(spark), queries.word_encoder, 1).collect() == []


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    signs = list("aabbeethnorsin   \n\t▁▁.,0123é漢字🙂́\x00<s></s>'sST") + ["<s>", "the", " the", "   ", "aaaa"]
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.choice([1, 3, 40, 300]))) for _ in range(300)]
    texts += ["a" * 3000, " " * 999, "ab" * 2000, "▁" * 17, "thethethe" * 300, "<s>" * 3000]
    docs = documents(spark, texts)
    got = Counter(map(tuple, token_counts(docs, queries.count_pieces, 200).collect()))
    want = Counter()
    for r in docs.collect():
        n = len(model.encode(r["text"] or ""))
        want[(r["doc_id"], len((r["text"] or "").encode()), n, n > 200)] += 1
    assert got == want
    assert token_counts(empty(spark), queries.count_pieces).collect() == []


def test_a_full_memory_changes_nothing(monkeypatch):
    from loreframe.llm import packing, token_counts as counts

    texts = near_copies(random.Random(2))
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = [x.tolist() for x in packing.word_ids(path)(texts)]
    pieces = piece_counter(public_tokenizers.path("piece_bpe_32k.model"))(texts)
    monkeypatch.setattr(packing, "CACHED_WORDS", 50)
    monkeypatch.setattr(counts, "CACHED_WORDS", 50)
    words_, pieces_ = packing.word_ids(path), piece_counter(public_tokenizers.path("piece_bpe_32k.model"))
    assert [w.tolist() for t in texts for w in words_([t])] == whole
    assert [n for t in texts for n in pieces_([t])] == pieces


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op4(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_cases(spark):
    docs = documents(spark, ["the cat and the dog"] * 6 + ["der Hund und die Katze"] * 6 + ODD + ["123 456"])
    learned = learn(docs)
    assert sorted(learned) == ["de", "en"]
    got = identify(docs, learned, ["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
    assert {r["lang_pred"] for r in identify(docs, {}, ["doc_id"]).collect()} == {"und"}
    assert learn(empty(spark)) == {} and identify(empty(spark), learned, ["doc_id"]).collect() == []
    assert spark.range(1).select(held_out(F.lit(None).cast("long"))).first()[0] is False


def brute_targets(sizes):
    """Deals out by weight and reshares the excess again and again."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {s: 0.0 for s in names}, 1.5 * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        rate = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += rate * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_mix_reaches_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 16)
    monkeypatch.setattr(mixing, "FAN", 2)
    rng = random.Random(4)
    texts = ODD + [" ".join(["w"] * rng.randint(1, 40)) for _ in range(600)]
    docs = documents(spark, texts)
    rows = mix_sources(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(words(r["text"])) and 0 <= r["copies"] <= 2
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    want = brute_targets(sizes)
    for s, n in sizes.items():
        largest = max(r["size"] for r in rows if r["source"] == s)
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= largest
        assert {r["source_size"] for r in rows if r["source"] == s} == {n}
    light = mix_sizes(docs.repartition(3)).collect()
    assert Counter((r["doc_id"], r["size"], r["source"], r["copies"]) for r in rows) == Counter(
        (r["doc_id"], r["size"], r["source"], r["copies"]) for r in light
    )
    assert mix_sources(empty(spark)).collect() == []


def test_mix_keeps_expected_copies(spark):
    docs = spark.createDataFrame([(i, "a b c", "st"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    total = Counter()
    for seed in range(12):
        for r in mix_sizes(docs, weights=(1, 2), share=1.0, seed=seed).collect():
            total[r["source"]] += r["copies"]
            total[r["doc_id"]] += r["copies"]
    assert total["s"] == pytest.approx(12 * 20, abs=12) and total["t"] == pytest.approx(12 * 40, abs=12)
    # 12 draws of 2/3 have a variance of 8/3; a favoured document would stand out
    assert 30 < sum((total[i] - 8) ** 2 for i in range(0, 60, 2)) < 160


def test_word_count(spark):
    docs = documents(spark, ODD)
    for r in docs.withColumn("n", word_count(F.col("text"))).collect():
        assert r["n"] == len(words(r["text"]))


def plain_simhash(terms):
    """Votes and signs by the definition, for the terms' hashes with repeats."""
    step = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & step
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & step
        return x ^ (x >> 31)

    salts = [mixed(((k + 1) * 0x9E3779B97F4A7C15) & step) for k in range(BITS // 64)]
    votes = [0] * BITS
    for term, count in Counter(terms).items():
        bits = b"".join(mixed((term + salt) & step).to_bytes(8, "little") for salt in salts)
        for k in range(BITS):
            votes[k] += count.bit_length() * (1 if bits[k // 8] >> (7 - k % 8) & 1 else -1)
    return sum((v >= 0) << (BITS - 1 - k) for k, v in enumerate(votes)).to_bytes(BITS // 8, "big")


def brute_fingerprint(text):
    """By the definition, with the hash of every term taken from the module's own arrays."""
    import pyarrow as pa

    from loreframe.llm.fingerprints import fingerprints

    return fingerprints(pa.array([text or ""]))[0]


@pytest.mark.parametrize("buckets", [1, 3, 8])
def test_fingerprints_of_edits(spark, buckets):
    docs = documents(spark, ODD + near_copies(random.Random(6), groups=2, copies=10)).where("doc_id is not null").distinct()
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r for r in fingerprint_edits(docs, buckets).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        text, following = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        edit = edited_text(text, following)
        assert edit == text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        g = got[r["doc_id"]]
        assert g["n_chars"] == len(text) and g["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        own, other, nxt = brute_fingerprint(text), brute_fingerprint(edit), brute_fingerprint(following)
        assert (g["fingerprint"], g["edited_fingerprint"]) == (own.hex(), other.hex())
        apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b)) / BITS
        assert g["near_edited"] == pytest.approx(1 - apart(own, other)) and g["near_next"] == pytest.approx(1 - apart(own, nxt))


def test_fingerprint_cases(spark):
    assert fingerprint_edits(empty(spark)).collect() == []
    one = fingerprint_edits(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one[0]["near_next"] == 1
    docs = documents(spark, ODD)
    assert fingerprint_edits(docs, 4).count() == docs.count()  # repeated rows and a null id


def test_all_fingerprints_within_the_radius(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(BITS) for _ in range(12)]
    marks = {f"{b:064x}" for b in base}
    for b in base:
        for flips in (1, 2, 3, 3, 4, 5):
            x = b
            for k in rng.sample(range(BITS), flips):
                x ^= 1 << k
            marks.add(f"{x:064x}")
    df = spark.createDataFrame([(m,) for m in marks] + [(None,), (min(marks),)], "fingerprint string")
    got = {(r["a"], r["b"]): r["distance"] for r in within_radius(df, 3).collect()}
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    assert got == {(a, b): apart(a, b) for a in marks for b in marks if a < b and apart(a, b) <= 3}


def apart(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def classes_of(rows, radius):
    """Smallest id and number of others of every row's class, from all pairs."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if apart(a, rows[j][1]) <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return {m: (min(g), len(g) - 1) for g in groups.values() for m in g}


@pytest.mark.parametrize("full,sampled", [(1 << 16, 64), (4, 1)])
def test_near_classes_of_chains(spark, monkeypatch, full, sampled):
    """Chains whose ends are far apart, hubs and copies; with small buckets all are split and joined again."""
    monkeypatch.setattr("loreframe.llm.fingerprints.FULL_BUCKET", full)
    monkeypatch.setattr("loreframe.llm.fingerprints.SAMPLED", sampled)
    rng = random.Random(8)
    rows = []
    for _ in range(6):
        x = rng.getrandbits(BITS)
        for step in range(14):
            rows.append((len(rows), f"{x:064x}"))
            for k in rng.sample(range(BITS), 14):  # neighbours within the radius, ends far beyond it
                x ^= 1 << k
        rows.append((len(rows), rows[-1][1]))
    rows += [(len(rows) + k, f"{rng.getrandbits(BITS):064x}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    got = df.join(near_classes(df, 0.9), "fingerprint").collect()
    assert {r["doc_id"]: (r["near_class"], r["n_near"]) for r in got} == classes_of(rows, radius_for(0.9))


@pytest.mark.parametrize("small,step", [(1 << 12, 1 << 20), (64, 8)])
def test_near_classes_lose_no_pair_at_the_radius(spark, monkeypatch, small, step):
    """Pairs just within and just beyond the radius, in one cell and in several; and without any table, by the cells alone."""
    monkeypatch.setattr("loreframe.llm.fingerprints.SMALL_CELL", small)
    monkeypatch.setattr("loreframe.llm.fingerprints.STEP", step)
    monkeypatch.setattr("loreframe.llm.fingerprints.WIDE", 1)
    rng, radius, rows = random.Random(10), radius_for(0.9), []
    for n in range(120):
        x = rng.getrandbits(BITS)
        y = x ^ sum(1 << k for k in rng.sample(range(BITS), radius + (n % 4 == 0)))
        rows += [(len(rows), f"{x:064x}"), (len(rows) + 1, f"{y:064x}")]
    x = rng.getrandbits(BITS)  # many that are all near each other
    rows += [(len(rows) + k, f"{x ^ (1 << k):064x}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    for recall in (0.9, 0.01):
        got = df.join(near_classes(df, 0.9, recall), "fingerprint").collect()
        assert {r["doc_id"]: (r["near_class"], r["n_near"]) for r in got} == classes_of(rows, radius)


def test_near_copies_are_found_by_their_texts(spark):
    """Recall of pairs of Jaccard 0.9 or more, on edited texts; clean texts stay alone."""
    rng = random.Random(9)
    rows = []
    for _ in range(150):
        text = [rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(300)]
        edit = list(text)
        for at in rng.sample(range(300), 3):  # 15 of 296 shingles at most: a Jaccard similarity of 0.9 or more
            edit[at] = "changed"
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(edit))]
    marks = fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"), 4).select("doc_id", "fingerprint")
    marks = spark.createDataFrame(marks.collect(), marks.schema)
    got = {r["doc_id"]: r for r in marks.join(near_classes(marks, 0.9), "fingerprint").collect()}
    assert sum(got[k + 1]["near_class"] == k for k in range(0, 300, 2)) >= 0.9 * 150
    assert all(got[k]["near_class"] // 2 == k // 2 and got[k]["n_near"] <= 1 for k in got)


def test_near_classes_cases(spark):
    kind = "doc_id long, fingerprint string"
    assert near_classes(spark.createDataFrame([], kind)).collect() == []
    f = "0f" * 32
    rows = [(None, f), (5, f), (5, f), (None, "f0" * 32), (1, None)]
    got = near_classes(spark.createDataFrame(rows, kind)).collect()
    assert {(r["fingerprint"], r["near_class"], r["n_near"]) for r in got} == {(f, 5, 2), ("f0" * 32, None, 0)}


def test_votes_and_weights(spark):
    import pyarrow as pa

    from loreframe.llm.fingerprints import fingerprints
    from loreframe.llm.wordarrays import shingles, text_bytes, word_hashes

    texts = ["a b c d e f g", "one", "", "x y " * 40, " ".join(str(k % 50) for k in range(400))]
    hashes, offsets = shingles(*word_hashes(*text_bytes(pa.array(texts))), 5)
    plain = [plain_simhash([int(h) for h in hashes[a:b]]) for a, b in zip(offsets[:-1], offsets[1:])]
    assert fingerprints(pa.array(texts)) == plain
