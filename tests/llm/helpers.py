"""Small document tables with the awkward cases, and plain versions of common steps."""

import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = [None, "", "   ", "\n\t", "a", "one two", "é ü 漢字 🙂", "x" * 5000, "the quick brown fox " * 400, "a\x00b \x1d c\xa0d"]


def words(text):
    return [w.lower() for w in WORD.findall((text or "").encode())]


def shingle_set(text, size):
    w = words(text)
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def near_copies(rng, groups=4, copies=25, length=60):
    """Groups of edited copies, edited copies of these, and texts that share a passage."""
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    passage = [rng.choice(vocabulary) for _ in range(20)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 12, length, 2 * length]))]
        for _ in range(copies):
            text = list(rng.choice(out[-6:]).split()) if out and rng.random() < 0.15 else list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(text))
                kind = rng.random()
                if kind < 0.5:
                    text[at] = rng.choice(vocabulary)
                elif kind < 0.75 and len(text) > 4:
                    del text[at]
                else:
                    text.insert(at, rng.choice(vocabulary))
            out.append(" ".join(text))
    for _ in range(copies):
        own = [rng.choice(vocabulary) for _ in range(rng.choice([5, 40]))]
        out.append(" ".join(own + passage))
    return out


def documents(spark, texts, extra=True):
    """Rows with ids in no order, two of them repeated and one without id; columns that clash with inner names."""
    rng = random.Random(5)
    rows = [(i * 3, t, ["en", "de", None][i % 3], ["s1", "s2", None, "S3"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[-1], (None, "no id here at all", "en", "s1", 5)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        df = df.selectExpr("*", "'x' as node", "1 as size", "2 as row", "'y' as bucket", "'z' as spans", "0 as copies", "'q' as list")
    return df.repartition(5)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
