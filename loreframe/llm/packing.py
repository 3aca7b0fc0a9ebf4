"""Concatenate and cut: documents become one stream of token ids, cut into windows of fixed length.

Pass one tokenizes each input partition once and writes the ids with running totals inside the
partition. A prefix sum over the partitions' totals (one row each) turns them into global offsets. Pass
two cuts every document at the multiples of the window: a piece that starts or ends there is a boundary
record. No text or token is shuffled, only the last window can be short, and a lost executor costs the
pass over its partitions.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from loreframe.llm.wordarrays import give_back, slices
from loreframe.session import written

CACHED_WORDS = 800_000  # words remembered per task; a full memory is emptied and filled anew
# a run of these after letters is a token run of its own (an apostrophe may join letters)
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _plain(word: str) -> bool:
    """Whether normalising only lower-cases the word, and all of it is one run of letters."""
    return word.isalpha() and (word.isascii() or (max(word) < "\u0250" and "\u0130" not in word))


def word_ids(path: str, remembered: int | None = None) -> Callable[[list[str] | pa.Array], list[np.ndarray]]:
    """Token ids of texts under a tokenizer that drops white space between its words.

    White space always ends a token there, so a text's ids are those of its words one after another, and
    each distinct word is encoded once while ``remembered`` words (CACHED_WORDS if not given) suffice. Words of plain letters are encoded many in one call; ids that end
    a word tell them apart.
    """
    remembered = remembered or CACHED_WORDS
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    letters = Tokenizer(tokenizer.model)  # for lower-case words that need neither normalising nor splitting
    letters.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    wide = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for t, i in vocabulary.items() if t.endswith(tokenizer.model.end_of_word_suffix or "")]] = True
    known: dict[str, bytes] = {}
    stems: dict[str, bytes] = {}

    def encode_one(words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            for word, found in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[word] = np.array(found.ids, wide).tobytes()

    def encode_stems(words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = np.array(letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, wide)
            cuts = ((np.flatnonzero(ends[ids]) + 1) * wide.itemsize).tolist()
            raw = ids.tobytes()
            stems.update(zip(part, [raw[x:y] for x, y in zip([0, *cuts[:-1]], cuts)]))

    tails: dict[str, bytes] = {"": b""}

    def learn(words: list[str]) -> None:
        made, other = [], []
        for word in words:
            stem = word.rstrip(_SIGNS)
            if _plain(stem):
                made.append(word)
            else:
                other.append(word)
        encode_one(other)
        lower = [w.rstrip(_SIGNS).lower() for w in made]
        encode_stems(list(set(lower) - stems.keys()))
        for word, stem in zip(made, lower):
            tail = word[len(stem) :]
            if tail not in tails:
                tails[tail] = np.array(tokenizer.encode(tail, add_special_tokens=False).ids, wide).tobytes()
            known[word] = stems[stem] + tails[tail]

    def encode(texts: list[str] | pa.Array) -> list[np.ndarray]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        split = pc.ascii_split_whitespace(column.cast(pa.large_string()).fill_null(""))
        coded = split.flatten().dictionary_encode()
        words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        new = [w for w in words if w not in known]
        if len(known) + len(new) > remembered:
            known.clear()
            stems.clear()
            tails.clear()
            tails[""] = b""
            new = words
        learn(new)
        raw = [known[w] for w in words]
        ids = np.frombuffer(b"".join(raw), wide)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // wide.itemsize
        starts = np.cumsum(sizes) - sizes
        # every word's ids one after another: its place in ``ids`` less its place in the text, plus a count
        per = sizes[index]
        ends = np.cumsum(per)
        flat = ids[np.repeat(starts[index] - (ends - per), per) + np.arange(int(per.sum()))]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [flat[x:y] for x, y in zip(bounds[:-1], bounds[1:])]

    return encode


def _tokenize(encoder: Callable[[], Callable[[pa.Array], list[np.ndarray]]], end_id: int, carried: list[str], stretch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what an earlier task of this worker has left
        encode, part, before = encoder(), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text", stretch):
                ids = [np.append(x, np.array(end_id, x.dtype)) for x in encode(batch.column("text"))]
                counts = np.array([len(x) for x in ids], np.int64)
                starts = before + np.concatenate([[0], counts.cumsum()])[:-1]
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c) for c in carried],
                        pa.array(np.full(len(ids), part, np.int64)),
                        pa.array(starts),
                        pa.array(counts),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                    ],
                    names=[*carried, "__part", "__before", "doc_tokens", "__ids"],
                )

    return run


def _cut(window: int, carried: list[str], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, length, crc, sequence, offset, kept = [], [], [], [], [], [], []
            begins = batch.column("__offset").to_numpy()
            counts = batch.column("doc_tokens").to_numpy()
            for i, raw in enumerate(batch.column("__ids").to_pylist()):
                n, begin, at = int(counts[i]), int(begins[i]), 0
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                while at < n:
                    place = (begin + at) % window
                    take = min(window - place, n - at)
                    piece = ids[at : at + take]
                    row.append(i)
                    start.append(at)
                    length.append(take)
                    crc.append(zlib.crc32(piece.tobytes()))
                    sequence.append((begin + at) // window)
                    offset.append(place)
                    if with_ids:
                        kept.append(piece.astype(np.int32))
                    at += take
            chosen = pa.array(row, pa.int64())
            arrays = [batch.column(c).take(chosen) for c in carried]
            arrays += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            arrays += [batch.column("doc_tokens").take(chosen)]
            arrays += [pa.array(x, pa.int64()) for x in (sequence, offset)]
            names = [*carried, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            give_back()

    return run


def pack(
    docs: DataFrame,
    encoder: Callable[[], Callable[[pa.Array], list[np.ndarray]]],
    end_id: int,
    window: int = 2048,
    with_ids: bool = False,
    stretch: int = 1 << 23,
) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``encoder()`` is called once in each task and gives the function from texts to id arrays. ``stretch``
    is about the bytes of text that it gets at a time. ``end_id`` closes each document, so a null or
    empty text is one piece of length 1. A row is one document, also
    when its doc_id is null or repeated. Other columns are ignored. Offsets inside a sequence have no
    gaps; all sequences but the last are full. An empty table gives no pieces.
    """
    carried = ["doc_id"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = written(
        docs.select("doc_id", "text").mapInArrow(
            _tokenize(encoder, end_id, carried, stretch),
            f"doc_id {kind}, __part long, __before long, doc_tokens long, __ids binary",
        ),
        "tokens",
    )
    totals = tokens.groupBy("__part").agg(F.sum("doc_tokens").alias("n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(F.col("__part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    # one row for each partition of the input, which the driver's scheduler holds anyway
    placed = tokens.join(F.broadcast(offsets), "__part").withColumn("__offset", F.col("__base") + F.col("__before"))
    schema = (
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + ", ids array<int>" * with_ids
    )
    return placed.select("doc_id", "doc_tokens", "__offset", "__ids").mapInArrow(_cut(window, carried, with_ids), schema)
