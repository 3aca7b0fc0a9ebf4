"""Fill-in-middle transformation by repeated-capture matching.

One ``fullmatch`` of ``(unit)*`` with the regex library keeps every repetition of its group. The group's end
offsets are then all places where a text may be cut: their number is the number of units, and the offsets
after the first and the second cut are read at those positions. A pass over the rows, with no exchange; a
text's ends take about 50 bytes a unit while it is worked on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

CODE_POINT = "(?s:.)"
MARKERS = ("<P>", "<S>", "<M>")


def _transform(unit: str, markers: tuple[str, str, str], plain_percent: int, spm_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = regex.compile(f"({unit})*")
        prefix_mark, suffix_mark, middle_mark = markers
        for batch in batches:
            rows = []
            for text, draw in zip(batch.column("text").to_pylist(), batch.column("__draw").to_pylist()):
                found = units.fullmatch(text)
                if found is None:
                    rows.append((None, "plain", None, None, text))
                    continue
                ends = found.ends(1)
                n = len(ends)
                h1, h2, h3, h4 = (int(draw[i : i + 8], 16) for i in (0, 8, 16, 24))
                if not text or any(m in text for m in markers) or h3 % 100 >= 100 - plain_percent:
                    rows.append((n, "plain", None, None, text))
                    continue
                first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
                a, b = ends[first - 1] if first else 0, ends[second - 1] if second else 0
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                if h4 % 100 < spm_percent:
                    rows.append((n, "spm", a, b - a, "".join((suffix_mark, suffix, prefix_mark, prefix, middle_mark, middle))))
                else:
                    rows.append((n, "psm", a, b - a, "".join((prefix_mark, prefix, suffix_mark, suffix, middle_mark, middle))))
            n, form, prefix_chars, middle_chars, output = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(form, pa.string()),
                    pa.array(prefix_chars, pa.int64()),
                    pa.array(middle_chars, pa.int64()),
                    pa.array(output, pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def fill_in_middle(
    docs: DataFrame,
    unit: str = CODE_POINT,
    markers: tuple[str, str, str] = MARKERS,
    seed: int = 1,
    plain_percent: int = 10,
    spm_percent: int = 20,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``docs(doc_id, text)``.

    ``n`` units are cut at two places drawn from ``sha256(seed:doc_id)``, the offsets are code points. ``psm`` is
    prefix, suffix, middle, each behind its marker; ``spm`` has the suffix first; ``plain`` is the text as it is:
    for ``plain_percent`` of the rows, for empty and null texts, for texts that hold a marker, and for those that
    ``unit`` does not match from end to end (their n is null). Markers must not overlap one another when
    written side by side, as ``restored`` looks for the first of each.

    Rows of one doc_id are cut by the same draws; a null doc_id draws like an empty one. Ties and repeated rows
    are rows of their own, other columns are ignored, an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.sha2(named, 256).alias("__draw"))
    return rows.mapInArrow(
        _transform(unit, markers, plain_percent, spm_percent),
        f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string",
    )


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The original text, from the output and its form alone; null for a null output."""
    prefix_mark, suffix_mark, middle_mark = markers

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + len(second) + 1, F.length(body))
        two = F.substring_index(rest, middle_mark, 1)
        return one, two, F.substring(rest, F.length(two) + len(middle_mark) + 1, F.length(rest))

    prefix, suffix, middle = parts(prefix_mark, suffix_mark)
    spm_suffix, spm_prefix, spm_middle = parts(suffix_mark, prefix_mark)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(spm_prefix, spm_middle, spm_suffix))
        .otherwise(output)
    )
