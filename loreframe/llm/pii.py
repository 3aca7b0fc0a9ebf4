"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Only SQL functions. A pattern's matches and the pieces between them (the same leftmost matches, by a
split) give all positions as one running sum of their lengths. Quantifiers that cannot gain by giving
characters back are possessive, and a mail address starts only where a run of its characters does, so
matching takes time in proportion to the text. An account number's pattern looks ahead and takes only the
first four signs; of the run behind them the longest part that ends with a group and passes the checksum counts.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = KINDS[:4]

# The patterns of the kinds. Possessive forms of the plain ones.
PATTERNS = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?+[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
    "iban": "(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:[\\x20]?+[A-Z0-9]){11,30}+[A-Za-z0-9]?+))[A-Z]{2}[0-9]{2}",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# A text without this cannot match.
NEEDS = {"email": "@", "ip": "\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]-[0-9]"}
# Score of a confirmed match, and words near it that raise or lower the score.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
RAISE = {
    "email": "mail|contact|write",
    "ip": "address|host|server|login",
    "card": "card|visa|credit|pay|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|anruf",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|tax",
}
LOWER = "version|release|example|order|invoice|isbn|serial"
NEAR = 40  # characters on each side that are looked at
THRESHOLD = 0.5  # added kinds need this score; the four base kinds stay whatever their score


def running_sums(values: Column, step: int = 128) -> Column:
    """Running sums of an int array, by blocks, so that no long array is copied once per element."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / step).cast("int")), lambda b: F.slice(values, b * step + 1, step)
    )
    grow = lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))
    zero = F.array(F.lit(0))
    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v))
    starts = F.slice(F.aggregate(totals, zero, grow), 1, F.size(blocks))
    sums = F.zip_with(blocks, starts, lambda x, o: F.slice(F.aggregate(x, F.array(o), grow), 2, step))
    return F.when(F.size(values) > 0, F.flatten(sums)).otherwise(F.array().cast("array<int>"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    marks = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2).otherwise(c.cast("int")),
    )
    return F.aggregate(marks, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number leaves 1 by 97, letters as 10 to 35, its first four signs at the end."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    signs = F.filter(F.split(turned, ""), lambda c: c != "")
    rest = F.aggregate(
        signs,
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def _confirmed(kind: str, raw: Column) -> Column:
    digits = F.regexp_replace(raw, "[^0-9]", "")
    if kind == "ip":
        return raw.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(\\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        plain = F.regexp_replace(raw, " ", "")
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(F.lit(False))
    if kind == "ssn":
        return ~raw.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _account(run: Column) -> Column:
    """The longest part of a run that ends with one of its groups and is an account number, or null."""
    groups = F.split(run, " ")
    parts = F.transform(F.sequence(F.size(groups), F.lit(1)), lambda n: F.array_join(F.slice(groups, 1, n), " "))
    return F.get(F.filter(parts, lambda p: p.rlike("^[A-Z0-9 ]+$") & _confirmed("iban", p)), 0)


def _accounts(found: Column) -> Column:
    """Account numbers of struct(raw, end), where raw is a run and end that of its first four signs; none overlap."""
    ends = F.transform(
        F.transform(found, lambda x: F.struct(_account(x["raw"]).alias("raw"), (x["end"] - 4).alias("start"))),
        lambda x: F.struct(x["raw"].alias("raw"), (x["start"] + F.length(x["raw"])).cast("int").alias("end")),
    )
    return F.aggregate(
        F.filter(ends, lambda x: x["raw"].isNotNull()),
        F.array().cast("array<struct<raw:string,end:int>>"),
        lambda acc, x: F.when(
            x["end"] - F.length(x["raw"]) < F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0)), acc
        ).otherwise(F.concat(acc, F.array(x))),
    )


def _score(kind: str, around: Column) -> Column:
    near = F.lower(around)
    return (
        F.lit(SCORES[kind])
        + F.when(near.rlike(f"\\b(?:{RAISE[kind]})"), 0.2).otherwise(0.0)
        - F.when(near.rlike(f"\\b(?:{LOWER})\\b"), 0.2).otherwise(0.0)
    )


def _is_confirmed(kind: str, x: Column) -> Column:
    return _confirmed(kind, x["raw"])


def _span(kind: str, x: Column) -> Column:
    """The scored span of a match in the column ``__t``."""
    start = x["end"] - F.length(x["raw"])
    before = F.substr("__t", F.greatest(F.lit(1), start - NEAR + 1), F.least(F.lit(NEAR), start))
    around = F.concat(before, F.lit(" "), F.substr("__t", x["end"] + 1, F.lit(NEAR)))
    return F.struct(
        F.lit(kind).alias("kind"), start.alias("start"), x["end"].alias("end"), _score(kind, around).alias("score")
    )


def find_pii(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with the array ``spans`` of struct(kind, start, end, score) of its text, by kind and start.

    Positions are code points, the end exclusive. A null or empty text has none. Spans of different kinds
    may overlap. Every row is looked at by itself; other columns stay, one named ``spans`` is replaced.
    """
    names = [c for c in docs.columns if c != spans]
    out = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    for kind in KINDS:
        pattern = F.lit(PATTERNS[kind])
        can = F.col("__t").rlike(NEEDS[kind])
        group = 1 if kind == "iban" else 0
        out = out.withColumn(f"__{kind}_raw", F.when(can, F.regexp_extract_all("__t", pattern, group)).otherwise(F.array().cast("array<string>")))
    for kind in KINDS:
        raw = F.col(f"__{kind}_raw")
        any_match = F.size(raw) > 0
        out = out.withColumn(
            f"__{kind}_gap", F.when(any_match, F.split("__t", PATTERNS[kind], -1)).otherwise(F.array().cast("array<string>"))
        )
    for kind in KINDS:
        raw, gap = F.col(f"__{kind}_raw"), F.col(f"__{kind}_gap")
        taken = (lambda r: F.lit(4)) if kind == "iban" else F.length
        sizes = F.zip_with(F.slice(gap, 1, F.size(raw)), raw, partial(lambda size, g, r: F.length(g) + size(r), taken))
        out = out.withColumn(f"__{kind}_end", F.when(F.size(raw) > 0, running_sums(sizes)).otherwise(F.array().cast("array<int>")))
    for kind in KINDS:
        raw, end = F.col(f"__{kind}_raw"), F.col(f"__{kind}_end")
        found = F.zip_with(raw, end, lambda r, e: F.struct(r.alias("raw"), e.alias("end")))
        found = _accounts(found) if kind == "iban" else F.filter(found, partial(_is_confirmed, kind))
        scored = F.transform(found, partial(_span, kind))
        if kind not in BASE:
            scored = F.filter(scored, lambda x: x["score"] >= THRESHOLD)
        out = out.withColumn(f"__{kind}_hit", scored)
    hits = F.concat(*[F.col(f"__{k}_hit") for k in KINDS])
    return out.select(*[F.col(f"`{c}`") for c in names], hits.alias(spans))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind in brackets.

    Overlapping spans become one, named after the first. A null text stays null.
    """
    found = find_pii(docs, text, "__spans")
    ordered = F.array_sort(F.transform("__spans", lambda x: F.struct(x["start"], x["end"], x["kind"])))
    merged = F.aggregate(
        ordered,
        F.array().cast("array<struct<start:int,end:int,kind:string>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] < F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"),
                        F.element_at(acc, -1)["kind"].alias("kind"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))),
    )
    found = found.withColumn("__merged", F.when(F.size("__spans") > 0, merged))
    parts = F.transform(
        "__merged",
        lambda x, i: F.concat(
            F.substr(
                text,
                F.coalesce(F.get("__merged", i - 1)["end"], F.lit(0)) + 1,
                x["start"] - F.coalesce(F.get("__merged", i - 1)["end"], F.lit(0)),
            ),
            F.lit("["),
            F.upper(x["kind"]),
            F.lit("]"),
        ),
    )
    clean = F.concat(F.array_join(parts, ""), F.substr(text, F.element_at("__merged", -1)["end"] + 1))
    value = F.when(F.size("__spans") > 0, clean).otherwise(F.col(text))
    return found.withColumn(text, value).drop("__spans", "__merged")
