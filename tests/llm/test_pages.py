import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loreframe.llm import warc
from loreframe.llm.pii import PATTERNS, find_pii, redact, span_text
from loreframe.llm.queries import RULES, op10
from loreframe.llm.topk_hamming import sign_code, top_k
from loreframe.llm.url_filters import judge_urls, propagate
from loreframe.llm.warc import canonical_url, resolve_revisits
from tests.llm.helpers import ODD, documents, empty


@pytest.mark.parametrize("k", [1, 3, 7, 500])
def test_top_k_equals_all_distances(spark, k):
    rng = random.Random(k)
    base = [[rng.uniform(-1, 1) for _ in range(20)] for _ in range(5)]
    rows = [(i, [x + rng.choice([0, 0, 0.8]) * rng.uniform(-1, 1) for x in rng.choice(base)]) for i in range(60)]
    rows += [(100 + i, base[0]) for i in range(30)] + [(100, base[0]), (200, None), (None, base[1]), (201, []), (202, [None] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("code", F.lit(1))
    codes = df.select(F.col("vec_id").alias("id"), sign_code("embedding", 20).alias("code"), F.lit(0).alias("rank"))
    got = {}
    for r in top_k(codes, codes.where("id % 20 = 0").withColumnRenamed("id", "query_id"), k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["id"]))
    bits = {i: [v is not None and v > 0 for v in (e + [None] * 20)[:20]] for i, e in rows if i is not None and e is not None}
    want = {}
    for q in bits:
        if q % 20 == 0:
            near = sorted((sum(a != b for a, b in zip(bits[q], bits[i])), i) for i in bits)[:k]
            want[q] = [(n + 1, d, i) for n, (d, i) in enumerate(near)]
    assert {q: sorted(v) for q, v in got.items()} == want


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "id long, code array<int>")
    assert top_k(none, none.withColumnRenamed("id", "query_id"), 3).collect() == []


def records(spark, rows):
    return spark.createDataFrame(
        rows,
        "record_id long, kind string, uri string, at timestamp, status int, headers map<string,string>, digest string, url string",
    )


def test_latest_earlier_response(spark, monkeypatch):
    monkeypatch.setattr(warc, "SLICE", 40)
    rng = random.Random(8)
    start, rows = datetime(2024, 1, 1), []
    for i in range(600):
        uri = rng.choice(["http://a.b/x"] * 6 + ["https://A.b:443/x#f", "http://c.d/y?b=1&utm_source=q&a=2", "http://e.f", None])
        at = rng.choice([start + timedelta(minutes=rng.randrange(200)), None if rng.random() < 0.05 else start])
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        rows.append((i, kind, uri, at, rng.choice([200, 200, 404]), {"etag": "x"}, None, "clash"))
    df = records(spark, rows)
    assert df.where("kind in ('response','revisit')").count() // 40 > 3
    canon = {r["uri"]: r["c"] for r in df.select("uri", canonical_url(F.col("uri")).alias("c")).distinct().collect()}
    assert canon["https://A.b:443/x#f"] == "a.b/x" and canon["http://e.f"] == "e.f/" and canon["http://c.d/y?b=1&utm_source=q&a=2"] == "c.d/y?a=2&b=1"
    want = {}
    for i, kind, uri, at, *_ in rows:
        if kind == "revisit":
            earlier = [(a, j) for j, k, u, a, s, *_ in rows if k == "response" and s == 200 and uri and at and a and canon[u] == canon[uri] and a < at]
            want[i] = max(earlier)[1] if earlier else None
    got = resolve_revisits(df).collect()
    assert {r["record_id"]: r["response_id"] for r in got} == want and len(got) == len(want)
    assert all((r["state"] == "no_response") == (r["response_id"] is None) for r in got)


def test_validators_and_headers(spark):
    t = datetime(2024, 1, 1)
    old = {"etag": '"1"', "last-modified": "m", "content-type": "text/html", "expires": "0"}
    cases = {
        1: ({"etag": 'W/"1"', "expires": "9", "content-type": "x", "server": "s"}, None, "resolved"),
        2: ({"etag": '"2"', "last-modified": "m"}, None, "mismatch"),
        3: ({"last-modified": "m"}, None, "resolved"),
        4: ({"server": "s"}, None, "unverified"),
        5: (None, "d", "resolved"),
        6: (None, "e", "mismatch"),
    }
    rows = [(0, "response", "http://a.b/", t, 200, old, "d", "")]
    rows += [(i, "revisit", "http://a.b/", t + timedelta(hours=1), 304, h, d, "") for i, (h, d, _) in cases.items()]
    got = {r["record_id"]: r for r in resolve_revisits(records(spark, rows)).collect()}
    assert {i: r["state"] for i, r in got.items()} == {i: s for i, (_, _, s) in cases.items()}
    assert got[1]["headers"] == {"etag": 'W/"1"', "last-modified": "m", "content-type": "text/html", "expires": "9"}
    assert got[1]["digest"] == "d" and got[2]["headers"] == cases[2][0] and got[2]["digest"] is None
    assert resolve_revisits(records(spark, [])).collect() == []


URLS = [
    "http://x.com/a", "http://X.EXAMPLE.com/en/1?q", "http://www.example.com/en/", "https://a.www.example.com/en/x#y", "http://n.net/es/1",
    "http://n.net/fr/", "http://n.net/de/", "http://o.org", "http://notcom/x", "http://a.com", "nothing", "", None, "a://b://c/d", "http://com/x?y",
    "http://all.net/es/1", "http://all.net/de/1",
]


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls(spark):
    pages = [(i, u, f'<a href="/x">s</a><A class=b HREF=\'http://n.net/es/\'>') for i, u in enumerate(URLS)]
    pages += [(99, "http://all.net/es/2", None), (99, "http://all.net/es/2", None), (None, "http://z.org/", "<a>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in judge_urls(df, RULES).collect())
    want = Counter()
    for i, u, _ in pages:
        host, path, rule, _ = brute_rule(u)
        want[(i, host, path, rule)] += 1
    assert got == want
    for r in judge_urls(df, RULES).collect():
        verdict = brute_rule(dict((p[0], p[1]) for p in pages)[r["page_id"]])[3]
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert judge_urls(df.limit(0), RULES).collect() == []


def test_a_mostly_blocked_host_is_blocked(spark):
    rows = [(i, f"http://bad.net/es/{i}", "") for i in range(9)] + [(9, "http://bad.net/de/", ""), (10, "http://good.org/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdict = {r["page_id"]: r["verdict"] for r in judge_urls(df, RULES).collect()}
    assert verdict[9] == "block" and verdict[10] == "allow"


def linked(bad_links):
    """bad.net has nine blocked pages, eleven links to itself and one page without a rule; other.org links to it."""
    rows = [(i, f"http://bad.net/es/{i}", '<a href="/x">' * (1 if i else 3)) for i in range(9)]
    rows += [(9, "http://bad.net/de/", ""), (10, "http://other.org/", '<a href="http://bad.net/es/1">' * bad_links)]
    return rows + [(11, "http://other.org/2", '<a href="/own">' * 40), (12, "http://a.com/", '<a href="http://bad.net/de/">' * bad_links)]


@pytest.mark.parametrize("bad_links", [0, 1, 2, 11])
def test_links_to_a_blocked_host_do_not_clear_it(spark, bad_links):
    df = spark.createDataFrame(linked(bad_links), "page_id long, url string, html string")
    verdict = {r["page_id"]: r["verdict"] for r in judge_urls(df, RULES).collect()}
    assert verdict[9] == "block" and verdict[10] == verdict[11] == "allow"


def test_a_host_that_links_to_nothing_but_blocked_ones_is_blocked(spark):
    rows = [(i, f"http://{h}.net/es/{i}", "") for i, h in enumerate(["bad"] * 5 + ["worse"] * 5)]
    rows += [(20, "http://ring.org/", '<a href="http://bad.net/es/1"><a href="//worse.net">' * 30)]
    verdict = {r["page_id"]: r["verdict"] for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert verdict[20] == "block"


def dense_quotients(n, links, seeds, damping, rounds):
    """(trust, distrust) of hosts 0 to n - 1 by dense matrices, as quotients by full seeds."""
    import numpy as np

    m = np.eye(n)
    for (a, b), c in links.items():
        m[a, b] += c
    ahead, back = m / m.sum(1, keepdims=True), m.T / m.T.sum(1, keepdims=True)
    out = []
    for walk, seed in zip((ahead, back), seeds):
        score, most = seed, np.ones(n)
        for _ in range(rounds):
            score, most = (1 - damping) * seed + damping * score @ walk, (1 - damping) + damping * most @ walk
        out.append(score / most)
    return out


def test_propagation_equals_dense_matrices(spark):
    import numpy as np

    rng = random.Random(9)
    n, links = 12, {}
    for _ in range(40):
        links[(rng.randrange(n), rng.randrange(n))] = rng.randint(1, 5)
    seeds = [(f"h{i}", rng.random(), rng.random()) for i in range(8)]
    got = propagate(
        spark.createDataFrame(seeds, "host string, trust double, distrust double"),
        spark.createDataFrame([(f"h{a}", f"h{b}", c) for (a, b), c in links.items()], "src string, dst string, n long"),
        0.8,
        9,
    ).collect()
    start = np.zeros((2, n))
    for i, (_, t, d) in enumerate(seeds):
        start[:, i] = t, d
    t, d = dense_quotients(n, links, start, 0.8, 9)
    for r in got:
        i = int(r["host"][1:])
        assert (r["trust"], r["distrust"]) == pytest.approx((t[i], d[i]))


def test_verdicts_equal_dense_matrices(spark):
    """Pages of random hosts with links between them; rules fit some pages of some hosts."""
    import numpy as np

    rng, rows, links = random.Random(20), [], Counter()
    hosts = [f"h{i}.{rng.choice(['net', 'com', 'org', 'net'])}" for i in range(14)]
    for i in range(160):
        a = rng.randrange(14)
        path, to = rng.choice(["/es/", "/fr/", "/es/", "/"]), [rng.randrange(14) for _ in range(rng.randrange(4))]
        links.update((a, b) for b in to)
        rows.append((i, f"http://{hosts[a]}{path}{i}", "".join(f'<a href="http://{hosts[b]}/q">' for b in to)))
    verdicts = {i: brute_rule(u)[3] for i, u, _ in rows}
    at = {i: hosts.index(u.split("/")[2]) for i, u, _ in rows}
    seeds = np.zeros((2, 14))
    for h in range(14):
        own = [verdicts[i] for i in at if at[i] == h]
        seeds[:, h] = [own.count(v) / max(1, len(own)) for v in ("allow", "block")]
    t, d = dense_quotients(14, links, seeds, 0.85, 12)
    want = {i: verdicts[i] or ("block" if d[at[i]] > max(0.5, t[at[i]]) else "allow") for i in at}
    got = {r["page_id"]: r["verdict"] for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert got == want and {want[i] for i in at if verdicts[i] is None} == {"allow", "block"}


# The plain base patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 8 <= len(digits) <= 15)
            ):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PERSONAL = [
    "write to a.b+c@ex-ample.co.uk. or x@y.z, é🙂 q@w.e._r@t.yy",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559",
    "+49 (30) 1234-5678 +1.2 ++44 20 7946 0958)",
    "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 000255.1.1.001",
    "iban DE89 3704 0044 0532 0130 00 and DE89370400440532013001 GB82WEST12345698765432",
    "my ssn 123-45-6789, and a good many words between the two; the order 123-45-6788 " + "and " * 12 + "ssn 000-11-2222",
    "1" * 4000, "1 " * 3000, "a@" + "b." * 3000 + "c", "a" * 60000, "+1" + " " * 5000 + "2", "a@b." * 50, "1." * 3000,
]


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(10)
    signs = list("aab@@..--  ++0123456789()%_é🙂") + ["4111111111111111", "a@b.c", "1.2.3.4", "+1 234 567 89"]
    texts = ODD + PERSONAL + ["".join(rng.choice(signs) for _ in range(rng.choice([5, 30, 200]))) for _ in range(400)]
    texts.append(" ".join(f"u{i}@h{i}.org" for i in range(700)))
    docs = documents(spark, texts)
    rows = docs.select("doc_id", "text").join(op10(docs).drop("text"), "doc_id").distinct().collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_spans(r["text"])
        shown = [s for s in r["spans"].split(",") if s.split(":")[0] in PLAIN]
        assert shown == base
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k + ":") for s in base) for k in PLAIN]
    assert find_pii(empty(spark)).collect() == []


def test_added_spans_need_checksum_and_context(spark):
    docs = documents(spark, PERSONAL)
    got = {r["text"]: r["s"] for r in find_pii(docs).select("text", span_text(F.col("spans")).alias("s")).collect()}
    assert [s for s in got[PERSONAL[4]].split(",") if s.startswith("iban")] == ["iban:5:32", "iban:60:82"]
    assert "ssn:7:18" in got[PERSONAL[5]] and got[PERSONAL[5]].count("ssn") == 1


ACCOUNTS = {  # text -> account numbers in it
    "DE89 3704 0044 0532 0130 00 Bitte zahlen": ["DE89 3704 0044 0532 0130 00"],
    "IBAN DE89370400440532013000 BIC COBADEFFXXX": ["DE89370400440532013000"],
    "DE89370400440532013000 A": ["DE89370400440532013000"],
    "DE89 3704 0044 0532 0130 00 12 EUR": ["DE89 3704 0044 0532 0130 00"],
    "DE89 3704 0044 0532 0130 00 2024 0815 4711 0001 0002": ["DE89 3704 0044 0532 0130 00"],
    "é🙂 GB82 WEST 1234 5698 7654 32 DE89 3704 0044 0532 0130 00 NO9386011117947": [
        "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "NO9386011117947",
    ],
    "DE12 3456 GB82WEST12345698765432 X": ["GB82WEST12345698765432"],
    "MT84MALT011000012345MTLCAST001S": ["MT84MALT011000012345MTLCAST001S"],
    "DE89370400440532013000a DE89370400440532013000AB xDE89370400440532013000 DE88 3704 0044 0532 0130 00": [],
    "AB12 " * 2000 + "DE89 3704 0044 0532 0130 00": ["DE89 3704 0044 0532 0130 00"],
}


def test_account_numbers_before_capitals_and_digits(spark):
    docs = spark.createDataFrame(list(enumerate(ACCOUNTS)), "doc_id long, text string")
    for r in find_pii(docs).collect():
        found = [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "iban"]
        assert [r["text"][a:b] for a, b in found] == ACCOUNTS[r["text"]]
    for r in redact(docs).collect():
        assert not any(a in r["text"] for a in list(ACCOUNTS.values())[r["doc_id"]])


def test_redaction(spark):
    docs = documents(spark, PERSONAL + ODD)
    rows = redact(docs).select("doc_id", "text", "node").collect()
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        old = before[r["doc_id"]]
        assert brute_spans(r["text"]) == [] or old is None
        if not find_pii(docs.where(docs.doc_id.eqNullSafe(r["doc_id"]))).first()["spans"]:
            assert r["text"] == old
    assert "write to [EMAIL]. or [EMAIL], é🙂 [EMAIL][EMAIL]" in {r["text"] for r in rows}
