"""URL filter: rules decide where one fits, propagation over the link graph decides the rest.

Trust is a personalised PageRank from hosts with allowed pages along links, distrust one from hosts with
blocked pages against them (who links to a blocked host is suspect). A host's seeds are the shares of its
pages that rules allow and block; every host also keeps a part of its own score.

How much of either reaches a host grows with its links, so both are divided by what would reach it if all hosts
were full seeds. The quotients, from 0 to 1, are averages of seeds: ``trust`` over the hosts from which walks
arrive, ``distrust`` over those to which they lead, the host itself included. A host's threshold is its own trust,
``least`` at the lowest: it is blocked if its distrust is above that. A blocked host does not become better by
being linked to, and a host is not blocked for a few of many links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loreframe.session import cut_lineage, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = "<[aA][ \\t\\r\\n][^>]*?[hH][rR][eE][fF][ ]*=[ ]*[\"']?([^\"' >]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as struct(rule, verdict), or null."""
    chosen = F.lit(None)
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        named = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, named).otherwise(chosen)
    return chosen


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between hosts of ``pages(url, html)``; a relative link stays on its host."""
    found = pages.select(
        host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)).alias("to")
    )
    target = (
        F.when(F.col("to").startswith("//"), host_of(F.concat(F.lit("x:"), F.col("to"))))
        .when(F.col("to").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), host_of(F.col("to")))
        .otherwise(F.col("src"))
    )
    return found.select("src", target.alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float, rounds: int, every: int = 4) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` steps from ``seeds(host, trust, distrust)``, seeds from 0 to 1.

    A walk goes along the links by their number; one more link from each host to itself keeps it going.
    """
    hosts = seeds.select("host").union(links.select("src")).union(links.select("dst")).distinct()
    start = hosts.join(seeds, "host", "left").fillna(0.0, ["trust", "distrust"])
    start = written(start.select("host", "trust", "distrust", F.lit(1.0).alias("trust_most"), F.lit(1.0).alias("distrust_most")), "seeds")
    loops = start.select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(1).cast("long").alias("n"))
    counted = links.union(loops).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    counted = written(counted, "links")
    out = counted.groupBy("src").agg(F.sum("n").alias("total"))
    into = counted.groupBy("dst").agg(F.sum("n").alias("total"))
    ahead = counted.join(out, "src").select(
        F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("total")).alias("a"), F.lit(0.0).alias("b")
    )
    back = counted.join(into, "dst").select("dst", "src", F.lit(0.0), F.col("n") / F.col("total"))
    steps = written(ahead.union(back).groupBy("host", "to").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "steps")
    weights = {"trust": "a", "distrust": "b", "trust_most": "a", "distrust_most": "b"}
    score = start
    for i in range(rounds):
        sent = score.join(steps, "host").groupBy("to").agg(*[F.sum(F.col(c) * F.col(w)).alias(f"sent_{c}") for c, w in weights.items()])
        own = [((1 - damping) * F.col(c) + damping * F.coalesce(f"sent_{c}", F.lit(0.0))).alias(c) for c in weights]
        first = start.join(sent.withColumnRenamed("to", "host"), "host", "left")
        score = first.select("host", *own)
        if (i + 1) % every == 0:
            score = cut_lineage(score)
    return score.select("host", *[(F.col(c) / F.col(f"{c}_most")).alias(c) for c in ("trust", "distrust")])


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    damping: float = 0.85,
    rounds: int = 12,
    least: float = 0.5,
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages(page_id, url, html)``.

    A null URL or one without ``://`` has empty host and path; such pages are one host of that name. A null
    html has no links. Rows are judged each for itself, also repeated ones and those with a null page_id.
    Other columns are ignored.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = named.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("ruled")
    )
    seeds = ruled.groupBy("host").agg(
        F.avg(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("trust"),
        F.avg(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("distrust"),
    )
    scores = propagate(seeds, host_links(pages), damping, rounds)
    # sums of doubles come in any order, so the last digits do not decide
    distrust, threshold = F.round("distrust", 9), F.greatest(F.lit(least), F.round("trust", 9))
    by_host = scores.select("host", F.when(distrust > threshold, "block").otherwise("allow").alias("spread"))
    return ruled.join(by_host, "host").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "spread").alias("verdict")
    )
