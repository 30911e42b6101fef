"""URL rules, and a verdict from link-graph propagation where no rule fits.

A rule is a host and a path prefix written together (``example.org/es/``); it fits its host and all
subdomains when the path starts with its path, and the longest fitting rule wins. Rules are a short
list given as a parameter. For the other pages two personalised PageRanks run over the host graph:
trust flows along links from hosts with allowed pages, distrust flows against links from hosts with
blocked pages (a host that links to blocked hosts inherits their distrust). Seeds are the shares of
a host's own pages that rules allow or block. Both run until no score changes by more than its
``SETTLED``-th part, however far the graph reaches. A host is blocked where distrust exceeds trust by
more than its ``TOLERANCE``-th part: scores shrink with the degrees on their way, so only their ratio counts.

Cases: a null url or one without ``://`` has an empty host and path; relative links, links to the
own host and links in null html add no edges; repeated pages count as often as they occur; ties
between trust and distrust allow; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import release, stored

RULES = [  # fixed values: rule, verdict
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
DAMPING = 0.85
SETTLED = 1e-9
TOLERANCE = 1e-9  # so that summation order cannot decide
ITERATIONS, DECIMALS = 20, 6  # of the SQL twin only, which cannot loop: enough for the given pages, which have no host links
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    found = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def host_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Links between different hosts: (src, dst, n)."""
    links = F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1)))
    return (
        pages.select(host_of(F.col(url)).alias("src"), links.alias("to"))
        .select("src", _lower(F.col("to")).alias("dst"))
        .where((F.col("src") != F.col("dst")) & (F.col("src") != ""))
        .groupBy("src", "dst").agg(F.count("*").alias("n"))
    )


def _flows(edges: DataFrame) -> DataFrame:
    """(kind, src, dst, w): trust along the links, distrust against them, weights from each source summing to one."""
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    total = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    return both.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, settled: float = SETTLED) -> DataFrame:
    """Personalised PageRank: ``seeds`` (kind, host, seed) to (kind, host, score), run until it has settled.

    Scores only grow from round to round. Where each grows by at most a share of itself, all later rounds
    do so too, and shrink by ``damping``: no score that is still to come is missed, not even a tiny one.
    """
    flows = stored(_flows(edges), "url-flows")
    start = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    table = state = stored(start, "url-rank")
    none = F.lit(0.0)
    while True:
        moved = (
            state.join(flows, (state["kind"] == flows["kind"]) & (state["host"] == flows["src"]))
            .select(state["kind"], F.col("dst").alias("host"), (damping * F.col("score") * F.col("w")).alias("score"), none.alias("was"))
        )
        kept = state.select("kind", "host", none.alias("score"), F.col("score").alias("was"))
        new = moved.unionByName(start.withColumn("was", none)).unionByName(kept)
        new = stored(new.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("was").alias("was")), "url-rank")
        moving = new.where(F.abs(F.col("score") - F.col("was")) > settled * F.col("score"))
        done = moving.isEmpty()
        release(table)
        table, state = new, new.drop("was")
        if done:
            return state


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, page_id: str = "page_id", url: str = "url",
          html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict and the host's trust and distrust, one row per page."""
    p = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    p = p.select("*", fitting_rule(F.col("host"), F.col("path"), rules).alias("fit"))
    share = lambda verdict: F.avg(F.coalesce((F.col("fit.verdict") == verdict).cast("double"), F.lit(0.0)))
    hosts = stored(p.where(F.col("host") != "").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "url-hosts")
    seeds = hosts.unpivot(["host"], ["trust", "distrust"], "kind", "seed").where(F.col("seed") > 0)
    scores = propagate(host_edges(pages, url, html), seeds).groupBy("host").agg(
        *(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")))
    scores = stored(scores, "url-scores").withColumnRenamed("host", "of_host")
    none = F.lit(0.0)
    verdict = F.when(F.coalesce(F.col("distrust"), none) > F.coalesce(F.col("trust"), none) * (1 + TOLERANCE), "block").otherwise("allow")
    return p.join(scores, F.col("host") == F.col("of_host"), "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), verdict).alias("verdict"),
        F.coalesce("trust", none).alias("trust"), F.coalesce("distrust", none).alias("distrust"))
