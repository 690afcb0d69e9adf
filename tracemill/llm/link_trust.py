"""URL filters with link-graph propagation, in DataFrame functions.

Rules decide what they fit. For the rest, hosts with allowed pages are trusted seeds and hosts with blocked pages blocked
ones, each weighted by the share of its pages. Trust is spread along links between hosts, as in a personalised PageRank;
distrust against them, from a host to those that link to it. Both are sums over walks, W s + (d W)^2 s + ..., so a host
without links has just its share, at every size of the table. A host is blocked where its distrust reaches the threshold
and is above its trust.

A null url, or one without `://`, has an empty host and path; an empty host is no node of the graph and is judged `allow`.
Null or empty html has no links. Repeated pages count as often as they are there. Links within a host aren't edges. Rounds
end when no walk goes on, or when all longer walks together are below `rest` of the seeds' weight. Columns of the table
other than those that are named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import ascii_lower, few, written

#: Absolute links of anchors, with or without a scheme.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>\\]+)"""


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if there is none."""
    return ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (verdict, host/path) that fits, null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    # The last that is tried is the longest; equally long ones for one url are equal.
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at, below = rule.split("/", 1)
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{below}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts that are both there, with the number of links."""
    links = pages.where(F.col(html).contains("//") & (F.col(host) != "")).select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).alias("dst"))
    return links.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, along: str, to: str, damping: float, rest: float) -> DataFrame:
    """(host, level): seeds (host, weight) carried from `along` to `to`, by the links' share, over walks of all lengths."""
    out = edges.groupBy(F.col(along).alias("_a")).agg(F.sum("n").alias("_all"))
    shares = written(edges.join(out, edges[along] == out["_a"]).select(F.col(along).alias("host"), F.col(to).alias("to"), (F.col("n") / F.col("_all")).alias("part")), "host-links")
    walks = [seeds]
    left = 1.0
    linked = shares.limit(1).count() > 0
    while linked and left > rest:
        step = walks[-1].join(shares, "host").groupBy(F.col("to").alias("host")).agg((F.sum(F.col("weight") * F.col("part")) * damping).alias("weight"))
        walks.append(written(step, "walks"))
        left *= damping
        linked = walks[-1].limit(1).count() > 0
    all_ = walks[0]
    for w in walks[1:]:
        all_ = all_.unionByName(w)
    return all_.groupBy("host").agg(F.sum("weight").alias("level"))


def host_levels(pages: DataFrame, damping: float = 0.85, rest: float = 1e-6) -> DataFrame:
    """(host, trust, distrust) of all hosts that seeds reach. pages: host, html, verdict (of a rule, or null)."""
    share = lambda v: (F.count_if(F.col("verdict") == v) / F.count("*")).alias(v)
    hosts = written(pages.where("host <> ''").groupBy("host").agg(share("allow"), share("block")), "hosts")
    edges = written(host_edges(pages), "host-edges")
    seeds = lambda v: hosts.where(F.col(v) > 0).select("host", F.col(v).alias("weight"))
    trust = spread(seeds("allow"), edges, "src", "dst", damping, rest)
    distrust = spread(seeds("block"), edges, "dst", "src", damping, rest)
    level = lambda df, name: df.select("host", *[(F.col("level") if n == name else F.lit(0.0)).alias(n) for n in ("trust", "distrust")])
    return level(trust, "trust").unionByName(level(distrust, "distrust")).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = 0.5, damping: float = 0.85, rest: float = 1e-6) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust, of each page (page_id, url, html)."""
    x = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    x = x.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).withColumns({"rule": F.col("_r.rule"), "verdict": F.col("_r.verdict")}).drop("_r")
    levels = written(host_levels(x, damping, rest), "host-levels")
    judged = x.drop("html").join(few(levels), "host", "left").fillna(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
