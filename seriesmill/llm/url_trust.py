"""URL filters: host rules, and link-graph propagation for what no rule judges.

Trust starts at hosts with pages that a rule allows and follows links; distrust starts
at hosts with pages that a rule blocks and follows links backwards, to whoever links
there. Both are personalised PageRank over host edges, computed with DataFrame
operations alone; a host whose distrust is high enough and above its trust is blocked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The target of a link, in double, single or no quotes, the name in any case.
LINK = r"""(?i:href)\s*=\s*["']?([^"'>\s]*)"""


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the production query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name).otherwise(name)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts, from the links in ``html``. Relative
    links stay on their host and make no edge. Counts are summed before the shuffle."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("to"))
    absolute = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))
    links = links.withColumn("dst", host_of(absolute)).where("dst <> '' and dst <> src")
    return links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


#: Rounds of propagation in one plan; between two plans the state is a stored table.
STRIDE = 4


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(kind, host, score): personalised PageRank of each kind at once, from ``seeds``
    (kind, host, seed) over ``edges`` (kind, src, dst, share), whose shares add up to 1 for
    each kind and src.

    A round moves what the last one brought: flow = damping * inflow, starting with
    (1 - damping) * seed, and a score is the sum of a host's flows. What flows in a round
    is at most ``damping`` times that of the round before, so after
    log(tolerance) / log(damping) rounds, 86 by default, less than ``tolerance`` of the
    seeds' mass is still to come; rounds stop before that if no flow is above a thousandth
    of ``tolerance``. What ends in hosts without out-edges returns to the seeds: the
    limit of that is the same scores, scaled to have the seeds' sum.
    """
    seeds = stored(seeds.where("seed > 0").select("kind", "host", "seed"), "trust-seeds")
    state = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"), (F.col("seed") * (1 - damping)).alias("flow"))
    rounds = max(1, math.ceil(math.log(tolerance) / math.log(damping)))
    for at in range(0, rounds, STRIDE):
        for _ in range(min(STRIDE, rounds - at)):
            sent = state.where("flow > 0").select("kind", F.col("host").alias("src"), "flow").join(edges, ["kind", "src"])
            inflow = sent.select("kind", F.col("dst").alias("host"), F.lit(0.0).alias("score"), (F.col("flow") * F.col("share") * damping).alias("flow"))
            both = state.select("kind", "host", "score", F.lit(0.0).alias("flow")).union(inflow)
            state = both.groupBy("kind", "host").agg((F.sum("score") + F.sum("flow")).alias("score"), F.sum("flow").alias("flow"))
        state = stored(state, "trust-rounds")
        if state.where(F.col("flow") > tolerance / 1000).isEmpty():
            break
    sums = state.groupBy("kind").agg(F.sum("score").alias("held")).join(seeds.groupBy("kind").agg(F.sum("seed").alias("given")), "kind")  # a row a kind
    return state.join(sums, "kind").select("kind", "host", (F.col("score") * F.col("given") / F.col("held")).alias("score"), (F.col("given") / F.col("held")).alias("scale"))


def judge_urls(pages: DataFrame, rules=RULES, damping: float = 0.85, threshold: float = 0.5, tolerance: float = 1e-6) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    A page that a rule fits has the rule's verdict. Another is blocked if its host's
    distrust is at least ``threshold`` times what a host of blocked pages alone has of its
    own, and above its trust. Null urls and urls without ``://`` have an empty host
    and path, which no link reaches: allowed. Null html has no links. Repeated rows
    count as pages of their own.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.withColumns({"rule": name, "ruled": verdict})
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    hosts = stored(judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "hosts")
    seeds = hosts.unpivot("host", ["trust", "distrust"], "kind", "seed")
    links = stored(host_edges(pages), "host-edges")
    forward = links.select(F.lit("trust").alias("kind"), "src", "dst", "weight")
    back = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    both = forward.union(back)
    total = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    edges = stored(both.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")), "links")
    scores = stored(propagate(seeds, edges, damping, tolerance), "trust")
    distrust = scores.where("kind = 'distrust'").select("host", F.col("score").alias("distrust"), "scale")
    trust = scores.where("kind = 'trust'").select("host", F.col("score").alias("trust"))
    enough = F.col("distrust") >= threshold * (1 - damping) * F.col("scale") - 1e-12
    bad = distrust.join(trust, "host", "left").where(enough & (F.col("distrust") > F.coalesce("trust", F.lit(0.0)))).select("host", F.lit("block").alias("spread"))
    return judged.select("page_id", "host", "path", "rule", "ruled").join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict"))
