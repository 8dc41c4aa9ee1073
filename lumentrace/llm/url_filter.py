"""URL filter: explicit rules first, then trust and distrust propagated over the host link graph.

A rule names a host suffix and a path prefix; the longest fitting rule decides. Urls without a rule get the
verdict of their host: hosts most of whose pages a rule blocks (allows) are blocked (trusted) seeds; trust
flows from trusted seeds along links as in a personalised PageRank, distrust flows backwards from blocked
seeds to the hosts that link to them; a host is blocked if distrust exceeds trust by ``threshold``.

Links are read from the pages' markup and reduced to one weighted edge per pair of hosts before anything is
joined, with partial sums before the shuffle, so a host with a third of all pages costs no more per edge than
any other. Every round is one join of scores with edges and one sum per host. All native columns.

Defined results: a null url or one without ``://`` has an empty host and path and no rule; null markup has no
links; repeated pages count as often as they occur; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of an absolute link in an attribute.
LINK = r"""(?i)(?:href|src)[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?(?:https?:)?//([^/?#"'<>\x20\x09-\x0D]+)"""


@dataclass(frozen=True)
class Propagation:
    damping: float = 0.85
    rounds: int = 10
    #: Share of a host's pages that a rule must block (allow) to make it a seed.
    seed_share: float = 0.5
    #: Distrust less trust from which on a host is blocked.
    threshold: float = 0.5


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    host, path = host_path(F.col(url_col))
    df = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
    return df.select("*", rule.alias("rule"), says.alias("says"))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per pair of different hosts: ``src``, ``dst``, and ``w``, the share of src's links that go there."""
    links = pages.select(
        host_path(F.col(url_col))[0].alias("src"),
        F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("dst"),
    ).select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    counted = links.filter((F.col("src") != F.col("dst")) & (F.col("src") != "")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    out = counted.groupBy(F.col("src").alias("_lt_src")).agg(F.sum("n").alias("total"))
    return counted.join(out, F.col("src") == F.col("_lt_src")).select("src", "dst", (F.col("n") / F.col("total")).alias("w"))


def host_scores(seeds: DataFrame, edges: DataFrame, how: Propagation) -> DataFrame:
    """``seeds``: host, trust, distrust. Adds what links bring, round by round."""
    flows = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w", F.lit(True).alias("forward")).unionByName(
        edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "w", F.lit(False).alias("forward"))
    )
    scores = seeds
    for k in range(how.rounds):
        part = flows.join(scores, F.col("a") == F.col("host")).select(
            F.col("b").alias("host"),
            F.when(F.col("forward"), F.col("w") * F.col("trust") * how.damping).otherwise(0.0).alias("trust"),
            F.when(F.col("forward"), 0.0).otherwise(F.col("w") * F.col("distrust") * how.damping).alias("distrust"),
        )
        scores = seeds.unionByName(part).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if k % 4 == 3:
            scores = materialise(scores, "host-scores")
    return scores


def filter_urls(pages: DataFrame, rules=RULES, how: Propagation | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Id, host, path, rule, verdict, and the host's trust and distrust."""
    how = how or Propagation()
    urls = judged(pages, rules, id_col, url_col)
    share = lambda says: F.avg(F.when(F.col("says") == says, 1.0).otherwise(0.0))
    hosts = urls.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    seed = lambda c: F.when(F.col(c) >= how.seed_share, F.col(c)).otherwise(0.0)
    seeds = materialise(hosts.select("host", seed("allowed").alias("trust"), seed("blocked").alias("distrust")), "host-seeds")
    edges = materialise(host_edges(pages, url_col, html_col), "host-edges")
    scores = seeds if edges.isEmpty() else host_scores(seeds, edges, how)
    ruled = scores.select(F.col("host").alias("_lt_host"), *[F.round(c, 9).alias(c) for c in ("trust", "distrust")])
    # The join's other side has a row per host; the hot host's urls are split by adaptive execution.
    out = urls.join(ruled, F.col("host") == F.col("_lt_host"), "left")
    method = F.when(F.col("distrust") - F.col("trust") >= how.threshold, "block").otherwise("allow")
    return out.select(id_col, "host", "path", "rule", F.coalesce("says", method).alias("verdict"), "trust", "distrust")
