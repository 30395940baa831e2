"""URL filters: rules first, then trust and distrust propagated over the links between hosts.

Trust starts at hosts whose ruled pages are mostly allowed and follows links; distrust starts at hosts whose ruled pages
are mostly blocked and follows links backwards, to the hosts that point at them. Both are personalised PageRanks over the
same host edges, run together as one distributed iteration.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanstrata.session import pin

DAMPING = 0.85
# Propagation ends once the ranks still to come are less than this share of the seeds.
TOLERANCE = 1e-7
PIN_EVERY = 8
# A host is blocked when its distrust exceeds this share of its trust.
THRESHOLD = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds `host` (A-Z lower-cased) and `path`; both are empty for a null url or one without `://`."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.substring_index(F.regexp_replace(text, r"(?s)^.*?://(.*)$", "$1"), "#", 1)).otherwise(F.lit(""))
    return pages.withColumns({"host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
                              "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null where none does; of equally long ones a block wins."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


# Links in quotes, up to what ends a host or the quote; links in running text, which also end at white space; plain names.
# Each pattern's last group is the host.
LINKS = [r"""["']\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<>]+)""", r"""(?:^|[\s=(:>])//([^/?#\s"'<>]+)""", r"([a-z0-9-]+(?:\.[a-z0-9-]+)+)"]


def host_edges(pages: DataFrame, hosts: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, w): pages of host src that name another judged host dst, in a link or in their text.

    A link's host is what the host of a url is: all up to `/`, `?`, `#` or its end, so ports, user parts, underscores,
    single labels and letters beyond ASCII count. Each page counts once per host it names. Names that are no host of
    the table cannot carry weight to one that is, so they are left out.
    """
    text = F.translate(F.coalesce(F.col(html).cast("string"), F.lit("")), UPPER, LOWER)
    named = F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) for pattern in LINKS]))
    pairs = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(named).alias("dst")).where("src <> dst")
    counted = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    return counted.join(hosts.select(F.col("host").alias("_host")), F.col("dst") == F.col("_host"), "left_semi")


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(kind, host, rank): personalised PageRank from `seeds` (kind, host, seed); edges are (kind, src, dst, p).

    Weight that reaches a host without outgoing edges is dropped, so ranks only compare within one run. Each step is a
    join on the source and a sum by target, folded per task first; the ranks are written every few steps. They only
    grow, so what their total gained since the last writing tells how much is still to come: the run ends when that is
    less than `tolerance` of the seeds.
    """
    base = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))
    rank, before = base, 0.0
    while True:
        for _ in range(PIN_EVERY):
            sent = edges.join(rank.select(F.col("kind").alias("_k"), F.col("host").alias("_h"), "rank"),
                              (F.col("kind") == F.col("_k")) & (F.col("src") == F.col("_h")))
            moved = sent.select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("p") * damping).alias("rank"))
            rank = moved.unionByName(base).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        rank = pin(rank)
        total = rank.agg(F.sum("rank")).first()[0] or 0.0
        # Every step brings at most `damping` of the one before.
        if (total - before) * damping ** PIN_EVERY / (1 - damping ** PIN_EVERY) <= tolerance:
            return rank
        before = total


def judge(pages: DataFrame, rules: list[Rule] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Every page with host, path, rule, verdict, and its host's trust and distrust.

    The longest fitting rule decides; otherwise a page is blocked when its host's distrust exceeds `threshold` times its
    trust. Hosts without evidence, the empty host among them, are allowed. Repeated pages are judged alike and all
    count as evidence; an empty table gives no rows.
    """
    parsed = with_host_and_path(pages.select("page_id", "url", "html"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": text, "_verdict": verdict})
    allow, block = F.count(F.when(F.col("_verdict") == "allow", 1)), F.count(F.when(F.col("_verdict") == "block", 1))
    hosts = pin(ruled.where("host <> ''").groupBy("host").agg(allow.alias("a"), block.alias("b")))
    total = hosts.agg(F.sum(F.abs(F.col("a") - F.col("b")))).first()[0] or 1
    lead = (F.col("a") - F.col("b")) / F.lit(float(total))
    seeds = pin(hosts.where("a <> b").select(F.when(lead > 0, "trust").otherwise("distrust").alias("kind"), "host", F.abs(lead).alias("seed")))
    found = pin(host_edges(ruled, hosts))
    share = lambda kind, a, b: found.join(
        found.groupBy(F.col(a).alias("_from")).agg(F.sum("w").alias("_all")), F.col(a) == F.col("_from")).select(
        F.lit(kind).alias("kind"), F.col(a).alias("src"), F.col(b).alias("dst"), (F.col("w") / F.col("_all")).alias("p"))
    edges = pin(share("trust", "src", "dst").unionByName(share("distrust", "dst", "src")))
    ranks = propagate(edges, seeds)
    scored = ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))).alias("trust"),
                                       F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("distrust"))
    side = scored.select(F.col("host").alias("_host"), "trust", "distrust")
    out = ruled.select("page_id", "host", "path", "rule", "_verdict").join(side, F.col("host") == F.col("_host"), "left")
    trust, distrust = F.coalesce(F.round("trust", 12), F.lit(0.0)), F.coalesce(F.round("distrust", 12), F.lit(0.0))
    judged = F.when(distrust > trust * threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", judged).alias("verdict"),
                      trust.alias("trust"), distrust.alias("distrust"))
