"""URL filters: rules by host and path, and trust propagated over the links between hosts.

*Rules* fit a host and its subdomains if the path starts with the rule's; the
longest wins.  For urls without a rule the host decides.  A host is a trusted
seed by the share of its pages that rules allow, a blocked seed by the share
that rules block.  Personalised PageRank carries trust from hosts to those they
link to; reversed, it carries distrust from hosts to those that link to them.
Both are held against the rank of a walk from all hosts, whose start is 1 where
rules judge pages and ``PRIOR`` where none does:

    t = (1 - d) * seed  + d * (t of each host that links here, shared by its links)
    r = (1 - d) * start + d * (r of each host that links here, shared by its links)
    trust = t / r, and distrust the same on the reversed links from blocked seeds

so a score is the share of a host's rank that comes from seeds: 0 to 1, whatever
the number of its links or the size of the corpus; without links it is the share
of its pages.  Unruled urls are blocked if
their host's distrust is ``least`` or more and above its trust.  Host edges are
the links of pages to other hosts, and an edge of weight 1 in each direction
between a host and the host it is a direct subdomain of, if pages have both.

Rounds go on until no score can be off by ``close``: a round shrinks the error by
``damping``, so they are bounded by the logarithm of ``close``.

Built-in functions only.  Edges are summed by host pair before any shuffle; the
scores stay in tables and those of every few rounds are written, so nothing grows
with lost executors or rounds.  Sums by host are partial first; the edges of a
host with very many of them are a skewed side of a plain join, which adaptive
execution splits.  Null urls, and those without ``://``, have empty
host and path, which no rule fits and no link reaches.  Null html has no links;
links of a host to itself don't count; very long html is searched whole.  Repeated
rows are judged each and count each as pages; ties between rules of equal length
go to ``block``.  An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.scratch import Scratch
from gridwright.llm.skew import join_counted

DAMPING = 0.85
CLOSE = 0.01
ROUNDS = 4
"""Rounds between two written tables."""
PRIOR = 0.1
"""What a host without judged pages starts with: the less, the further scores reach along links."""
LEAST = 0.5
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with its subdomains, and a path prefix."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]

    def fits(self) -> F.Column:
        host = (F.col("host") == self.host) | F.col("host").endswith("." + self.host)
        return host & F.col("path").startswith(self.path)


RULES = (Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"), Rule("block", "net/fr/"))


def lower_ascii(c: F.Column) -> F.Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def with_host(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``; empty if there is no ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    return pages.select("*", lower_ascii(F.regexp_extract(url, URL, 1)).alias("host"), F.regexp_extract(url, URL, 2).alias("path"))


def with_rule(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``rule`` and ``ruled``, pattern and verdict of the longest rule that fits (else null)."""
    rule = ruled = None
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.verdict == "block", r.pattern), reverse=True):
        rule = F.when(r.fits(), r.pattern) if rule is None else rule.when(r.fits(), r.pattern)
        ruled = F.when(r.fits(), r.verdict) if ruled is None else ruled.when(r.fits(), r.verdict)
    none = F.lit(None).cast("string")
    return pages.select("*", (none if rule is None else rule).alias("rule"), (none if ruled is None else ruled).alias("ruled"))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst, w``: links from pages of one host to another, and those between hosts and their direct subdomains."""
    rows = with_host(pages.select(url_col, html_col), url_col).where("host <> ''")
    links = rows.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(html_col, F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", lower_ascii("dst").alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    hosts = rows.select("host").distinct()
    above = hosts.select("host", F.regexp_replace("host", r"^[^.]*\.", "").alias("over")).where("instr(over, '.') > 0 and over <> host")
    pairs = above.join(hosts.select(F.col("host").alias("over")), "over")
    own = pairs.select(F.col("host").alias("src"), F.col("over").alias("dst"), F.lit(1.0).alias("w"))
    return links.unionByName(own).unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(seeds: DataFrame, edges: DataFrame, scratch: Scratch, *, damping: float = DAMPING, close: float = CLOSE) -> DataFrame:
    """``host, trust, distrust`` from ``seeds(host, good, bad)``; hosts that only links name are included."""
    edges = scratch.cut(edges)
    zero = F.lit(0.0)
    out, into = (edges.groupBy(F.col(x).alias("host")).agg(F.sum("w").alias(f"{x}_w")) for x in ("src", "dst"))
    base = out.join(into, "host", "full").join(seeds, "host", "full").select("host", F.coalesce("good", zero).alias("good"), F.coalesce("bad", zero).alias("bad"), "src_w", "dst_w")
    base = scratch.cut(base.withColumn("start", F.when(F.col("good") + F.col("bad") > 0, 1.0).otherwise(PRIOR)))
    now = base.select("*", F.col("good").alias("t"), F.col("start").alias("r"), F.col("bad").alias("d"), F.col("start").alias("q"))
    if not edges.limit(1).count():
        return now.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    start = {"t": F.col("good"), "r": F.col("start"), "d": F.col("bad"), "q": F.col("start")}
    scores = [F.col(x) for x in ("host", *start)]
    now = scratch.cut(now)
    # what a round moves shrinks by the damping: after these the rest is below `close` of any score
    for _ in range(math.ceil(math.log(close) / math.log(damping) / ROUNDS)):
        then = now
        for _ in range(ROUNDS):
            down = edges.join(then.select(F.col("host").alias("src"), "src_w", "t", "r"), "src")
            down = down.select(F.col("dst").alias("host"), *((F.col(x) * F.col("w") / F.col("src_w")).alias(x) for x in ("t", "r")), zero.alias("d"), zero.alias("q"))
            up = edges.join(then.select(F.col("host").alias("dst"), "dst_w", "d", "q"), "dst")
            up = up.select(F.col("src").alias("host"), zero.alias("t"), zero.alias("r"), *((F.col(x) * F.col("w") / F.col("dst_w")).alias(x) for x in ("d", "q")))
            come = down.unionByName(up).groupBy("host").agg(*(F.sum(x).alias(f"{x}_in") for x in start))
            then = base.join(come, "host", "left").select(*base.columns, *(((1 - damping) * s + damping * F.coalesce(f"{x}_in", zero)).alias(x) for x, s in start.items()))
        then = scratch.cut(then)
        moved = [F.abs(F.col(f"a.{x}") - F.col(f"b.{x}")) / F.col(f"a.{y}") for x, y in ("tr", "rr", "dq", "qq")]
        step = then.select(*scores).alias("a").join(now.select(*scores).alias("b"), "host").agg(F.max(F.greatest(*moved)).alias("x")).first().x
        scratch.drop(now)
        now = then
        if step is None or step * damping**ROUNDS / (1 - damping**ROUNDS) < close:
            break
    return now.select("host", (F.col("t") / F.col("r")).alias("trust"), (F.col("d") / F.col("q")).alias("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, least: float = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **how) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every url, with its host's scores."""
    scratch = Scratch(pages.sparkSession, "urls")
    rows = with_rule(with_host(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))), rules).select("page_id", "host", "path", "rule", "ruled")
    share = lambda verdict: F.avg(F.when(F.col("ruled") == verdict, 1.0).otherwise(0.0))
    hosts = scratch.cut(rows.groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"), F.count("*").alias("n")))
    scores = propagate(hosts.where("host <> ''").select("host", "good", "bad"), host_edges(pages, url_col, html_col), scratch, **how)
    known = scratch.cut(hosts.select("host", "n").join(scores, "host", "left").na.fill(0.0))
    both = join_counted(rows, known, "host", "n", known.agg(F.sum("n")).first()[0] or 0)
    verdict = F.coalesce("ruled", F.when((F.col("distrust") >= least) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow"))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
