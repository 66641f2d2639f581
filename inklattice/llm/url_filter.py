"""URL filters by link-graph propagation (operator 5).

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z folded; path: from there up to ``?``, ``#``
or the end.  A null url, or one without ``://``, has an empty host and path.

Rules (host, path, verdict) fit a host and all its subdomains if the url's path starts with the rule's path; the
longest rule wins.  All other urls are judged by their host in the link graph: hosts are nodes, an edge goes from
a page's host to every host its html links to (one vote per pair of hosts, weighed by links).  Personalised
PageRank spreads trust from the hosts that only allow rules fit, along the edges; distrust spreads from the hosts
that only block rules fit, against them.  A host is blocked where its share of distrust is at least ``ratio``
times its share of trust and above zero.  Hosts that neither reaches are allowed.  Both walks go on until every
host that can be reached has been and no host's mass changes by more than ``TOLERANCE`` of itself in a round, however
many rounds that takes (about 130 and the longest way from a seed, if the graph has cycles).

Nulls: a null html has no links.  Rows with a null id are judged like others.  Repeated rows give repeated rows
and repeated links.  Empty tables give empty results; other columns are ignored.  Ties between rules of one
length go to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inklattice.llm.common import discard, materialize

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DAMPING = 0.85
#: Rounds between two tests of convergence.
ITERATIONS = 8
#: Largest change of a host's mass in a round, as a share of that mass, at which the walk has settled.
TOLERANCE = 1e-9
RATIO = 1.0
#: Links of one host that one task joins.
HUB = 100_000
#: Rows up to which the table of judged hosts, or that of hosts with many links, is sent to all executors.
BROADCAST_ROWS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts.  pages: host, html."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s<>]+)"""), F.lit(1))
    out = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(links).alias("url"))
    out = out.withColumn("dst", host_of(F.when(F.col("url").startswith("//"), F.concat(F.lit("x:"), F.col("url"))).otherwise(F.col("url"))))
    return out.filter("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(host, mass) by personalised PageRank along ``edges`` from ``seeds`` (host); masses sum to one.

    Runs blocks of ``iterations`` rounds until a block's last round reaches no new host and changes no mass by more
    than ``TOLERANCE`` of it.  A hot target is pre-aggregated before each shuffle; the links of a source with many are
    dealt to parts of ``HUB`` links, to each of which its mass goes.  Every second round and
    the last of a block are written to the shared folder.  Mass that hosts without links hold goes back to the seeds,
    which multiplies all masses alike and is made up for at the end.
    """
    if not 0 <= damping < 1 or iterations < 1:
        raise ValueError("damping must be in [0, 1) and iterations 1 or more")
    n = seeds.count()
    start = seeds.select("host", F.lit(1.0 / max(n, 1)).alias("jump"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"), F.ceil(F.count("*") / HUB).cast("int").alias("parts"))
    share = (F.col("weight") / F.col("total")).alias("p")
    steps = materialize(edges.join(out, "src").select("src", "dst", share, F.pmod(F.xxhash64("dst"), "parts").cast("int").alias("part")), "steps")
    hubs = materialize(out.filter("parts > 1").select(F.col("src").alias("host"), "parts"), "hubs")
    n_hubs = hubs.count()
    mass = start.select("host", F.col("jump").alias("mass"))
    if n and not steps.isEmpty():
        kept, settled = None, False
        while not settled:
            for k in range(iterations):
                before = mass
                held = mass.withColumn("part", F.lit(0))
                if n_hubs:
                    spread = mass.join(F.broadcast(hubs) if n_hubs <= BROADCAST_ROWS else hubs, "host", "left")
                    held = spread.select("host", "mass", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
                moved = steps.join(held, (steps.src == held.host) & (steps.part == held.part)).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("mass") * F.col("p"))).alias("mass"))
                mass = moved.union(start.select("host", ((1 - damping) * F.col("jump")).alias("mass"))).groupBy("host").agg(F.sum("mass").alias("mass"))
                if k % 2 or k >= iterations - 2:
                    mass = materialize(mass, "mass")
                    if kept is not None and k < iterations - 1:
                        discard(kept)
                    kept, last = mass, kept
            # Reached hosts only grow in number, so a round without new ones is the last to look for them.
            old = before.select("host", F.col("mass").alias("old"))
            settled = mass.join(old, "host", "left").filter(F.col("old").isNull() | (F.abs(F.col("mass") - F.col("old")) > TOLERANCE * F.col("mass"))).isEmpty()
            if last is not None:
                discard(last)
    total = mass.agg(F.sum("mass")).first()[0]
    return mass.select("host", (F.col("mass") / F.lit(float(total or 1.0))).alias("mass"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=None, damping: float = DAMPING, iterations: int = ITERATIONS, ratio: float = RATIO) -> DataFrame:
    """id, host, path, rule, verdict, trust, distrust of every row."""
    rules = RULES if rules is None else rules
    parts = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    urls = parts.drop("html").withColumn("rule", rule).withColumn("ruled", verdict)
    hosts = urls.filter("host <> ''").groupBy("host").agg(F.max(F.col("ruled") == "allow").alias("allowed"), F.max(F.col("ruled") == "block").alias("blocked"))
    hosts = materialize(hosts, "hosts")
    edges = materialize(host_edges(parts), "edges")
    one = lambda yes, no: hosts.filter(F.coalesce(yes, F.lit(False)) & ~F.coalesce(no, F.lit(False))).select("host")
    trust = propagate(edges, one(F.col("allowed"), F.col("blocked")), damping, iterations)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(back, one(F.col("blocked"), F.col("allowed")), damping, iterations)
    both = trust.select("host", F.col("mass").alias("trust"), F.lit(0.0).alias("distrust")).union(distrust.select("host", F.lit(0.0).alias("trust"), F.col("mass").alias("distrust")))
    scored = materialize(both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "trust")
    scored = F.broadcast(scored) if scored.count() <= BROADCAST_ROWS else scored
    none = F.lit(0.0)
    out = urls.join(scored, "host", "left").withColumn("trust", F.coalesce("trust", none)).withColumn("distrust", F.coalesce("distrust", none))
    spread = F.when((F.col("distrust") > 0) & (F.col("distrust") >= ratio * F.col("trust")), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", spread).alias("verdict"), "trust", "distrust")


RULES_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, v DESC) AS k FROM h JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT h.page_id, h.host, h.path, m.rule, m.v AS ruled FROM h LEFT JOIN m ON m.page_id = h.page_id AND m.k = 1
"""
