"""Operator 1, URL filters by link-graph propagation.

Pages give edges between hosts: the absolute links of a page, and, in both
directions, a host and its parent host (a.b.example.com and b.example.com, and
so on down to ``site_labels`` labels, and www.example.com and example.com),
since a site's hosts link to each other wherever their pages' relative links
don't name them.  An edge's weight is the number of the links.

Trust is personalised PageRank from the trusted seeds along the edges; distrust
is personalised PageRank from the blocked seeds against them, so that it reaches
the hosts that link to blocked ones; what a host without outgoing edges has is
not passed on.  Beside each goes the same walk with every host as a seed, and a
host's trust or distrust is the part of what it receives that comes from the
seeds: from 0 to 1 however many hosts and links there are, and 1 for the seeds
themselves.  Scores of PageRank shrink with the number of hosts; their quotient
does not, so one threshold serves any graph.  A host is blocked if it is a
blocked seed, or if its distrust is at least ``threshold`` and above its trust;
each page follows its host.

The walk's first ``steps`` steps are summed, so many that what is left out is at
most ``TOLERANCE`` of all scores, whatever the graph (a step passes on at most
``damping`` of what it gets).  Hosts, edges and scores are tables keyed by host;
each step is one join and one aggregation for all scores, and every ``cut`` steps
the scores are written to the shared folder.

Defined results: a page whose url is null or has no host has a null host, scores
0 and is not kept; a null html has no links, and html of any length is read
whole; a null page_id stays null; repeated rows count their links again and are
reported again; hosts are compared in lower case without port and user; a host
may hold letters of any script, digits, points, hyphens and underscores, or be an
address in brackets, and anything else is no host (no part of it is taken
instead); equal trust and distrust don't block; with no seeds, or an empty table,
all scores are 0; columns besides page_id, url and html are ignored, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import discard, stored

DAMPING, THRESHOLD, SITE_LABELS, TOLERANCE = 0.85, 0.5, 3, 0.005
#: All of ASCII but letters, digits, points, hyphens and underscores.
_NOT = r"\x00-\x2C\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F"
_HOST = rf"^(?:(?i:https?):)?//(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^{_NOT}\s]+)(?::[0-9]*)?(?:[/?#\\]|$)"
_LINK = r"(?i)\b(?:href|src|action)\s*=\s*[\"']?((?:https?:)?//[^\s\"'<>]+)"


def steps(damping: float = DAMPING, tolerance: float = TOLERANCE) -> int:
    """The number of steps after which at most tolerance of all scores is left out."""
    return max(1, math.ceil(math.log(tolerance) / math.log(damping))) if damping > 0 else 1


def host(url: Column) -> Column:
    """Lower-case host of an absolute url, else null."""
    own = F.lower(F.regexp_extract(url, _HOST, 1))
    own = F.regexp_replace(own, r"^\.+|\.+$", "")
    return F.when(own != "", own)


def host_edges(pages: DataFrame, site_labels: int = SITE_LABELS) -> DataFrame:
    """(src, dst, weight) of different hosts."""
    own = pages.select(host(F.col("url")).alias("src"), "html").filter("src is not null")
    links = own.select("src", F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("link"))
    links = links.select("src", host(F.col("link")).alias("dst")).filter("dst is not null and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = own.select(F.col("src").alias("h")).union(links.select("dst")).distinct().filter("h NOT LIKE '[%'")
    parts = hosts.select(F.split("h", r"\.").alias("p")).withColumn("n", F.size("p"))
    # the place of the last label to leave out
    last = F.greatest(F.col("n") - site_labels, F.when((F.col("p")[0] == "www") & (F.col("n") > 2), 1).otherwise(0))
    site = parts.filter(last > 0).select("p", "n", F.explode(F.sequence(F.lit(1), last)).alias("k"))
    tail = lambda k: F.array_join(F.slice("p", k, F.col("n")), ".")
    site = site.select(tail(F.col("k")).alias("src"), tail(F.col("k") + 1).alias("dst"))
    site = site.union(site.select("dst", "src")).distinct()
    return links.union(site.withColumn("weight", F.lit(1.0))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, trusted: tuple[str, ...], blocked: tuple[str, ...], damping: float = DAMPING, tolerance: float = TOLERANCE, cut: int = 3) -> DataFrame:
    """(host, trust, distrust) of all hosts of the edges and seeds."""
    spark = edges.sparkSession
    # one table for both directions: way 0 follows an edge, way 1 goes against it
    ways = edges.select(F.lit(0).alias("way"), F.col("src").alias("host"), F.col("dst").alias("to"), "weight").union(edges.select(F.lit(1), "dst", "src", "weight"))
    total = ways.groupBy("way", "host").agg(F.sum("weight").alias("total"))
    ways = stored(ways.join(total, ["way", "host"]).select("way", "host", "to", (F.col("weight") / F.col("total")).alias("part")))
    own = [(way, h) for way, own in ((0, trusted), (1, blocked)) for h in sorted({x.lower() for x in own})]
    own = spark.createDataFrame(own, "way int, host string").withColumn("seed", F.lit(1 - damping))
    every = ways.select(F.col("host").alias("h")).union(ways.select("to")).union(own.select("host")).distinct().select(F.explode(F.array(F.lit(0), F.lit(1))).alias("way"), F.col("h").alias("host"))
    # own: from the seeds; whole: from all hosts
    seeds = stored(every.join(own, ["way", "host"], "left").select("way", "host", F.coalesce("seed", F.lit(0.0)).alias("own"), F.lit(1 - damping).alias("whole")))
    scores, before = seeds, None
    number = steps(damping, tolerance)
    for k in range(1, number + 1):
        part = lambda c: F.sum(damping * F.col(c) * F.col("part")).alias(c)
        moved = scores.join(ways, ["way", "host"]).groupBy("way", F.col("to").alias("host")).agg(part("own"), part("whole"))
        scores = moved.union(seeds.select("way", "host", "own", "whole")).groupBy("way", "host").agg(F.sum("own").alias("own"), F.sum("whole").alias("whole"))
        if k % cut == 0 or k == number:
            scores = stored(scores)
            if before is not None:
                discard(before)
            before = scores
    received = scores.join(seeds.select("way", "host", F.col("own").alias("seed")), ["way", "host"])
    share = F.when(F.col("seed") > 0, 1.0).when(F.col("whole") - (1 - damping) > 1e-12, F.col("own") / (F.col("whole") - (1 - damping))).otherwise(0.0)
    of = lambda way: F.max(F.when(F.col("way") == way, share)).alias("trust" if way == 0 else "distrust")
    return received.groupBy("host").agg(of(0), of(1))


def filter_urls(pages: DataFrame, trusted: tuple[str, ...], blocked: tuple[str, ...], damping: float = DAMPING, threshold: float = THRESHOLD, site_labels: int = SITE_LABELS, tolerance: float = TOLERANCE) -> DataFrame:
    """(page_id, host, trust, distrust, kept) of each page, scores rounded to 6 digits."""
    pages = pages.select("page_id", "url", "html")
    scores = stored(propagate(stored(host_edges(pages, site_labels)), trusted, blocked, damping, tolerance))
    # the optimiser broadcasts the hosts' scores where their size allows, and joins by host where it doesn't
    own = pages.select("page_id", host(F.col("url")).alias("host")).join(scores, "host", "left")
    trust, distrust = (F.round(F.coalesce(F.col(c), F.lit(0.0)), 6) for c in ("trust", "distrust"))
    own = own.select("page_id", "host", trust.alias("trust"), distrust.alias("distrust"))
    seed = F.coalesce(F.col("host").isin([x.lower() for x in blocked]), F.lit(False)) if blocked else F.lit(False)
    return own.withColumn("kept", F.col("host").isNotNull() & ~seed & ~((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))))


def sql(trusted: tuple[str, ...], blocked: tuple[str, ...]) -> str:
    """The same rows in DuckDB's SQL."""
    host_of = lambda x: f"nullif(regexp_replace(lower(regexp_extract({x}, '{_HOST}', 1)), '^\\.+|\\.+$', '', 'g'), '')"
    values = lambda own, way: ", ".join(f"({way}, '{h}')" for h in sorted(set(own)))
    link = "\\b(?:href|src|action)\\s*=\\s*[\"\'\']?((?:https?:)?//[^\\s\"\'\'<>]+)"
    walk = "".join(
        f""", s{k} AS MATERIALIZED (SELECT way, host, sum(own) AS own, sum(whole) AS "whole" FROM (SELECT s.way, w."to" AS host, {DAMPING}::DOUBLE * s.own * w.part AS own, {DAMPING}::DOUBLE * s."whole" * w.part AS "whole" FROM s{k - 1} s JOIN ways w ON s.way = w.way AND s.host = w.host UNION ALL SELECT way, host, own, "whole" FROM s0) GROUP BY 1, 2)"""
        for k in range(1, steps() + 1)
    )
    return f"""
WITH own AS (SELECT page_id, {host_of("url")} AS host, html FROM pages),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1, 'i')) AS link FROM own WHERE host IS NOT NULL),
links AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT src, {host_of("link")} AS dst FROM found) WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2),
hosts AS (SELECT host AS h FROM own WHERE host IS NOT NULL UNION SELECT dst FROM links),
parts AS (SELECT p, len(p) AS n, greatest(len(p) - {SITE_LABELS}, CASE WHEN p[1] = 'www' AND len(p) > 2 THEN 1 ELSE 0 END) AS last FROM (SELECT string_split(h, '.') AS p FROM hosts WHERE h NOT LIKE '[%')),
up AS (SELECT p, n, unnest(range(1, last + 1)) AS k FROM parts WHERE last > 0),
pairs AS (SELECT array_to_string(p[k : n], '.') AS h, array_to_string(p[k + 1 : n], '.') AS p FROM up),
site AS (SELECT h AS src, p AS dst FROM pairs UNION SELECT p, h FROM pairs),
edges AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM links UNION ALL SELECT src, dst, 1.0 FROM site) GROUP BY 1, 2),
both_ways AS (SELECT 0 AS way, src AS host, dst AS "to", weight FROM edges UNION ALL SELECT 1, dst, src, weight FROM edges),
ways AS MATERIALIZED (SELECT way, host, "to", weight / sum(weight) OVER (PARTITION BY way, host) AS part FROM both_ways),
seeds AS (SELECT * FROM (VALUES {values(trusted, 0)}, {values(blocked, 1)}) v(way, host)),
every AS (SELECT DISTINCT host FROM (SELECT host FROM ways UNION ALL SELECT "to" FROM ways UNION ALL SELECT host FROM seeds)),
s0 AS MATERIALIZED (SELECT e.way, e.host, CASE WHEN seeds.host IS NULL THEN 0.0 ELSE {1 - DAMPING} END::DOUBLE AS own, {1 - DAMPING}::DOUBLE AS "whole" FROM (SELECT host, unnest([0, 1]) AS way FROM every) e LEFT JOIN seeds USING (way, host)){walk},
parts_of AS (SELECT s.host, s.way, CASE WHEN s0.own > 0 THEN 1.0 WHEN s."whole" - {1 - DAMPING} > 1e-12 THEN s.own / (s."whole" - {1 - DAMPING}) ELSE 0.0 END AS share FROM s{steps()} s JOIN s0 USING (way, host)),
scores AS (SELECT host, max(share) FILTER (WHERE way = 0) AS trust, max(share) FILTER (WHERE way = 1) AS distrust FROM parts_of GROUP BY host),
page AS (SELECT page_id, own.host, round(coalesce(trust, 0), 6) AS trust, round(coalesce(distrust, 0), 6) AS distrust FROM own LEFT JOIN scores USING (host))
SELECT page_id, host, trust, distrust, host IS NOT NULL AND NOT coalesce(host IN ({", ".join(f"'{h}'" for h in blocked)}), false) AND NOT (distrust >= {THRESHOLD} AND distrust > trust) AS kept FROM page"""
