"""URL filter by rules and link-graph propagation.

A rule (``host/path``, allow or block) fits its host and all subdomains where the url's path starts with the rule's; the
longest rule wins. Urls without a rule are judged by their host. Each host's share of allowed pages is its seed of
trust, its share of blocked pages its seed of distrust. Trust is propagated along links between hosts by personalised
PageRank, distrust against them from the blocked seeds, each link passing on its part of the linking (or linked) host's
score times ``DAMPING``. A host whose distrust exceeds its trust by more than ``MARGIN`` is blocked.

Propagation ends when all that is still to come, over all hosts together, is at most ``LEAST``, however many links that
takes; ``MARGIN`` is larger, so nothing that is left out decides a verdict by itself. (A seed of 1 is above the margin
up to some 70 links away.) Scores are in units of one wholly allowed or blocked host. Bringing either kind's seeds to
a sum of 1, or giving back to the seeds what hosts without links hold, multiplies all scores of that kind by one
number; neither is done, as it would weigh trust against distrust by how common each is.

Links are the absolute and protocol-relative ``href`` targets in the page; a host's links to itself pass nothing on.
All of it is DataFrame expressions: edges are summed before the shuffle, each step joins edges with the scores that
changed, and only a sum comes to the driver. Pages meet their host's score by broadcast up to ``BROADCAST_ROWS`` hosts,
beyond that by host and one of ``SALTS`` numbers, so a host with a third of all pages is not one task.

Null urls and urls without ``://`` have an empty host and path, fit no rule and are judged by the empty host. Null
html has no links. Repeated rows are judged alike and count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

DAMPING, LEAST, MARGIN = 0.85, 1e-7, 1e-6
BROADCAST_ROWS, SALTS = 100_000, 16
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\s"'<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z), and path, both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct (size, rule, verdict), or null; equally long ones by text."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string,host:string,path:string>")
    known = F.array(*[F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(rule.partition("/")[0].lower()).alias("host"), F.lit("/" + rule.partition("/")[2]).alias("path")) for verdict, rule in rules])
    fits = F.filter(known, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.array_max(fits)


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, n): how many pages of one host link to another. ``pages`` has host and html."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1)), ascii_lower))
    links = pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst")).where("src != dst and src != ''")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, least: float = LEAST) -> DataFrame:
    """(host, kind, score) from seeds (host, kind, score): kind 0 goes along edges (src, dst, n), kind 1 against them."""
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("all"))
    part = (F.lit(damping) * F.col("n") / F.col("all")).alias("part")
    along = edges.join(out, "src").select(F.col("src").alias("host"), F.lit(0).alias("kind"), F.col("dst").alias("to"), part)
    against = edges.join(into, "dst").select(F.col("dst").alias("host"), F.lit(1).alias("kind"), F.col("src").alias("to"), part)
    ways = cut(along.union(against))
    summed = lambda rows: rows.groupBy("host", "kind").agg(F.sum("score").alias("score"))
    scores = gain = cut(seeds.select("host", "kind", ((1 - damping) * F.col("score")).alias("score")))
    if ways.isEmpty():
        return scores
    step = 0
    while (gain.agg(F.sum("score")).first()[0] or 0.0) * damping / (1 - damping) > least:
        gain = cut(ways.join(gain, ["host", "kind"]).groupBy(F.col("to").alias("host"), "kind").agg(F.sum(F.col("score") * F.col("part")).alias("score")))
        step += 1
        scores = scores.union(gain) if step % 16 else cut(summed(scores.union(gain)))
    return summed(scores)


def with_scores(rows: DataFrame, hosts: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` (host, key) with the columns of ``hosts`` (one row for each host), null where it has none."""
    if hosts.count() <= broadcast_rows:
        return rows.join(F.broadcast(hosts), "host", "left")
    copies = hosts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("key", "path"), F.lit(SALTS)).cast("int")).join(copies, ["host", "salt"], "left").drop("salt")


def judge(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", html: str = "html", margin: float = MARGIN, **how) -> DataFrame:
    """(key, host, path, rule, verdict, trust, distrust) for each row."""
    host, path = host_and_path(F.col(url))
    named = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    ruled = named.select("key", "host", "path", best_rule(F.col("host"), F.col("path"), rules).alias("r"))
    ruled = ruled.select("key", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"))
    by_host = ruled.groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"), F.count("*").alias("n"))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), (F.col("allowed") / F.col("n")).alias("score")), F.struct(F.lit(1).alias("kind"), (F.col("blocked") / F.col("n")).alias("score")))
    seeds = by_host.select("host", F.explode(kinds).alias("s")).select("host", "s.kind", "s.score").where("score > 0")
    scores = propagate(cut(host_edges(named)), seeds, **how)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    hosts = cut(scores.groupBy("host").agg(of(0).alias("trust"), of(1).alias("distrust")))
    both = with_scores(ruled, hosts).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    verdict = F.coalesce("ruled", F.when(F.col("distrust") - F.col("trust") > margin, "block").otherwise("allow"))
    return both.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
