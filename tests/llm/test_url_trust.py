"""Rules and link-graph propagation against plain versions."""

import re

import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from siftstone.llm.queries import ORACLES, QUERIES, RULES
from siftstone.llm.url_trust import DAMPING, MARGIN, SALTS, judge, with_scores

URLS = [None, "", "no scheme", "http://A.Example.ORG/es/1", "https://example.org/en/12?q", "https://example.org/en/2#x", "http://x.com/fr/a", "http://x.com/de/a", "http://com/de/", "http://mycom/de/", "ftp://b.net?x://y", "http://h.org", "http://éX.Com/fr/ü", "://z.com/de/", "a://b://c/d", "http://x.com/en/a"]


def plain_parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def plain_judge(pages):
    rows = [(k, *plain_parse(u), h or "") for k, u, h in pages]
    rules = [plain_rule(host, path) for _, host, path, _ in rows]
    edges = {}
    for _, host, _, html in rows:
        for dst in {"".join(c.lower() if "A" <= c <= "Z" else c for c in m) for m in re.findall(r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\s"'<>]+)""", html)}:
            if dst != host and host:
                edges[host, dst] = edges.get((host, dst), 0) + 1
    hosts = {h for _, h, _, _ in rows} | {x for e in edges for x in e}
    n = {h: sum(r[1] == h for r in rows) for h in hosts}
    seed = {v: {h: sum(r[1] == h and u[1] == v for r, u in zip(rows, rules)) / max(1, n[h]) for h in hosts} for v in ("allow", "block")}
    out, into = {}, {}
    for (a, b), w in edges.items():
        out[a], into[b] = out.get(a, 0) + w, into.get(b, 0) + w
    score = {}
    for v, ways in (("allow", [(a, b, w / out[a]) for (a, b), w in edges.items()]), ("block", [(b, a, w / into[b]) for (a, b), w in edges.items()])):
        gain = {h: (1 - DAMPING) * s for h, s in seed[v].items()}
        score[v] = dict(gain)
        for _ in range(400):
            new = dict.fromkeys(hosts, 0.0)
            for a, b, w in ways:
                new[b] += DAMPING * w * gain[a]
            gain = new
            for h in hosts:
                score[v][h] += gain[h]
    return [(k, h, p, r[0], r[1] or ("block" if score["block"][h] - score["allow"][h] > MARGIN else "allow")) for (k, h, p, _), r in zip(rows, rules)]


def test_judgements(spark):
    link = lambda *hosts: " ".join(f'<a HREF = "//{h}/x">' for h in hosts)
    pages = [(i, u, None) for i, u in enumerate(URLS)]
    pages += [(100, "http://spam.net/a", link("x.com", "bad.com")), (101, "http://bad.com/de/x", link("far.net", "spam.net")), (102, "http://good.net/", link("www.org")), (103, "http://www.org/", link("good.net", "Friend.net")), (104, "http://friend.net/z", link("friend.net")), (105, "http://lone.net/", ""), (106, "http://bad.com/en/", "<a href='https://x.com/'>"), (106, "http://bad.com/en/", "<a href='https://x.com/'>"), (None, "http://spam.net/b", "x" * 200000)]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(frame, RULES, least=1e-12).collect()]
    assert sorted(got, key=str) == sorted(plain_judge(pages), key=str)
    by = {g[0]: g[4] for g in got}
    assert by[100] == "block" and by[106] == "block" and by[104] == "allow" and by[105] == "allow"
    assert judge(frame.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in judge(frame, []).collect()} == {"allow"}


def test_linked_hosts_equal_the_sql(spark, tmp_path):
    """Chains of 45 hosts before and behind seeds, a cycle, a hub and random links, by the registered query and its SQL."""
    rng = random.Random(5)
    href = lambda hosts: " ".join(f"<a href='http://{h}/q'>" for h in hosts)
    pages = [(f"http://c{i}.net/", href([f"c{i + 1}.net"])) for i in range(45)] + [("http://c45.net/", href(["x.com"])), ("http://x.com/de/1", "")]
    pages += [(f"http://t{i}.net/", href([f"t{i + 1}.net"])) for i in range(45)] + [("http://www.org/", href(["t0.net"]))]
    pages += [("http://r0.net/", href(["r1.net"])), ("http://r1.net/", href(["r2.net", "y.com"])), ("http://r2.net/", href(["r0.net"])), ("http://y.com/de/", href(["r0.net"]))]
    pages += [("http://hub.net/", href(f"s{i}.net" for i in range(60)))] + [(f"http://s{i}.net/", href(["hub.net", rng.choice(["x.com", "www.org", "far.net"])])) for i in range(60)]
    pages += [(f"http://m{rng.randrange(30)}.net/{rng.choice(['', 'de/', 'fr/'])}", href(f"m{rng.randrange(30)}.net" for _ in range(3))) for _ in range(200)]
    pages += [(f"http://m{rng.randrange(30)}.com/{rng.choice(['', 'de/', 'fr/'])}", href([f"m{rng.randrange(30)}.net", f"m{rng.randrange(30)}.com"])) for _ in range(100)]
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in QUERIES["op1_url_trust"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.register("pages", pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "html": [r[2] for r in rows]}))
    want = sorted((r[0], r[1], r[2], r[3], r[4]) for r in db.execute(f"select page_id, host, path, rule, verdict from ({ORACLES['op1_url_trust']})").fetchall())
    assert got == want == sorted(plain_judge(rows))
    by = {h: v for _, h, _, rule, v in got if rule is None}
    assert by["c0.net"] == "block" and by["t44.net"] == "allow" and {by[f"r{i}.net"] for i in range(3)} == {"block"}


def test_scores_meet_pages_by_salt_as_by_broadcast(spark):
    rows = spark.range(500).select(F.concat(F.lit("h"), F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 7)).alias("host"), F.col("id").alias("key"), F.lit("/").alias("path"))
    hosts = spark.createDataFrame([(f"h{i}", i / 8) for i in range(5)], "host string, trust double")
    both = [sorted((r["key"], r["host"], r["trust"]) for r in with_scores(rows, hosts, n).select("key", "host", "trust").collect()) for n in (10, 1)]
    assert both[0] == both[1] and len(both[0]) == 500 and SALTS > 1
