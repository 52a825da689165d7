from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from cohortspark.llm import urls
from cohortspark.llm.queries import URL_RULES

URLS = ["http://Example.COM/en/a", "https://www.example.com/en/", "https://www.example.com/en", "http://notexample.com/en/x", "http://a.example.com/en/b?x=1",
        "ftp://x.net/es/1#f", "http://x.net/ES/1", "http://net/fr/", "http://com/", "http://com", "http://x.com?y=/en/", "http://x.org/a#://b/c",
        "no scheme", "", None, "://host/p", "a://b://c/d", "http://É.com/é", "http://x.org/" + "y" * 200_000, "http://x.net:80/fr/a", "http:///p",
        "http://x.org/a\nb?c", "http://x.org//", "http://www.x.org/a/?utm_source=feed&b=2&a=1&&ref=z", "https://x.org/a?a=1&b=2#top", "http://x.org:443/a?refer=1"]


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def canonical(url):
    if url is None or "://" not in url:
        return None
    host, path = host_path(url)
    host = re.sub(r":(80|443)?\Z", "", host.removeprefix("www."))
    tail = url[url.index("://") + 3:].split("#")[0]
    named = tail.split("?", 1)[1].split("&") if "?" in tail else []
    wanted = sorted(p for p in named if p and not re.match(r"(utm_[^=]*|ref|fbclid|gclid)(=|\Z)", p))
    return host + path.rstrip("/") + ("?" + "&".join(wanted) if wanted else "")


def judged(url, listed):
    host, path = host_path(url)
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    on_list = canonical(url) is not None and canonical(url) in {canonical(u) for u in listed}
    _, rule, verdict = max(fits, default=(0, None, "block" if on_list else "allow"))
    return url, host, path, canonical(url), on_list, rule, verdict


def frame(spark, rows):
    return spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")


def test_every_row_matches_brute_force_both_ways(spark, scratch):
    rng = random.Random(5)
    hosts = ["a.org", "www.a.org", "b.net", "x.b.net", "example.com", "www.example.com"]
    rows = URLS + ["http://{}/{}/{}{}".format(rng.choice(hosts), rng.choice(["en", "es", "fr"]), rng.randint(0, 40),
                                              rng.choice(["", "/", "#t", "?utm_source=f"])) for _ in range(400)]
    rows += ["http://hot.org/x"] * 300
    listed = [None, "", "http://x.org/a?b=2&a=1", "https://hot.org/x/", "http://hot.org/x"] + [f"https://b.net/{g}/{i}" for g in ("en", "fr") for i in range(0, 40, 2)]
    expected = sorted((judged(u, listed) for u in rows), key=str)
    for most in (32 << 20, 0):   # sent to every executor, and joined by block
        out = urls.filter_urls(scratch, frame(spark, rows).repartition(5), frame(spark, listed), URL_RULES, broadcast_bytes=most)
        got = [(r["url"], r["host"], r["path"], r["canonical"], r["listed"], r["rule"], r["verdict"]) for r in out.collect()]
        assert sorted(got, key=str) == expected
    assert any(e[4] and e[5] is None for e in expected) and any(e[4] and e[5] for e in expected)


def test_false_positives_are_few_and_removed(spark, scratch):
    listed = [f"http://l.org/{i}" for i in range(4000)]
    rows = [f"http://o.org/{i}" for i in range(20_000)] + listed[::10]
    out = urls.filter_urls(scratch, frame(spark, rows), frame(spark, listed))
    assert out.filter("listed").count() == 400 == out.filter("verdict = 'block'").count()
    for n in (400, 4000):   # the share that goes to the exact join stays small however long the list is
        blocks = 1
        while blocks * 256 < n * 16:
            blocks *= 2
        words = urls.bloom(frame(spark, listed[:n]).select(urls.canonical(F.col("url")).alias("k")), "k", blocks)
        probe = frame(spark, rows[:20_000]).select(urls.canonical(F.col("url")).alias("k"))
        hits = probe.withColumn("block", urls._block(F.col("k"), blocks)).join(words, "block")
        for i, m in enumerate(urls._masks(F.col("k"))):
            hits = hits.filter(F.col(f"w{i}").bitwiseAND(m) == m)
        assert hits.count() < 200


def test_empty_tables_clashing_names_and_plan(spark, scratch):
    df = frame(spark, URLS).withColumn("Host", F.lit("x")).withColumn("block", F.lit(1)).withColumn("w0", F.lit(2)).withColumn("doc", F.lit(3))
    out = urls.filter_urls(scratch, df, frame(spark, []), URL_RULES)
    assert out.columns == ["page_id", "url", "block", "w0", "doc", "host", "path", "canonical", "listed", "rule", "verdict"]
    assert out.count() == len(URLS) and out.filter("listed").count() == 0
    assert urls.filter_urls(scratch, frame(spark, []), df.select("url")).count() == 0
    plan = out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
