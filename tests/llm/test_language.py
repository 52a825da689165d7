from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import language

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark, scratch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.TextModel.fit(docs.filter("doc_id % 2 = 0"), rows=300)
    rows = docs.filter("doc_id % 2 = 1").select(F.col("doc_id").cast("string").cast("binary").alias("key"), "text", F.col("lang").alias("truth"),
                                                *[F.lit(None).cast("string").alias(c) for c in ("declared", "host", "domain", "suffix")])
    found = language.identify(scratch, rows.drop("truth"), model).join(rows.select("key", "truth"), "key").collect()
    assert sum(r["lang"] == r["truth"] for r in found) >= 0.97 * len(found)
    assert sum(r["rejected"] for r in found) <= 0.01 * len(found)


def test_pages_agree_with_their_declared_language(spark, scratch):
    model = language.TextModel.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    found = language.identify(scratch, language.web_evidence(pages), model, page=True).collect()
    assert len(found) == pages.count()
    assert sum(r["lang"] == r["declared"] for r in found) >= 0.95 * len(found)


def test_host_and_declaration_decide_a_short_text(spark, scratch, docs_of):
    r = random.Random(1)
    german, english = "der die das und nicht ein schön groß".split(), "the and of this that with from have".split()
    train = docs_of([(i, " ".join(r.choice(w) for _ in range(40)), lang) for i in range(40) for lang, w in (("de", german), ("en", english))])
    model = language.TextModel.fit(train)
    page = "<html lang='{}'><script>var the = 'and of';</script><body>{}</body></html>"
    rows = [(i, "http://a.example.de/x", page.format("de", " ".join(r.choice(german) for _ in range(30)))) for i in range(30)]
    rows += [(100 + i, "https://b.example.com:80/x", page.format("en", " ".join(r.choice(english) for _ in range(30)))) for i in range(30)]
    rows += [(200, "http://a.example.de/y", "<p>xq</p>"), (201, "http://b.example.com/y", "<p>xq</p>"), (202, None, None), (203, "no url", ""),
             (204, "http://c.example.de/", "<p>xq</p>"), (205, "http://a.example.de/", "<html lang=de>12345 !!!"), (206, "", "<script>the and of"), (206, "", "x" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("logs", F.lit(1))
    found = {r["id"]: r for r in language.identify(scratch, language.web_evidence(df), model, page=True)
             .withColumn("id", F.decode("key", "UTF-8").cast("long")).collect()}
    assert all(found[i]["lang"] == "de" for i in range(30)) and all(found[100 + i]["lang"] == "en" for i in range(30))
    assert found[200]["lang"] == "de" and found[201]["lang"] == "en" and found[204]["lang"] == "de"
    assert all(found[i]["rejected"] and found[i]["lang"] == "und" for i in (202, 203, 205))
    assert found[0]["posterior"] > 0.99


def test_smoothed_prior_matches_a_plain_computation(spark, scratch, docs_of):
    model = language.TextModel.fit(docs_of([(1, "der die das und " * 9, "de"), (2, "the and of this " * 9, "en")]))
    rows = [("a1", "the and of this", "a.x", "x")] * 3 + [("a2", "der die das und", "a.x", "x")] + [("b", "der die das und", "b.x", "x")] * 5
    df = spark.createDataFrame([(k.encode(), t, None, h, d, None) for k, t, h, d in rows], "key binary, text string, declared string, host string, domain string, suffix string")
    found = {bytes(r["key"]): r for r in language.identify(scratch, df, model, kappa=4.0).collect()}
    names = model.languages
    import numpy as np
    whole = (np.array([6, 3, 0]) + 1.0) / 12
    domain = (np.array([6, 3, 0]) + 4 * whole) / 13
    host = (np.array([1, 3, 0]) + 4 * domain) / 8
    total = model.likelihoods("the and of this", 40) + np.log(host)
    expected = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
    assert found[b"a1"]["lang"] == names[int(total.argmax())]
    assert abs(found[b"a1"]["posterior"] - expected.max()) < 1e-9


def test_stage_keeps_clean_documents(spark, scratch, docs_of):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs_of([(900, None, "en", None), (901, "", None, "s"), (902, "12 34 !!", "en", "s"), (None, "the and of this that", None, None),
                   (903, "the quick and the other of that", "en", "s")])
    kept = language.keep_identified(scratch, docs.unionByName(odd).withColumn("Key", F.lit(1)))
    assert kept.columns == [*docs.columns, "Key"]
    ids = {r[0] for r in kept.select("doc_id").collect()}
    assert {r[0] for r in docs.select("doc_id").collect()} <= ids and not ids & {900, 901, 902} and 903 in ids
    assert language.keep_identified(scratch, docs_of([])).count() == 0


def test_rare_languages_and_hot_copies_keep_their_sample(scratch, docs_of):
    r = random.Random(5)
    words = {"en": "the and of this that with from have".split(), "de": "der die das und nicht ein schön groß".split(),
             "fi": "ja ei että hän olla minä tämä mutta".split()}
    rows = [(i, " ".join(r.choice(words[lang]) + r.choice(["", *"abcdefgh"]) for _ in range(30)), lang)
            for i in range(20_000) for lang in ["fi" if i % 10_000 == 0 else "de" if i % 2 else "en"]]
    known = docs_of(rows).withColumn("h", F.xxhash64("lang", "text"))
    hot = known.filter("lang <> 'fi'").orderBy("h").select("text", "lang").first()
    rows += [(100_000 + i, hot["text"], hot["lang"]) for i in range(10_000)]
    df = docs_of(rows).repartition(8)
    assert language.TextModel.fit(df).languages == ["de", "en", "fi", "und"]
    kept = language.keep_identified(scratch, df)
    assert kept.count() == len(rows)
    found = language.TextModel.fit(df, rows=50)
    for lang, own in words.items():
        assert found.languages[int(found.likelihoods(" ".join(own * 3), 40).argmax())] == lang


def test_sample_holds_the_distinct_texts_with_the_smallest_hashes(spark, docs_of):
    r = random.Random(6)
    rows = [(i, f"{'abcdefgh'[i % 8]} {'xyz'[i % 3]} " * 4 + " ".join(r.choice(["lo", "mi", "na", "ru"]) for _ in range(9)), "a" if i % 5 else "b") for i in range(3000)]
    rows += [(9000 + i, None, "a") for i in range(3)] + [(9100, "no label", None)]
    whole = docs_of(rows + rows[:700] * 2)
    known = docs_of(rows).filter("text IS NOT NULL AND lang IS NOT NULL").withColumn("h", F.xxhash64("lang", "text")).select("lang", "text", "h").distinct().collect()
    drawn = [x for lang in "ab" for x in sorted((k for k in known if k["lang"] == lang), key=lambda k: k["h"])[:100]]
    assert len(drawn) == 200
    few, all_of_them = language.TextModel.fit(whole, rows=100), language.TextModel.fit(docs_of([(1, d["text"], d["lang"]) for d in drawn]))
    assert few.languages == all_of_them.languages and (few.logs == all_of_them.logs).all()


@pytest.mark.parametrize("page, words", [
    ("<body>5 < 6 and nothing else follows", "5 < 6 and nothing else follows"),
    ("if a < b then c</p><p>second", "if a < b then c second"),
    ("a<3 x <b>bold</b> <<i>y", "a< 3 x bold < y"),
    ("open <b and no end", "open <b and no end"),
    ("x <!-- never closed", "x <!-- never closed"),
    ("x<!-- a > b -->y", "x y"),
    ('<a title="a > b" href=x>link</a >t', "link t"),
    ("<a title=it's>that's</a>", "that's"),
    ("<SCRIPT>if (a < b) t='</p>'</script >after<style a='>'>p{}</STYLE\n>end", "after end"),
    ("<scripture>kept</scripture>", "kept"),
    ("a<script>never closed", "a"),
    ("<?xml version='1'?><!DOCTYPE html>&lt;b&gt; &amp;", "<b> &"),
    ("x <", "x <"), ("", ""), (None, "")])
def test_visible_text_loses_nothing(page, words):
    assert language.visible(page).split() == words.split()


def test_visible_text_takes_linear_time():
    import time

    for unit in ("<", "<a =", "<a ='", '<a ="', "<!--", "<script", "<b x='>", "a < b ", '<a =">"', "<a =\">\" ='", "<script>", "<!-- -->"):
        page = unit * (400_000 // len(unit))
        begin = time.perf_counter()
        language.visible(page)
        assert time.perf_counter() - begin < 5, unit


def test_every_page_matches_a_plain_recomputation(spark):
    from conftest import DATA
    from .plain_language import fitted, identified, page_row

    from cohortspark.llm.queries import op8_language

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("lang", "text").collect()
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    rows = [page_row(p["url"], p["html"]) for p in pages]
    expected = {p["page_id"]: (r, e) for p, r, e in zip(pages, rows, identified(rows, fitted([tuple(d) for d in docs])))}
    found = op8_language(spark, DATA).collect()
    assert len(found) == len(pages) and len({r["lang"] for r in found}) > 2
    for r in found:
        row, (lang, posterior, text_lang, rejected) = expected[r["page_id"]]
        assert (r["lang"], r["text_lang"], r["declared"], r["host"], r["rejected"]) == (lang, text_lang, row[1], row[2], rejected)
        assert abs(r["posterior"] - posterior) < 2e-6


def test_kept_documents_match_a_plain_recomputation(spark, scratch, docs_of):
    from .plain_language import fitted, identified

    rng = random.Random(9)
    words = {"en": ["the", "and", "water", "house", "with"], "de": ["und", "der", "wasser", "haus", "mit"], "xx": ["zzq", "qqx", "xjq"]}
    rows = []
    for i in range(120):
        lang = rng.choice(list(words))
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 30)))
        rows.append((i, rng.choice([text, text, text, text, "123 456", "", None, "q0w9"]), rng.choice([lang, lang, "en", None]), rng.choice(["a", "b", "b", None])))
    plain = identified([(t or "", lang, host, None, None) for _, t, lang, host in rows], fitted([(lang, t) for _, t, lang, _ in rows]))
    expected = sorted(r[0] for r, e in zip(rows, plain) if not e[3])
    assert sorted(r["doc_id"] for r in language.keep_identified(scratch, docs_of(rows)).collect()) == expected and 0 < len(expected) < len(rows)
