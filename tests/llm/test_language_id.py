"""Fused evidence against plain loops, held-out accuracy, odd tables."""

import math
import random
from collections import Counter, defaultdict

import pytest

from lodestone.llm import language_id as lid

WORDS = {"de": "der die und nicht ist ein wird auch", "en": "the and of with that was for are", "fr": "le la les dans est une pour que"}


def buckets(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % (1 << 32)) >> (32 - lid.BITS) for i in range(len(b) - 2)]


def normal(x):
    top = max(x)
    w = [math.exp(v - top) for v in x]
    return [v / sum(w) for v in w]


def plain(pages, docs):
    counts = defaultdict(Counter)
    for text, lang in docs:
        if lang:
            counts[lang.lower()].update(buckets(text or ""))
    langs = sorted(counts)
    size = 1 << lid.BITS
    log_p = {k: (lambda total, c=counts[k]: lambda g: math.log((c[g] + 0.5) / total))(sum(counts[k].values()) + 0.5 * size) for k in langs}
    rows = []
    for page, url, html in pages:
        g = buckets(lid.page_text(html or ""))
        scale = lid.TEMPER * min(len(g), lid.TEXT_GRAMS) / max(len(g), 1)
        ll = [scale * sum(map(log_p[k], g)) for k in langs]
        said = lid.declared_language(html or "")
        rows.append([page, *lid.host_levels(url or ""), said if said in langs else "other" if said else "", ll, normal(ll)])
    add = lambda own: [sum(r[6][k] for r in own) for k in range(len(langs))]
    by = lambda at: {v: add([r for r in rows if r[at] == v]) for v in {r[at] for r in rows}}
    total = add(rows)
    prior = [(x + 1) / (sum(total) + len(langs)) for x in total]
    lean = lambda c, above: [(a + lid.LEAN * p) / (sum(c) + lid.LEAN) for a, p in zip(c, above, strict=True)]
    suffixes, domains, hosts, said = by(3), by(2), by(1), by(4)
    like = lambda seen, v: [math.log((seen[v][k] + 0.5) / (total[k] + 0.5 * (len(seen) + 1))) for k in range(len(langs))]
    out = {}
    for page, host, domain, suffix, declared, ll, text_p in rows:
        above = lean(domains[domain], lean(suffixes[suffix], prior))
        others = [max(c - p, 0) for c, p in zip(hosts[host], text_p, strict=True)]
        score = [sum(x) for x in zip(ll, map(math.log, lean(others, above)), like(said, declared), like(suffixes, suffix), strict=True)]
        p = normal(score)
        out[page] = (langs[p.index(max(p))], max(p))
    return out


def tables(spark, pages, docs):
    return spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "text string, lang string")


@pytest.mark.parametrize("broadcast", [True, False])
def test_posterior_equals_loops(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(lid, "BROADCAST_HOSTS", 0)
    rnd = random.Random(8)
    some = lambda k, n: " ".join(rnd.choice(WORDS[k].split()) for _ in range(n))
    docs = [(some(k, 30), k.upper() if n == 1 else k) for k in WORDS for n in range(4)] + [(None, "de"), ("x y", None), ("", "")]
    pages = [(1000, None, None), (1001, "", ""), (1002, "http://h1.a.de/", "<html lang=xx>"), (1003, "http://h1.a.de/", "z" * 1_200_000)]
    for k in range(90):
        lang = rnd.choice(sorted(WORDS))
        host = rnd.choice(["h1.a.de", "h2.a.de", "b.fr", "c.com", "d.c.com"])
        head = rnd.choice(["<html>", f'<html lang="{lang}">', '<html lang="en">', '<html lang="xx">'])
        pages.append((k, f"http://{host}/{k}", f"{head}<p>{some(lang, rnd.randrange(0, 9))}</p>"))
    got = {r.page_id: (r.lang, r.posterior) for r in lid.identify(*tables(spark, pages, docs)).collect()}
    want = plain(pages, docs)
    assert got.keys() == want.keys()
    for k, (lang, p) in want.items():
        assert got[k][0] == lang and got[k][1] == pytest.approx(p, abs=1e-4), k


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 200 and lang is not null")
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    pages = held.selectExpr("doc_id as page_id", "concat('http://h', doc_id % 9, '.example.com/') as url", "concat('<p>', text, '</p>') as html")
    right = lid.identify(pages, train).join(held.selectExpr("doc_id as page_id", "lang as own"), "page_id").selectExpr("avg(cast(lang = own as int)) as share").first().share
    assert right >= 0.95


def test_odd_tables(spark):
    pages, docs = tables(spark, [(None, "http://a.de", "der die"), (None, "http://a.de", "der die"), (7, None, None)], [("der die und", "de"), ("the and of", "en")])
    clash = pages.selectExpr("*", "1 as host", "2 as lang", "3 as s0", "4 as ll", "5 as salt")
    assert sorted((r.page_id is None, r.lang) for r in lid.identify(clash, docs).collect()) == [(False, "de"), (True, "de"), (True, "de")]
    assert lid.identify(pages.limit(0), docs).count() == 0 and lid.identify(pages.limit(0), docs.limit(0)).count() == 0
