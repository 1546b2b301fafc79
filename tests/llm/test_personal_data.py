"""Personal data: pattern spans against plain patterns, the vote model against loops, planted cases, odd inputs."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from lodestone.llm import personal_data as pd_
from lodestone.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * 2 if k % 2 else int(d) for k, d in enumerate(reversed(digits))]
    return sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def passes(kind, s):
    digits = re.sub(r"[^0-9]", "", s)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def plain_base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def told(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


TRICKY = [
    "a@b", "a@b.c", "@b.c", "a@@b.c", "x.y+z%w-1@mail-7.example.com.", "a@b.c@d.e", "a@b..c", "a@-.-", "é@b.cé", "a@b.c-@d.e.f", "1.2.3.4.5.6.7.8", "1.2.3", "256.1.1.1 1.1.1.256", "001.002.003.0255", "1.2.3.4.", "12.34.56.78@9.a",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "41111111111111111111111", "0000000000000", "0" * 19, "0" * 20, "+1 (132) 555-1352", "+1 (132) 555-1352 4111 1111 1111 1111", "+12", "+1 2345678", "++1 23456789 0+1 23456789 0", "+1.......", "+(1) 234567890",
]


def test_base_spans_equal_plain_patterns():
    rnd = random.Random(5)
    texts = TRICKY + ["".join(rnd.choice("a1 .@-+(4é\n0") for _ in range(rnd.randrange(60))) for _ in range(4000)] + ["".join(rnd.choice("0123456789 -") for _ in range(40)) for _ in range(2000)]
    for t in texts:
        assert [(pd_.KINDS[k], a, b) for k, a, b, ok in pd_.pattern_matches(t) if ok] == plain_base(t), t


@pytest.mark.parametrize("text", ["a" * 2_000_000, "1" * 2_000_000, "1." * 500_000, "+1(" * 500_000, "a@" * 500_000, "A" * 1_000_000 + "@", "Ab " * 300_000, "12 " * 500_000, "AB12 " * 200_000, "at dot " * 200_000], ids=lambda t: t[:6])
def test_long_texts_take_linear_time(text):
    import time

    began = time.time()
    pd_.candidates(text)
    assert time.time() - began < 20


def test_vote_model_equals_loops():
    codes, counts = np.array([0, 26, 180, 378, 405, 702, 729 - 1, 300]), np.array([50.0, 3, 20, 9, 14, 40, 8, 5])
    got = pd_.Votes(codes, counts, rounds=40).posterior
    votes = {c: [c // 3 ** (5 - k) % 3 for k in range(6)] for c in codes.tolist()}
    sign = {pd_.NO_VOTE: 0, pd_.NO: -1, pd_.YES: 1}
    post = {c: 1 / (1 + math.exp(-1.5 * (sum(sign[x] for x in v) + sign[v[0]]) + 0.75)) for c, v in votes.items()}
    n = dict(zip(codes.tolist(), counts.tolist(), strict=True))
    for _ in range(40):
        share, prior = {}, {}
        for true in (0, 1):
            w = {c: n[c] * (post[c] if true else 1 - post[c]) for c in n}
            prior[true] = (sum(w.values()) + 1) / (sum(n.values()) + 2)
            for k in range(6):
                seen = [sum(w[c] for c in n if votes[c][k] == v) + 1 + (sum(w.values()) * pd_.CHECK_PRIOR[true][v] if k == 0 else 0) for v in range(3)]
                share[true, k] = [x / sum(seen) for x in seen]
        like = {c: [prior[true] * math.prod(share[true, k][votes[c][k]] for k in range(6)) for true in (0, 1)] for c in n}
        post = {c: x[1] / (x[0] + x[1]) for c, x in like.items()}
    assert all(abs(post[c] - got[c]) < 1e-6 for c in n)


def test_classifier_is_at_its_optimum():
    rnd = np.random.default_rng(1)
    bits, yes, no = rnd.integers(0, 1 << pd_.BITS, 200), rnd.random(200) * 9, rnd.random(200) * 9
    w = pd_.fit_logistic(bits, yes, no)
    x = np.column_stack([*((bits >> k) & 1 for k in range(pd_.BITS)), np.ones(200)])
    p = 1 / (1 + np.exp(-x @ w))
    slope = x.T @ (yes - (yes + no) * p) - np.array([1.0] * pd_.BITS + [0.01]) * w
    assert np.abs(slope).max() < 1e-4


def planted(n, seed):
    """Texts with personal data that no base pattern sees, and look-alikes; (text, the planted string or None)."""
    rnd, out = random.Random(seed), []
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    for _ in range(n):
        local, host = rnd.choice(["anna", "paul.k", "office7"]), rnd.choice(["acme", "example", "mail3"])
        shown = f"({num(3)}) {num(3)}-{num(4)}"
        kind = rnd.randrange(8)
        s = [shown, f"{local} (at) {host} (dot) com", None, None, "Dr Anna Maria Berg", None, f"+49 30 {num(3)} {num(4)}", f"{local}@{host}.org"][kind]
        cue = ["please call or phone", "write an email to", "see order", "invoice row", "was signed by", "part", "telephone", "contact email"][kind]
        text = f"some words here {cue} {s or num(3) + '-' + num(4) + '-' + num(2)} and then more words follow"
        out.append((text, s))
    return out


def test_planted_cases_and_look_alikes(spark):
    cases = planted(1500, 3)
    got = {r.doc_id: {c[0][s.start : s.end] for s in r.spans} for c, r in zip(cases, pd_.personal_spans(spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "doc_id long, text string").coalesce(1)).collect(), strict=True)}
    found = sum(s in got[k] for k, (_, s) in enumerate(cases) if s)
    wrong = sum(bool(got[k] - {s}) for k, (_, s) in enumerate(cases))
    assert found >= 0.95 * sum(s is not None for _, s in cases) and wrong <= 0.02 * len(cases), (found, wrong)


def test_odd_rows_keep_and_clashes(spark):
    rows = [(1, None, "a"), (1, "", "b"), (None, "x@y.zz", "c"), (None, "x@y.zz", "c"), (2, "q " * 900_000 + "+1 (132) 555-1352", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string").withColumn("base", docs_col()).withColumn("k0", docs_col())
    got = pd_.personal_spans(docs, keep=["found"]).collect()
    assert sorted((r.found, len(r.base), len(r.spans)) for r in got) == [("a", 0, 0), ("b", 0, 0), ("c", 1, 1), ("c", 1, 1), ("d", 1, 1)]
    assert pd_.digest(pd_.personal_spans(docs.limit(0))).count() == 0


def docs_col():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_registered_query_base_equals_plain_patterns(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op12_personal_data"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in pd_.BASE]
        assert r.base_sha256 == told(want) and {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))
