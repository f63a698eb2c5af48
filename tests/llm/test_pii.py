"""Personal data: patterns against Python's, disclosure against a plain model, and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from episodica.llm import pii
from episodica.llm.pii import Disclosure

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        doubled = [d * 2 - 9 * (d > 4) if k % 2 else d for k, d in enumerate(map(int, reversed(digits)))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def slow_spans(text):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(PLAIN[kind], text or "") if slow_valid(kind, m[0]))


def random_text(rng):
    parts = ["a@b.c", "x@y", "_d@e.f.g", "@", ".", "é", "😀", " ", "-", "+", "+1 (499) 555-6503", "10.0.0.1", "1.2.3.4.5", "256.1.1.1", "000255.1.1.01", "4111 1111 1111 1111", "4111-1111-1111-1112", "79927398713", "+49 30 1234567", "()", "%+-", "ab", "7", "\n", "9999999999.1.1.1"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(40)))


def test_patterns_match_plain_ones(spark):
    rng = random.Random(2)
    texts = [random_text(rng) for _ in range(1500)] + [None, "", "a" * 5_000, "1 " * 50_000, "a@" + "b." * 50_000 + "c", "+1" + " " * 100_000, ".".join(["1"] * 50_000)]
    texts += ["".join(f"é{k}@mail.example.com " for k in range(5000))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.base] for r in pii.found_spans(docs).collect()}
    for k, text in enumerate(texts):
        assert got[k] == slow_spans(text), text and text[:200]


def test_patterns_are_linear(spark):
    """Long texts that a pattern tried at every place would go through once for each of them, and many words."""
    texts = ["a" * 1_000_000, "1" * 1_000_000, "+1" + "-" * 1_000_000, "x@" * 200_000, "é" * 1_000_000, "1.1.1.1 " * 20_000, "word " * 100_000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert [len(r.base) for r in sorted(pii.found_spans(docs).collect())] == [0, 0, 0, 0, 0, 20_000, 0]


def slow_terms(docs, how):
    """Disclosed share and kind of every term, by the definitions."""
    near, all_terms = defaultdict(list), Counter()
    for text in docs:
        all_terms.update(w.lower() for w in re.findall(rf"[^\W\d_]{{{how.least_letters},}}", text))
        for k, kind in enumerate(pii.KINDS):
            matches = list(re.finditer(PLAIN[kind], text))
            edges = [0, *[e for m in matches for e in (m.start(), m.end())], len(text)]
            pieces = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
            for n, m in enumerate(matches):
                if slow_valid(kind, m[0]):
                    value = m[0].lower() if kind == "email" else m[0] if kind == "ip" else re.sub("[^0-9]", "", m[0])
                    before, behind = (re.findall(r"[^\W\d_]+", pieces[n + d]) for d in (0, 1))
                    words = before[-how.reach :] + behind[: how.reach]
                    near[k, value].append([w.lower() for w in words if len(w) >= how.least_letters])
    total, out = all_terms.total(), {}
    for (k, _), lists in near.items():
        n_e, both = sum(map(len, lists)), Counter(w for ws in lists for w in ws)
        for t, n in both.items():
            if len({tuple(ws) for ws in lists if t in ws}) >= how.support and n_e < total:
                share = math.log(min(n, all_terms[t]) * total / (n_e * all_terms[t])) / math.log(total / n_e)
                if share >= how.generalise - 1e-12 and share > out.get(t, (-1, 0))[0]:
                    out[t] = (share, k)
    return out


@pytest.mark.parametrize("limit", [pii.BROADCAST_TERMS, 0])
def test_terms_that_disclose(spark, monkeypatch, limit):
    """A nickname that stands by one address only is found where the address is not; common words are left alone."""
    monkeypatch.setattr(pii, "BROADCAST_TERMS", limit)
    rng = random.Random(4)
    common = [f"w{a}{b}" for a in "abcdefghij" for b in ("one", "two", "three")]
    some = lambda n: " ".join(rng.choice(common) for _ in range(n))
    docs = [f"{some(20)} Zorblatt {some(2)} carl@x.org {some(3)} ÜBERMUT {some(20)}" for _ in range(9)]
    docs += [f"{some(9)} übermut {some(9)}" for _ in range(3)] + [f"{some(30)} zorblatt {some(5)}"] + [some(60) for _ in range(60)]
    docs += [f"{some(3)} passage that is copied by dora@x.org with qwertz and more {some(0)}"] * 40 + [f"call +49 30 1234567{k} {some(8)}" for k in range(9)]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id long, text string")
    found = pii.found_spans(table)
    want = slow_terms(docs, pii.DISCLOSURE)
    assert {"zorblatt"} <= set(want) <= {"zorblatt", "übermut"} and "qwertz" not in want
    for r in found.collect():
        text = docs[r.doc_id]
        spans = [(m.start(), 4 + (want[m[0].lower()][0] >= 0.95), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", text) if m[0].lower() in want]
        assert [(s.start, s.kind, s.end) for s in r.added] == spans
    clean = {r.doc_id: r.text for r in pii.sanitised(table.withColumns({"key": F.lit(1), "base": F.lit(2), "__cuts": F.lit(3)})).collect()}
    for k, text in enumerate(docs):
        assert not re.search("zorblatt|@x.org|49 30", clean[k], re.I)
        if not slow_spans(text) and not any(t in text.lower() for t in want):
            assert clean[k] == text
    loose = Disclosure(reach=3, least_letters=4, support=2, generalise=0.5, remove=2.0)
    got = {r.term: r.disclosed for r in pii.revealing_terms(table, pii.with_spans(table, "text", "spans", loose).select("doc_id", "spans"), loose).collect()}
    plain = slow_terms(docs, loose)
    assert got.keys() == plain.keys() and all(abs(got[t] - plain[t][0]) < 1e-9 for t in got)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "mail a@b.cc now"), (None, "mail a@b.cc now"), (None, "other"), (3, "plain text"), (3, "ip 1.2.3.4!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("start", "words", "spans", "email_matches", "KEY")})
    got = sorted(map(str, [(r.doc_id, pii_spans) for r in pii.found_spans(docs).collect() for pii_spans in [[(s.start, s.kind, s.end) for s in r.base]]]))
    assert got == sorted(map(str, [(k, slow_spans(t)) for k, t in rows]))
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns
    assert sorted(map(str, [(r.doc_id, r.text) for r in clean.collect()])) == sorted(map(str, [(k, t and t.replace("a@b.cc", "<email>").replace("1.2.3.4", "<ip>")) for k, t in rows]))
    assert pii.found_spans(docs.limit(0)).count() == 0 and pii.sanitised(docs.limit(0)).count() == 0


def test_query_spells_spans(spark, sf):
    from episodica.sources.tables import table

    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in pii.op11_personal_data(spark, sf).collect():
        spans = slow_spans(texts[r.doc_id])
        said = ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in spans) for n in range(4)]
        assert [s for s in r.spans.split(",") if s and s.split(":")[0] in pii.KINDS] == [s for s in said.split(",") if s]
