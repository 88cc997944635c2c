"""Decontamination and personal data against plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest

from llm.conftest import EDGES, SF_DIR, frame
from logvigil.llm.decontaminate import contamination
from logvigil.llm.pii import find_personal_data, personal_data_digest, redact
from logvigil.llm.stages import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected_hits(docs, items, n=13):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1)):
            if w:
                windows[tuple(w[i:i + n])].add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (held := windows.get(tuple(w[i:i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= held
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def digest_rows(found):
    return sorted(map(repr, (tuple(r)[:6] for r in found.collect())))


@pytest.mark.parametrize("slice_windows", [500_000, 100])
def test_contamination(spark, documents, rows, slice_windows):
    benchmark = table(spark, SF_DIR, "benchmark")
    found = contamination(documents, benchmark, slice_windows=slice_windows)
    expected = expected_hits([(r.doc_id, r.text) for r in rows], [tuple(r) for r in benchmark.collect()])
    assert digest_rows(found) == sorted(map(repr, expected))
    assert any(r[-1] for r in expected)


@pytest.mark.parametrize("slice_windows", [500_000, 1])
def test_contamination_edges(spark, edges, slice_windows):
    items = [(1, "quick brown FOX"), (2, None), (3, ""), (10, "lazy dog"), (10, "lazy dog"), (4, "été 你好")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as doc_id", "'x' as window")
    found = contamination(edges, benchmark, slice_windows=slice_windows)
    assert digest_rows(found) == sorted(map(repr, expected_hits(EDGES, items)))


def test_contamination_of_nothing(spark, nothing, edges):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert contamination(nothing, benchmark).collect() == []
    assert not any(r.contaminated for r in contamination(edges, benchmark).collect())


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: max(map(int, m[0].split("."))) <= 255,
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15}[kind]():
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


TRICKY = [
    (1, "a@b.c_d@e.f x@@y.z a@b.c.d. é@q.r ..@a-b.co a@b@c.d"),
    (2, "1.2.3.45.6.7.8 0255.1.1.1 256.1.1.1 1.2.3.4.5 00.0.0.0 😀9.9.9.9"),
    (3, "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 4111 1111  1111 1111 5 5"),
    (4, "+27 (11) 555-0100 ext +1+2 +123456789012345678 +1 555 010 9999 +49.30.123456"),
    (5, "mail me: é jo@example.org, card 4111111111111111, IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432"),
    (6, "a." * 30_000 + "@x"), (7, "1" * 30_000), (8, "1." * 20_000), (9, "+1" + " 1" * 20_000), (10, "a@b" + ".c" * 20_000),
    (11, None), (12, ""),
]


def test_personal_data(spark, documents, rows):
    texts = {r.doc_id: r.text for r in rows} | {-i: t for i, t in TRICKY}
    found = personal_data_digest(documents.select("doc_id", "text")).collect()
    found += personal_data_digest(frame(spark, [(-i, t) for i, t in TRICKY])).collect()
    assert len(found) == len(texts)
    for r in found:
        expected = spans(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in expected)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), r
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(
            sum(k == kind for k, _, _ in expected) for kind in PATTERNS)
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("iban")) == listed


def test_check_sums_and_context(spark):
    text = dict(TRICKY)[5]
    docs = frame(spark, [(1, text), (2, text.replace("DE89", "DE88")), (3, "jo@example.org")])
    found = {r.doc_id: r.found for r in find_personal_data(docs).collect()}
    assert [s["kind"] for s in found[1]] == ["email", "card", "iban", "iban"]
    assert [s["kind"] for s in found[2]] == ["email", "card", "iban"]
    assert text[found[1][2]["start"]:found[1][2]["end"]] == "DE89 3704 0044 0532 0130 00"
    assert found[1][0]["score"] > found[3][0]["score"]


def test_redaction_and_edges(spark, edges, nothing):
    assert redact(frame(spark, [(1, "to jo@example.org.")])).first().text == "to <email>."
    assert personal_data_digest(nothing).collect() == []
    assert len(personal_data_digest(edges).collect()) == len(EDGES)
