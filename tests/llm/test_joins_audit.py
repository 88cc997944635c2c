"""N-gram Jaccard join, spelling variants and filter audit against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm.conftest import EDGES, SF_DIR, frame
from llm.test_duplicates import brute_components, copies
from logvigil.llm import filter_audit, jaccard_join, links, spelling
from logvigil.llm.filter_audit import RadixTrie, failed_filters, failures
from logvigil.llm.jaccard_join import jaccard_components
from logvigil.llm.queries import op11_spelling_variants, op12_jaccard_join, op13_filter_audit
from logvigil.llm.spelling import (
    cells_in_reach, fit_cells, halves, letter_counts, letters_of, one_edit, pairs_in_reach, spelling_variants, word_counts,
)


# ---- n-gram Jaccard join ----

def linked(texts, size=4, percent=85):
    return {x[:3] for x in brute_components(texts, size, percent)}


def found_links(docs, size=4, percent=85):
    return {tuple(r) for r in jaccard_components(docs, size, percent).collect()}


def test_join_of_the_query(spark, rows):
    expected = linked([(r.doc_id, r.text) for r in rows])
    assert {tuple(r) for r in op12_jaccard_join(spark, SF_DIR).collect()} == expected
    assert any(i != c for i, _, c in expected)


@pytest.mark.parametrize("percent", [70, 85, 100])
def test_join_of_copies_and_a_chain(spark, monkeypatch, percent):
    monkeypatch.setattr(links, "BLOCK", 16)
    monkeypatch.setattr(links, "UNIT", 20)
    texts = copies(90, seed=percent)
    texts += [(20_000 + i, texts[3][1]) for i in range(50)] + [(30_000 + i, f"w{i} x") for i in range(5)]
    assert found_links(frame(spark, texts), 4, percent) == linked(texts, 4, percent)


def test_join_at_the_threshold(spark):
    base = [f"a{i}" for i in range(103)]            # 100 shingles
    texts = [(1, " ".join(base))]
    for i, extra in enumerate(range(14, 22)):
        texts.append((10 + i, " ".join(base + [f"b{i}_{j}" for j in range(extra)])))
    assert found_links(frame(spark, texts)) == linked(texts)
    assert {c for i, _, c in linked(texts) if i >= 10} > {1}


def test_pairs_grow_with_copies_not_their_square(spark, monkeypatch):
    """Pairs taken to hubs and links found for 300 and 900 near copies; the rest are rows of prefixes at most."""
    counted = defaultdict(dict)
    kept = jaccard_join.Stages.keep
    for n in (300, 900):
        def keep(self, df, name="stage", n=n):
            table = kept(self, df, name)
            counted[name][n] = table.count()
            return table

        monkeypatch.setattr(jaccard_join.Stages, "keep", keep)
        jaccard_components(frame(spark, copies(n)), 4, 85).collect()
        assert counted["may-link"][n] <= 2 * counted["postings"][n]
    for name in ("hub-pairs", "postings"):
        assert counted[name][900] <= 4 * max(counted[name][300], 50)
    assert counted["more-links"][900] < 900


def test_join_edges(spark, edges, nothing):
    found = defaultdict(set)
    for i, n, c in found_links(edges):
        found[i].add((n, c))
    for i in (2, 3, 4):
        assert found[i] == {(0, i)}
    assert found[None] == {(9, None)} and found[5] == {(7, 5), (3, 5)}
    assert {c for _, c in found[7]} == {6} == {c for _, c in found[6]} and len(jaccard_components(edges).collect()) == len(EDGES)
    assert jaccard_components(nothing).collect() == []


# ---- spelling variants ----

def brute_variants(rows, every=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            counts[word[:h % len(word)] + word[h % len(word) + 1:] if h % every == 0 else word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    shorter, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            cut = w[:k] + w[k + 1:]
            shorter[k, cut].add(w)
            if cut in counts:
                near[w].add(cut)
                near[cut].add(w)
    for group in shorter.values():
        for a, b in itertools.permutations(group, 2):
            near[a].add(b)
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda x: (-counts[x], x))
        if counts[best] >= 10 * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w
    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def test_variants_of_the_query(spark, rows):
    expected = brute_variants([(r.doc_id, r.text) for r in rows])
    assert {tuple(r) for r in op11_spelling_variants(spark, SF_DIR).collect()} == expected
    assert any(f for _, f, *_ in expected)


def test_variants_in_small_cells_and_blocks(spark, monkeypatch):
    for name, value in (("CELL", 20), ("BLOCK", 7), ("LEAF", 3), ("UNIT", 10), ("HELD", 50)):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(3)
    stems = ["".join(rng.choice("abÀÿ") for _ in range(rng.randrange(7, 11))) for _ in range(60)]
    texts = [(i, " ".join(rng.choice(stems[:1 + rng.randrange(60)]) + rng.choice(["", "", "a", "É"]) for _ in range(40)))
             for i in range(60)]
    expected = brute_variants(texts, every=5)
    assert {tuple(r) for r in spelling_variants(word_counts(frame(spark, texts), drop_every=5)).collect()} == expected
    assert max(len([1 for w, f, *_ in expected if f == x]) for _, x, *_ in expected if x) > 1


def test_roots_follow_chains(spark):
    chain = [("aaaaaaa" + "b" * i + "c" * (5 - i), 10 ** i) for i in range(6)]
    found = {r.word: r for r in spelling_variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert {r.root for r in found.values()} == {"aaaaaaabbbbb"}
    assert found["aaaaaaaccccc"].form == "aaaaaaabcccc" and found["aaaaaaabbbbb"].form is None


def test_variant_edges(spark, edges, nothing):
    found = {tuple(r) for r in spelling_variants(word_counts(edges, drop_every=31)).collect()}
    assert found == brute_variants(EDGES)
    assert spelling_variants(word_counts(nothing)).collect() == []
    long = [(1, "q" * 70_000 + " " + "q" * 70_001), (2, "q" * 70_000 + " " + "q" * 70_001)]
    assert {(len(r.word), r.n_near) for r in spelling_variants(word_counts(frame(spark, long))).collect()} == {
        (70_000, 1), (70_001, 1)}


def test_tree_search():
    rng = random.Random(5)
    draw = lambda k: sorted({bytes(rng.choice(b"abcd\xe9") for _ in range(k)) for _ in range(300)})
    for k in (7, 8):
        shorter, longer = draw(k), draw(8)
        points = letter_counts(longer)
        tree = fit_cells(points, 40)
        own, cells = cells_in_reach(tree, points, 0)
        assert sorted(own) == list(range(len(longer))) and len(set(cells)) > 4
        near = {(a, b) for a, b in itertools.product(range(len(shorter)), range(len(longer)))
                if one_edit(letters_of([shorter[a]]), letters_of([longer[b]]))[0]}
        asked = set(zip(*cells_in_reach(tree, letter_counts(shorter), 2), strict=True))
        cell_of = dict(zip(own, cells, strict=True))
        assert near and all((a, cell_of[b]) in asked for a, b in near)
        here, there = letters_of(shorter), letters_of(longer)
        found = set()
        for i, j in pairs_in_reach(points, letter_counts(shorter), halves(there, k), halves(here, k)):
            ok = one_edit(here[i], there[j])
            found |= set(zip(i[ok].tolist(), j[ok].tolist(), strict=True))
        assert found == near


def test_one_edit():
    pairs = {("abc", "abd"): True, ("abc", "abc"): False, ("abc", "acb"): False, ("abc", "xabc"): True,
             ("abc", "abxc"): True, ("abc", "abcx"): True, ("abc", "axbd"): False, ("aab", "aaab"): True}
    for (a, b), expected in pairs.items():
        assert one_edit(letters_of([a.encode()]), letters_of([b.encode()]))[0] == expected


# ---- filter audit ----

def brute_audit(rows, labels):
    first, marks = {}, defaultdict(set)
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, good, toxic in labels:
        marks[i] |= {name for name, mark in (("good", good), ("toxic", toxic)) if mark == 1}
    docs = []
    for i, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > first[t]}.items() if bad}
        docs.append((part or "", fails, marks[i] if i is not None else set()))
    out = set()
    for part in {p for p, *_ in docs}:
        mine = [d for d in docs if d[0] == part]
        shares = Counter()
        found = []
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                gone = set(order[:step])
                here = [d for d in mine if f in d[1] and not d[1] & gone]
                shares[f] += len(here)
                found.append((f, "".join(order), step + 1, sum(not d[1] & (gone | {f}) for d in mine), len(here),
                              sum(f in d[1] and bool(d[1] & gone) for d in mine), sum(d[1] == {f} for d in mine),
                              sum("good" in d[2] for d in here), sum("toxic" in d[2] for d in here)))
        out |= {(part, *r, shares[f]) for f, *r in found}
    return out


def test_audit_of_the_query(spark, rows):
    labels = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    expected = brute_audit([(r.doc_id, r.text, r.lang) for r in rows], labels)
    assert {tuple(r) for r in op13_filter_audit(spark, SF_DIR).collect()} == expected


def test_audit_of_hot_texts_and_prefixes(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD", 500)
    rng = random.Random(7)
    start = "the same start of very many texts " * 4
    pool = [start + "end " * rng.randrange(4) + "é" * rng.randrange(3) for _ in range(30)] + ["", "#", "ABC", None, "the"]
    rows = [(rng.randrange(150), pool[0] if rng.random() < 0.3 else rng.choice(pool), rng.choice(["en", None, ""]))
            for _ in range(400)]
    docs = spark.createDataFrame(rows + [(None, "ABC", "en"), (None, None, "fr")], "doc_id long, text string, lang string")
    rows += [(None, "ABC", "en"), (None, None, "fr")]
    labels = [(i, i % 2, i % 3) for i in range(0, 150, 2)] + [(4, 1, 1), (4, None, 0)]
    frame_of_labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {tuple(r) for r in filter_audit.filter_audit(docs, frame_of_labels).collect()}
    assert found == brute_audit(rows, labels)


def test_audit_edges(spark, edges, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = {tuple(r) for r in filter_audit.filter_audit(edges, labels).collect()}
    assert found == brute_audit([(i, t, "en") for i, t in EDGES], [])
    assert len(found) == 600 and filter_audit.filter_audit(nothing, labels).collect() == []
    assert sum(r.copies for r in failed_filters(edges).collect()) == len(EDGES)


def test_trie():
    rng = random.Random(2)
    rows = [(bytes(rng.choice(b"ab") for _ in range(rng.randrange(7))), (rng.randrange(50), "p")) for _ in range(500)]
    trie, least, copies_of = RadixTrie(), {}, Counter(rows)
    for text, row in rows:
        trie.insert(text, row)
        least[text] = min(row[0], least.get(text, row[0]))
    found = list(trie.walk())
    assert {(t, r): n for t, r, n, _ in found} == dict(copies_of)
    assert all(repeated == (r[0] > least[t]) for t, r, _, repeated in found)


def test_failures():
    assert failures(b"") == filter_audit.A
    assert failures(("a " * 200).encode()) == filter_audit.B
    assert failures(" ".join(f"w{i}" for i in range(200)).encode()) == 0
    assert failures("éA".encode() * 200 + b" x" * 200) & filter_audit.C
    assert failures(" ".join(f"w{i}" for i in range(200)).encode() + b" |") == filter_audit.D
    assert np.unique([len(steps) for _, steps in filter_audit.filter_orders()]).tolist() == [5]
