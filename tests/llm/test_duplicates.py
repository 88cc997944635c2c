"""Near duplicates, repeated lines and passages, and the pipeline."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from llm.conftest import EDGES, SF_DIR, frame
from logvigil.llm import links, near_dedup, passages
from logvigil.llm.components import components
from logvigil.llm.line_dedup import LEAST_RARITY, dedup_lines, hashed_lines, matching, overlapping
from logvigil.llm.near_dedup import near_duplicates
from logvigil.llm.passages import bounds, centres, passages_between, ranked, repeated_passages, run_hashes
from logvigil.llm.stages import Stages, table


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, size):
    w = words(text)
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_components(texts, size, percent=80):
    sets, holders, shared = {i: shingle_set(t, size) for i, t in texts}, defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for x in s:
            for j in holders[x]:
                shared[j, i] += 1
            holders[x].append(i)
    label = {i: i for i in sets}
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((label[a], label[b]))
            label = {i: low if v == high else v for i, v in label.items()}
    return {(i, len(sets[i]), label[i], label[i] == i) for i in sets}


def found_components(docs, size):
    return {tuple(r)[:4] for r in near_duplicates(docs, size, 80).collect()}


def test_near_duplicates(documents, rows, size=4):
    expected = brute_components([(r.doc_id, r.text) for r in rows], size)
    assert found_components(documents, size) == expected
    assert any(not kept for *_, kept in expected)


def copies(n, seed=0):
    """Copies of a text with one to four changed words, and a chain where only neighbours link."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    out = []
    for i in range(n):
        text = base[:]
        for _ in range(rng.randrange(1, 5)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10_000)}"
        out.append((i, " ".join(text)))
    chain = [f"c{i}" for i in range(400)]
    return out + [(10_000 - i, " ".join(chain[i * 8:i * 8 + 120])) for i in range(12)]


def test_group_of_copies_and_chain(spark):
    texts = copies(60)
    assert found_components(frame(spark, texts), 4) == brute_components(texts, 4)


def test_remaining_pairs_settle_what_hubs_miss(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 8)
    texts = copies(24, seed=4)
    found = {tuple(r)[:4] for r in near_duplicates(frame(spark, texts), 4, 80, hub_turns=0).collect()}
    assert found == brute_components(texts, 4)


def test_pairs_grow_with_copies(spark, monkeypatch):
    """Pairs taken to hubs and links found for 400 and 1,200 near copies: threefold, not ninefold."""
    counted = defaultdict(dict)
    kept = near_dedup.Stages.keep
    for n in (400, 1200):
        def keep(self, df, name="stage", n=n):
            held = kept(self, df, name)
            counted[name][n] = held.count()
            return held

        monkeypatch.setattr(near_dedup.Stages, "keep", keep)
        near_duplicates(frame(spark, copies(n)), 4, 80).collect()
        assert counted["may-link"][n] <= 2 * counted["buckets"][n] and counted["more-links"][n] < n
    for name in ("hub-pairs", "buckets"):
        assert counted[name][1200] <= 4 * max(counted[name][400], 100)


def test_near_duplicate_edges(edges, nothing):
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(edges, 4, 80).collect()}
    by_id = defaultdict(list)
    for i, *rest in found:
        by_id[i].append(tuple(rest))
    for i in (2, 3, 4):
        assert by_id[i] == [(0, i, True)]
    assert by_id[None] == [(9, None, True)]
    assert {c for _, c, _ in by_id[5]} == {5} and {k for *_, k in by_id[5]} == {True}
    assert by_id[7][0][1:] == (6, False) and by_id[6][0][1:] == (6, True)
    assert near_duplicates(nothing).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)]
    links = spark.createDataFrame(chain + star + [(5, 5), (7, 7)], "a long, b long")
    found = dict(map(tuple, components(links, Stages(spark)).collect()))
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}


def test_patience_diff():
    assert matching([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert matching([1, 1, 2, 3], [5, 1, 1, 2, 6, 3]) == [(0, 1), (1, 2), (2, 3), (3, 5)]
    assert matching([], [1]) == matching([1], [2]) == []
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = matching(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_lines_leave_later_documents_only(documents, rows):
    holders, after = defaultdict(set), defaultdict(set)
    plain = lambda line: " ".join(line.split())
    texts = {r.doc_id: r.text for r in rows}
    for i, t in texts.items():
        for line in t.split("\n"):
            holders[plain(line)].add(i)
    found = dedup_lines(documents).collect()
    assert len(found) == len(rows) and any(r.dedup.n_removed for r in found)
    for r in found:
        lines, gone = texts[r.doc_id].split("\n"), set(r.dedup.removed)
        assert r.text == "\n".join(x for i, x in enumerate(lines) if i not in gone)
        assert all(min(holders[plain(lines[i])]) < r.doc_id for i in gone if plain(lines[i]))
        for line in r.text.split("\n"):
            after[plain(line)].add(r.doc_id)
    assert set(after) | {""} == set(holders) | {""}


def test_exact_copies_lose_all_lines_at_any_rarity(spark):
    """A third of a small table, one-line texts and lines too short to tell anything."""
    four = "the first line of it\n\nthe second line of it\nthe third line of it\nthe fourth"
    texts = [(i, f"own text of document {i} here\nand {i * 7} more") for i in range(130)]
    texts += [(1000 + i, four if i % 2 else four.replace("\n\n", "\n")) for i in range(70)]
    texts += [(2000 + i, "a single line of text, twice here") for i in range(2)] + [(3000 + i, "ok\nno") for i in range(3)]
    found = {r.doc_id: r for r in dedup_lines(frame(spark, texts)).collect()}
    for i, t in texts:
        if i in (1000, 2000, 3000) or i < 1000:
            assert found[i].text == t
        else:
            assert not found[i].text.strip() and found[i].dedup.n_removed >= 1


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(1)
    pool = [f"line number {i} of some length" for i in range(60)]
    texts = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own line {i} {j} here" for j in range(10)))
             for i in range(40)]
    found = {r.doc_id: r.dedup.removed for r in dedup_lines(frame(spark, texts), least_rarity=0.0).collect()}
    first = {}
    for i, t in texts:
        for line in t.split("\n"):
            first.setdefault(line, i)
    for i, t in texts:
        lines, expected = t.split("\n"), set()
        for other in {first[x] for x in lines} - {i}:
            expected |= {j for _, j in matching(dict(texts)[other].split("\n"), lines)}
        assert found[i] == sorted(expected)


def test_line_dedup_sums_rarity_over_real_pairs(spark):
    rare = [f"a line {i} that few documents hold" for i in range(6)]
    own = lambda i, n: [f"own line {i} {j} of a document" for j in range(n)]
    texts = [(0, [*own(0, 3), rare[0]]), (1, [rare[1], *own(1, 2)]), (2, [*own(2, 1), rare[2]]),
             (10, rare[:3]), (11, [*own(11, 1), *rare[:3]]), (12, [rare[0], *own(12, 1), rare[3]]),
             (13, [*rare[:3], *own(13, 2)]), (14, [rare[2], *own(14, 3)])]
    texts += [(100 + i, own(100 + i, 2)) for i in range(60)]
    held = defaultdict(set)
    for i, ls in texts:
        for line in ls:
            held[line].add(i)
    rarity = {x: math.log(len(texts) / len(h)) for x, h in held.items() if len(h) > 1}
    expected = {i: set() for i, _ in texts}
    for later, right in texts:
        for first, left in texts:
            if first < later and sum(rarity.get(x, 0) for x in set(left) & set(right)) >= LEAST_RARITY:
                expected[later] |= {j for _, j in matching(left, right)}
    found = dedup_lines(frame(spark, [(i, "\n".join(ls)) for i, ls in texts])).collect()
    assert {r.doc_id: set(r.dedup.removed) for r in found} == expected
    assert expected[11] == {1, 2, 3} and expected[13] == {0, 1, 2} and not expected[10] and not expected[14]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_of_overlapping_documents_have_a_partner(spark, seed):
    """Documents that share lines whose first holders are others, in no order the same neighbours."""
    rng = random.Random(seed)
    pool = [f"a line {i} that many documents hold" for i in range(60)]
    texts = [(i, "\n".join(rng.sample(pool, rng.randint(8, 14)))) for i in range(120)]
    lines = hashed_lines(frame(spark, texts)).drop("body")
    found = {(r.doc_id, r.first) for r in overlapping(lines, LEAST_RARITY, Stages(spark)).collect()}
    sets, holders = {i: set(t.split("\n")) for i, t in texts}, defaultdict(int)
    for s in sets.values():
        for x in s:
            holders[x] += 1
    over = {(i, j) for i in sets for j in range(i)
            if sum(math.log(len(sets) / holders[x]) for x in sets[i] & sets[j]) >= LEAST_RARITY}
    assert found <= over and len(over) > 500
    for i, s in sets.items():
        shared, met = ({x for j in sets if (i, j) in pairs for x in s & sets[j]} for pairs in (over, found))
        assert shared == met


def test_line_dedup_edges(edges, nothing):
    found = dedup_lines(edges, least_rarity=0.5).collect()
    assert len(found) == len(EDGES)
    by_id = {r.doc_id: r for r in found if r.doc_id != 5}
    assert by_id[2].text is None and by_id[3].text == "" and by_id[2].dedup.n_lines == 0
    assert by_id[10].text == "A third line." and by_id[10].dedup.removed == [0]
    assert by_id[7].dedup.n_removed > 0 and by_id[None].dedup.n_removed == 0
    assert all(r.dedup.n_removed == 0 for r in found if r.doc_id == 5)
    assert all(r.kept == "x" and r.key == "x" for r in found)
    assert dedup_lines(nothing).collect() == []


def test_compact_windows():
    rng = random.Random(3)
    import numpy as np
    tokens = np.array([0, *[rng.randrange(1, 50) * 2 + 1 for _ in range(200)], 0], np.uint64)
    ranks = ranked(tokens, 1)
    for width in (5, 30):
        places, keys = centres(ranks, width)
        left, right = bounds(places, keys, len(tokens))
        held = {(int(l), int(c), int(r)) for l, c, r in zip(left, places, right, strict=True)}
        for start in range(len(tokens) - width + 1):
            for end in (start + width - 1, min(len(tokens), start + width + 20) - 1):
                least = start + int(np.argmin(keys[start:end + 1]))
                assert sum(l <= start <= c <= end <= r for l, c, r in held) == 1
                assert any(c == least and l <= start and end <= r for l, c, r in held)


def test_passages(documents, rows):
    found = repeated_passages(documents).collect()
    held = {r.doc_id: words(r.text) for r in rows}
    covered, first = defaultdict(list), {}
    for r in found:
        a, b = held[r.doc_id][r.start:r.end], held[r.first_doc_id][r.first_start:r.first_end]
        sa, sb = (shingle_set(" ".join(x), 5) for x in (a, b))
        assert r.first_doc_id < r.doc_id and min(len(a), len(b)) >= 50 and len(sa & sb) >= 0.75 * len(sa | sb)
        covered[r.doc_id].append((r.start, r.end))
    for i, w in held.items():
        for s in range(len(w) - 49):
            run = tuple(w[s:s + 50])
            if first.setdefault(run, i) < i:
                assert any(a <= s and s + 50 <= b for a, b in covered[i])


@pytest.mark.parametrize("heavy", [10_000, 2])
def test_near_copies_of_passages(spark, monkeypatch, heavy):
    monkeypatch.setattr(passages, "HEAVY", heavy)
    rng = random.Random(5)
    fill = lambda n: [f"f{rng.randrange(10 ** 9)}" for _ in range(n)]
    passage = [f"p{i}" for i in range(90)]
    changed = passage[:]
    changed[40] = "other"
    texts = [(i, " ".join(fill(30 + i) + (changed if i % 3 == 0 else passage) + fill(40))) for i in range(12)]
    texts += [(50 + i, " ".join(fill(200))) for i in range(10)] + [(70, " ".join(fill(30) + passage[:40] + fill(30)))]
    found = repeated_passages(frame(spark, texts)).collect()
    assert {r.doc_id for r in found} == set(range(1, 12))


def test_matching_without_unique_elements():
    p = list(range(100, 160))
    for left, right in (([1, *p, *p, 2], [3, *p, 4]), ([3, *p, 4], [1, *p, *p, 2]), ([1, *p, *p, 2], [3, *p, *p, 4])):
        assert len(matching(left, right)) == (120 if len(left) == len(right) else 60)


def test_passages_repeated_within_a_document(spark):
    rng = random.Random(8)
    fill = lambda n: [f"f{rng.randrange(10 ** 9)}" for _ in range(n)]
    p, q = ([f"{x}{i}" for i in range(n)] for x, n in (("p", 64), ("q", 80)))
    texts = [
        fill(20) + p + fill(20) + q + q + fill(10), fill(5) + p + p + fill(5), fill(3) + q + p + q + p + q + fill(70),
        fill(9) + q + fill(60) + q + p + fill(1), p + p + p + p,
    ]
    found = repeated_passages(frame(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()
    first, checked = {}, 0
    for i, t in enumerate(texts):
        for s in range(len(t) - 49):
            run = tuple(t[s:s + 50])
            if first.setdefault(run, i) < i:
                assert any(r.doc_id == i and r.start <= s and s + 50 <= r.end for r in found), (i, s)
                checked += 1
    assert checked > 300


def test_passages_whose_first_token_holders_lack_them(spark):
    """Every five words of the passage stand in earlier documents that hold half of it."""
    rng = random.Random(3)
    fill = lambda n: [f"f{rng.randrange(10 ** 9)}" for _ in range(n)]
    passage = [f"p{i}" for i in range(60)]
    texts = [(i, " ".join(fill(50) + passage[i % 3 * 15:i % 3 * 15 + 30] + fill(50))) for i in range(24)]
    texts += [(100 + i, " ".join(fill(20 + i) + passage + fill(30))) for i in range(4)]
    found = repeated_passages(frame(spark, texts)).collect()
    assert {(r.doc_id, r.first_doc_id, r.start, r.end, r.first_start) for r in found} == {
        (100 + i, 100, 20 + i, 80 + i, 20) for i in range(1, 4)}


def test_runs_an_alignment_leaves():
    run, gap = list(range(100, 150)), [1, 2, 3]
    left, right = [*run, *gap, *run[:20]], [*run[:20], 9, *run]
    found = passages_between(left, right, 46, 80, [(0, 21)])
    assert any(p[0] <= 0 and p[1] >= 50 for p in found)


def test_run_hashes():
    tokens = np.array([*range(1, 60), 0, *range(1, 60)], np.uint64)
    for width in (1, 2, 7, 46):
        found = run_hashes(tokens, width)
        assert len(found) == len(tokens) - width + 1 and (found[:60 - width] == found[60:]).all()
        assert len(set(found.tolist())) == len(found) - (60 - width)


def test_passage_edges(edges, nothing):
    found = repeated_passages(edges).collect()
    assert {(r.doc_id, r.first_doc_id) for r in found} == {(7, 6)}
    assert max(r.n_words for r in found) >= 119_990
    assert repeated_passages(nothing).collect() == []


def test_pipeline(spark, documents, rows):
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES:
        docs = Stages(spark).keep(stage(spark, docs, SF_DIR), "stage")
        kept.append(docs)
    for docs in kept[:-1]:
        assert docs.columns == documents.columns
    counts = [x.count() for x in kept[:-1]]
    assert len(rows) >= counts[0] >= counts[1] >= counts[2] >= counts[3] > 0.5 * len(rows)
    assert {r.doc_id for r in kept[-1].collect()} == {r.doc_id for r in kept[3].collect()}
    assert all(r.n_chars == len(r.text) for r in kept[1].collect() if r.text)


def test_pipeline_stages_on_edges(spark, edges, nothing):
    for docs in (edges, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF_DIR)
            assert out.columns == docs.columns
            assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}


def test_pipeline_stage_decisions(spark):
    benchmark = table(spark, SF_DIR, "benchmark").orderBy("item_id").first().text
    docs = frame(spark, [(1, benchmark), (2, "clean words only"), (3, "x " * 3000 + benchmark[:30]), (4, None)])
    left = corpus_pipeline.decontaminate(spark, docs, SF_DIR)
    assert {r.doc_id for r in left.collect()} == {2, 3, 4}
    texts = copies(20)
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, frame(spark, texts), SF_DIR).collect()}
    assert kept == {i for i, _, _, k in brute_components(texts, 5) if k}
