from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bidweave.llm import exact_dedup, ngram_join, substring_dedup
from bidweave.llm.components import connected
from bidweave.llm.ngram_join import shingles, together, word_hashes, words_of

#: The words that operators see, as a pattern.
WORD = re.compile(r"[^\W_]+")


def words(rng, n, vocabulary=2000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, own, changes):
    out = list(own)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    """Families of near copies, exact copies, and unrelated texts."""
    rng = random.Random(4)
    rows, i = [], 0
    for _ in range(12):
        base = words(rng, 120)
        for _ in range(rng.randint(1, 6)):
            rows.append((i, " ".join(edited(rng, base, rng.randint(0, 3)))))
            i += 1
    for _ in range(30):
        rows.append((i, rows[rng.randrange(len(rows))][1] if rng.random() < 0.3 else " ".join(words(rng, 60))))
        i += 1
    return rows


def brute_classes(rows, threshold=0.8):
    sets = defaultdict(list)
    for d, t in rows:
        sets[shingles(t or "", 5).tobytes()].append(d)
    keys = [k for k in sets if k]
    grams = [set(np.frombuffer(k, np.uint64).tolist()) for k in keys]
    parent, links = list(range(len(keys))), [0] * len(keys)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            both = len(grams[a] & grams[b])
            if both >= threshold * (len(grams[a]) + len(grams[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for i, k in enumerate(keys):
        least[find(i)] = min([least.get(find(i), 10**9), *sets[k]])
    out = {}
    for i, k in enumerate(keys):
        for d in sets[k]:
            out[d] = (least[find(i)], links[i], len(sets[k]))
    for d in sets.get(b"", []):
        out[d] = (d, 0, 1)
    return out


def test_near_duplicates_equal_brute_force(documents, corpus):
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in ngram_join.near_duplicates(documents(corpus)).collect()}
    assert got == brute_classes(corpus)


@pytest.mark.parametrize("dense", [4, 0])
def test_large_groups_are_compared_in_blocks(documents, monkeypatch, dense):
    """A family larger than a chunk: every pair of chunks of the component (or, where it is sparse, of each
    bucket) is a block, and no link is lost or counted twice."""
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    rng = random.Random(9)
    base = words(rng, 150)
    rows = [(i, " ".join(edited(rng, base, 2))) for i in range(45)] + [(100 + i, " ".join(words(rng, 50))) for i in range(5)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in ngram_join.near_duplicates(documents(rows)).collect()}
    assert got == brute_classes(rows)


def test_long_texts_are_compared_in_smaller_blocks(documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_GRAMS", 300)
    rng = random.Random(10)
    base = words(rng, 150)
    rows = [(i, " ".join(edited(rng, base, 2))) for i in range(20)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in ngram_join.near_duplicates(documents(rows)).collect()}
    assert got == brute_classes(rows)


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.9), (0.9, 0.99999)):
        bands, rows = ngram_join.choose_bands(threshold, recall)
        assert bands * rows <= 128 and 1 - (1 - threshold**rows) ** bands >= recall


@pytest.mark.parametrize(("k", "window"), [(5, 10), (25, 26), (6, 1), (6, 45)])
def test_seeds_of_many_texts_are_those_of_each(k, window):
    draw = random.Random(k * window)
    size = lambda i: draw.choice([0, 1, k, k + window - 2, k + window - 1, k + window, 300])
    texts = [" ".join(draw.choices("aÉσжΣxyz" if i % 3 else "ab", k=size(i))) for i in range(60)]
    texts += ["ΑΣ", "", "İstanbul ΟΔΟΣ", " x", "same " * 200]
    own, counts = words_of(texts)
    each = [word_hashes(t) for t in texts]
    assert counts.tolist() == [len(w) for w in each] and (own == np.concatenate(each)).all()
    h, at, text = substring_dedup.seeds_of(own, counts, k, window)
    for i, words in enumerate(each):
        one_h, one_at = substring_dedup.seeds(words, k, window)
        assert h[text == i].tolist() == one_h.tolist() and at[text == i].tolist() == one_at.tolist()
    assert [x for lo, hi in together(texts, 100) for x in texts[lo:hi]] == texts


def test_near_duplicates_edges(documents, edges):
    out = ngram_join.near_duplicates(documents(edges)).collect()
    assert len(out) == len(edges)
    by_id = defaultdict(list)
    for r in out:
        by_id[r["doc_id"]].append((r["class_id"], r["n_links"], r["n_copies"]))
    assert by_id[1] == [(1, 0, 1)] and by_id[4] == [(4, 0, 1)]
    assert by_id[5] == [(5, 0, 3)] and by_id[6] == [(5, 0, 3)] * 2
    assert ngram_join.near_duplicates(documents([])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40) if i % 7 != 6] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(15)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    got = {r["node"]: r["label"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(documents, edges, keep):
    rows = [*edges, (20, "same"), (21, "same"), (22, "same "), (23, "Same")]
    out = exact_dedup.exact_dedup(documents(rows), keep=keep).collect()
    assert len(out) == len(rows)
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    best = {t: (max if keep == "largest" else min)([d for d in ds if d is not None], default=None) for t, ds in groups.items()}
    for r in out:
        text = next(t or "" for d, t in rows if d == r["doc_id"])
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best[text], len(groups[text]), r["doc_id"] == best[text])
        assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert exact_dedup.exact_dedup(documents([])).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(documents([]), keep="first")


def test_distinct_documents(documents, edges):
    docs = documents(edges)
    out = exact_dedup.distinct_documents(docs, keep="largest")
    assert out.columns == docs.columns
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert got == {(2, ""), *[(d, t) for d, t in edges if t and d not in (5,)]}


def passages_of(rows, **kw):
    return substring_dedup.repeated_passages(rows, **kw).collect()


def test_passages_cover_every_exact_repeat(documents):
    rng = random.Random(8)
    shared = [words(rng, n) for n in (50, 55, 80, 200)]
    rows = []
    for i in range(60):
        own = words(rng, rng.randint(20, 300))
        if i % 3:
            p = shared[rng.randrange(4)]
            at = rng.randrange(len(own))
            own = own[:at] + p + own[at:]
        rows.append((i, " ".join(own)))
    out = passages_of(documents(rows))
    first = {}
    for d, t in rows:
        own = WORD.findall(t)
        for i in range(len(own) - 49):
            first.setdefault(tuple(own[i : i + 50]), d)
    spans = defaultdict(list)
    for r in out:
        spans[r["doc_id"]].append((r["start_word"], r["end_word"]))
        assert r["n_words"] >= 50 and r["identity"] >= 0.8 and r["doc_id"] != r["source_id"]
    for d, t in rows:
        own = WORD.findall(t)
        repeats = [i for i in range(len(own) - 49) if first[tuple(own[i : i + 50])] != d]
        assert all(any(a <= i and i + 50 <= b for a, b in spans[d]) for i in repeats)
        if not repeats:
            assert not spans[d]


def test_fuzzy_passage_is_found_and_short_ones_are_not(documents):
    rng = random.Random(11)
    base = words(rng, 120)
    changed = [w if i % 20 else f"x{i}" for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(words(rng, 40) + changed + words(rng, 40))), (3, " ".join(words(rng, 30) + base[:40] + words(rng, 30)))]
    out = passages_of(documents(rows))
    assert [(r["doc_id"], r["source_id"]) for r in out] == [(2, 1)]
    assert out[0]["n_words"] >= 110 and 0.9 < out[0]["identity"] < 1


@pytest.mark.parametrize(("n", "between"), [(60, 100), (100, 60), (100, 200)])
def test_passages_with_other_text_between_are_both_found(documents, n, between):
    rng = random.Random(n + between)
    one, two = words(rng, n, 10**6), words(rng, n, 10**6)
    rows = [(d, " ".join(words(rng, 30, 10**6) + one + words(rng, between, 10**6) + two + words(rng, 30, 10**6))) for d in (1, 2)]
    out = passages_of(documents(rows))
    assert sorted((r["start_word"], r["end_word"], r["identity"]) for r in out) == [(30, 30 + n, 1.0), (30 + n + between, 30 + 2 * n + between, 1.0)]


def has_passage(a, b, least=50, identity=0.8):
    """By brute force: a stretch of least words on one diagonal, with words of identity in place."""
    for shift in range(-len(b), len(a)):
        same = [0]
        for i in range(len(a)):
            same.append(same[-1] + (0 <= i - shift < len(b) and a[i] == b[i - shift]))
        for i in range(len(a) - least + 1):
            if any(same[j] - same[i] >= identity * (j - i) - 1e-9 for j in range(i + least, len(a) + 1)):
                return True
    return False


def changed_passages(rng, trials):
    """(words of one text, words of another) with a passage of 50 to 80 words in common of which 5 to 15 % are changed."""
    for _ in range(trials):
        base, share = words(rng, rng.randint(50, 80), 10**6), rng.choice([0.05, 0.1, 0.15])
        other = list(base)
        for i in rng.sample(range(len(base)), round(share * len(base))):
            other[i] = f"x{rng.randrange(10**6)}"
        yield tuple(words(rng, 30, 10**6) + p + words(rng, 30, 10**6) for p in (base, other))


def test_alignment_goes_on_through_changed_words():
    """From the longest unchanged run alone, every passage is found that brute force finds."""
    rng = random.Random(21)
    pairs = list(changed_passages(rng, 40))
    texts, aligned = [], []
    for a, b in pairs:
        x, y = (np.array([hash(w) & 0xFFFFFFFF for w in t], np.uint32) for t in (a, b))
        same = np.flatnonzero(x[: min(len(x), len(y))] == y[: min(len(x), len(y))])
        runs = np.split(same, np.flatnonzero(np.diff(same) != 1) + 1)
        run = max(runs, key=len)
        texts.append((x, y))
        aligned.append(substring_dedup.align(x, y, [(int(run[0]), int(run[0]), len(run))]))
    found = [bool(substring_dedup.parts(xs, ys, 50, 0.8)) for xs, ys, _, _ in substring_dedup.extended(aligned, texts)]
    assert found == [has_passage(a, b) for a, b in pairs] and sum(found) > 30


def test_alignment_goes_on_through_skipped_words():
    x, y = np.arange(60, dtype=np.uint32), np.delete(np.arange(60, dtype=np.uint32), [8, 20, 45])
    (xs, ys, _, _), = substring_dedup.extended([substring_dedup.align(x, y, [(25, 23, 10)])], [(x, y)])
    assert (x[xs] == y[ys]).all() and len(xs) == 57
    assert substring_dedup.parts(xs, ys, 50, 0.8) == [(0, 60, 0, 57, 0.95)]


def test_passage_whose_pieces_came_first_in_other_documents_is_found(documents):
    rng = random.Random(31)
    rows, want = [], set()
    for case in range(20):
        joined, i = words(rng, 60, 10**6), 10 * case
        for d, piece in ((1, joined[:30]), (2, joined[30:]), (3, joined), (4, joined)):
            rows.append((i + d, " ".join(words(rng, 40, 10**6) + piece + words(rng, 40, 10**6))))
        want.add((i + 4, i + 3, 40, 100, 1.0))
    got = {(r["doc_id"], r["source_id"], r["start_word"], r["end_word"], r["identity"]) for r in passages_of(documents(rows))}
    assert got == want


@pytest.mark.parametrize("after", [False, True])
def test_passage_that_came_earlier_in_scattered_bits_is_found_whole(documents, after):
    """Bits of 14 words that overlap came before (and between) the two documents that share 200 words."""
    rng = random.Random(51)
    passage = words(rng, 200, 10**6)
    bits = lambda base: [(base + i, " ".join(words(rng, 40, 10**6) + passage[6 * i : 6 * i + 14] + words(rng, 40, 10**6))) for i in range(32)]
    whole = lambda d: (d, " ".join(words(rng, 80, 10**6) + passage + words(rng, 80, 10**6)))
    rows = bits(0) + [whole(1000), *(bits(1100) if after else []), whole(2000)]
    out = passages_of(documents(rows))
    assert [(r["doc_id"], r["source_id"], r["start_word"], r["end_word"], r["source_start"]) for r in out] == [(2000, 1000, 80, 280, 80)]


def test_long_passages_are_extended_as_far_as_words_match(documents):
    """All but a few words of a long passage came first elsewhere, so one seed must do for a thousand words."""
    rng = random.Random(52)
    passage = words(rng, 1000, 10**6)
    rows = [(i, " ".join(passage[40 * i : 40 * i + 45] + words(rng, 30, 10**6))) for i in range(25) if i != 12]
    rows += [(d, " ".join(words(rng, 20, 10**6) + passage + words(rng, 20, 10**6))) for d in (100, 200)]
    out = passages_of(documents(rows))
    assert (200, 100, 20, 1020) in {(r["doc_id"], r["source_id"], r["start_word"], r["end_word"]) for r in out}


def test_recall_of_changed_passages(documents):
    rng = random.Random(41)
    pairs = list(changed_passages(rng, 120))
    rows = [(2 * i + j, " ".join(t)) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    got = {(r["doc_id"], r["source_id"]) for r in passages_of(documents(rows))}
    assert got == {(2 * i + 1, 2 * i) for i, (a, b) in enumerate(pairs) if has_passage(a, b)}


def common_words(a, b):
    """Length of the longest common subsequence, cell by cell."""
    row = [0] * (len(b) + 1)
    for w in a:
        corner = 0
        for j, v in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if w == v else max(row[j], row[j - 1])
    return row[-1]


def varied(rng, passage, kind, rate):
    """The passage with words deleted, inserted or replaced at random, or by all three."""
    out = []
    for w in passage:
        how = rng.choice(("delete", "insert", "replace")) if kind == "mixed" else kind
        if rng.random() >= rate:
            out.append(w)
        elif how != "delete":
            out += [*([w] if how == "insert" else []), *words(rng, 1, 3000)]
    return out


def test_recall_of_edits_against_common_subsequences(documents):
    """Deletions, insertions, replacements and mixtures of 5 to 18 %; what a subsequence of 0.8 of at least 50 words proves must be found."""
    rng = random.Random(77)
    rows, want = [], {}
    for kind in ("delete", "insert", "replace", "mixed"):
        for rate in (0.05, 0.1, 0.15, 0.18):
            for _ in range(25):
                passage = words(rng, rng.randint(60, 90), 3000)
                changed = varied(rng, passage, kind, rate)
                if min(len(passage), len(changed)) >= 50 and common_words(passage, changed) >= 0.8 * max(len(passage), len(changed)):
                    want[len(rows) + 1] = (kind, rate)
                for text in (passage, changed):
                    rows.append((len(rows), " ".join(words(rng, rng.randint(20, 80), 3000) + text + words(rng, 50, 3000))))
    got = {(r["doc_id"], r["source_id"]) for r in passages_of(documents(rows))}
    assert all(d == s + 1 and s % 2 == 0 for d, s in got)
    for kind in ("delete", "insert", "replace", "mixed"):
        own = [d for d, (k, _) in want.items() if k == kind]
        assert len(own) > 60 and sum((d, d - 1) in got for d in own) >= 0.97 * len(own), kind


def test_large_gaps_are_aligned_in_halves(monkeypatch):
    rng = random.Random(6)
    a, b = (np.array([rng.randrange(12) for _ in range(n)]) for n in (70, 90))
    whole = len(substring_dedup._common(a, b)[0])
    monkeypatch.setattr(substring_dedup, "CELLS", 50)
    xs, ys = substring_dedup._common(a, b)
    assert len(xs) == whole and (a[xs] == b[ys]).all() and (np.diff(xs) > 0).all() and (np.diff(ys) > 0).all()


def test_passages_edges(documents, edges):
    assert passages_of(documents([])) == []
    assert passages_of(documents([(d, t) for d, t in edges if d != 11])) == []
    twice = "alpha beta gamma delta " * 40
    assert {r["doc_id"] for r in passages_of(documents([(1, twice), (2, twice), (2, twice), (None, twice)]))} == {2}
    rng = random.Random(3)
    shared, other = words(rng, 90), words(rng, 60)
    mixed = [(1, " ".join(shared)), (1, " ".join(other)), (2, " ".join(words(rng, 70) + shared)), (2, "short text"), (2, " ".join(other[:55]))]
    out = passages_of(documents(mixed))
    assert {(r["doc_id"], r["source_id"]) for r in out} == {(2, 1)} and max(r["n_words"] for r in out) == 90


def test_chain_prefers_the_collinear_matches():
    xs, ys = np.array([0, 10, 20, 25, 40, 50]), np.array([100, 110, 120, 7, 141, 151])
    best, other = substring_dedup.chains(xs, ys, reach=15)
    assert best == [(0, 100, 25), (40, 141, 15)] and other == [(25, 7, 5)]
    assert substring_dedup.chains(np.array([0, 500]), np.array([0, 500]), reach=15) == [[(0, 0, 5)], [(500, 500, 5)]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "ab", "b", "é", "1", "٣", "日", "😀", " ", "_", "-", "\n", "A", "Z", "x" * 70, "\0", "ǅ", "İ", "½"]), max_size=25).map("".join) | st.text(max_size=40))
def test_words_are_those_of_the_pattern(text):
    found = WORD.findall(text.lower())
    hashes = word_hashes(text).tolist()
    assert len(hashes) == len(found)
    assert len(set(hashes)) == len(set(found)) == len(set(zip(found, hashes)))
