"""The prefix trie, toxicity and collocations against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidweave.llm import collocations, common, conversation_trie, toxicity

SF = "/root/testdata/sf0.1"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute_trie(rows, graft=True):
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in by.items()}
    made = own
    if graft:
        made = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            made[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, v in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(v) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, v in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in v if len(made[c]) == len(k)))
        out.append((min(v), len(k), min(members[k[:-1]]) if k else None, len(v), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_of(spark, rows, graft=True):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("conv", "pos", "name", "key", "d", "_at", "_pid", "chars", "n", "owner")})
    return sorted((tuple(r) for r in conversation_trie.conversation_trie(frame, graft=graft).collect()), key=repr)


def test_trie_equals_brute_force(spark):
    draw = random.Random(5)
    rows = [(c, t, draw.choice(["user", "assistant"]), draw.choice(["a", "b", "é😀"])) for c in [*range(190, 215), *range(3), -7, -150, 400] for t in range(draw.randrange(12))]
    # No conversation, turns without number, role or text, ties, repeated rows, copies, a long conversation of one turn over and over.
    rows += [(None, 0, "user", "x"), (500, None, "user", "first"), (500, 1, None, None), (500, 1, None, None), (501, 1, "user", "tie"), (501, 1, "user", "tied"), (501, 1, "assistant", "tie"), (600, 0, "user", "")]
    rows += [(700 + i, t, "user", f"copy {t}") for i in range(40) for t in range(7)]
    rows += [(900, t, "user", "again") for t in range(150)] + [(901, t, "user", "again" if t < 133 else "other") for t in range(140)] + [(902, 0, "user", "x" * 300_000)]
    assert trie_of(spark, rows) == brute_trie(rows)
    assert trie_of(spark, rows, graft=False) == brute_trie(rows, graft=False)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "user", "x")]) == []
    # Conversation 4 takes 5 turns of conversation 0, which isn't there, and has fewer of its own.
    assert zlib.crc32(b"4") % 6 > 0
    assert trie_of(spark, [(4, 0, "user", "gone")]) == brute_trie([(4, 0, "user", "gone")])


def test_sums_and_digests_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK_BITS", 2)
    rows = [(c, t, "user", f"turn {t}") for c in range(30) for t in range(9 + c % 3)]
    assert trie_of(spark, rows, graft=False) == brute_trie(rows, graft=False)


def test_places_go_on_from_task_to_task(spark):
    """One group holds most rows, and these are all equal but for their order."""
    rows = spark.range(5000).select(F.when(F.col("id") < 4500, 1).otherwise(F.col("id")).alias("g"), (F.col("id") % 3).alias("o"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table, stretches = common.numbered(rows, "g", ["o"], common.Scratch(spark))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    placed = table.join(stretches, ["_pid", "g"]).select("g", "o", (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos")).collect()
    ones = sorted((r["pos"], r["o"]) for r in placed if r["g"] == 1)
    assert [p for p, _ in ones] == list(range(4500)) and [o for _, o in ones] == sorted(o for _, o in ones)
    assert all(r["pos"] == 0 for r in placed if r["g"] != 1)
    assert table.where("g = 1").select("_pid").distinct().count() > 1


def brute_collocations(rows, least=10, first=2000):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    counts["und" if lang is None else lang][" ".join(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        phrases = {p: a for p, a in c.items() if a >= least and " " in p}
        inside = {q for p, a in phrases.items() if p.count(" ") == 2 for q in (p.rpartition(" ")[0], p.partition(" ")[2]) if 100 * a >= 50 * phrases[q]}
        best = []
        for p, a in phrases.items():
            if p not in inside:
                w = p.split(" ")
                cuts = [(c[" ".join(w[:k])], c[" ".join(w[k:])], k) for k in range(1, len(w))]
                score, _, left, right = min((10**6 * a * a // (x * y), k, x, y) for x, y, k in cuts)
                best.append((-score, -a, p.encode(), left, right))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:first], 1)]
    return sorted(out)


def collocations_of(spark, rows, **options):
    frame = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit("clash") for c in ("phrase", "f", "n", "rank", "_p", "w", "score", "doc_id")})
    return sorted(tuple(r) for r in collocations.collocations(frame, **options).collect())


def test_collocations_equal_brute_force(spark):
    draw = random.Random(9)
    words = ["The", "of", "bid", "ÄRA", "ära", "a b", "x" * 50_000, "\x1c", "0", "😀"]
    texts = ["".join(draw.choice(words[:5] + [draw.choice(words)]) + draw.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(draw.randrange(60))) for _ in range(60)]
    rows = [(t, draw.choice(["en", "de", None, "und", ""])) for t in texts] + [(None, "en"), ("", "en"), (" \t .. \n", "fr"), ("only one", "it")] + [("again and again " * 3000, "la")] * 3
    for options in ({}, {"first": 3}):
        got = collocations_of(spark, rows, **options)
        assert got == brute_collocations(rows, **options) and got
    assert collocations_of(spark, []) == []


def test_long_texts_are_split_between_words(spark, monkeypatch):
    for size in (1, 7, 64):
        monkeypatch.setattr(collocations, "AT_ONCE", size)
        monkeypatch.setattr(collocations, "TOGETHER", size * 10)
        grams, counts, total = collocations.counted(["One two  three. four\tfive, SIX seven", "eight"], "en", 1, [])
        assert dict(zip(grams, counts)) == {w: 1 for w in b"one two three four five six seven eight".split()} and total == 8


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """Where all bits are set, the passes count more and find the same."""
    monkeypatch.setattr(collocations.Filter, "has", lambda self, lang, grams: np.ones(len(grams), bool))
    rows = [(t, "en") for t in ["the bid is open. the bid is closed", "a bid of the state"] * 12]
    assert collocations_of(spark, rows) == brute_collocations(rows)


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_000
    found = [spark.createDataFrame([("en", "a", big), ("en", "b", big + 7)], "lang string, phrase string, f long"), spark.createDataFrame([("en", "a b", big - 1)], "lang string, phrase string, f long")]
    assert collocations.scored(found, 2).first()["score"] == 10**6 * (big - 1) ** 2 // (big * (big + 7))


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


#: Disguises and what stands behind them; none of the words is named in the operator.
DISGUISED = [
    ("m0r0n", "moron"), ("$tup1d", "stupid"), ("tr@sh", "trash"), ("d1sgust1ng", "disgusting"), ("w0rthl3ss", "worthless"), ("i d i o t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("p-a-t-h-e-t-i-c", "pathetic"),
    ("stuuuupid", "stupid"), ("clooown", "clown"), ("TRAAASH", "trash"), ("l o s e r", "loser"), ("s c u m", "scum"), ("m.0.r.0.n", "moron"),
]


@pytest.mark.parametrize("hidden,word", DISGUISED)
def test_disguises_are_restored(model, hidden, word):
    restorer = toxicity.Restorer(model.characters)
    for text in (hidden, f"they are a {hidden}, and of the {hidden}!!"):
        assert re.findall(r"[^\W\d_]+", restorer.text(text)).count(word) == (1 if text == hidden else 2)


@pytest.mark.parametrize("text", ["", "   ", "It is the time.", "version 2.0 at 10:30, call 555-1234", "the state's $500 bid | a list | of parts", "well-known words and good books", "Oueand$$$ thth%%%"])
def test_plain_texts_stay(model, text):
    assert toxicity.Restorer(model.characters).text(text) == text


def test_decoding_is_the_best_of_all_paths(model):
    symbol = toxicity._symbols()

    def paths(nodes):
        if not nodes:
            yield "", 0.0
            return
        for text, cost in nodes[0]:
            for rest, more in paths(nodes[1:]):
                yield text + rest, cost + more

    def likelihood(text):
        a = b = 0
        total = 0.0
        for c in text + " ":
            s = int(symbol[ord(c)])
            if s or b:
                total += float(model.characters[a, b, s])
            a, b = (b, s) if s else (0, 0)
        return total

    for span in ("1d10t", "s.t.u.p.1.d", "aa11!!b", "l0o0ser", "x$y$z"):
        best = max(likelihood(t) - cost for t, cost in paths(toxicity._lattice(span)))
        found = toxicity.decode(span, model.characters)
        assert best == pytest.approx(max(likelihood(t) - c for t, c in paths(toxicity._lattice(span)) if t.strip() == found), abs=1e-4)


def test_held_out_documents(spark, model):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id)
    toxic, clean = rows[rows.toxic == 1].score.values, rows[rows.toxic == 0].score.values
    assert np.mean([(clean < s).mean() + (clean == s).mean() / 2 for s in toxic]) > 0.95
    assert (toxic >= 0.5).mean() > 0.85 and (clean >= 0.5).mean() < 0.01


def test_words_in_disguise_count_as_toxic(spark, model, documents):
    plain = "of the and in that it is for the with an and of the "
    texts = {1: plain * 4, 2: plain + " ".join(w for _, w in DISGUISED) + plain, 3: plain + " ".join(h for h, _ in DISGUISED) + plain}
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(documents(list(texts.items())), model).collect()}
    assert scores[1] < 0.2 and scores[2] > 0.5 and abs(scores[3] - scores[2]) < 0.3


def test_toxicity_of_odd_rows(spark, model, documents, edges):
    rows = toxicity.score(documents(edges), model).collect()
    assert len(rows) == len(edges) and rows[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.score(documents([]), model).count() == 0


def test_toxicity_without_labels(spark, documents):
    docs = documents([(i, f"text number {i}") for i in range(20)])
    for labels in ([], [(1, None), (None, 1)], [(i, 0) for i in range(20)], [(i, 1) for i in range(20)]):
        known = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r["predicted"] for r in toxicity.score(docs, known).collect()} == {0}
    assert toxicity.score(docs, toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))).count() == 20


def test_characters_are_counted_over_all_texts(spark, documents):
    counts = toxicity.count_characters(documents([(1, "ab ab"), (2, "AB"), (3, None)]))
    a_b = toxicity.SYMBOLS + 2
    assert counts[a_b] == 3 and counts.sum() == 9


@pytest.mark.parametrize("text", ["1" * 300_000, "1a" * 100_000, "a.b." * 60_000, "a " * 100_000, "x" * 1_000_000, "!a" + "b" * 500_000, "aaab" * 50_000])
def test_long_disguises_take_bounded_time(model, text):
    start = time.monotonic()
    toxicity.Restorer(model.characters).text(text)
    assert time.monotonic() - start < 20
