import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from kelvingrid.llm import ngram_join
from kelvingrid.llm.common import flat_utf8
from kelvingrid.llm.components import component_labels
from kelvingrid.llm.shingles import shingle_sets


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


class Union:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        while self.parent.setdefault(x, x) != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def brute(rows):
    sets, union = [(i, shingles(t)) for i, t in rows], Union()
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                union.join(i, j)
    return {i: (len(s), union.find(i)) for i, s in sets}


def near_copies(n, words, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(words)] = f"z{rng.randrange(99)}"
        out.append((1000 * seed + i, " ".join(w[: rng.randint(words * 2 // 3, words)])))
    return out


def test_shingle_hashes_stand_for_sets():
    rng = random.Random(2)
    parts = ["a", "A", "b", "é", "É", "  ", "\t", "\x0b", "word", "WoRd", "\n", "x y", "\x1c", "\x85"]
    texts = [None, "", " ", "a", "a b c d", "a b c d e", "A B C D E f"] + [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(800)]
    hashes, offsets = shingle_sets(*flat_utf8(pa.array(texts)))
    seen = {}
    for i, t in enumerate(texts):
        got, want = tuple(hashes[offsets[i] : offsets[i + 1]].tolist()), shingles(t)
        assert len(got) == len(want) and list(got) == sorted(set(got))
        assert seen.setdefault(want, got) == got


def test_signature_bound_never_undercuts():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = np.unique(rng.choice(pool, rng.integers(1, 300))), np.unique(rng.choice(pool, rng.integers(1, 300)))
        blobs = ngram_join.signatures(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]))
        x = ngram_join.stack_signatures(blobs, 8 * min(map(len, blobs)))
        assert ngram_join.overlap_at_most(x[0], x[1], len(a), len(b)) >= len(np.intersect1d(a, b))


@pytest.mark.parametrize("kind", ["chain", "random", "stars"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {
        "chain": [(i, i + 1) for i in range(40)], "random": [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(90)],
        "stars": [(7, i) for i in range(60)] + [(200, i) for i in range(55, 120)],
    }[kind]
    union = Union()
    for a, b in edges:
        union.join(a, b)
    got = {r.node: r.label for r in component_labels(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(x, x) == union.find(x) for e in edges for x in e)


def test_against_brute_force(spark, monkeypatch):
    rows = near_copies(70, 60, 1) + near_copies(40, 25, 2) + near_copies(15, 8, 3) + [(1, None), (2, ""), (3, " "), (4, "a b c"), (5, "A b  c"), (6, "a b")]
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 8)  # tiles are divided here
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows) and len(got) == len(rows)


def test_completeness_without_seeds(spark, monkeypatch):
    """The tiles alone find every component."""
    rows = near_copies(50, 40, 4) + near_copies(30, 12, 5)
    verified = ngram_join.verified
    calls = []

    def none_first(pairs, *rest):
        calls.append(1)
        return verified(pairs.limit(0) if len(calls) == 1 else pairs, *rest)

    monkeypatch.setattr(ngram_join, "verified", none_first)
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_messy_documents(messy, no_docs):
    got = ngram_join.similar_components(messy).collect()
    of = defaultdict(set)
    for r in got:
        of[r.doc_id].add((r.n_shingles, r.component_id))
    assert len(got) == messy.count()
    assert of[1] == {(0, 1)} and of[2] == {(0, 2)} and of[3] == {(0, 3)} and of[5] == {(1, 5)} and of[6] == {(1, 5)}
    assert ngram_join.similar_components(no_docs).count() == 0


def test_representatives_stay(messy):
    kept = ngram_join.keep_representatives(messy)
    assert kept.columns == messy.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 2, 3, 4, 5, 7, 8, 9]


def test_shared_tokens_across_batches(spark):
    rng = random.Random(9)
    rows = sorted((rng.randrange(12), 2 * rng.randrange(3) + 1) for _ in range(60))
    sets = defaultdict(set)
    for t, w in rows:
        sets[t].add(w)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = ngram_join._shared_tokens(spark.createDataFrame(rows, "token long, who long").coalesce(1)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == sorted((t, w) for t, ws in sets.items() if len(ws) > 1 for w in ws)


def test_bounded_pairs_hold_every_link(spark, monkeypatch):
    """The bound before verification drops no link, drops pairs that share little, and works a few pairs at a time."""
    monkeypatch.setattr(ngram_join, "BOUND_ROWS", 5)
    rows = near_copies(20, 60, 6) + near_copies(10, 90, 7) + [(1, None), (2, "a b"), (3, "A  b")]
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    links = {(a, b) for a, b in pairs if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    docs, limit = spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.Threshold()
    got = {(r.a, r.b) for r in ngram_join.bounded(spark.createDataFrame(pairs, "a long, b long"), docs, 5, limit).collect()}
    assert links <= got
    far = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) * 2 < len(sets[a] | sets[b])]
    assert far and not {p for p in far if sets[p[0]] and sets[p[1]]} & got
    exact = {(r.a, r.b) for r in ngram_join.verified(spark.createDataFrame(sorted(got), "a long, b long"), docs, 5, limit).collect()}
    assert exact == links
