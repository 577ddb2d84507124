"""Merkle manifest, centroid clustering and HyperMinHash against brute force; messy and empty tables."""

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from kelvingrid.llm import clustering, hyperminhash, merkle
from kelvingrid.llm.ngram_join import Threshold

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, level int, pos long, grp string, w string"


def h(text):
    return sha256(text.encode()).hexdigest()


# Merkle manifest


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return h("".join(map(field, (row[0], row[3], row[2], row[4], text))))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    out = []
    for nodes in tree[:-1]:
        begin = i // 16 * 16
        out.append(("".join(nodes[begin:i]), "".join(nodes[i + 1 : begin + 16])))
        i //= 16
    return out


def manifest_by_hand(rows):
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    groups = defaultdict(list)
    for r in rows:
        tampered = r[0] is not None and crc32(str(r[0]).encode()) % 5 == 0
        changed = leaf(r, None if r[1] is None else r[1].translate(lower)) if tampered else None
        groups[r[3]].append((r[0], leaf(r, r[1]), changed))
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for k in names:
        groups[k].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2] or ""))
    trees = {k: levels([x[1] for x in groups[k]]) for k in names}
    top = levels([trees[k][-1][0] for k in names])
    out = []
    for j, k in enumerate(names):
        for i, (doc, own, changed) in enumerate(groups[k]):
            path = siblings(trees[k], i) + siblings(top, j)
            folded = changed or own
            for a, b in path:
                folded = h(a + folded + b)
            out.append((str(doc), own, trees[k][-1][0], top[-1][0], h("".join(a + b for a, b in path)), folded, folded == top[-1][0]))
    return sorted(out)


def manifest(df):
    found = merkle.lower_case_versions(df)
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found.collect())


def test_manifest_against_brute_force(spark, monkeypatch):
    """Blocks of 16 leaves, so that groups span several stages of blocks; ties, nulls, 20 sources and a hot one."""
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rng = random.Random(1)
    rows = [(i, f"Text {rng.randint(0, 99)} É", "en", "hot", 7, 1, 2, "g", "w") for i in range(700)]
    rows += [(i, "UP low", None, f"s{i % 20}", None, 1, 2, "g", "w") for i in range(40)]
    rows += [(5, "same id", "de", "hot", 1, 1, 2, "g", "w"), (5, "same id", "de", "hot", 1, 1, 2, "g", "w"), (None, "A", "de", "hot", 1, 1, 2, "g", "w")]
    rows += [(9, None, None, None, None, None, None, None, None), (None,) * 9, (None,) * 9, (3, "", "", "", 0, 1, 2, "g", "w"), (4, "x" * 300_000, "en", "é", 300_000, 1, 2, "g", "w")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DDL).repartition(5)
    assert manifest(df) == manifest_by_hand(rows)


def test_manifest_of_one_leaf_and_of_none(spark, messy, no_docs):
    one = [(10, "AbC", "en", "s", 3, 1, 2, "g", "w")]
    assert manifest(spark.createDataFrame(one, DDL)) == manifest_by_hand(one)
    assert merkle.lower_case_versions(no_docs).count() == 0
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in messy.collect()]
    assert manifest(messy) == manifest_by_hand(rows)


def test_versions_share_untouched_nodes(spark):
    rows = [(i, f"T{i}", "en", "s", 2, 1, 2, "g", "w") for i in range(100)]
    found = merkle.lower_case_versions(spark.createDataFrame(rows, DDL)).collect()
    for r in found:
        tampered = crc32(str(r.doc_id).encode()) % 5 == 0
        assert len(r.copied) == (2 if tampered else 0) and r.verified == (not tampered)
        assert not tampered or r.copied[-1] == r.folded_root


# centroid clustering


def lloyd(vectors, k=16, rounds=3):
    """vectors: (vec_id, whole components), rows in any order."""
    digest = lambda v: (v[0] is None, "" if v[0] is None else h(f"1:{v[0]}"), v[1])
    centroids = [list(w) for _, w in sorted(vectors, key=digest)[:k]]
    near = lambda w: min((sum((a - b) ** 2 for a, b in zip(w, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, w in vectors:
            held[near(w)[1]].append(w)
        for c, members in held.items():
            centroids[c] = [sum(x) // len(members) for x in zip(*members)]
    return [(v, near(w)[1], near(w)[0], h(",".join(map(str, centroids[near(w)[1]])))) for v, w in vectors]


def whole(x):
    return [int(np.floor(64 * float(np.float32(c)))) for c in x]


def test_clusters_against_full_scans(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (20, 64))
    good = [(i, (centres[i % 20] + rng.normal(0, 0.25, 64)).astype(np.float32).tolist()) for i in range(600)]
    good += [(7, good[0][1]), (7, good[3][1]), (None, good[5][1]), (601, [1000.0] * 64), (602, [-3.5] * 64)]
    bad = [(700, None), (701, [0.1] * 63), (702, [0.1] * 63 + [None]), (703, [float("nan")] * 64), (704, [float("inf")] + [0.0] * 63), (705, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in good + bad], "vec_id long, embedding array<float>, cluster string, distance int").repartition(4)
    rows = clustering.cluster_report(df).collect()
    want = lloyd([(v, whole(x)) for v, x in good])
    key = lambda x: tuple(map(str, x))
    assert sorted([(r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in rows], key=key) == sorted(want, key=key)
    assert {r.inertia for r in rows} == {sum(w[2] for w in want)}
    assert all(r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster) for r in rows)
    assert np.mean([r.scanned for r in rows]) < 8


def test_few_equal_and_no_vectors(spark):
    ddl = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(i, [0.5] * 64) for i in range(3)], ddl)
    assert [(r.cluster, r.distance, r.inertia) for r in clustering.cluster_report(same).collect()] == [(0, 0, 0)] * 3
    assert clustering.cluster_report(spark.createDataFrame([], ddl)).count() == 0
    with pytest.raises(Exception, match="too large"):
        clustering.cluster_report(spark.createDataFrame([(1, [1e30] * 64)], ddl)).collect()


def test_drift_bounds_hold_and_are_tighter_than_the_drift():
    rng = np.random.default_rng(4)
    old = rng.integers(-200, 200, (6, 8))
    new = old + rng.integers(-30, 30, (6, 8))
    new[2] = old[2]
    radius = rng.uniform(10, 150, 6)
    bound = clustering.drift_bounds(old, new, radius)
    for i in range(6):
        step = rng.normal(size=(4000, 8))
        x = old[i] + step / np.linalg.norm(step, axis=1)[:, None] * radius[i] * rng.uniform(0, 1, (4000, 1)) ** (1 / 8)
        for j in range(6):
            gain = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
            assert gain.max() <= bound[i, j] + 1e-9
    drift = np.linalg.norm(new - old, axis=1)
    assert (bound <= drift[None, :] + 1e-5).all() and (bound < 0.9 * drift[None, :]).any() and (bound[:, 2] == 0).all()


# HyperMinHash


def groups_by_hand(rows, n=3, num=85):
    sets = []
    for _, text in rows:
        words = [w.translate(str.maketrans(merkle.UPPER, merkle.LOWER)) for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set()))
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= num * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((root(rows[x][0]), root(rows[y][0])))
                label[b] = a
    return {i: (len(s), root(i), root(i) == i) for (i, _), s in zip(rows, sets)}


def near_rows():
    rng = random.Random(11)
    word = lambda: rng.choice(["Alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]) + str(rng.randint(0, 60))
    rows, passage = [], [word() for _ in range(40)]
    for n in (2, 3, 5, 8, 12, 40, 150, 700):
        base = [word() for _ in range(n)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, n // 60, n // 25])):
                copy[rng.randrange(n)] = word()
            rows.append(" ".join(copy))
    rows += [" ".join(passage + [word() for _ in range(rng.randint(3, 12))]) for _ in range(60)]  # a crowd that shares a passage
    rows += [None, "", " \t ", "one", "ONE", "a b c", "a b c d", "A  b\nC"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n long, comp string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in hyperminhash.near_duplicates(df).collect()}
    assert got == groups_by_hand(rows)


def test_tiles_alone_find_every_link(spark, monkeypatch):
    """Without stars, with tiles of three probes: buckets are compared in full across components."""
    monkeypatch.setattr(hyperminhash, "STAR_ROUNDS", 0)
    monkeypatch.setattr(hyperminhash, "TILE_ROWS", 3)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in hyperminhash.near_duplicates(df).collect()}
    assert got == groups_by_hand(rows)


def test_messy_and_empty_documents(spark, messy, no_docs):
    rows = hyperminhash.near_duplicates(messy).collect()
    assert len(rows) == messy.count() and hyperminhash.near_duplicates(no_docs).count() == 0
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_shingles == by_id[2].n_shingles == by_id[3].n_shingles == 0 and by_id[1].kept
    assert by_id[6].component_id == 5 and not by_id[6].kept and by_id[5].kept


def test_registers_and_estimates():
    value = np.array([1, 2, 3, 1 << 63, (1 << 63) - 1, (1 << 64) - 1, 0xABCD << 40], np.uint64)
    for v, r in zip(value.tolist(), hyperminhash.compressed(value).tolist()):
        zeros = min(64 - v.bit_length(), 62)
        assert r >> 10 == zeros + 1
        if zeros < 54:
            assert r & 1023 == v >> (v.bit_length() - 11) & 1023
    rng = np.random.default_rng(2)
    for share, n in ((0.85, 4000), (0.5, 4000), (0.0, 4000)):
        found = []
        for _ in range(30):
            common = int(round(2 * n * share / (1 + share)))
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(np.r_[pool[:common], pool[n : 2 * n - common]])
            r = hyperminhash.registers(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]))
            e, used = hyperminhash.estimates(r[:1], r[1:], np.array([n]), np.array([n]))
            assert hyperminhash.plausible(e, used, 0.85)[0] == (share > 0.8) or 0.6 < e[0]
            found.append(e[0])
        assert abs(np.mean(found) - share) < 0.03
    assert Threshold(85, 100).least_overlap(20, 20) == 19
