"""MinHash groups against brute force."""

import math
import random

import numpy as np
import pytest

from featloom.llm import minhash

DOCS = "doc_id bigint, text string, id string, n int, hub string, kept string"


def set_slow(text, size=2):
    words = (text or "").encode().lower().split()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def groups_slow(rows, size=2, percent=80):
    sets = [set_slow(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared) and shared:
                root[find(i)] = find(j)
    out = {}
    for i, (doc_id, _) in enumerate(rows):
        out.setdefault(find(i), []).append(doc_id)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in out.items()}
    return [(doc_id, len(sets[i]), least[find(i)], doc_id == least[find(i)]) for i, (doc_id, _) in enumerate(rows)]


def prose(pick, n):
    return [f"w{int(pick.paretovariate(0.7))}" for _ in range(n)]


def copy_of(pick, words, share):
    return [pick.choice(["x", "y", "z"]) + str(pick.randrange(900)) if pick.random() < share else w for w in words]


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "a", 1, "b", None) for i, t in rows], DOCS)
    out = minhash.group(docs, **options)
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def test_groups_against_brute_force(spark):
    pick = random.Random(2)
    base, rows = [prose(pick, pick.randrange(1, 200)) for _ in range(25)], []
    for i in range(260):
        words = copy_of(pick, base[pick.randrange(25)], pick.choice([0, 0.02, 0.05, 0.08, 0.12]))
        rows.append((1000 - i, (pick.choice([" ", "\n", "\t "])).join(words).upper()))
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, "one"), (2004, "ONE "), (2005, "é É"), (2006, "É é")]
    rows += [rows[0], rows[5], (None, rows[7][1]), (None, "nobody else has this"), (1, "longer " * 70_000)]
    assert ordered(run(spark, rows)) == ordered(groups_slow(rows))


def test_a_hot_group_is_found_whole(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SETS", 16)
    pick = random.Random(4)
    base = prose(pick, 160)
    rows = [(i, " ".join(copy_of(pick, base, pick.choice([0.01, 0.03, 0.05, 0.07])))) for i in range(220)]
    rows[7] = (7, " ".join(base))
    chain = prose(pick, 100)
    for i in range(300, 340):
        chain = copy_of(pick, chain, 0.02)
        rows.append((i, " ".join(chain)))
    expected = groups_slow(rows)
    assert len({r[2] for r in expected}) > 5 and sum(r[2] == 0 for r in expected) > 50
    assert ordered(run(spark, rows)) == ordered(expected)


@pytest.mark.parametrize(("shingle", "percent"), [(1, 90), (5, 80)])
def test_other_parameters(spark, shingle, percent):
    pick = random.Random(6)
    base = [prose(pick, 120) for _ in range(6)]
    rows = [(i, " ".join(copy_of(pick, base[i % 6], pick.choice([0.0, 0.01, 0.04])))) for i in range(90)]
    got = run(spark, rows, shingle=shingle, percent=percent)
    assert ordered(got) == ordered(groups_slow(rows, shingle, percent))


def test_empty_table(spark):
    assert run(spark, []) == []


def test_pruning_keeps_good_pairs():
    least = minhash.least_matches()
    n = minhash.BATCH
    for places, m in zip(range(n, minhash.HASHES + 1, n), least):
        tail = sum(math.comb(places, k) * 0.8**k * 0.2 ** (places - k) for k in range(m))
        assert tail < 1e-5 and m > 0.3 * places


def test_signatures_estimate_similarity():
    pick = np.random.default_rng(1)
    a = pick.integers(0, 1 << 63, 4000, dtype=np.uint64)
    sets = [np.unique(a[:3000]), np.unique(a[500:]), np.unique(a[:10]), np.unique(a[:100_000])]
    signed = minhash.signatures(sets)
    assert abs((signed[0] == signed[1]).mean() - 2500 / 4000) < 0.12
    assert (minhash.signatures(sets[:1])[0] == signed[0]).all()
