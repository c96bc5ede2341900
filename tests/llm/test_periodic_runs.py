"""Runs of words against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from featloom.llm import periodic_runs

DOCS = "doc_id bigint, text string, lang string, runs string, collapsed int"


def runs_slow(words, least=6, times=4):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, size, q) for (s, size), q in found.items())


def looped_slow(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def awkward(pick):
    alphabet = [f"w{i}" for i in range(pick.choice([1, 2, 3, 30]))]
    words = []
    while len(words) < pick.randrange(1, 260):
        piece = [pick.choice(alphabet) for _ in range(pick.randrange(1, 30))]
        words += piece * pick.choice([1, 1, 2, 4, 5, 9])
        words += piece[: pick.randrange(len(piece) + 1)]
    return words


@pytest.mark.parametrize("seed", range(60))
def test_runs_against_brute_force(seed):
    words = awkward(random.Random(seed))
    assert [tuple(r) for r in periodic_runs.find_runs(periodic_runs.numbered(words))] == runs_slow(words)


@pytest.mark.parametrize("times", [2, 3, 6])
def test_other_exponents(times):
    for seed in range(20):
        words = awkward(random.Random(100 + seed))
        got = periodic_runs.find_runs(periodic_runs.numbered(words), 2 * times, times)
        assert [tuple(r) for r in got] == runs_slow(words, 2 * times, times)


def test_extensions_against_brute_force():
    pick = random.Random(3)
    for _ in range(30):
        words = np.array([pick.randrange(3) for _ in range(200)] * pick.choice([1, 3]) + [7] * 40)
        n = len(words)
        i, j = np.sort(np.random.default_rng(pick.randrange(99)).integers(0, n + 1, (2, 400)), axis=0)
        i, j = i[i < j], j[i < j]
        slow = [next((k for k in range(n) if b + k >= n or words[a + k] != words[b + k]), n) for a, b in zip(i, j)]
        assert periodic_runs.CommonExtensions(words)(i, j).tolist() == slow


@pytest.mark.parametrize("n", [40, 97, 130, 300])
def test_extensions_between_ranks_far_apart(n):
    """Suffixes of one word repeated are ranked by length, so any distance of ranks occurs."""
    i, j = np.triu_indices(n + 1, 1)
    assert (periodic_runs.CommonExtensions(np.zeros(n, np.int64))(i, j) == n - j).all()


def test_grids_are_looked_at_in_parts(monkeypatch):
    words = awkward(random.Random(11)) * 3
    whole = periodic_runs.find_runs(periodic_runs.numbered(words))
    monkeypatch.setattr(periodic_runs, "GRID", 5)
    assert (periodic_runs.find_runs(periodic_runs.numbered(words)) == whole).all()


def test_digests_against_brute_force(spark):
    pick = random.Random(5)
    rows = [(i, " \n".join(awkward(pick)), "en", "x", 1) for i in range(150)]
    rows += [(i, " ".join(f"a{j}" for j in range(i)), "en", None, 1) for i in range(150, 260)]
    rows += [(300, None, None, None, None), (301, "", "", "", 0), (302, " \t ", "x", "x", 2), (303, "é " * 9, "x", "x", 2)]
    rows += [rows[0], (None, "a " * 50, "en", "x", 1), (400, "long words " * 60_000, "en", "x", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    out = periodic_runs.digests(periodic_runs.collapse(docs, rewrite=periodic_runs.loop_tenth)).collect()
    assert len(out) == len(rows)
    expected = []
    for doc_id, text, *_ in rows:
        words = (text or "").split()
        if doc_id is not None:
            words = looped_slow(doc_id, words)
        runs = [(0, 120_000, 2)] if doc_id == 400 and len(words) == 120_000 and len(set(words)) == 2 else runs_slow(words)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        expected.append((
            doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest(),
        ))
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, out), key=order) == sorted(expected, key=order)


def test_spans_and_texts(spark):
    docs = spark.createDataFrame([("a", "x go go go go go go y"), ("b", None)], "doc_id string, text string")
    got = {r.doc_id: r for r in periodic_runs.collapse(docs).collect()}
    assert [tuple(r) for r in got["a"].runs] == [(1, 6, 1)] and got["a"].collapsed == "x go y"
    assert got["b"].runs == [] and got["b"].collapsed == ""
    assert periodic_runs.collapse(docs.limit(0)).count() == 0
