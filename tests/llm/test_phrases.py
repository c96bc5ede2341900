"""Phrases against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from featloom.llm import phrases

DOCS = "doc_id bigint, text string, lang string, n int, f string, words int, phrase string"


def phrases_slow(rows, least, top):
    total, count = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    good = {key: a for key, a in count.items() if a >= least and len(key[1]) > 1}
    covered = set()
    for (lang, p), a in good.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= 100 * count[lang, p[i : i + k]]:
                    covered.add((lang, p[i : i + k]))
    out = {}
    for (lang, p), a in good.items():
        if (lang, p) in covered:
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = count[lang, p[:k]], count[lang, p[k:]]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right, total[lang]))
    return sorted(
        (lang, i, p.decode(), -a, left, right, n, -score)
        for lang, found in out.items()
        for i, (score, a, p, left, right, n) in enumerate(sorted(found)[:top], 1)
    )


def made(pick, n):
    vocab = ["the", "The", "of", "a", "ñu", "Ñu", "zz", "x y", "q-q", "I'm"] + [f"r{i}" for i in range(300)]
    fixed = ["alpha beta gamma delta epsilon zeta", "new york", "New York city", "a a a a a"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(pick.randrange(0, 30)):
            parts.append(pick.choice(fixed) if pick.random() < 0.3 else vocab[min(int(pick.paretovariate(0.6)) - 1, 309)])
            parts.append(pick.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!? ", "\x0b", "\x0c"]))
        rows.append(("".join(parts), pick.choice(["en", "en", "de", None])))
    return rows


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, lang, 1, "x", 2, "y") for i, (t, lang) in enumerate(rows)], DOCS)
    out = phrases.mine(docs.repartition(3), **options)
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize(("least", "top", "slots", "chunk"), [(5, 2000, 1 << 16, 1 << 20), (20, 7, 1 << 17, 50)])
def test_phrases_against_brute_force(spark, monkeypatch, least, top, slots, chunk):
    monkeypatch.setattr(phrases, "_CHUNK", chunk)
    rows = made(random.Random(least), 400) + [(None, "en"), ("", None), (" . ", "xx"), ("once, twice", "xx")]
    rows += [rows[0]] * 3
    expected = phrases_slow(rows, least, top)
    assert len(expected) > 10
    assert run(spark, rows, least=least, top=top, slots=slots) == expected


def test_more_words_than_slots_stay_exact(spark):
    """When every slot is full nothing is padded early, and nothing changes."""
    rows = made(random.Random(1), 60) + [(" ".join(f"u{i} v{i}" for i in range(60_000)), "en")] * 2
    assert run(spark, rows, least=2, top=50, slots=1 << 16) == phrases_slow(rows, 2, 50)


def test_slots_grow_with_the_words(spark, monkeypatch):
    """A corpus with many words for each slot would fill all of them and pad nothing away."""
    monkeypatch.setattr(phrases, "SLOTS", 1 << 16)
    pick = random.Random(3)
    rows = [(" ".join(f"word{pick.randrange(3000)}" for _ in range(1000)), "en") for _ in range(500)]
    texts = spark.createDataFrame(rows, "text string, lang string")
    slots = phrases.enough_slots(texts, 5)
    assert 500_000 < slots <= phrases.MOST_SLOTS
    assert phrases.enough_slots(texts.limit(0), 5) == 1 << 16
    bits = phrases.frequent_slots(texts, 5, slots)
    assert [int(b) < slots // 50 for b in np.unpackbits(bits, axis=1).sum(axis=1)] == [True] * len(phrases.ORDERS)
    assert run(spark, rows[:40], least=3, top=50) == phrases_slow(rows[:40], 3, 50)


def test_large_counts_are_exact(spark):
    sizes = spark.createDataFrame([("en", 9_000_000_000_000)], "lang string, n bigint")
    rows = [("en", "a b", 2, 700_000_000_007), ("en", "a", 1, 3_000_000_000_001), ("en", "b", 1, 4_999_999_999_999)]
    counted = spark.createDataFrame(rows, "lang string, phrase string, words int, f bigint")
    (got,) = phrases.scored(counted, sizes).collect()
    assert got.score == 1000 * 700_000_000_007 * 9_000_000_000_000 // (3_000_000_000_001 * 4_999_999_999_999)


def test_empty_table(spark):
    assert run(spark, []) == []
