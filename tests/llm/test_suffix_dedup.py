import hashlib
import random

import numpy as np
import pytest

from featloom.llm import suffix_dedup
from featloom.llm.suffix_dedup import column_order, dedup


def brute(rows, length):
    """By definition: first holder of each string, then covered bytes."""
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        if doc_id is None:
            continue
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            first[s] = min(first.get(s, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        off = [False] * len(data)
        if doc_id is not None:
            for i in range(len(data) - length + 1):
                if first[data[i : i + length]] < doc_id:
                    off[i : i + length] = [True] * length
        runs = sum(1 for i, x in enumerate(off) if x and (i == 0 or not off[i - 1]))
        kept = bytes(b for b, x in zip(data, off) if not x)
        out.append((doc_id, len(data), sum(off), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, length):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted((tuple(r) for r in dedup(df, length).collect()), key=str)


def made_rows(seed, n=60):
    pick = random.Random(seed)
    words = ["".join(pick.choice("abcé\0 ") for _ in range(pick.randrange(1, 9))) for _ in range(30)]
    passages = [" ".join(pick.choice(words) for _ in range(pick.randrange(8, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [
            pick.choice(passages)[pick.randrange(20):] if pick.random() < 0.5
            else " ".join(pick.choice(words) for _ in range(pick.randrange(40)))
            for _ in range(pick.randrange(5))
        ]
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("length", [16, 50])
def test_against_definition(spark, length):
    rows = made_rows(length)
    rows += [(100, rows[7][1]), (101, None), (102, ""), (103, "short"), (None, rows[7][1]), (3, rows[8][1])]
    rows += [(104, "ab" * 300), (105, "a" * 400), (106, "a" * 49), (107, "x" + "a" * 60), (3, rows[3][1])]
    pick = random.Random(1)
    pick.shuffle(rows)
    assert got(spark, rows, length) == brute(rows, length)


def test_long_texts_in_parts(spark, monkeypatch):
    pick = random.Random(3)
    text = "".join(pick.choice("abcdefgh ") for _ in range(5000))
    rows = [(1, text), (2, text[:2000] + "ZZ" + text[2500:]), (3, text[700:1600])]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    number, place = [], []
    for part in suffix_dedup._parts(text.encode(), 50):
        n, p, *_ = suffix_dedup.anchors([(0, *part)], 50)
        number += n.tolist()
        place += p.tolist()
    whole = suffix_dedup.anchors([(0, text.encode(), 0, 0, len(text))], 50)[1].tolist()
    assert place == whole
    monkeypatch.undo()
    assert got(spark, rows, 50) == brute(rows, 50)


def test_column_order_is_suffix_order():
    pick = np.random.default_rng(5)
    pieces = pick.integers(97, 99, (40, 30)).astype(np.uint8)
    for column, order, shared in column_order(pieces, 20):
        rows = [bytes(pieces[i, column:]) for i in order]
        assert rows == sorted(rows)
        for i in range(1, len(rows)):
            same = next((k for k, (x, y) in enumerate(zip(rows[i - 1], rows[i])) if x != y), len(rows[i]))
            assert shared[i] == min(same, 20)


def test_empty_table_and_other_columns(spark):
    schema = "doc_id bigint, text string, body string, marks int"
    assert dedup(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "x" * 60, "b", 1), (2, "x" * 60, None, None)]
    assert [r.n_removed for r in dedup(spark.createDataFrame(rows, schema)).orderBy("doc_id").collect()] == [0, 60]
