"""The registered text queries against their SQL, and the pipeline against brute force."""

import pathlib
import random

import pytest
from parity import compare, connect
from test_operators import components_slow, judged_slow, lines_slow, simhash_slow

import corpus_pipeline
from featloom.llm import language
from featloom.llm.queries import ORACLES, QUERIES

FOLDER = pathlib.Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_parity(spark, name):
    assert compare(QUERIES[name](spark, str(FOLDER)), connect(str(FOLDER)), ORACLES[name]) == []


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))


def test_pipeline_against_brute_force(spark, tmp_path):
    pick = random.Random(13)
    sounds = {"aa": "ka lo mi tu".split(), "bb": "schr ein ung cht".split()}

    def prose(lang, n):
        return " ".join("".join(pick.choice(sounds[lang]) for _ in range(pick.randrange(1, 6))) for _ in range(n))

    items = [(i, prose("aa", 20)) for i in range(4)]
    shared = [[prose("bb", 6) for _ in range(4)] for _ in range(2)]
    rows = []
    for i in range(90):
        lang = pick.choice(list(sounds))
        lines = [prose(lang, pick.randrange(4, 30)) for _ in range(pick.randrange(1, 6))]
        if i % 7 == 0:
            lines += pick.choice(shared)
        if i % 9 == 0:
            lines.append(pick.choice(items)[1].upper())
        if rows and i % 5 == 0:
            lines = [pick.choice(rows)[1] or "x"]
        rows.append((i, "\n".join(lines), lang, pick.choice(["a", "a", "b", None]), 0))
    rows += [(200, None, "aa", "a", 0), (201, "12 34", "aa", "a", 0), (202, "", None, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    profiles = language.learn(docs)
    left = [(r[0], r[1]) for r in rows if profiles.predict(r[1])[0] != "und" and profiles.predict(r[1])[1] >= 0.05]
    assert len(left) == 90
    left = [(int(i), t) for i, _, _, t in lines_slow(left, 3, 50) if t is None or t.split()]
    left.sort()
    group = components_slow([simhash_slow(t) for _, t in left])
    least = {g: min(i for (i, _), h in zip(left, group) if h == g) for g in group}
    left = [(i, t) for (i, t), g in zip(left, group) if least[g] == i]
    dirty = {r[0] for r in judged_slow(left, items) if r[5]}
    assert dirty
    left = [(i, t) for i, t in left if str(i) not in dirty]
    assert sorted(out) == [i for i, _ in left]
    assert all(out[i].size == len(t.split()) for i, t in left)
    by = {}
    for r in out.values():
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert sum(r.size for r in own) == own[0].source_size
        assert sum(r.taken for r in own) == int(own[0].target)


def test_stages_keep_the_columns(spark):
    rows = [(1, "some words here", "en", "a", 3), (2, "and other words there", "en", "b", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0
