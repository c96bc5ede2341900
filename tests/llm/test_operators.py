"""The text operators against brute force on small tables with awkward rows."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from featloom.llm import (
    decontaminate,
    html_text,
    language,
    line_dedup,
    mixing,
    quality,
    secrets,
    simhash,
    url_filter,
)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, rows):
    """Rows of (doc_id, text), with columns whose names an operator might use itself."""
    full = [(i, t, "en", f"s{(i or 0) % 3}", 0, "x", 1, "y") for i, t in rows]
    return spark.createDataFrame(full, DOCS + ", hash string, size int, host string")


# ---- URL filter


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(3000).select(
        F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") % 7 == 0).alias("listed")
    )
    cascade = url_filter.fit_cascade(keys, bits_per_key=2)
    assert len(cascade.levels) > 2
    wrong = keys.where(cascade.contains(F.col("key")) != F.col("listed"))
    assert wrong.count() == 0


def test_url_rules_and_limits(spark):
    rows = [
        (1, "http://A.Example.ORG/es/x?q"), (2, "https://example.org/en/12"), (3, "http://b.org"), (4, None),
        (5, "no scheme"), (6, "http://x.com/fr/a#b"), (7, "http://x.com/de/"), (8, "http://bad.net/a"),
        (9, "http://notbad.net?x"), (9, "http://notbad.net?x"), (None, "://org/"), (10, "http://x.com/fr"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("rule", F.lit("z"))
    for most in (1 << 20, 0):  # by bits, and by a join where bits are too many
        out = url_filter.filter_urls(pages, F.col("key") == "bad.net", most_bytes=most)
        found = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in out.collect()))
        assert found == sorted([
            (1, "a.example.org", "/es/x", "example.org/es/", "block"),
            (2, "example.org", "/en/12", "example.org/en/1", "block"),
            (3, "b.org", "", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
            (6, "x.com", "/fr/a", "com/fr/", "allow"), (7, "x.com", "/de/", "com/de/", "block"),
            (8, "bad.net", "/a", None, "block"), (9, "notbad.net", "", None, "allow"),
            (9, "notbad.net", "", None, "allow"), (0, "org", "/", "org/", "allow"), (10, "x.com", "/fr", None, "allow"),
        ])
    assert url_filter.filter_urls(pages.limit(0), F.col("key") == "bad.net").count() == 0


# ---- secrets


def base_by_re(text):
    found = []
    for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        text or "", re.I | re.A,
    ):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    names = ("assign", "access", "hex")
    return [f"{names[k]}:{s}:{e}" for s, k, e in sorted(found)]


def test_secrets_against_re(spark):
    pick = random.Random(2)
    bits = [
        "token=", "Secret : ", "api_key='", "AKIA", "PASSWD\"=", "é😀 ", "word ", "abcdef012345", "0123456789abcdef",
        "ABCDEF123456", "=", "\n", "secret=token: abcdefg", "passwordx", "x=1", "ordinaryidentifier ",
    ]
    rows = [(i, "".join(pick.choice(bits) for _ in range(pick.randrange(1, 25)))) for i in range(150)]
    hexes = "".join(pick.choice("0123456789abcdef") for _ in range(4000))
    rows += [(200 + i, f"the token = {hexes[i * 40:i * 40 + 40]} and key") for i in range(60)]
    rows += [(300, None), (301, ""), (302, "a B " + hexes[:40].upper() + " c"), (None, "secret=abcdefgh"), (302, "x")]
    out = secrets.scan(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(base_by_re(t))
    for r in out:
        spans = [s for s in r.spans.split(",") if s]
        base = [s for s in spans if not s.startswith("markov")]
        assert base in texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.n_assign + r.n_access + r.n_hex == len(base) and r.n_markov == len(spans) - len(base)
        if r.doc_id == 302 and spans:
            assert spans == ["markov:4:44"]
    assert any(r.doc_id == 302 and r.n_markov == 1 for r in out)
    assert secrets.scan(docs_of(spark, [])).count() == 0


# ---- language


def test_language_on_held_out(spark):
    pick = random.Random(4)
    sounds = {"aa": "ka lo mi tu".split(), "bb": "schr ein ung cht".split(), "cc": "ção ñez íos lla".split()}
    rows = []
    for i in range(300):
        lang = pick.choice(list(sounds))
        words = ["".join(pick.choice(sounds[lang]) for _ in range(3)) for _ in range(30)]
        rows.append((i, " ".join(words), lang, "s", 0))
    rows += [(1000, None, "aa", "s", 0), (1001, "123 !?", None, None, None), (None, rows[0][1], None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    profiles = language.learn(docs, sample=40)
    assert profiles.languages == ("aa", "bb", "cc")
    truth = {r[0]: r[2] for r in rows}
    out = language.predict(docs, profiles).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1
        if r.doc_id in (1000, 1001):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred == truth[r.doc_id]
            assert r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0)
    kept = language.keep_known(docs, profiles)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 2
    nothing = language.learn(docs.limit(0))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


@pytest.mark.parametrize("sample", [1, 7, 500])
def test_language_learns_from_the_least_hashes(spark, sample):
    pick = random.Random(5)
    rows = [
        (i, "".join(pick.choice("abcdefgh ") for _ in range(40)), "hot" if i % 3 else pick.choice("xy"), "s", 0)
        for i in range(400)
    ]
    rows += [(7, "again and again", "hot", "s", 0), (9, None, "x", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    hashes = dict(docs.select("doc_id", F.xxhash64("doc_id")).collect())
    least = []
    for lang in ("hot", "x", "y"):
        ids = [r[0] for r in rows if r[2] == lang and __import__("zlib").crc32(str(r[0]).encode()) % 5]
        least += [(i, lang) for i in sorted(ids, key=lambda i: hashes[i])[:sample]]
    chosen = [r for r in rows if (r[0], r[2]) in set(least)]
    got, want = language.learn(docs, sample=sample), language.learn(spark.createDataFrame(chosen, DOCS))
    assert got.languages == want.languages and got.keys.tolist() == want.keys.tolist()
    assert got.places.tolist() == want.places.tolist()


def test_out_of_place_distance():
    profiles = language.Profiles.of([("x", 97, 0), ("x", 98, 1), ("y", 98, 0)], size=4)
    # " ab " has a, b, " a", "ab", "b ", " ab", "ab "; the four least by number are kept
    own = language.most_frequent(*language.ngrams("ab"), 4)
    assert own[:2].tolist() == [97, 98] and len(own) == 4
    assert profiles.predict("ab") == ("x", 1 - 8 / 16)


# ---- page text


def test_page_zones_and_differencing(spark):
    def page(article, frame):
        return (
            f"<html><head><title>t</title><style>p{{}}</style></head><body><nav>menu</nav><div>{frame}</div>"
            f"<article><h1>Head &amp; tail</h1><p>{article}<br>next  line<p>more</article>"
            "<div class='comments'>hi</div><div>own " + article + "</div><footer>f</footer><script>var x='<p>';</script>"
        )

    rows = [(i, f"http://h.net/a/{i}", page(f"text {i}", "Site of news")) for i in range(8)]
    rows += [(20, "http://other.net/x", page("lone", "Site of news")), (21, None, None), (22, "http://h.net/z", "")]
    rows += [rows[3], (None, "http://h.net/a/9", page("text 3", "Site of news"))]
    out = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    found = sorted(((r.page_id if r.page_id is not None else -1, r.text) for r in out.collect()))
    assert len(found) == len(rows)
    for i in range(8):
        assert (i, f"Head & tail text {i} next line more own text {i}") in found or i == 3
    # copies keep the article; lines outside it that a copy shares go
    assert found.count((3, "Head & tail text 3 next line more")) == 2
    assert (20, "Site of news Head & tail lone next line more own lone") in found
    assert (21, "") in found and (22, "") in found


def test_shared_lines_is_a_longest_common_subsequence():
    pick = random.Random(6)

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    for _ in range(500):
        a = [pick.randrange(5) for _ in range(pick.randrange(14))]
        b = [pick.randrange(5) for _ in range(pick.randrange(14))]
        hit = html_text.shared_lines(np.array(a, np.int64), np.array(b, np.int64))
        chosen, rest = [x for x, k in zip(a, hit) if k], iter(b)
        assert len(chosen) == length(a, b) and all(x in rest for x in chosen)


# ---- SimHash


def simhash_slow(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components_slow(prints):
    group = list(range(len(prints)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                group[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def near_rows():
    pick = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = [pick.choice(vocabulary) for _ in range(150)]
        rows.append(" ".join(words))
        for _ in range(pick.randrange(3)):
            words = list(words)
            words[pick.randrange(150)] = "ÄX"
            rows.append("\t".join(words))
    return [(i, t) for i, t in enumerate(rows)] + [
        (900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "a b"), (5, rows[5]), (None, rows[0]),
    ]


def test_simhash_groups(spark):
    rows = near_rows()
    prints = [simhash_slow(t) for _, t in rows]
    assert [simhash.fingerprint(t) for _, t in rows] == prints
    group = components_slow(prints)
    least = {g: min((i for (i, _), h in zip(rows, group) if h == g and i is not None), default=None) for g in group}
    want = sorted((str(i), p, least[g]) for (i, _), p, g in zip(rows, prints, group))
    out = simhash.group(docs_of(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in out) == want
    kept = simhash.keep_first(docs_of(spark, rows))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(least.values()))
    assert simhash.group(docs_of(spark, [])).count() == 0


def test_links_find_all_pairs_of_a_dense_group(spark):
    pick = random.Random(8)
    prints = {0}
    for _ in range(400):
        near = pick.choice(sorted(prints))
        prints.add(near ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    found = {(r.a, r.b) for r in simhash.links(frame).collect()}
    want = {
        (a, b) for a in signed for b in signed
        if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2
    }
    assert found == want and simhash.links(frame).count() == len(want)


# ---- decontamination


def judged_slow(docs, items):
    def words(text):
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    spans = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            spans.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, named = words(text), set(), set()
        for n in {len(s) for s in spans}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in spans:
                    hit |= set(range(i, i + n))
                    named |= {str(x) for x in spans[tuple(w[i : i + n])] if x is not None}
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((str(doc_id), len(w), len(hit), len(named), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_decontamination(spark):
    pick = random.Random(9)
    vocabulary = [f"v{i}" for i in range(12)] + ["É", "ß9"]

    def some(n):
        return " ".join(pick.choice(vocabulary) for _ in range(n))

    items = [(i, some(pick.choice([1, 3, 5, 12, 13, 14, 40]))) for i in range(14)]
    items += [(50, None), (51, "!?"), (None, some(20)), (3, items[3][1]), (60, items[6][1])]
    docs = []
    for i in range(80):
        text = some(pick.randrange(60))
        if pick.random() < 0.5:
            text += ". " + (pick.choice(items)[1] or "").upper() + " " + some(pick.randrange(200))
        docs.append((i, text))
    docs += [(100, None), (101, ""), (7, docs[7][1]), (None, items[6][1]), (8, docs[9][1])]
    frame = docs_of(spark, docs)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for chosen in (items, [i for i in items if i[1] and len(i[1].split()) >= 12]):
        bench = spark.createDataFrame(chosen, "item_id bigint, text string")
        out = decontaminate.judge(frame, bench).collect()
        want = judged_slow(docs, chosen)
        assert sorted((str(r[0]), *r[1:]) for r in out) == want
    kept = decontaminate.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(r[0] for r in want if not r[5])
    assert decontaminate.judge(frame, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_takes_texts_apart_twice(spark):
    """Once for the hashes of all lengths, once around their places; hits are not made again."""
    items = [(1, "a"), (2, "b c d"), (3, " ".join(f"w{i}" for i in range(13)))]
    docs = [(i, f"x {items[i % 3][1]} y") for i in range(12)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    frame = docs_of(spark, [*docs, docs[0]])
    frame = frame.mapInArrow(counted, frame.schema)
    hits = decontaminate.find_hits(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_hit, *r.item_ids) for r in hits) == [
        (i, (1, 3, 13)[i % 3], str(i % 3 + 1)) for i in range(12)
    ]
    assert read.value == 2 * 13


# ---- quality


def counted_slow(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit),
    )


def test_quality_counts_and_classifier(spark):
    pick = random.Random(10)
    good, bad = [f"good{i} é" for i in range(40)], [f"#junk{i} |" for i in range(40)]
    rows, labels = [], []
    for i in range(240):
        text = " ".join(pick.choice(good if i % 3 else bad) for _ in range(pick.randrange(15, 60)))
        rows.append((i, text + pick.choice(["", "\nx\n x\nx", " \n\n"])))
        if i < 160:
            labels.append((i, 1 if i % 3 else 0))
    rows += [(500, None), (501, ""), (502, " ".join("abcdefgh") * 30), (503, "a b c d e f g h " * 5), (None, "x"), (5, rows[5][1])]
    frame = docs_of(spark, rows)
    known = spark.createDataFrame([*labels, (3, None), (5, 1), (9999, 0)], "doc_id bigint, quality int")
    fitted = quality.fit(frame, known, sample=120)
    out = quality.judge(frame, fitted).collect()
    want = sorted((str(i), *counted_slow(t)) for i, t in rows)
    assert sorted((str(r.doc_id), *r[1:6]) for r in out) == want
    for r in out:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
        if r.doc_id is not None and 160 <= r.doc_id < 240 and not r.base_failed:
            assert r.kept == bool(r.doc_id % 3)
    assert quality.fit(frame, known.limit(0)) is None
    assert {r.kept for r in quality.judge(frame, None).collect() if not r.base_failed} == {True}


# ---- lines


def lines_slow(rows, window, long_words):
    def units(text):
        return [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate((text or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")]

    first = {}
    for doc_id, text in rows:
        u = [x for _, x in units(text)]
        for i in range(len(u)):
            place = (-1 if doc_id is None else doc_id, i)
            if i + window <= len(u):
                span = tuple(u[i : i + window])
                first[span] = min(first.get(span, place), place)
            if len([w for w in re.split(r"[\x20\x09-\x0D]+", u[i]) if w]) >= long_words:
                first[u[i]] = min(first.get(u[i], place), place)
    out = []
    for doc_id, text in rows:
        u, gone = [x for _, x in units(text)], set()
        for i in range(len(u)):
            place = (-1 if doc_id is None else doc_id, i)
            if i + window <= len(u) and first[tuple(u[i : i + window])] < place:
                gone |= set(range(i, i + window))
            if first.get(u[i], place) < place:
                gone.add(i)
        lines = {i for n, (i, _) in enumerate(units(text)) if n in gone}
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in lines)
        out.append((str(doc_id), len(u), len(gone), kept))
    return sorted(out, key=str)


def test_line_dedup(spark):
    pick = random.Random(11)
    pool = [f"line {i}" for i in range(12)] + [" ".join(f"long{i}" for i in range(k, k + 9)) for k in (0, 50)] + ["", "  "]
    rows = [(i, "\n".join(pick.choice(pool) for _ in range(pick.randrange(12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "same\n" * 9), (None, rows[9][1]), (104, rows[9][1]), (104, rows[9][1])]
    frame = docs_of(spark, rows)
    out = line_dedup.summary(frame, window=3, long_words=8).collect()
    assert sorted(((str(r[0]), *r[1:]) for r in out), key=str) == lines_slow(rows, 3, 8)
    left = line_dedup.dedup(frame, window=3, long_words=8)
    assert left.columns == frame.columns and left.count() == len(rows)
    assert line_dedup.summary(frame.limit(0)).count() == 0


@pytest.mark.parametrize("window", [1, 2, 4])
def test_line_dedup_of_other_windows(spark, window):
    pick = random.Random(window)
    pool = [f"line {i}" for i in range(9)] + [" ".join(f"long{i}" for i in range(9)), "", " x "]
    rows = [(i, "\n".join(pick.choice(pool) for _ in range(pick.randrange(14)))) for i in range(40)]
    out = line_dedup.summary(docs_of(spark, rows), window=window, long_words=8).collect()
    assert sorted(((str(r[0]), *r[1:]) for r in out), key=str) == lines_slow(rows, window, 8)


def test_a_line_at_one_place_makes_no_window(spark):
    """Rows are selected lines, about half of all, and a line of its own joins nothing."""
    rows = [(i, "\n".join(f"line {i} {j}" for j in range(60))) for i in range(30)]
    frame = docs_of(spark, rows + [(99, rows[3][1]), (100, None)])
    gone = line_dedup.repeats(frame)
    assert [(r.doc_id, sorted(r.removed)) for r in gone.collect()] == [(99, list(range(60)))]


def test_line_dedup_of_a_very_long_text(spark):
    lines = [f"line number {i}" for i in range(60_000)]
    frame = docs_of(spark, [(1, "\n".join(lines)), (2, "\n".join(["first", *lines, "last"]))])
    began = time.time()
    out = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.summary(frame).collect()}
    assert time.time() - began < 120
    assert out[1][:2] == (60_000, 0) and out[2] == (60_002, 60_000, "first\nlast")


# ---- mixing


def test_mix_budgets(spark):
    pick = random.Random(12)
    rows = [
        (i, " ".join("w" for _ in range(pick.randrange(30))), None, pick.choice(["a", "a", "a", "b", None, "ä"]), 0)
        for i in range(200)
    ]
    rows += [(900, None, None, "a", 0), (901, "x y", None, "z", 0), (902, "", None, "empty", 0), rows[5], (None, "p q", None, "b", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    total = sum(r.size for r in out)
    by = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert sum(r.size for r in own) == own[0].source_size
        assert sum(r.taken for r in own) == int(own[0].target)
    assert sum(own[0].target for own in by.values()) == pytest.approx(1.5 * total)
    open_ones = {s: own[0].target for s, own in by.items() if own[0].target < 2 * own[0].source_size}
    names = [*sorted(s for s in by if s is not None), None]
    shares = {round(t / (5, 2, 1)[names.index(s) % 3], 6) for s, t in open_ones.items()}
    assert len(shares) <= 1
    assert mixing.mix(docs.limit(0)).count() == 0
