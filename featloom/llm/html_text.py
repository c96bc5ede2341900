"""Main text of web pages by differencing with the pages of nearest URL.

1. Each page is read into text lines, one per block element, from the whole html.
   Scripts, styles, forms and other markup without prose give no line.  A line knows
   whether it stands inside the page's article (``article`` or ``main``).
2. Pages of a host are put in order of their URL path; each is paired with the page
   before and the page after it.  Line hashes are aligned with each partner's by longest
   common subsequence, and a line outside the article that the two share is deleted:
   what neighbours have in common is the site's frame.  Lines inside an article are the
   page's own even if another page prints them too, so copies keep their text.
3. Of the lines left, those of navigation, header, footer, aside, notice, advert and
   comment elements go by name; what remains is joined.

Paths are ordered over all pages at once (range-sorted parts, then a rank), so a host of
any size is dealt over many tasks.  Partners exchange line hashes, never html; only
decisions come back to the page.

Defined cases: null html is empty and gives an empty text; a null url has an empty host
and path; pages alone on their host keep all lines of step 1 that step 3 leaves;
repeated rows are neighbours and keep their articles; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.llm.common import global_rank
from featloom.llm.url_filter import host_of, path_of
from featloom.session import materialize

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b.*?(?:</\1\s*>|\Z)"
    # A quote only holds a value together if it follows the equals sign.
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>=]+|=)*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
# Elements that flow inside a line; all others begin and end one.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose lines are not the article, wherever they stand.
_FRAME = frozenset("nav footer aside form button head dialog menu".split())
_FRAME_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side-bar|nav\w*|menu\w*|breadcrumb\w*|"
    r"header|masthead|footer|foot|cookie\w*|consent|notice\w*|popup|modal|newsletter|subscribe|share|social\w*|"
    r"related|recommend\w*|comment\w*|disqus|replies|form)(?=$|[\s_-])",
    re.I,
)
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ROLES = re.compile(r"(?<![\w-])role\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|dialog|alert)", re.I)

FREE, ARTICLE, FRAME = 0, 1, 2
BREAKS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)


def _is_frame(name: str, attributes: str, in_article: bool) -> bool:
    if name in _FRAME:
        return True
    if name == "header":
        return not in_article
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    if _ROLES.search(attributes):
        return True
    values = (a or b or c for a, b, c in _NAMED.findall(attributes))
    if in_article:
        # There a name must say it whole: a section-header heads a part of the article.
        return any(_FRAME_NAME.fullmatch(word) for v in values for word in v.split())
    return any(_FRAME_NAME.search(v) for v in values)


def read_lines(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each block in page order; blank blocks give none."""
    lines: list[tuple[int, str]] = []
    parts: list[str] = []
    open_tags: list[tuple[str, int]] = []
    zone = FREE

    def end_line() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                lines.append((zone, text))
            parts.clear()

    at = 0
    text = page or ""
    for token in _TOKEN.finditer(text):
        if token.start() > at:
            parts.append(text[at : token.start()])
        at = token.end()
        name = token[3]
        if name is None:
            continue
        name = name.lower()
        block = name not in _INLINE
        if block:
            end_line()
        if name in _VOID:
            continue
        if token[2]:
            for depth in range(len(open_tags) - 1, -1, -1):
                if open_tags[depth][0] == name:
                    if not block:
                        before = open_tags[depth][1]
                        if before != zone:
                            end_line()
                        zone = before
                        del open_tags[depth:]
                    else:
                        zone = open_tags[depth][1]
                        del open_tags[depth:]
                    break
                if not block and open_tags[depth][0] not in _INLINE:
                    break  # a stray end tag does not close the block around it
            continue
        if token[4].endswith("/") and block:
            continue
        if name in BREAKS_P:
            # an open p ends where a block begins
            for depth in range(len(open_tags) - 1, -1, -1):
                if open_tags[depth][0] == "p":
                    zone = open_tags[depth][1]
                    del open_tags[depth:]
                    break
                if open_tags[depth][0] not in _INLINE:
                    break
        new = zone
        if zone != FRAME:
            if _is_frame(name, token[4], zone == ARTICLE):
                new = FRAME
            elif name in ("article", "main") or "itemprop" in token[4] and "articleBody" in token[4]:
                new = ARTICLE
        if new != zone and not block:
            end_line()
        open_tags.append((name, zone))
        zone = new
    if at < len(text):
        parts.append(text[at:])
    end_line()
    return lines


def shared_lines(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of ``own`` lie on a longest common subsequence with ``other``.

    Common ends are taken first; in between, rows of the table are bit vectors in one
    integer each (a row takes one addition), so long pages stay cheap.
    """
    n, m = len(own), len(other)
    found = np.zeros(n, bool)
    least = min(n, m)
    differ = np.flatnonzero(own[:least] != other[:least])
    head = int(differ[0]) if len(differ) else least
    found[:head] = True
    rest = least - head
    if rest:
        back = np.flatnonzero(own[n - rest:][::-1] != other[m - rest:][::-1])
        tail = int(back[0]) if len(back) else rest
    else:
        tail = 0
    if tail:
        found[n - tail:] = True
    a, b = own[head : n - tail].tolist(), other[head : m - tail].tolist()
    if not a or not b:
        return found
    # Only lines that both have can match.
    common = set(a) & set(b)
    keep = [i for i, x in enumerate(a) if x in common]
    b = [x for x in b if x in common]
    if not keep:
        return found
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, v = [], full
    for i in keep:
        u = v & masks[a[i]]
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    # Walk back: bit j of a row is 0 where the length rises at column j.
    j = len(b)
    for r in range(len(keep) - 1, -1, -1):
        if j == 0:
            break
        above = rows[r - 1] if r else full
        low = (1 << j) - 1
        here = j - (rows[r] & low).bit_count()
        if here == j - (above & low).bit_count():
            continue  # this row adds nothing up to column j
        while (masks[a[keep[r]]] >> (j - 1)) & 1 == 0 or (rows[r] >> (j - 1)) & 1:
            j -= 1
        found[head + keep[r]] = True
        j -= 1
    return found


def _row_key(df: DataFrame) -> F.Column:
    return F.xxhash64("page_id", "url", "html")


def _hashed(pages: DataFrame) -> DataFrame:
    """(row_key, host, path, page_id, hashes, free): each line's hash, and if it may go."""
    narrow = pages.select(
        _row_key(pages).alias("row_key"),
        F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"),
        F.col("page_id").cast("long").alias("page_id"), "html",
    )

    def work(batches):
        for batch in batches:
            lines = [read_lines(t.as_py()) for t in batch.column(4)]
            yield pa.record_batch(
                [*(batch.column(i) for i in range(4)),
                 pa.array([[xxhash.xxh64_intdigest(t) - (1 << 63) for _, t in ls] for ls in lines], pa.list_(pa.int64())),
                 pa.array([[z != ARTICLE for z, _ in ls] for ls in lines], pa.list_(pa.bool_()))],
                ["row_key", "host", "path", "page_id", "hashes", "free"],
            )

    return narrow.mapInArrow(
        work, "row_key bigint, host string, path string, page_id bigint, hashes array<bigint>, free array<boolean>"
    )


def frame_lines(pages: DataFrame) -> DataFrame:
    """(row_key, gone): numbers of the lines that a page shares with a neighbour."""
    order = [F.col("host"), F.col("path"), F.col("page_id"), F.col("row_key")]
    ranked = materialize(global_rank(_hashed(pages), order, "page-lines", "rank"), "page-order")
    other = ranked.select(
        F.explode(F.array(F.col("rank") - 1, F.col("rank") + 1)).alias("of"),
        F.col("host").alias("other_host"), F.col("hashes").alias("other"),
    )
    # Each rank meets two rows, whatever the size of its host.
    pairs = ranked.join(other, (F.col("rank") == F.col("of")) & (F.col("host") == F.col("other_host")))

    def align(batches):
        for batch in batches:
            keys, gone = [], []
            for key, own, free, partner in zip(*(batch.column(i) for i in range(4))):
                mine = np.array(own.as_py(), np.int64)
                hit = shared_lines(mine, np.array(partner.as_py(), np.int64))
                hit &= np.array(free.as_py(), bool)
                if hit.any():
                    keys.append(key.as_py())
                    gone.append(np.flatnonzero(hit).tolist())
            yield pa.record_batch(
                [pa.array(keys, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["row_key", "gone"]
            )

    aligned = pairs.select("row_key", "hashes", "free", "other").mapInArrow(
        align, "row_key bigint, gone array<int>"
    )
    return aligned.groupBy("row_key").agg(
        F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")
    )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page."""
    gone = materialize(frame_lines(pages), "page-frames").withColumnRenamed("row_key", "k")
    narrow = pages.select("page_id", "url", _row_key(pages).alias("row_key"), "html")
    page_id = narrow.schema["page_id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            kept = []
            for text in batch.column(3):
                lines = enumerate(read_lines(text.as_py()))
                kept.append([{"n": i, "line": t} for i, (z, t) in lines if z != FRAME])
            kind = pa.list_(pa.struct([("n", pa.int32()), ("line", pa.string())]))
            yield pa.record_batch(
                [*(batch.column(i) for i in range(3)), pa.array(kept, kind)],
                ["page_id", "url", "row_key", "lines"],
            )

    read = narrow.mapInArrow(
        work, f"page_id {page_id}, url string, row_key bigint, lines array<struct<n:int,line:string>>"
    )
    joined = read.join(gone, F.col("row_key") == F.col("k"), "left")
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains(F.col("gone"), x["n"]))
    )
    text = F.array_join(F.transform(left, lambda x: x["line"]), " ")
    return joined.select("page_id", "url", text.alias("text")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )
