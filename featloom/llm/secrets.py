"""Secret scan: fixed patterns, and two character Markov models compared by likelihood.

The patterns give base spans.  The method adds spans of kind ``markov``: a run of
``[A-Za-z0-9+/_=-]`` of at least ``least_length`` characters with a letter and a digit,
whose pairs of characters are likelier, by ``threshold`` nats a pair on average, under a
model of random strings than under one of ordinary identifiers.  Letters are compared in
lower case.  A run that touches a base span is left to it.

Both models are trained on labelled strings: a table given by the caller, or those found
in at most ``sample`` documents (with the least hash of their id).  There the values of
base spans are random, without the keyword before them, and runs of six or more
characters outside base spans are ordinary, secrets that no pattern knows among them, so
a table is better where those are many.  Counts are aggregated by Spark; the driver
gets one array of log ratios, as long as the alphabet squared.  Everything runs as
built-in expressions, and every whole text is scanned without a shuffle.

Positions come from splitting a text at a pattern: the pieces between the matches and
the matches themselves, added up in blocks, say where each match starts, in code points.
Time grows with the length of a text, also of one run, and only a block's share with the
number of matches in it.

Defined cases: a null text is empty; without any run to learn from no span is added;
repeated rows are scanned alike; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.llm.common import bind, lower_ascii

# Fixed values of the contract.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
LEAST_VALUE = 6
ACCESS = "AKIA[A-Z0-9]+"
LEAST_ACCESS = 20
HEX = "[0-9a-f]{24,}"  # the whole run of hex digits, of 24 or more
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]"
SAMPLE = 4000
LEAST_LENGTH = 20
THRESHOLD = 0.5
# Matches that are placed together, and the character that stands for assign spans.
BLOCK = 256
HIDDEN = "\x01"

_SPAN = "struct<kind:int,start:int,end:int,value:string>"


def _pieces(text: Column, pattern: str, group: int = 0) -> Column:
    """(between, whole, value): what stands before each match, the match, and its group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    return F.arrays_zip(
        F.split(text, pattern, -1).alias("between"), whole.alias("whole"), value.alias("value")
    )


def matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All leftmost matches as (kind, start, end, value of the group), in order."""
    none = F.array().cast(f"array<{_SPAN}>")

    def add(acc, x):
        start = acc["at"] + F.length(x["between"])
        end = start + F.coalesce(F.length(x["whole"]), F.lit(0))
        span = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value")
        )
        # The last piece has no match after it.
        out = F.when(x["whole"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span)))
        return F.struct(end.alias("at"), out.alias("out"))

    def shift(acc, block):
        moved = F.transform(block["out"], lambda s: F.struct(
            s["kind"].alias("kind"), (s["start"] + acc["at"]).alias("start"),
            (s["end"] + acc["at"]).alias("end"), s["value"].alias("value"),
        ))
        return F.struct(
            (acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out")
        )

    def spans(steps):
        # Appending copies what is there, so spans are placed within blocks first.
        first = F.sequence(F.lit(1), F.size(steps), F.lit(BLOCK))
        blocks = F.transform(first, lambda i: F.aggregate(
            F.slice(steps, i, BLOCK), F.struct(F.lit(0).alias("at"), none.alias("out")), add
        ))
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out"))
        return F.flatten(F.aggregate(blocks, empty, shift, lambda acc: acc["out"]))

    found = bind(_pieces(text, pattern, group), spans)
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(none)


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    """Spans of the three patterns; matches that fail their length are dropped."""
    assign = F.filter(matches(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= LEAST_VALUE)
    access = F.filter(matches(text, ACCESS, 1), lambda s: F.length(s["value"]) >= LEAST_ACCESS)
    return assign, access, matches(text, HEX, 2)


def _with_base(documents: DataFrame) -> DataFrame:
    text = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    assign, access, hexes = base_spans(F.col("text"))
    return text.select(
        "doc_id", "text", assign.alias("assign"), access.alias("access"), hexes.alias("hex")
    ).withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))


def _hide_assigned(text: Column) -> Column:
    """The text with each assign span overwritten by as many of one character not in it."""
    free = F.when(F.contains(text, F.lit(HIDDEN)), F.translate(text, HIDDEN, "\n")).otherwise(text)
    return F.array_join(
        F.transform(
            _pieces(free, ASSIGN, 2),
            lambda x: F.concat(
                x["between"],
                F.when(x["whole"].isNull(), F.lit(""))
                .when(F.length(x["value"]) >= LEAST_VALUE, F.repeat(F.lit(HIDDEN), F.length(x["whole"])))
                .otherwise(x["whole"]),
            ),
        ),
        "",
    )


def _hides_other(run: Column) -> Column:
    """Whether a run holds an access or hex span; those never leave a run."""
    return F.rlike(run, F.lit(f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}|{HEX}"))


def labelled_strings(
    documents: DataFrame, sample: int = SAMPLE, least: int = LEAST_VALUE
) -> DataFrame:
    """(text, random): distinct strings of ``sample`` documents, labelled by the base patterns."""
    chosen = (
        documents.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # At most ``sample`` ids.
    chosen = F.broadcast(chosen.withColumnRenamed("doc_id", "id"))
    read = _with_base(
        documents.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("id"))
    )
    runs = F.regexp_extract_all(_hide_assigned(F.col("text")), F.lit(f"{RUN}{{{least},}}"), F.lit(0))
    both = F.concat(
        F.transform("base", lambda s: F.struct(s["value"].alias("text"), F.lit(True).alias("random"))),
        F.transform(
            F.filter(runs, lambda r: ~_hides_other(r)),
            lambda r: F.struct(r.alias("text"), F.lit(False).alias("random")),
        ),
    )
    return read.select(F.inline(both)).distinct()


def _codes(text: Column) -> Column:
    """Numbers of the characters in the alphabet, in lower case; -1 for any other."""
    return F.transform(
        F.split(lower_ascii(text), ""), lambda c: F.instr(F.lit(ALPHABET), c).cast("int") - 1
    )


def log_ratios(labelled: DataFrame) -> Column | None:
    """By pair of characters, log of its chance in random strings over ordinary ones.

    Chances are of the second character after the first, with one added to each count.
    ``labelled`` has (text, random), of any size; None if it lacks one of the two labels.
    """
    known = labelled.where(F.col("text").isNotNull() & F.col("random").isNotNull())
    codes = known.select("random", _codes(F.col("text")).alias("codes"))
    pairs = codes.select(
        "random",
        F.inline(F.arrays_zip(F.col("codes").alias("a"), F.expr("slice(codes, 2, size(codes))").alias("b"))),
    ).where("a >= 0 and b >= 0")
    # At most twice the alphabet squared rows.
    counts = pairs.groupBy("random", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    if {r.random for r in counts} != {True, False}:
        return None
    n = len(ALPHABET)
    tables = {True: [[1.0] * n for _ in range(n)], False: [[1.0] * n for _ in range(n)]}
    for r in counts:
        tables[r.random][r.a][r.b] += r.n
    ratios = [
        math.log(tables[True][a][b] / sum(tables[True][a])) - math.log(tables[False][a][b] / sum(tables[False][a]))
        for a in range(n) for b in range(n)
    ]
    return F.lit(ratios)


def random_score(run: Column, ratios: Column) -> Column:
    """Mean log ratio over the pairs of a run, all of it in the alphabet, in lower case."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    total = F.aggregate(
        _codes(run),
        start,
        lambda acc, c: F.struct(
            c.alias("last"),
            (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(
                F.get(ratios, acc["last"] * len(ALPHABET) + c)
            )).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return total / (F.length(run) - 1)


def scan(
    documents: DataFrame,
    sample: int = SAMPLE,
    least_length: int = LEAST_LENGTH,
    threshold: float = THRESHOLD,
    labelled: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, n_markov, spans).

    ``labelled`` is (text, random) to train on; without it the documents give their own.
    """
    ratios = log_ratios(labelled_strings(documents, sample) if labelled is None else labelled)
    read = _with_base(documents)
    if ratios is None:
        added = F.array().cast(f"array<{_SPAN}>")
    else:
        # Whole runs, but for those that go on into an assign span.
        likely = f"(?<!{RUN}){RUN}{{{least_length},}}+(?!{HIDDEN})"

        def random(s):
            run = s["value"]
            return (
                F.rlike(run, F.lit("[A-Za-z]")) & F.rlike(run, F.lit("[0-9]"))
                & ~_hides_other(run) & (random_score(run, ratios) >= threshold)
            )

        read = read.withColumn("runs", matches(_hide_assigned(F.col("text")), likely, 3))
        added = F.filter(F.col("runs"), random)
    read = read.withColumn("added", added)
    return read.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_digest(F.col("base")), 256).alias("base_sha256"),
        F.size("added").cast("long").alias("n_markov"),
        _digest(F.concat("base", "added")).alias("spans"),
    )


def _digest(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.sort_array(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    )
    return F.array_join(
        F.transform(
            ordered,
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )
