"""Secret scans: fixed patterns, and strings that read like random characters rather than identifiers.

The patterns give the base spans: ``assign``, ``access`` and ``hex``, leftmost and non-overlapping for each kind. Two first-order
Markov models over characters, one of random strings and one of ordinary words and identifiers, then judge every run of
``DOTTED`` characters, which may have dots inside: where the log-likelihood ratio of the two is ``RATIO`` or more, it is a span of kind
``markov``, unless it overlaps a base span. Of runs that are not, each piece between dots, a ``CANDIDATE``, is judged on its own. Dots say
nothing for either model. Runs of fewer than ten characters are not judged. The models are trained from samples that the patterns label: base spans' secrets are random strings,
the words outside them are ordinary. The training documents are the ``SAMPLE`` first in the order of a hash of doc_id and text. All
documents are scanned, whole. Everything is built-in column functions.

A pattern's spans come from the pieces between its matches: a match begins after all pieces and matches before it.

Defined cases: a null or empty text has no spans. Where the sample holds no secret, random strings are of equally likely
characters. Repeated rows are scanned alike. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolake.llm.common import kept

#: The patterns of the base spans.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: What the models judge: runs with dots inside or none, and pieces next to a dot; a word of training.
DOTTED, WORD = r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_=.-]{8,}[A-Za-z0-9+/_=-]", r"[A-Za-z0-9+/_=-]{4,}"
CANDIDATE = r"(?<=\.)[A-Za-z0-9+/_=-]{10,}+|(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{10,}+(?=\.++[A-Za-z0-9+/_=-])"
KINDS = ("assign", "access", "hex", "markov")
SAMPLE, RATIO, ALPHABET, SMOOTH = 4000, 12.0, 67, {"random": 40.0, "ordinary": 2.0}
_NONE = "CAST(array() AS array<struct<s: bigint, k: int, e: bigint, v: string>>)"


def _spans(text: Column, pattern: str, kind: int, value: int = 0, passes: Callable[[Column], Column] | None = None) -> Column:
    """All matches as structs of start, kind, end (code points) and the wanted group, those whose group ``passes``.

    Appending copies the list, so what doesn't pass is never in it: the cost grows with the text and the square of what passes.
    """
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    parts = F.arrays_zip(F.transform(gaps, F.char_length).alias("g"), F.transform(matches, F.char_length).alias("m"), values.alias("v"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(_NONE).alias("out"))

    def add(acc: Column, part: Column) -> Column:
        s = acc["at"] + part["g"]
        e = s + F.coalesce(part["m"], F.lit(0))
        span = F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), part["v"].alias("v"))
        good = part["m"].isNotNull() if passes is None else part["m"].isNotNull() & passes(part["v"])
        return F.struct(e.alias("at"), F.when(good, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, start, add)["out"]


def base_spans(text: Column) -> Column:
    """The base spans of a text that is not null, by start, then kind."""
    none = F.expr(_NONE)
    found = (
        # A maximal run shorter than the least length is a failing match, so asking for that length at once is the same;
        # for assignments it is not, as a failing one still uses up its text.
        F.when(text.rlike(ASSIGN), _spans(text, ASSIGN, 0, 2, lambda v: F.char_length(v) >= LEAST["assign"])).otherwise(none),
        F.when(text.contains("AKIA"), _spans(text, f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", 1)).otherwise(none),
        F.when(text.rlike(f"[0-9a-f]{{{LEAST['hex']}}}"), _spans(text, f"[0-9a-f]{{{LEAST['hex']},}}", 2)).otherwise(none),
    )
    return F.array_sort(F.concat(*found))


def _pairs(strings: DataFrame) -> DataFrame:
    """How often one character follows another in column ``v``."""
    at = strings.where("char_length(v) > 1").select("v", F.explode(F.expr("sequence(1, char_length(v) - 1)")).alias("i"))
    return at.select(F.expr("ascii(substr(v, i, 1)) * 128 + ascii(substr(v, i + 1, 1))").alias("p")).where("p < 16384").groupBy("p").agg(F.count("*").alias("n"))


def log_ratios(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """128 by 128: log of how much likelier one character follows another in random strings than in ordinary words."""
    order = F.xxhash64("doc_id", "text")
    last = docs.select(order.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    known = kept(docs.where(order <= F.lit(last)).select(F.coalesce("text", F.lit("")).alias("text")).limit(sample)) if last is not None else None
    tables = {}
    for name in ("random", "ordinary"):
        counts = np.zeros(128 * 128)
        if known is not None:
            if name == "random":
                strings = known.select(F.explode(base_spans(F.col("text"))).alias("x")).select("x.v")
            else:
                clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), r"AKIA[A-Z0-9]{12,}", " "), r"[0-9a-f]{32,}", " ")
                strings = known.select(F.explode(F.regexp_extract_all(clean, F.lit(WORD), F.lit(0))).alias("v"))
            for r in _pairs(strings).collect():
                counts[r["p"]] = r["n"]
        counts = counts.reshape(128, 128)
        tables[name] = np.log((counts + SMOOTH[name] / ALPHABET) / (counts.sum(1, keepdims=True) + SMOOTH[name]))
    ratios = tables["random"] - tables["ordinary"]
    ratios[ord(".")] = ratios[:, ord(".")] = 0.0
    return ratios


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of (doc_id: long, text: string)."""
    docs = docs.select("doc_id", "text")
    ratios = ",".join(f"{x:.5f}" for x in log_ratios(docs).ravel())
    table = F.expr(f"CAST(split('{ratios}', ',') AS array<double>)")
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text"), base_spans(text).alias("base"))

    def ratio(v: Column) -> Column:
        pair = lambda i: F.ascii(F.substring(v, i, F.lit(1))) * 128 + F.ascii(F.substring(v, i + 1, F.lit(1)))
        return F.aggregate(F.sequence(F.lit(1), F.char_length(v) - 1), F.lit(0.0), lambda s, i: s + F.element_at(table, pair(i) + 1))

    def fresh(pattern: str, others: str) -> Column:
        clear = lambda x: ~F.exists(others, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        spans = F.filter(_spans(F.col("text"), pattern, 3, 0, lambda v: ratio(v) >= RATIO), clear)
        return F.array_sort(F.concat(others, F.when(F.col("text").rlike(pattern), spans).otherwise(F.expr(_NONE))))

    found = found.withColumn("whole", fresh(DOTTED, "base"))
    found = found.select("doc_id", "base", fresh(CANDIDATE, "whole").alias("all"))

    def listed(spans: str) -> Column:
        kind = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["k"] + 1)
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["s"].cast("string"), x["e"].cast("string"))), ",")

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")

    counts = [number(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"))
