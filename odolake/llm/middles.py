"""Fill-in-the-middle over a learned index of token boundaries.

A text is cut into n tokens (the blanks before a word belong to it; blanks at the end are one more), so it has n + 1
boundaries. ``boundary_index`` learns the map from a boundary's rank to its offset in code points: straight segments,
each started at the first boundary that its predecessor could not predict within ``BOUND``, with whole-number slopes of
2^-24, and one byte for every boundary that holds what the prediction missed. ``offset_at`` looks a cut up in it:
the segment by its first rank, the prediction, and the stored residual, which makes it exact. A lookup touches one segment
and one byte, whatever the length of the text, and an index kept with a corpus serves every further seed.

``fill_in_middle`` draws two cuts and a form from sha256 of the seed and the doc_id and writes the text as it is (plain),
suffix first (spm) or prefix first (psm); ``restored`` takes the parts apart again by their markers. Only fitting runs in
Python, on one batch of texts at a time; nothing is shuffled, so keys, sources and groups of copies don't matter.

Defined cases: a null text is empty; an empty text, or one that holds a marker, stays plain and has no cuts, though
its tokens are counted. A text of blanks only is one token. A null doc_id is drawn as an empty one. Repeated rows give
repeated results, an empty table none. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest residual before slopes are rounded, which adds less than one; fraction bits of a slope; most ranks of a segment.
BOUND, FRACTION, LONGEST = 120, 24, 1 << 23
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SUFFIX_FIRST = 42, 50, 80
INDEX = "n bigint, ranks array<bigint>, offsets array<bigint>, slopes array<bigint>, residuals binary"
_INDEX = pa.struct(
    [("n", pa.int64()), ("ranks", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("slopes", pa.list_(pa.int64())), ("residuals", pa.binary())]
)


def boundaries(text: str) -> np.ndarray:
    """Offsets of all token boundaries in code points, from 0 to the length of the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    ends = ~blank
    ends[:-1] &= blank[1:]
    if len(ends):
        ends[-1] = True
    return np.concatenate(([0], np.flatnonzero(ends) + 1))


def predict(ranks: np.ndarray, offset: int, slope: int) -> np.ndarray:
    """Offsets a segment predicts, by ranks counted from its first."""
    return offset + ((slope * ranks) >> FRACTION)


def fit(offsets: np.ndarray) -> tuple[list[int], list[int], list[int], np.ndarray]:
    """First ranks, first offsets and slopes of the segments, and the residual of every boundary.

    A segment goes on as long as one slope through its first boundary keeps all others within ``BOUND``: the
    interval of such slopes narrows with each boundary. It is narrowed over stretches that double in length.
    """
    ranks, firsts, slopes = [], [], []
    residuals = np.zeros(len(offsets), np.int64)
    start, n = 0, len(offsets)
    while start < n:
        base = int(offsets[start])
        low, high, at, step = -np.inf, np.inf, start + 1, 256
        while at < min(n, start + LONGEST):
            stop = min(at + step, n, start + LONGEST)
            run = np.arange(at - start, stop - start)
            rise = offsets[at:stop] - base
            lows = np.maximum(np.maximum.accumulate((rise - BOUND) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + BOUND) / run), high)
            broken = np.flatnonzero(lows > highs)
            if len(broken):
                reached = int(broken[0])
                if reached:
                    low, high = lows[reached - 1], highs[reached - 1]
                at += reached
                break
            low, high, at, step = lows[-1], highs[-1], stop, step * 2
        slope = 0 if low == -np.inf else int(round((low + high) / 2 * (1 << FRACTION)))
        residuals[start:at] = offsets[start:at] - predict(np.arange(at - start), base, slope)
        ranks.append(start)
        firsts.append(base)
        slopes.append(slope)
        start = at
    return ranks, firsts, slopes, residuals


def _fit_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = []
        for text in texts:
            ranks, firsts, slopes, residuals = fit(boundaries(text.as_py() or ""))
            rows.append((len(residuals) - 1, ranks, firsts, slopes, (residuals + 128).astype(np.uint8).tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * len(_INDEX)
        yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _INDEX, strict=True)], fields=list(_INDEX))


def boundary_index(text: str) -> Column:
    """The learned index of a text column, as a struct: n, the segments (ranks, offsets, slopes) and the residuals."""

    @F.arrow_udf(INDEX)
    def index(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _fit_batches(batches)

    return index(F.coalesce(F.col(text), F.lit("")))


def offset_at(index: str, rank: Column) -> Column:
    """Exact offset of a boundary: what its segment predicts, set right by the stored residual."""
    at = f"`{index}`"
    # Segments are ordered, so the one that holds a rank is the last that starts no later.
    segment = F.size(F.filter(F.col(f"{at}.ranks"), lambda first: first <= rank)) - 1
    ahead = rank - F.get(F.col(f"{at}.ranks"), segment)
    predicted = F.get(F.col(f"{at}.offsets"), segment) + F.shiftright(F.get(F.col(f"{at}.slopes"), segment) * ahead, FRACTION)
    residual = F.conv(F.hex(F.substring(F.col(f"{at}.residuals"), (rank + 1).cast("int"), F.lit(1))), 16, 10).cast("long") - 128
    return predicted + residual


def _draw(digest: Column, number: int) -> Column:
    """One of the eight 32-bit numbers of a hex sha256."""
    return F.conv(F.substring(digest, 8 * number - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, and index, the learned index of the text.

    ``rate`` of 100 texts are cut, of these ``suffix_first`` of 100 put the suffix first.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("index", boundary_index("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = text.select("*", F.col("index.n").alias("n"), *[_draw(digest, i).alias(f"h{i}") for i in (1, 2, 3, 4)])
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(marker))
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    cut = F.col("form") != "plain"
    one, other = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    at = drawn.withColumn("form", form).select(
        "*",
        F.when(cut, offset_at("index", F.least(one, other))).alias("prefix_chars"),
        F.when(cut, offset_at("index", F.greatest(one, other))).alias("_to"),
    )
    parts = at.withColumn("middle_chars", F.col("_to") - F.col("prefix_chars"))
    prefix = F.expr("substring(text, 1, int(prefix_chars))")
    middle = F.expr("substring(text, int(prefix_chars) + 1, int(middle_chars))")
    suffix = F.expr("substring(text, int(_to) + 1)")
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    return parts.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.alias("output"), "index")


def restored(form: str = "form", output: str = "output") -> Column:
    """The text that an output was made of. A cut text holds no marker, so the output's three split it."""
    parts = F.split(F.col(output), "<[PSM]>")
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(F.col(form) == "psm", F.concat(first, middle, second)).when(F.col(form) == "spm", F.concat(second, middle, first)).otherwise(F.col(output))


def digests(filled: DataFrame) -> DataFrame:
    """The outputs and what they are restored to as sha256."""
    return filled.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"),
    )
