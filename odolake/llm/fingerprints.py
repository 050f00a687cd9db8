"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Paragraphs are what line feeds part. Each is hashed to a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors, each lane modulo 2^32; so it doesn't depend on their order, equal multisets have equal fingerprints,
and a paragraph is added to or taken from a fingerprint by adding or taking its vector (``changed``). A vector has

* ``TELLING`` lanes of 32 bits, uniform in the whole paragraph, which tell multisets apart, and
* ``LIKENESS`` lanes that sum +1 or -1 over the paragraph's pairs of neighbouring words, signs by a hash, kept as the number
  of +1; the last word's pair has no second. With ``units``, the number of pairs, the difference of two fingerprints estimates how many pairs
  differ: likeness = 1 - |A - B|^2 / (|A|^2 + |B|^2), within 0 and 1, standard error 0.12 at most.

The string is the hexadecimal lanes, eight digits each: telling lanes, units, likeness lanes. Everything is built-in column functions.

The next document is found by one range partitioning of ids. Only what an edit takes of the next text is sent to it.

Defined cases: a null text is empty, one empty paragraph. doc_id descends, null last, equal ids by a hash of the text. Rows
with equal doc_id and text are neighbours of each other in that order. A single row is its own next. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odolake.llm.common import kept, partitions

TELLING, LIKENESS = 16, 64
KEY = ("nul", "kid", "h")
_HALF = LIKENESS // 2
_LOW = (1 << 32) - 1
_WHITE = r"[\x20\x09-\x0D]+"


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").isNull().alias("nul"), F.coalesce("doc_id", F.lit(0)).alias("kid"), F.xxhash64(text).alias("h"), text.alias("text"))


def ring(rows: DataFrame) -> DataFrame:
    """For each distinct (doc_id, text): its key, copies, characters and the key of the next in descending order of doc_id."""
    order = [F.asc("nul"), F.desc("kid"), F.asc("h")]
    ids = rows.groupBy(*KEY).agg(F.count("*").alias("m"), F.max(F.char_length("text")).alias("n"))
    placed = kept(ids.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("pid", F.spark_partition_id()))
    here = F.struct(*KEY)
    within = Window.partitionBy("pid").orderBy(*order)
    numbered = placed.withColumn("after", F.lead(here).over(within)).withColumn("i", F.row_number().over(within))
    # One row for each range partition: where it begins.
    heads = numbered.where("i = 1").select("pid", here.alias("head"))
    around = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("pid", F.coalesce(F.lead("head").over(Window.orderBy("pid")), F.first("head").over(around)).alias("wrap"))
    return kept(numbered.join(heads, "pid").select(*KEY, "m", "n", F.coalesce("after", "wrap").alias("after")))


def _sums() -> list[Column]:
    """Sums over word pairs; a paragraph's telling lanes count with its first pair."""
    first = F.col("pos") == 0
    telling = []
    for j in range(TELLING // 2):
        lane = F.xxhash64("b1", "b2", F.lit(j))
        telling += [F.sum(F.when(first, x).otherwise(F.lit(0).cast("long"))).alias(f"t{2 * j + k}") for k, x in enumerate((lane.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(lane, 32)))]
    # Two lanes in one sum, 32 bits apart.
    both = F.lit((1 << 32) | 1)
    return [*telling, F.count("*").alias("units"), *(F.sum(F.shiftrightunsigned("unit", j).bitwiseAND(both)).alias(f"s{j}") for j in range(_HALF))]


def lanes(texts: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and the lanes, one array of longs, of the texts in column ``text``; ``by`` tells rows apart."""
    paragraphs = texts.select(*by, F.explode(F.split("text", "\n", -1)).alias("p"))
    words = F.split("p", _WHITE, -1)
    split = paragraphs.select(*by, F.xxhash64("p").alias("b1"), F.xxhash64(F.lit(1), "p").alias("b2"), words.alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    units = split.select(*by, "b1", "b2", F.posexplode(pairs).alias("pos", "unit"))
    summed = units.groupBy(*by).agg(*_sums())
    low = [F.col(f"s{j}").bitwiseAND(F.lit(_LOW)) for j in range(_HALF)]
    high = [F.shiftrightunsigned(f"s{j}", 32) for j in range(_HALF)]
    telling = [F.col(f"t{j}").bitwiseAND(F.lit(_LOW)) for j in range(TELLING)]
    return summed.select(*by, F.array(*telling, F.col("units").bitwiseAND(F.lit(_LOW)), *low, *high).alias("lanes"))


def written(lanes: Column) -> Column:
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def read(fingerprint: Column) -> Column:
    """The lanes of a written fingerprint."""
    at = F.sequence(F.lit(0), F.lit(TELLING + LIKENESS))
    return F.transform(at, lambda i: F.conv(F.substring(fingerprint, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def changed(fingerprint: Column, more: Column, add: bool = True) -> Column:
    """A written fingerprint after the paragraphs of another are added, or taken away."""
    return written(F.zip_with(read(fingerprint), read(more), lambda a, b: F.pmod(a + b if add else a - b, F.lit(1 << 32))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from the lanes of two fingerprints; equal fingerprints are 1 alike."""

    def squares(f):
        return F.aggregate(F.sequence(F.lit(TELLING + 2), F.lit(TELLING + LIKENESS + 1)), F.lit(0.0), lambda s, i: s + f(i) * f(i))

    def signed(x):
        return lambda i: (2 * F.element_at(x, i) - F.element_at(x, TELLING + 1)).cast("double")

    x, y = signed(a), signed(b)
    size = squares(x) + squares(y)
    same = F.when(a == b, 1.0).when(size == 0, 0.0)
    return same.otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - squares(lambda i: x(i) - y(i)) / size)))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of (doc_id: long, text: string)."""
    rows = _keyed(docs)
    order = ring(rows)
    texts = rows.dropDuplicates(list(KEY))
    cut = F.floor(F.col("n") / 2).cast("int")
    after = [F.col(f"after.{k}").alias(k) for k in KEY]
    own = [F.col(k).alias(f"own_{k}") for k in KEY]
    taken = order.select(*own, *after, cut.alias("cut")).join(texts, list(KEY)).select(*[F.col(f"own_{k}").alias(k) for k in KEY], F.expr("left(text, cut)").alias("start"))
    full = texts.join(order.select(*KEY, "m", "n"), list(KEY)).join(taken, list(KEY)).withColumn("cut", cut)
    # Of m equal rows, one has the next document as its next, the others each other: two variants at most.
    both_ways = F.array(F.lit(0), F.lit(1))
    variants = full.withColumn("self", F.explode(F.when(F.col("m") > 1, both_ways).otherwise(F.array(F.lit(0)))))
    start = F.when(F.col("self") == 0, F.col("start")).otherwise(F.expr("left(text, cut)"))
    edited = variants.select(*KEY, "self", "text", F.concat(F.expr("left(text, CAST(n - cut AS INT))"), start).alias("edited"))
    by = [*KEY, "self"]
    # The digest goes along as a grouping column, so the shuffled texts are gone through once.
    by = [*by, "sha"]
    edited = edited.withColumn("sha", F.unhex(F.sha2("edited", 256)))
    both = edited.select(*by, F.posexplode(F.array("text", "edited")).alias("which", "text"))
    sides = [F.max(F.when(F.col("which") == w, F.col("lanes"))).alias(name) for w, name in enumerate("ab")]
    paired = lanes(both, [*by, "which"]).groupBy(*by).agg(*sides)
    prints = kept(paired.join(order, list(KEY)))
    after = [F.when(F.col("self") == 0, F.col(f"after.{k}")).otherwise(F.col(k)).alias(f"next_{k}") for k in KEY]
    first = prints.where("self = 0").select(*[F.col(k).alias(f"next_{k}") for k in KEY], F.col("a").alias("c"))
    found = prints.select("nul", "kid", "n", "m", "self", "a", "b", "sha", *after).join(first, [f"next_{k}" for k in KEY])
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("self") == 0, F.lit(1).cast("long")).otherwise(F.col("m") - 1)))
    return found.withColumn("_", times).select(
        F.when(~F.col("nul"), F.col("kid")).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"),
        written(F.col("a")).alias("fingerprint"), written(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
