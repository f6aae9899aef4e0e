"""Document fingerprints by homomorphic multiset hashing, in DataFrame expressions only.

A document is the multiset of its paragraphs (lines with a character that is
not white space).  Every paragraph is hashed to a wide vector and the
fingerprint is the sum of the vectors modulo 2**32 in each lane, so the
order of paragraphs does not matter and one paragraph can be added or taken
away without the others.

* Lanes 0-7 are the eight 32-bit parts of the whole paragraph's SHA-256, so
  paragraphs that differ agree in all of them only where SHA-256 collides.
  Sums of lanes are no defence against someone who chooses many paragraphs.
* Lanes 8-71 are the paragraph's runs of three words hashed to 64 signs each
  and summed.  The squared length of a difference of two such sums estimates in
  how many runs the texts differ, which gives a likeness between 0 and 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmend.llm.common import text_of

EXACT = 8
SIGNS = 64
RUN = 3
_MASK = (1 << 32) - 1
_SPACE = r"[ \t\n\x0B\f\r]+"


def _units(text: Column) -> Column:
    """Array of ``(digest, h)``: a paragraph's SHA-256 in hex, or a hash of one of its word runs; the other is null."""
    paragraphs = F.filter(F.split(text, "\n"), lambda p: p.rlike(r"[^ \t\x0B\f\r]"))

    def runs(p):
        # An array of one word list, so that the words are a bound variable and split once.
        words = F.array(F.filter(F.split(p, _SPACE), lambda w: w != ""))
        return F.flatten(F.transform(words, lambda ws: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(ws) - (RUN - 1), F.lit(1))),
            lambda i: F.struct(F.lit(None).cast("string").alias("digest"), F.xxhash64(F.slice(ws, i, RUN)).alias("h")))))

    whole = F.transform(paragraphs, lambda p: F.struct(F.sha2(p, 256).alias("digest"), F.lit(None).cast("long").alias("h")))
    return F.concat(whole, F.flatten(F.transform(paragraphs, runs)))


def _lane_sums(digest: Column, h: Column) -> list[Column]:
    """Aggregates: exact lanes, then word-run bits, two 32-bit counters in each long."""
    exact = [F.sum(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")).alias(f"e{k}") for k in range(EXACT)]
    pair = F.lit((1 << 32) | 1)
    bits = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(pair)).alias(f"b{i}") for i in range(SIGNS // 2)]
    return [*exact, *bits, F.count(h).alias("n")]


def _lanes() -> Column:
    """All lanes modulo 2**32 as one array of longs from the columns of ``_lane_sums``."""
    def zero(c):
        return F.coalesce(F.col(c), F.lit(0).cast("long"))

    exact = [zero(f"e{k}").bitwiseAND(F.lit(_MASK)) for k in range(EXACT)]
    low = [zero(f"b{i}").bitwiseAND(F.lit(_MASK)) for i in range(SIGNS // 2)]
    high = [F.shiftrightunsigned(zero(f"b{i}"), 32) for i in range(SIGNS // 2)]
    signs = [(2 * c - zero("n")).bitwiseAND(F.lit(_MASK)) for c in [*low, *high]]
    return F.array(*exact, *signs)


def lanes_of(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` and ``lanes``: the fingerprint of each group of rows named by ``keys``.

    Texts of one group add up, like their paragraphs in one document.  Null
    and empty texts add nothing: a group of these has all lanes zero.
    """
    units = texts.select(*keys, F.explode_outer(_units(text_of(text_col))).alias("u")).select(*keys, "u.digest", "u.h")
    return units.groupBy(*keys).agg(*_lane_sums(F.col("digest"), F.col("h"))).select(*keys, _lanes().alias("lanes"))


def add(a: Column, b: Column) -> Column:
    """Fingerprint of both documents' paragraphs together."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(_MASK)))


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint of ``a`` without the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(_MASK)))


def as_text(lanes: Column) -> Column:
    """Eight lower-case hex digits a lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _signed(x: Column) -> Column:
    return F.when(x >= (1 << 31), x - (1 << 32)).otherwise(x).cast("double")


def _squares(lanes: Column) -> Column:
    return F.aggregate(F.slice(lanes, EXACT + 1, SIGNS), F.lit(0.0), lambda s, x: s + _signed(x) * _signed(x))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one less the estimated share of word runs that only one side has; equal fingerprints give 1."""
    total = _squares(a) + _squares(b)
    apart = _squares(subtract(a, b))
    return F.when(a == b, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / total)))


def _range_of(key: Column, cuts: list[int]) -> Column:
    """Number of ``cuts`` below ``key``, found in two steps of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i:i + width] for i in range(0, len(cuts), width)]
    longs = "array<bigint>"
    first = F.size(F.filter(F.array(*[F.lit(g[0]) for g in groups]).cast(longs), lambda c: c < key))
    fine = F.array(*[F.array(*[F.lit(c) for c in g]).cast(longs) for g in groups])
    inside = F.size(F.filter(F.get(fine, first - 1), lambda c: c < key))
    return F.when(first == 0, F.lit(0)).otherwise((first - 1) * width + inside)


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by
    the first as many (or all) of the next document in ascending id (after the
    last: the first).  Null ids come first, equal ids in order of a hash of the text;
    repeated rows stay; null texts are empty; one document alone is its own
    next.  Other columns are not read.  An empty table gives an empty result.

    Rows are dealt into ranges of ids (four for each shuffle partition); the
    first row of each range also goes, as a guest, to the range before, where
    it is the last row's next.  So texts are shuffled once and no task sorts
    more than a range.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # One long orders ids with nulls before all others.
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts_row = src.select(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n).alias("q")).first() if n > 1 else None
    cuts = sorted(set((cuts_row[0] or []) if cuts_row else []))
    bucketed = src.withColumn("key", key).withColumn("bucket", _range_of(F.col("key"), cuts)).withColumn("h", F.xxhash64("text"))
    firsts = bucketed.groupBy("bucket").agg(F.min(F.struct("key", "h")).alias("f"))  # one row a range
    every = Window.orderBy("bucket")
    host = F.coalesce(F.lag("bucket").over(every), F.last("bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    hosts = F.broadcast(firsts.select("bucket", F.col("f.key").alias("first_key"), F.col("f.h").alias("first_h"), host.alias("host")))
    home = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest"))
    copies = F.when((F.col("key") == F.col("first_key")) & (F.col("h") == F.col("first_h")),
                    F.array(home, F.struct(F.col("host").alias("b"), F.lit(1).alias("guest")))).otherwise(F.array(home))
    placed = bucketed.join(hosts, "bucket").select("doc_id", "text", "key", "h", F.inline(copies))
    order = Window.partitionBy("b").orderBy("guest", "key", "h", "text")
    rows = placed.withColumn("rn", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    n_chars = F.length("text").cast("long")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n_chars - half).cast("int")),
                      F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    both = rows.select("b", "rn", "guest", "doc_id", "text", n_chars.alias("n_chars"), F.when(F.col("guest") == 0, edited).alias("edited"))

    def side(text, number):
        return F.transform(_units(text), lambda u: F.struct(F.lit(number).alias("side"), u["digest"].alias("digest"), u["h"].alias("h")))

    # Everything made of texts is made before the explode; after it there is a row for each hash.
    ready = both.select("b", "rn", "guest", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.concat(
        side(F.col("text"), 0), side(F.coalesce("edited", F.lit("")), 1)).alias("units"))
    units = ready.select("b", "rn", "guest", "doc_id", "n_chars", "edited_sha256", F.explode_outer("units").alias("u"))
    sums = units.select("b", "rn", "guest", "doc_id", "n_chars", "edited_sha256", F.coalesce("u.side", F.lit(0)).alias("side"), "u.digest", "u.h")
    keys = ["b", "rn", "guest", "doc_id", "n_chars", "edited_sha256"]
    lanes = sums.groupBy(*keys, "side").agg(*_lane_sums(F.col("digest"), F.col("h"))).select(*keys, "side", _lanes().alias("lanes"))
    zero = F.array_repeat(F.lit(0).cast("long"), EXACT + SIGNS)
    wide = lanes.groupBy(*keys).agg(F.max(F.when(F.col("side") == 0, F.col("lanes"))).alias("own"),
                                    F.max(F.when(F.col("side") == 1, F.col("lanes"))).alias("edit"))
    wide = wide.withColumn("own", F.coalesce("own", zero)).withColumn("edit", F.coalesce("edit", zero))
    wide = wide.withColumn("next", F.lead("own").over(Window.partitionBy("b").orderBy("rn")))
    return wide.where("guest = 0").select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
