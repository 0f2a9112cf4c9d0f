"""Operator 3: passages of a benchmark in documents, by SimHash of item-sized windows.

A window is as many words as the item has. Its fingerprint is a 64-bit SimHash of its words,
each weighted by how often it occurs. The fingerprints are split into ``BLOCKS`` blocks; when
two fingerprints differ in at most ``RADIUS`` bits, some block differs in at most
``RADIUS // BLOCKS`` bits, so windows and items meet on equal blocks after every block value
of the items has been spread to its neighbours within that distance. No fingerprinted pair within
the radius is missed. What meets is verified exactly: the weighted Jaccard similarity of word
5-grams (sum of smaller counts over sum of larger counts) has to reach ``THRESHOLD``.

Windows are fingerprinted wherever that similarity can be reached: an item of n shingles and a
window of m need 4 (n + m) / 9 shared ones for 0.8, so every window that holds as many places
with a shingle of the item is taken, in whatever order they stand. Any other window would fail
the exact check, so the result is that of fingerprinting all windows. A text shorter than an
item has one window, the whole text.

Items of fewer than five words have one shingle of all their words. Null and blank texts and
items have no windows. Rows of one id are taken together; null ids are kept as they are. Further
columns are not looked at. The items are broadcast only while their shingles number at most
``BROADCAST_ROWS``; beyond that the joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hodos.llm.common import table, words
from hodos.session import scratch

SHINGLE, THRESHOLD = 5, 0.8
BITS, BLOCKS, RADIUS = 64, 8, 15
BROADCAST_ROWS = 500_000


def _shingle(width: int, at: Column) -> Column:
    """Hash of the ``width`` words of column ``w`` from position ``at``, counted from 0."""
    return F.xxhash64(*[F.get(F.col("w"), at + j) for j in range(width)])


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, w, size, width (of its shingles) for every item that has a word."""
    items = benchmark.select("item_id", words(F.col("text").cast("string")).alias("w")).filter(F.size("w") > 0)
    return items.withColumn("size", F.size("w")).withColumn("width", F.least(F.size("w"), F.lit(SHINGLE))).distinct()


def _spots(items: DataFrame, width: int) -> DataFrame:
    """shingle, item_id, size: the shingles of every item whose shingles have ``width`` words."""
    spots = items.filter(F.col("width") == width).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("size") - width)))
    return spots.select(_shingle(width, F.col("at")).alias("shingle"), "item_id", "size").distinct()


def _spans(texts: DataFrame, items: DataFrame, small: bool) -> DataFrame:
    """doc_id, copy, start, size: every window with as many of an item's shingles as THRESHOLD needs."""
    texts = texts.select("doc_id", "copy", words(F.col("text")).alias("w"))
    found = None
    widths = [r.width for r in items.select("width").distinct().collect()]  # at most SHINGLE of them
    for width in sorted(widths):
        spots = _spots(items, width)
        at = texts.filter(F.size("w") >= width).select("doc_id", "copy", "w", F.size("w").alias("n_words"), F.posexplode("w").alias("at", "word"))
        at = at.filter(F.col("at") <= F.col("n_words") - width).select("doc_id", "copy", "n_words", "at", _shingle(width, F.col("at")).alias("shingle"))
        met = at.join(F.broadcast(spots) if small else spots, "shingle")
        hits = met.groupBy("doc_id", "copy", "n_words", "item_id", "size").agg(F.sort_array(F.collect_set("at")).alias("hits"))
        n, m = F.col("size") - width + 1, F.least("size", "n_words") - width + 1
        need = F.ceil((n + m) * THRESHOLD / (1 + THRESHOLD) - 1e-9).cast("int")
        runs = hits.withColumn("m", m).withColumn("need", need).filter(F.size("hits") >= F.col("need"))
        # a window with that many hits starts at or before some hit and ends at or after the one ``need - 1`` on
        runs = runs.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("hits") - F.col("need"))))
        low = F.greatest(F.lit(0), F.get("hits", F.col("k") + F.col("need") - 1) - F.col("m") + 1)
        high = F.least(F.get("hits", F.col("k")), F.greatest(F.lit(0), F.col("n_words") - F.col("size")))
        runs = runs.select("doc_id", "copy", "size", low.alias("low"), high.alias("high")).filter("low <= high")
        part = runs.select("doc_id", "copy", F.explode(F.sequence("low", "high")).alias("start"), "size").distinct()
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = texts.limit(0).select("doc_id", "copy", F.lit(0).alias("start"), F.lit(0).alias("size"))
    return found.distinct()


def windows(documents: DataFrame, items: DataFrame, small: bool, folder: str) -> DataFrame:
    """doc_id, start, size, window (its words): every window that can be as similar as THRESHOLD to an item."""
    spark = documents.sparkSession
    text = F.col("text").cast("string")
    # rows of one id may have different texts, so a text is known by its id and its hash
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("copy"))
    spans = _spans(texts, items, small).groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    spans.write.parquet(f"{folder}/spans")
    spans = spark.read.parquet(f"{folder}/spans").withColumnsRenamed({"doc_id": "span_id", "copy": "span_copy"})
    met = texts.join(spans, (F.col("copy") == F.col("span_copy")) & F.col("doc_id").eqNullSafe(F.col("span_id")))
    met = met.select("doc_id", words(F.col("text")).alias("w"), F.explode("spans").alias("span"))
    return met.select("doc_id", "span.start", "span.size", F.slice("w", F.col("span.start") + 1, F.col("span.size")).alias("window")).distinct()


def fingerprinted(frame: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """``frame`` with ``print``: for each bit, whether the words that set it outweigh the others."""
    each = frame.select(*keys, F.explode(column).alias("word")).withColumn("h", F.xxhash64("word"))
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"s{j}") for j in range(BITS)]
    votes = each.groupBy(*keys).agg(*sums)
    value = F.lit(0).cast("long")
    for j in range(BITS):
        value = value.bitwiseOR(F.when(F.col(f"s{j}") > 0, F.shiftleft(F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long")))
    return votes.select(*keys, value.alias("print"))


def _block(value: Column, k: int) -> Column:
    wide = BITS // BLOCKS
    return F.shiftrightunsigned(value, k * wide).bitwiseAND(F.lit((1 << wide) - 1))


def _blocks(value: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), _block(value, k).cast("int").alias("value")) for k in range(BLOCKS)])


def _neighbours() -> list[int]:
    """All block values with at most RADIUS // BLOCKS bits set."""
    return [x for x in range(1 << (BITS // BLOCKS)) if bin(x).count("1") <= RADIUS // BLOCKS]


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of shingle hashes: smaller counts over larger counts."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.array_distinct(F.concat(a, b))
    low = F.aggregate(both, F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return low / (F.size(a) + F.size(b) - low)


def _shingles(column: str) -> Column:
    """Hashes of the 5-grams of an array of words, or of all its words where they are fewer."""
    w, n = F.col(column), F.size(column)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, SHINGLE), " ")))
    return F.when(n == 0, F.array().cast("array<long>")).otherwise(runs)


def contaminations(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, similarity): each item a document has, where it fits best.

    ``start`` counts words from 0; of equally similar windows the first is given.
    """
    spark = documents.sparkSession
    folder = scratch(spark, "windows")
    _items(benchmark).write.parquet(f"{folder}/items")
    items = spark.read.parquet(f"{folder}/items")
    shingles = items.agg(F.sum("size")).first()[0] or 0
    small = shingles * 2 <= BROADCAST_ROWS
    windows(documents, items, small, folder).write.parquet(f"{folder}/windows")
    spans = spark.read.parquet(f"{folder}/windows")

    keys = ["doc_id", "start", "size"]
    # windows of one place may differ where an id repeats, so the words belong to the key
    prints = fingerprinted(spans.withColumn("words", F.col("window")), "words", [*keys, "window"])
    wanted = fingerprinted(items.select("item_id", "size", "w"), "w", ["item_id", "size", "w"])
    spread = wanted.withColumn("block", F.explode(_blocks(F.col("print")))).withColumn("flip", F.explode(F.array(*[F.lit(x) for x in _neighbours()])))
    spread = spread.select("item_id", "size", F.col("block.k").alias("k"), F.col("block.value").bitwiseXOR(F.col("flip")).alias("value"), F.col("print").alias("item_print"))
    here = prints.withColumn("block", F.explode(_blocks(F.col("print")))).select(*keys, "window", "print", F.col("block.k").alias("k"), F.col("block.value").alias("value"))
    met = here.join(F.broadcast(spread) if small else spread, ["size", "k", "value"])
    met = met.filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    # a pair within the radius may meet in several blocks; it goes on from the first
    first = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda k: F.when(_flips(k) <= RADIUS // BLOCKS, k).otherwise(F.lit(BLOCKS))))
    met = met.filter(F.col("k") == first).select(*keys, "window", "item_id")
    own = items.select("item_id", "size", _shingles("w").alias("item_shingles"))
    pairs = met.join(F.broadcast(own) if small else own, ["item_id", "size"])
    pairs = pairs.withColumn("similarity", similarity(_shingles("window"), F.col("item_shingles"))).filter(F.col("similarity") >= THRESHOLD)
    best = F.max_by(F.struct("start", "similarity"), F.struct(F.col("similarity"), -F.col("start")))
    return pairs.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", F.col("best.start").cast("long").alias("start"), F.round("best.similarity", 6).alias("similarity"))


def _flips(k: Column) -> Column:
    """Bits in which block ``k`` of the two fingerprints differs."""
    differing = F.col("print").bitwiseXOR(F.col("item_print"))
    wide = BITS // BLOCKS
    return F.bit_count(F.call_function("shiftrightunsigned", differing, (k * wide).cast("int")).bitwiseAND(F.lit((1 << wide) - 1)))


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those in which an item was found. Rows of a null id are judged together."""
    bad = contaminations(documents, benchmark).select(F.col("doc_id").alias("bad_id")).distinct()
    return documents.join(bad, documents.doc_id.eqNullSafe(bad.bad_id), "left_anti")


def leaks(spark, sf_dir: str) -> DataFrame:
    """op3: doc_id, item_id, similarity over all of ``documents`` and ``benchmark``."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "similarity")


#: Every window of every document of an item's size, compared shingle by shingle.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS p FROM d WHERE len(w) >= 5)),
it AS (SELECT item_id, size, s, count(*) AS c FROM (
    SELECT item_id, len(w) AS size, array_to_string(w[q + 1:q + 5], ' ') AS s FROM (SELECT item_id, w, unnest(range(0, len(w) - 4)) AS q FROM i WHERE len(w) >= 5)) GROUP BY ALL),
hit AS (SELECT ds.doc_id, p, item_id, size, s, c FROM ds JOIN it USING (s)),
spots AS (SELECT DISTINCT h.doc_id, h.item_id, h.size, unnest(range(greatest(0, p - size + 5), least(p, len(w) - size) + 1)) AS start
  FROM hit h JOIN d USING (doc_id) WHERE len(w) >= size),
counted AS (SELECT x.doc_id, x.item_id, x.start, x.size, h.s, min(h.c) AS c, count(*) AS n
  FROM spots x JOIN hit h ON h.doc_id = x.doc_id AND h.item_id = x.item_id AND h.p BETWEEN x.start AND x.start + x.size - 5 GROUP BY ALL),
whole AS (SELECT doc_id, item_id, start, sum(least(c, n)) AS low, 2 * (any_value(size) - 4) - sum(least(c, n)) AS high FROM counted GROUP BY ALL)
SELECT doc_id, item_id, round(max(low / high), 6) AS similarity
FROM whole WHERE low / high >= 0.8 GROUP BY ALL
"""
