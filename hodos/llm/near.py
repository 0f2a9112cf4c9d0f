"""Operator 2: texts of Jaccard similarity 0.8 or more over word 5-grams, by a MinHash forest.

Every distinct text gets a signature of minima, ``DEPTH`` for each tree; a tree is the trie of
those. At a level (a prefix length) two texts meet where they share that prefix in one of the
first ``trees(level)`` trees, as many as it takes to miss no more of the pairs at the threshold
than that level's part of ``1 - RECALL``.

How long the prefixes of a text are follows from the data. All texts meet at the shortest level
first. A text that meets more than ``CROWD`` others there is in a crowded part of the tries: it
looks at every level and takes the one at which it meets fewest, the shorter of equal ones. A
pair is examined at the shorter level of its two texts, so at a level only those texts meet that
took it or a longer one, and two texts that both took a longer one are not compared there.
Whichever levels the data choose, a pair can only be missed if one of the levels misses it, and
all levels together miss at most ``1 - RECALL`` of the pairs at the threshold; that includes
pairs whose whole signature agrees in less than ``DOUBT``, which are not verified. The walk goes
from short prefixes to long ones and subtries are runs of rows of one prefix, by name: texts that
meet nobody, most of them, are left after the shortest level.

A pair belongs to the first tree it meets in, so it is verified once, exactly, on the sets of
shingle hashes. A subtrie of many texts is cut into blocks and each pair of blocks is a task
group of its own, so neither a subtrie nor its pairs come to one task; pairs are counted where
they are found and only a spanning set of links leaves the task.

Defined results: copies are texts that are equal byte for byte, and a text's copies are linked
to each other and to whatever the text is linked to. Texts of fewer than five words have one
shingle of all their words. Null texts and those without words are linked to nothing, copies
included. Rows are kept as they are: repeated rows count as copies of each other. Null ids are
kept; a class whose ids are all null has a null class id. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hodos.llm.common import attached, blocks_of, free, mixed, shingle_hashes, table
from hodos.session import cut, scratch

SHINGLE, THRESHOLD = 5, 0.8
RECALL = 0.9995
LEVELS = (2, 3, 4, 5)
DEPTH = LEVELS[-1]
#: Texts a block holds; a task group holds two blocks.
BLOCK = 256
#: Texts met at the shortest level, over all trees, beyond which longer prefixes are looked at.
CROWD = 64
#: Pairs whose signatures agree in less are not verified: one in 10 ** 9 at the threshold.
DOUBT = 0.55


def trees(level: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """How many trees it takes for pairs of ``threshold`` to share a prefix of ``level`` minima in
    one of them, but for a miss of one part in ``len(LEVELS)`` of ``1 - recall``."""
    return ceil(log(0.99 * (1 - recall) / len(LEVELS)) / log(1 - threshold**level))


#: A minimum is kept by 16 bits of its hash: minima of long texts all are small numbers, so their own leading
#: bits would agree. Chance agreements only add candidates, and at longer prefixes hardly any.
TREES = trees(DEPTH)


def missed(threshold: float = THRESHOLD) -> float:
    """A bound on the share of pairs of ``threshold`` that are not verified, whatever the levels."""
    n = TREES * DEPTH
    doubted = sum(comb(n, k) * threshold**k * (1 - threshold) ** (n - k) for k in range(ceil(DOUBT * n)))
    return sum((1 - threshold**level) ** trees(level) for level in LEVELS) + doubted


_rng = np.random.default_rng(97)
_TIMES = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(minima [n, TREES * DEPTH] as uint16, whether the text has a word)."""
    out, some = np.full((len(texts), TREES * DEPTH), 0xFFFF, np.uint16), np.zeros(len(texts), bool)
    for a, b in blocks_of(texts, 1 << 20):
        hashes, owner = shingle_hashes(texts[a:b], SHINGLE)
        if len(hashes):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            some[a + owner[first]] = True
            for k in range(TREES * DEPTH):
                out[a + owner[first], k] = mixed(np.minimum.reduceat(hashes * _TIMES[k] + _PLUS[k], first)) >> np.uint64(48)
    return out, some


def prefixes(minima: np.ndarray, level: int) -> np.ndarray:
    """[n, trees(level)]: a 64-bit name of each text's prefix of ``level`` minima in each tree."""
    name = np.full((len(minima), trees(level)), level, np.uint64)
    for j in range(level):
        name = mixed(name * np.uint64(31) + minima[:, j::DEPTH][:, : trees(level)].astype(np.uint64) + np.uint64(1))
    return mixed(name + np.arange(trees(level), dtype=np.uint64)).astype(np.int64)


def _signed(rows: DataFrame) -> DataFrame:
    """copy, doc_id, minima (null where the text has no word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minima, some = signatures([(t or "").encode() for t in batch["text"].to_pylist()])
            kept = pa.array([m.tobytes() if s else None for m, s in zip(minima, some)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["copy"], batch["doc_id"], kept], names=["copy", "doc_id", "minima"])

    return rows.mapInArrow(run, "copy string, doc_id long, minima binary")


def _entries(nodes: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """copy, level, prefix: the names of every text's prefixes at ``levels``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minima = np.frombuffer(b"".join(batch["minima"].to_pylist()), np.uint16).reshape(-1, TREES * DEPTH)
            for level in levels:
                names = prefixes(minima, level)
                copies = batch["copy"].take(pa.array(np.repeat(np.arange(len(names)), names.shape[1])))
                yield pa.RecordBatch.from_arrays([copies, pa.array(np.full(names.size, level, np.int32)), pa.array(names.ravel())], names=["copy", "level", "prefix"])

    return nodes.select("copy", "minima").mapInArrow(run, "copy string, level int, prefix long")


def _meeting(nodes: DataFrame, levels: tuple[int, ...], folder: str) -> DataFrame:
    """copy, level, prefix, size: the prefixes that ``size`` > 1 of the texts share."""
    spark = nodes.sparkSession
    _entries(nodes, levels).write.parquet(f"{folder}/entries{levels[0]}")
    entries = spark.read.parquet(f"{folder}/entries{levels[0]}")
    sizes = entries.groupBy("prefix").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").withColumn("times", F.col("size"))
    sizes.write.parquet(f"{folder}/sizes{levels[0]}")
    sizes = spark.read.parquet(f"{folder}/sizes{levels[0]}")
    attached(entries, sizes, "prefix", "times", entries.count()).select("copy", "level", "prefix", "size").write.parquet(f"{folder}/meeting{levels[0]}")
    return spark.read.parquet(f"{folder}/meeting{levels[0]}")


def levelled(nodes: DataFrame, folder: str) -> DataFrame:
    """copy, level, prefix, size, own: the subtries in which the texts of ``nodes`` (copy, minima)
    meet and the level each text took, for those levels up to its own."""
    spark = nodes.sparkSession
    first = LEVELS[0]
    short = _meeting(nodes, LEVELS[:1], folder)
    crowded = short.groupBy("copy").agg(F.sum(F.col("size") - 1).alias("met")).filter(F.col("met") > CROWD)
    crowded.write.parquet(f"{folder}/crowded")
    crowded = spark.read.parquet(f"{folder}/crowded")
    long = _meeting(nodes.join(crowded, "copy", "left_semi"), LEVELS[1:], folder)
    totals = long.groupBy("copy").agg(*(F.sum(F.when(F.col("level") == d, F.col("size") - 1).otherwise(0)).alias(f"met{d}") for d in LEVELS[1:]))
    choices = [F.struct(F.col("met").alias("met"), F.lit(first).alias("level"))]
    choices += [F.struct(F.coalesce(f"met{d}", F.lit(0)).alias("met"), F.lit(d).alias("level")) for d in LEVELS[1:]]
    crowded.join(totals, "copy", "left").select("copy", F.array_min(F.array(*choices))["level"].alias("took")).write.parquet(f"{folder}/took")
    took = spark.read.parquet(f"{folder}/took")
    every = short.join(took, "copy", "left").unionByName(long.join(took, "copy"))
    return every.withColumn("own", F.coalesce("took", F.lit(first))).drop("took").filter("level <= own")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of equal (prefix, low, high) in sorted batches, put together over their edges."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("prefix", "low", "high")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if rest and tuple(keys[:, 0]) != tuple(rest[-1][c][-1].as_py() for c in ("prefix", "low", "high")):
            yield pa.Table.from_batches(rest)
            rest = []
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            rest.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(rest)
                rest = []
    if rest:
        yield pa.Table.from_batches(rest)


def _candidates(group: pa.Table) -> np.ndarray:
    """[n, n] upper triangle: pairs that this group has to verify."""
    minima = np.frombuffer(b"".join(group["minima"].to_pylist()), np.uint16).reshape(-1, TREES * DEPTH)
    low, high, block = group["low"][0].as_py(), group["high"][0].as_py(), group["block"].to_numpy()
    level, own = group["level"][0].as_py(), group["own"].to_numpy()
    n, names = len(minima), prefixes(minima, level)
    pairs = np.triu((own[:, None] == level) | (own[None, :] == level), 1)
    if low != high:
        pairs &= block[:, None] != block[None, :]
    tree = int(np.flatnonzero(names[0] == group["prefix"][0].as_py())[0])
    for t in range(tree):
        pairs &= names[:, t][:, None] != names[:, t][None, :]
    a, b = np.nonzero(pairs)
    for at in range(0, len(a), 1 << 14):
        s = slice(at, at + (1 << 14))
        pairs[a[s], b[s]] = (minima[a[s]] == minima[b[s]]).mean(axis=1) >= DOUBT
    return pairs


def _worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each group that have a pair to verify in it."""
    for group in _groups(batches):
        pairs = _candidates(group)
        some = pairs.any(axis=0) | pairs.any(axis=1)
        if some.any():
            yield from group.filter(pa.array(some)).combine_chunks().to_batches()


def similar(texts: list[bytes], pairs: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The pairs [k, 2] of ``pairs`` (upper triangle) whose exact similarity reaches ``threshold``."""
    hashes, owner = shingle_hashes(texts, SHINGLE)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])] if len(hashes) else np.zeros(0, bool)
    hashes, owner = hashes[keep], owner[keep]
    sizes = np.bincount(owner, minlength=len(texts))
    a, b = np.nonzero(pairs)
    if len(a) <= 4 * len(texts):
        ends = np.cumsum(sizes)
        sets = [hashes[e - s : e] for e, s in zip(ends, sizes)]
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    else:
        shared = np.zeros((len(texts), len(texts)), np.float32)
        column = np.unique(hashes, return_inverse=True)[1]
        by = np.argsort(column, kind="stable")
        column, rows = column[by], owner[by]
        for at in range(0, (column[-1] + 1) if len(column) else 0, 4096):
            x, y = np.searchsorted(column, [at, at + 4096])
            has = np.zeros((len(texts), 4096), np.float32)
            has[rows[x:y], column[x:y] - at] = 1
            shared += has @ has.T
        common = np.rint(shared[a, b]).astype(np.int64)
    return np.stack([a, b], 1)[common >= threshold * (sizes[a] + sizes[b] - common) - 1e-9]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each member that has a link: how many documents it links to here, and a member that
    all of its group's connected part point to."""
    for group in _groups(batches):
        texts = [t.encode() for t in group["text"].to_pylist()]
        links = similar(texts, _candidates(group))
        if not len(links):
            continue
        times, copies = group["times"].to_numpy(), group["copy"].to_pylist()
        count, root = np.zeros(len(texts), np.int64), list(range(len(texts)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        np.add.at(count, links[:, 0], times[links[:, 1]])
        np.add.at(count, links[:, 1], times[links[:, 0]])
        for i, j in links.tolist():
            i, j = top(i), top(j)
            root[max(i, j)] = min(i, j)
        have = np.flatnonzero(count).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([copies[i] for i in have]), pa.array([copies[top(i)] for i in have]), pa.array(count[have])], names=["copy", "root", "links"])


def blocked(members: DataFrame, folder: str) -> DataFrame:
    """copy, prefix, level, own, block, low, high: every text of ``members`` once for each pair
    (low, high) of blocks it is compared in.

    Only pairs with a text that took the subtrie's level are compared. A large subtrie therefore
    has blocks of those texts first and blocks of the others behind them, and no pair of blocks
    has two of the others'.
    """
    spark = members.sparkSession
    took = F.sum((F.col("own") == F.col("level")).cast("long"))
    sizes = members.groupBy("prefix").agg(F.count(F.lit(1)).alias("times"), took.alias("lookers")).filter("times > 1 and lookers > 0")
    whole = F.col("times") <= BLOCK
    lookers = F.when(whole, 1).otherwise(F.ceil(F.col("lookers") / BLOCK)).cast("long")
    others = F.when(whole, 0).otherwise(F.ceil((F.col("times") - F.col("lookers")) / BLOCK)).cast("long")
    sizes.select("prefix", "times", lookers.alias("lookers"), others.alias("others")).write.parquet(f"{folder}/blocks")
    members = attached(members.drop("size"), spark.read.parquet(f"{folder}/blocks"), "prefix", "times", members.count())
    looks = (F.col("own") == F.col("level")) | (F.col("others") == 0)
    number = F.xxhash64("copy", "prefix")
    members = members.withColumn("block", F.when(looks, F.pmod(number, F.col("lookers"))).otherwise(F.col("lookers") + F.pmod(number, F.greatest("others", F.lit(1)))))
    partners = F.when(looks, F.col("lookers") + F.col("others")).otherwise(F.col("lookers"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), partners - 1)))
    return members.select("copy", "prefix", "level", "own", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def _dealt(rows: DataFrame) -> DataFrame:
    keys = ["prefix", "low", "high"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "copy")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the least node it is connected to.

    Least-neighbour steps, each followed by a jump to the root's root, until nothing changes.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    roots = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")))
    while True:
        near = both.join(roots, both.b == roots.node).groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near, roots.node == near.a).select("node", "root", F.least("root", "near").alias("next"))
        above = step.select(F.col("node").alias("above"), F.col("next").alias("over"))
        after = cut(step.join(above, step.next == above.above).select("node", F.least("next", "over").alias("root"), (F.least("next", "over") != F.col("root")).alias("moved")))
        roots = after.select("node", "root")
        if not after.filter("moved").limit(1).count():
            return roots


def text_copy(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def linked(documents: DataFrame) -> DataFrame:
    """(doc_id, copy, class_id, n_links) for every row: the least id of its connected class and
    the number of other rows whose text is similar or equal."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("copy", text_copy(F.col("text")))
    folder = scratch(spark, "forest")
    _signed(rows).write.parquet(f"{folder}/signed")
    signed = spark.read.parquet(f"{folder}/signed")
    nodes = signed.groupBy("copy").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("times"), F.min("minima").alias("minima"))
    nodes.write.parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")

    levelled(nodes.filter("minima is not null"), folder).write.parquet(f"{folder}/levelled")
    members = blocked(spark.read.parquet(f"{folder}/levelled"), folder)
    kinds = "prefix long, low long, high long, level int, own int, copy string, block long, times long, minima binary"
    met = _dealt(members.join(nodes.select("copy", "times", "minima"), "copy").select("prefix", "low", "high", "level", "own", "copy", "block", "times", "minima"))
    met.mapInArrow(_worth, kinds).write.parquet(f"{folder}/met")
    met = spark.read.parquet(f"{folder}/met")

    wanted = nodes.join(met.select("copy").distinct(), "copy", "left_semi").select("copy", F.col("least"))
    texts = rows.join(wanted, (rows.copy == wanted.copy) & rows.doc_id.eqNullSafe(wanted.least)).select(rows.copy, "text").dropDuplicates(["copy"])
    verified = _dealt(met.join(texts, "copy").select(*met.columns, "text")).mapInArrow(_verify, "copy string, root string, links long")
    verified.write.parquet(f"{folder}/links")
    links = spark.read.parquet(f"{folder}/links")

    roots = components(links.select(F.col("copy").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("copy").agg(F.sum("links").alias("links"))
    known = nodes.join(counts, "copy", "left").join(roots, nodes.copy == roots.node, "left")
    known = known.select(nodes.copy, "least", "times", F.col("minima").isNotNull().alias("some"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", nodes.copy).alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("class_id"))
    found = known.join(least, "root").select("copy", "times", "some", "class_id", (F.col("links") + F.col("times") - 1).alias("n_links"))
    found.write.parquet(f"{folder}/found")
    found = spark.read.parquet(f"{folder}/found")
    total = found.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    return attached(signed.select("doc_id", "copy"), found, "copy", "times", total).select(
        "doc_id", "copy", F.when(F.col("some"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("some"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links")
    )


def deduplicated(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each class left, the one of the least id, and all rows
    whose text has no word."""
    verdict = linked(documents).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    keep = verdict.select(F.col("doc_id").alias("kept_id"), F.col("copy").alias("kept_copy")).distinct()
    name = free("copy", documents.columns)
    marked = documents.withColumn(name, text_copy(F.col("text")))
    kept = marked.join(keep, marked.doc_id.eqNullSafe(keep.kept_id) & (marked[name] == keep.kept_copy), "left_semi")
    worded = F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit("\x20\t\n\x0b\x0c\r"))) > 0
    once = kept.filter(worded).dropDuplicates(["doc_id", name])
    return once.unionByName(kept.filter(~worded)).drop(name)


def near(spark, sf_dir: str) -> DataFrame:
    """op2: doc_id, class_id, n_links for every row of ``documents``."""
    return linked(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


#: All pairs that share a shingle, counted one by one, and classes by repeated least ids.
SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM worded WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(y) FROM reach r WHERE r.x = d.doc_id), d.doc_id)) AS class_id,
  (SELECT count(*) FROM links l WHERE l.x = d.doc_id) AS n_links
FROM documents d
"""
