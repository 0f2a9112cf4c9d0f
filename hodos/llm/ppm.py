"""Operator 5: log probability of whole texts by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ``ORDER`` bytes with the count of every byte that
follows. A byte is coded in the longest known context: by its share there, or by an escape to the
next shorter context, in which the bytes seen in the longer one are excluded (escape method C: as
many escapes as different bytes). Below the empty context the bytes never seen share evenly.
Since every byte seen after a context is also seen after its suffixes, exclusion only needs, for
each context, how much of its suffix's counts its own bytes make up.

Training counts runs of ``ORDER + 1`` bytes in every task with numpy, adds them up by a shuffle
and stores the trie as Parquet in the shared folder. While all depths together have at most
``NODES`` contexts with a byte, workers read the trie once each, at about 60 bytes a node. Beyond
that they read at most ``NODES`` of its most frequent longest runs; all other runs of the texts
are looked up in the stored trie, depth by depth, by a shuffle. Both ways give the same scores,
of order ``ORDER``. Texts are worked through in blocks of ``BLOCK`` bytes.

The base score is an add-half unigram model over words, named by 64-bit hashes. Their counts are
added up by the same shuffle. Workers read those of at most ``COMMON`` most frequent words from
the shared folder; all other words are joined by a shuffle.

Defined results: null and empty texts are one end-of-text event for the base score, and for the
model as well, where byte 0 ends every text. Repeated rows are learned from as often as they
occur and scored each; null ids are kept. Without training rows the model is uniform. Further
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hodos.llm.common import blocks_of, fold, table, word_hashes
from hodos.session import scratch

ORDER, NODES = 4, 1 << 20
#: Words whose counts every worker holds, about 30 bytes each.
COMMON = 1 << 20
BLOCK = 1 << 19
#: Counts are ranked by this many steps for each doubling.
RANKS = 8


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, each text closed by END; number of bytes of the text before each, capped at ORDER)."""
    flat = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    depth = np.full(len(flat), ORDER, np.int8)
    starts = np.r_[0, ends[:-1]]
    for j in range(ORDER - 1, -1, -1):
        at = starts + j
        depth[at[at < ends]] = j
    return flat, depth


def _codes(flat: np.ndarray, order: int) -> np.ndarray:
    """At each place the byte and the ``order`` before it as one number, nearest byte lowest."""
    code = flat.astype(np.int64)
    for j in range(1, order + 1):
        code[j:] |= flat[:-j].astype(np.int64) << (8 * j)
    return code


# Nodes of the trie are named (depth << 48) | (context and byte); words by their hash.
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, name, times): 0 for the longest byte run at each place, 1 for words, 2 for texts."""

    def out(kind: int, names: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), kind, np.int32)), pa.array(names.astype(np.int64)), pa.array(times.astype(np.int64))], names=["kind", "name", "times"])

    _held.clear()  # a model of an earlier run is of no use while counting
    for batch in batches:
        texts = _lowered(batch)
        for a, b in blocks_of(texts, BLOCK):
            flat, depth = _flat(texts[a:b])
            code = _codes(flat, ORDER)
            for d in range(ORDER + 1):
                some, times = np.unique(code[depth == d] & ((1 << (8 * d + 8)) - 1), return_counts=True)
                yield out(0, (np.int64(d) << 48) | some, times)
            yield out(1, *np.unique(word_hashes(texts[a:b])[0].view(np.int64), return_counts=True))
        yield out(2, np.zeros(1), np.array([len(texts)]))


def _lowered(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode().lower() for t in batch["text"].to_pylist()]


def fit(texts: DataFrame, folder: str) -> dict:
    """Learns from column ``text``: the trie and the word counts below ``folder``, and
    ``tokens``, ``kinds`` and ``ends``, the training tokens, different ones, and texts."""
    spark = texts.sparkSession
    counts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "kind int, name long, times long").groupBy("kind", "name").agg(F.sum("times").alias("times"))
    counts.write.partitionBy("kind").parquet(f"{folder}/counts")
    counts = spark.read.schema("name long, times long, kind int").parquet(f"{folder}/counts")
    runs = counts.filter("kind = 0").select("times", F.shiftright("name", 48).cast("int").alias("depth"), F.col("name").bitwiseAND(F.lit((1 << 48) - 1)).alias("code"))
    # a run of d context bytes also counts in all of its shorter contexts
    parts = runs.select("code", "times", F.explode(F.sequence(F.lit(0), "depth")).alias("d"))
    mask = F.element_at(F.array(*[F.lit((1 << (8 * d + 8)) - 1) for d in range(ORDER + 1)]), F.col("d") + 1)
    nodes = parts.groupBy("d", F.col("code").bitwiseAND(mask).alias("code")).agg(F.sum("times").alias("times"))
    nodes.write.partitionBy("d").parquet(f"{folder}/trie")
    sizes = {r.d: r["count"] for r in spark.read.schema("code long, times long, d int").parquet(f"{folder}/trie").groupBy("d").count().collect()}
    held_whole = sum(sizes.values()) <= NODES
    if not held_whole:
        _store_contexts(spark, folder)

    vocabulary = counts.filter("kind = 1").select("name", "times", F.floor(F.log2("times") * RANKS).cast("int").alias("rank"))
    by_rank = sorted(((r["rank"], r["words"], r["tokens"]) for r in vocabulary.groupBy("rank").agg(F.count(F.lit(1)).alias("words"), F.sum("times").alias("tokens")).collect()), reverse=True)
    least, held = 1 << 20, 0
    for rank, some, _ in by_rank:
        held += some
        if held > COMMON:
            break
        least = rank
    vocabulary.filter(F.col("rank") >= least).select("name", "times").write.parquet(f"{folder}/common")
    vocabulary.filter(F.col("rank") < least).select("name", "times").write.parquet(f"{folder}/rare")
    ends = counts.filter("kind = 2").agg(F.sum("times")).first()[0] or 0
    return {"folder": folder, "deepest": max(sizes, default=-1), "held_whole": held_whole, "ends": ends, "tokens": sum(t for _, _, t in by_rank) + ends, "kinds": sum(w for _, w, _ in by_rank) + (ends > 0)}


def _masks(of: Column, masks: list[int]) -> Column:
    """The mask for each depth."""
    return F.element_at(F.array(*[F.lit(m).cast("long") for m in masks]), of + 1)


def _trie(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("code long, times long, d int").parquet(f"{folder}/trie")


def _store_contexts(spark: SparkSession, folder: str) -> None:
    """Below ``folder``: ``contexts``, what Trie knows of each context, and ``frequent``, the
    name and cost of the most frequent longest runs."""
    nodes = _trie(spark, folder).withColumn("up", F.col("code").bitwiseAND(_masks(F.col("d"), [(1 << (8 * d)) - 1 for d in range(ORDER + 1)])))
    above = _trie(spark, folder).select((F.col("d") + 1).alias("d"), F.col("code").alias("up"), F.col("times").alias("up_times"))
    contexts = nodes.join(above, ["d", "up"], "left").groupBy("d", F.shiftright("code", 8).alias("context"))
    contexts.agg(F.sum("times").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("up_times").alias("taken")).write.parquet(f"{folder}/totals")
    contexts = spark.read.parquet(f"{folder}/totals")
    above = contexts.select((F.col("d") + 1).alias("d"), F.col("context").alias("suffix"), F.col("total").alias("up_total"), F.col("kinds").alias("up_kinds"))
    suffix = F.col("context").bitwiseAND(_masks(F.col("d"), [0, *[(1 << (8 * d)) - 1 for d in range(ORDER)]]))
    others, left = F.col("up_kinds") - F.col("kinds"), F.col("up_total") - F.col("taken")
    contexts = contexts.withColumn("suffix", suffix).join(above, ["d", "suffix"], "left").select(
        "d", "context", "total", "kinds", (-F.log10(F.greatest(left + others, F.lit(1)))).alias("share"),
        F.when(others > 0, F.log10(others / F.greatest(left + others, F.lit(1)))).otherwise(0.0).alias("next"),
    )
    contexts.write.partitionBy("d").parquet(f"{folder}/contexts")

    longest = _trie(spark, folder).filter(F.col("d") == ORDER).withColumn("rank", F.floor(F.log2("times") * RANKS).cast("int"))
    least, held = 1 << 20, 0
    for r in sorted(longest.groupBy("rank").agg(F.count(F.lit(1)).alias("runs")).collect(), key=lambda r: -r["rank"]):
        held += r["runs"]
        if held > NODES:
            break
        least = r["rank"]
    known = _contexts(spark, folder).filter(F.col("d") == ORDER).select("context", "total", "kinds")
    frequent = longest.filter(F.col("rank") >= least).withColumn("context", F.shiftright("code", 8)).join(known, "context")
    name = F.col("code").bitwiseOR(F.lit(ORDER << 48))
    frequent.select(name.alias("name"), F.log10(F.col("times") / (F.col("total") + F.col("kinds"))).alias("cost")).write.parquet(f"{folder}/frequent")


def _contexts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("context long, total long, kinds long, share double, next double, d int").parquet(f"{folder}/contexts")


def _resolved(runs: DataFrame, folder: str) -> DataFrame:
    """(name, cost) of different runs ``name``: the steps of Trie.costs, one depth after the other."""
    spark = runs.sparkSession
    at = runs.select("name", F.shiftright("name", 48).cast("int").alias("depth"), F.col("name").bitwiseAND(F.lit((1 << 48) - 1)).alias("run"))
    at = at.withColumns({"cost": F.lit(0.0), "done": F.lit(False), "came": F.lit(False), "came_share": F.lit(0.0), "came_next": F.lit(0.0)})
    for d in range(ORDER, -1, -1):
        nodes = _trie(spark, folder).filter(F.col("d") == d).select(F.col("code").alias("here"), "times")
        contexts = _contexts(spark, folder).filter(F.col("d") == d).drop("d")
        # by their names, depths 0 and 1 have at most 65,536 nodes, depths to 2 as many contexts
        at = at.withColumn("here", F.col("run").bitwiseAND(F.lit((1 << (8 * d + 8)) - 1))).withColumn("context", F.shiftright("here", 8))
        at = at.join(F.broadcast(nodes) if d < 2 else nodes, "here", "left").join(F.broadcast(contexts) if d < 3 else contexts, "context", "left")
        todo = ~F.col("done") & (F.col("depth") >= d)
        hit, known, came = todo & F.col("times").isNotNull(), todo & F.col("times").isNull() & F.col("total").isNotNull(), F.col("came")
        whole = F.col("total") + F.col("kinds")
        step = F.when(hit & came, F.log10("times") + F.col("came_share")).when(hit, F.log10(F.col("times") / whole))
        step = step.when(known & came, F.col("came_next")).when(known, F.log10(F.col("kinds") / whole)).otherwise(0.0)
        at = at.select(
            "name", "depth", "run", (F.col("cost") + step).alias("cost"), (F.col("done") | hit).alias("done"), (came | known).alias("came"),
            F.when(known, F.col("share")).otherwise(F.col("came_share")).alias("came_share"),
            F.when(known, F.col("next")).otherwise(F.col("came_next")).alias("came_next"),
        )
    kinds = _trie(spark, folder).filter("d = 0").count()
    rest = float(-np.log10(256 - kinds)) if kinds < 256 else 0.0
    return at.select("name", (F.col("cost") + F.when(F.col("done"), 0.0).otherwise(rest)).alias("cost"))


class Names:
    """Places of 64-bit names in a sorted list: a table of one guess for each hash, and a
    binary search for names whose guess is another's."""

    def __init__(self, names: np.ndarray):
        self.names = names
        self.bits = max(4, int(len(names) * 3).bit_length())
        self.guess = np.zeros(1 << self.bits, np.int32)
        self.guess[self._hash(names)] = np.arange(len(names), dtype=np.int32)

    def _hash(self, names: np.ndarray) -> np.ndarray:
        return ((names.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether the name is there)."""
        if not len(self.names):
            return np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        place = self.guess[self._hash(names)]
        found = self.names[place] == names
        lost = np.flatnonzero(~found)
        again = np.minimum(np.searchsorted(self.names, names[lost]), len(self.names) - 1)
        place[lost] = again
        found[lost] = self.names[again] == names[lost]
        return place, found


class Trie:
    """For each depth the sorted codes (context and byte) with their counts and contexts, and the
    sorted contexts with the log10 costs of escaping from them."""

    def __init__(self, levels):
        """``levels``: (codes, times) of each depth from 0, codes in any order."""
        self.levels = []
        above = None
        for d, (codes, counts) in enumerate(levels):
            order = np.argsort(codes)
            codes, counts = codes[order], counts[order]
            contexts, first = np.unique(codes >> 8, return_index=True)
            total, kinds = np.add.reduceat(counts, first), np.diff(np.r_[first, len(codes)])
            level = {"codes": codes, "contexts": contexts, "code_names": Names(codes), "context_names": Names(contexts), "escape": np.log10(kinds / (total + kinds))}
            level["owner"] = np.repeat(np.arange(len(contexts), dtype=np.int32), kinds)
            level["counts"] = counts.astype(np.int32) if counts.max() < 1 << 31 else counts
            if above is not None:
                # what this context's bytes make up of its suffix's counts, and what is left there
                suffix = codes & ((1 << (8 * d)) - 1)
                taken = np.add.reduceat(above["counts"][np.searchsorted(above["codes"], suffix)].astype(np.int64), first)
                up = np.searchsorted(above["contexts"], contexts & ((1 << (8 * (d - 1))) - 1))
                left, others = above["total"][up] - taken, above["kinds"][up] - kinds
                level["share"] = -np.log10(np.maximum(left + others, 1))
                level["next"] = np.where(others > 0, np.log10(np.maximum(others, 1) / np.maximum(left + others, 1)), 0.0)
            level["total"], level["kinds"] = total, kinds.astype(np.int32)
            above = level
            self.levels.append(level)
        self.deepest = len(self.levels) - 1
        kinds = self.levels[0]["kinds"][0] if self.levels else 0
        self.rest = -np.log10(256 - kinds) if kinds < 256 else 0.0

    def costs(self, flat: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """log10 probability of every byte; ``reach`` bytes before it belong to its text."""
        out = np.zeros(len(flat))
        code = _codes(flat, max(self.deepest, 0))
        # where a place stands: -1 not begun, else the context it escaped from last
        todo, came = np.arange(len(flat)), np.full(len(flat), -1, np.int64)
        for d in range(self.deepest, -1, -1):
            level, deeper = self.levels[d], self.levels[d + 1] if d < self.deepest else None
            here = code[todo] & ((1 << (8 * d + 8)) - 1)
            spot, hit = level["code_names"].find(here)
            hit &= reach[todo] >= d
            fresh = came[todo] < 0
            a = hit & fresh
            own = level["owner"][spot[a]]
            out[todo[a]] += np.log10(level["counts"][spot[a]] / (level["total"][own] + level["kinds"][own]))
            a = hit & ~fresh
            if deeper is not None and a.any():
                out[todo[a]] += np.log10(level["counts"][spot[a]]) + deeper["share"][came[todo[a]]]
            todo, here, fresh = todo[~hit], here[~hit], fresh[~hit]
            context, known = level["context_names"].find(here >> 8)
            known &= reach[todo] >= d
            a = known & fresh
            out[todo[a]] += level["escape"][context[a]]
            a = known & ~fresh
            if deeper is not None and a.any():
                out[todo[a]] += deeper["next"][came[todo[a]]]
            came[todo[known]] = context[known]
        out[todo] += self.rest
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in blocks_of(texts, BLOCK):
            flat, reach = _flat(texts[a:b])
            lengths = np.fromiter((len(t) + 1 for t in texts[a:b]), np.int64, b - a)
            out[a:b] = np.add.reduceat(self.costs(flat, reach), np.cumsum(lengths) - lengths)
        return out


def _read(folder: str) -> pa.Table | None:
    files, base = fs.FileSystem.from_uri(folder)
    found = files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    parts = [pq.ParquetFile(files.open_input_file(f.path)).read() for f in found if f.path.endswith(".parquet")]
    return pa.concat_tables(parts) if parts else None


#: What this worker has read, by folder; at most one model.
_held: dict[str, tuple[Trie | Frequent, Names, np.ndarray]] = {}


class Frequent:
    """The costs of the most frequent longest runs; the others are given back by their names."""

    def __init__(self, names: np.ndarray, costs: np.ndarray):
        order = np.argsort(names)
        self.names, self.costs = Names(names[order]), costs[order]

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the sum of known costs; (text, run, times) of all other runs, by text."""
        out, rest = np.zeros(len(texts)), []
        for a, b in blocks_of(texts, BLOCK):
            flat, depth = _flat(texts[a:b])
            owner = np.repeat(np.arange(a, b), [len(t) + 1 for t in texts[a:b]])
            depth = depth.astype(np.int64)
            names = (depth << 48) | (_codes(flat, ORDER) & ((np.int64(1) << (8 * depth + 8)) - 1))
            place, known = self.names.find(names)
            if known.any():
                out += np.bincount(owner[known], self.costs[place[known]], len(texts))
            names, owner = names[~known], owner[~known]
            order = np.lexsort((names, owner))
            names, owner = names[order], owner[order]
            first = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])]) if len(names) else np.zeros(0, int)
            rest.append((owner[first], names[first], np.diff(np.r_[first, len(names)])))
        return out, *(np.concatenate([r[k] for r in rest] or [np.zeros(0, np.int64)]) for k in range(3))


def _learned(folder: str, deepest: int, held_whole: bool) -> tuple[Trie | Frequent, Names, np.ndarray]:
    """The trie or its frequent runs, and the names and counts of the common words, once for each worker."""
    if folder in _held:
        return _held[folder]
    _held.clear()
    if held_whole:
        read = (_read(f"{folder}/trie/d={d}") for d in range(deepest + 1))
        model = Trie((t["code"].to_numpy(), t["times"].to_numpy()) for t in read)
    else:
        frequent = _read(f"{folder}/frequent")
        model = Frequent(*(frequent[c].to_numpy() if frequent is not None else np.zeros(0, t) for c, t in (("name", np.int64), ("cost", float))))
    common = _read(f"{folder}/common")
    names, counts = (common[c].to_numpy() if common is not None else np.zeros(0, np.int64) for c in ("name", "times"))
    order = np.argsort(names)
    _held[folder] = model, Names(names[order]), counts[order]
    return _held[folder]


def scored(rows: DataFrame, model: dict, folder: str) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of ``rows`` (doc_id, text)."""
    spark = rows.sparkSession
    where, deepest, held_whole, floor = model["folder"], model["deepest"], model["held_whole"], np.log10(model["tokens"] + 0.5 * (model["kinds"] + 1))
    ends, uncounted = model["ends"], np.log10(0.5)

    def run(batches):
        trie, names, counts = _learned(where, deepest, held_whole)
        for batch in batches:
            texts = _lowered(batch)
            for a, b in blocks_of(texts, BLOCK):
                none = np.zeros(0, np.int64)
                score, run_of, runs, run_times = (trie.score(texts[a:b]), none, none, none) if held_whole else trie.score(texts[a:b])
                run_cuts = pa.array(np.searchsorted(run_of, np.arange(b - a + 1)).astype(np.int32))
                hashes, owner = word_hashes(texts[a:b])
                hashes = hashes.view(np.int64)
                place, known = names.find(hashes)
                n = b - a
                tokens = np.bincount(owner, minlength=n)
                logs = np.where(known, np.log10(counts[place] + 0.5), 0.0) if len(counts) else np.zeros(len(hashes))
                had = np.bincount(owner[known], minlength=n)
                # words that are not common: once for each text, with how often they occur
                rare = np.lexsort((hashes[~known], owner[~known]))
                word, of = hashes[~known][rare], owner[~known][rare]
                first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (of[1:] != of[:-1])]) if len(word) else np.zeros(0, int)
                cuts = np.searchsorted(of[first], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(a, n), pa.array(tokens + 1), pa.array(had + (ends > 0)),
                        pa.array(np.bincount(owner, logs, n) + np.log10(ends + 0.5)), pa.array(score),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(word[first])),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.diff(np.r_[first, len(word)]).astype(np.int32))),
                        pa.ListArray.from_arrays(run_cuts, pa.array(runs)), pa.ListArray.from_arrays(run_cuts, pa.array(run_times.astype(np.int32))),
                    ],
                    names=["doc_id", "n_tokens", "known", "logs", "score", "words", "times", "runs", "run_times"],
                )

    kinds = "doc_id long, n_tokens long, known long, logs double, score double, words array<long>, times array<int>, runs array<long>, run_times array<int>"
    base = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base.mapInArrow(run, kinds).withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{folder}/texts")
    texts = spark.read.parquet(f"{folder}/texts")
    each = texts.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("name"), F.col("w.times").alias("n"))
    rare = spark.read.parquet(f"{where}/rare")
    met = each.join(rare, "name").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("times") + F.lit(0.5))).alias("plus"))
    out = texts.drop("words", "times", "runs", "run_times").join(met, "row", "left")
    if not held_whole:
        left = texts.select("row", F.explode(F.arrays_zip("runs", "run_times")).alias("r")).select("row", F.col("r.runs").alias("name"), F.col("r.run_times").alias("n"))
        _resolved(left.select("name").distinct(), where).write.parquet(f"{folder}/costs")
        rest = left.join(spark.read.parquet(f"{folder}/costs"), "name").groupBy("row").agg(F.sum(F.col("n") * F.col("cost")).alias("rest"))
        out = out.join(rest, "row", "left").withColumn("score", F.col("score") + F.coalesce("rest", F.lit(0.0)))
    known = F.col("known") + F.coalesce("more", F.lit(0))
    total = F.col("logs") + F.coalesce("plus", F.lit(0.0)) + (F.col("n_tokens") - known) * float(uncounted) - F.col("n_tokens") * float(floor)
    unseen = 0.0 if ends else float(-uncounted)  # the end event is in logs already
    return out.select("doc_id", "n_tokens", known.cast("long").alias("n_known"), (total + unseen).alias("base_score"), "score")


def language_model(spark, sf_dir: str) -> DataFrame:
    """op5: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all ``documents``."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch(spark, "ppm")
    held_out = fold(F.col("doc_id"), 5) == 1
    model = fit(documents.filter(~held_out), folder)
    out = scored(documents, model, f"{folder}/scores")
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
