"""Operator 10: token ids written in training order, as shards of records of one length.

Every text is encoded, closed with the end id and cut into sequences of ``LENGTH`` ids; the
last one is filled up with end ids. Sequences are numbered through all rows, and a keyed Feistel
permutation of the numbers (walked until it is back inside them) gives each its slot in the
training order. Shard k holds the slots from k * ``PER_SHARD`` on; in it record i begins at
``HEADER + i * 2 * LENGTH``, so any slot is found by arithmetic and a reader resumes anywhere.

The input is read twice, once to count each scan partition's sequences and once to write them,
so it has to be a table in files, whose partitions hold the same rows each time; what is not is
written to the shared folder first. A partition whose count differs fails the job. The driver
gets one number for each scan partition. Shards are written under another name, then renamed: a
task that runs again replaces its shard by the same bytes.

Defined results: null and empty texts are one sequence of end ids with ``n_tokens`` 1; repeated
rows get sequences and slots of their own; null ids stay null. Of an empty table no shard is
written. Further columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from hodos.llm.bpe import END, RANKS, encoder
from hodos.llm.common import table
from hodos.session import scratch

LENGTH, PER_SHARD, KEY, ROUNDS = 512, 32768, 20240917, 6
#: Magic, ids a record, first slot, records.
HEAD = "<8sQQQ"
MAGIC, HEADER = b"SEQSHARD", struct.calcsize(HEAD)


def permuted(index: np.ndarray, count: int, key: int = KEY) -> np.ndarray:
    """The slot of each of ``index`` in a keyed permutation of range(count)."""
    half = max(1, -(-max(1, (count - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([key, count]).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            x = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, (left ^ (x >> np.uint64(31))) & mask
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= count]
    return out.astype(np.int64)


def _encoded(batches: Iterator[pa.RecordBatch], ranks: str) -> Iterator[tuple[int | None, bytes]]:
    known, end = encoder(ranks), np.array([END], "<u2").tobytes()
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            yield doc_id, known.encode(text or "") + end


def _pieces(size: int, length: int) -> int:
    return -(-size // (2 * length))


def write_shards(documents: DataFrame, folder: str, ranks: str = RANKS, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """Writes the shards below ``folder`` (a URI or path all executors reach) and returns
    (doc_id, part, slot, shard, record, n_tokens, crc) of every sequence, ``record`` being its
    place in the shard and ``n_tokens`` its ids without the filling."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not documents.inputFiles():
        again = scratch(spark, "rows")
        rows.write.parquet(again)
        rows = spark.read.parquet(again)

    def count(batches):
        known, total = encoder(ranks), 0
        for batch in batches:
            total += sum(_pieces(2 * (known.count(text or "") + 1), length) for text in batch["text"].to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total], pa.int64())], names=["partition", "total"])

    counts = {r.partition: r.total for r in rows.mapInArrow(count, "partition int, total long").collect()}
    total, starts = 0, {}
    for partition in sorted(counts):
        starts[partition] = (total, counts[partition])
        total += counts[partition]
    shards = max(1, -(-total // per_shard))

    def place(batches):
        at, most = starts.get(TaskContext.get().partitionId(), (0, 0))
        most += at
        ids_, parts, numbers, sizes, tokens, held = [], [], [], [], [], 0

        def flush():
            slots = permuted(np.array(numbers, np.int64), total, key)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids_, pa.int64()), pa.array(parts, pa.int32()), pa.array(slots), pa.array((slots // per_shard).astype(np.int32)), pa.array(sizes, pa.int32()), pa.array(tokens, pa.binary())],
                names=["doc_id", "part", "slot", "shard", "n_tokens", "tokens"],
            )

        for doc_id, ids in _encoded(batches, ranks):
            for part in range(_pieces(len(ids), length)):
                piece = ids[part * 2 * length : (part + 1) * 2 * length]
                ids_.append(doc_id), parts.append(part), numbers.append(at), sizes.append(len(piece) // 2), tokens.append(piece)
                at, held = at + 1, held + len(piece)
                if held > 1 << 22:
                    yield flush()
                    ids_, parts, numbers, sizes, tokens, held = [], [], [], [], [], 0
        if at != most:
            raise RuntimeError("the rows of a partition changed between the two passes")
        if numbers:
            yield flush()

    fill = np.array([END], "<u2").tobytes()

    def write(batches):
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        name = f"{TaskContext.get().taskAttemptId()}.writing"
        shard, out, done = None, None, 0
        for batch in batches:
            records, crcs = [], []
            for at, slot, tokens in zip(batch["shard"].to_pylist(), batch["slot"].to_pylist(), batch["tokens"].to_pylist()):
                if at != shard:
                    if out is not None:
                        out.close()
                        files.move(f"{base}/{shard:08d}-{name}", f"{base}/shard-{shard:08d}.bin")
                    shard, done = at, 0
                    out = files.open_output_stream(f"{base}/{shard:08d}-{name}")
                    out.write(struct.pack(HEAD, MAGIC, length, shard * per_shard, min(per_shard, total - shard * per_shard)))
                if slot != shard * per_shard + done:
                    raise RuntimeError(f"slot {slot} where {shard * per_shard + done} belongs")
                out.write(tokens + fill * (length - len(tokens) // 2))
                records.append(done)
                crcs.append(zlib.crc32(tokens))
                done += 1
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], batch["slot"], batch["shard"], pa.array(records, pa.int32()), batch["n_tokens"], pa.array(crcs, pa.int64())], names=["doc_id", "part", "slot", "shard", "record", "n_tokens", "crc"])
        if out is not None:
            out.close()
            files.move(f"{base}/{shard:08d}-{name}", f"{base}/shard-{shard:08d}.bin")

    placed = rows.mapInArrow(place, "doc_id long, part int, slot long, shard int, n_tokens int, tokens binary")
    dealt = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    return dealt.mapInArrow(write, "doc_id long, part int, slot long, shard int, record int, n_tokens int, crc long")


def read_slots(folder: str, start: int, count: int, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """The records of ``count`` slots from ``start`` on, in training order, fewer at the end."""
    files, base = fs.FileSystem.from_uri(folder)
    while count > 0:
        path = f"{base}/shard-{start // per_shard:08d}.bin"
        if files.get_file_info(path).type != fs.FileType.File:
            return
        with files.open_input_file(path) as source:
            magic, length, _, held = struct.unpack(HEAD, source.read(HEADER))
            if magic != MAGIC:
                raise ValueError(f"{path} is no shard")
            first = start % per_shard
            some = min(count, held - first)
            if some <= 0:
                return
            source.seek(HEADER + first * 2 * length)
            yield from np.frombuffer(source.read(some * 2 * length), "<u2").reshape(some, length)
        start, count = start + some, count - some


def materialised(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The sequences of ``documents``, written to a new folder below the shared one."""
    return write_shards(documents, scratch(spark, "shards"))


def training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: doc_id, part, slot, shard, record, n_tokens, crc of every sequence of ``documents``."""
    return materialised(spark, table(spark, sf_dir, "documents"))
