"""Words, hashes and folds that several operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What separates words: ASCII space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "\x20\t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def free(name: str, columns) -> str:
    """``name``, longer by as many underscores as it takes to be none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is frequent if it holds more than one row in so many; there are at most so many of them.
FREQUENT = 1_000


def attached(many: DataFrame, one: DataFrame, key: str, times: str, rows: int) -> DataFrame:
    """``many`` joined with ``one``, which has one row a key and how often ``many`` has it. Rows
    of frequent keys stay where they are: ``one`` comes to them, at most ``FREQUENT`` rows, whose
    keys the filter of the other rows names."""
    frequent = one.filter(F.col(times) * FREQUENT > rows).drop(times)
    others = one.filter(F.col(times) * FREQUENT <= rows).drop(times)
    keys = [r[0] for r in frequent.select(key).collect()]
    if not keys:
        return many.join(others, key)
    met = many.join(F.broadcast(frequent), key)
    return met.unionByName(many.filter(~F.col(key).isin(keys)).join(others, key).select(*met.columns))


# --- vectorised word hashes, for use inside tasks ------------------------------------

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLOT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        forth = np.full(size, _ODD, np.uint64)
        back = np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
        forth[0] = back[0] = 1
        _powers[size] = np.multiply.accumulate(forth), np.multiply.accumulate(back)
    return _powers[size]


#: Bytes whose words are hashed at once, so that what is held does not grow with a text.
_PIECE = 1 << 18


def _pieces(flat: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of about _PIECE bytes that end behind a separator; longer only for a longer word."""
    out, start = [], 0
    while start < len(flat):
        end = start + _PIECE
        while end < len(flat):
            gaps = np.flatnonzero(_IS_SPACE[flat[end : end + 4096]])
            if len(gaps):
                end += int(gaps[0]) + 1
                break
            end += 4096
        out.append((start, min(end, len(flat))))
        start = end
    return out


def _piece_hashes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of bytes that end in a separator."""
    forth, back = _power_tables(len(flat) + 1)
    inside = np.zeros(len(flat) + 2, bool)
    inside[1:-1] = ~_IS_SPACE[flat]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE[flat] * forth[: len(flat)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of every text, number of the text it is in), in order.

    A word's hash is a difference of prefix sums over the joined texts, so no word becomes
    a Python object.
    """
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    parts = [(a, *_piece_hashes(flat[a:b])) for a, b in _pieces(flat)]
    hashes = np.concatenate([h for _, h, _ in parts])
    starts = np.concatenate([a + s for a, _, s in parts])
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return hashes, np.searchsorted(np.cumsum(lengths), starts, "right")


def shingle_hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``width`` words, number of its text). A text of fewer words, but
    at least one, has a single shingle made of all of them."""
    hashes, owner = word_hashes(texts)
    n = len(hashes)
    if not n:
        return hashes, owner
    first = np.r_[True, owner[1:] != owner[:-1]]
    left = np.bincount(owner, minlength=len(texts))[owner] - (np.arange(n) - np.flatnonzero(first)[np.cumsum(first) - 1])
    total = np.zeros(n, np.uint64)
    for j in range(min(width, n)):
        total[: n - j] += np.where(left[: n - j] > j, hashes[j:] * _SLOT[j], np.uint64(0))
    keep = (left >= width) | first
    return mixed(total[keep]), owner[keep]


def blocks_of(texts: list[bytes], limit: int = 1 << 22):
    """Runs of consecutive texts of about ``limit`` bytes together, at least one text each."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)
