"""Operator 6: token counts that follow edits, from a segment tree of each document.

A text is cut into blocks at places no pre-token reaches over: behind a character that is no
white space and before ASCII white space. The tree's leaves hold a block's characters and ids,
its nodes their sums. An edit finds its blocks from the sums, replaces their text, widens to the
neighbours until both ends are such places again, encodes only that, and updates the sums above.

Defined results: null and empty texts are one empty block with no id; a null edit list is none.
Edits apply in order, each to the text the ones before it left; places beyond the end mean the
end, and a null insertion is empty. Repeated rows and null ids are kept; further columns are not
looked at. Texts without such places are one block and encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hodos.llm.bpe import RANKS, encoder
from hodos.llm.common import table

BLOCK = 512
CUT = re.compile(r"(?<=\S)(?=[ \t-\r])")


def _apart(left: str, right: str) -> bool:
    """Whether no pre-token reaches over the end of ``left`` into ``right``."""
    return not left[-1].isspace() and right[0] in " \t\n\x0b\x0c\r"


class CountTree:
    """chars[i], ids[i]: sums below node i; the leaves are from ``first`` on."""

    def __init__(self, text: str, count):
        self.count, self.recoded = count, 0
        self.blocks, at = [], 0
        while at < len(text):
            met = CUT.search(text, at + BLOCK) if at + BLOCK < len(text) else None
            end = met.start() if met else len(text)
            self.blocks.append(text[at:end])
            at = end
        self.first = 1 << max(0, (max(1, len(self.blocks)) - 1).bit_length())
        self.chars, self.ids = [0] * (2 * self.first), [0] * (2 * self.first)
        for i, block in enumerate(self.blocks):
            self.chars[self.first + i], self.ids[self.first + i] = len(block), count(block)
        self.blocks += [""] * (self.first - len(self.blocks))
        for i in range(self.first - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i], self.ids[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.ids[2 * i] + self.ids[2 * i + 1]

    @property
    def total(self) -> int:
        return self.ids[1] if self.first > 1 else self.ids[self.first]

    @property
    def length(self) -> int:
        return self.chars[1] if self.first > 1 else self.chars[self.first]

    def leaf(self, place: int) -> tuple[int, int]:
        """(block that holds character ``place``, place within it); the end is behind the last."""
        node = 1
        while node < self.first:
            node *= 2
            if place >= self.chars[node]:
                if self.chars[node + 1]:
                    place -= self.chars[node]
                    node += 1
        return node - self.first, place

    def _next(self, i: int, step: int) -> int | None:
        """The nearest block from ``i`` on that has characters."""
        while 0 <= i < self.first and not self.blocks[i]:
            i += step
        return i if 0 <= i < self.first else None

    def edit(self, start: int, stop: int, insert: str) -> None:
        start = max(0, min(start, self.length))
        stop = max(start, min(stop, self.length))
        low, a = self.leaf(start)
        high, b = self.leaf(stop)
        text = self.blocks[low][:a] + insert + self.blocks[high][b:]
        for i in range(low, high + 1):
            self.blocks[i] = ""
        while (i := self._next(low - 1, -1)) is not None and not (text and _apart(self.blocks[i], text)):
            text, self.blocks[i], low = self.blocks[i] + text, "", i
        while (i := self._next(high + 1, 1)) is not None and not (text and _apart(text, self.blocks[i])):
            text, self.blocks[i], high = text + self.blocks[i], "", i
        self.recoded += len(text)
        self.blocks[low] = text
        for i in range(low, high + 1):
            self.chars[self.first + i], self.ids[self.first + i] = len(self.blocks[i]), 0
        self.ids[self.first + low] = self.count(text)
        low, high = (self.first + low) // 2, (self.first + high) // 2
        while low:
            for i in range(low, high + 1):
                self._sum(i)
            low, high = low // 2, high // 2


def counted(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_after, n_chars_after, n_edits, recoded_chars) of every row of
    ``documents`` (doc_id, text, edits: array of start, stop, insert)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = encoder(ranks).whole
        count = lambda text: len(whole.encode_ordinary(text))
        for batch in batches:
            rows = []
            for doc_id, text, edits in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "edits"))):
                tree = CountTree(text or "", count)
                before = tree.total
                for e in edits or []:
                    tree.edit(e["start"] or 0, e["stop"] or 0, e["insert"] or "")
                rows.append((doc_id, before, tree.total, tree.length, len(edits or []), tree.recoded))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)], names=["doc_id", "n_tokens", "n_tokens_after", "n_chars_after", "n_edits", "recoded_chars"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "edits")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_tokens_after long, n_chars_after long, n_edits long, recoded_chars long")


def edits_of(text: Column, doc_id: Column) -> Column:
    """Up to three edits that follow from the row: a cut, a doubled passage and a replaced one."""
    n = F.length(text)
    at = lambda k: F.pmod(F.xxhash64(doc_id, F.lit(k)), n + 1).cast("int")
    edit = lambda start, stop, insert: F.struct(start.alias("start"), stop.alias("stop"), insert.alias("insert"))
    three = F.array(edit(at(1), at(1) + 25, F.lit("")), edit(at(2), at(2), F.substr(text, at(3) + 1, F.lit(40))), edit(at(4), at(4) + 7, F.lit(" edited\n")))
    return F.when(n > 0, F.slice(three, F.lit(1), F.pmod(F.xxhash64(doc_id), F.lit(4)).cast("int")))


def token_counts(spark, sf_dir: str) -> DataFrame:
    """op6: the counts before and after edits for every row of ``documents``."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counted(documents.withColumn("edits", edits_of(F.col("text"), F.col("doc_id"))))
