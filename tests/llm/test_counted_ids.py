"""Ids counted without being kept."""

import random

import numpy as np
import tiktoken

from hodos.llm.bpe import encoder


def test_counts_are_those_of_the_encoding():
    known = encoder()
    for text in ("", " ", "one two  three\n\n", "Ωμέγα 12 ok?!", "x" * 5000, "'s it's \x00  "):
        assert known.count(text) == len(known.encode(text)) // 2


def test_ids_are_an_array_and_those_of_the_published_pattern():
    known, rng = encoder(), random.Random(7)
    published = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    plain = tiktoken.Encoding("plain", pat_str=published, mergeable_ranks=known.whole._mergeable_ranks, special_tokens={})
    pieces = ["'s", "'", "'ll", "'Ve", "'d", " ", "  ", "\n", "\r\n", "\t", " ", "　", " ", "word", "Ωμέγα", "12", "٣", "½", "?!", "<|end|>", "\x00", "😀", "é", "‍", "_"]
    texts = ["", " ", "\n\n", "a \n", "<|end|>", " <|end|><|end|> "] + ["".join(rng.choices(pieces, k=rng.randrange(1, 40))) for _ in range(5000)]
    for text in texts:
        ids = known.ids(text)
        assert isinstance(ids, np.ndarray) and ids.tolist() == plain.encode_ordinary(text)
        assert known.encode(text) == np.array(ids, "<u2").tobytes() and known.count(text) == len(ids)
