"""Byte-level BPE of whole texts, for use inside tasks.

The vocabulary file's path is a parameter; workers read it once.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import tiktoken

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the vocabulary. It is
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+ in a form that cuts every
#: text at the same places without stepping back: runs are possessive, white space at the end goes whole.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Fixed value: the free id behind the vocabulary, the end of a text.
END = 50256


class Encoder:
    def __init__(self, ranks: str):
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # A name for the end id: ids come as an array only from the call that looks for names, and with none it
        # looks at every character. The name is never looked up, so a text that holds it is encoded like any other.
        self.whole = tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=table, special_tokens={"<|end|>": END})

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text; no Python number is made for any of them."""
        return self.whole.encode_to_numpy(text, disallowed_special=())

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 16-bit integers."""
        return self.ids(text).astype("<u2").tobytes()

    def count(self, text: str) -> int:
        """The number of ids of a text."""
        return len(self.ids(text))


@lru_cache(maxsize=1)
def encoder(ranks: str = RANKS) -> Encoder:
    return Encoder(ranks)
