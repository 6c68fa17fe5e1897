"""Token counters: a quarter of the characters, or the byte-pair encoding of a rank file where one is given."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

try:  # the encoder is optional; without it counts are estimates
    import tiktoken
except ImportError:
    tiktoken = None

PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PER_MESSAGE, PER_NAME, PER_REPLY = 3, 1, 3


@lru_cache(4)
def _encoding(path: str):
    """The encoding of a rank file (base64 token, rank); None where it can't be had."""
    if tiktoken is None or not path:
        return None
    try:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (OSError, ValueError):
        return None


class TokenCounter:
    """Counts tokens by the rank file at ``ranks`` or in SYNAPTA_COUNTER_RANKS; without one, or if it can't be read, by characters."""

    def __init__(self, ranks: str | None = None):
        self.ranks = ranks or os.environ.get("SYNAPTA_COUNTER_RANKS") or ""

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        encoding = _encoding(self.ranks)
        return max(1, len(text) // 4) if encoding is None else len(encoding.encode_ordinary(text))

    def chat(self, messages: list[dict], reply: bool = True) -> int:
        """Tokens of a chat: its messages' roles, contents and names with their framing, and the reply's beginning."""
        total = PER_REPLY if reply else 0
        for m in messages:
            total += PER_MESSAGE + self.count(str(m.get("role", ""))) + self.count(str(m.get("content", "")))
            if "name" in m:
                total += PER_NAME + self.count(str(m["name"]))
        return total

    def column(self, x) -> Column:
        """Tokens of a column: an estimate stays in the JVM, an encoding runs by Arrow batches."""
        if _encoding(self.ranks) is None:
            return X.token_count(x)
        count = self.count

        @F.pandas_udf("long")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in parts:
                yield texts.map(count)

        return run(X.col(x))

    def describe(self) -> dict[str, str]:
        """Which backend counts, and from what."""
        encoding = _encoding(self.ranks)
        return {"backend": "heuristic" if encoding is None else "bpe", "source": "characters / 4" if encoding is None else self.ranks, "encoding": "" if encoding is None else encoding.name, "framing": f"{PER_MESSAGE} a message, {PER_REPLY} for the reply"}
