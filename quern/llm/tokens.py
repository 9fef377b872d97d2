"""Text sizes in tokens of a public tokenizer, whose vocabulary file is a parameter.

Defined cases: a null text has 0 tokens, as has an empty one; whole texts are counted,
of any length; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Default vocabulary: a byte-level BPE for many languages, as base64 ranks. It must be at this path on every node.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    """The tokenizer of a vocabulary file; loaded once in each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("quern", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: object, path: str = VOCABULARY) -> int:
    return len(encoder(path).encode_ordinary(text)) if isinstance(text, str) and text else 0


def token_sizes(docs: DataFrame, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of each row's text; rows without the first of them (the id) are skipped."""
    src = docs.where(F.col(keep[0]).isNotNull()).select(*keep, "text")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "text")

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            n = [len(encode(x)) if isinstance(x, str) and x else 0 for x in b["text"]]
            yield b[keep].assign(n_tokens=pd.array(n, dtype="int64"))

    return src.mapInPandas(sizes, f"{names}, n_tokens bigint")
