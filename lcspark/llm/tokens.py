"""Token counts under a public byte-level BPE vocabulary, the same as encoding each text."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lcspark.session import spread

#: Folder of the vocabulary files; it must exist under this path on every executor.
TOKENIZERS = os.environ.get("LCSPARK_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_PIECES = 500_000


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class TokenCounter:
    """Counts tokens piece by piece; merges never cross pieces, so each distinct piece is encoded once while it is remembered."""

    def __init__(self, path: str):
        import regex

        self.pieces = regex.compile(PATTERN).findall
        self.encode = _encoding(path).encode_ordinary
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for p in self.pieces(text):
            n = known.get(p)
            if n is None:
                if len(known) >= KEPT_PIECES:
                    known.clear()
                n = known[p] = len(self.encode(p))
            total += n
        return total


def count_tokens(df: DataFrame, text: str, keep: list[str], folder: str | None = None, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``keep`` columns and ``n_tokens`` of each row's whole text (0 for null or empty). Texts are moved only where their files are
    fewer than the cores."""
    path = os.path.join(folder or TOKENIZERS, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TokenCounter(path)
        for b in batches:
            n = pa.array([count(t) for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], names=[*keep, "n_tokens"])

    d = spread(df.select(*keep, text))
    types = ", ".join(f"`{c}` {t}" for c, t in d.dtypes[: len(keep)])
    return d.mapInArrow(work, f"{types}, n_tokens bigint")
