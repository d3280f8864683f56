"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder with the vocabulary files; only its path is used, the files stay where they are.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
# fixed value: the split pattern that belongs to the vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict = {}


def encoding(folder: str, file: str = "byte_bpe_50k.tiktoken"):  # noqa: ANN201
    """The tokenizer of a vocabulary file, read once in a process."""
    import tiktoken

    path = os.path.join(folder, file)
    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def with_token_counts(df: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None, folder: str = TOKENIZERS) -> DataFrame:
    """(item_id, *keep, n_tokens); null texts have 0 tokens. Only the columns in keep are carried."""
    cols = [c for c in keep or [] if c not in ("item_id", "n_tokens", "text")]
    given = df.select(F.col(id_col).alias("item_id"), *cols, F.col(text_col).alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(folder)
        for b in batches:
            yield b.drop(columns="text").assign(n_tokens=[len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]])

    return given.mapInPandas(count, fields + ", n_tokens bigint")
