"""Chunks of texts that end at natural breaks, and what has changed between two texts, line by line."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: breaks in the order in which they are preferred, and how many characters on the next chunk may begin; each looks one character on
BREAKS = [(re.compile(r"\n(?=\n)"), 2), (re.compile(r"[.!?](?=[ \t\r\n])"), 1), (re.compile(r"(?s)[ \t\r\n](?=.)"), 1)]


def break_point(text: str, start: int, stop: int, back: int) -> int:
    """Where the last break of the best kind ends that begins in the `back` characters before stop; stop itself where there is none."""
    for kind, on in BREAKS:
        places = [m.start() for m in kind.finditer(text, max(stop - back, start), stop + 1)]
        if places:
            return places[-1] + on
    return stop


def natural_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 64, back: int = 50, least: int = 100) -> DataFrame:
    """(doc, n, start, stop, chunk): chunks of about `size` characters that end after a blank line, a sentence or a word, if one ends within the last
    `back` characters, each starting `overlap` characters before the end of the one before.

    The last chunk ends with the text; is it shorter than `least`, it is joined to the one before. A paragraph break may end a chunk one character
    beyond size. Chunks without ink are left out, null and empty texts have none, repeated rows are cut each, other columns are not carried.
    """
    if not 0 <= overlap < size - back:
        raise ValueError("the overlap must be less than size - back")
    given = docs.filter(F.length(text_col) > 0).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))

    def spans(text: str) -> list[list[int]]:
        out, start = [], 0
        while True:
            stop = len(text) if start + size >= len(text) else break_point(text, start, start + size, back)
            if out and stop == len(text) and stop - start < least:
                out[-1][1] = stop
            else:
                out.append([start, stop])
            if stop == len(text):
                return [s for s in out if text[s[0] : s[1]].strip(" \t\r\n")]
            start = stop - overlap

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(doc, n, x, y, text[x:y]) for doc, text in zip(b["doc"], b["text"]) for n, (x, y) in enumerate(spans(text))]
            if rows:
                yield pd.DataFrame(rows, columns=["doc", "n", "start", "stop", "chunk"])

    return given.mapInPandas(cut, f"doc {given.schema['doc'].dataType.simpleString()}, n int, start int, stop int, chunk string")


def common_lines(old: list[str], new: list[str]) -> int:
    """Length of the longest common subsequence, with one row of numbers for the longer side."""
    if len(new) < len(old):
        old, new = new, old
    code = {line: i for i, line in enumerate(dict.fromkeys(old))}
    right = np.array([code.get(line, -1) for line in new], np.int64)
    row = np.zeros(len(new) + 1, np.int64)
    for line in old:
        # one more than the diagonal where lines agree, else the greatest to the left and above
        row[1:] = np.maximum(row[1:], np.where(right == code[line], row[:-1] + 1, 0))
        row = np.maximum.accumulate(row)
    return int(row[-1])


def line_changes(pairs: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """(keys, n_same, n_added, n_removed, similarity) for pairs of texts, by the longest common subsequence of their lines; similarity is the part of
    all lines that is common. A null text has no lines, and two texts without lines are alike. Lines end at \\n only; equal ends are set aside first."""
    given = pairs.select(*keys, F.col(old).alias("_old"), F.col(new).alias("_new"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            if b.empty:
                continue
            for x, y in zip(b["_old"], b["_new"]):
                a, z = ([] if not t else t.removesuffix("\n").split("\n") for t in (x, y))
                head = next((i for i, (p, q) in enumerate(zip(a, z)) if p != q), min(len(a), len(z)))
                p, q = a[head:], z[head:]
                tail = next((i for i, (u, v) in enumerate(zip(reversed(p), reversed(q))) if u != v), min(len(p), len(q)))
                same = head + tail + common_lines(p[: len(p) - tail], q[: len(q) - tail])
                rows.append((same, len(z) - same, len(a) - same, 2 * same / (len(a) + len(z)) if a or z else 1.0))
            counts = pd.DataFrame(rows, columns=["n_same", "n_added", "n_removed", "similarity"])
            yield pd.concat([b[keys].reset_index(drop=True), counts], axis=1)

    kinds = ", ".join(f"{k} {given.schema[k].dataType.simpleString()}" for k in keys)
    return given.mapInPandas(compare, f"{kinds}, n_same int, n_added int, n_removed int, similarity double")
