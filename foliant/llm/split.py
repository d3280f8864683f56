"""Splitting oversized texts at natural boundaries (problem 1).

Every boundary of a text gets its farthest legal successor: the start of the piece that would follow a piece starting there, overlap
included. Squaring that successor table doubles, in each round, the number of cuts that are known, so the cuts of a text with m pieces are
derived in log2(m) whole-array steps instead of m dependent ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARAGRAPH, LINE, SENTENCE, WORD = 4, 3, 2, 1


def boundary_levels(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the boundaries of UTF-8 bytes, ascending, with 0 and the end, and how strong each is. A boundary is the start of what follows."""
    n = len(raw)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    # the white space before each start begins after the last byte that is none
    inked = np.concatenate([[-1], np.flatnonzero(~space[:-1] & space[1:])])
    ink = inked[np.searchsorted(inked, start, "left") - 1]
    line = np.flatnonzero(raw == 10)
    breaks = np.searchsorted(line, start) - np.searchsorted(line, ink + 1)
    mark = np.where(ink >= 0, raw[np.maximum(ink, 0)], 0) if n else ink
    ellipsis = (ink >= 2) & (mark == 0xA6) & (raw[np.maximum(ink - 1, 0)] == 0x80) & (raw[np.maximum(ink - 2, 0)] == 0xE2) if n else ink > 0
    ended = np.isin(mark, np.frombuffer(b".!?", np.uint8)) | ellipsis
    level = np.where(breaks > 1, PARAGRAPH, np.where(breaks == 1, LINE, np.where(ended, SENTENCE, WORD)))
    a, b, c = raw[:-2], raw[1:-1], raw[2:]
    # ideographic full stop, full-width exclamation and question mark need no space after them
    full = ((a == 0xE3) & (b == 0x80) & (c == 0x82)) | ((a == 0xEF) & (b == 0xBC) & ((c == 0x81) | (c == 0x9F)))
    ideal = np.flatnonzero(full) + 3
    at = np.concatenate([[0, n], start, ideal])
    kind = np.concatenate([[PARAGRAPH, PARAGRAPH], level, np.full(len(ideal), SENTENCE)]).astype(np.int8)
    order = np.lexsort((-kind, at))
    at, kind = at[order], kind[order]
    first = np.concatenate([[True], at[1:] != at[:-1]])
    return at[first], kind[first]


def cuts(raw: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the pieces of one text. The tables hold a row for each boundary, and for each character only where boundaries are so
    far apart that a piece may have to begin between them."""
    n = len(raw)
    if n <= limit:
        return np.array([0]), np.array([n])
    at, level = boundary_levels(raw)
    strong = {k: at[level >= k] for k in range(WORD, PARAGRAPH + 1)}

    def back(pos: np.ndarray) -> np.ndarray:
        """The last position up to pos that is not inside a character."""
        for _ in range(3):
            pos = pos - ((pos < n) & ((raw[np.minimum(pos, n - 1)] & 0xC0) == 0x80))
        return pos

    gap = np.flatnonzero(np.diff(at) > (2 * overlap or limit // 2))
    between = [np.flatnonzero((raw[a + 1 : b] & 0xC0) != 0x80) + a + 1 for a, b in zip(at[gap], at[gap + 1])]
    pos = np.sort(np.concatenate([at, *between])) if between else at
    last = lambda k, x: strong[k][np.searchsorted(strong[k], x, "right") - 1]
    # end of a piece that starts at pos: the farthest boundary of the strongest kind in the window's second half, else a word's, else a character's
    reach = np.minimum(pos + limit, n)
    end = back(reach)
    end = np.where(end > pos, end, n)
    for k in range(WORD, PARAGRAPH + 1):
        there = last(k, reach)
        end = np.where(there > pos + (limit // 2 if k > WORD else 2 * overlap), there, end)
    end = np.where(pos + limit >= n, n, end)
    # start of the next piece: the boundary nearest to `overlap` bytes before that end
    want = np.maximum(end - overlap, 0)
    low = last(WORD, want)
    high = at[np.minimum(np.searchsorted(at, want), len(at) - 1)]
    near = np.where((high < end) & (high - want < want - low), high, low)
    step = np.where((near > pos) & (near >= end - 2 * overlap) & (near < end), near, back(want))
    step = np.where(step > pos, step, end)  # windows too small for the overlap still advance
    jump = np.searchsorted(pos, np.where(end >= n, n, step))
    done = len(pos) - 1
    known = np.array([0])
    while known[-1] != done:
        known = np.concatenate([known, jump[known]])
        jump = jump[jump]
    known = np.unique(known[known < done])
    return pos[known], end[known]


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 1000, overlap: int = 100, keep: Sequence[str] = ()) -> DataFrame:
    """Pieces of at most `limit` UTF-8 bytes for every text longer than that.

    Returns (item_id, piece_no, byte_start, byte_length, piece_text) and the columns of `keep`; others are not carried, so clashing names do no
    harm. Together the pieces cover every byte of the text. A null, empty or short text yields no row; a null id is kept as null; repeated rows are cut
    once each. Needs limit >= 8 and overlap <= limit / 4.
    """
    if limit < 8 or overlap < 0 or 4 * overlap > limit:
        raise ValueError("limit must be at least 8 and four times the overlap")
    long = df.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("whole"), *keep).filter(F.octet_length("whole") > limit)
    kind = long.schema["item_id"].dataType.simpleString()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text, *rest in zip(batch["item_id"], batch["whole"], *[batch[c] for c in keep]):
                data = text.encode("utf-8")
                start, end = cuts(np.frombuffer(data, np.uint8), limit, overlap)
                yield pd.DataFrame({
                    "item_id": [item] * len(start), "piece_no": np.arange(len(start), dtype=np.int32), "byte_start": start.astype(np.int64),
                    "byte_length": (end - start).astype(np.int64), "piece_text": [data[a:b].decode("utf-8") for a, b in zip(start, end)],
                } | {c: [x] * len(start) for c, x in zip(keep, rest)})

    kept = "".join(f", {c} {long.schema[c].dataType.simpleString()}" for c in keep)
    return long.mapInPandas(pieces, f"item_id {kind}, piece_no int, byte_start bigint, byte_length bigint, piece_text string{kept}")


def placed_pieces(pieces: DataFrame, placed: DataFrame, indexed: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Pieces with their document, and with new positions and offsets in it, and the columns of `keep`.

    pieces: of split_oversized, item_id being chunk_id. placed: the chunks before the split (version_id, document_id, chunk_id, position,
    byte_offset, created_at), any number of versions; the newest counts, of equal times that with the greatest version_id. A piece moves
    back by the extra pieces that the oversized chunks before it in its document bring. Without a row in placed, document_id stays null and
    position and offset count from the chunk's own start; null positions and offsets count as 0.

    indexed: whether a piece is of the text that the index holds, by default all are. A chunk may have several texts and moves others once:
    by its indexed text, else by that with most pieces. Chunks without an indexed text are moved by all, but move only each other.
    """
    own = F.lit(True) if indexed is None else indexed
    n = pieces.groupBy("item_id").agg(F.max(F.when(own, F.col("piece_no"))).alias("indexed"), F.max("piece_no").alias("most"))
    newest = (
        placed.select("chunk_id", "document_id", "position", "byte_offset", "created_at", "version_id")
        .join(n, placed["chunk_id"] == n["item_id"], "left_semi")
        .groupBy("chunk_id")
        .agg(F.max_by(F.struct("document_id", "position", "byte_offset"), F.struct("created_at", "version_id")).alias("at"))
    )
    # only oversized chunks bring extra pieces, so only they take part in the running sums
    # chunks of no known document are moved by none, so each is a window of its own
    alone = F.when(F.col("at.document_id").isNull(), F.col("item_id"))
    before = W.partitionBy("at.document_id", alone).orderBy("at.position", "item_id").rowsBetween(W.unboundedPreceding, -1)
    extra = F.when(F.col("indexed").isNotNull(), F.sum("indexed").over(before)).otherwise(F.sum(F.coalesce("indexed", "most")).over(before))
    moved = F.when(F.col("at.document_id").isNotNull(), F.coalesce(extra, F.lit(0))).otherwise(0)
    base = n.join(newest, n["item_id"] == newest["chunk_id"], "left").select("item_id", "at", moved.alias("moved"))
    zero = F.lit(0)
    return pieces.join(base, "item_id").select(
        F.col("item_id").alias("chunk_id"),
        F.col("at.document_id").alias("document_id"),
        (F.coalesce("at.position", zero) + F.col("moved") + F.col("piece_no")).cast("bigint").alias("position"),
        (F.coalesce("at.byte_offset", zero) + F.col("byte_start")).alias("byte_offset"),
        "byte_length",
        F.col("piece_text").alias("text"),
        *keep,
    )
