"""Packing documents into fixed-length training sequences: shortest-pack-first.

Documents become token pieces of at most ``length`` ids. Only the histogram of piece
lengths reaches the driver (``length`` counts at most). Lengths are placed longest
first, each time into the open packs with the most room; packs with the same contents
are one pattern with a count. The patterns give every (length, rank) a sequence and an
offset, and pieces join them by their rank among the pieces of the same length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambilens.llm.common import rank_within
from ambilens.session import stage

SEQUENCE = 2048
END_ID = 1
#: Pieces of one length that are put in order together, while that takes few buckets.
RANKED_ROWS = 1000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

Pattern = tuple[int, ...]


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[Pattern, int]]:
    """Patterns and how many packs have them, for ``histogram`` of length -> count.

    >>> shortest_pack_first({3: 1, 2: 2, 1: 1}, 5)
    [((3, 2), 1), ((2, 1), 1)]
    """
    by_room: dict[int, dict[Pattern, int]] = {}

    def put(pattern: Pattern, count: int) -> None:
        packs = by_room.setdefault(size - sum(pattern), {})
        packs[pattern] = packs.get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in sorted((r for r in by_room if r >= length), reverse=True):
            # What is put back has less room and is met again below if it still fits.
            while left and by_room.get(room):
                pattern, packs = by_room[room].popitem()
                used = min(packs, left)
                if packs > used:
                    by_room[room][pattern] = packs - used
                put((*pattern, length), used)
                left -= used
        # Packs made above, with less room, are the shortest left.
        while left and (room := max((r for r in by_room if r >= length and by_room[r]), default=0)):
            pattern, packs = by_room[room].popitem()
            used = min(packs, left)
            if packs > used:
                by_room[room][pattern] = packs - used
            put((*pattern, length), used)
            left -= used
        each = size // length
        full, rest = divmod(left, each)
        if full:
            put((length,) * each, full)
        if rest:
            put((length,) * rest, 1)
    return sorted(((p, n) for packs in by_room.values() for p, n in packs.items()), reverse=True)


def segments(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """Per length: (first rank, end rank, first sequence, offset) of each place in a pattern."""
    ranks: dict[int, int] = {}
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for pattern, packs in patterns:
        offset = 0
        for length in pattern:
            first = ranks.get(length, 0)
            places.setdefault(length, []).append((first, first + packs, sequence, offset))
            ranks[length] = first + packs
            offset += length
        sequence += packs
    return sorted(places.items())


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """Encoder for the ranks in ``path``; the end-of-text string is a special token.

    A text that the fast encoder refuses (its patterns give up on runs of about a million
    blanks) is encoded by the slower one, from the same vocabulary's file for it.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
        special_tokens={"<|endoftext|>": len(ranks)},
    )

    def encode(text: str) -> np.ndarray:
        try:
            return encoding.encode_to_numpy(text, allowed_special="all")
        except Exception:  # whatever it can't do, the other one decides
            found = whole_tokenizer(path.removesuffix(".tiktoken") + ".json")
            return np.array(found.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


@lru_cache(maxsize=2)
def whole_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_pieces(docs: DataFrame, size: int = SEQUENCE, ranks: str | None = None) -> DataFrame:
    """Pieces of each document's ids (end id added), none longer than ``size``.

    ``ranks`` is the vocabulary file; it must be installed where tasks run. The vocabulary
    is the one of ``byte_bpe_50k.json`` as ranks, which encode several times faster.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(ranks or default_ranks())
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(ids_of, batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), END_ID).astype("<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    for column, value in zip(rows, (doc, start, len(piece), crc32(piece.tobytes()), len(ids))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, pa.int64()) for column in rows],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Add ``sequence_id`` (gapless from 0) and ``offset`` to pieces with ``length``.

    ``pieces`` is read three times, so it should be a stored table. Equal pieces are
    told apart by their rank only; which of them comes first doesn't matter. An empty
    table gives an empty one.
    """
    counted = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``size`` rows
    places = segments(shortest_pack_first({row.length: row.n for row in counted}, size))
    if not places:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    table = pieces.sparkSession.createDataFrame(
        places, "length long, places array<struct<lo: long, hi: long, sequence: long, at: long>>"
    )
    sizes = pieces.sparkSession.createDataFrame(
        [(row.length, 1 + row.n // RANKED_ROWS) for row in counted], "length long, __buckets long"
    )
    ranked = rank_within(
        pieces.join(F.broadcast(sizes), "length"), ["length"], ["doc_id", "start", "ids_crc32"], "__rank",
        F.col("__buckets"),
    )
    # One row for each length: at most ``size`` rows.
    placed = ranked.join(F.broadcast(table), "length").withColumn(
        "__place", F.filter("places", lambda p: (p.lo <= F.col("__rank")) & (F.col("__rank") < p.hi))[0]
    )
    return placed.select(
        *[F.col(c) for c in pieces.columns],
        (F.col("__place.sequence") + F.col("__rank") - F.col("__place.lo")).alias("sequence_id"),
        F.col("__place.at").alias("offset"),
    )


def pack_documents(docs: DataFrame, size: int = SEQUENCE, ranks: str | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text; others are ignored) with their place in a sequence.

    A null or empty text is one piece that holds the end id. A null doc_id stays null.
    Repeated rows are packed as often as they occur. A text of any length is encoded as a
    whole, since ids depend on their surroundings; its pieces go out as they are cut.
    """
    return pack(stage(token_pieces(docs, size, ranks), "pieces"), size)
