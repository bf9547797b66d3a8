"""Operator 7, shortest-pack-first histogram packing.

Documents become token ids, are cut into pieces of at most one sequence, and only the histogram
of piece lengths (as many rows as a sequence has places) goes to the driver. There lengths are
placed longest first, each into the open packing pattern with most room, as many copies at once as
the pattern and the length both have; patterns carry their counts. Pieces find their place again
by rank: the r-th piece of a length takes the r-th slot of that length.

Edge cases: a null or empty text is the end id alone; a text longer than a sequence is cut into
full pieces and a rest; repeated rows are separate documents; an empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from freshlane.llm.common import arrow_map, tokenizer_path, written
from freshlane.llm.tokens import encoder, slices

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: A rank group holds about this share of all pieces, however common its length is.
RANK_GROUPS = 4096


def cut_pieces(docs: DataFrame, room: int = 2048, end_id: int = 1,
               vocabulary_file: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per piece of each document's ids (with ``end_id`` appended): PIECE_SCHEMA."""
    def run(batches):
        encode = encoder(tokenizer_path(vocabulary_file))
        for whole in batches:
            for b in slices(whole):
                rows = []
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    ids = np.append(encode(text), end_id).astype("<u4")
                    for at in range(0, len(ids), room):
                        piece = ids[at:at + room]
                        rows.append((doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return arrow_map(docs.select("doc_id", "text"), run, PIECE_SCHEMA)


def shortest_pack_first(histogram: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and their counts; ``histogram`` has the pieces of each length."""
    open_packs: dict[int, list] = defaultdict(list)      # room left -> [(count, lengths)]
    for length in sorted(histogram, reverse=True):
        left, space = histogram[length], room
        while left:
            while space >= length and not open_packs.get(space):
                space -= 1
            if space < length:
                open_packs[room - length].append((left, (length,)))
                break
            count, lengths = open_packs[space].pop()
            used = min(left, count)
            if count > used:
                open_packs[space].append((count - used, lengths))
            open_packs[space - length].append((used, (*lengths, length)))
            left -= used
    return [(lengths, count) for packs in open_packs.values() for count, lengths in packs]


def slot_table(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank. Copies of a pattern
    are consecutive sequences, so one row serves all copies of one slot."""
    rows, taken, sequence = [], defaultdict(int), 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, room: int = 2048) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (a stored table with PIECE_SCHEMA's columns).

    Ranks are taken inside groups of one length and one hash class; common lengths have as many
    classes as keep a group near 1/RANK_GROUPS of all pieces, so no task gets a whole length.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    share = max(1, sum(histogram.values()) // RANK_GROUPS)
    classes = {k: n // share + 1 for k, n in histogram.items() if n > share}
    n_classes = F.lit(1)
    if classes:
        table = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
        n_classes = F.coalesce(table[F.col("length")], F.lit(1))
    ranked = pieces.withColumn("__class", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), n_classes))
    sizes = sorted((r["length"], r["__class"], r["n"]) for r in
                   ranked.groupBy("length", "__class").agg(F.count("*").alias("n")).collect())
    widest = max([1, *classes.values()])
    keys = np.array([k * widest + c for k, c, _ in sizes], np.int64)
    before, total = [], defaultdict(int)
    for k, _, n in sizes:
        before.append(total[k])
        total[k] += n
    before = np.array(before, np.int64)
    slots = slot_table(shortest_pack_first(histogram, room))
    span = int(max([1, *histogram.values()]))
    slot_keys = slots[:, 0] * span + slots[:, 1]

    def place(batches):
        for b in batches:
            col = lambda n: b.column(n).to_numpy(zero_copy_only=False)
            length = col("length")
            rank = before[np.searchsorted(keys, length * widest + col("__class"))] + col("__rank") - 1
            at = np.searchsorted(slot_keys, length * span + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[b.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")],
                 pa.array(slots[at, 2] + rank - slots[at, 1]), pa.array(slots[at, 3])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    order = W.partitionBy("length", "__class").orderBy("doc_id", "start", "ids_crc32")
    return arrow_map(ranked.withColumn("__rank", F.row_number().over(order).cast("long")), place,
                     PIECE_SCHEMA + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, room: int = 2048, end_id: int = 1,
                   vocabulary_file: str = "byte_bpe_50k.json") -> DataFrame:
    """Tokenise once, keep the pieces as a table in the shared folder, pack them."""
    return pack(written(cut_pieces(docs, room, end_id, vocabulary_file), "pieces"), room)
