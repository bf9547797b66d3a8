"""Operator 11, cross-tokenizer alignment by pointer jumping.

A text is encoded by vocabulary A (byte-level BPE, with a space in front) and by vocabulary B (sentence pieces,
which add that space). Every token points to its farthest-right overlapping token of the other vocabulary; a B
token that no token outreaches points to itself. Successor doubling (``to = to[to]`` on flat arrays, logarithmic
rounds) takes every token to the terminal token of its component, which labels its group. Overlapping pairs are
links; a link's count is how many links of the corpus hold the same pair of ids.

A text is cut before each single space between two characters that are not white space: there both vocabularies
start a new token, so groups and links never cross a cut. Equal cuts ("units") of a block of texts are aligned
once. A block ends after ``block_chars`` characters, is written with its own counts of pairs, and gets back only
the corpus-wide counts of the pairs that it holds, so the shuffle carries pairs of blocks, not of texts.

Edge cases: null and empty texts, and texts whose token bytes are not the text's (a literal U+2581, say), have no
tokens: zeros, ''. Strings of special tokens are plain text. Repeated rows give repeated rows; null ids stay;
a text longer than a block is one block; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshlane.llm.common import arrow_map, tokenizer_path, written
from freshlane.llm.tokens import PRETOKEN, slices, vocabulary

#: A block of texts ends at so many characters or different units (memory of one worker, no bound of a result).
BLOCK_CHARS, BLOCK_UNITS = 32_000_000, 300_000
#: A pair's key is a << B_BITS | b.
B_BITS = 15
CUT = re.compile(r"(?<=\S) (?=\S)")
ENCODED = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, "
           "units binary, pairs array<struct<key:int,n:long>>, unit_links binary")


@functools.lru_cache(maxsize=2)
def coders(file_a: str, file_b: str):
    """``encode_a(unit)``, ``encode_b(units)`` and the bytes of the tokens of both vocabularies by id."""
    import sentencepiece
    import tiktoken
    ids, _, _ = vocabulary(file_a)
    pattern = PRETOKEN.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S")
    fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ids, special_tokens={})
    slow = []

    def encode_a(unit: str) -> list[int]:
        try:
            return fast.encode_ordinary(" " + unit)
        except ValueError:
            if not slow:
                from tokenizers import Tokenizer
                slow.append(Tokenizer.from_file(file_a))
                slow[0].encode_special_tokens = True
            return slow[0].encode(" " + unit, add_special_tokens=False).ids

    pieces = sentencepiece.SentencePieceProcessor(model_file=file_b)
    if pieces.get_piece_size() > 1 << B_BITS:
        raise ValueError("vocabulary B has too many pieces for the pairs' keys")
    bytes_a = [b""] * (max(ids.values()) + 1)
    for spelled, i in ids.items():
        bytes_a[i] = spelled
    names = [(pieces.id_to_piece(i), pieces.is_byte(i)) for i in range(pieces.get_piece_size())]
    bytes_b = [bytes([int(p[3:5], 16)]) if single else p.replace("▁", " ").encode() for p, single in names]
    return encode_a, lambda units: pieces.encode(units, num_threads=1), bytes_a, bytes_b


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terminal B token of the component of every A and every B token.

    The tokens of both sides tile the same bytes; ``end_a`` and ``end_b`` are their ascending ends.
    """
    n = len(end_a)
    to = np.r_[n + np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)]     # who holds the token's last byte
    own = np.arange(n, n + len(end_b))
    to[n:] = np.where(end_a[to[n:]] == end_b, own, to[n:])
    while True:
        farther = to[to]
        if np.array_equal(farther, to):
            return to[:n] - n, to[n:] - n
        to = farther


class Units:
    """The different units of a block, with their alignment."""

    def __init__(self, file_a: str, file_b: str):
        self.encode_a, self.encode_b, self.bytes_a, self.bytes_b = coders(file_a, file_b)
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)     # tokens of A and B, groups, links; of a unit that cannot be aligned -1
        self.keys = [np.zeros(0, np.int64)]
        self.seen = np.zeros(0, np.int64)

    def learn(self, units: list[str]) -> None:
        """Align units not met before, all in one set of flat arrays."""
        a, b = [self.encode_a(u) for u in units], self.encode_b(units)
        plain = [(" " + u).encode() for u in units]
        good = np.array([b"".join(map(self.bytes_a.__getitem__, x)) == p and b"".join(map(self.bytes_b.__getitem__, y)) == p
                         for x, y, p in zip(a, b, plain)])
        sizes = np.full((len(units), 4), -1, np.int64)
        groups = [""] * len(units)
        which = np.flatnonzero(good)
        if len(which):
            n_a, n_b = (np.array([len(x[i]) for i in which]) for x in (a, b))
            a, b = (np.array([t for i in which for t in x[i]], np.int64) for x in (a, b))
            end_a = np.cumsum(np.array([len(self.bytes_a[t]) for t in a]))
            end_b = np.cumsum(np.array([len(self.bytes_b[t]) for t in b]))
            last_a, last_b = terminals(end_a, end_b)
            unit_a, unit_b = np.repeat(np.arange(len(which)), n_a), np.repeat(np.arange(len(which)), n_b)
            ends = np.union1d(end_a, end_b)          # the overlap of a linked pair lies between two neighbouring ends
            of_a, of_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
            last = np.flatnonzero(last_b == np.arange(len(b)))
            links = np.bincount(unit_a[of_a], minlength=len(which))
            sizes[which] = np.stack([n_a, n_b, np.bincount(unit_b[last], minlength=len(which)), links], axis=1)
            self.keys.append(a[of_a] << B_BITS | b[of_b])
            for i, text in zip(which, spelled(a, b, np.searchsorted(last, last_a), np.searchsorted(last, last_b), unit_a, unit_b)):
                groups[i] = text
        self.at.update(zip(units, range(len(self.at), len(self.at) + len(units))))
        self.groups += groups
        self.sizes = np.concatenate([self.sizes, sizes])
        self.seen = np.r_[self.seen, np.zeros(len(units), np.int64)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different keys, how many links of the block hold each, and the unit links as places in the keys."""
        keys, place = np.unique(np.concatenate(self.keys), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, place, np.repeat(self.seen, np.maximum(self.sizes[:, 3], 0)))
        return keys, total, place


def spelled(a, b, group_a, group_b, unit_a, unit_b) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every unit."""
    n = group_b[-1] + 1
    before_a, before_b = (np.r_[0, np.cumsum(np.bincount(g, minlength=n))] for g in (group_a, group_b))
    place = np.r_[np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + before_a[group_b + 1]]
    order = np.empty(len(place), np.int64)
    order[place] = np.arange(len(place))
    ids, group, unit = np.r_[a, b][order], np.r_[group_a, group_b][order], np.r_[unit_a, unit_b][order]
    side = (order >= len(a)).astype(np.int64)
    then = np.zeros(len(ids), np.int64)
    then[:-1] = np.where(unit[1:] != unit[:-1], 3, np.where(group[1:] != group[:-1], 2, side[1:] != side[:-1]))
    then[-1] = 3
    parts = [str(i) + (",", "|", ";", "")[t] for i, t in zip(ids.tolist(), then.tolist())]
    stops = (np.flatnonzero(then == 3) + 1).tolist()
    return ["".join(parts[i:j]) for i, j in zip([0, *stops], stops)]


def packed(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)


def encoded(docs: DataFrame, file_a: str, file_b: str, keep_groups: bool, block_chars: int, block_units: int) -> DataFrame:
    """A row for every text (its sizes, groups, and units as places in its block) and one for every block (its pairs)."""
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("groups_sha256", pa.string()),
                        ("units", pa.binary()), ("pairs", pa.list_(pa.struct([("key", pa.int32()), ("n", pa.int64())]))),
                        ("unit_links", pa.binary())])

    def run(batches):
        from pyspark import TaskContext
        first = TaskContext.get().partitionId() << 32
        block, units, chars = 0, None, 0

        def end():
            keys, total, place = units.links()
            pairs = pa.ListArray.from_arrays([0, len(keys)], pa.StructArray.from_arrays(
                [pa.array(keys.astype(np.int32)), pa.array(total)], names=["key", "n"]))
            whole = packed(np.r_[len(units.sizes), np.maximum(units.sizes[:, 3], 0), place])
            none = [pa.nulls(1, f.type) for f in schema]
            return pa.RecordBatch.from_arrays([pa.array([first + block]), *none[1:9], pairs, pa.array([whole])], schema=schema)

        for whole in batches:
            for b in slices(whole):
                if units is None:
                    units = Units(tokenizer_path(file_a), tokenizer_path(file_b))
                texts = b.column("text").to_pylist()
                cut = [CUT.split(t) if t else [] for t in texts]
                units.learn(sorted({u for x in cut for u in x} - units.at.keys()))
                rows = []
                for x in cut:
                    at = np.array([units.at[u] for u in x], np.int64)
                    if not len(at) or (units.sizes[at, 0] < 0).any():
                        rows.append((0, 0, 0, 0, "" if keep_groups else None, "", None))
                        continue
                    text = ";".join([units.groups[i] for i in at])
                    np.add.at(units.seen, at, 1)
                    steps = np.diff(np.sort(at), prepend=0)      # small numbers
                    rows.append((*units.sizes[at].sum(axis=0).tolist(), text if keep_groups else None,
                                 hashlib.sha256(text.encode()).hexdigest(), packed(steps)))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[2:9])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), first + block)), b.column("doc_id").cast(pa.int64()), *columns,
                     pa.nulls(len(rows), schema.field("pairs").type), pa.nulls(len(rows), pa.binary())], schema=schema)
                chars += sum(len(t) for t in texts if t)
                if chars >= block_chars or len(units.at) >= block_units:
                    yield end()
                    block, units, chars = block + 1, None, 0
        if units is not None:
            yield end()

    return arrow_map(docs.select("doc_id", "text"), run, ENCODED)


def aligned(docs: DataFrame, vocabulary_a: str = "byte_bpe_50k.json", vocabulary_b: str = "piece_bpe_32k.model",
            keep_groups: bool = True, block_chars: int = BLOCK_CHARS, block_units: int = BLOCK_UNITS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs`` (doc_id, text),
    and ``groups`` (``a1,a2|b1;a3|b2,b3``, token ids) if they are kept.

    The best counts are a row for each piece of B at most, which bounds their broadcast.
    """
    rows = written(encoded(docs, vocabulary_a, vocabulary_b, keep_groups, block_chars, block_units), "aligned")
    held = rows.where("pairs IS NOT NULL").select("block", F.explode("pairs").alias("p")).select("block", "p.key", "p.n")
    totals = written(held.groupBy("key").agg(F.sum("n").alias("total")), "pair-counts")
    b = F.col("key").bitwiseAND((1 << B_BITS) - 1)
    highest = totals.groupBy(b.alias("b")).agg(F.max("total").alias("highest"))
    counts = totals.join(F.broadcast(highest), b == F.col("b")).select("key", "total", (F.col("total") == F.col("highest")).alias("best"))
    known = held.select(F.col("block").alias("of"), "key").join(counts, "key").select("of", "key", "total", "best")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256"]

    def price(left, right):
        whole = next(x for x in left.column("unit_links").to_pylist() if x is not None)
        texts = left.filter(left.column("unit_links").is_null())
        numbers = unpacked(whole)
        sizes, place = numbers[1:1 + numbers[0]], numbers[1 + numbers[0]:]
        order = np.argsort(right.column("key").to_numpy())      # the block's keys, ascending as ``place`` counts them
        total = right.column("total").to_numpy()[order]
        best = right.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        stops = np.r_[0, np.cumsum(sizes)]
        of_unit = [(lambda s: s[stops[1:]] - s[stops[:-1]])(np.r_[0, np.cumsum(x[place])]) for x in (best, total)]
        found = []
        for data in texts.column("units").to_pylist():
            at = np.cumsum(unpacked(data)) if data is not None else np.zeros(0, np.int64)
            found.append([int(x[at].sum()) for x in of_unit])
        n_best, count_sum = zip(*found) if found else ((), ())
        return pa.table([*[texts.column(c) for c in columns], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())],
                        names=[*columns, "n_best", "count_sum"])

    priced = rows.select("block", *columns, "units", "unit_links").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(
        price, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, n_best long, count_sum long")
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return priced.select(*out, *["groups"] * keep_groups)
