"""Operator 10, token counts by rank-synchronous array merging; exact ids for packing.

A byte-level BPE splits a text into pre-tokens and merges, inside each, the adjacent pair of
lowest rank until none is left. Here the pre-tokens of a whole Arrow batch that were not met
before are one ragged numpy array of symbol ids. Every round looks up the rank of each adjacent
pair, takes each sequence's lowest rank, merges all its occurrences from the left at once, and
drops finished sequences. What survives is counted per pre-token and summed per document. A pre-token of
LONG_PIECE bytes or more (a megabyte without a space) takes the same rounds by itself, over linked arrays:
only pairs that a merge has changed are ranked again, so its cost follows its merges, not rounds times length.

Edge cases: a null or empty text has no tokens; special strings of the vocabulary inside a text
are one token each, as the library's default has it; repeated rows give repeated rows.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from freshlane.llm.common import arrow_map, tokenizer_path

#: Byte-level pre-token pattern of the vocabulary (fixed value). White space is the Unicode property.
PRETOKEN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"""
            r"""|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+""")

#: Pre-tokens remembered by one Python worker before it starts afresh (memory bound, not a result bound).
MAX_REMEMBERED = 400_000
#: Bytes of new pre-tokens merged in one numpy round.
ROUND_BYTES = 2_000_000
#: Bytes from which a pre-token is merged by itself, over linked arrays.
LONG_PIECE = 4_000


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies spell the 256 bytes: printable ones as they are,
    the others from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], dict[str, int]]:
    """Token ids by bytes, merges in rank order, and special strings of a ``tokenizers`` file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    spell = lambda s: bytes(letters[c] for c in s)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ids = {spell(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    merges = [tuple(spell(s) for s in (m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
    return ids, merges, special


class RankMerger:
    """Counts the symbols that byte-level BPE leaves of many pre-tokens at once."""

    def __init__(self, path: str):
        import regex
        ids, merges, special = vocabulary(path)
        self.size = max(ids.values()) + 1
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        order = np.argsort(left * self.size + right, kind="stable")
        self.pairs = (left * self.size + right)[order]
        self.ranks = order.astype(np.int64)      # rank of the k-th pair in sorted order
        self.made = made                         # symbol made by a rank
        self.bytes = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        self.pattern = regex.compile(PRETOKEN)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.known: dict[str, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], len(self.made))

    def merge_long(self, piece: bytes) -> int:
        """Symbols left of one piece: rounds of its lowest rank over linked arrays, ranks kept in a heap."""
        symbols = self.bytes[np.frombuffer(piece, np.uint8)]
        end, none = len(symbols), len(self.made)
        after, before = np.arange(1, end + 1), np.arange(-1, end - 1)
        rank_at = np.full(end, none, np.int64)      # rank of the pair that starts at a place, none at dead places
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def rank_again(at: np.ndarray) -> None:
            """Rank the pairs that start at ``at`` (no place twice) and queue those that can merge."""
            pairs = at[after[at] < end]
            rank_at[at] = none
            rank_at[pairs] = self._rank(symbols[pairs], symbols[after[pairs]])
            pairs = pairs[rank_at[pairs] < none]
            pairs = pairs[np.argsort(rank_at[pairs], kind="stable")]
            ranks, starts = np.unique(rank_at[pairs], return_index=True)
            for rank, places in zip(ranks.tolist(), np.split(pairs, starts[1:])):
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(heap, rank)
                waiting[rank].append(places)

        rank_again(np.arange(end))
        count = end
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[rank_at[at] == rank]
            if not len(at):
                continue
            # As in ``merge``: of hits that overlap, every second one of a run, from the left.
            run = np.r_[True, after[at[:-1]] != at[1:]] | (symbols[at] != symbols[after[at]])
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            gone = after[at]
            symbols[at] = self.made[rank]
            after[at] = after[gone]
            rank_at[gone] = none
            following = after[at]
            inside = following < end
            before[following[inside]] = at[inside]
            count -= len(at)
            rank_again(np.unique(np.r_[at, before[at][before[at] >= 0]]))
        return count

    def merge(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty piece."""
        left = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if (left >= LONG_PIECE).any():
            long = np.flatnonzero(left >= LONG_PIECE)
            short = np.flatnonzero(left < LONG_PIECE)
            left[long] = [self.merge_long(pieces[i]) for i in long]
            if len(short):
                left[short] = self.merge([pieces[i] for i in short])
            return left
        symbols = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), left)
        none = len(self.made)
        while len(symbols) > 1:
            rank = np.full(len(symbols), none, np.int64)
            rank[:-1] = np.where(owner[1:] == owner[:-1], self._rank(symbols[:-1], symbols[1:]), none)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            alive = np.repeat(lowest < none, sizes)
            if not alive.any():
                break
            hit = (rank == np.repeat(lowest, sizes)) & (rank < none)
            # Occurrences that overlap ("aaa") merge from the left: every second one of a run of hits.
            at = np.flatnonzero(hit)
            run = np.r_[True, np.diff(at) != 1]
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            symbols[at] = self.made[rank[at]]
            alive[at + 1] = False
            left -= np.bincount(owner[at], minlength=len(left))
            symbols, owner = symbols[alive], owner[alive]
        return left

    def learn(self, pieces: set[str]) -> None:
        """Remember the counts of new pre-tokens, in rounds of bounded size."""
        part, size = [], 0
        for piece in pieces:
            part.append(piece)
            size += len(piece)
            if size >= ROUND_BYTES:
                self.known.update(zip(part, self.merge([p.encode() for p in part]).tolist()))
                part, size = [], 0
        if part:
            self.known.update(zip(part, self.merge([p.encode() for p in part]).tolist()))

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        split = []
        for text in texts:
            pieces, specials = [], 0
            if text:
                parts = self.special.split(text) if self.special else [text]
                specials = len(parts) - 1
                for p in parts:
                    pieces += self.pattern.findall(p)
            split.append((pieces, specials))
        new = {p for pieces, _ in split for p in pieces} - self.known.keys()
        if len(self.known) + len(new) > MAX_REMEMBERED:
            self.known = {}
            new = {p for pieces, _ in split for p in pieces}
        self.learn(new)
        get = self.known.__getitem__
        return [sum(map(get, pieces)) + specials for pieces, specials in split]


#: Characters of text handled together; a longer text is a batch of its own.
SLICE_CHARS = 4_000_000


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch by the size of its texts, so that memory does not follow the row count."""
    import pyarrow.compute as pc
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + SLICE_CHARS, side="right")))
        yield batch.slice(start, end - start)
        start = end


def token_counts(docs: DataFrame, limit: int = 512, vocabulary_file: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of ``docs`` (doc_id, text).

    ``vocabulary_file`` is looked up on each executor. No shuffle; memory per worker is bounded by
    the batch and by MAX_REMEMBERED pre-tokens.
    """
    def run(batches):
        merger = RankMerger(tokenizer_path(vocabulary_file))
        for whole in batches:
            for b in slices(whole):
                texts = b.column("text").to_pylist()
                n = merger.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").cast(pa.int64()),
                     pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                     pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """``text -> ids``: the vocabulary of a ``tokenizers`` file run by tiktoken, several times faster
    than the library and equal to it (tests compare them). Texts it cannot split go to the library."""
    import tiktoken
    ids, _, special = vocabulary(path)
    pattern = PRETOKEN.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S")
    fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ids, special_tokens=special)
    slow = []

    def encode(text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        try:
            return np.array(fast.encode(text, allowed_special="all"), np.uint32)
        except ValueError:
            if not slow:
                from tokenizers import Tokenizer
                slow.append(Tokenizer.from_file(path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode
