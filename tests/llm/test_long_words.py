"""Long pre-tokens: linked merging equals the ragged rounds and the library, in time that follows the merges."""

import random
import time

import pytest
from tokenizers import Tokenizer

from freshlane.llm import tokens
from freshlane.llm.common import tokenizer_path

FILE = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def merger():
    return tokens.RankMerger(tokenizer_path(FILE))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path(FILE))


def _words():
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    yield from ("a" * n for n in range(1, 40))
    yield from ("ab" * n + "a" for n in range(1, 20))
    yield from ("-" * n for n in (1, 2, 3, 63, 64, 65, 129, 1000))
    for n in (1, 2, 5, 50, 500, 3000):
        yield "".join(rng.choice(letters) for _ in range(n))
        yield "".join(rng.choice("ae") for _ in range(n))
        yield "".join(rng.choice("thein") for _ in range(n))
        yield "".join(chr(rng.randrange(0x4E00, 0x4E40)) for _ in range(n))


def test_linked_rounds_equal_the_ragged_ones_and_the_library(merger, library):
    words = list(_words())
    linked = [merger.merge_long(w.encode()) for w in words]
    assert linked == merger.merge([w.encode() for w in words]).tolist()
    assert linked == [len(library.encode(w, add_special_tokens=False).ids) for w in words]


def test_long_and_short_words_in_one_text(merger, library):
    rng = random.Random(5)
    text = " ".join(["The", "x" * (tokens.LONG_PIECE - 2), "y" * tokens.LONG_PIECE, "end",
                     "".join(rng.choice("etaoin") for _ in range(3 * tokens.LONG_PIECE)), "of it."])
    assert merger.count([text, None, ""]) == [len(library.encode(text, add_special_tokens=False).ids), 0, 0]


def test_a_word_of_a_megabyte_ends_in_seconds(merger, library):
    rng = random.Random(3)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    start = time.process_time()
    n = merger.count([word])[0]
    spent = time.process_time() - start
    print(f"{spent:.1f} s")
    assert n == len(library.encode(word, add_special_tokens=False).ids)
    assert spent < 60
