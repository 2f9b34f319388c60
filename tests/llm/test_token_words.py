"""Counts and ids of random Unicode words, marks and expansions included, against the library."""

import random
import sys
import unicodedata

import pytest

from paperstrata.llm import tokens


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(tokens.tokenizer_path())


def same(library, texts):
    counter, words = tokens.Counter(tokens.tokenizer_path()), tokens.Words(tokens.tokenizer_path())
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # words are compiled when they come again
        assert counter([t.encode() for t in texts]) == [len(x) for x in want]
    import numpy as np

    assert [np.frombuffer(words.ids(t), np.uint32).tolist() for t in texts] == want


@pytest.mark.parametrize("tail", list(".,;:!?") + ["...", "!?"])
def test_letters_that_end_in_marks(library, tail):
    same(library, [f"{w}{tail}" for w in ("İ", "EVİ", "ǰ", "ﬁ", "H̱", "é", "ß", "ẞ", "ŉ", "ΐ", "ΑΣ", "क्ष", "กำ", "א", "שׁ")])


def test_many_tokens_in_a_short_word(library):
    same(library, ["שּׁ" * 85, "x " + "שּׁ" * 85 + " y " + "שּׁ" * 85, "𝔘" * 60])


def test_random_words(library):
    rng = random.Random(11)
    letters = [chr(c) for c in range(33, sys.maxunicode) if unicodedata.category(chr(c))[0] in "LMNPS" and c < 0x3000]
    special = "İıŉǰΐΰ̣̇́̈ſKÅΣςﬁﬀשּׁ̈́'’.,;:!?-_<|>"

    def word():
        pool = rng.choice([letters, special, "abcdefgXYZ", special + "abcXYZ"])
        return "".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", "!", ",", "'s"])

    words = [word() for _ in range(100_000)]
    same(library, [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)])


def test_texts_over_a_segment(library):
    rng = random.Random(12)
    some = ["EVİ.", "Straße", "naïve,", "don't", "x1y2", "über-", "…"]
    long = " ".join(rng.choice(some) + rng.choice(["", "a", "İ", "9"]) for _ in range(900_000))
    assert len(long.encode()) > tokens.SEGMENT
    same(library, [long, "a" * (tokens.LANE * 3) + " " + long[:100]])


def test_merges(library):
    """The automaton against plain merging and the library: pieces of the vocabulary glued together, periods, letters of all bytes."""
    import json

    from paperstrata.llm.merges import Merges

    model = json.loads(library.to_str())["model"]
    own, rng = Merges(model), random.Random(13)
    pieces, letters = [t.removesuffix("</w>") for t in model["vocab"]], sorted({c for t in model["vocab"] for c in t.removesuffix("</w>")})
    words = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))) for _ in range(15_000)]
    words += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(5_000)]
    words += ["".join(rng.choice(["aab", "in", "ing", "th", "a"]) for _ in range(rng.randint(1, 60))) for _ in range(3_000)]
    for w in words:
        assert own.count(w) == len(library.model.tokenize(w)), w
        if len(w) < 12:
            assert own.count(w) == len(own.merged([*[own.plain[c] for c in w[:-1]], own.final[w[-1]]]))
    own.states.clear()
    own.ends.clear()
    assert [own.count(w) for w in words[:200]] == [len(library.model.tokenize(w)) for w in words[:200]]


def test_letters_of_latin_1_are_normalised_without_the_library(library):
    """Every letter of Latin-1, alone and with marks, has its ids, and the library's normaliser is asked for none of them."""
    letters = [chr(c) for c in range(65, 256) if chr(c).isalpha()]
    words = tokens.Words(tokens.tokenizer_path())
    assert [words.normal(f"{c}a{c}") for c in letters] == [library.normalizer.normalize_str(f"{c}a{c}") for c in letters]

    class Library:
        model = words.library.model

    words.library = Library  # has no normaliser
    assert [words.normal(f"Ñ{c}") for c in letters] == [f"Ñ{c}".lower() for c in letters]
    same(library, [f"{c}{c}a{tail} {c}" for c in letters for tail in ("", ".", "?!", "-x.", ".x")])
