"""Words are cut and told apart in Arrow: the same ids as the library's, no look-up of every occurrence."""

import random

from millrace.llm import entry
from millrace.llm.word_ids import WordIds

PIECES = ["a", "é", "ß", "÷", "×", "Z", "É", "İ", "Σ", ".", ",", "!", "'", "s", " ", "\n", "\x1c", " ", "́", "̈́", "<|endoftext|>", "<|", "1", "#", "ÿ", "\t", "\x0b", "\x85", "한", "ſ", "ñ.", "'S"]


def test_odd_texts_as_the_library_encodes_them():
    rng = random.Random(3)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(8000)] + ["", " ", "  a  "]
    words = WordIds(entry.WORD_BPE)
    assert words.by_word
    want = [e.ids for e in words.library.encode_batch(texts, add_special_tokens=False)]
    for low in range(0, len(texts), 1000):
        got = words.encode(texts[low : low + 1000])
        assert [memoryview(x).cast("I").tolist() for x in got] == want[low : low + 1000]
    assert words.encode([]) == [] and words.encode([""]) == [b""]


def test_a_word_is_looked_up_once_in_a_slice():
    words, seen = WordIds(entry.WORD_BPE), []

    class Counted(type(words.table)):
        def get(self, key, default=None):
            seen.append(key)
            return super().get(key, default)

    words.table = Counted()
    one, two = words.encode(["the cat, the été, dog " * 50, "The cat. " * 20])
    assert len(seen) == len(set(seen)) <= 7 and len(one) > len(two) > 0
