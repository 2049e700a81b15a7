"""Features of whole batches against those of single texts, counted by hand."""

from __future__ import annotations

from collections import Counter

import numpy as np

from leafmill.llm.quality import GRAM, Texts

TEXTS = ["", "abc", "abcd", "Über ätsch 🦜x", "aaaaaa", "één", "the cat the cat"]


def test_grams_are_of_characters_and_of_one_text():
    data = [t.encode() for t in TEXTS]
    whole = Texts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    slots, at = whole.features()[2]
    seen: dict[str, int] = {}
    for k, text in enumerate(TEXTS):
        own = slots[at[k] : at[k + 1]]
        grams = [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)]
        assert len(own) == len(grams)
        for gram, slot in zip(grams, own.tolist(), strict=True):
            assert seen.setdefault(gram, slot) == slot
        alone = Texts(np.frombuffer(data[k], np.uint8), np.array([0, len(data[k])])).features()
        assert Counter(alone[2][0].tolist()) == Counter(own.tolist())
    assert len(set(seen.values())) == len(seen)
