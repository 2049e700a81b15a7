"""Disguises that the lattice must see through."""

from __future__ import annotations

import time

import numpy as np
import pytest

from leafmill.llm import toxicity

WORDS = ["idiot", "stupid", "moron", "loser", "trash", "worthless", "piece", "pathetic"]


@pytest.fixture
def restorer():
    bigrams = np.ones((28, 28))
    for word in WORDS * 50:
        codes = [0, *(ord(c) - 96 for c in word), 0]
        for a, b in zip(codes, codes[1:], strict=False):
            bigrams[a, b] += 1
    return toxicity.Restorer(bigrams, frozenset({"the", "is"}))


def forms(restorer, text):
    words = toxicity.Words(restorer)
    own = toxicity.raw_words(text, restorer.common)
    words.learn(own)
    return " ".join(f for w in own for f in words.known[w])


@pytest.mark.parametrize("text, word", [("stu" + "u" * 40 + "pid", "stupid"), ("you-are-a-w0rthle$$-p1ece-of-tr@sh", "trash"), ("1d10t" + "-x1" * 3000 + "-m0r0n", "moron")])
def test_long_tokens(restorer, text, word):
    assert word in forms(restorer, text)


@pytest.mark.parametrize(
    "text, word",
    [("l o $ e r", "loser"), ("i d ! o t", "idiot"), ("i  d  i  o  t", "idiot"), ("m\to\tr\to\tn", "moron"), ("he is a m o r o n.", "moron"), ("the stu pid", "stupid"), ("stu-pid", "stupid"), ("m/o/r/o/n", "moron"), ("iddiioott", "idiot"), ("losser", "loser")],
)
def test_separators_and_doubled_letters(restorer, text, word):
    assert word in forms(restorer, text)


def test_common_short_words(spark):
    docs = spark.createDataFrame([("the cat is 12",), ("the é",), (None,)], "text string")
    assert toxicity.count_characters(docs)[1] == {"the", "cat", "is"}


def best_by_hand(restorer, token):
    """Every reading of a token, one after the other."""
    readings = {((), 0): 0.0}
    for i, char in enumerate(token):
        emit, drop = restorer.cost(char)
        if i and char == token[i - 1] and char.isalpha():
            drop = -1.0
        new = {}
        for (text, state), value in readings.items():
            options = [((text, state), value + drop)]
            options += [(((*text, char if c == 27 else toxicity.LETTERS[c - 1] if c else " "), c), value + restorer.step[state, c] + emit[c]) for c in np.flatnonzero(emit > -np.inf)]
            for key, v in options:
                new[key] = max(v, new.get(key, -np.inf))
        readings = new
    ends = sorted(((v + restorer.step[state, 0], "".join(text)) for (text, state), v in readings.items()), reverse=True)
    return ends


def test_viterbi_finds_the_best_reading(restorer):
    rng = np.random.default_rng(3)
    chars = list("aisto10$@!*-.7é")
    checked = 0
    for _ in range(400):
        token = "".join(rng.choice(chars, int(rng.integers(1, 7))))
        ends = best_by_hand(restorer, token)
        if len(ends) == 1 or ends[0][0] - ends[1][0] > 1e-9:
            assert restorer.restore([token]) == [ends[0][1]], token
            checked += 1
    assert checked > 300


def test_empty_table_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "x"), (None, None), (2, "")], "doc_id long, text string")
    model = toxicity.train(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs.limit(0), model).count() == 0 and {r.score for r in toxicity.score(docs, model).collect()} == {0.05}


def test_words_of_one_core_are_decoded_once(restorer, monkeypatch):
    decoded = []
    own = restorer.restore
    monkeypatch.setattr(restorer, "restore", lambda tokens: decoded.extend(tokens) or own(tokens))
    words = toxicity.Words(restorer)
    words.learn({"stu-pid.", "stu-pid,", "“stu-pid"})
    assert decoded == ["stu-pid"] and all("stupid" in forms for forms in words.known.values())


def test_many_short_words_in_a_row(restorer):
    began = time.process_time()
    words = toxicity.raw_words("is the " * 60_000 + "nothing stu pid", restorer.common)
    assert words == {"is", "the", "nothing", "stu", "pid", "stu pid"} and time.process_time() - began < 5


def test_scores_when_known_words_are_dropped(restorer, monkeypatch):
    model = toxicity.Model(-3.0, {"=stupid": 6.0, "=moron": 5.0}, restorer)
    whole = model.scorer()
    monkeypatch.setattr(toxicity.Words, "__init__", lambda words, restorer, most=0, own=toxicity.Words.__init__: own(words, restorer, most))
    small = model.scorer()
    texts = [f"a {a} stu-pid word {k}" if k % 3 else f"m-o-r-o-n {k}" for k, a in enumerate("xyzxyzxyz")]
    assert [small([t])[0] for t in texts] == whole(texts)
