"""Cheapest repairs don't depend on cuts; excuses are found in one pass; terms of one slot add up."""

import itertools
import math
import random
import time

from sparkweft.llm import chat, quality, toxicity


def first_cheapest(roles):
    """The cheapest labels, of equal ones the first in order, by trying all."""
    best = (math.inf, ())
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        at, cost = 0, 0
        for r, to in zip(roles, labels, strict=True):
            cost += chat.step_cost(r, at, to)
            at = to
        best = min(best, (cost + chat.INSERT * len(chat.ENDS[at]), labels))
    return list(best[1])


def repaired(blocks):
    ends = chat.borders([chat.block_matrix(b) for b in blocks])
    return [x for b, (first, last) in zip(blocks, ends, strict=True) for x in chat.block_labels(b, first, last)]


def test_labels_at_any_cut():
    rng = random.Random(4)
    for roles in [[3, 0, 2, 1, 1, 3, 0, 0], *([rng.randrange(4) for _ in range(rng.randint(1, 7))] for _ in range(250))]:
        want = first_cheapest(roles)
        assert repaired([roles]) == want
        for cut in range(1, len(roles)):
            assert repaired([roles[:cut], roles[cut:]]) == want
        assert repaired([[r] for r in roles]) == want
    long = [rng.randrange(4) for _ in range(3000)]
    assert repaired([long]) == repaired([long[i : i + 256] for i in range(0, 3000, 256)]) == repaired([long[i : i + 7] for i in range(0, 3000, 7)])


def test_excuses():
    lex = toxicity.Lexicon({" trash": 5.0, " moron ": 5.0})
    began = time.perf_counter()
    assert len(lex.matches(toxicity.fold("trash can " * 100_000 + "trash " * 100_000 + "moron"))) == 100_001
    assert time.perf_counter() - began < 5
    # nested and overlapping spans against every span
    rng = random.Random(6)
    lex = toxicity.Lexicon({" a": 1.0, " b ": 2.0, " c": 1.0}, exceptions=("a b", "b c a", "c", "a b c a b"))
    words = lex.exceptions
    for _ in range(200):
        folded = toxicity.fold(" ".join(rng.choice("abcd") for _ in range(12)))
        spans = [(i, i + len(toxicity.fold(p)) - 1) for p in words for i in range(len(folded)) if folded.startswith(toxicity.fold(p), i)]
        for s, e, _ in lex.matches(folded):
            assert not any(x <= s and e <= y for x, y in spans)
        free = {i for t in lex.weights for i in range(len(folded)) if folded.startswith(t, i) and not any(x <= i and i + len(t) - 1 <= y for x, y in spans)}
        assert {s for s, _, _ in lex.matches(folded)} <= free


def test_letters_without_a_form():
    assert toxicity.fold("Łøđß Æœ") == " lodss aeoe "


def test_slots_add_up(monkeypatch):
    monkeypatch.setattr(quality, "WORDS", 1)
    slot = 1 + quality.SHAPES
    text = b"one two two"
    assert math.isclose(quality.bag(text)[slot], quality.WORD_WEIGHT * (math.log1p(100 / 3) + math.log1p(200 / 3)))
    assert quality.bag(text)[slot] == quality.bag(b"two one two")[slot]
