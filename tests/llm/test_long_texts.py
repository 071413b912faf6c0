"""Token counts of very long texts against the library where it can, by known pieces where it can't."""

import random

import pytest

from sparkweft.llm import token_counts

PATH = f"{token_counts.TOKENIZERS}/{token_counts.VOCABULARY}"


def test_long_white_space_as_the_library_counts_it():
    encoding, rng = token_counts.encoder(PATH), random.Random(2)
    for _ in range(60):
        kinds = rng.choice([" ", "\n", "\t", " \n", "\r\n\t ", "　", " \x1c"])
        run = "".join(rng.choice(kinds) for _ in range(rng.choice([1, 4095, 4096, 4097, 5000, 50_000])))
        text = rng.choice(["", "a", "word ", "x1!"]) + run + rng.choice(["", "b", " c", "!!", "9", "\x1c", "é"]) + rng.choice(["", run, run + "z"])
        assert token_counts.token_count(encoding, text) == len(encoding.encode_ordinary(text))


@pytest.mark.parametrize("space", [" ", "\n", "\t", " \n\t"])
def test_two_million_spaces(spark, space):
    text = "a" + space * (2_000_000 // len(space)) + "b"
    rows = [(1, text), (2, None), (3, ""), (4, "a"), (5, " " * 2_000_000)]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    encoding = token_counts.encoder(PATH)
    # longer runs have the pieces of shorter ones: what one more repeat adds is the same
    short = lambda n: len(encoding.encode_ordinary("a" + space * n + "b"))
    step = short(20_000) - short(10_000)
    assert got[1] == short(10_000) + step * (2_000_000 // len(space) - 10_000) // 10_000
    assert (got[2], got[3], got[4]) == (0, 0, 1)
