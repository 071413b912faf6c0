"""Spelling variants against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sparkweft.llm import spelling

SCHEMA = "doc_id long, text string, word string, id int"


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    left = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            left[w[:i] + w[i + 1 :]].add(w)
    near = {w: set() for w in counts}
    for rest, group in left.items():
        for a, b in itertools.combinations(group | ({rest} & counts.keys()), 2):
            long, short = sorted((a, b), key=len, reverse=True)
            one = sum(x != y for x, y in zip(a, b, strict=True)) == 1 if len(a) == len(b) else len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))
            if one:
                near[a].add(b)
                near[b].add(a)
    best = {w: min(near[w], key=lambda x: (-counts[x], x)) for w in counts if near[w]}
    form = {w: b for w, b in best.items() if counts[b] >= 10 * counts[w]}
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


def texts(seed, n_docs, n_words, letters, base):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 10))) for _ in range(base)]
    for i in range(n_docs):
        out = []
        for _ in range(n_words):
            w = rng.choice(words[: 1 + int(rng.paretovariate(0.7))])
            p = rng.randrange(len(w))
            edits = (w[:p] + rng.choice(letters) + w[p:], w[:p] + w[p + 1 :], w[:p] + rng.choice(letters + "ZÉ") + w[p + 1 :])
            out.append(rng.choice(edits) if rng.random() < 0.2 else w)
        yield (i if i % 7 else None, " ".join(out))


@pytest.mark.parametrize(("seed", "letters", "base"), [(1, "abcàé", 60), (2, "ab", 12)])
def test_against_brute_force(spark, seed, letters, base):
    rows = [*texts(seed, 120, 150, letters, base), (5, None), (6, ""), (None, None), (7, " ".join(["a" * 3000] * 2 + ["a" * 2999] * 2))]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = spelling.spelling_variants(df).collect()
    assert len(got) == len({r["word"] for r in got})
    want = brute(rows)
    assert {tuple(r) for r in got} == want
    assert any(f and f != root for _, f, root, *_ in want) or seed == 2


def test_repeated_rows_and_ties(spark):
    rows = [(1, "lettera " * 10 + "letterb " * 10 + "letterc")] * 2
    got = {r["word"]: r for r in spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {w: (r["n"], r["n_near"], r["form"]) for w, r in got.items()} == {"lettera": (20, 2, None), "letterb": (20, 2, None), "letterc": (2, 2, "lettera")}


def test_empty(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, "short words only here")], "doc_id long, text string")).collect() == []


def test_ways_number_each_node_once(spark):
    words = [(i, w) for i, w in enumerate(sorted({"".join(p) for p in itertools.product("abc", repeat=4)} | {"a", "ab", "abcabc", "b" * 50}))]
    way = {r["word"]: r["way"] for r in spelling.trie_ways(spark.createDataFrame(words, "id long, word string")).collect()}
    nodes = {}
    for w, path in way.items():
        assert path[0] == 0 and len(path) == len(w) + 1
        for k in range(len(w) + 1):
            assert nodes.setdefault(w[:k], path[k]) == path[k]
    assert sorted(nodes.values()) == list(range(len(nodes)))
