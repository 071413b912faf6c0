"""The training-data operators against brute force and invariants, on a messy table."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweft.llm import chat, class_lm, decontaminate, line_dedup, merkle, mixing, near_dedup, quality, token_counts, toxicity
from sparkweft.llm.common import remainder

#: documents with extra columns whose names clash with the operators' own
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, copies int, label int, word string"
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice(["ba", "le", "tion", "re", "ing", "on", "thé"]) for _ in range(RNG.randint(1, 4))) for _ in range(400)]


def words(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def make_rows():
    shared = " ".join(words(12))
    texts = []
    for i in range(60):
        lines = [" ".join(words(RNG.randint(3, 30))).capitalize() + "." for _ in range(RNG.randint(1, 4))]
        if i % 6 == 0:
            lines.append("  " + shared.upper() + "\t")
        texts.append("\n".join(lines))
    base = " ".join(words(80))
    for k in range(12):  # near copies with more and more edits, and exact copies in another case
        w = base.split()
        for at in range(0, k):
            w[at * 6] = f"edit{k}x{at}"
        texts.append(" ".join(w))
    texts += [base.upper(), base, None, "", " \n\t", "one two", "one two", "x", " ".join(words(6000)), "\n\n\n", texts[0], texts[0], "ünï ÇÖDE \U0001f600 " * 20]
    rows = [(i, t, "en", [None, "b", "a", "hot", "hot", "hot"][i % 6], len(t or ""), 0.5, True, 1, 1, "w") for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[5], "en", None, 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(50)] + [(None, 1, 1), (7, None, None), (8, 0, 0), (9999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    item = " ".join(ROWS[70][1].split()[20:45])
    rows = [(1, item), (2, item), (3, " ".join(words(20))), (4, None), (5, ""), (6, "one two"), (7, "x y z"), (8, " ".join(ROWS[0][1].split()[1:4])), (None, item)]
    return spark.createDataFrame(rows, "item_id long, text string")


def tokens(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = tokens(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_line_dedup_counts_documents_not_rows(spark):
    line = "this line of more than forty characters stands in several documents"
    four = [(1, line), (2, line), (3, line), (4, line), (4, f"other text\n{line}"), (None, line), (None, line)]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.n_dropped == 0 for r in line_dedup.line_digest(df(four)).collect())
    got = line_dedup.line_digest(df([*four, (5, line)])).collect()
    assert sorted((str(r.doc_id), r.n_dropped) for r in got) == [("1", 1), ("2", 1), ("3", 1), ("4", 1), ("4", 1), ("5", 0), ("None", 0), ("None", 0)]
    long = [(i, "z" * 2_000_000 if i < 6 else "word " * 20_000) for i in range(7)]
    assert sorted((r.doc_id, r.n_dropped) for r in line_dedup.line_digest(df(long)).collect()) == [(i, int(i < 5)) for i in range(7)]


def test_line_dedup(docs, none):
    known = [(r[0], r[1]) for r in ROWS if r[0] is not None]
    want = line_dedup.reference(known)
    got = line_dedup.line_digest(docs).collect()
    assert len(got) == len(ROWS)
    assert all((r.n_lines, r.n_dropped, r.kept_sha256) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert sum(r.n_dropped for r in got) > 5 and all(r.n_dropped == 0 for r in got if r.doc_id is None)
    after = line_dedup.drop_lines(docs)
    assert after.columns == docs.columns and after.count() == len(ROWS)
    for r in after.filter("doc_id IS NOT NULL").collect():
        assert hashlib.sha256((r.text or "").encode()).hexdigest() == want[r.doc_id][2]
        assert r.n_chars == len(r.text or "")
    assert line_dedup.line_digest(none).count() == 0 == line_dedup.drop_lines(none).count()


def brute_components(rows):
    sets, parent = {}, {}
    for r in rows:
        if r[0] is not None:
            sets[r[0]], parent[r[0]] = shingles(r[1]), r[0]

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_dedup(docs, none):
    want = brute_components(ROWS)
    got = near_dedup.near_dedup(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
        else:
            assert r.kept and r.component_id is None
    left = near_dedup.drop_near_duplicates(docs)
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in got if r.kept} and left.columns == docs.columns
    assert near_dedup.near_dedup(none).count() == 0 == near_dedup.drop_near_duplicates(none).count()


def test_near_dedup_of_a_large_group_with_outliers(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 1, 2, 3, 6, 9])):
            w[at] = f"e{i}x{at}"
        rows.append((i, " ".join(w)))
    want = brute_components(rows)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 1 < len({c for _, c in want.values()}) < 400


def test_components_and_estimate(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (8, 7), (5, 5)], "a long, b long")
    assert {(r.node, r.label) for r in near_dedup.components(links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (9, 7), (8, 7), (7, 7)}
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        h = rng.integers(0, 2**64, 2000, dtype=np.uint64)
        k = int(2000 * share)
        a, b = h[: (2000 + k) // 2], h[(2000 - k) // 2 :]
        x, y = near_dedup.registers(np.unique(a)), near_dedup.registers(np.unique(b))
        got = near_dedup.joint_estimate(x[None], y[None], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(got - len(np.intersect1d(a, b)) / 2000) < 0.17
    # mergeable: the registers of a union are the larger of both
    assert (np.maximum(x, y) == near_dedup.registers(np.unique(h))).all()


def test_decontaminate(docs, none, benchmark):
    lower = lambda t: (t or "").lower().encode().split()
    sh = lambda t, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if (w := lower(t)) else set()
    width = {r.item_id: min(5, len(lower(r.text))) for r in benchmark.collect()}
    items = {r.item_id: sh(r.text, width[r.item_id]) for r in benchmark.collect() if r.item_id is not None}
    want = {(d[0], i) for d in ROWS if d[0] is not None for i, s in items.items() if s and 100 * len(s & sh(d[1], width[i])) >= 75 * len(s)}
    got = decontaminate.contained_items(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 3 and len(got) == len(want)
    assert {d for d, i in want if i == 8} >= {0} and {d for d, i in want if i == 6} > set()
    assert all(r.n_found == len(items[r.item_id] & sh(ROWS[r.doc_id][1], width[r.item_id])) for r in got)
    bad = {d for d, _ in want}
    left = decontaminate.decontaminate(docs, benchmark)
    held = lambda t: any(s and 100 * len(s & sh(t, width[i])) >= 75 * len(s) for i, s in items.items())
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in ROWS if not held(r[1])) and left.columns == docs.columns
    assert bad and all(r[0] in bad for r in ROWS if held(r[1]) and r[0] is not None)
    assert decontaminate.contained_items(none, benchmark).count() == 0
    assert decontaminate.contained_items(docs, benchmark.limit(0)).count() == 0


def test_only_signature_hits_are_candidates(spark):
    """Candidates come from the minima of an item's size class alone, and from documents large enough for it."""
    w = [f"t{i}" for i in range(44)]
    items = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    sets = decontaminate.item_sets(items)
    row, kept = sets.first(), {r.h for r in decontaminate.signatures(sets).collect()}
    assert (row.n_item, row.size_class, len(kept)) == (40, 64, 40 - 30 + 1) and kept == set(sorted(row.s)[:11])
    order = {r.h: r.at for r in decontaminate.document_shingles(items.withColumnRenamed("item_id", "doc_id").withColumn("row", F.lit(0)), [5]).withColumn("at", F.monotonically_increasing_id()).collect()}
    first = min((order[h] for h in kept))
    # a document of the item's other shingles only is no candidate, though it shares some; one with a minimum is
    without = [" ".join(w[at : at + 5]) for h, at in ((h, order[h] % (1 << 33)) for h in set(order) - kept)]
    rows = [(10, " . ".join(without)), (11, " ".join(w[first % (1 << 33) : first % (1 << 33) + 5] + ["pad"] * 40)), (12, " ".join(w[first % (1 << 33) : first % (1 << 33) + 5]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.col("doc_id"))
    assert {(r.doc_id, r.item_id) for r in decontaminate.candidates(docs, sets, [5]).collect()} == {(11, 1)}
    assert decontaminate.contained_items(docs, items).count() == 0


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by the rule itself: cap what is above, share the excess among the others by weight, again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_targets_against_the_rule(spark):
    rng = random.Random(17)
    for n in (1, 2, 5, 12, 40):
        sizes = {(None if i == 3 else f"s{i:02d}ü"[: 2 + i % 3] + str(i)): rng.choice([0, 1, 10, 100, 1000, 10_000]) for i in range(n)}
        if not sum(sizes.values()):
            continue
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = brute_targets(sizes)
        assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in sizes), (n, got, want)


def test_equal_rows_and_repeated_ids_are_mixed_row_by_row(spark):
    rows = [(1, "a b c d", "s")] * 300 + [(1, f"w{i} x y z", "s") for i in range(300)] + [(None, f"n{i} x y z", "s") for i in range(300)] + [(None, None, "t"), (2, "q", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and {r.source_size for r in got if r.source == "s"} == {3600}
    taken = sum(r.copies * r.size for r in got if r.source == "s")
    assert abs(taken - got[0].target) <= 4 or abs(taken - 5401.5) <= 8
    written = mixing.apply_mix(docs).collect()
    assert sum(len(tokens(r.text)) for r in written if r.source == "s") == taken
    assert sum(r.text == "a b c d" for r in written) == sum(r.copies for r in got if r.doc_id == 1) - sum(r.doc_id == 1 and r.text != "a b c d" for r in written)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_mixing(docs, none):
    got = mixing.mix_digest(docs).collect()
    assert len(got) == len(ROWS)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_digest(docs.repartition(5)).collect()))
    size = lambda t: len(tokens(t))
    sizes = defaultdict(int)
    for r in ROWS:
        sizes[r[3]] += size(r[1])
    assert math.isclose(sum({r.source_size: r.target for r in got}.values()), 1.5 * sum(sizes.values()))
    source = {r[0]: r[3] for r in ROWS}
    taken, target = defaultdict(int), {}
    for r in got:
        assert r.taken <= 2 * r.size and (r.taken == 0 or r.taken % r.size == 0)
        if r.doc_id is not None:
            assert r.size == size(ROWS[r.doc_id][1]) and r.source_size == sizes[source[r.doc_id]]
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
        assert r.target <= 2 * r.source_size + 1e-6
    largest = sorted(size(r[1]) for r in ROWS)[-2]
    assert all(abs(taken[s] - target[s]) <= max(largest, 0.1 * s) for s in taken if s < 6000)
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == [*docs.columns, "copy"] and mixed.count() > 0
    assert mixing.mix(none).count() == 0 == mixing.apply_mix(none).count()


def test_pivot_keeps_words_and_expectation():
    rng = np.random.default_rng(3)
    size, rate = rng.integers(1, 500, 300), np.full(300, 0.37)
    total = np.zeros(300)
    for k in range(200):
        copies, left = mixing.pivot(size, rate, rng.random(300))
        rest = np.nan_to_num(left)
        assert (~np.isnan(left)).sum() <= 1
        assert math.isclose(((copies + rest) * size).sum(), (size * rate).sum(), rel_tol=1e-9)
        total += copies + rest
    assert abs(total.mean() / 200 - 0.37) < 0.01 and (np.abs(total / 200 - 0.37) < 0.2).all()


def test_class_lm(docs, none):
    train = [t for i, t in ((r[0], r[1]) for r in ROWS) if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    end = b"\n"
    c = Counter(w for t in train for w in [*tokens(t), end])
    n, v = sum(c.values()), len(c)
    got = class_lm.lm_query(docs).collect()
    assert len(got) == len(ROWS)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t, *_ in ROWS[:-3]:
        r, w = by[i][0], [*tokens(t), end]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
    assert len(by[3]) == 2 and by[3][0] == by[3][1] and len(by[None]) == 2
    model, _ = class_lm.fit(docs)
    # the score, token by token, from the model's classes
    ending = lambda w: model.endings.get(w[-class_lm.SUFFIX :], 0)
    own = lambda w: model.head.get(w, model.own) < model.own
    cls = lambda w: int(model.word_class[model.head[w]] if own(w) else model.ending_class[ending(w)])
    rest_n, rest_v = Counter(), Counter()
    for w, k in c.items():
        if not own(w):
            rest_n[ending(w)] += k
            rest_v[ending(w)] += 1
    mass, size, g = Counter(), Counter(), Counter()
    for w in model.head:
        if own(w):
            mass[cls(w)] += c[w]
            size[cls(w)] += 1
    for e in range(class_lm.ENDINGS):
        mass[int(model.ending_class[e])] += rest_n[e]
        size[int(model.ending_class[e])] += 1
    for t in train:
        for x, y in itertools.pairwise([end, *tokens(t), end]):
            g[cls(x), cls(y)] += 1
    out = Counter()
    for (x, _), k in g.items():
        out[x] += k
    share = lambda k: (mass[k] + 0.5) / (n + 0.5 * class_lm.CLASSES)

    def logp(x, y):
        p = (g[cls(x), cls(y)] + class_lm.ALPHA * share(cls(y))) / (out[cls(x)] + class_lm.ALPHA)
        norm = mass[cls(y)] + 0.5 * size[cls(y)]
        if own(y):
            return math.log10(p * (c[y] + 0.5) / norm)
        return math.log10(p * (rest_n[ending(y)] + 0.5) / norm * (c[y] + 0.5) / (rest_n[ending(y)] + 0.5 * (rest_v[ending(y)] + 1)))

    for i, t, *_ in ROWS[:40]:
        assert math.isclose(by[i][0].score, sum(logp(x, y) for x, y in itertools.pairwise([end, *tokens(t), end])), rel_tol=1e-7), i
    assert model.own == 1 + max(sum(k >= class_lm.MIN_COUNT for w, k in c.items() if w != end), min(len(c) - 1, class_lm.WORD_TYPES))
    assert class_lm.lm_query(none).count() == 0


def test_every_word_is_exchanged(spark, none, monkeypatch):
    """With few types of their own, the other words leave their ending's class for the best one by the fixed counts."""
    rng = random.Random(3)
    a, b = [f"ax{i}le" for i in range(20)], [f"bx{i}le" for i in range(20)]  # one ending for both kinds
    texts = [" ".join(w for _ in range(60) for w in (rng.choice(a), rng.choice(b))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, _ = class_lm.fit(docs, 8, 6)
    of = {w.decode(): int(model.word_class[i]) for w, i in model.head.items() if i < model.own}
    learned = [w for w, i in model.head.items() if 8 < i < model.own]
    assert len(learned) >= 30
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    monkeypatch.setattr(class_lm, "exchanged", lambda found, *_: found.limit(0).select("word", F.lit(0).alias("class")))
    start, _ = class_lm.fit(docs, 8, 6)
    old = {w.decode(): int(start.word_class[i]) for w, i in start.head.items() if i < start.own}
    g, after, before = np.zeros((6, 6)), defaultdict(lambda: np.zeros(6)), defaultdict(lambda: np.zeros(6))
    self_n = Counter()
    for t in train:
        w = ["\n", *t.split(), "\n"]
        for x, y in itertools.pairwise(w):
            g[old[x], old[y]] += 1
            if x == y:
                self_n[x] += 1
            else:
                after[x][old[y]] += 1
                before[y][old[x]] += 1
    for w in map(bytes.decode, learned):
        table, k = g.copy(), old[w]
        table[k] -= after[w]
        table[:, k] -= before[w]
        table[k, k] -= self_n[w]
        assert of[w] == class_lm.best_class(table, after[w], before[w], self_n[w], k), w
    assert len({of[w.decode()] for w in learned}) > 1


def test_exchange_ends_where_no_single_move_helps():
    pairs = np.random.default_rng(0).integers(0, 30, (40, 40)).astype(float)

    def likelihood(of):
        g = np.eye(5)[of].T @ pairs @ np.eye(5)[of]
        return class_lm.xlogx(g).sum() - class_lm.xlogx(g.sum(0)).sum() - class_lm.xlogx(g.sum(1)).sum()

    of = class_lm.exchange(pairs, classes=5)
    assert of[0] == 0 and (of[1:] > 0).all()
    for w, k in itertools.product(range(1, 40), range(1, 5)):
        moved = of.copy()
        moved[w] = k
        assert likelihood(moved) <= likelihood(of) + 1e-6


def skewed_pairs(seed, types=24):
    """A table of bigram counts with few frequent types, many rare ones and uneven pairs."""
    rng = np.random.default_rng(seed)
    x = rng.zipf(1.3, types).astype(float).clip(1, 1e4)
    return rng.poisson(np.outer(x, x) / x.sum() * rng.gamma(0.5, 2, (types, types))).astype(float)


def class_likelihood(pairs, of, classes=5):
    member = np.eye(classes)[of]
    g = member.T @ pairs @ member
    return class_lm.xlogx(g).sum() - class_lm.xlogx(g.sum(0)).sum() - class_lm.xlogx(g.sum(1)).sum()


def test_gains_are_what_the_likelihood_grows_by():
    for seed in range(10):
        pairs, of = skewed_pairs(seed), np.r_[0, np.random.default_rng(seed).integers(1, 5, 23)]
        for w in (1, 7, 23):
            member = np.eye(5)[of]
            member[w] = 0
            gain = class_lm.gains(member.T @ pairs @ member, pairs[w] @ member, pairs[:, w] @ member, pairs[w, w])[1:]
            grown = np.array([class_likelihood(pairs, np.r_[of[:w], k, of[w + 1 :]]) for k in range(1, 5)])
            assert np.allclose(gain - gain[0], grown - grown[0], rtol=1e-9, atol=1e-6), (seed, w)


@pytest.mark.parametrize("scale", [1, 10**6])
def test_exchange_ends_on_skewed_tables(scale, monkeypatch):
    """A gain that isn't the likelihood's has types go round and round; 100 passes are far more than are needed."""
    calls, best_class = [0], class_lm.best_class

    def counted(*args):
        calls[0] += 1
        assert calls[0] <= 100 * 23
        return best_class(*args)

    monkeypatch.setattr(class_lm, "best_class", counted)
    for seed in range(12):
        pairs, calls[0] = skewed_pairs(seed), 0
        of = class_lm.exchange(pairs * scale, classes=5)
        reached = class_likelihood(pairs, of)
        for w, k in itertools.product(range(1, 24), range(1, 5)):
            assert class_likelihood(pairs, np.r_[of[:w], k, of[w + 1 :]]) <= reached + 1e-6, (seed, w, k)


def test_exchange_ends_where_moves_raise_nothing(monkeypatch):
    """Moves that rounding errors make for ever end the exchange."""
    calls = [0]

    def wavering(g, after, before, self_n, a):
        calls[0] += 1
        assert calls[0] < 1000
        return 1 + a % 4

    monkeypatch.setattr(class_lm, "best_class", wavering)
    of = class_lm.exchange(np.full((9, 9), 7.0), classes=5)
    assert of[0] == 0 and ((of[1:] > 0) & (of[1:] < 5)).all()


def test_toxicity(spark, none, labels):
    rng, rows, marks = random.Random(2), [], []
    for i in range(600):
        bad = i % 4 == 0
        w = [rng.choice(VOCABULARY) for _ in range(rng.randint(8, 60))]
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["vilewort", "grubnik", "zorkhead"]))
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*rows, (700, None), (701, ""), (702, rows[0][1]), (None, rows[0][1])], "doc_id long, text string").withColumn("label", F.lit(3)).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) > 0.95 * len(held)
    assert toxicity.drop_toxic(docs, labels).filter("doc_id < 600").count() == sum(not r.predicted for r in got if r.doc_id is not None and r.doc_id < 600)
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0
    assert all(r.predicted == 0 for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect())


def naive_features(lex, text):
    """Brute force: every term is searched for by itself at every place."""
    folded = toxicity.fold(text)
    places = lambda t: [i for i in range(len(folded)) if folded.startswith(t, i)]
    spans = [(i, i + len(f) - 1) for p in lex.exceptions for f in [toxicity.fold(p)] for i in places(f)]
    best = {}
    for t in sorted(lex.weights, key=len):
        for i in places(t):
            if lex.weights[t] > best.get(i, (0.0, ""))[0]:
                best[i] = (lex.weights[t], t)
    hits = [(w, t) for i, (w, t) in best.items() if not any(x <= i and i + len(t) - 1 <= y for x, y in spans)]
    n, total = max(1, len(folded.split())), sum(w for w, _ in hits)
    return [1.0, math.log1p(total), math.log1p(10 * total / n), math.log1p(len({t.strip() for _, t in hits})), math.log1p(len(hits)) * math.log1p(n) / 10]


def test_toxicity_against_a_naive_search(docs):
    rng = random.Random(14)
    every = sorted(set().union(*(toxicity.terms(toxicity.fold(r[1] or "")) for r in ROWS[:30])))
    lex = toxicity.Lexicon({t: round(rng.uniform(0.5, 4), 1) for t in rng.sample(every, 150)}, tuple(" ".join(ROWS[k][1].split()[2:4]) for k in range(8)))
    lex.model = np.array([-2.0, 0.7, 0.4, 0.3, -0.2])
    got = defaultdict(set)
    for r in toxicity.toxicity(docs, lex).collect():
        got[r.doc_id].add(round(r.score, 9))
    some = [r for r in ROWS if r[0] is not None and len(r[1] or "") < 3000]
    want = {r[0]: round(1 / (1 + math.exp(-float(np.dot(naive_features(lex, r[1] or ""), lex.model)))), 9) for r in some}
    assert all(got[i] == {w} for i, w in want.items()) and len(set(want.values())) > 40


def test_folding_of_other_scripts_accents_and_digits():
    same = ["moron", "MORON", "mórôn", "\uff4dоrоn", "m\u200boron", "m0r0n", "𝐦𝐨𝐫𝐨𝐧", "moro\u0301n"]
    assert {toxicity.fold(t) for t in same} == {" moron "}
    assert toxicity.fold("a55 k1ck$") == " ass kicks " and toxicity.fold("7 11 $5") == " 7 11 $5 "
    assert toxicity.terms(" " + "z" * 5000 + " ") == {f" {'z' * n}" for n in toxicity.PREFIXES}


def test_learned_exceptions(spark):
    rng, rows, marks = random.Random(31), [], []
    for i in range(500):
        w = [rng.choice(VOCABULARY) for _ in range(30)]
        if i % 3 == 0:
            w[5:5] = ["zorkhead"]
        elif i % 3 == 1 and i % 10 == 0:
            w[5:5] = ["zorkhead", "lamp"]  # a clean use of the word
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(i % 3 == 0)))
    lex = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), exceptions=())
    plain, excused = (lex.features(f"one two {t} three")[1] for t in ("zorkhead", "zorkhead lamp"))
    assert plain > 0 and excused == 0 and "zorkhead lamp" in lex.exceptions


def test_folding_and_exceptions():
    lex = toxicity.Lexicon({" trash": 5.0, " moron ": 5.0})
    for text in ("you M0r0n!", "moron.", "MORON", "mоrоn", "trash-talk", "tr@sh"):
        assert lex.features(text)[1] > 0, text
    for text in ("", "oxymoron", "the trash can", "TRASH CAN is full", "$$$ moronic"):
        assert lex.features(text)[1] == 0, text
    assert lex.features("moron " * 3 + "x " * 300)[2] < lex.features("moron " * 3)[2]


def test_quality_votes_against_naive_cosines(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(VOCABULARY, rng.integers(1, 40))) for _ in range(60)] + ["", " "]
    bags = [quality.bag(t.encode()) for t in texts]
    space = quality.Neighbours(rng.random(quality.TERMS).astype(np.float32), rng.standard_normal((quality.TERMS, 6)).astype(np.float32), np.zeros((0, 6), np.float32), np.zeros(0), 0.5)
    vectors = space.project(bags[:40])
    space.vectors, space.labels = np.concatenate([vectors, vectors[:20]]), rng.integers(0, 2, 60).astype(float)  # twins: ties
    got = space.vote(bags, 7)
    for b, g in zip(bags, got, strict=True):
        x = space.project([b])[0]
        cos = [np.float32(v) for v in (x[None] @ space.vectors.T)[0]]
        near = sorted(range(60), key=lambda i: (-cos[i], i))[:7]
        w = [max(1e-3, min(1.0, float(cos[i]))) ** 8 for i in near]
        assert abs(g - sum(v * space.labels[i] for v, i in zip(w, near, strict=True)) / sum(w)) < 1e-3
    assert (quality.nearest(np.array([[1.0, 2.0, 2.0, 0.0, 2.0]]), 2)[0] == [1, 2]).all()


def test_quality(spark, none):
    rng, rows, marks = random.Random(4), [], []
    for i in range(400):
        w = [rng.choice(VOCABULARY) for _ in range(rng.randint(10, 60))]
        junk = i % 3 == 0
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w).capitalize() + "."))
        marks.append((i, int(not junk), 0))
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (None, "x")], "doc_id long, text string").withColumn("label", F.lit("clash"))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) > 0.95 * len(held)
    assert quality.quality_scores(none, labels).count() == 0
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_fingerprints(docs, none):
    got = merkle.fingerprints(docs).collect()
    assert len(got) == len(ROWS)
    spark = docs.sparkSession
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for t in {r[1] or "" for r in ROWS}], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1] or ""], (r[1] or "").encode()))
    want = Counter()
    for k, r in enumerate(order):
        t, nxt = r[1] or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        want[(r[0], len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest(), merkle.tree(t).root)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    roots = {}
    for r in ROWS:
        roots.setdefault(merkle.tree(r[1]).root, set()).add(r[1] or "")
    assert all(len(x) == 1 for x in roots.values())
    long = [r for r in got if r.n_chars > 300 and r.doc_id is not None and r.doc_id < 59]  # the others are near copies of the next
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.3
    assert merkle.fingerprints(none).count() == 0


def test_fingerprints_of_a_hot_id_and_of_rows_without_one(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SPLIT", 20)
    rows = [(i, f"text {i} " * 3) for i in range(40)] + [(7, f"seven {i}") for i in range(150)] + [(None, f"none {i}") for i in range(130)] + [(None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashes = {r.t: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).distinct().select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1] or ""]))
    want = Counter()
    for k, r in enumerate(order):
        t, nxt = r[1] or "", order[(k + 1) % len(order)][1] or ""
        want[(r[0], len(t), hashlib.sha256(merkle.edited_text(t, nxt).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in merkle.fingerprints(docs).collect()) == want
    groups = {r.grp: r.n for r in merkle.with_next(docs).filter("pos = 0").groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(groups.values()) < 60


def naive_likeness(a, b):
    """Brute force for texts whose paragraphs all differ: shared pieces by their bytes, twice over both sizes."""
    pieces = lambda t: Counter(p for line in t.encode().split(b"\n") for p in re.findall(rb"[^ ]* |[^ ]+$|^$", line))
    x, y = pieces(a), pieces(b)
    size = sum(len(p) * n for p, n in (x + y).items())
    return 2 * sum(len(p) * n for p, n in (x & y).items()) / size if size else 1.0


def test_likeness_against_brute_force():
    rng = random.Random(21)
    for _ in range(40):
        a = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 8))]
        b = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(1, 25))) if rng.random() < 0.3 else x for x in a]
        got = merkle.likeness(merkle.tree("\n".join(a)), merkle.tree("\n".join(b)))[0]
        whole = naive_likeness("\n".join(a), "\n".join(b))
        assert got <= whole + 1e-9  # equal branches match as wholes first, so a piece can find its like taken
        rest_a, rest_b = [x for x in a if x not in b], [x for x in b if x not in a]
        same = sum(len(x.encode()) for x in a if x in b) + sum(len(x.encode()) for x in b if x in a)
        total = sum(len(x.encode()) for x in a + b)
        left = sum(len(x.encode()) for x in rest_a + rest_b)
        assert math.isclose(got, (same + naive_likeness("\n".join(rest_a), "\n".join(rest_b)) * left) / total, abs_tol=1e-9) or len(set(a)) < len(a) or len(set(b)) < len(b)


def test_edits_are_located():
    a = [" ".join(words(40)) for _ in range(30)]
    b = [*a]
    b[17] = b[17].replace(" ", "  ", 1)
    near, mine, other = merkle.likeness(merkle.tree("\n".join(a)), merkle.tree("\n".join(b)))
    assert mine == other == [17] and 0.9 < near < 1
    near, mine, other = merkle.likeness(merkle.tree("\n".join(a)), merkle.tree("\n".join([*a[:5], "new one", *a[5:]])))
    assert mine == [] and other == [5]


def test_pieces_do_not_depend_on_the_length_of_their_paragraph():
    rng = random.Random(4)
    w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    long, short = " ".join(w) + " ", " ".join(w[:40]) + " "  # 480 and 240 bytes
    assert merkle.piece_ends(long.encode())[: len(merkle.piece_ends(short.encode()))] == merkle.piece_ends(short.encode())
    assert merkle.likeness(merkle.tree(long), merkle.tree(short))[0] == 2 / 3  # all of the short one, half of the long one


def test_token_histogram(docs, none):
    texts = [r[1] or "" for r in ROWS]
    encode = token_counts.encoder(f"{token_counts.TOKENIZERS}/{token_counts.VOCABULARY}").encode_ordinary
    n = sorted(len(encode(t)) for t in texts)
    got = token_counts.token_histogram(docs)
    for r in got.collect():
        assert r.n_docs == n.count(r.n_tokens) and r.docs_from == sum(x >= r.n_tokens for x in n)
        assert r.tokens_from == sum(x for x in n if x >= r.n_tokens) and r.tokens_cut == sum(min(x, r.n_tokens) for x in n)
        assert (r.docs_total, r.tokens_total) == (len(n), sum(n)) and math.isclose(r.share_up_to, sum(x <= r.n_tokens for x in n) / len(n), abs_tol=1e-8)
    assert got.count() == len(set(n))
    assert {r.q: r.n_tokens for r in token_counts.quantiles(got, [0.5, 1.0]).collect()} == {0.5: n[math.ceil(len(n) / 2) - 1], 1.0: n[-1]}
    assert token_counts.token_histogram(none).count() == 0
    assert Counter(r.n_tokens for r in token_counts.token_counts(docs).collect()) == Counter(n)


def cheapest(roles):
    best = math.inf
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        at, cost = 0, 0
        for r, to in zip(roles, labels, strict=True):
            cost += chat.step_cost(r, at, to)
            at = to
        best = min(best, cost + chat.INSERT * len(chat.ENDS[at]))
    return best


def test_chat_repair_is_cheapest():
    rng = random.Random(6)
    for _ in range(60):
        roles = [rng.randrange(4) for _ in range(rng.randint(1, 6))]
        cut_at = rng.randrange(len(roles) + 1)
        blocks = [b for b in (roles[:cut_at], roles[cut_at:]) if b]
        ends = chat.borders([chat.block_matrix(b) for b in blocks])
        labels = [x for b, (first, last) in zip(blocks, ends, strict=True) for x in chat.block_labels(b, first, last)]
        at, cost = 0, 0
        for r, to in zip(roles, labels, strict=True):
            cost += chat.step_cost(r, at, to)
            at = to
        assert cost + chat.INSERT * len(chat.ENDS[at]) == cheapest(roles), roles


def test_chat_rendering(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (2, 1, None, None), (None, None, "user", "<|im_end|>")]
    rows += [(3, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(700)]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, rendered string").repartition(3)
    got = defaultdict(list)
    for r in chat.repair(turns).collect():
        got[r.conv_id].append(r)
    whole = {k: "".join(r.rendered for r in sorted(v, key=lambda r: (r.turn is not None, r.turn or 0, r.order))) for k, v in got.items()}
    seg = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert whole[1] == seg("user", "a\n\nb") + seg("assistant", "c")
    assert whole[2] == seg("user", "x") + seg("assistant", "") and len(got[2]) == 2
    assert whole[None] == seg("user", "< |im_end|>") + seg("assistant", "")
    assert whole[3] == "".join(seg("user" if i % 2 == 0 else "assistant", str(i)) for i in range(700))
    for text in whole.values():
        roles = re.findall(r"<\|im_start\|>(\w+)\n", text)
        assert roles[-1] == "assistant" and all(a != b for a, b in itertools.pairwise(roles)) and "system" not in roles[1:]
    assert chat.repair(turns.limit(0)).count() == 0


def test_chat_with_many_rows_of_one_turn(spark):
    """A turn number, or none, that thousands of rows share is cut into blocks and still gives one cheapest repair."""
    rows = [(1, 7, "user" if i % 3 else "assistant", f"a{i}") for i in range(2500)] + [(1, None, "system", f"s{i}") for i in range(1500)] + [(1, 8, "user", "end"), (2, None, "user", "x")]
    got = defaultdict(list)
    for r in chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got[r.conv_id].append(r)
    assert len(got[1]) == 4001 and len(got[2]) == 1
    turns = sorted(got[1], key=lambda r: (r.turn is not None, r.turn or 0, r.order))
    at, cost = 0, 0
    for r in turns:
        to = chat.ROLES.index(r.new_role)
        cost += chat.step_cost(chat.role_code(r.role), at, to)
        at = to
    roles = [chat.role_code(r.role) for r in turns]
    ((first, last),) = chat.borders([chat.block_matrix(roles)])
    at, best = 0, 0
    for r, to in zip(roles, chat.block_labels(roles, first, last), strict=True):
        best += chat.step_cost(r, at, to)
        at = to
    assert cost == best
    text = "".join(r.rendered for r in turns)
    assert text.startswith("<|im_start|>system") and text.endswith("<|im_end|>\n") and text.count("<|im_start|>system") == 1


def test_remainder(spark):
    df = spark.createDataFrame([(i,) for i in range(30)] + [(None,)], "doc_id long")
    assert all(r.m == zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 for r in df.select("doc_id", remainder("doc_id").alias("m")).collect())


@pytest.mark.parametrize("name", ["labels"])
def test_labels_with_gaps(docs, labels, name):
    assert toxicity.toxicity_scores(docs, labels).count() == quality.quality_scores(docs, labels).count() == len(ROWS)


def test_near_dedup_of_repeated_ids_goes_by_the_text(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (2, a + " z"), (3, b + " z"), (5, a)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (3, 3), (5, 2), (5, 2), (5, 3)]


def test_meeting_rows_of_a_large_group_stay_few_and_lose_no_link(spark):
    """Near copies of all sizes: every linked pair of different labels meets, most other pairs don't."""
    rng = random.Random(3)
    base, sets = [f"w{i}" for i in range(150)], {}
    for i in range(120):
        w = list(base)[: rng.choice([150, 150, 140, 120])]
        for at in rng.sample(range(len(w)), rng.choice([0, 1, 2, 3, 5, 7])):
            w[at] = f"e{i}x{at}"
        sets[i] = shingles(" ".join(w))
    count = Counter(h for s in sets.values() for h in s)
    code = {h: k for k, h in enumerate(sorted(count))}
    rows = []
    for i, s in sets.items():
        order = sorted((count[h], code[h]) for h in s)
        rows.append((i, len(s), i, sum(c == 1 for c, _ in order), [h for c, h in order if c > 1]))
    met = near_dedup.prefixes(spark.createDataFrame(rows, "node long, n long, label long, lone int, order array<long>")).collect()
    probes, waits = defaultdict(list), defaultdict(list)
    for r in met:
        (probes if r.probe else waits)[r.h, r["class"]].append(r)
    pairs = {frozenset((x.node, y.node)) for k in probes for x in probes[k] for y in waits[k] if x.node != y.node and 175 * min(x.rest, y.rest) >= 75 * (x.n + y.n)}
    linked = {frozenset(p) for p in itertools.combinations(sets, 2) if 100 * len(sets[p[0]] & sets[p[1]]) >= 75 * len(sets[p[0]] | sets[p[1]])}
    assert linked <= pairs and len(linked) > 100
    assert len(pairs) < 0.7 * 120 * 119 / 2
