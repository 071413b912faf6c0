"""LM scoring by Brown class bigrams.

All counts cover all training text. Classes come by exchange clustering, frequent words
first. The WORD_TYPES most frequent words are types of their own and every other word
belongs to the type of its ending (its last SUFFIX bytes, the most frequent endings; the
rest share one). Types move between classes while the likelihood of the class bigrams
grows, on the table of type bigrams, 2048 x 2048 counts however large the corpus, until
no type moves. Then a distributed round exchanges the other words: every word of the
vocabulary (at least MIN_COUNT times in the training text) leaves its ending's class for
the one where the likelihood grows most, by the classes that stand before and after it in
all training text, against the fixed class bigrams. Words that are rarer still stay with
their ending, which was exchanged with all of their counts. A word's probability is

    P(class | class before) * P(type | class) * P(word | type)

with the transition smoothed towards the class's share, the emission by add-0.5 (a word
of the vocabulary is a type alone), and within an ending's type (c + 0.5) / (N + 0.5 *
(V + 1)) over its N tokens of V words outside the vocabulary, which leaves one share for
unseen words. The HEAD most frequent words' counts and classes are broadcast (bounded);
a document's other words get their counts by a join on the word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, parts, remainder, slices, texts

#: Types that are words, types that are endings (with the shared one), classes, bytes of an ending.
WORD_TYPES, ENDINGS, CLASSES, SUFFIX = 1024, 1023, 96, 3
#: Words that are broadcast (a longer one, in bytes, is never among them); how often a word with a class of its own must stand.
HEAD, HEAD_BYTES, MIN_COUNT = 1 << 18, 64, 5
ALPHA = 5.0
#: A move must help by more than this (natural log), so that rounding errors move nothing.
LEAST_GAIN = 1e-6
END = b"\n"
#: Entries of a task's own counter before it is passed on; tokens before their pairs are counted.
FLUSH, FLUSH_TOKENS = 400_000, 2_000_000


def document_tokens(batch: pa.RecordBatch) -> tuple[list[bytes], list[int]]:
    """The tokens of a slice's documents one after another, each with its END, and where each document starts."""
    tokens, starts = [], []
    for text in texts(batch):
        starts.append(len(tokens))
        tokens += text.lower().split()
        tokens.append(END)
    return tokens, starts


def word_counts(train: DataFrame) -> DataFrame:
    """(word binary, n): counts of all tokens, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        out = lambda: pa.RecordBatch.from_pydict({"word": pa.array(list(c), pa.binary()), "n": pa.array(list(c.values()), pa.int64())})
        for batch in batches:
            for part in slices(batch):
                c.update(document_tokens(part)[0])
                if len(c) > FLUSH:
                    yield out()
                    c.clear()
        if c:
            yield out()

    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Words, endings, classes and log10 probabilities; see the module's text."""

    total: int
    distinct: int
    #: the most frequent words by frequency, END being 0, and their counts; the first ``own`` have classes of their own
    head: dict[bytes, int]
    count: np.ndarray
    own: int
    #: endings from 1 (0: the shared one); tokens and words outside the vocabulary of each
    endings: dict[bytes, int]
    rest_n: np.ndarray
    rest_v: np.ndarray
    word_class: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ending_class: np.ndarray = field(default_factory=lambda: np.zeros(ENDINGS, np.int64))
    step: np.ndarray = field(default_factory=lambda: np.zeros((1, 1)))
    word_emit: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ending_emit: np.ndarray = field(default_factory=lambda: np.zeros(ENDINGS))
    word_types: int = WORD_TYPES
    n_classes: int = CLASSES

    @property
    def n_types(self) -> int:
        return 1 + self.word_types + ENDINGS

    def encode(self, tokens: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words, each token's position among them, each distinct word's number in ``head`` (or -1) and ending."""
        e = pa.array(tokens, pa.binary()).dictionary_encode()
        words = e.dictionary.to_pylist()
        number = np.fromiter((self.head.get(w, -1) for w in words), np.int64, len(words))
        ending = np.fromiter((self.endings.get(w[-SUFFIX:], 0) for w in words), np.int64, len(words))
        return words, e.indices.to_numpy(), number, ending

    def types(self, number: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """Types of the first clustering: END and the most frequent words, then the endings."""
        return np.where((number >= 0) & (number <= self.word_types), number, 1 + self.word_types + ending)

    def classes(self, number: np.ndarray, ending: np.ndarray) -> np.ndarray:
        word = (number >= 0) & (number < self.own)
        return np.where(word, self.word_class[np.where(word, number, 0)], self.ending_class[ending])


def least_count(counts: DataFrame, most: int, top: int = 1 << 20) -> int:
    """The smallest count that at most ``most`` words reach; counts above ``top`` are one level."""
    levels = counts.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count(F.lit(1)).alias("v")).toArrow().to_pylist()
    total, least = 0, top + 1
    for level in sorted(levels, key=lambda x: -x["n"]):
        total += level["v"]
        if total > most:
            break
        least = level["n"]
    return least


def read_words(counts: DataFrame, word_types: int = WORD_TYPES, classes: int = CLASSES) -> Model:
    """Choose the words and endings by frequency (ties by bytes)."""
    one = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    is_end = F.col("word") == F.lit(END).cast("binary")
    short = counts.filter((F.length("word") <= HEAD_BYTES) & ~is_end)
    end = counts.filter(is_end).first()
    rows = sorted(((-r["n"], r["word"]) for r in short.filter(F.col("n") >= least_count(short, HEAD)).select("word", "n").toArrow().to_pylist()))
    head = {END: 0} | {w: 1 + i for i, (_, w) in enumerate(rows)}
    count = np.array([end["n"] if end else 0, *(-n for n, _ in rows)], np.int64)
    own = max(1 + int((count[1:] >= MIN_COUNT).sum()), min(len(count), 1 + word_types))

    def among(k: int):  # the first k words of the order: no table of them is needed
        if not k:
            return F.lit(False)
        n, word = -rows[k - 1][0], F.lit(bytearray(rows[k - 1][1]))
        return (F.length("word") <= HEAD_BYTES) & ((F.col("n") > n) | ((F.col("n") == n) & (F.col("word") <= word)))

    rare = ~among(own - 1)
    others = counts.filter(~is_end & ~among(min(len(rows), word_types)))
    by = others.groupBy(F.substring("word", -SUFFIX, SUFFIX).alias("ending")).agg(F.sum("n").alias("n"), F.sum(F.when(rare, F.col("n")).otherwise(0)).alias("rest_n"), F.count_if(rare).alias("rest_v"))
    by = cut(by)
    all_ = by.agg(F.sum("rest_n").alias("n"), F.sum("rest_v").alias("v")).first()
    endings, rest_n, rest_v = {}, np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in by.orderBy(F.desc("n"), "ending").limit(ENDINGS - 1).collect():
        k = endings[bytes(r["ending"])] = 1 + len(endings)
        rest_n[k], rest_v[k] = r["rest_n"], r["rest_v"]
    rest_n[0], rest_v[0] = (all_["n"] or 0) - rest_n.sum(), (all_["v"] or 0) - rest_v.sum()
    return Model(one["n"] or 0, one["v"] or 0, head, count, own, endings, rest_n, rest_v, word_types=word_types, n_classes=classes)


def pair_counts(train: DataFrame, model: Model, names: str, size: int) -> DataFrame:
    """(pair, n): counts of bigrams of types or classes, pair = before * size + after; a document starts after an END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, dense = [], 0, np.zeros(size * size, np.int64)
        for batch in batches:
            for part in slices(batch):
                _, idx, number, ending = model.encode(document_tokens(part)[0])
                t = getattr(model, names)(number, ending)[idx]
                held.append(np.concatenate([[getattr(model, names)(np.zeros(1, np.int64), np.zeros(1, np.int64))[0]], t[:-1]]) * size + t)
                n += len(t)
                if n > FLUSH_TOKENS:
                    dense += np.bincount(np.concatenate(held), minlength=size * size)
                    held, n = [], 0
        if held:
            dense += np.bincount(np.concatenate(held), minlength=size * size)
        pair = np.flatnonzero(dense)
        for i in range(0, len(pair), 200_000):
            yield pa.RecordBatch.from_pydict({"pair": pa.array(pair[i : i + 200_000], pa.int64()), "n": pa.array(dense[pair[i : i + 200_000]])})

    return train.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def square(counts: DataFrame, size: int) -> np.ndarray:
    """The table of at most size * size counts as a matrix."""
    table, out = counts.toArrow(), np.zeros(size * size)
    out[table["pair"].to_numpy()] = table["n"].to_numpy()
    return out.reshape(size, size)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(g: np.ndarray, after: np.ndarray, before: np.ndarray, self_n: float) -> np.ndarray:
    """How much the likelihood grows if a type joins each class of ``g``, which doesn't hold it now.

    ``after`` and ``before``: how often each class follows and precedes the type;
    ``self_n``: how often it follows itself (in neither). The likelihood of class
    bigrams is, up to a constant, the sum of n log n over class pairs less that over
    classes, once as first and once as second. ``g`` lacks the type, but wherever it
    goes, the classes before and after it have their bigrams with it.
    """
    out, into, d = g.sum(1) + before, g.sum(0) + after, g.diagonal()
    k, m = np.flatnonzero(after), np.flatnonzero(before)
    gain = (xlogx(g[:, k] + after[k]) - xlogx(g[:, k])).sum(1) + (xlogx(g[m] + before[m, None]) - xlogx(g[m])).sum(0)
    gain += xlogx(d + after + before + self_n) - xlogx(d + after) - xlogx(d + before) + xlogx(d)
    ro, ci = after.sum() + self_n, before.sum() + self_n
    gain -= xlogx(out + ro) - xlogx(out) + xlogx(into + ci) - xlogx(into)
    gain[0] = -np.inf  # END's own
    return gain


def best_class(g: np.ndarray, after: np.ndarray, before: np.ndarray, self_n: float, a: int) -> int:
    """The class with the largest gain; ``a``, the type's class now, unless another helps more; ties: the smaller number."""
    gain = gains(g, after, before, self_n)
    b = int(np.argmax(gain))
    return b if gain[b] > gain[a] + LEAST_GAIN else a


def likelihood(g: np.ndarray) -> float:
    """Log-likelihood of class bigrams, up to a constant."""
    return xlogx(g).sum() - xlogx(g.sum(1)).sum() - xlogx(g.sum(0)).sum()


def exchange(pairs: np.ndarray, classes: int = CLASSES, passes: int | None = None) -> np.ndarray:
    """Exchange clustering of types by their bigram counts: each type in turn goes where the likelihood grows most.

    Ends where a pass moves no type, or where its moves no longer raise the likelihood in
    double precision (rounding errors alone made them, as can be with very large counts).
    As every other pass raises it, no state comes again. END, type 0, keeps a class of its own.
    """
    n = pairs.sum(0) + pairs.sum(1)
    order = np.lexsort((np.arange(len(n)), -n))
    order = order[(order != 0) & (n[order] > 0)]
    of = np.zeros(len(n), np.int64)
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    of[(n == 0) & (np.arange(len(n)) > 0)] = 1
    member = np.zeros((len(n), classes))
    member[np.arange(len(n)), of] = 1
    rows, cols = pairs @ member, member.T @ pairs  # type -> class, class -> type
    g = member.T @ rows
    done, best = 0, -np.inf
    while passes is None or done < passes:
        done, moved = done + 1, 0
        for w in order:
            a, self_n = of[w], pairs[w, w]
            r, c = rows[w].copy(), cols[:, w].copy()
            r[a] -= self_n
            c[a] -= self_n
            g[a] -= r
            g[:, a] -= c
            g[a, a] -= self_n
            b = best_class(g, r, c, self_n, a)
            g[b] += r
            g[:, b] += c
            g[b, b] += self_n
            if a != b:
                moved += 1
                of[w] = b
                rows[:, a] -= pairs[:, w]
                rows[:, b] += pairs[:, w]
                cols[a] -= pairs[w]
                cols[b] += pairs[w]
        reached = likelihood(g)
        if not moved or reached <= best:
            break
        best = reached
    return of


def contexts(train: DataFrame, model: Model) -> DataFrame:
    """(word, at, n): for words with a class of their own but no type, how often each class precedes (at < classes)
    and follows them, and how often they follow themselves (at = 2 * classes); several rows for each word."""
    width = 2 * model.n_classes + 1

    def rows(codes: list[np.ndarray]) -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(codes), return_counts=True)
        word, at = code // width, (code % width).astype(np.int16)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
        ends = pa.array(np.r_[first, len(word)].astype(np.int32))
        return pa.RecordBatch.from_pydict({"word": pa.array(word[first]), "at": pa.ListArray.from_arrays(ends, pa.array(at)), "n": pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch):
                _, idx, number, ending = model.encode(document_tokens(part)[0])
                word, cls = number[idx], model.classes(number, ending)[idx]
                prev, follow = np.r_[0, word[:-1]], np.r_[word[1:], 0]  # a slice ends with an END, which has no class to learn
                some = np.flatnonzero((word > model.word_types) & (word < model.own))
                c0 = model.word_class[0]
                before = np.where(prev == word, width - 1, np.r_[c0, cls[:-1]])[some]
                after = (model.n_classes + np.r_[cls[1:], c0])[some]
                held += [word[some] * width + before, (word[some] * width + after)[follow[some] != word[some]]]
                size += 2 * len(some)
                if size > FLUSH_TOKENS:
                    yield rows(held)
                    held, size = [], 0
        if size:
            yield rows(held)

    return train.select("text").mapInArrow(run, "word long, at array<short>, n array<int>")


def exchanged(found: DataFrame, model: Model, g: np.ndarray) -> DataFrame:
    """(word, class): one exchange of every word of :func:`contexts` against the fixed class bigrams ``g``, in tasks."""
    width = 2 * model.n_classes + 1
    names, classes = list(model.head), model.n_classes
    now = model.classes(np.arange(len(names)), np.fromiter((model.endings.get(w[-SUFFIX:], 0) for w in names), np.int64, len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n = [], []
        for batch in batches:
            at, word = column(batch, "at"), column(batch, "word").to_numpy()
            code.append(np.repeat(word, np.diff(at.offsets.to_numpy())) * width + at.flatten().to_numpy())
            n.append(column(batch, "n").flatten().to_numpy())
        if not code:
            return
        words, row = np.unique(np.concatenate(code) // width, return_inverse=True)
        dense = np.bincount(row * width + np.concatenate(code) % width, np.concatenate(n), len(words) * width).reshape(-1, width)
        out, table = np.zeros(len(words), np.int32), g.copy()
        for i, w in enumerate(words):
            before, after, self_n, a = dense[i, :classes], dense[i, classes:-1], dense[i, -1], now[w]
            table[a] -= after
            table[:, a] -= before
            table[a, a] -= self_n
            out[i] = best_class(np.maximum(table, 0), after, before, self_n, a)
            table[a], table[:, a] = g[a], g[:, a]
        yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.int64()), "class": pa.array(out)})

    return found.repartition(parts(found), "word").mapInArrow(run, "word long, class int")


def fit(docs: DataFrame, word_types: int = WORD_TYPES, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """Count all training documents (crc32 of the id modulo 5 not 1) and build the model; also returns the word counts."""
    train = docs.filter(remainder("doc_id") != 1)
    counts = cut(word_counts(train))
    model = read_words(counts, word_types, classes)
    pairs = square(pair_counts(train, model, "types", model.n_types), model.n_types)
    of = exchange(pairs, classes)
    member = np.zeros((model.n_types, classes))
    member[np.arange(model.n_types), of] = 1
    model.ending_class = of[1 + word_types :].astype(np.int64)
    names = list(model.head)[: model.own]
    model.word_class = model.ending_class[np.fromiter((model.endings.get(w[-SUFFIX:], 0) for w in names), np.int64, len(names))]
    typed = min(model.own, 1 + word_types)
    model.word_class[:typed] = of[:typed]
    if model.own > typed:
        moved = exchanged(contexts(train, model), model, member.T @ pairs @ member).toArrow()  # at most HEAD rows of 12 bytes
        model.word_class[moved["word"].to_numpy()] = moved["class"].to_numpy()
    g = square(pair_counts(train, model, "classes", classes), classes)
    n, size = np.zeros(classes), np.zeros(classes)
    np.add.at(n, model.word_class, model.count[: model.own])
    np.add.at(n, model.ending_class, model.rest_n)
    np.add.at(size, model.word_class, 1)
    np.add.at(size, model.ending_class, 1)
    share = (n + 0.5) / (n.sum() + 0.5 * classes)
    model.step = np.log10((g + ALPHA * share) / (g.sum(1, keepdims=True) + ALPHA))
    norm = n + 0.5 * size
    model.word_emit = np.log10((model.count[: model.own] + 0.5) / norm[model.word_class])
    # an ending's share, and what its words' own shares are divided by
    model.ending_emit = np.log10((model.rest_n + 0.5) / norm[model.ending_class]) - np.log10(model.rest_n + 0.5 * (model.rest_v + 1))
    return model, counts


def lm_scores(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Score every document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text has one token, its end. Rows that repeat a doc_id are scored
    by their own text; repeated rows and rows without doc_id are scored like any
    other. Without training text nothing is known. A very long text is one row of its
    task, its words beyond the broadcast ones one row each. An empty table gives an
    empty result. Other columns are left out, whatever their names. Sums go by shuffle
    order and are rounded to nine digits, so that reruns agree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                tokens, starts = document_tokens(part)
                words, idx, number, ending = model.encode(tokens)
                tail = number < 0
                c = np.where(tail, 0, model.count[np.maximum(number, 0)])
                log_c = np.where(tail, 0.0, np.log10(c + 0.5))
                word = ~tail & (number < model.own)
                emit = np.where(word, model.word_emit[np.where(word, number, 0)], model.ending_emit[ending] + log_c)
                cls = model.classes(number, ending)[idx]
                before = np.concatenate([[model.word_class[0]], cls[:-1]])
                score = np.add.reduceat(model.step[before, cls] + emit[idx], starts)
                base = np.add.reduceat(log_c[idx], starts)
                known = np.add.reduceat((c > 0)[idx].astype(np.int64), starts)
                n = np.diff([*starts, len(tokens)])
                ids = column(part, "doc_id")
                uid = pa.array([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in texts(part)], pa.int64())
                main = pa.RecordBatch.from_pydict({"doc_id": ids, "uid": uid, "word": pa.nulls(len(ids), pa.binary()), "tf": pa.array(n, pa.int64()), "known": pa.array(known, pa.int64()), "base": pa.array(base), "score": pa.array(score)})
                yield main
                at = np.flatnonzero(tail[idx])
                if len(at):
                    doc = np.searchsorted(starts, at, "right") - 1
                    code, tf = np.unique(doc.astype(np.int64) * len(words) + idx[at], return_counts=True)
                    doc, k = pa.array(code // len(words)), code % len(words)
                    zero = np.zeros(len(code))
                    yield pa.RecordBatch.from_pydict({"doc_id": ids.take(doc), "uid": uid.take(doc), "word": pa.array(words, pa.binary()).take(pa.array(k)), "tf": pa.array(tf, pa.int64()), "known": pa.array(zero.astype(np.int64)), "base": pa.array(zero), "score": pa.array(zero)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, uid long, word binary, tf long, known long, base double, score double")
    # rows of a document itself have no word and meet no count; hashing them by document keeps them apart
    key = F.coalesce(F.col("word"), F.concat(F.lit(END.decode()), F.col("uid").cast("string")).cast("binary"))
    named = counts.filter(F.col("word") != F.lit(END).cast("binary")).select(F.col("word").alias("key"), F.col("n").alias("c"))
    joined = rows.withColumn("key", key).join(named.hint("shuffle_hash"), "key", "left")
    own = F.col("word").isNull()
    c = F.coalesce(F.col("c"), F.lit(0))
    log_c = F.when(own, F.lit(0.0)).otherwise(F.col("tf") * F.log10(c + F.lit(0.5)))
    sums = joined.groupBy("doc_id", "uid").agg(
        F.count_if(own).alias("m"),
        F.sum(F.when(own, F.col("tf")).otherwise(F.lit(0))).alias("n_tokens"),
        F.sum(F.when(own, F.col("known")).when(c > 0, F.col("tf")).otherwise(F.lit(0))).alias("n_known"),
        F.sum(F.col("base") + log_c).alias("base"),
        F.sum(F.col("score") + log_c).alias("score"),
    )
    m = F.col("m")  # equal rows were summed together
    norm = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    tokens = (F.col("n_tokens") / m).cast("long")
    return sums.select(
        "doc_id", tokens.alias("n_tokens"), (F.col("n_known") / m).cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        F.round(F.col("base") / m - tokens * F.lit(norm), 9).alias("base_score"), F.round(F.col("score") / m, 9).alias("score"),
        F.explode(F.sequence(F.lit(1), m.cast("int"))).alias("copy"),
    ).drop("copy")


def lm_query(docs: DataFrame) -> DataFrame:
    """Fit and score: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    model, counts = fit(docs)
    scored = lm_scores(docs, model, counts)
    return scored.select("doc_id", (remainder("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
