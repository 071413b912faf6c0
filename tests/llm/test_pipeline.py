"""The pipeline's stages on a small corpus with planted cases, against brute force."""

import random

import pytest

import corpus_pipeline
from sparkweft.llm import line_dedup

from .test_operators import VOCABULARY, brute_components, shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(n))
    common, item = text(20), text(30)
    rows, toxic = [], set()
    for i in range(300):
        t = text(rng.randint(30, 80))
        if i % 10 == 1:
            t += "\n" + common
        if i % 25 == 2:
            t += " " + item
        if i % 20 == 3:
            w = t.split()
            for at in (3, 9, 15):
                w.insert(at, rng.choice(["vilewort", "grubnik"]))
            t, toxic = " ".join(w), toxic | {i}
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    rows += [(300 + k, rows[5][1] if k % 2 else rows[5][1] + " tail", "en", "s1", 0) for k in range(10)]
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, rows, toxic, item


def test_stages(spark, folder, tmp_path):
    out, rows, toxic, item = folder
    docs, seen = spark.read.parquet(f"{out}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, out).write.parquet(f"{tmp_path}/{i}")
        columns, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{i}")
        after = [(r.doc_id, r.text) for r in docs.collect()]
        seen[name] = (before, after)
        assert docs.columns == columns + ["copy"] * (name == "mixing")
    ids = lambda x: {i for i, _ in x}
    assert ids(seen["toxicity"][0]) - ids(seen["toxicity"][1]) == toxic
    before, after = seen["line_dedup"]
    want = line_dedup.reference(before)
    assert len(after) == len(before) and sum(n for _, n, _ in want.values()) > 5
    assert {i: t.count("\n") + 1 for i, t in after} == {i: max(1, n - d) for i, (n, d, _) in want.items()}
    before, after = seen["near_dedup"]
    assert ids(after) == {root for _, root in brute_components(before).values()} and len(after) < len(before)
    before, after = seen["decontamination"]
    q = shingles(item)
    assert ids(after) == {i for i, t in before if len(q & shingles(t)) < 0.75 * len(q)} and len(after) < len(before)
    before, after = seen["mixing"]
    assert ids(after) <= ids(before) and abs(sum(len(t.split()) for _, t in after) / sum(len(t.split()) for _, t in before) - 1.5) < 0.1
    assert sorted(map(str, after)) == sorted(str((r.doc_id, r.text)) for r in corpus_pipeline.run(spark, out).collect())


def test_stages_on_messy_rows(spark, folder, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ids, clashing names: each stage's defined result."""
    out, rows, _, item = folder
    schema = "doc_id long, text string, lang string, source string, n_chars long, copy string, score double, row string, __kept boolean"
    long_word, long_text = "x" * 1_200_000, " ".join(f"w{i % 977}q{i % 31}" for i in range(30_000))
    messy = [  # ids without labels
        (1001, rows[7][1]), (1001, rows[7][1]), (1001, rows[8][1]), (None, rows[9][1]), (None, None), (1002, None), (1003, ""), (1004, " \n "), (1005, long_word), (1006, long_text), (1006, long_text), (1007, rows[7][1]),
        (1008, f"{rows[10][1]} {item}"), (None, f"{rows[11][1]} {item}"), (1009, "vilewort grubnik"), (None, "grubnik vilewort grubnik"),
    ]
    docs = spark.createDataFrame([(i, t, None, None if k % 3 else "s", None, "clash", None, None, None) for k, (i, t) in enumerate(messy)], schema)
    learned = spark.createDataFrame([(i, t, None, None, None, "clash", None, None, None) for i, t, *_ in rows if i not in dict(messy)], schema)
    key = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    every = key(docs)
    left = {name: stage(spark, docs, out) for name, stage in corpus_pipeline.STAGES}
    for name, df in left.items():
        assert df.columns == (docs.columns if name != "mixing" else [c for c in docs.columns if c != "copy"] + ["copy"])
    toxic = {("1009", "vilewort grubnik"), ("None", "grubnik vilewort grubnik")}
    with_labels = corpus_pipeline.reject_toxic(spark, docs.unionByName(learned), out).filter("doc_id IS NULL OR doc_id >= 1000")
    assert key(with_labels) == [x for x in every if x not in toxic]
    assert key(left["toxicity"]) == every  # none of these rows has a label: nothing is learned, nothing goes
    assert key(left["line_dedup"]) == every
    gone = [x for x in every if x[0] == "1007" and x[1] == rows[7][1]]
    assert key(left["near_dedup"]) == [x for x in every if x not in gone]
    assert key(left["decontamination"]) == [x for x in every if item not in x[1]]
    sizes = {(str(i), t or ""): len((t or "").split()) for i, t in messy}
    mixed = left["mixing"].collect()
    assert all(r.copy >= 1 for r in mixed) and sum(sizes[str(r.doc_id), r.text or ""] for r in mixed) > sum(len((t or "").split()) for _, t in messy)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), out).count() == 0, name
