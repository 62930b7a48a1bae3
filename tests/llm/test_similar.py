"""The pipeline's near-dedup stage against brute-force Jaccard."""

import random
import time

import corpus_pipeline
import numpy as np
from brindle.llm import similar, simhash
from pyspark.sql import functions as F


def kept(rows):
    """Of each group tied by pairs of similarity 0.8 or more, the least row."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if 5 * len(x & y) >= 4 * len(x | y):
                root[top(a)] = top(b)
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(top(k), []).append(row)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_stage_keeps_one_of_what_is_similar(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, _ in kept([(r.doc_id, r.text) for r in docs.collect()]))


def test_edited_copies_and_odd_ids(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    texts = [rng.choices(words, k=rng.randint(1, 120)) for _ in range(25)]
    line = [f"l{k}" for k in range(12)]
    for _ in range(120):
        t = list(rng.choice(texts[:25])) + (line if rng.random() < 0.3 else [])
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(t)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(900, None), (901, ""), (902, " \n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == sorted(i for i, _ in kept(rows))
    # one id with two texts keeps both; rows without ids are told by text, near copies of others too
    odd = [(1, "a b c d e f g"), (1, "other words stand here alone now"), (1, "a b c d e f g"), (None, "A b c d e f g"), (None, "no id and no copy of it"), (None, "no id and no copy of it")]
    frame = spark.createDataFrame(odd, "doc_id long, text string")
    assert sorted(r.text for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == ["a b c d e f g", "no id and no copy of it", "other words stand here alone now"]
    assert corpus_pipeline.near_dedup(spark, frame.where("false"), "").count() == 0


def edited(rng, base, n, most):
    """Copies of base, each with up to `most` words replaced by new ones."""
    out = []
    for k in range(n):
        t = list(base)
        for i in rng.sample(range(len(t)), rng.randint(0, most)):
            t[i] = f"n{k}x{i}"
        out.append(" ".join(t))
    return out


def test_stage_tells_sets_by_simhash(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(300)}" for _ in range(200)]
    texts = edited(rng, base, 60, 3) + [" ".join(f"w{rng.randrange(300)}" for _ in range(60)) for _ in range(20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.unhex(F.md5("text")))
    rows = similar.leads(frame).collect()
    assert [r.fp % (1 << 64) for r in sorted(rows, key=lambda r: r.doc_id)] == [simhash.majority(similar.shingles(t).view(np.uint64)) for t in texts]
    of = {r.name: r.fp % (1 << 64) for r in rows}
    head = {}
    for name in sorted(of, reverse=True):
        head[of[name]] = name
    want = {(head[of[x]], x) for x in of if x != head[of[x]]}
    want |= {tuple(sorted((head[f], head[g]))) for f in head for g in head if f < g and (f ^ g).bit_count() <= 3}
    groups = spark.createDataFrame([(r.name, r.fp) for r in rows], "name long, fp long")
    assert {tuple(r) for r in similar.near_fingerprints(groups).collect()} == want and want
    # and the stage goes by them
    seen, plain = [], similar.near_fingerprints
    monkeypatch.setattr(similar, "near_fingerprints", lambda g: seen.append(1) or plain(g))
    corpus_pipeline.near_dedup(spark, frame.drop("key"), "")
    assert seen == [1]


def test_few_pairs_of_a_group_of_edited_copies(spark):
    rng = random.Random(6)
    texts = edited(rng, [f"w{k}" for k in range(150)], 150, 16)
    sets = [similar.shingles(t) for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.unhex(F.md5("text")))
    groups = similar.leads(frame)
    tied = groups.select("name", "n", F.posexplode("first").alias("at", "x"), F.col("name").alias("root"))
    n = {r.name: r.n for r in groups.select("name", "n").collect()}
    got = {(r.a, r.b) for r in similar.untied(tied, groups).collect()}
    name = {r.doc_id: r.name for r in groups.select("doc_id", "name").collect()}
    shared = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in name for b in name if name[a] < name[b]}
    alike = {(name[a], name[b]) for (a, b), s in shared.items() if 9 * s >= 4 * (n[name[a]] + n[name[b]])}
    far = {(name[a], name[b]) for (a, b), s in shared.items() if 10 * s < 4 * (n[name[a]] + n[name[b]])}
    assert alike and alike <= got
    # before parities, all that shared a first shingle at a fit place were compared
    assert len(far) > 1000 and len(far & got) * 20 < len(far)


def test_large_groups_are_tied_by_drawn_pairs(spark, monkeypatch):
    """Of a group of near copies few pairs are left to be looked at, not a share of all pairs."""
    rng = random.Random(7)
    texts = edited(rng, [f"w{k}" for k in range(150)], 300, 6)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    left, plain = [], similar.untied

    def untied(tied, groups):
        out = plain(tied, groups)
        left.append(out.count())
        return out

    monkeypatch.setattr(similar, "untied", untied)
    got = sorted(r.doc_id for r in similar.keep_one(frame).collect())
    assert got == sorted(i for i, _ in kept(list(enumerate(texts))))
    # pairs count once for each first shingle in common; 61,431 when all met only the least of each shingle
    assert len(left) == 1 and left[0] < 20 * len(texts)


def test_all_is_found_without_turns(spark, monkeypatch):
    monkeypatch.setattr(similar, "TURNS", 1)
    monkeypatch.setattr(similar, "drawn", lambda tied, turn: tied.select(F.col("name").alias("a"), F.col("name").alias("b")).where("false"))
    monkeypatch.setattr(similar, "near_fingerprints", lambda groups: similar.written(groups.select(F.col("name").alias("a"), F.col("name").alias("b")).where("false")))
    rng = random.Random(8)
    texts = edited(rng, [f"w{k}" for k in range(150)], 40, 8) + edited(rng, [f"v{k}" for k in range(60)], 20, 3)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.keep_one(frame).collect()) == sorted(i for i, _ in kept(list(enumerate(texts))))


def test_disk_of_comparing_grows_with_the_sets(spark, monkeypatch):
    """Shuffle files of a step are gone before the next one, texts are dealt once, and no join takes more pairs than there are sets."""
    rng = random.Random(9)
    texts = edited(rng, [f"w{k}" for k in range(90)], 40, 4)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = frame.withColumn("key", F.unhex(F.md5("text")))
    groups = similar.written(similar.leads(rows).select("name", "n", F.struct("key").alias("least")))
    names = sorted(r.name for r in groups.select("name").collect())
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a < b], "a long, b long")

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName().split("_")[1] for f in (files.apply(k) for k in range(files.size())) if f.getName().startswith("shuffle_")}

    similar.sweep(spark)
    seen, made, plain = [], set(), similar.written

    def written(df, name="table"):
        until = time.time() + 5
        while made & shuffles() and time.time() < until:
            time.sleep(0.1)
        seen.append((name, made & shuffles(), df._jdf.queryExecution().executedPlan().toString()))
        out = plain(df, name)
        if name != "pairs":
            made.update(shuffles() - before)
        return out

    time.sleep(1)
    before = shuffles()
    monkeypatch.setattr(similar, "written", written)
    got = {tuple(r) for r in similar.verified(pairs, groups, rows).collect()}
    of = {r.name: set(similar.shingles(texts[r.doc_id]).tolist()) for r in similar.leads(rows).select("name", "doc_id").collect()}
    assert got == {(a, b) for a in names for b in names if a < b and 5 * len(of[a] & of[b]) >= 4 * len(of[a] | of[b])} and got
    (sets,) = (x for x in seen if x[0] == "sets")
    assert not [x for x in sets[2].split("MapInArrow")[0].splitlines() if "Exchange" in x]
    parts = [x for x in seen if x[0] == "similar"]
    assert made and not any(x[1] for x in parts)
    assert (len(parts) - 1) * len(names) >= pairs.count()
