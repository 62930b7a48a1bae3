"""The pipeline against a plain version of each stage, one after another."""

import hashlib
from zlib import crc32

import corpus_pipeline
from test_similar import kept
from brindle.llm import language, mixing, pieces, secrets, simhash
from brindle.llm.queries import tokenizer
from pyspark.sql import functions as F


def folder(spark, path, extra):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return f"{path}"


def identified(rows):
    by = {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and crc32(str(r["doc_id"]).encode()) % 4 != 2:
            by.setdefault(r["lang"], []).append(r["text"].encode())
    model = language.Model.of_texts(by)
    return [r for r, x in zip(rows, model.predict([r["text"] for r in rows]), strict=True) if x[0] != "und" and (x[2] < language.JUNK_BITS or len(r["text"].encode()) < language.JUNK_BYTES)]


def test_pipeline(spark, tmp_path):
    secret = "password = hunter2hunter2 and a long enough tail of words to stand alone"
    extra = [(90001, None, None, "s", 0), (90002, "", "en", "s", 0), (90003, "12 34", "en", "s", 5), (90004, secret, None, "s", None), (90005, secret, None, "s", None), (90006, "qzxjw" * 40, None, "s", None)]
    sf = folder(spark, tmp_path, extra)
    rows = identified([r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert not {90001, 90002, 90003, 90006} & {r["doc_id"] for r in rows}
    stay = {i for i, _ in kept([(r["doc_id"], r["text"]) for r in rows])}
    rows = [r for r in rows if r["doc_id"] in stay]
    rows = [r | {"text": secrets.redacted(r["text"])} for r in rows]
    assert [r["text"][:12] for r in rows if r["doc_id"] in (90004, 90005)] == ["[SECRET] and"]
    frame = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    rates = mixing.mixed_rates(frame, spark.read.parquet(f"{sf}/labels.parquet"))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    drawn = {r.doc_id: r.draw for r in frame.select("doc_id", draw.alias("draw")).collect()}
    copies = {r.doc_id: int(r.rate + drawn[r.doc_id]) for r in rates.collect()}
    fst = pieces.transducer(tokenizer("piece_bpe_32k.model"))
    want = []
    for r in rows:
        ids = fst.encode(r["text"])
        want += [(r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), ids)] * copies[r["doc_id"]]
    got = corpus_pipeline.run(spark, sf).select("doc_id", "n_pieces", "ids_sha256", "ids").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_rows_without_an_id_stay_once(spark):
    frame = spark.createDataFrame([(None, "one text of words"), (None, "one text of words"), (None, "some other words here"), (1, "last words")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.keep_one(frame).collect()) == ["last words", "one text of words", "some other words here"]


def test_one_id_of_two_texts_keeps_both(spark):
    rows = [(1, "one text of words and more of them here"), (1, "something wholly different stands in this one"), (1, "one text of words and more of them here")]
    frame = spark.createDataFrame([(i, t, "k", "r") for i, t in rows], "doc_id long, text string, key string, root string")
    assert sorted(r.text for r in simhash.keep_one(frame).collect()) == sorted({t for _, t in rows})
    assert simhash.keep_one(frame).columns == frame.columns


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
