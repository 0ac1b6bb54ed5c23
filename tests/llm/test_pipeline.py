"""The corpus pipeline over planted documents, and what is registered."""

import random

import corpus_pipeline
from stratalog.llm import registry

from .test_operators import plain_components, plain_fingerprint, words_of

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(20)
    texts, toxic = [], {}
    for i in range(400):
        w = words_of(rnd, rnd.randrange(30, 120), 3000).split()
        toxic[i] = int(i % 5 == 0)
        if toxic[i]:
            w.insert(3, "dolt")
        texts.append(" ".join(w))
    passage = " ".join(f"p{k}" for k in range(40))
    planted = {"copy": texts[1], "toxic": "you dolt " + words_of(rnd, 50, 3000), "leak": words_of(rnd, 20, 3000) + " " + passage + " end", "secret": words_of(rnd, 20, 3000) + ' token = "abcdef0123456789"', "clean": words_of(rnd, 60, 3000)}
    names = {n: 400 + k for k, n in enumerate(planted)}
    return [*texts, *planted.values(), None], toxic, passage, names


def write(spark, tmp_path):
    texts, toxic, passage, names = corpus()
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)] + [(None, "no id here", None, None, None)]
    spark.createDataFrame(rows, KINDS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return texts, toxic, names


def test_stages(spark, tmp_path):
    texts, toxic, names = write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept, last = ids(docs), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()} if k < 4 else {}
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        now = ids(docs)
        if k < 4:
            assert set(docs.columns) == {c.split()[0] for c in KINDS.split(", ")}
        gone = kept - now
        if name == "toxicity":
            assert names["toxic"] in gone and {i for i, y in toxic.items() if y} <= gone and names["clean"] in now
        elif name == "near_dedup":
            order = sorted(i for i in before if i is not None)
            parts = plain_components([plain_fingerprint(before[i]) for i in order])
            assert now == {order[p] for p in parts} | {None} and names["copy"] in gone
        elif name == "decontamination":
            assert gone == {names["leak"]}
        elif name == "secrets":
            text = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
            assert not gone and text[names["secret"]][0].endswith('[SECRET]"') and text[names["secret"]][1] == len(text[names["secret"]][0])
            assert all(t[0] == before[i] for i, t in text.items() if i != names["secret"])
        kept, last = now, docs
    assert last.filter("taken > 2 * size or copies < 1").count() == 0
    masked = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/out3").collect()}
    assert {c.split()[0] for c in KINDS.split(", ")} <= set(last.columns) and all(r.text == masked[r.doc_id] for r in last.collect())
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.taken) for r in whole} == {(r.doc_id, r.taken) for r in last.collect()}


def test_no_documents(spark, tmp_path):
    write(spark, tmp_path / "full")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    spark.createDataFrame([], KINDS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_registered():
    assert [n.split("_")[0] for n in sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{n}" for n in range(1, 14)]
    assert set(registry.ORACLES) <= set(registry.QUERIES) and corpus_pipeline.QUERIES["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
