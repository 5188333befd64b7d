"""Each stage of the pipeline on planted cases, and the whole of it."""

import random

import corpus_pipeline

from corpusmill.llm import decontam, lsh_forest, pii, quality


def test_pipeline(spark, tmp_path):
    rnd = random.Random(3)
    words = [f"{a}{b}" for a in ("ta", "re", "mi", "so", "lu") for b in "abcdefghijklmnopqrst"]
    sentence = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = sentence(14)
    rows, labels = {}, []
    for d in range(300):
        t = sentence(60)
        if d % 6 == 5:
            t = f"{t} hateful {sentence(5)} hateful2"
        rows[d] = t
        labels.append((d, 1, int(d % 6 == 5)))
    base = sentence(200)
    rows[400], rows[401], rows[402] = base, base, base.replace(base.split()[100], "changed", 1)
    rows[410] = f"{sentence(20)} {passage.upper()} {sentence(20)}"
    rows[420] = f"{sentence(30)} mail joe@mail.example.com now"
    rows[430], rows[431] = None, ""
    docs = [(d, t, "en", f"s{d % 3}", len(t or ""), "x") for d, t in rows.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, size string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    first = spark.read.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = first, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in seen.items()}
    toxic = {d for d in range(300) if d % 6 == 5}
    assert not ids["quality"] & toxic and ids["quality"] == set(rows) - toxic
    assert ids["near_duplicates"] == ids["quality"] - {401, 402}
    assert ids["decontamination"] == ids["near_duplicates"] - {410}
    assert all(v.columns == first.columns for k, v in seen.items() if k != "packing")
    text = {r.doc_id: r for r in seen["pii"].collect()}
    assert text[420].text.endswith("mail [EMAIL] now") and text[420].n_chars == len(text[420].text) and text[400].text == base
    assert ids["packing"] == ids["pii"] == ids["decontamination"]
    tokens = {}
    for r in seen["packing"].collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
        assert r.doc_tokens >= r.length
    assert all(tokens[r.doc_id] == r.doc_tokens for r in seen["packing"].collect())


def test_clashing_columns(spark):
    rows = [(1, "one two three four five six", "a", 1, "b"), (1, "one two three four five six", "a", 1, "b"), (2, None, None, None, None), (None, "x y", "c", 2, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int, _t string").withColumnRenamed("_t", "hash").selectExpr("*", "source as lang", "n as node", "hash as bytes", "n as rid")
    labels = spark.createDataFrame([(1, 1, 0, "z")], "doc_id long, quality int, toxic int, bytes string")
    items = spark.createDataFrame([(1, "nothing of this", "z")], "item_id long, text string, doc_id string")
    assert quality.clean(docs, labels).columns == docs.columns
    assert lsh_forest.distinct(docs).count() == 3
    assert decontam.clean(docs, items).count() == 4
    assert pii.redact(docs).columns == docs.columns
