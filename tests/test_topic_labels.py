"""Phrases as labels: words, poor ones, families, candidates by a plain count, greedy choice on literal cases."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import phrases
from corpusmill.operators import labels


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("term", "poor"),
    [("graph neural networks", False), ("machine learning", False), ("machine learning github", True), ("deep learning", True), ("cnn", True), ("q-bio.NC", True), ("code available", True), ("mml math x", True), ("models", True), ("protein folding", False), ("  ", True), (None, True)],
)
def test_poor(spark, term, poor):
    assert one(spark, phrases.is_poor(F.lit(term).cast("string"))) is poor


def test_words_and_terms(spark):
    said = F.lit("The Deep-Q learning of ab 3dcnn Models, GitHub!")
    assert one(spark, phrases.words(said, phrases.PHRASE_STOPWORDS)) == ["deep-q", "learning", "dcnn", "models"]
    assert one(spark, phrases.words(said, phrases.TERM_STOPWORDS)) == ["deep-q", "dcnn"]
    assert one(spark, phrases.words(F.lit(None).cast("string"), [])) == []
    assert one(spark, phrases.rewritten(F.lit(" Graph\n GNNs"))) == "graph neural networks"


def test_redundant(spark):
    got = lambda t, *taken: one(spark, phrases.is_redundant(F.lit(t), F.array(*[F.lit(x) for x in taken]).cast("array<string>")))
    assert got("machine learning") and got("graph") and not got("neural network") and not got("language models")
    assert got("neural network", "graph neural networks") and got("language models", "large language models") and got("x y", "x y")
    assert got("graph neural network", "deep graph neural networks") and not got("support vector machine", "support vector machines")


def candidates(spark, scores):
    return spark.createDataFrame([(1, p, s, None) for p, s in scores.items()], "c int, phrase string, score long, last_resort long")


def chosen(found, most=5):
    return [r.label for r in labels.topic_labels(found, "c", most).orderBy("position").collect()]


def test_two_of_a_family_first(spark):
    scores = {"graph neural networks": 50, "node classification": 50, "link prediction": 50, "protein folding": 10, "graph": 900, "neural networks": 900}
    assert chosen(candidates(spark, scores), 3) == ["graph neural networks", "node classification", "protein folding"]
    assert chosen(candidates(spark, scores)) == ["graph neural networks", "node classification", "protein folding", "link prediction"]


def test_ties_and_rewrites(spark):
    assert chosen(candidates(spark, {"zeta waves": 5, "beta waves": 5, "alpha rays": 5})) == ["alpha rays", "beta waves", "zeta waves"]
    assert chosen(candidates(spark, {"github pages": 5, "cs.cl": 9})) == []
    assert labels.topic_labels(candidates(spark, {"x": 1}).where("false"), "c").count() == 0


def test_last_resort(spark):
    found = spark.createDataFrame([(1, "protein folding", None, 4), (1, "machine learning", 90, 90), (2, "protein folding", 3, 4), (2, "cell biology", None, 99)], "c int, phrase string, score long, last_resort long")
    got = {(r.c, r.position): r.label for r in labels.topic_labels(found, "c").collect()}
    assert got == {(1, 1): "protein folding", (2, 1): "protein folding"}


def plainly(docs, most=20):
    """Candidates of one cluster by a plain program."""
    poor_parts = phrases.BANNED_PARTS

    def poor(t):
        if any(s in t for s in phrases.STRONG):
            return any(x in t for x in phrases.SPOILED)
        return t in phrases.TERM_STOPWORDS or t in phrases.BANNED or re.match(phrases.ARXIV_CATEGORY, t) is not None or len(t) < 4 or any(p in t for p in poor_parts)

    def top(c):
        return sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most]

    counts = defaultdict(Counter)
    for title, body, keywords in docs:
        for name, said in (("title", title), ("body", body)):
            found = re.findall(r"[a-z][a-z0-9\-]{2,}", (said or "").lower())
            w = [x for x in found if x not in phrases.PHRASE_STOPWORDS]
            for n in (2, 3):
                for g in zip(*[w[i:] for i in range(n)]):
                    p = phrases.REWRITES.get(" ".join(g), " ".join(g))
                    if len(set(g)) > 1 and not poor(p):
                        counts[f"{name}_{n}"][p] += 1
            if name == "title":
                counts["title_1"].update(x for x in found if x not in phrases.TERM_STOPWORDS)
        counts["keywords"].update(k for k in (" ".join((k or "").lower().split()) for k in keywords or []) if k and k not in phrases.TERM_STOPWORDS)
    out = {}
    for kind, c in counts.items():
        clean = Counter()
        for p, n in top(c):
            p = phrases.REWRITES.get(p, p)
            if not poor(p):
                clean[p] += n
        w, least = labels.EVIDENCE.get(kind, (0, 1))
        for i, (p, n) in enumerate(top(clean)):
            score, last = out.get(p, (None, 0))
            if n >= least and w and not (kind == "title_1" and i >= 15):
                score = (score or 0) + round(w * n)
            out[p] = (score, last + round(labels.LAST_RESORT[kind] * n))
    return out


def test_candidates_equal_a_plain_count(spark):
    docs = [
        ("Graph GNNs for molecules", "We propose graph neural networks graph neural networks on molecules", ["Chemistry ", None, "deep"]),
        ("Graph neural networks, again", None, ["chemistry", "Large Language LLMs"]),
        (None, "graph neural networks and protein folding protein folding protein folding", []),
        ("protein folding protein folding", "very very very github code available", None),
        ("", "molecules " * 300, ["chemistry"]),
    ] * 2
    df = spark.createDataFrame([(c, *d) for c in (1, None) for d in docs], "c int, title string, body string, keywords array<string>").repartition(5)
    got = {c: {} for c in (1, None)}
    for r in labels.topic_candidates(df, "c", "title", "body").collect():
        got[r.c][r.phrase] = (r.score, r.last_resort)
    want = plainly(docs)
    assert got[1] == want and got[None] == want
    assert {"graph neural networks", "protein folding"} <= set(want)
    best = labels.topic_labels(labels.topic_candidates(df, "c", "title", "body"), "c").where("position = 1").collect()
    assert [(r.label, r.family) for r in best] == [("graph neural networks", "graph_learning")] * 2
    assert labels.topic_candidates(df.limit(0), "c", "title", "body").count() == 0
