"""The similarity join of names against all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from corpusmill.operators import names


def near(rnd, words):
    t = list(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5))))
    for _ in range(rnd.randint(0, 3)):
        i = rnd.randrange(len(t) + 1)
        t[i : i + rnd.randint(0, 1)] = rnd.choice(["", "x", "é"])
    return "".join(t)


@pytest.mark.parametrize("threshold", [0.7, 0.85])
def test_equals_all_pairs(spark, threshold):
    rnd = random.Random(8)
    words = ["deep", "learning", "graph", "for", "net", "a", "vision", "of"]
    rows = [(i, near(rnd, words), i % 2) for i in range(160)] + [(900 + i, "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 6))), i % 2) for i in range(80)] + [(990, None, 0), (991, "", 0), (992, "", 0)]
    df = spark.createDataFrame(rows, "id long, name string, year int").repartition(5)
    got = {(r.a, r.b): r.ratio for r in names.pairs_of_rows(df, "id", "name", threshold, ["year"]).collect()}
    want = {}
    for i, a, y in rows:
        for j, b, z in rows:
            if i < j and y == z and a and b:
                if (r := round(SequenceMatcher(None, a, b).ratio(), 6)) >= threshold:
                    want[i, j] = r
    assert got == want and len(want) > 10
    with pytest.raises(ValueError, match="2/3"):
        names.similar(df, "name", 0.5, ["year"])


def test_candidates_follow_the_rows(spark):
    """Ten times the names, spread over as many more words: about ten times the candidates."""
    rnd = random.Random(3)
    counts = []
    for n in (200, 2000):
        rows = [(i, f"{rnd.randrange(10**9):09d} {rnd.randrange(10**9):09d}", 0) for i in range(n)]
        rows += [(n + i, rows[i][1][:-1] + "z", 0) for i in range(n // 10)]
        df = spark.createDataFrame(rows, "id long, name string, year int")
        base = df.selectExpr("struct(year) as block", "name").distinct()
        counts.append((names._candidates(base, 2, 0.9).count(), names.similar(df, "name", 0.9, ["year"]).count()))
    assert counts[0][1] == 20 and counts[1][1] == 200 and counts[1][0] <= 25 * counts[0][0]
