"""The automaton, snippets and digests against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from evergrain.operators import admin, digests, patterns


def test_matches(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abİcß ", k=rnd.randrange(1, 5))) for _ in range(1000)] + ["", "the end", "end of"]
    texts = [(k, "".join(rnd.choices("abİIcßẞ ", k=rnd.randrange(0, 60)))) for k in range(60)] + [(90, None), (91, "The END of the end"), (92, "")]
    rows = spark.createDataFrame(texts, "id long, text string").repartition(3)
    named = spark.createDataFrame([(w,) for w in words], "pattern string")
    wanted = sorted({w.lower() for w in words} - {""})
    all_, best, counts = set(), set(), {}
    for k, text in texts:
        low, origin = "", []
        for i, c in enumerate(text or ""):
            low += c.lower()
            origin += [i] * len(c.lower())
        at = {i: [w for w in wanted if low.startswith(w, i)] for i in range(len(low))}
        all_ |= {(k, w, origin[i], origin[i + len(w) - 1] + 1) for i, ws in at.items() for w in ws}
        counts[k] = len({w for ws in at.values() for w in ws})
        i = 0
        while i < len(low):
            w = max(at[i], key=len, default="")
            if w:
                best.add((k, w, origin[i], origin[i + len(w) - 1] + 1))
            i += len(w) or 1
    key = lambda df: {tuple(r) for r in df.select("id", "pattern", "start", "end").collect()}
    assert key(patterns.matches(rows, "id", "text", named, longest=False)) == all_
    assert key(patterns.matches(rows, "id", "text", named)) == best
    assert {r["id"]: r["n_patterns"] for r in patterns.distinct_hits(rows, "id", "text", named).collect()} == {k: n for k, n in counts.items() if n}
    assert patterns.matches(rows, "id", "text", named.where("false")).count() == 0


def test_too_many_patterns(spark, monkeypatch):
    monkeypatch.setattr(patterns, "MAX_PATTERNS", 3)
    with pytest.raises(ValueError, match="more than an automaton"):
        patterns.matches(spark.range(1).selectExpr("id", "'x' as text"), "id", "text", spark.range(4).selectExpr("cast(id as string) as pattern"))


def test_best_snippet(spark):
    rows = spark.createDataFrame([("one two alpha three four five six alpha beta. seven eight", ["alpha", "beta"]), ("nothing here", ["alpha"]), ("", ["x"]), ("Alpha", ["alpha"])], "b string, t array<string>")
    got = [r["s"] for r in rows.select(admin.best_snippet(F.col("b"), F.col("t"), 3).alias("s")).collect()]
    assert got == ["…[alpha] [beta.] seven…", "nothing here", "", "[Alpha]"]


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_differences(spark, ranges):
    rows = [(k, f"v{k % 9}", None if k % 5 else float(k)) for k in range(500)] + [(2**60 + 1, "x", 0.5), (None, "null key", 1.0)]
    schema = "k long, a string, b double"
    a = spark.createDataFrame(rows, schema).repartition(3)
    assert digests.differences(a, a.repartition(2), "k", ranges).count() == 0
    other = [(k, "new" if k in (3, 2**60 + 1) else v, b) for k, v, b in rows if k != 77] + [(1000, "y", None), (-5, None, None)]
    b = spark.createDataFrame(other, schema).repartition(4)
    got = {tuple(r) for r in digests.differences(a, b, "k", ranges).collect()}
    assert got == {(3, "changed"), (2**60 + 1, "changed"), (77, "missing"), (1000, "added"), (-5, "added")}
    cuts = digests.bounds(a, "k", ranges)
    assert digests.differing_ranges(a, b, "k", cuts).count() <= 5
    assert digests.tree(a, "k", cuts).where("level = 0").agg(F.sum("n_rows")).first()[0] == len(rows)
    assert digests.table_root(a, "k", ranges).collect() == digests.table_root(a.repartition(5), "k", ranges).collect()


def test_differences_by_text_keys_and_of_nothing(spark):
    a = spark.createDataFrame([(f"k{k}", k) for k in range(60)], "k string, v int")
    b = a.where("k <> 'k7'")
    assert [tuple(r) for r in digests.differences(a, b, "k", 5).collect()] == [("k7", "missing")]
    assert digests.differences(a.where("false"), b.where("k = 'k1'"), "k", 5).collect() == [("k1", "added")]
    assert digests.differences(a.where("false"), b.where("false"), "k", 5).count() == 0
