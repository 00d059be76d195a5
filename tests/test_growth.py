"""What keeps work and memory of a task from following the corpus, seen in plans and in small runs."""

from pyspark.sql import functions as F

from evergrain.operators import feedback, patterns, retrieval




def test_relevance_intersects_once(spark):
    rows = spark.createDataFrame([(["a", "b"], ["a", "x", "a", "y"])], "wanted array<string>, found array<string>")
    made = rows.select(retrieval.relevance_of(F.col("wanted"), F.col("found")).alias("r"))
    logical = made._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains(array_intersect(" not in logical and made.first()[0] == 0.5 + 0.5


def test_hits_are_counted_where_documents_are(spark):
    docs = spark.createDataFrame([(k, f"harbour wall lot{k}") for k in range(30)], "belief_id int, body string")
    asked = spark.createDataFrame([(1, "harbour lot7"), (2, "lot3 wall")], "query_id int, query string")
    hits = retrieval.lexical_hits(docs, asked)
    found = {(r["query_id"], r["belief_id"]): round(r["relevance"], 6) for r in hits.collect()}
    assert len(found) == 60 and found[1, 7] == round(1 + 2 / 3, 6) and found[1, 8] == round(1 / 2 + 1 / 3, 6)
    # of a table too large to be sent to all tasks, nothing moves between cutting and counting
    large = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.col("doc_id").alias("belief_id"), F.col("text").alias("body"))
    asked = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    plan = retrieval.lexical_hits(large, asked)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "hashpartitioning(query_id" not in plan


def test_keys_that_no_event_has_leave_before_the_join(spark):
    rows = spark.createDataFrame([(k, 1, "none") for k in range(50)] + [(99, 1, "here")], "retrieval_id int, day int, served_id string")
    there = spark.createDataFrame([("here",), ("here",), ("else",)], "served_id string")
    assert [tuple(r) for r in feedback._met(rows, "served_id", there).select("retrieval_id", "served_id").collect()] == [(99, "here")]


def test_many_occurrences_in_one_text(spark):
    rows = spark.createDataFrame([(1, "ab" * 60_000), (2, "ab")], "id int, text string").coalesce(1)
    wanted = spark.createDataFrame([("ab",)], "pattern string")
    found = patterns.matches(rows, "id", "text", wanted, longest=False)
    assert patterns.SLICE_HITS < 60_000 and {r["id"]: (r["n"], r["a"], r["b"]) for r in found.groupBy("id").agg(F.count("*").alias("n"), F.min("start").alias("a"), F.max("end").alias("b")).collect()} == {1: (60_000, 0, 120_000), 2: (1, 0, 2)}
