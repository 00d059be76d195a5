from pyspark.sql import functions as F

from evergrain.operators import admin


def test_admin(spark):
    df = spark.createDataFrame([("the quick brown fox jumps over the lazy dog and runs far away from the hunter",)], "body string")
    assert df.select(admin.snippet(F.col("body"), F.array(F.lit("lazy")), 6).alias("x")).first()["x"] == "…jumps over the [lazy] dog and…"
    old = spark.createDataFrame([("1", "about shop", "current", None, None, "t2"), ("2", "x", "current", "p", None, "t3"), ("3", "x", "stale", None, None, "t1"), ("4", "x", "current", None, None, "t1")], "id string, body string, status string, project string, path string, updated_at string")
    have = spark.createDataFrame([("legacy:4",)], "belief_id string")
    assert [(r["belief_id"], r["scope"]["scope_id"]) for r in admin.backfill(old, have, [("shop", "store")]).collect()] == [("legacy:2", "project:p"), ("legacy:1", "project:store")]
    lines = spark.createDataFrame([("a.py", 1, "password = hunter22"), (".env", 2, "x"), ("b.py", 3, "Codename here"), ("c.py", 4, "a" * 64)], "path string, line_no long, line string")
    assert sorted((r["line_no"], r["finding"]) for r in admin.public_findings(lines, ["codename"]).collect()) == [(1, "secret_leak"), (2, "forbidden_path"), (3, "denied_word")]
