"""Null and repeated ids, empty tables and very long texts, for the corpus operators whose other tests do not meet them."""

import random
import zlib

import numpy as np
import pytest

from evergrain.llm import bpe, exact_dedup, licenses, media, mixing, quality, sharding, substring_dedup, suffix_array

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
DOCS = "doc_id long, text string, source string, norm string, digest string, bucket int, kind int, shard int, size int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None if (d or 0) % 3 else "s", "n", "d", 1, 2, 3, 4) for d, t in rows], DOCS).repartition(3)


def prose(n, seed):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(10**5)}" for _ in range(n))


def brute(rows, cut, width):
    units = [(d, cut(t or "")) for d, t in rows]
    first = {}
    for d, u in units:
        for i in range(len(u) - width + 1):
            if d is not None:
                key = tuple(u[i : i + width])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, u in units:
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - width + 1):
            if d is not None and first[tuple(u[i : i + width])] < d:
                gone[i : i + width] = True
        out.append((str(d), len(u), int(gone.sum())))
    return sorted(out)


@pytest.mark.parametrize(("remove", "cut", "n"), [(substring_dedup.remove_repeated_words, str.split, 200_000), (suffix_array.remove_repeated_bytes, str.encode, 25_000)])
def test_repeats(spark, remove, cut, n):
    long = prose(n, 1)
    at = len(long) // 2
    rows = [(7, long), (3, long[at : at + 3000]), (7, long[:2000]), (9, "own words " + long[-5000:]), (None, long[:4000]), (None, None), (0, ""), (7, long[:2000])]
    got = remove(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_units"], r["n_removed"]) for r in got) == brute(rows, cut, 50)
    assert remove(frame(spark, [])).count() == 0


def test_bpe(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ref = tokenizers.Tokenizer.from_file(path)
    rows = [(None, "no id"), (None, None), (4, prose(60_000, 2)), (4, "again"), (4, "again"), (5, "é" * 30_000 + " x")]
    got = bpe.encode_decode(frame(spark, rows), path).collect()
    want = sorted(str((d, ref.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    assert sorted(str((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    assert bpe.encode_decode(frame(spark, []), path).count() == 0


def test_media(spark):
    rows = [(None, "no id"), (None, None), (4, prose(100_000, 3)), (4, "again"), (4, "again")]
    got = media.store_media(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], zlib.crc32(r["payload"])) for r in got) == sorted(
        (str(d), len(b), zlib.crc32(b.ljust(max(192, -(-len(b) // 192) * 192)))) for d, b in ((d, (t or "").encode()) for d, t in rows))
    assert media.store_media(frame(spark, [])).count() == 0


def test_mix(spark):
    rows = [(None, "a b c"), (None, "a b c"), (None, None), (6, prose(5000, 4)), (6, "x y"), (6, "x y"), (7, "z " * 40), (8, "")]
    got = mixing.mix(frame(spark, rows), block=4).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d), len((t or "").split())) for d, t in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    sums = {}
    for r in got:
        sums.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(target - taken) <= 8 for target, taken in sums.values())


def test_quality(spark):
    labels = spark.createDataFrame([(k, int(k % 2), 0) for k in range(40)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(k, prose(50, k) if k % 2 else "!! $$ " * 30) for k in range(40)] + [(90, prose(150_000, 5)), (None, None)])
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == 42 and all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["held_out"] is False
    assert quality.quality_scores(docs.where("false"), labels).count() == 0 and quality.keep_good(docs.where("false"), labels).count() == 0


def test_exact_duplicates(spark):
    long = prose(200_000, 6)
    rows = [(5, long), (4, long.replace(" ", "\n", 1000)), (4, long + "!"), (None, long)]
    got = sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(frame(spark, rows)).collect())
    assert got == [("4", 4, 1, True), ("4", 4, 3, True), ("5", 4, 3, False), ("None", 4, 3, False)]


def test_shards(spark):
    rows = [(k, "text %d" % (k % 40)) for k in range(400)] + [(900, prose(100_000, 7)), (901, prose(100_000, 8)), (None, None), (None, None)]
    got = sharding.byte_shards(frame(spark, rows), 4).collect()
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 1 for _, t in rows)
    where = {}
    for r in got:
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
    big = {zlib.crc32(t.encode()) for d, t in rows if (d or 0) >= 900}
    assert all(len(s) == 1 for c, s in where.items()) and len({min(where[c]) for c in big}) == 2
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_licenses(spark):
    from pyspark.sql import functions as F

    rows = [(None, "Released under the MIT License."), (None, None), (3, prose(100_000, 9) + "\nReleased under the MIT License.\n"), (3, "plain"), (3, "plain")]
    got = licenses.scan_licenses(frame(spark, rows), F.lit("a/b.txt")).collect()
    assert sorted((str(r["doc_id"]), r["own_license"]) for r in got if r["own_license"]) == [("3", "MIT"), ("None", "MIT")] and len(got) == 5
