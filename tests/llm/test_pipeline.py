"""Every stage of the pipeline and run() against plain versions, on small tables with nulls, empty texts, repeats and no rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evergrain.llm import exact_dedup, quality

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rnd = random.Random(21)
    words = "the river stone quietly carries morning light over many small bridges while people walk home and talk about seasons work bread music rain".split()
    texts = []
    for _ in range(25):
        n = rnd.randrange(40, 160)
        base = [rnd.choice(words) for _ in range(n)]
        texts.append(" ".join(base).capitalize() + ".")
        for _ in range(rnd.randrange(3)):
            t = list(base)
            for _ in range(rnd.randrange(0, 5)):
                t[rnd.randrange(n)] = rnd.choice(words)
            texts.append(rnd.choice([" ", "  "]).join(t))
        if rnd.random() < 0.3:
            texts.append(texts[-1].replace(" ", "\n"))
    texts += [None, "", "  ", "!!!! $$$$ #### !!!! $$$$", "x", "x"] + ["zzz zzz zzz " * 30] * 2
    rnd.shuffle(texts)
    rows = [(k, t, "en", rnd.choice(["a", "b", None]), len(t or "")) for k, t in enumerate(texts)]
    return rows + [(3, "the same id stands here again with words of its own", "en", "a", 1), (None, "no id but words", "en", "b", 1), rows[5], (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), DOCS).repartition(3)


def multiset(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


def test_reject_poor(spark, docs):
    kept = corpus_pipeline.reject_poor(spark, docs, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scored = quality.quality_scores(docs, labels)
    assert kept.columns == docs.columns
    assert multiset(kept, "doc_id") == multiset(scored.where("predicted = 1"), "doc_id")
    assert corpus_pipeline.reject_poor(spark, docs.where("false"), SMALL).count() == 0


def brute_once(rows):
    first = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        if key not in first or (r[0] is not None and (first[key] is None or r[0] < first[key])):
            first[key] = r[0]
    return first


def test_drop_copies(spark, docs):
    kept = corpus_pipeline.drop_copies(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d in brute_once(fixture()).values())
    assert corpus_pipeline.drop_copies(spark, docs.where("false"), SMALL).count() == 0


def brute_components(rows):
    sets = []
    for d, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    least = {d: d for d, _ in sets if d is not None}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if a is not None and b is not None and least[a] != least[b] and x and 5 * len(x & y) >= 4 * len(x | y):
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return least


def test_drop_near_copies(spark, docs):
    kept = corpus_pipeline.drop_near_copies(spark, docs, SMALL)
    assert kept.columns == docs.columns
    rows = fixture()
    least = brute_components(rows)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, *_ in rows if d is None or least[d] == d)
    assert len({d for d in least if least[d] != d}) > 5
    assert corpus_pipeline.drop_near_copies(spark, docs.where("false"), SMALL).count() == 0


def test_mix_sources(spark, docs):
    mixed = corpus_pipeline.mix_sources(spark, docs, SMALL)
    assert mixed.columns == docs.columns
    before, after = {}, {}
    for table, held in ((docs, before), (mixed, after)):
        for r in table.collect():
            if r["text"] and r["text"].split():
                held.setdefault((r["doc_id"], r["text"]), 0)
                held[r["doc_id"], r["text"]] += 1
    assert after and all(after[k] <= 2 * before[k] for k in after)  # documents of the input, none oftener than twice for each row
    size = lambda held, s: sum(n * len(t.split()) for (d, t), n in held.items() if where[d, t] == s)
    where = {(r["doc_id"], r["text"]): r["source"] for r in docs.collect()}
    sizes = {s: size(before, s) for s in ("a", "b", None)}
    level, open_, left, want = 0.0, {"a": 3, "b": 1, None: 2}, 1.5 * sum(sizes.values()), {}
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if open_[s] * level > 2 * sizes[s]]
        if not full:
            want |= {s: w * level for s, w in open_.items()}
            break
        for s in full:
            want[s] = 2 * sizes[s]
            left -= want[s]
            del open_[s]
    longest = max(len((t or "").split()) for t in (r[1] for r in fixture()))
    for s in sizes:
        assert abs(size(after, s) - want[s]) <= longest + 16
    assert corpus_pipeline.mix_sources(spark, docs.where("false"), SMALL).count() == 0


def test_encode(spark, docs):
    ref = tokenizers.Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    got = corpus_pipeline.encode(spark, docs, SMALL).collect()
    want = []
    for d, t, *_ in fixture():
        ids = ref.encode(t or "", add_special_tokens=False).ids
        want.append(str((d, ids, ref.decode(ids, skip_special_tokens=False))))
    assert sorted(str((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"])) for r in got) == sorted(want)
    assert corpus_pipeline.encode(spark, docs.where("false"), SMALL).count() == 0


def test_run_is_its_stages_in_order(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["reject_poor", "drop_copies", "drop_near_copies", "mix_sources", "encode"]
    want = docs
    for _, stage in corpus_pipeline.STAGES:
        want = stage(spark, want, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path))
    cols = ("doc_id", F.hex("ids").alias("ids"), "decoded")
    assert multiset(got, *cols) == multiset(want, *cols) and got.count() > 10


def test_stages_keep_the_staying_ids(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.reject_poor(spark, documents, SMALL)
    want = {r["keep_id"] for r in exact_dedup.exact_duplicates(kept).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.drop_copies(spark, kept, SMALL).collect()} == want
