"""The corpus operators against plain versions, on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evergrain.llm import bpe, exact_dedup, licenses, media, mixing, ngram_join, quality, sharding, substring_dedup, suffix_array
from evergrain.llm.components import components
from evergrain.llm.routing import SPAN, doc_bucket, pack, unpack

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
DOCS = "doc_id long, text string, source string, lang string, norm string, digest string, bucket int, shard int, size int"


def corpus(seed=3, n=60):
    """Near copies, copies, shared passages, nulls, empty texts, white space, long words."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    base = [rnd.choice(words) for _ in range(260)]
    texts = [None, "", "  \n ", "a", "a b", "A  b", "x" * 400, "x" * 400]
    for _ in range(n - len(texts)):
        a = rnd.randrange(200)
        t = base[a : a + rnd.randrange(0, 120)] + [rnd.choice(words) for _ in range(rnd.randrange(40))]
        for _ in range(rnd.randrange(3)):
            if t:
                t[rnd.randrange(len(t))] = rnd.choice(words)
        texts.append(rnd.choice([" ", "  ", "\n"]).join(t))
        if rnd.random() < 0.2:
            texts.append(texts[-1])
    rnd.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, f"s{(d or 0) % 3}" if (d or 0) % 7 else None, "en", "n", "d", 1, 2, 3) for d, t in rows], DOCS).repartition(3)


def brute_repeats(rows, unit, width):
    cut = {d: (t or "").encode().split() if unit == "words" else [bytes([b]) for b in (t or "").encode()] for d, t in rows}
    first = {}
    for d, u in cut.items():
        for i in range(len(u) - width + 1):
            key = tuple(u[i : i + width])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, u in cut.items():
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            if first[tuple(u[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = (b" " if unit == "words" else b"").join(x for x, g in zip(u, gone) if not g)
        out[d] = (len(u), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), kept)
    return out


@pytest.mark.parametrize(("unit", "remove", "width", "gram"), [("words", substring_dedup.remove_repeated_words, 50, 12), ("words", substring_dedup.remove_repeated_words, 8, 3), ("bytes", suffix_array.remove_repeated_bytes, 50, 20)])
def test_repeats(spark, unit, remove, width, gram):
    rows = corpus()
    got = remove(frame(spark, rows), width=width, gram=gram).collect()
    assert {r["doc_id"]: (r["n_units"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == brute_repeats(rows, unit, width)


@pytest.mark.parametrize("width", [64, 65, 90, 130, 300])
def test_repeats_of_wide_windows(spark, width):
    rnd = random.Random(width)
    base = [f"w{rnd.randrange(40)}" for _ in range(700)]
    rows = []
    for d in range(12):
        a, own = rnd.randrange(300), [f"v{rnd.randrange(9)}" for _ in range(5)]
        rows.append((d, " ".join(own + base[a : a + rnd.randrange(100, 400)])))
    got = substring_dedup.remove_repeated_words(frame(spark, rows), width=width, gram=12).collect()
    assert {r["doc_id"]: (r["n_units"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == brute_repeats(rows, "words", width)


def test_repeats_null_and_repeated_ids(spark):
    long = " ".join(f"w{k}" for k in range(60))
    got = remove_rows(spark, [(None, long), (5, long), (5, long), (5, long + " z"), (6, long), (None, None)])
    assert sorted(got, key=str) == sorted([(None, 60, 0), (5, 60, 0), (5, 60, 0), (5, 61, 0), (6, 60, 60), (None, 0, 0)], key=str)
    assert remove_rows(spark, []) == []


@pytest.mark.parametrize(("unit", "remove"), [("words", substring_dedup.remove_repeated_words), ("bytes", suffix_array.remove_repeated_bytes)])
@pytest.mark.parametrize("nameless", ["x", " ".join(f"v{k}" for k in range(90))])
def test_repeats_null_id_beside_document_0(spark, unit, remove, nameless):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(0, "a b " + long), (3, long[:-1] + "z"), (5, "c d " + long)]
    df = spark.createDataFrame([(None, nameless), rows[0], (None, nameless), *rows[1:]], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove(df).collect()}
    assert got.pop(None) == (len(nameless.split() if unit == "words" else nameless), 0, 0, nameless.encode())
    assert got == brute_repeats(rows, unit, 50)


def remove_rows(spark, rows):
    found = substring_dedup.remove_repeated_words(spark.createDataFrame(rows, "doc_id long, text string"))
    return [(r["doc_id"], r["n_units"], r["n_removed"]) for r in found.collect()]


def test_longest_matches_and_suffix_order():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        n = int(rnd.integers(1, 60))
        s = rnd.integers(1, 4, n)
        assert suffix_array.difference_cover_order(s).tolist() == sorted(range(n), key=lambda k: s[k:].tolist())
        label = rnd.integers(0, 4, n)
        ended = np.concatenate([s, [9]])
        got = substring_dedup.longest_matches(ended, np.concatenate([label, [0]]))
        for i in range(n):
            best = 0
            for j in range(n):
                if label[j] < label[i]:
                    k = 0
                    while max(i, j) + k < n and s[i + k] == s[j + k]:
                        k += 1
                    best = max(best, k)
            assert got[i] == best


def test_packing_and_buckets(spark):
    data = np.zeros(5, SPAN)
    data["doc"], data["twin"], data["start"], data["count"] = [-5, 2**60, 0, 7, 7], [1, -1, 0, 3, 2**62], [0, 1, 2, 3, 2**31], 4
    assert (unpack(pack(data), SPAN)[0] == data).all() and len(unpack(pack(data[:0]), SPAN)[0]) == 0
    ids = [0, 1, -7, 2**62]
    want = [r["b"] for r in spark.createDataFrame([(i,) for i in ids], "id long").select(F.pmod(F.xxhash64("id"), F.lit(13)).alias("b")).collect()]
    assert doc_bucket(np.array(ids), 13).tolist() == want


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, part, whole):
    sets, up = {d: shingle_set(t, n) for d, t in rows}, {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and whole * both >= part * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def near_rows():
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    texts = ["", None, "a", "A", "a b"]
    for m, n, edits in [(25, 120, 3), (12, 60, 2), (12, 300, 9), (3, 20, 1)]:
        base = [rnd.choice(words) for _ in range(n)]
        for _ in range(m):
            t = list(base)
            for _ in range(rnd.randint(0, edits)):
                t[rnd.randrange(n)] = rnd.choice(words)
            texts.append(" ".join(t))
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("n", "similarity", "block"), [(3, (9, 10), 1000), (5, (4, 5), 5)])
def test_ngram_components(spark, n, similarity, block):
    rows = near_rows()
    got = ngram_join.ngram_components(frame(spark, rows), n=n, similarity=similarity, block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, n, *similarity)


def test_link_cluster_asks_sets_of_an_overtaken_component():
    rnd = np.random.default_rng(0)
    core, extra = np.split(rnd.permutation(np.unique(rnd.integers(0, 2**63, 130).astype(np.uint64)))[:121], [95])
    x = np.r_[core, extra[:10]]
    k2 = np.r_[core, extra[15:21]]
    sets = [np.sort(t) for t in (np.r_[x, extra[10:15]], x, k2, k2[1:], core)]  # k1, x, k2, y2, y1: only x and y1 link the two
    assert ngram_join.link_cluster(list(range(5)), sets) == [(k, 0) for k in range(1, 5)]
    for seed in range(200):  # chains of near copies
        rnd = np.random.default_rng(seed)
        pool = np.unique(rnd.integers(0, 2**63, 80).astype(np.uint64))
        chain = [pool[:40]]
        for _ in range(12):
            last = chain[int(rnd.integers(len(chain)))]
            chain.append(np.unique(np.r_[rnd.permutation(last)[: len(last) - int(rnd.integers(0, 4))], rnd.choice(pool, int(rnd.integers(0, 4)))]))
        rows = [(k, " ".join(map(str, t.tolist()))) for k, t in enumerate(chain)]
        want = {d: r for d, (_, r) in brute_components(rows, 1, 9, 10).items() if d != r}
        assert dict(ngram_join.link_cluster(list(range(len(chain))), chain)) == want


@pytest.mark.parametrize("merge", [0, 2048])
@pytest.mark.parametrize("similarity", [(9, 10), (4, 5)])
def test_search_and_clusters_by_brute_force(monkeypatch, merge, similarity):
    monkeypatch.setattr(ngram_join, "MERGE", merge)
    rnd, (part, whole) = np.random.default_rng(5), similarity
    for _ in range(800):
        pool = np.unique(rnd.integers(0, 2**63, 90).astype(np.uint64))
        sets = [pool[:40]]
        for _ in range(13):
            last = sets[int(rnd.integers(len(sets)))]
            sets.append(np.unique(np.r_[rnd.permutation(last)[: len(last) - int(rnd.integers(0, 5))], rnd.choice(pool, int(rnd.integers(0, 5)))]))
        plain = [set(x.tolist()) for x in sets]
        near = lambda a, b: whole * len(a & b) >= part * len(a | b)
        index = ngram_join.Index(sets, similarity)
        assert index.search(sets[-1]) == [k for k, other in enumerate(plain) if near(plain[-1], other)]
        groups = ngram_join.Groups()
        for k, a in enumerate(plain):
            for m, b in enumerate(plain[:k]):
                if near(a, b):
                    groups.join(k, m)
        assert dict(ngram_join.link_cluster(list(range(len(sets))), sets, similarity)) == {k: groups.root(k) for k in range(len(sets)) if groups.root(k) != k}


@pytest.mark.parametrize(("similarity", "block"), [((9, 10), 1000), ((4, 5), 1000), ((4, 5), 6), ((1, 2), 1000)])
def test_ngram_components_at_the_edge(spark, similarity, block):
    """Sets of 1 to 900 shingles and copies of them whose similarity lies around the bound, among passages that many share."""
    part, whole = similarity
    rnd = random.Random(part)
    passage = [f"p{k}" for k in range(300)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "One")]
    for g in range(45):
        n = rnd.choice([1, 2, 3, 7, 30, 120, 190, 210, 240, 500, 900])
        base = [f"g{g}w{k}" for k in range(n)]
        if rnd.random() < 0.5:
            at = rnd.randrange(n)
            base[at:at] = passage[: rnd.randrange(1, 300)]
        for _ in range(rnd.randrange(1, 6)):
            t = list(base)
            for _ in range(rnd.randrange(0, max(2, int(1.3 * len(t) * (whole - part) / whole / 3)))):
                t[rnd.randrange(len(t))] = f"e{rnd.randrange(10**9)}"
            rows.append((len(rows), " ".join(t)))
    got = ngram_join.ngram_components(frame(spark, rows), similarity=similarity, block=block).collect()
    want = brute_components(rows, 3, part, whole)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert 20 < len({c for _, c in want.values()}) < len(rows) - 20


def test_ngram_components_of_odd_tables(spark):
    assert ngram_join.ngram_components(frame(spark, [])).collect() == []
    long = " ".join(f"w{k}" for k in range(400))
    rows = [(None, long), (None, None), (7, long), (7, "other words of its own"), (9, long + " end"), (4, "other words of its own"), (1, "x " * 60_000), (2, "X\n" * 70_000)]
    got = ngram_join.ngram_components(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted(
        [(None, 398, None), (None, 0, None), (7, 398, 4), (7, 3, 4), (9, 399, 4), (4, 3, 4), (1, 1, 1), (2, 1, 1)], key=str)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (6, 6), (9, 3), (2, 1)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(links).collect()} == {(2, 1), (3, 1), (9, 1), (5, 4)}


@pytest.mark.parametrize("nibbles", [64, 1])
def test_exact_duplicates(spark, nibbles):
    rows = corpus(7, 40) + [(3, "again"), (3, "again"), (None, "again"), (None, "alone")]
    got = exact_dedup.exact_duplicates(frame(spark, rows), digest_nibbles=nibbles).collect()
    norm = lambda t: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    want = sorted((str(d), str(min((x for x in groups[norm(t)] if x is not None), default=None)), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert sorted(exact_dedup.drop_duplicates(frame(spark, rows)).columns) == sorted(frame(spark, rows).columns)
    assert exact_dedup.drop_duplicates(frame(spark, rows)).count() == len(groups)


def test_byte_shards(spark):
    rows = corpus(9, 120) + [(None, "z"), (1, "z"), (1, "z")]
    got = sharding.byte_shards(frame(spark, rows), 4).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    assert max(sizes) - min(sizes) < 0.25 * sum(sizes) / 4
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    hot = sharding.byte_shards(frame(spark, [(k, "same text") for k in range(90)] + [(k, str(k)) for k in range(90, 180)]), 4).collect()
    sizes = [sum(r["size"] for r in hot if r["shard"] == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 30
    assert sharding.byte_shards(frame(spark, []), 4).count() == 0


def brute_targets(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    keys = sorted(sizes, key=lambda k: (k is None, (k or "").encode()))
    weight = {k: weights[i % 3] for i, k in enumerate(keys)}
    target, left, open_ = {}, share * sum(sizes.values()), set(keys)
    while open_:
        level = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if weight[k] * level > most * sizes[k]}
        if not full:
            return target | {k: weight[k] * level for k in open_}
        for k in full:
            target[k] = most * sizes[k]
            left -= target[k]
        open_ -= full
    return target


def test_mix(spark):
    rows = corpus(11, 150)
    df = frame(spark, rows)
    got = mixing.mix(df, block=4, shard_rows=10).collect()
    again = mixing.mix(df.repartition(5), block=4, shard_rows=10).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    targets = brute_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6 * max(1, targets[r["source"]])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 4 * 10
    assert mixing.mix(frame(spark, [])).count() == 0
    copies = mixing.mixed_documents(df, block=4, shard_rows=10)
    assert copies.columns == df.columns and copies.count() > 0


def test_apportionment_is_highest_quotients(spark):
    rnd = random.Random(1)
    votes = {k: rnd.randint(1, 1000) for k in range(9)}
    parties = spark.createDataFrame([(k, float(v)) for k, v in votes.items()], "party long, votes double")
    for seats in (1, 7, 100):
        won = {k: 0 for k in votes}
        for _ in range(seats):
            k = max(votes, key=lambda k: (votes[k] / (2 * won[k] + 1), -k))
            won[k] += 1
        got = mixing.apportion(parties, F.lit(seats).cast("long"), [], "votes").collect()
        assert {r["party"]: r["won"] for r in got} == won


@pytest.mark.parametrize("votes", [[1000.0] + [0.49] * 60, [300.0, 300.0] + [1.5] * 90, [5.0] * 40, [0.0, 0.0, 7.0], [3.0, 9.0, 15.0, 1.0]])
def test_apportionment_of_many_small_parties(spark, votes):
    parties = spark.createDataFrame(list(enumerate(votes)), "party long, votes double")
    for seats in (0, 3, 50, 1029):
        won = [0] * len(votes)
        for _ in range(seats):
            k = max(range(len(votes)), key=lambda k: (votes[k] / (2 * won[k] + 1), -k))
            won[k] += 1
        got = mixing.apportion(parties, F.lit(seats).cast("long"), [], "votes").collect()
        assert [w for _, w in sorted((r["party"], r["won"]) for r in got)] == won
    both = parties.withColumn("g", F.lit("a")).unionByName(parties.withColumn("g", F.lit("b")))
    got = mixing.apportion(both, F.when(F.col("g") == "a", 3).otherwise(50).cast("long"), ["g"], "votes").collect()
    assert sum(r["won"] for r in got if r["g"] == "a") == 3 and sum(r["won"] for r in got if r["g"] == "b") == 50


def test_mixed_documents_repeat_what_the_mix_takes(spark):
    rows = corpus(5, 90) + [(3, "again and again"), (3, "again and again"), (3, "another text of this id"), (None, "no id here")]
    df = frame(spark, rows)
    taken = {}
    for r in mixing._mixed_rows(df, block=4, shard_rows=10).collect():
        if r["size"]:
            key = (r["doc_id"], r["text_hash"])
            taken[key] = taken.get(key, 0) + int(np.floor(r["taken"] / r["size"] + 0.5))
    hashed = mixing.mixed_documents(df, block=4, shard_rows=10).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    got = {}
    for r in hashed:
        got[r["doc_id"], r["h"]] = got.get((r["doc_id"], r["h"]), 0) + 1
    assert got == {k: n for k, n in taken.items() if n}
    assert mixing.mixed_documents(frame(spark, [])).count() == 0


def test_shards_keep_groups_whole(spark):
    rnd = random.Random(4)
    rows = [(k, f"own text number {k} " * rnd.randrange(1, 5)) for k in range(600)]
    for g, n in enumerate([75, 60, 60, 30, 12, 12, 3]):  # of one shard in eight's bytes: up to most of it
        rows += [(len(rows) + k, f"shared text {g} " * 6) for k in range(n)]
    got = sharding.byte_shards(frame(spark, rows), 8).collect()
    where = {}
    for r in got:
        where.setdefault(r["text_sha256"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 8
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    rows += [(len(rows) + k, "one group larger than any shard") for k in range(3000)]  # only this one is cut
    got = sharding.byte_shards(frame(spark, rows), 8).collect()
    where = {}
    for r in got:
        where.setdefault(r["text_sha256"], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) == 1
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 8


def test_levels_take_later_batches(spark):
    rows = [(k, t) for k, t in corpus(13, 60)]
    first, second = [r for r in rows if r[0] % 2], [r for r in rows if r[0] % 2 == 0] + [(500, "only here"), (501, "only  here"), (None, None)]
    old, new = frame(spark, first), frame(spark, second)
    level = exact_dedup.compact(exact_dedup.flush(old))
    kept = exact_dedup.drop_duplicates(old)
    norm = lambda t: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "")
    left, merged = exact_dedup.add_batch(level, kept, new)
    before = {norm(t) for _, t in first}
    want = {}
    for d, t in second:
        if norm(t) not in before:
            want.setdefault(norm(t), []).append(d)
    assert left.columns == new.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(min(x for x in ids if x is not None) for ids in want.values())
    everything = exact_dedup.compact(exact_dedup.flush(old.unionByName(new)))
    show = lambda f: sorted((r["digest"], str(r["first"]["doc_id"]), r["group_size"]) for r in f.collect())
    assert show(merged) == show(everything)
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def test_bpe(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ref = tokenizers.Tokenizer.from_file(path)
    texts = ["", None, "a<|endoftext|>b", "  two  spaces \n x", "naïve 漢字 😀 'll I'm 123abc!!", "x" * 5000, "\t\r\n", "a b", "same", "same"]
    texts += [t for _, t in corpus(2, 30)]
    got = bpe.encode_decode(frame(spark, list(enumerate(texts))), path).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = ref.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == ref.decode(ids, skip_special_tokens=False)


def test_media(spark):
    texts = ["", None, "abc", "é" * 300, "abc", "z" * 192]
    got = {r["doc_id"]: r for r in media.store_media(frame(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        assert bytes(got[k]["payload"]) == raw.ljust(max(192, -(-len(raw) // 192) * 192)) and got[k]["n_bytes"] == len(raw)
    assert got[2]["media"] == got[4]["media"] and got[2]["feature"] == got[4]["feature"]
    broken = bytearray(got[3]["media"])
    broken[60] ^= 1
    with pytest.raises(media.BadMedia):
        media.decode_png(bytes(broken))


@pytest.mark.parametrize(("height", "width", "channels"), [(1, 64, 3), (5, 7, 1), (32, 32, 3), (33, 64, 3), (100, 64, 3), (697, 64, 4)])
def test_feature_takes_every_pixel(height, width, channels):
    rnd = np.random.default_rng(height)
    image = rnd.integers(0, 256, (height, width, channels)).astype(np.uint8)
    side, low = media.SIDE, media.LOW
    edges = lambda k, n: slice(k * n // side, max((k + 1) * n // side, k * n // side + 1))
    small = np.array([[image[edges(y, height), edges(x, width)].mean() for x in range(side)] for y in range(side)])
    wave = np.array([[np.cos(np.pi * (2 * x + 1) * k / (2 * side)) for x in range(side)] for k in range(low)])
    found = np.round(wave @ small @ wave.T, 6).ravel()
    assert media.cosine_hash(image) == np.packbits(found > np.median(found[1:])).tobytes().hex()
    if height > side:  # what differs only between the corners of the cells
        other = 255 - image
        tall, wide = np.arange(side) * height // side, np.arange(side) * width // side
        other[np.ix_(tall, wide)] = image[np.ix_(tall, wide)]
        assert media.cosine_hash(other) != media.cosine_hash(image)


def test_png_filters_and_channels():
    rnd = np.random.default_rng(0)
    for channels in (1, 2, 3, 4):
        image = rnd.integers(0, 256, (7, 5, channels)).astype(np.uint8)
        assert (media.decode_png(media.encode_png(image)) == image).all()
    want = rnd.integers(0, 256, (6, 12)).astype(int)  # the filters as the format defines them, three bytes a pixel
    rows = np.zeros((6, 13), np.uint8)
    for y in range(6):
        rows[y, 0] = kind = y % 5
        for x in range(12):
            a, b = want[y, x - 3] if x > 2 else 0, want[y - 1, x] if y else 0
            c = want[y - 1, x - 3] if x > 2 and y else 0
            near = min((a, b, c), key=lambda v: (abs(a + b - c - v), [a, b, c].index(v)))
            rows[y, 1 + x] = (want[y, x] - [0, a, b, (a + b) // 2, near][kind]) % 256
    assert (media._unfilter(rows, 3) == want).all()


def test_quality(spark):
    rnd = random.Random(4)
    rows = [(k, " ".join(f"w{rnd.randrange(200)}" for _ in range(60)) if k % 4 else "SPAM!! " * 40) for k in range(400)] + [(None, None), (900, ""), (900, "")]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(400)] + [(None, 1, 0), (901, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    tested = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert len(tested) > 40 and all(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in tested)
    assert quality.keep_good(frame(spark, rows), labels).where("text like 'SPAM%'").count() == 0
    assert {r["score"] for r in quality.quality_scores(frame(spark, rows), labels.limit(0)).collect()} == {0.5}


def test_licenses(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License.\nmore"), (2, "a/b/x.py", "# nothing here"), (3, "a/b/c/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/c/y.py", None), (5, "a/b/c/z.py", "text\nLicensed under CC BY-NC 4.0.\n"), (6, "top.py", "print"), (7, None, ""), (8, "q/r/s.py", "the license of the and version"),
    ]
    df = spark.createDataFrame([(d, p, t, "x") for d, p, t in files], "doc_id long, path string, text string, license string")
    got = {r["doc_id"]: (r["own_license"], r["license"], r["inherited_from"]) for r in licenses.scan_licenses(df, F.col("path")).collect()}
    assert got == {
        1: ("MIT", "MIT", None), 2: (None, "MIT", "a"), 3: ("Apache-2.0", "Apache-2.0", None), 4: (None, "Apache-2.0", "a/b/c"),
        5: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 6: (None, None, None), 7: (None, None, None), 8: (None, None, None),
    }
    shapes = licenses.Templates(licenses.TEMPLATES, {"the": 50, "license": 5}, 100, 0.6)
    loose = licenses.Templates(licenses.TEMPLATES, {"the": 50, "license": 5}, 100, 0.6)
    loose.needed = loose.vocabulary
    rnd = random.Random(1)
    for _ in range(500):
        line = " ".join(rnd.choice(sorted(shapes.vocabulary) + ["zzz"]) for _ in range(rnd.randrange(1, 14)))
        assert shapes.closest(line) == loose.closest(line)


def test_licenses_at_the_root_and_over_lines(spark):
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version {}\n\n Everyone is permitted to copy"
    files = [
        (1, "LICENSE", "Released under the MIT License."), (2, "src/a.py", ""), (3, "top.py", "x"), (4, "/abs/b.py", ""), (5, None, ""), (6, "lib/COPYING", gpl.format("3, 29 June 2007")), (7, "lib/x/y.py", ""),
        (8, "old/COPYING", gpl.format("2, June 1991")), (9, "old/z.py", ""), (10, "/LICENSE", "Licensed under CC BY 4.0"), (11, "w.py", "# Licensed under the\n# Apache License,\n#\n# Version 2.0\nimport os"),
    ]
    files += [(k, f"v/{k}.txt", "version 2 of 2\nthe gnu general public license") for k in range(20, 40)]  # a common 2 favours GPL-2.0 by the heading alone
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["own_license"], r["license"], r["inherited_from"]) for r in licenses.scan_licenses(df, F.col("path")).collect()}
    assert {k: got[k] for k in range(1, 12)} == {
        1: ("MIT", "MIT", None), 2: (None, "MIT", ""), 3: (None, "MIT", ""), 4: (None, "CC-BY-4.0", "/"), 5: (None, None, None), 6: ("GPL-3.0", "GPL-3.0", None), 7: (None, "GPL-3.0", "lib"),
        8: ("GPL-2.0", "GPL-2.0", None), 9: (None, "GPL-2.0", "old"), 10: ("CC-BY-4.0", "CC-BY-4.0", None), 11: ("Apache-2.0", "Apache-2.0", None),
    }


def test_full_licence_texts_of_headers_and_files(spark):
    import math
    import textwrap

    wrap = lambda name, mark="": "\n".join(mark + line for line in textwrap.wrap(licenses.FULL_TEXTS[name][0], 70))
    code = "\n\nimport os\n" + "def f(x):\n    return x + 1\n" * 50
    files = [(1, "a/LICENSE", "Copyright 2020 Someone\n\n" + wrap("MIT")), (2, "a/x.py", "# Copyright Someone\n" + wrap("BSD-3-Clause", "# ") + code), (3, "b/LICENSE", wrap("BSD-2-Clause")), (4, "b/y.c", " * " + wrap("ISC", " * ") + code),
             (5, "b/z.c", code), (6, "a/w.c", "merchantability of the goods " * 80), (7, "c/LICENSE", "x " * 70_000 + wrap("MIT"))]
    rows = files + files[:1]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: (r["own_license"], r["license"]) for r in got}
    assert {d: x[0] for d, x in found.items() if d < 7} == {1: "MIT", 2: "BSD-3-Clause", 3: "BSD-2-Clause", 4: "ISC", 5: None, 6: None}
    assert found[5][1] == "BSD-2-Clause" and found[6][1] == "MIT"
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, path string, text string"), F.col("path")).count() == 0
    # the same cosines by plain dictionaries over whole texts
    frequency, n = {"the": 900, "software": 40, "copyright": 60, "x": 5}, 1000
    shapes = licenses.Templates(licenses.FULL_TEXTS, frequency, n, 0.6)
    weight = lambda t: math.log((1 + n) / (1 + (frequency.get(t, 0) if t in shapes.vocabulary else 0))) + 1
    vector = lambda text: {t: k * weight(t) for t, k in licenses.terms(text).items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for _, _, text in files:
        v = vector(text)
        cosines = {name: sum(x * v.get(t, 0) for t, x in vector(full).items()) / (length(vector(full)) * length(v) or 1) for name, (full,) in licenses.FULL_TEXTS.items()}
        best = max(sorted(cosines), key=lambda k: round(cosines[k], 9))
        want = None if cosines[best] < 0.6 else best
        closest = shapes.closest(text)
        assert (closest and closest[1]) == want and (not closest or abs(closest[0] - cosines[best]) < 1e-9)


def test_license_runs_by_brute_force():
    shapes = licenses.Templates(licenses.TEMPLATES, {"the": 50, "license": 5, "version": 9}, 100, 0.6)
    rnd = random.Random(2)
    names = sorted(shapes.vocabulary) + ["zzz"] * 20
    for _ in range(60):
        lines = [" ".join(rnd.choice(names) for _ in range(rnd.randrange(4))) for _ in range(rnd.randrange(30))]
        notice = rnd.choice([n for notices in licenses.TEMPLATES.values() for n in notices]).split()
        lines[3:3] = [" ".join(notice[k : k + 3]) for k in range(0, len(notice), 3)]
        full = [x for x in lines if licenses.terms(x)]
        best = max((shapes.closest(" ".join(full[i:j])) or (0, "") for i in range(len(full)) for j in range(i + 1, min(len(full), i + shapes.most_lines) + 1)), key=lambda x: x[0])
        assert abs(shapes.closest_run("\n".join(lines))[0] - best[0]) < 1e-9
