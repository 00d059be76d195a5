"""Jaccard join of word n-gram sets by T-occurrence search (DivideSkip), as connected components of the links.

Which sets are searched together is settled by rare evidence, without losing a link:

1. A set of n shingles that is linked with another has at most D = n - ceil(similarity * n) shingles which the other
   lacks. Tasks send a share of their shingles, chosen by hash, to buckets, which find those that two documents have. A
   set with more than D shingles that no other document has is linked with nothing and is done.
2. The sets that are left order their shingles by document frequency among them, rarest first. Two linked sets
   share one of their first D + 1 (the prefix filter), so sets that meet in such a shingle come into one cluster.
3. Each cluster, in blocks of bounded size, is an inverted index. A set is searched in it by T-occurrence: its short
   lists are merged on a heap, what the merge finds often enough is looked up in its long lists by binary probes, and
   what reaches the required overlap is linked. Components need no more than the sets outside the largest component of
   a cluster as queries: any link between components has an end there. Of a cluster with several blocks a query goes
   only to those that hold one of its first shingles.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, text_of, written
from .components import components
from .routing import KEY_BITS, PACKED, U64, _dealt, _frame, _group_starts, _mixed, _powers, _unpack, doc_bucket, word_units

#: Least similarity as a fraction: 100 * intersection >= 90 * union.
SIMILARITY = (9, 10)
#: Sets of fewer shingles send all of them, larger ones a share that is this many times D.
SMALL = 200
SPREAD = 2.5
#: Sets in a block; clusters of more are searched in several blocks. First queries of such a cluster.
BLOCK = 1000
#: Entries of short lists that are merged on a heap; more are counted.
MERGE = 2048
HUBS = 8
#: Shingles that a task holds before it sends them, and buckets of shingles for each shuffle partition.
FLUSH = 1 << 19
FINER = 2
PLACE = np.dtype([("key", "u8"), ("doc", "i8")])
KEY = np.dtype([("key", "u8")])
COUNT = np.dtype([("doc", "i8"), ("n", "i8")])
NEED = np.dtype([("doc", "i8"), ("size", "i8"), ("need", "i8"), ("head", "i8"), ("tail", "i8")])
PAIR = np.dtype([("a", "i8"), ("b", "i8")])
#: Needed by a set that is no candidate: it is empty, or equal to another that stands for it.
NEVER = 1 << 40


def shingles(raw: bytes, n: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text in lower case (A-Z only); of fewer words, of all as one."""
    body, starts, ends = word_units(raw.lower())
    if not len(starts):
        return np.zeros(0, U64)
    k = min(n, len(starts))
    data = np.frombuffer(body, np.uint8)
    up, down = _powers(1 << len(data).bit_length())
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(up[: len(data)] * (data + U64(1)), out=sums[1:])
    begin, end = starts[: len(starts) - k + 1], ends[k - 1 :]
    return np.unique(_mixed(_mixed((sums[end] - sums[begin]) * down[begin]) ^ (end - begin).astype(U64)))


def missing(n: int, similarity: tuple[int, int] = SIMILARITY) -> int:
    """How many of its n shingles a set may have that a set it is linked with lacks."""
    part, whole = similarity
    return n - -(-part * n // whole)


def _evidence(n: int, n_docs: int, words: int, similarity: tuple[int, int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per task: shingles of the sets it met, one document for equal sets; links of the others to it; what each set needs.

    Kinds of rows: 0 shingles with their document, 1 shingles of documents that do not count them, 2 shingles that two
    documents of the task have; 3 shared shingles of a document, 4 what it needs, 5 links.
    """
    part, whole = similarity
    every = max(1, int(1 / (SPREAD * max(0.01, 1 - part / whole))))
    key_bits = U64((1 << KEY_BITS) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: dict[bytes, int] = {}
        tokens: list[np.ndarray] = []
        owners: list[tuple[int, int, bool]] = []  # document, shingles sent, all of them count
        links: list[tuple[int, int]] = []
        size = 0

        def send() -> pd.DataFrame:
            keys = np.concatenate(tokens) if tokens else np.zeros(0, U64)
            sent, docs = [o[1] for o in owners], np.array([o[0] for o in owners], np.int64)
            doc = np.repeat(docs, sent)
            counted = np.repeat(np.array([o[2] for o in owners], bool), sent) | ((keys >> U64(8)) % U64(every) == 0)
            order = np.argsort(keys, kind="stable")
            keys, doc, counted = keys[order], doc[order], counted[order]
            at = _group_starts(keys)
            long = np.diff(np.r_[at, len(keys)])
            two = np.repeat(np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at), long) if len(at) else np.zeros(0, bool)
            met, times = np.unique(doc[two & counted], return_counts=True)
            bucket = ((keys >> U64(KEY_BITS)) % U64(n)).astype(np.int64)
            rows = []
            for kind, chosen in ((0, ~two & counted), (1, ~two & ~counted)):
                rows += _dealt(kind, bucket[chosen], _array(PLACE, keys[chosen] & key_bits, doc[chosen]))
            known = at[two[at]] if len(at) else at
            rows += _dealt(2, bucket[known], _array(KEY, keys[known] & key_bits))
            rows += _dealt(3, doc_bucket(met, n_docs), _array(COUNT, met, times))
            pairs = np.array(links, np.int64).reshape(-1, 2)
            rows += _dealt(5, doc_bucket(pairs[:, 0], n_docs), _array(PAIR, pairs[:, 0], pairs[:, 1]))
            return _frame(rows)

        for batch in batches:
            needs: list[tuple[int, int, int, int, int]] = []
            for doc, text in zip(batch["doc"].tolist(), batch["text"], strict=True):
                own = shingles(text.encode("utf-8", "replace"), words)
                k = len(own)
                digest = _digest(own)
                same = first.setdefault(digest, doc) if k else doc
                if not k or same != doc:
                    needs.append((doc, k, NEVER, 0, 0))
                    if k:
                        links.append((doc, same))
                    continue
                chosen = (own >> U64(8)) % U64(every) == 0
                n_counted = k if k < SMALL else int(chosen.sum())
                sent = own if k * part < SMALL * whole else own[chosen]
                needs.append((doc, k, n_counted - missing(k, similarity), *np.frombuffer(digest, np.int64).tolist()))
                owners.append((doc, len(sent), k < SMALL))
                tokens.append(sent)
                size += len(sent)
            table = np.array(needs, np.int64).reshape(-1, 5)
            yield _frame(_dealt(4, doc_bucket(table[:, 0], n_docs), _array(NEED, *table.T)))
            if size >= FLUSH:
                yield send()
                first, tokens, owners, links, size = {}, [], [], [], 0
        yield send()

    return run


def _digest(tokens: np.ndarray) -> bytes:
    from hashlib import blake2b

    return blake2b(tokens.tobytes(), digest_size=16).digest()


class Groups:
    """Union-find over node numbers, roots the least."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        self.up.setdefault(min(x, y), min(x, y))
        return True


ROWS = "kind int, a long, b long"
JUDGED = ROWS + ", c long"


def _rows(kind: int, a, b) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(a), kind, np.int32), "a": np.asarray(a, np.int64), "b": np.asarray(b, np.int64)})


def _array(dtype: np.dtype, *columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(columns[0]), dtype)
    for name, column in zip(dtype.names or (), columns, strict=True):
        out[name] = column
    return out


def _met(n_docs: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Shingles of a bucket that two documents have, as counts of their documents."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        counting, other = _unpack(group, 0, PLACE), _unpack(group, 1, PLACE)
        known = np.unique(_unpack(group, 2, KEY)["key"])
        counts = np.repeat([True, False], [len(counting), len(other)])
        both = np.concatenate([counting, other])
        order = np.argsort(both["key"], kind="stable")
        both, counts = both[order], counts[order]
        at = _group_starts(both["key"])
        if not len(at):
            return _frame([])
        two = np.minimum.reduceat(both["doc"], at) != np.maximum.reduceat(both["doc"], at)
        two |= np.isin(both["key"][at], known)
        chosen = np.repeat(two, np.diff(np.r_[at, len(both)])) & counts
        doc, times = np.unique(both["doc"][chosen], return_counts=True)
        return _frame(_dealt(3, doc_bucket(doc, n_docs), _array(COUNT, doc, times)))

    return run


def _left(group: pd.DataFrame) -> pd.DataFrame:
    """Documents that may be linked, with the digest of their set (kind 0), links of equal sets (1), set sizes (2)."""
    need, met, links = _unpack(group, 4, NEED), _unpack(group, 3, COUNT), _unpack(group, 5, PAIR)
    need = need[np.argsort(need["doc"], kind="stable")]
    docs = np.unique(need["doc"])
    have = np.zeros(len(docs), np.int64)
    np.add.at(have, np.searchsorted(docs, met["doc"]), met["n"])
    left = need[have[np.searchsorted(docs, need["doc"])] >= need["need"]]
    parts = [_rows(0, left["doc"], left["head"]).assign(c=left["tail"]), _rows(1, links["a"], links["b"]).assign(c=0), _rows(2, need["doc"], need["size"]).assign(c=0)]
    return pd.concat(parts)


class Index:
    """Inverted lists of a block of sets."""

    def __init__(self, sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY):
        self.part, self.whole = similarity
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        tokens = np.concatenate(sets) if sets else np.zeros(0, U64)
        order = np.lexsort((owner, tokens))
        tokens = tokens[order]
        at = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
        self.tokens = tokens[at]
        self.begin = np.r_[at, len(tokens)]
        self.owner = owner[order]

    def search(self, query: np.ndarray, skip: Callable[[int], bool] = lambda k: False) -> list[int]:
        """The sets whose similarity to the query is enough, but for those that skip() says are of no interest by now."""
        n = len(query)
        place = np.searchsorted(self.tokens, query)
        place = np.minimum(place, len(self.tokens) - 1)
        place = place[self.tokens[place] == query]
        required = -(-self.part * n // self.whole)  # overlap with the smallest set that can be linked
        if len(place) < required:
            return []
        lengths = self.begin[place + 1] - self.begin[place]
        order = np.argsort(lengths, kind="stable")
        place, lengths = place[order], lengths[order]
        lists = [self.owner[b:e] for b, e in zip(self.begin[place].tolist(), self.begin[place + 1].tolist(), strict=True)]
        n_long = min(required - 1, int(required / (0.01 * math.log2(max(2, int(lengths[-1]))) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        found, count = _merge(short, int(lengths[: len(short)].sum()), len(self.sizes))
        wanted = count >= required - n_long
        found, count = found[wanted], count[wanted]
        wanted = np.fromiter((not skip(k) for k in found.tolist()), bool, len(found))
        found, count = found[wanted], count[wanted]
        need = -(-self.part * (n + self.sizes[found]) // (self.part + self.whole))
        for left, members in zip(range(len(long), 0, -1), long, strict=True):
            wanted = count + left >= need
            if not wanted.all():
                found, count, need = found[wanted], count[wanted], need[wanted]
            if not len(found):
                break
            at = np.minimum(np.searchsorted(members, found), len(members) - 1)
            count = count + (members[at] == found)
        return found[count >= need].tolist()


def _merge(lists: list[np.ndarray], total: int, n_sets: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets in short lists, in order, and in how many of them each is: on a heap, or by counting where the lists hold many."""
    if total > MERGE:
        count = np.bincount(np.concatenate(lists), minlength=n_sets)
        found = np.flatnonzero(count)
        return found, count[found]
    runs = [(k, sum(1 for _ in run)) for k, run in groupby(heapq.merge(*[x.tolist() for x in lists]))]
    table = np.array(runs, np.int64).reshape(-1, 2)
    return table[:, 0], table[:, 1]


def link_cluster(nodes: list[int], sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY) -> list[tuple[int, int]]:
    """(node, least node of its component) within one block that is a whole cluster."""
    index, groups = Index(sets, similarity), Groups()
    ids = list(range(len(sets)))
    size = {k: 1 for k in ids}
    asked: set[int] = set()
    # the set that shares most shingles with others first: in a group of near copies it finds nearly all
    shared = np.repeat(np.diff(index.begin), np.diff(index.begin))
    weight = np.bincount(index.owner, weights=shared, minlength=len(sets))
    order = np.argsort(-weight, kind="stable").tolist()
    largest = -1
    # a set skipped in a component that another one overtakes is asked later: in the end all outside the largest have been
    while left := [k for k in order if k not in asked and groups.root(k) != largest]:
        for k in left:
            if groups.root(k) == largest:
                continue
            asked.add(k)
            for other in index.search(sets[k], lambda x, k=k: groups.root(x) == groups.root(k)):
                a, b = groups.root(k), groups.root(other)
                if groups.join(k, other):
                    size[min(a, b)] = size[a] + size[b]
            if largest < 0 or size[groups.root(k)] > size[groups.root(largest)]:
                largest = groups.root(k)
            largest = groups.root(largest)
    least: dict[int, int] = {}
    for k in ids:
        r = groups.root(k)
        least[r] = min(least.get(r, nodes[k]), nodes[k])
    return [(nodes[k], least[groups.root(k)]) for k in ids if nodes[k] != least[groups.root(k)]]


def _sets_of(words: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                sets = [shingles(t.encode("utf-8", "replace"), words) for t in part["text"]]
                yield pd.DataFrame({"node": part["node"], "n": [len(x) for x in sets], "tokens": [x.view(np.int64) for x in sets]})

    return run


def _first_shingles(sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(node, token): the first D + 1 shingles of each set by document frequency, without those that no other set has.

    A set with more than D of the latter is left out. Counts combine on the map side; a shingle that very many sets have
    is a skewed key of the join, which splits, and never stands in one group.
    """
    part, whole = similarity
    tokens = sets.select("node", "n", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    need = F.ceil(F.col("n") * part / whole)
    nth = F.row_number().over(Window.partitionBy("node").orderBy("df", "token"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("node"))
    ranked = tokens.join(often, "token").select("node", "token", "n", nth.alias("nth"), shared.alias("shared"))
    return ranked.where((F.col("shared") >= need) & (F.col("nth") <= F.col("shared") - need + 1)).select("node", "token")


def _link_bucket(similarity: tuple[int, int]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, part in group.groupby("cluster"):
            out += link_cluster(part["node"].tolist(), [t.view(U64) for t in part["tokens"]], similarity)
        return _rows(1, [x for x, _ in out], [y for _, y in out])

    return run


def _search_block(similarity: tuple[int, int]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Queries of a cluster against one of its blocks; of a component of the queries one link to each set is enough."""

    def run(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        nodes = block["node"].tolist()
        index, out = Index([t.view(U64) for t in block["tokens"]], similarity), []
        groups = Groups()
        number = {node: k for k, node in enumerate(nodes)}
        for node, tokens in sorted(zip(queries["node"].tolist(), queries["tokens"], strict=True)):
            own = number.setdefault(node, len(number))
            for k in index.search(tokens.view(U64), lambda x, own=own: groups.root(x) == groups.root(own)):
                if groups.join(own, k):
                    out.append((node, nodes[k]))
        return _rows(1, [x for x, _ in out], [y for _, y in out])

    return run


def _search_large(tokens: DataFrame, first: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links of clusters with several blocks: a few hubs first, then all sets outside the largest component.

    A query meets only the blocks that hold one of its first shingles, so it is sent no oftener than it has partners.
    """
    first = first.join(tokens.select("node", "cluster", "block"), "node")
    held = first.select("token", "cluster", "block").distinct()

    def asked(queries: DataFrame) -> DataFrame:
        goes = first.join(queries.select("node").distinct(), "node", "left_semi").select("node", "token", "cluster")
        goes = goes.join(held, ["token", "cluster"]).select("node", "cluster", "block").distinct()
        sent = goes.join(queries.select(*[F.col(c).alias(c) for c in ("node", "tokens")]), "node")
        sent = sent.select(*[F.col(c).alias(c) for c in ("cluster", "block", "node", "tokens")])  # names of their own
        return tokens.groupBy("cluster", "block").cogroup(sent.groupBy("cluster", "block")).applyInPandas(_search_block(similarity), ROWS)

    by_hash = F.row_number().over(Window.partitionBy("cluster", "block").orderBy(F.xxhash64("node")))
    hubs = tokens.withColumn("__nth", by_hash).where(f"__nth = 1 and block < {HUBS}")
    links = written(asked(hubs), "hub-links")
    roots = components(links, name="hub-components")
    placed = tokens.select("cluster", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = placed.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = written(counts.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("largest")), "largest")
    outside = written(placed.join(largest, "cluster").where("root <> largest").select("node"), "outside")
    rest = tokens.join(outside, "node", "left_semi")
    return links.unionByName(written(asked(rest), "rest-links"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, similarity: tuple[int, int] = SIMILARITY,
                     block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a set is the distinct n-word shingles, or the whole
    sequence where there are fewer words. Documents link when intersection / union is at least the similarity (a fraction); component_id is the smallest id
    reachable by links. A text that is null or has no words has an empty set and is its own component. Rows that repeat an
    id are one document with several texts: they share a component. A null id links with nothing and its component is null. Ids
    are whole numbers. An empty table gives an empty result.
    """
    width = shuffle_width(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text"))
    known = named.where("doc is not null")
    evidence = written(known.mapInPandas(_evidence(width * FINER, width, n, similarity), PACKED), "evidence")
    met = evidence.where("kind < 3").groupBy("bucket").applyInPandas(_met(width), PACKED)
    judged = written(evidence.where("kind >= 3").unionByName(met).groupBy("bucket").applyInPandas(_left, JUDGED), "judged", compression="zstd")

    # of equal sets one goes on, and the others are linked with it
    left = judged.where("kind = 0")
    one_of = left.groupBy("b", "c").agg(F.min("a").alias("node"))
    equal = left.join(one_of, ["b", "c"]).where("a <> node").select(F.lit(1).alias("kind"), "a", F.col("node").alias("b"))
    # a merge join at every size: the sets that are left grow with the input, and their shingles are made in one pass
    texts = known.withColumnRenamed("doc", "node").join(one_of.select("node").distinct().hint("merge"), "node")
    sets = written(texts.mapInPandas(_sets_of(n), "node long, n long, tokens array<long>"), "sets")
    first = written(_first_shingles(sets, similarity), "first-shingles", compression="zstd")
    least = first.groupBy("token").agg(F.min("node").alias("least"))
    met_in = first.join(least, "token").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))

    clusters = components(met_in, name="clusters")
    members = clusters.select("node", F.col("root").alias("cluster")).unionByName(clusters.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct())
    counted = clusters.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("n_sets")).withColumnRenamed("root", "cluster")
    members = members.join(counted, "cluster").withColumn("n_blocks", F.ceil(F.col("n_sets") / block).cast("int"))
    members = written(members, "members").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    members = members.withColumn("bucket", F.pmod(F.xxhash64("cluster"), F.lit(width * FINER)).cast("int"))
    tokens = members.join(sets.select("node", "tokens"), "node")
    links = tokens.where("n_blocks = 1").groupBy("bucket").applyInPandas(_link_bucket(similarity), ROWS)
    links = written(links.unionByName(judged.where("kind = 1").drop("c")).unionByName(equal), "links")
    if not members.where("n_blocks > 1").isEmpty():
        large = written(tokens.where("n_blocks > 1"), "large-clusters")
        links = links.unionByName(_search_large(large, first, similarity))
    roots = components(links, name="linked")
    sized = judged.where("kind = 2").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    found = sized.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    if named.where("doc is null").isEmpty():
        return found

    @F.pandas_udf("long")  # type: ignore[call-overload]
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(shingles(t.encode("utf-8", "replace"), n)))

    nameless = named.where("doc is null").select(F.col("doc").alias("doc_id"), count("text").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return found.unionByName(nameless)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each component, that with the smallest id; every column stays. Rows without an id stay."""
    found = ngram_components(docs, id_col, text_col, **options)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
