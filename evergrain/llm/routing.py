"""Exact repeats across documents: bringing together, without loss, all places where a window could repeat.

A window is `width` consecutive units (words or bytes) of one document. Its anchor is the smallest hash among the k-unit
grams inside it, so equal windows have equal anchors wherever they stand, and consecutive windows mostly share one: they
form a run. Runs are what is moved, in packed arrays:

1. every task hashes its documents into runs and sends them to their anchor's bucket; a bucket finds the anchors
   that two documents share. Runs that a task already knows to be shared go straight to their document, and only the
   anchor is sent: a hot anchor costs a bucket one entry for each task, not one for each document;
2. the shared runs meet their document's text and take their own text along, again once for each task: in a task
   all but the smallest document with the same text of a run are known to repeat it;
3. a block of runs with the same anchors is handed to a resolver, which indexes it and finds the windows that
   start in a smaller document too;
4. the windows found go back to their documents.

Buckets are as many as shuffle partitions, and each is worked on in blocks of bounded size, so memory follows the
session's partitioning and not the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, text_of

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at a time, runs held by a task before it sends them, units in a block.
SLICE = 1 << 19
FLUSH = 1 << 20
BLOCK = 400_000
OCCURRENCE = np.dtype([("key", "u8"), ("doc", "i8"), ("twin", "i8"), ("start", "u4"), ("count", "u4")])
KEY = np.dtype([("key", "u8")])
SPAN = np.dtype([("doc", "i8"), ("twin", "i8"), ("start", "u4"), ("count", "u4")])

#: Bits of an anchor that are sent; the bits above choose its bucket. Two anchors that look alike by this cost work, never a result.
KEY_BITS = 40

#: A resolver: (texts of runs, smallest document of each, windows in each) -> for each text the windows that repeat, as bools.
Resolver = Callable[[list[bytes], np.ndarray, np.ndarray], list[np.ndarray]]


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _made_powers(2 * SLICE)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse at least; those for more than two slices are made for one call only."""
    return _kept_powers() if n <= 2 * SLICE else _made_powers(n)


def _made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, U64), np.full(n, BASE_INVERSE, U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def word_units(raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, and where each begins and ends."""
    words = raw.split()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), ends - lengths, ends


class _Places:
    """Where each byte begins (plus 0) or ends (plus 1), without an array of them."""

    def __init__(self, n: int, plus: int):
        self.n, self.plus = n, plus

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at):
        return at + self.plus

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return np.arange(self.plus, self.n + self.plus, dtype=dtype or np.int64)


def byte_units(raw: bytes) -> tuple[bytes, _Places, _Places]:
    return raw, _Places(len(raw), 0), _Places(len(raw), 1)


class Units:
    """How documents fall into units: "words" or "bytes", windows of `width` units, anchors of `gram` units."""

    def __init__(self, kind: str, width: int, gram: int):
        self.cut = {"words": word_units, "bytes": byte_units}[kind]
        self.kind, self.width, self.gram = kind, width, gram

    def pieces(self, raw: bytes) -> Iterator[tuple[int, bytes]]:
        """(first unit, piece): a long text in pieces of about SLICE bytes that overlap so that each window lies in one of them."""
        if len(raw) <= 2 * SLICE:
            yield 0, raw
            return
        units = raw if self.kind == "bytes" else raw.split()
        step = SLICE if self.kind == "bytes" else SLICE // 8
        for at in range(0, max(1, len(units) - self.width + 1), step):
            piece = units[at : at + step + self.width - 1]
            yield at, piece if isinstance(piece, bytes) else b" ".join(piece)

    def runs(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document number, anchor, first window, windows) of all runs."""
        parts, starts, ends, counts, at = [], [], [], [], 0
        for raw in raws:
            body, s, e = self.cut(raw)
            parts.append(body)
            starts.append(np.asarray(s) + at)
            ends.append(np.asarray(e) + at)
            counts.append(len(s))
            at += len(body)
        n_units, spans = sum(counts), self.width - self.gram + 1
        if n_units < self.width:
            return tuple(np.zeros(0, t) for t in (np.int64, U64, np.int64, np.int64))  # type: ignore[return-value]
        data = np.frombuffer(b"".join(parts), np.uint8)
        begin, end = np.concatenate(starts), np.concatenate(ends)
        up, down = _powers(1 << int(at).bit_length())
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(up[: len(data)] * (data + U64(1)), out=sums[1:])
        last = n_units - self.gram + 1
        grams = _mixed((sums[end[self.gram - 1 :]] - sums[begin[:last]]) * down[begin[:last]])
        least, have = grams, 1  # smallest of `have` grams from each on, by doubling
        while have < spans:
            more = min(have, spans - have)
            least = np.minimum(least[:-more], least[more:])
            have += more
        counted = np.array(counts)
        first = np.cumsum(counted) - counted
        n_windows = np.maximum(0, counted - self.width + 1)
        doc = np.repeat(np.arange(len(raws)), n_windows)
        nth = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        anchor = least[first[doc] + nth]
        if not len(anchor):
            return doc, anchor, nth, nth
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
        return doc[new], anchor[new], nth[new], np.diff(np.r_[new, len(anchor)])


def _group_starts(sorted_key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]]) if len(sorted_key) else np.zeros(0, np.int64)


def _ranges(at: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Beginnings to (beginning, end) pairs."""
    begins = [int(x) for x in at]
    return list(zip(begins, [*begins[1:], n], strict=True)) if begins else []


def _shared(occ: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Of occurrences sorted by key: those whose key two documents have, or that is known."""
    at = _group_starts(occ["key"])
    if not len(at):
        return np.zeros(0, bool)
    two = np.minimum.reduceat(occ["doc"], at) != np.maximum.reduceat(occ["doc"], at)
    two |= np.isin(occ["key"][at], known)
    return np.repeat(two, np.diff(np.r_[at, len(occ)]))


def _bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    return (_mixed(key) % U64(n)).astype(np.int64)


def doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    """pmod(xxhash64(doc), n) as Spark computes it for a long, so that both sides of a join agree."""
    p1, p2, p3, p4, p5 = (U64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    turn = lambda x, k: (x << U64(k)) | (x >> U64(64 - k))
    with np.errstate(over="ignore"):
        h = (U64(42) + p5 + U64(8)) ^ (turn(doc.astype(np.int64).view(U64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> U64(33))) * p2
        h = (h ^ (h >> U64(29))) * p3
        h ^= h >> U64(32)
    return (h.view(np.int64) % n).astype(np.int64)


def pack(data: np.ndarray) -> bytes:
    """Columns one after the other, each less its smallest value, in as few bytes as its largest then takes."""
    out = [np.array([len(data)], "i8").tobytes()]
    for name in data.dtype.names or ():
        column = np.ascontiguousarray(data[name]).astype(data.dtype[name])
        low = column.min() if len(column) else column.dtype.type(0)
        above = (column - low).view(f"u{column.itemsize}")
        size = max(1, (int(above.max()).bit_length() + 7) // 8) if len(above) else 1
        wide = above.astype("<u8").view("u1").reshape(-1, 8)
        out += [np.array([low]).astype(column.dtype).tobytes(), bytes([size]), wide[:, :size].tobytes()]
    return b"".join(out)


def unpack(packed: bytes, dtype: np.dtype, at: int = 0) -> tuple[np.ndarray, int]:
    """What pack() took, and where it ends."""
    n = int(np.frombuffer(packed, "i8", 1, at)[0])
    at += 8
    out = np.empty(n, dtype)
    for name in dtype.names or ():
        low = np.frombuffer(packed, dtype[name], 1, at)[0]
        at += dtype[name].itemsize
        size = packed[at]
        wide = np.zeros((n, 8), "u1")
        wide[:, :size] = np.frombuffer(packed, "u1", n * size, at + 1).reshape(n, size)
        at += 1 + n * size
        out[name] = wide.view("<u8").ravel().astype(f"u{dtype[name].itemsize}").view(dtype[name]) + low
    return out, at


def _dealt(kind: int, bucket: np.ndarray, data: np.ndarray) -> list[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    at = _group_starts(bucket[order])
    return [(int(bucket[order[a]]), kind, pack(data[order[a:b]])) for a, b in _ranges(at, len(order))]


def _frame(rows: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "kind", "packed"]).astype({"bucket": "int32", "kind": "int32"})


PACKED = "bucket int, kind int, packed binary"


def _unpack(frame: pd.DataFrame, kind: int, dtype: np.dtype) -> np.ndarray:
    found = [unpack(x, dtype)[0] for x in frame["packed"][frame["kind"] == kind]]
    return np.concatenate(found) if found else np.zeros(0, dtype)


def _find_runs(units: Units, n: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def send(held: list[np.ndarray]) -> pd.DataFrame:
        occ = np.concatenate(held)
        occ = occ[np.argsort(occ["key"], kind="stable")]
        here = _shared(occ, np.zeros(0, U64))
        above = ((occ["key"] >> U64(KEY_BITS)) % U64(n)).astype(np.int64)
        occ["key"] &= U64((1 << KEY_BITS) - 1)
        known = occ[here]
        firsts = _group_starts(known["key"])
        keys = known[firsts][["key"]].astype(KEY)
        return _frame(_dealt(0, above[~here], occ[~here]) + _dealt(1, doc_bucket(known["doc"], n), known) + _dealt(2, above[here][firsts], keys))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for batch in batches:
            ids, twins = batch["doc"].to_numpy(), batch["twin"].to_numpy()
            some: list[tuple[int, int, bytes]] = []
            size = 0
            cut = ((k, at, piece) for k, text in enumerate(batch["text"]) for at, piece in units.pieces(text.encode("utf-8", "replace")))
            for k, at, piece in chain(cut, [(-1, 0, b"")]):
                if some and (k < 0 or size >= SLICE):
                    part, anchor, first, count = units.runs([p for _, _, p in some])
                    row, before = np.array([r for r, _, _ in some]), np.array([b for _, b, _ in some])
                    occ = np.empty(len(part), OCCURRENCE)
                    occ["key"], occ["doc"], occ["twin"], occ["start"], occ["count"] = anchor, ids[row[part]], twins[row[part]], before[part] + first, count
                    held.append(occ)
                    some, size = [], 0
                    if sum(map(len, held)) >= FLUSH:
                        yield send(held)
                        held = []
                some.append((k, at, piece))
                size += len(piece)
        if held:
            yield send(held)

    return run


def _keep_shared(n: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        occ = _unpack(group, 0, OCCURRENCE)
        occ = occ[np.argsort(occ["key"], kind="stable")]
        shared = [occ[_shared(occ, _unpack(group, 2, KEY)["key"])], _unpack(group, 1, OCCURRENCE)]
        return _frame([row for part in shared for row in _dealt(1, doc_bucket(part["doc"], n), part)])

    return run


def _take_texts(units: Units, n: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(docs: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        occ = _unpack(packed, 1, OCCURRENCE)
        if not len(occ):
            return _frame([])
        occ = occ[np.lexsort((occ["start"], occ["twin"], occ["doc"]))]
        docs = docs[docs["known"]]  # a null id stands as 0 here and must not hide the text of document 0
        texts = {(d, t): x for d, t, x in zip(docs["doc"], docs["twin"], docs["text"], strict=True)}
        at = np.flatnonzero(np.r_[True, (occ["doc"][1:] != occ["doc"][:-1]) | (occ["twin"][1:] != occ["twin"][:-1])])
        seen: dict[tuple[int, bytes], int] = {}  # a text of an anchor -> its entry, that of the smallest document
        entries: list[int] = []
        found: list[np.ndarray] = []
        variants: list[bytes] = []
        repeats = np.zeros(len(occ), bool)
        for a, b in _ranges(at, len(occ)):  # documents from the smallest on
            body, starts, ends = units.cut(texts[int(occ["doc"][a]), int(occ["twin"][a])].encode("utf-8", "replace"))
            begin = starts[occ["start"][a:b]].tolist()
            end = ends[occ["start"][a:b].astype(np.int64) + occ["count"][a:b] + units.width - 2].tolist()
            doc, keys = occ["doc"][a], occ["key"][a:b].tolist()
            for k in range(b - a):
                cut = body[begin[k] : end[k]]
                known = seen.setdefault((keys[k], cut), a + k)
                if known != a + k and occ["doc"][known] < doc:
                    repeats[a + k] = True
                else:
                    entries.append(a + k)
                    variants.append(cut)
        found = occ[repeats]
        rows = _dealt(1, doc_bucket(found["doc"], n), found[list(SPAN.names)].astype(SPAN))
        sent = occ[entries]
        bucket = _bucket_of(sent["key"], n)
        order = np.argsort(bucket, kind="stable")
        starts = _group_starts(bucket[order])
        for a, b in _ranges(starts, len(order)):
            part = order[a:b]
            cuts = [variants[k] for k in part]
            sizes = np.fromiter(map(len, cuts), "u4", len(cuts))
            rows.append((int(bucket[part[0]]), 0, pack(sent[part]) + sizes.tobytes() + zstandard.compress(b"".join(cuts), 3)))
        return _frame(rows)

    return run


def _read_runs(packed: bytes) -> tuple[np.ndarray, list[bytes]]:
    occ, at = unpack(packed, OCCURRENCE)
    lengths = np.frombuffer(packed, "u4", len(occ), at)
    text = zstandard.decompress(packed[at + 4 * len(occ) :])
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    return occ, [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _resolve(units: Units, resolver: Resolver, n: int, block: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        read = [_read_runs(p) for p in group["packed"][group["kind"] == 0]]
        out = [_unpack(group, 1, SPAN)]
        if read:
            occ, texts = np.concatenate([o for o, _ in read]), [t for _, part in read for t in part]
            order = np.lexsort((occ["doc"], occ["key"]))
            # equal texts of an anchor: all but those in the smallest document repeat as a whole
            variant_of, label, where, keys = {}, [], [], []
            number = np.empty(len(occ), np.int64)
            key_list, doc_list = occ["key"].tolist(), occ["doc"].tolist()
            for k in order.tolist():
                pair = (key_list[k], texts[k])
                v = variant_of.get(pair)
                if v is None:
                    v = variant_of[pair] = len(label)
                    label.append(doc_list[k])
                    where.append(k)
                    keys.append(key_list[k])
                number[k] = v
            labels = np.array(label, np.int64)
            whole = occ["doc"] > labels[number]
            out.append(occ[whole][list(SPAN.names)].astype(SPAN))
            # anchors with one text are done; the others' texts are indexed in blocks of whole anchors
            key_array = np.array(keys, U64)
            starts = _group_starts(key_array)
            sizes = np.diff(np.r_[starts, len(key_array)])
            left = np.flatnonzero(np.repeat(sizes > 1, sizes))
            measure = np.cumsum([occ["count"][where[v]] + units.width for v in left]) // block if len(left) else np.zeros(0, np.int64)
            firsts = _group_starts(key_array[left])
            piece = np.repeat(measure[firsts], np.diff(np.r_[firsts, len(left)])) if len(left) else measure
            spans: dict[int, np.ndarray] = {}
            edges = _group_starts(piece)
            for a, b in _ranges(edges, len(piece)):
                chosen = left[a:b]
                counts = occ["count"][[where[v] for v in chosen]].astype(np.int64)
                flags = resolver([texts[where[v]] for v in chosen], labels[chosen], counts)
                spans.update(zip(chosen.tolist(), flags, strict=True))
            # every place of such a text in its smallest document has the windows found
            rows = []
            for k in np.flatnonzero(~whole).tolist():
                flag = spans.get(int(number[k]))
                if flag is not None and flag.any():
                    edge = np.flatnonzero(np.diff(np.r_[0, flag.astype(np.int8), 0]))
                    o = occ[k]
                    rows += [(o["doc"], o["twin"], o["start"] + a, b - a) for a, b in zip(edge[::2], edge[1::2], strict=True)]
            out.append(np.array(rows, SPAN))
        done = np.concatenate(out)
        return _frame(_dealt(1, doc_bucket(done["doc"], n), done))

    return run


def _merged(spans: np.ndarray | None, width: int) -> np.ndarray:
    """Beginnings and ends, in turn, of the stretches of units that runs of windows cover."""
    if spans is None or not len(spans):
        return np.zeros(0, np.int64)
    spans = spans[np.argsort(spans["start"], kind="stable")]
    begin = spans["start"].astype(np.int64)
    end = np.maximum.accumulate(begin + spans["count"] + (width - 1))
    new = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
    return np.stack([begin[new], end[np.r_[new[1:] - 1, len(end) - 1]]], axis=1).ravel()


def _apply(units: Units) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(docs: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        found = _unpack(packed, 1, SPAN)
        found = found[np.lexsort((found["twin"], found["doc"]))]
        at = np.flatnonzero(np.r_[True, (found["doc"][1:] != found["doc"][:-1]) | (found["twin"][1:] != found["twin"][:-1])]) if len(found) else []
        own = {(int(found["doc"][a]), int(found["twin"][a])): found[a:b] for a, b in _ranges(at, len(found))}
        n_units, n_removed, n_spans, spans, kept = [], [], [], [], []
        glue = b" " if units.kind == "words" else b""
        for doc, twin, text, known in zip(docs["doc"], docs["twin"], docs["text"], docs["known"], strict=True):
            body, starts, ends = units.cut(text.encode("utf-8", "replace"))
            n = len(starts)
            edge = _merged(own.get((doc, twin)) if known else None, units.width)
            n_units.append(n)
            n_removed.append(int((edge[1::2] - edge[::2]).sum()))
            n_spans.append(len(edge) // 2)
            spans.append(edge.tolist())
            stay = np.r_[0, edge, n].reshape(-1, 2)
            kept.append(glue.join([body[starts[a] : ends[b - 1]] for a, b in stay.tolist() if a < b]))
        return pd.DataFrame({"doc_id": docs["doc"].where(docs["known"], None).astype("Int64"), "n_units": n_units, "n_removed": n_removed, "n_spans": n_spans, "spans": spans, "kept": kept})

    return run


def remove_repeats(docs: DataFrame, units: Units, resolver: Resolver, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, spans (starts and ends of removed units in turn), kept (bytes), for every row.

    A unit goes when a window that covers it also starts in a document with a smaller id. A null text has no units. Rows
    that repeat an id are no smaller than each other; each is judged by its own text. A row with a null id stays as it is and
    repeats nothing. Ids are whole numbers. An empty table gives an empty result.
    """
    n = shuffle_width(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text"))
    twins = not named.where("doc is not null").groupBy("doc").count().where("count > 1").isEmpty()
    twin = F.xxhash64("text") if twins else F.lit(0).cast("long")
    named = named.select(F.coalesce("doc", F.lit(0)).alias("doc"), twin.alias("twin"), "text", F.col("doc").isNotNull().alias("known"))

    runs = named.where("known").select("doc", "twin", "text").mapInPandas(_find_runs(units, n), PACKED)
    shared = runs.groupBy("bucket").applyInPandas(_keep_shared(n), PACKED)
    placed = named.withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(n)).cast("int"))
    texts = placed.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInPandas(_take_texts(units, n), PACKED)
    spans = texts.groupBy("bucket").applyInPandas(_resolve(units, resolver, n, block), PACKED)
    out = "doc_id long, n_units long, n_removed long, n_spans long, spans array<long>, kept binary"
    return placed.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInPandas(_apply(units), out)

