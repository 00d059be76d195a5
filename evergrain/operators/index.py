"""A kept inverted index for BM25: postings in blocks by bucket of their term, changes as segments, exact top-k by document shard.

A segment holds the postings of the documents that came with one change by bucket of their term, and the documents themselves
(length, terms and the columns that gates need) by bucket of their id. A term's document frequency is what its blocks hold less
what changes took away, which is kept beside the marks. A change or
deletion marks the (document, segment) that it replaces; postings of marked pairs count no more and go when segments are
merged. Statistics are sums over segments, so an index after any changes scores as one built anew.

Texts are dealt once, by shard of their document; there they are cut into terms, and documents and blocks are written from the
same task into the folders of their buckets. Postings are not moved one by one, and those of documents that a change replaces,
or of terms that nobody asks for, leave by a bitmap of what is wanted before anything is joined.

Postings of a term stand in blocks of up to BLOCK documents of one shard and chunk, from high to low share of the score, and each block
keeps its greatest term frequency and least length, which bound what any document in it can get. A search reads the buckets
of its terms only and sends their blocks, as arrays, to the shards of their documents. A shard adds up the terms of a query
from the highest bound down; once what is left cannot lift a new document over the k-th best sum (the bar), only documents that
can still reach the bar are added to, and blocks whose bound shows that none of theirs can are skipped. Each shard gives its best k.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from evergrain.functions import text as T
from evergrain.sources.store import Store

from .retrieval import K1, B, top

BLOCK = 128
#: Segments are merged into one beyond this number.
MERGE_AFTER = 8
#: Documents that a shard holds about; queries that go to a shard together.
SHARD_DOCS, SLICE_QUERIES = 50_000, 2_000
#: Documents that a task cuts, and from which another task is worth its files.
TASK_DOCS, LEAST_TASK_DOCS = 8_000, 1_000
#: Bytes of terms, and postings, that are made into blocks together; rows that a chunk grows by.
CHUNK_BYTES, CHUNK_POSTINGS, STEP = 8_000_000, 1_000_000, 200
#: Bits of a bitmap of wanted keys; it is sent to all tasks in this / 64 rows.
SLOTS = 1 << 23
#: Summation orders may move a score by less than this.
SLACK = 1e-6


def _share(tf, length, mean):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _sifted(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is, by its hash, among the wanted keys (a column of that name): all that are, and few others. Null keys go."""
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    word, bit = F.floor(slot / 64).alias("__word"), (slot % 64).cast("int")
    bits = wanted.where(F.col(key).isNotNull()).select(word, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("__word").agg(F.bit_or("b").alias("__bits"))
    found = rows.where(F.col(key).isNotNull()).select("*", word).join(F.broadcast(bits), "__word")  # SLOTS / 64 rows at most
    return found.where(F.getbit("__bits", bit) == 1).select(*rows.columns)


class SearchIndex:
    """An index of documents by weighted fields.

    fields: text column -> weight; keep: columns that searches gate or rank by. Both are fixed for the index's life, as is the number of buckets.
    """

    def __init__(self, spark: SparkSession, root: str, fields: dict[str, float], id_col: str = "doc_id", keep: tuple[str, ...] = (), buckets: int = 64):
        self.spark, self.store, self.fields, self.id_col, self.keep, self.buckets = spark, Store(spark, root), fields, id_col, keep, buckets

    def _bucket(self, of: str) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(self.buckets)).cast("int").alias("bucket")

    # ---- writing ---------------------------------------------------------------------------------------------------

    def _dealt(self, rows: DataFrame, n_docs: int, shards: int) -> DataFrame:
        """Rows (doc, ...) of n_docs documents dealt to tasks by shard; a large shard lies in several, a task of a small change has several shards."""
        tasks = max(-(-n_docs // TASK_DOCS), min(self.spark.sparkContext.defaultParallelism, -(-n_docs // LEAST_TASK_DOCS)), 1)
        parts = shards * -(-tasks // shards)
        tasks = parts if tasks >= shards else tasks
        return rows.repartitionById(tasks, (F.pmod(F.xxhash64("doc"), F.lit(parts)) % tasks).cast("int"))

    def _segment(self, docs: DataFrame, number: int, shards: int | None = None) -> dict:
        """Stages a segment of new documents; what it replaces is not known here. The first segment settles the number of shards."""
        n_docs = docs.count()
        shards = shards or max(1, -(-n_docs // SHARD_DOCS))
        texts, weights = [f"__{k}" for k in range(len(self.fields))], [float(w) for w in self.fields.values()]
        dealt = self._dealt(docs.select(F.col(self.id_col).alias("doc"), *self.keep, *[F.col(f).alias(t) for t, f in zip(texts, self.fields)]), n_docs, shards)
        # no term has a space; one string for a text takes less of a worker than its list of terms
        cut = dealt.select("doc", *self.keep, _shard("doc", shards), *[F.array_join(T.terms(F.col(t)), " ").alias(t) for t in texts])
        kept = cut.select("doc", *self.keep, F.lit(0.0).alias("len"), F.lit("").alias("terms"))
        doc_schema, block_schema = kept.schema, _block_schema(cut)
        both = StructType([StructField(f.name, f.dataType) for f in (*kept.select(F.lit("").alias("kind"), "*").schema, *block_schema)])
        arrow, named, block, most, step = to_arrow_schema(both), [*self.keep], BLOCK, CHUNK_BYTES, STEP

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for col in _chunks(batches, most, lambda b: sum(pc.sum(pc.binary_length(b.column(t))).as_py() for t in texts), step):
                n = len(col("doc"))
                rows, terms, weight, length = [], [], [], np.zeros(n)
                for t, w in zip(texts, weights):
                    text = col(t)
                    each = pc.split_pattern(text, " ")
                    sizes = np.where(pc.binary_length(text).to_numpy() == 0, 0, pc.list_value_length(each).to_numpy())
                    rows.append(np.repeat(np.arange(n), sizes))
                    values = each.flatten()
                    terms.append(values.filter(pc.greater(pc.binary_length(values), 0)))  # an empty text is split into an empty term
                    weight.append(np.full(len(terms[-1]), w))
                    length += sizes * w
                coded = pa.concat_arrays(terms).dictionary_encode()
                base = max(1, len(coded.dictionary))
                pairs, at = np.unique(np.concatenate(rows) * base + coded.indices.to_numpy(), return_inverse=True)
                tf, row, code = np.bincount(at, np.concatenate(weight), len(pairs)), pairs // base, pairs % base
                words = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), coded.dictionary.take(pa.array(code)))
                yield from _rows(arrow, "docs", n, {"doc": col("doc"), "len": pa.array(length), "terms": pc.binary_join(words, " ")} | {c: col(c) for c in named})
                if len(row):
                    made = _packed(col("shard").to_numpy()[row], code, coded.dictionary, col("doc"), row, tf, length[row], number, block)
                    yield from _rows(arrow, "postings", len(made["term"]), made)

        made = cut.mapInArrow(run, both)
        bucket = F.when(F.col("kind") == "docs", self._bucket("doc")).otherwise(self._bucket("term"))
        path = self.store.stage(made.withColumn("bucket", bucket), "segment", ["kind", "bucket"], dealt=True)
        segment = {"number": number, "docs": self.store.folder(f"{path}/kind=docs"), "doc_schema": doc_schema.add("bucket", "integer").json(), "postings": self.store.folder(f"{path}/kind=postings"), "block_schema": block_schema.add("bucket", "integer").json()}
        stats = self.store.read(segment["docs"], doc_schema).agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0.0))).first()
        return segment | {"shards": shards, "n_docs": stats[0], "sum_len": stats[1]}

    def _docs(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        """Documents of all segments with their segment's number, marked ones too."""
        out = None
        for s in m["segments"]:
            rows = self.store.read(s["docs"], _schema(s["doc_schema"]))
            rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
            rows = rows.withColumn("segment", F.lit(s["number"]))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _doc_type(self, m: dict) -> str:
        return _schema(m["segments"][0]["doc_schema"])["doc"].dataType.simpleString()

    def _dead(self, m: dict) -> DataFrame | None:
        """Marked pairs (doc, segment)."""
        out = None
        for path in m["dead"]:
            rows = self.store.read(path, f"doc {self._doc_type(m)}, segment int")
            out = rows if out is None else out.unionByName(rows)
        return out

    def _live_docs(self, m: dict, buckets: list[int] | None = None, among: DataFrame | None = None) -> DataFrame:
        """among: a column `doc` of distinct ids; only they come, and what is left of other documents is not moved."""
        docs, dead = self._docs(m, buckets), self._dead(m)
        # inner and outer joins: Spark would take a semi or an anti join to the scan, before the bitmap
        docs = docs if among is None else _sifted(docs, "doc", among).join(among, "doc")
        return docs if dead is None else docs.join(dead.withColumn("__dead", F.lit(True)), ["doc", "segment"], "left").where("__dead IS NULL").drop("__dead")

    def build(self, docs: DataFrame, **note) -> dict:
        """The index of all documents, anew. note: what the caller wants to find in the manifest again."""
        segment = self._segment(docs, 0)
        made = {"segments": [segment], "dead": [], "lost": [], "next": 1, "shards": segment["shards"], "n_docs": segment["n_docs"], "sum_len": segment["sum_len"]}
        return self.store.publish(made | note, self.store.current())

    def update(self, changed: DataFrame, deleted: DataFrame | None = None) -> dict:
        """Documents that are new or changed, and ids (id_col) that go. Costs follow the change: old rows are looked up in the buckets of the ids."""
        now = self.store.current()
        number = now["next"]
        segment = self._segment(changed, number, now["shards"])
        new = self._docs({"segments": [segment]})
        gone = new.select("doc", "bucket")
        if deleted is not None:
            gone = gone.unionByName(deleted.select(F.col(self.id_col).alias("doc"), self._bucket(self.id_col)))
        gone = gone.distinct()
        buckets = [r["bucket"] for r in gone.select("bucket").distinct().collect()]  # no more than buckets
        old = self._live_docs(now, buckets, gone.select("doc"))
        dead = self.store.stage(old.select("doc", "segment", "len", "terms"), "dead")
        old = self.store.read(dead, old.select("doc", "segment", "len", "terms").schema)
        lost = old.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0.0))).first()
        lost_terms = old.select(F.explode(F.split("terms", " ")).alias("term")).where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n")).select("term", "n", self._bucket("term"))
        made = now | {
            "segments": now["segments"] + [segment], "dead": now["dead"] + [dead], "lost": now["lost"] + [self.store.stage(lost_terms, "lost", "bucket")], "next": number + 1,
            "n_docs": now["n_docs"] + segment["n_docs"] - lost[0], "sum_len": now["sum_len"] + segment["sum_len"] - lost[1],
        }
        return self.store.publish(self._merged(made) if len(made["segments"]) > MERGE_AFTER else made, now)

    def _merged(self, m: dict) -> dict:
        """One segment of what is live."""
        number = m["next"]
        shards = max(1, -(-m["n_docs"] // SHARD_DOCS))
        rows = self._dealt(self._exploded(m, None).select("doc", "term", "tf", "len"), m["n_docs"], shards).select("doc", "term", "tf", "len", _shard("doc", shards))
        block_schema = _block_schema(rows)
        arrow, block, most, step = to_arrow_schema(block_schema), BLOCK, CHUNK_POSTINGS, STEP

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for col in _chunks(batches, most, len, step):
                coded = col("term").dictionary_encode()
                n = len(coded)
                made = _packed(col("shard").to_numpy(), coded.indices.to_numpy(), coded.dictionary, col("doc"), np.arange(n), col("tf").to_numpy(), col("len").to_numpy(), number, block)
                yield from _rows(arrow, None, len(made["term"]), made)

        blocks = rows.mapInArrow(run, block_schema).withColumn("bucket", self._bucket("term"))
        kept = self._live_docs(m).drop("segment")
        segment = {"docs": self.store.stage(kept, "docs", "bucket"), "doc_schema": kept.schema.json(), "number": number, "postings": self.store.stage(blocks, "postings", ["bucket"], dealt=True), "block_schema": blocks.schema.json(), "shards": shards, "n_docs": m["n_docs"], "sum_len": m["sum_len"]}
        return m | {"segments": [segment], "dead": [], "lost": [], "shards": shards, "next": number + 1}

    # ---- reading ---------------------------------------------------------------------------------------------------

    def _frequencies(self, m: dict, buckets: list[int], held: DataFrame) -> DataFrame:
        """term, df of the terms of some blocks: their documents, less those that changes took away."""
        each = held.select("term", F.size("docs").cast("long").alias("n"))
        for path in m["lost"]:
            each = each.unionByName(self.store.read(path, "term string, n long, bucket int").where(F.col("bucket").isin(buckets)).select("term", (-F.col("n")).alias("n")))
        return each.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")

    def blocks(self, m: dict, buckets: list[int] | None) -> DataFrame:
        """Blocks of the postings in some buckets; only their folders are read."""
        out = None
        for s in m["segments"]:
            rows = self.store.read(s["postings"], _schema(s["block_schema"]))
            rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _exploded(self, m: dict, buckets: list[int] | None) -> DataFrame:
        """Live postings: term, doc, segment, tf, len."""
        each = F.explode(F.arrays_zip("docs", "segments", "tfs", "lens")).alias("p")
        rows = self.blocks(m, buckets).select("term", each).select("term", F.col("p.docs").alias("doc"), F.col("p.segments").alias("segment"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))
        dead = self._dead(m)
        return rows if dead is None else rows.join(dead, ["doc", "segment"], "left_anti")

    def search(self, queries: DataFrame, k: int, gate: Column | None = None, digits: int | None = None, most_terms: int = 24) -> DataFrame:
        """query_id, id, score, rank: the k best documents of each query (query_id, query) that pass the gate, a condition on kept columns.

        Equal scores (after rounding to `digits`, where given) go by id.
        """
        m = self.store.current()
        asked = queries.select("query_id", F.explode(T.fts_terms(F.col("query"), most_terms)).alias("term")).withColumn("bucket", self._bucket("term"))
        buckets = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())  # no more than buckets
        n, mean = float(m["n_docs"]), (m["sum_len"] / m["n_docs"] if m["n_docs"] else 0.0) or 1.0
        # blocks of a term that nobody asked for may be among them; they do no harm
        held = _sifted(self.blocks(m, buckets), "term", asked.select("term"))
        df = self._frequencies(m, buckets, held)
        idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        asked = asked.join(df.select("term", idf.alias("idf")), "term").select("query_id", "term", "idf")
        slices = max(1, -(-queries.count() // SLICE_QUERIES))
        part_of = F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int").alias("part")
        every_part = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("part")

        # a shard's frame: blocks of the terms asked for, and in chunks the documents that count
        held = held.select("shard", "term", "max_tf", "min_len", "docs", "segments", "tfs", "lens")
        live = self._docs(m)
        live = (live if gate is None else live.where(gate)).select("doc", "segment")
        dead = self._dead(m)
        live = live if dead is None else live.join(dead, ["doc", "segment"], "left_anti")
        chunk = F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(16))
        live = live.groupBy(_shard("doc", m["shards"]), chunk.alias("chunk")).agg(F.collect_list(F.struct("doc", "segment")).alias("d"))
        live = live.select("shard", F.lit(None).cast("string").alias("term"), F.transform("d", lambda x: x["doc"]).alias("docs"), F.transform("d", lambda x: x["segment"]).alias("segments"))
        rows = held.unionByName(live, allowMissingColumns=True).select("*", every_part)
        wanted = asked.select("query_id", "term", "idf", part_of, F.explode(F.sequence(F.lit(0), F.lit(m["shards"] - 1))).alias("shard"))
        types = asked.schema["query_id"].dataType.simpleString(), self._doc_type(m)

        def run(postings: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out = []
            answers = _Shard(postings, mean, k, digits)
            if answers.any:
                for _, group in asked.groupby("query_id", sort=False):
                    out += answers.best(group)
            return pd.DataFrame(out, columns=["query_id", "doc", "score"])

        keys = ["shard", "part"]
        found = rows.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(run, f"query_id {types[0]}, doc {types[1]}, score double")
        return top(found.withColumnRenamed("doc", self.id_col), k, F.desc("score"), F.asc(self.id_col))


class _Shard:
    """The documents of a shard that count, and the postings of the terms asked for among them."""

    def __init__(self, frame: pd.DataFrame, mean: float, k: int, digits: int | None):
        self.mean, self.k, self.digits = mean, k, digits
        is_live = frame["term"].isna().to_numpy()
        docs = list(frame["docs"][is_live])
        self.any = bool(docs)
        if not docs:
            return
        docs, segments = np.concatenate(docs), np.concatenate(list(frame["segments"][is_live]))
        order = np.argsort(docs, kind="stable")
        self.docs, self.segments = docs[order], segments[order]
        self.terms: dict[str, list[tuple[float, np.ndarray, np.ndarray]]] = {}
        blocks = frame[~is_live]
        for term, max_tf, min_len, d, s, tf, length in zip(*(blocks[c] for c in ("term", "max_tf", "min_len", "docs", "segments", "tfs", "lens"))):
            at = np.minimum(np.searchsorted(self.docs, d), len(self.docs) - 1)
            counts = (self.docs[at] == d) & (self.segments[at] == s)
            if counts.any():
                self.terms.setdefault(term, []).append((_share(max_tf, min_len, self.mean), at[counts], _share(np.asarray(tf)[counts], np.asarray(length)[counts], self.mean)))

    def best(self, asked: pd.DataFrame) -> list[tuple]:
        """(query_id, doc, score) of a query's k best documents here; asked: its terms with their idf."""
        lists = [(idf * max(b for b, _, _ in self.terms[t]), idf, self.terms[t]) for t, idf in zip(asked["term"], asked["idf"]) if t in self.terms]
        if not lists:
            return []
        lists.sort(key=lambda x: -x[0])
        room = SLACK + (0.0 if self.digits is None else 10.0**-self.digits)
        left = sum(bound for bound, _, _ in lists)
        sums, bar = np.zeros(len(self.docs)), 0.0
        for bound, idf, blocks in lists:
            if bar > 0 and left < bar:  # no new document can come in
                able = sums + left >= bar
                top_sum = sums.max()
                for most, at, share in blocks:
                    if top_sum + left - bound + idf * most < bar:  # none of the block's can reach the bar
                        continue
                    chosen = able[at] & (sums[at] > 0)
                    sums[at[chosen]] += idf * share[chosen]
            else:
                for _, at, share in blocks:
                    sums[at] += idf * share
            left -= bound
            if len(sums) >= self.k:
                bar = max(bar, float(np.partition(sums, -self.k)[-self.k]) - room)
        scores = sums if self.digits is None else np.round(sums, self.digits)
        some = np.flatnonzero(sums > 0)
        if len(some) > self.k:
            least = np.partition(scores[some], -self.k)[-self.k]
            some = some[scores[some] >= least]
        some = sorted(some.tolist(), key=lambda i: (-scores[i], i))[: self.k]  # docs are in order
        query = asked["query_id"].iat[0]
        return [(query, self.docs[i], float(scores[i])) for i in some]


def _chunks(batches: Iterator[pa.RecordBatch], most: int, size: Callable[[pa.RecordBatch], int], step: int) -> Iterator[Callable[[str], pa.Array]]:
    """Slices of `step` rows put together until their size is `most`: a function from a column's name to its values."""
    held: list[pa.RecordBatch] = []
    n = 0
    for part in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
        held, n = [*held, part], n + size(part)
        if n >= most:
            yield lambda name, held=held: pa.concat_arrays([b.column(name) for b in held])
            held, n = [], 0
    if held:
        yield lambda name, held=held: pa.concat_arrays([b.column(name) for b in held])


def _packed(shard: np.ndarray, code: np.ndarray, names: pa.Array, docs: pa.Array, row: np.ndarray, tf: np.ndarray, length: np.ndarray, segment: int, block: int) -> dict:
    """Columns of the blocks of some postings: of docs[row], with names[code]."""
    order = np.lexsort((-_share(tf, length, length.mean() or 1.0), code, shard))
    shard, code, row, tf, length = shard[order], code[order], row[order], tf[order], length[order]
    starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (shard[1:] != shard[:-1])])
    place = np.arange(len(code)) - np.repeat(starts, np.diff(np.r_[starts, len(code)]))
    cuts = np.flatnonzero(place % block == 0)
    lists = lambda values: pa.ListArray.from_arrays(pa.array(np.r_[cuts, len(code)], pa.int32()), values)
    return {
        "term": names.take(pa.array(code[cuts])), "shard": pa.array(shard[cuts], pa.int32()), "max_tf": pa.array(np.maximum.reduceat(tf, cuts)), "min_len": pa.array(np.minimum.reduceat(length, cuts)),
        "docs": lists(docs.take(pa.array(row))), "segments": lists(pa.array(np.full(len(code), segment, np.int32))), "tfs": lists(pa.array(tf)), "lens": lists(pa.array(length)),
    }


def _rows(schema: pa.Schema, kind: str | None, n: int, columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    """n rows of a schema, with nulls in the columns that are not given."""
    columns = columns if kind is None else columns | {"kind": pa.array([kind] * n, pa.string())}
    made = pa.Table.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], names=schema.names)
    yield from made.to_batches(max_chunksize=20_000)


def _block_schema(rows: DataFrame) -> StructType:
    """Of blocks of the documents `doc` of rows, without the bucket."""
    doc = rows.schema["doc"].dataType.simpleString()
    return StructType.fromDDL(f"term string, shard int, max_tf double, min_len double, docs array<{doc}>, segments array<int>, tfs array<double>, lens array<double>")


def _shard(doc: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(shards)).cast("int").alias("shard")


def _schema(text: str) -> StructType:
    return StructType.fromJson(json.loads(text))
