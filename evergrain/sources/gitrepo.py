"""A git repository as tables: objects from loose files and packs, commits, what each commit changed, and commits as persona rows.

Files are read by Spark (binaryFile), so a repository may lie in any store Spark reads; a loose object is a row, a pack is a task
(git splits packs at pack.packSizeLimit; one value holds 2 GB). History is walked by joins: along first parents in doubling
steps, then again from the other parents of merges. Trees are compared level by level, and only where their hashes differ.
"""

from __future__ import annotations

import difflib
import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evergrain.functions import text as T
from evergrain.functions.ids import stable_id

from .store import Store

OBJECT = "sha string, kind string, content binary"
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET_DELTA, REF_DELTA = 6, 7
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
#: Characters of a change list in a prompt, and what a verified author's row counts.
STAT_MAX, VERIFIED = 2000, 0.85


def _sha(kind: str, content: bytes) -> str:
    return hashlib.sha1(f"{kind} {len(content)}\0".encode() + content).hexdigest()


def _loose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for raw in f["content"]:
            head, _, content = zlib.decompress(raw).partition(b"\0")
            kind = head.split(b" ")[0].decode()
            out.append((_sha(kind, content), kind, content))
        yield pd.DataFrame(out, columns=["sha", "kind", "content"])


def _patched(base: bytes, delta: bytes) -> bytes:
    """What a delta makes of its base: copies of parts of the base, and new bytes."""

    def size(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            byte = delta[at]
            n, shift, at = n | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return n, at

    _, at = size(0)
    _, at = size(at)
    out = []
    while at < len(delta):
        op = delta[at]
        at += 1
        if op < 128:
            out.append(delta[at : at + op])
            at += op
            continue
        start = length = 0
        for k in range(7):
            if op >> k & 1:
                if k < 4:
                    start |= delta[at] << 8 * k
                else:
                    length |= delta[at] << 8 * (k - 4)
                at += 1
        length = length or 0x10000
        out.append(base[start : start + length])
    return b"".join(out)


def _entries(pack: bytes) -> Iterator[tuple[int, int, int | str | None, bytes]]:
    """(offset, type, base: an offset or a hash, inflated bytes) of a pack's objects in order."""
    (count,) = struct.unpack(">I", pack[8:12])
    at = 12
    for _ in range(count):
        begin, byte = at, pack[at]
        kind, at = byte >> 4 & 7, at + 1
        while byte & 128:
            byte, at = pack[at], at + 1
        base: int | str | None = None
        if kind == OFFSET_DELTA:
            byte, at = pack[at], at + 1
            back = byte & 127
            while byte & 128:
                byte, at = pack[at], at + 1
                back = (back + 1) << 7 | byte & 127
            base = begin - back
        elif kind == REF_DELTA:
            base, at = pack[at : at + 20].hex(), at + 20
        inflate = zlib.decompressobj()
        data = inflate.decompress(memoryview(pack)[at:])
        at = len(pack) - len(inflate.unused_data)
        yield begin, kind, base, data


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for pack in f["content"]:
            held = {at: (kind, base, data) for at, kind, base, data in _entries(pack)}
            by_sha: dict[str, int] = {}

            @lru_cache(maxsize=2048)
            def whole(at: int) -> tuple[int, bytes]:
                kind, base, data = held[at]  # noqa: B023  this pack's
                if kind in KINDS:
                    return kind, data
                kind, under = whole(base if isinstance(base, int) else by_sha[base])  # noqa: B023
                return kind, _patched(under, data)

            left = sorted(held)
            while left:  # a base named by its hash may stand later in the pack
                later, out = [], []
                for at in left:
                    try:
                        kind, content = whole(at)
                    except KeyError:
                        later.append(at)
                        continue
                    sha = _sha(KINDS[kind], content)
                    by_sha[sha] = at
                    out.append((sha, KINDS[kind], content))
                    if len(out) == 500:
                        yield pd.DataFrame(out, columns=["sha", "kind", "content"])
                        out = []
                yield pd.DataFrame(out, columns=["sha", "kind", "content"])
                if len(later) == len(left):
                    raise ValueError("a pack's delta has no base in it")
                left = later


def objects(spark: SparkSession, git_dir: str) -> DataFrame:
    """sha, kind, content of every object of a repository, loose and packed, once each."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{git_dir.rstrip('/')}/objects")
    loose = raw.where(F.col("path").rlike(r"/[0-9a-f]{2}/[0-9a-f]{38}$")).select("content").mapInPandas(_loose, OBJECT)
    packs = raw.where(F.col("path").endswith(".pack")).select("content").repartition(64).mapInPandas(_packed, OBJECT)
    return loose.unionByName(packs).dropDuplicates(["sha"])


def _commit_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for sha, raw in zip(f["sha"], f["content"]):
            head, _, message = raw.partition(b"\n\n")
            fields: dict[str, list[str]] = {}
            for line in head.decode("utf-8", "replace").split("\n"):
                if not line.startswith(" "):
                    name, _, value = line.partition(" ")
                    fields.setdefault(name, []).append(value)
            who, _, when = fields["author"][0].rpartition("> ")
            name, _, mail = who.partition(" <")
            out.append((sha, fields["tree"][0], fields.get("parent", []), name, mail, int(when.split(" ")[0]), message.decode("utf-8", "replace")))
        yield pd.DataFrame(out, columns=["sha", "tree", "parents", "author", "email", "at", "message"])


def commits(objects: DataFrame) -> DataFrame:
    """sha, tree, parents, author, email, at (seconds), message."""
    return objects.where("kind = 'commit'").select("sha", "content").mapInPandas(_commit_rows, "sha string, tree string, parents array<string>, author string, email string, at long, message string")


def heads(spark: SparkSession, git_dir: str) -> DataFrame:
    """sha that HEAD stands for: a branch's file, its line among the packed ones, or a hash itself."""
    root = git_dir.rstrip("/")
    head = spark.read.option("wholetext", "true").text(f"{root}/HEAD").select(F.trim(F.regexp_replace("value", r"\s+$", "")).alias("v"))
    named = head.select(F.when(F.col("v").startswith("ref: "), F.substring("v", 6, 1000)).alias("ref"), F.when(~F.col("v").startswith("ref: "), F.col("v")).alias("sha"))
    refs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("path").rlike(r"/(refs/heads/.*|packed-refs)$"))
    lines = refs.select("path", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where(F.length("line") >= 40)
    own = F.regexp_extract("path", r"/(refs/heads/.*)$", 1)
    known = lines.select(F.when(own != "", own).otherwise(F.substring("line", 42, 1000)).alias("ref"), F.substring("line", 1, 40).alias("sha"), (own != "").alias("own")).where("sha rlike '^[0-9a-f]{40}$'")
    best = known.groupBy("ref").agg(F.max_by("sha", "own").alias("found"))
    return named.join(best, "ref", "left").select(F.coalesce("sha", "found").alias("sha")).where("sha is not null")


def reachable(store: Store, commits: DataFrame, start: DataFrame) -> DataFrame:
    """sha of all commits that are ancestors of the start (sha) or in it.

    Marks go along first parents in steps of 1, 2, 4, ...: a round more for twice the history. Other parents of merges start the next pass.
    """
    up = commits.select("sha", F.try_element_at("parents", F.lit(1)).alias("to"))
    jumps = [store.read(store.stage(up.where("to is not null"), "jumps"), "sha string, to string")]
    others = commits.select("sha", F.explode(F.slice("parents", 2, 1000)).alias("to"))
    schema = "sha string"
    marked = store.read(store.stage(start.select("sha").distinct(), "marked"), schema)
    fresh = marked
    while not fresh.isEmpty():
        k, size = 0, fresh.count()
        while True:
            if k == len(jumps):
                before = jumps[-1]
                twice = before.join(before.select(F.col("sha").alias("to"), F.col("to").alias("far")), "to").select("sha", F.col("far").alias("to"))
                jumps.append(store.read(store.stage(twice, "jumps"), "sha string, to string"))
            fresh = fresh.unionByName(fresh.join(jumps[k], "sha").select(F.col("to").alias("sha"))).distinct()
            fresh = store.read(store.stage(fresh, "fresh"), schema)
            k, more = k + 1, fresh.count()
            # a step that marks nothing leaves nothing for longer ones
            if more == size:
                break
            size = more
        marked = store.read(store.stage(marked.unionByName(fresh).distinct(), "marked"), schema)
        found = fresh.join(others, "sha").select(F.col("to").alias("sha")).distinct().join(marked, "sha", "left_anti")
        fresh = store.read(store.stage(found, "fresh"), schema)
    return marked


def _tree_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for sha, raw in zip(f["sha"], f["content"]):
            at = 0
            while at < len(raw):
                gap, end = raw.index(b" ", at), raw.index(b"\0", at)
                out.append((sha, raw[gap + 1 : end].decode("utf-8", "replace"), raw[at:gap] == b"40000", raw[end + 1 : end + 21].hex()))
                at = end + 21
        yield pd.DataFrame(out, columns=["tree", "name", "is_tree", "child"])


def entries(objects: DataFrame) -> DataFrame:
    """tree, name, is_tree, child of every tree."""
    return objects.where("kind = 'tree'").select("sha", "content").mapInPandas(_tree_rows, "tree string, name string, is_tree boolean, child string")


def changed_files(store: Store, commits: DataFrame, entries: DataFrame) -> DataFrame:
    """sha, path, old, new: the blobs that each commit changed against its first parent (a first commit against nothing); null on the side where a file is not."""
    parents = commits.select(F.col("sha").alias("p"), F.col("tree").alias("old"))
    pairs = commits.select("sha", F.try_element_at("parents", F.lit(1)).alias("p"), F.col("tree").alias("new")).join(parents, "p", "left").select("sha", F.lit("").alias("path"), "old", "new")
    schema = "sha string, path string, old string, new string"
    side = lambda rows, which: rows.select("sha", "path", F.col(which).alias("tree")).where("tree is not null").join(entries, "tree")
    found, out = pairs.where(~F.col("old").eqNullSafe(F.col("new"))), []
    while True:
        found = store.read(store.stage(found, "trees"), schema)
        if found.isEmpty():
            break
        a = side(found, "old").select("sha", "path", "name", F.col("child").alias("a"), F.col("is_tree").alias("a_tree"))
        b = side(found, "new").select("sha", "path", "name", F.col("child").alias("b"), F.col("is_tree").alias("b_tree"))
        both = a.join(b, ["sha", "path", "name"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        both = both.withColumn("path", F.concat("path", F.when(F.col("path") != "", "/").otherwise(""), "name"))
        blob = lambda c: F.when(~F.col(f"{c}_tree"), F.col(c))
        level = both.select("sha", "path", blob("a").alias("old"), blob("b").alias("new")).where("old is not null or new is not null")
        out.append(store.stage(level, "changed"))
        tree = lambda c: F.when(F.col(f"{c}_tree"), F.col(c))
        found = both.select("sha", "path", tree("a").alias("old"), tree("b").alias("new")).where("old is not null or new is not null")
    reader = store.spark.read.schema(schema)
    return reader.parquet(*[f"{store.root}/{p}" for p in out]) if out else store.spark.createDataFrame([], schema)


_COUNTS = StructType([StructField("added", LongType()), StructField("removed", LongType())])


@F.pandas_udf(_COUNTS)  # type: ignore[call-overload]
def _line_counts(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    out = []
    for a, b in zip(old, new):
        a, b = a or b"", b or b""
        if b"\0" in a[:8000] or b"\0" in b[:8000]:
            out.append((None, None))
            continue
        x, y = a.splitlines(keepends=True), b.splitlines(keepends=True)
        same = sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        out.append((len(y) - same, len(x) - same))
    return pd.DataFrame(out, columns=["added", "removed"]).astype("Int64")


def line_counts(changed: DataFrame, objects: DataFrame) -> DataFrame:
    """changed with added and removed lines (null for binary files). Where lines repeat a shorter difference may exist than the one counted."""
    blobs = objects.where("kind = 'blob'")
    rows = changed.join(blobs.select(F.col("sha").alias("old"), F.col("content").alias("a")), "old", "left").join(blobs.select(F.col("sha").alias("new"), F.col("content").alias("b")), "new", "left")
    return rows.select("sha", "path", "old", "new", _line_counts("a", "b").alias("n")).select("sha", "path", "old", "new", "n.added", "n.removed")


def commit_turns(commits: DataFrame, counts: DataFrame, repo: str, authors: list[str], agent_marks: list[str]) -> DataFrame:
    """Commits of named authors as persona rows: sha, prompt (the files they changed), voice (the redacted message), evidence_id, source_uri, confidence.

    Merges, commits with an agent's mark in what follows the subject, and commits that change nothing are left out. authors are patterns for `name <mail>`, and
    agent_marks are parts of texts; both are the operator's short lists.
    """
    by = F.lit(False) if authors else F.lit(True)
    for a in authors:
        by = by | F.concat("author", F.lit(" <"), "email", F.lit(">")).rlike(a)
    subject = F.regexp_replace(F.element_at(F.split(T.strip(F.col("message")), r"\n\s*\n"), 1), r"\n", " ")
    body = T.strip(F.regexp_replace(T.strip(F.col("message")), r"(?s)\A.*?(\n\s*\n|\z)", ""))
    rows = commits.where((F.size("parents") <= 1) & by).select("sha", subject.alias("subject"), body.alias("body"))
    marked = F.lit(False)
    for mark in agent_marks:
        marked = marked | F.col("body").contains(mark)
    line: Column = F.concat("path", F.lit(" | "), F.when(F.col("added").isNull(), F.lit("binary")).otherwise(F.concat(F.lit("+"), F.col("added").cast("string"), F.lit(" -"), F.col("removed").cast("string"))))
    listed = counts.select("sha", "path", line.alias("line")).groupBy("sha").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n").alias("stat"))
    voice = T.redact_secrets(F.when(F.col("body") == "", F.col("subject")).otherwise(F.concat("subject", F.lit("\n\n"), "body")))
    uri = F.concat(F.lit(f"git://{repo}#"), "sha")
    return rows.where(~marked).join(listed, "sha").select(
        "sha", F.concat(F.lit("Write a commit message for these changes:\n"), F.substring(T.redact_secrets(F.col("stat")), 1, STAT_MAX)).alias("prompt"), voice.alias("voice"),
        stable_id("evd", uri).alias("evidence_id"), uri.alias("source_uri"), F.lit("git_commit").alias("source_kind"), F.lit(VERIFIED).alias("confidence"),
    )
