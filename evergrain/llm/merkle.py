"""Merkle manifest of a table: a hash tree for each source, a tree over the sources, and a proof for every row.

Rows become leaves; the leaves of a source are numbered by doc_id; every three consecutive nodes become the hash of their
concatenation, level by level, each level a table. Proofs come from the top: a node joins its parent, picks its siblings from
the parent's children and puts them before the proof that the parent has inherited. A row's proof is a pair (left, right) of
digests for each level; folding it over the leaf gives the root.

Ties and nulls: a null value is `-` in the leaf; a null doc_id comes first, a null source is a source of its own and first;
rows that repeat a doc_id are ordered by their leaves, and rows that are equal are leaves of their own. A null text stays null
when tampered with, and a row without doc_id is not tampered with. An empty table has no root and gives no rows. Other columns
are not part of the leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, shuffle_width, written

WIDTH = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A level of at most so many nodes is broadcast to its children: a node is its children's digests and at most two digests a level above.
BROADCAST_NODES = 8_192
_PROOF = "array<struct<left:binary,right:binary>>"


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    """The leaf's digest of a row, with some of its fields changed."""
    return _digest(F.concat(*[_field(changed.get(name, F.col(name))) for name in FIELDS]))


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with pos, the row's number within its group by the order given (from 0), and n, the group's size.

    Rows are dealt to ranges of (group, order), so a large group lies in many; a range's part of a group is numbered by itself
    and starts after the counts of the parts before it.
    """
    dealt = df.repartitionByRange(shuffle_width(df.sparkSession), group, *order).withColumn("__range", F.spark_partition_id())
    dealt = written(dealt, name, compression="zstd")
    parts = dealt.groupBy("__range", group).agg(F.count(F.lit(1)).alias("__part"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("__range", group, F.coalesce(F.sum("__part").over(before), F.lit(0)).alias("__start"), F.sum("__part").over(whole).alias("n"))
    inside = Window.partitionBy("__range", group).orderBy(*order)
    at = F.row_number().over(inside) - 1
    return dealt.join(starts, ["__range", group]).select(*df.columns, (F.col("__start") + at).cast("long").alias("pos"), "n")


def build(leaves: DataFrame, name: str) -> tuple[list[DataFrame], list[int]]:
    """Tables of all levels of the trees of leaves (group, pos, n, node), leaves first, and their numbers of nodes.

    A level above the leaves also has its nodes' children. A tree ends at the level where its n is 1.
    """
    sizes = leaves.where("pos = 0").select("n")
    power = [F.sum(F.ceil(F.col("n") / F.lit(WIDTH**k))).alias(f"level{k}") for k in range(40)]
    top, *counts = sizes.agg(F.max("n"), *power).first()  # one row
    levels = [leaves]
    while top is not None and top > 1:
        kids = F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda k: k["node"])
        up = levels[-1].where("n > 1").groupBy("group", F.floor(F.col("pos") / WIDTH).alias("pos"))
        level = up.agg(F.first("n").alias("n"), kids.alias("kids"))
        node = _digest(F.array_join(F.transform("kids", _hex), ""))
        level = level.select("group", "pos", F.ceil(F.col("n") / WIDTH).cast("long").alias("n"), node.alias("node"), "kids")
        levels.append(written(level, f"{name}-{len(levels)}"))
        top = -(-top // WIDTH)
    return levels, counts


def _roots(levels: list[DataFrame]) -> DataFrame:
    out = levels[0].where("n = 1").select("group", "node")
    for level in levels[1:]:
        out = out.unionByName(level.where("n = 1").select("group", "node"))
    return out


def push(levels: list[DataFrame], counts: list[int], inherited: DataFrame, name: str) -> DataFrame:
    """The leaves with subroot (their tree's root) and proof: pairs of siblings, ended by what the root inherits.

    inherited has group, subroot and proof. Of a level, nodes below a parent take its proof and the root of a tree what is inherited.
    """
    parents = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k].drop("kids") if k == 0 else levels[k]
        reached = level.where("n = 1").join(inherited, "group")
        if parents is not None:
            above = parents.select("group", F.col("pos").alias("__up"), F.col("kids").alias("__kids"), "subroot", F.col("proof").alias("__proof"))
            above = F.broadcast(above) if counts[k + 1] <= BROADCAST_NODES else above
            below = level.where("n > 1").withColumn("__up", F.floor(F.col("pos") / WIDTH)).join(above, ["group", "__up"])
            own = (F.col("pos") % WIDTH + 1).cast("int")

            def side(start: Column, length: Column) -> Column:
                return F.unhex(F.array_join(F.transform(F.slice("__kids", start, length), F.hex), ""))

            siblings = F.struct(side(F.lit(1), own - 1).alias("left"), side(own + 1, F.size("__kids") - own).alias("right"))
            below = below.withColumn("proof", F.concat(F.array(siblings), "__proof")).drop("__up", "__kids", "__proof")
            reached = reached.unionByName(below)
        if k == 0:
            return reached
        stored = written(reached, f"{name}-{k}")
        if parents is not None:
            discard(parents)
        parents = stored
    raise AssertionError("no levels")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, s: _digest(F.concat(_hex(s["left"]), _hex(node), _hex(s["right"]))))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, altered (the leaf after tampering), subroot, root (digests as bytes) and proof of every row.

    Tampering removes the line feeds of the text where 2 divides the CRC-32 of the decimal doc_id.
    """
    group = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    altered = F.when(hit, leaf_of(text=F.replace(F.col("text"), F.lit("\n"), F.lit("")))).otherwise(leaf_of())
    rows = written(docs.select("doc_id", group.alias("group"), leaf_of().alias("node"), altered.alias("altered")), "merkle-leaves")
    leaves = written(numbered(rows, "group", ["doc_id", "node", "altered"], "merkle-dealt"), "merkle-0")
    levels, counts = build(leaves, "merkle")

    sources = _roots(levels).select(F.lit("").alias("group"), F.col("group").alias("source"), "node")
    sources = written(numbered(sources, "group", ["source"], "merkle-sources-dealt"), "merkle-sources-0")
    over, over_counts = build(sources, "merkle-sources")
    root = _roots(over).select("node").first()  # one row, or none of an empty table
    start = over[-1].where("n = 1").select("group", F.col("node").alias("subroot"), F.array().cast(_PROOF).alias("proof"))
    proven = push(over, over_counts, start, "merkle-sources-proofs")
    inherited = written(proven.select(F.col("source").alias("group"), F.col("node").alias("subroot"), "proof"), "merkle-inherited")
    rows = push(levels, counts, inherited, "merkle-proofs")
    top = F.lit(None).cast("binary") if root is None else F.lit(root["node"])
    return rows.select("doc_id", F.col("node").alias("leaf"), "altered", "subroot", top.alias("root"), "proof")


def verified(rows: DataFrame) -> DataFrame:
    """A manifest's rows as hex text, with the proof's digest, the root folded from the altered leaf and whether it is the root."""
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), "")
    back = folded(F.col("altered"), F.col("proof"))
    rows = rows.select("*", back.alias("__back"), F.sha2(siblings, 256).alias("proof_sha256"))
    return rows.select(
        "doc_id",
        *[_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        "proof_sha256",
        _hex(F.col("__back")).alias("folded_root"),
        (F.col("__back") == F.col("root")).alias("verified"),
    )
