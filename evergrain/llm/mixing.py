"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets follow from the sources' sizes alone. The mix has a whole number of blocks; sources win them by
highest quotients target / (2 k - 1), and each source's blocks are dealt to its shards in the same way.
Inside a shard the documents stand in seeded order and form a stream of words; the blocks that the shard
won are the first ones of that stream, read at most twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, running_sums, text_of, written

WEIGHTS = (3, 1, 2)
#: Price ranges in which quotients are counted before those of one range are ranked.
RANGES = 4096


def apportion(parties: DataFrame, seats: Column, within: list[str], votes: str) -> DataFrame:
    """parties with the column `won`: seats by highest quotients votes / (2 k - 1), separately for each `within`.

    Ties go to the smaller `party`. Rounding shares gives each party half a seat more or less, so the divisor that deals all
    seats lies between those whose shares sum to half a seat a party less and more than there are: quotients above both
    are won, quotients below both are lost, and those between, two for each party on average, are ranked. They are counted
    in price ranges first, so a task ranks those of a range only.
    """
    group = [*within, "__all"]
    based = parties.withColumn("__all", F.lit(0)).withColumn("__seats", seats)
    totals = based.groupBy(*group).agg(F.sum(votes).alias("__votes"), F.count_if(F.col(votes) > 0).alias("__n"), F.max("__seats").alias("__seats"))
    low = F.greatest(F.col("__seats") - F.col("__n") / 2, F.lit(0.0)) / F.col("__votes")  # seats a vote
    totals = totals.where("__votes > 0").select(*group, "__seats", low.alias("__low"), ((F.col("__seats") + F.col("__n") / 2) / F.col("__votes")).alias("__high"))
    tried = based.drop("__seats").join(totals, group).where(F.col(votes) > 0)
    tried = tried.withColumn("__sure", F.greatest(F.floor(F.col(votes) * F.col("__low") + 0.5) - 1, F.lit(0)).cast("long"))
    tried = tried.withColumn("__upto", F.floor(F.col(votes) * F.col("__high") + 0.5).cast("long") + 1)
    left = tried.groupBy(*group).agg((F.max("__seats") - F.sum("__sure")).alias("__left"))
    price = (2 * F.col("__k") - 1) / F.col(votes)
    at = (price / 2 - F.col("__low")) / (F.col("__high") - F.col("__low")) * RANGES
    tried = tried.withColumn("__k", F.explode(F.sequence(F.col("__sure") + 1, "__upto"))).select(
        *group, "party", "__k", price.alias("__price"), F.greatest(F.lit(0), F.least(F.lit(RANGES), F.floor(at))).cast("int").alias("__range"))
    counted = tried.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__here"))
    upto = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("__before", F.coalesce(F.sum("__here").over(upto), F.lit(0))).join(left, group)
    open_ranges = counted.where("__before < __left").select(*group, "__range", "__before", "__left")
    ranked = tried.join(open_ranges, [*group, "__range"])
    nth = F.row_number().over(Window.partitionBy(*group, "__range").orderBy("__price", "party", "__k"))
    extra = ranked.withColumn("__nth", nth).where(F.col("__before") + F.col("__nth") <= F.col("__left")).groupBy(*group, "party").agg(F.max("__k").alias("__most"))
    found = based.drop("__seats").join(totals.drop("__seats"), group, "left").join(extra, [*group, "party"], "left")
    sure = F.when(F.col(votes) > 0, F.greatest(F.floor(F.col(votes) * F.col("__low") + 0.5) - 1, F.lit(0)))
    return found.withColumn("won", F.coalesce("__most", sure, F.lit(0)).cast("long")).select(*parties.columns, "won")


def source_targets(sources: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (key, source_size) with the column target.

    Sources by code point, null last, weigh 3, 1, 2, repeating. share of all sizes is dealt by weight; a target
    stops at `most` times its source's size and the excess is dealt anew by weight. That is the level at which the
    sum of least(weight * level, most * size) meets the total: with sources ordered by the level at which
    each fills up, the first one that stays below its bound gives it (later ones give less).
    """
    turned = running_sums(sources, ["key"], {"__turn": F.lit(1)}, "mix-turns")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__turn") % len(weights) + 1).cast("int")).cast("double")
    weighed = turned.withColumn("weight", weight).drop("__turn").withColumn("bound", F.col("source_size") * F.lit(float(most)))
    weighed = weighed.withColumn("full_at", F.col("bound") / F.col("weight"))
    filled = running_sums(weighed, ["full_at", "key"], {"filled": F.col("bound"), "used_weight": F.col("weight")}, "mix-levels")
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if whole["weight"] is None:
        return filled.select(*sources.columns, F.col("bound").alias("target"))
    level = (F.lit(whole["size"] * float(share)) - F.col("filled")) / (F.lit(whole["weight"]) - F.col("used_weight"))
    fits = filled.where(level <= F.col("full_at")).agg(F.max(level)).first()[0]
    target = F.col("bound") if fits is None else F.least("bound", F.col("weight") * F.lit(fits))
    return filled.select(*sources.columns, target.alias("target"))


def mix(
    docs: DataFrame,
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
    block: int = 16,
    shard_rows: int = 4096,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target, taken, source for every row.

    size is the number of words of the text (null: 0). taken is the number of words that the mix takes from the row,
    repeats counted: the part of the row's words that lies in the blocks won by its shard, so at most `most`
    (2) times its size, and a source's sum is within a block for each of its shards of its target. A shard holds
    about shard_rows rows of one source, dealt by a seeded hash of the id, and the order inside is by
    another seeded hash, so reruns agree. Rows that repeat an id are kept apart by their text's hash; rows
    equal in both share the words by chance of order and are alike in all else. A source without words gets
    target 0; an empty table gives an empty result; other columns are ignored.
    """
    return _mixed_rows(docs, share, most, weights, block, shard_rows, seed, id_col, text_col, source_col).drop("text_hash")


def _mixed_rows(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, block: int = 16, shard_rows: int = 4096, seed: int = 17,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of mix() with text_hash, which tells texts of a repeated id apart."""
    text = text_of(text_col)
    key = F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"))
    sized = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), n_words(text).alias("size"), F.xxhash64(text).alias("text_hash"))
    sized = written(sized, "mix-sizes", compression="zstd")
    sources = sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    targets = written(source_targets(sources, share, most, weights), "mix-targets")
    seats = round((targets.agg(F.sum("target")).first()[0] or 0.0) / block)
    quotas = apportion(targets.withColumn("party", F.col("key")), F.lit(seats).cast("long"), [], "target")
    quotas = written(
        quotas.select("key", "source_size", "target", F.col("won").alias("quota"), F.ceil(F.col("n_rows") / shard_rows).cast("long").alias("n_shards")), "mix-quotas"
    )

    pick = F.xxhash64(F.lit(seed), "doc_id", "text_hash")
    order = F.xxhash64(F.lit(seed + 1), "doc_id", "text_hash")
    dealt = sized.join(quotas, "key").withColumn("party", F.pmod(pick, F.col("n_shards"))).withColumn("order", order)
    shards = dealt.groupBy("key", "party").agg(F.sum("size").cast("double").alias("shard_size"), F.first("quota").alias("source_quota"))
    shards = written(shards, "mix-shards")
    won = apportion(shards, F.col("source_quota"), ["key"], "shard_size").select("key", "party", "shard_size", F.col("won").alias("shard_quota"))
    stream = Window.partitionBy("key", "party").orderBy("order", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("end", F.sum("size").over(stream)).join(won, ["key", "party"])
    end, size = F.col("end").cast("double"), F.col("size").cast("double")
    words = F.col("shard_quota") * F.lit(float(block))
    part = lambda past: F.least(F.greatest(words - past - (end - size), F.lit(0.0)), size)
    return placed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (part(F.lit(0.0)) + part(F.col("shard_size"))).cast("long").alias("taken"),
        F.when(~F.col("key.none"), F.col("key.name")).alias("source"),
        "text_hash",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: each row as often as the words taken are, rounded, of its own (0, 1 or 2 times).

    Whole rows are repeated or left out, texts are never cut; rows without words take part in no mix and go. Rows that
    repeat an id are told apart by their text, and by number where that is equal too.
    """
    cols = docs.columns
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    mixed = _mixed_rows(docs, **options).where("size > 0")
    number = lambda by: F.row_number().over(Window.partitionBy("__id", "__hash").orderBy(by))
    wanted = mixed.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.round(F.col("taken") / F.col("size")).cast("int").alias("__times"))
    wanted = wanted.withColumn("__nth", number(F.desc("__times"))).where("__times > 0")
    wanted = wanted.select(*[F.col(c).alias(f"{c}_wanted") for c in ("__id", "__hash", "__nth")], "__times")
    keyed = docs.withColumn("__id", F.col(id_col)).withColumn("__hash", F.xxhash64(text_of(text_col)))
    keyed = keyed.withColumn("__nth", number(F.lit(0)))
    same = F.col("__id").eqNullSafe(F.col("__id_wanted")) & (F.col("__hash") == F.col("__hash_wanted")) & (F.col("__nth") == F.col("__nth_wanted"))
    return keyed.join(wanted, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(cols)
