"""Mixing sources to target weights, with DataFrame functions only.

Documents of a source follow one another as one stream of words, cut into fixed-length blocks. A source's target is
met by slots, one for each block of each pass over the source (the last pass may be a part pass). Every slot draws an
output shard, which gives each shard its multinomial counts of slots by source; a shard's slots of a source are then
the next range, as long as its count, of the source's running number of slots. A slot's number says its pass and its
place in the pass, and a pseudorandom permutation of the source's block indices, another for each pass, maps the
place to a block (swap-or-not: involutions that need no table and no sort). The last slot ends inside its block,
where the target is reached. Blocks are joined to documents by index: what a document gives is what these joins say.
A row of the mixed corpus goes whole to the shard of the slot that its first word is in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, small, stage

BLOCK, SHARDS, ROUNDS, SEED = 256, 64, 16, 17
#: Weights by a source's rank, repeating; share of all words; most times that a source is used.
WEIGHTS, SHARE_PERCENT, MOST = (5, 2, 1), 150, 2
#: Words of a shard that one task sorts, about.
SHARD_WORDS = 4_000_000
#: Documents in a piece of the corpus, within which a source's words are summed in order; pieces summed in one go.
PIECE, PIECES = 500, 1024
_WORD, _SPACED = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """Targets of sources (source, source_size): a row for each source, small however many documents there are.

    Sources sort by code point, null last, and weigh as `weights` say, repeating. Filling by weight with a cap of
    `most` times the size: sorted by cap over weight, the capped sources are the first ones, up to where an even
    level for the rest no longer exceeds the next cap.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(whole) * share_percent / 100 - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    filled = ranked.withColumn("level", level).withColumn("place", F.row_number().over(by_fill)).withColumn("fits", F.col("cap") >= F.col("level") * F.col("weight"))
    # The first source that fits in the order of filling, which tells sources of one cap over weight apart.
    first = F.min(F.when(F.col("fits"), F.struct("place", "level"))).over(whole)["level"]
    return filled.withColumn("settled", first).select("source", "source_size", "weight", F.when(F.col("settled").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("settled") * F.col("weight"))).alias("target"))


def permuted(slot: Column, n: Column, *key: Column) -> Column:
    """Position of `slot` under a keyed pseudorandom permutation of 0 .. n - 1 (swap-or-not)."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("shift"), r, *key), n) + n - x, n)
        return F.when(F.pmod(F.xxhash64(F.lit("swap"), r, F.greatest(x, other), *key), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), slot.cast("long"), step)


def _before(df: DataFrame, by: list[str], order: str, value: str) -> Column:
    """Sum of `value` over the earlier rows of a group."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sized documents with the place of their first word in their source's stream; sources.

    A document's place is the words of its source in earlier batches of pieces, in earlier pieces of its batch and before
    it in its piece: no sum runs over more than PIECE documents (about), PIECES pieces or the batches.
    """
    # The text's hash deals rows without an id, and different rows of one id, to pieces of their own.
    mark = F.xxhash64(F.col("doc_id").cast("long"), F.lit(SEED), "text")
    rows = stage(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), mark.alias("mark")), "sizes")
    pieces = max(1, rows.count() // PIECE)
    rows = rows.withColumn("piece", F.pmod("mark", F.lit(pieces)))
    sums = stage(rows.groupBy("source", "piece").agg(F.sum("size").alias("words")).withColumn("batch", F.floor(F.col("piece") / PIECES)), "piece_sums")
    batches = sums.groupBy("source", "batch").agg(F.sum("words").alias("words"))
    batches = stage(batches.select(F.col("source").alias("s"), F.col("batch").alias("b"), _before(batches, ["source"], "batch", "words").alias("earlier")), "batch_sums")
    starts = sums.withColumn("base", _before(sums, ["source", "batch"], "piece", "words"))
    starts = starts.join(small(batches), F.col("source").eqNullSafe(F.col("s")) & (F.col("batch") == F.col("b")))  # a row for PIECE x PIECES documents of a source
    starts = starts.select(F.col("source").alias("s"), F.col("piece").alias("p"), (F.col("base") + F.col("earlier")).alias("base"))
    within = Window.partitionBy("source", "piece").orderBy("doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("run", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = run.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("piece") == F.col("p"))).select("doc_id", "source", "size", (F.col("base") + F.col("run")).alias("start"))
    return placed, sums.groupBy("source").agg(F.sum("words").alias("source_size"))


def mix_plan(docs: DataFrame, weights: tuple = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """What the mix takes: (documents, slots).

    documents: doc_id, source, size, source_size, target, taken (words) and ranges (array of struct<pass, from, words,
    shard>: words taken in a pass, by place in the document, ascending). slots: source, pass, place, block, words, shard.
    A null source is a source; a document without words is taken no words of.
    """
    placed, sums = _placed(docs)
    key = [F.coalesce("source", F.lit("\0null")), F.lit(seed), F.lit(shards)]
    sources = source_targets(sums, weights, share_percent, most).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    sources = sources.withColumn("full", full).withColumn("rest", F.round(F.col("target") - F.col("full") * F.col("source_size")).cast("long"))
    # Where the part pass has the stream's short last block.
    sources = stage(sources.withColumn("tail", permuted_inverse(F.col("blocks") - 1, F.greatest(F.col("blocks"), F.lit(1)), *key, F.col("full"))), "targets")
    sources = sources.withColumnRenamed("source", "s")
    known = stage(placed.join(small(sources), F.col("source").eqNullSafe(F.col("s"))).drop("s", "weight"), "placed")

    # Each document names the blocks that begin in it, so the numbers of a source's slots arise where its documents are.
    first, end = F.ceil(F.col("start") / block).cast("long"), F.col("start") + F.col("size")
    begins = known.filter(F.col("size") > 0).filter(first * block < end)
    begins = begins.select("source", "source_size", "blocks", "full", "rest", "tail", F.explode(F.sequence(first, F.floor((end - 1) / block).cast("long"))).alias("place"))
    passes = F.col("full") + (F.col("rest") > 0).cast("long")
    slots = begins.filter(passes > 0).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)))
    # Words the part pass takes before this slot: whole blocks, but for the short last block if its slot came earlier.
    before = F.col("place") * block - F.when(F.col("place") > F.col("tail"), F.col("blocks") * block - F.col("source_size")).otherwise(0)
    slots = slots.withColumn("left", F.when(F.col("pass") < F.col("full"), F.lit(block)).otherwise(F.col("rest") - before)).filter("left > 0")
    slots = slots.withColumn("slot", F.col("pass") * F.col("blocks") + F.col("place"))
    # The draws, and the range of slots that each shard's count gives it: SHARDS numbers for each source.
    drawn = slots.groupBy("source", F.pmod(F.xxhash64(F.lit("shard"), "slot", *key), F.lit(shards)).alias("shard")).agg(F.count("*").alias("slots"))
    starts = drawn.withColumn("start", _before(drawn, ["source"], "shard", "slots"))
    starts = stage(starts.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("start", "shard"))).alias("starts")), "shard_starts")
    slots = slots.join(small(starts.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
    own = F.element_at(F.filter("starts", lambda x: x["start"] <= F.col("slot")), -1)["shard"]
    slots = slots.withColumn("block", permuted(F.col("place"), F.col("blocks"), *key, F.col("pass"))).withColumn("shard", own)
    words = F.least(F.lit(block), F.col("source_size") - F.col("block") * block, F.col("left"))
    slots = slots.select("source", "pass", "place", "block", words.alias("words"), "shard")

    touched = known.filter("size > 0").withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / block).cast("long"), F.floor((end - 1) / block).cast("long"))))
    given = slots.select(F.col("source").alias("s"), F.col("block").alias("sb"), "pass", "words", "shard")
    a, z = F.greatest(F.col("start"), F.col("b") * block), F.least(end, F.col("b") * block + F.col("words"))
    parts = touched.join(given, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("sb"))).filter(z > a)
    parts = parts.select("doc_id", "source", "start", F.struct("pass", (a - F.col("start")).alias("from"), (z - a).alias("words"), "shard").alias("range"))
    # The documents with words of a source have different starts.
    ranges = parts.groupBy("doc_id", "source", "start").agg(F.sum("range.words").alias("taken"), F.array_sort(F.collect_list("range")).alias("ranges"))
    ranges = ranges.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("start").alias("at"), "taken", "ranges")
    both = known.join(ranges, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("at")) & (F.col("size") > 0), "left")
    none = F.array().cast("array<struct<pass:bigint,from:bigint,words:bigint,shard:bigint>>")
    return both.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("ranges", none).alias("ranges")), slots


def permuted_inverse(place: Column, n: Column, *key: Column) -> Column:
    """The slot that permuted() maps to `place`: every round is its own inverse, so they run backwards."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("shift"), r, *key), n) + n - x, n)
        return F.when(F.pmod(F.xxhash64(F.lit("swap"), r, F.greatest(x, other), *key), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)), place.cast("long"), step)


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """Words of each document that the mix takes: doc_id, source, size, source_size, target, taken. A row for each row.

    Null and empty texts have size 0. Repeated rows are documents of their own. A null source counts as one. Other
    columns play no part; an empty table gives an empty result.
    """
    return mix_plan(docs, **options)[0].drop("ranges")


def shard_counts(docs: DataFrame, **options) -> DataFrame:
    """What each output shard takes of each source, over all passes: source, shard, slots, words."""
    return mix_plan(docs, **options)[1].groupBy("source", "shard").agg(F.count("*").alias("slots"), F.sum("words").alias("words"))


def mix_documents(docs: DataFrame, shard: bool = False, **options) -> DataFrame:
    """The mixed corpus, in the columns of `docs`: a row for each pass that takes words of a document, its text as it is
    if the pass takes all, else the words taken with the white space after each. Documents without words stay, once,
    as they are. Columns named n_chars follow the text; others are carried along, whatever their names.

    A shard's rows stand together, in hashed order (in several partitions if they are very many); `shard` adds its number as a last column. Rows that share doc_id,
    source and size are taken in any order; an empty table gives an empty result.
    """
    shards, seed = options.get("shards", SHARDS), options.get("seed", SEED)
    key, own, n, at, rank, taken, put, to = fresh(docs, "_key", "_own", "_n", "_at", "_rank", "_taken", "_put", "_shard")
    identity = lambda d, s, size: F.struct(d.cast("long").alias("d"), s.cast("string").alias("s"), size.alias("n"))
    plan = mix_plan(docs, **options)[0]
    plan = stage(plan.groupBy(identity(F.col("doc_id"), F.col("source"), F.col("size")).alias(at)).agg(F.array_sort(F.collect_list("ranges")).alias(own)), "mix_plan")
    sized = docs.withColumn(n, word_count(F.col("text"))).withColumn(key, identity(F.col("doc_id"), F.col("source"), col(n)).cast(plan.schema[at].dataType))  # of the very type, so that join and window share a shuffle
    both = sized.join(plan, col(key) == col(at)).withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64("text"))))
    ranges = F.element_at(col(own), col(rank))
    empty = F.array(F.struct(F.lit(0).cast("long").alias("pass"), F.lit(0).cast("long").alias("from"), F.lit(0).cast("long").alias("words"), F.pmod(F.xxhash64(F.lit("shard"), "doc_id", F.lit(seed)), F.lit(shards)).alias("shard")))
    ranges = F.when(col(n) == 0, empty).otherwise(ranges)
    # Ranges of one pass together.
    of_pass = F.transform(F.array_distinct(F.transform(ranges, lambda r: r["pass"])), lambda p: F.filter(ranges, lambda r: r["pass"] == p))
    rows = both.withColumn(taken, F.explode(of_pass))
    words = F.regexp_extract_all("text", F.lit(_SPACED), F.lit(0))
    part = F.array_join(F.flatten(F.transform(taken, lambda r: F.slice(words, (r["from"] + 1).cast("int"), r["words"].cast("int")))), "")
    whole = F.aggregate(taken, F.lit(0).cast("long"), lambda x, r: x + r["words"]) == col(n)
    out = rows.withColumn(put, F.when(whole, F.col("text")).otherwise(part)).withColumn(to, col(taken)[0]["shard"])
    # A shard of more words than a task should sort falls into parts.
    words = plan.agg(F.sum(F.aggregate(F.flatten(own), F.lit(0).cast("long"), lambda x, r: x + r["words"]))).first()[0] or 0
    parts = 1 + words // (shards * SHARD_WORDS)
    out = out.repartition(shards * parts, col(to), F.pmod(F.xxhash64("doc_id"), F.lit(parts))).sortWithinPartitions(to, F.xxhash64("doc_id", col(taken)[0]["pass"], F.lit(seed)))
    more = [col(to).alias("shard")] if shard else []
    return out.select([col(put).alias("text") if c == "text" else (F.coalesce(F.length(put), F.lit(0)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else col(c)) for c in docs.columns] + more)
