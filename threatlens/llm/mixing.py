"""Mixing sources to target weights in fixed-length blocks of words.

Every source's words form one stream, cut into blocks of ``BLOCK`` words and a
shorter last one.  A source takes its target's number of words: in each epoch
the full blocks in the order of a pseudorandom index permutation of its own,
then the last block, until the number is reached; the final slot may be cut.

Every slot draws its output shard evenly and independently, so the counts of a
source per shard are multinomial, conditioned on the source's total, which is the
target.  Prefix sums of the counts give each shard its own slots of each source.
Permutations are keyed Feistel networks on the smallest grid that holds the
indices; images outside are sent through again until they fall inside.  Slots and
blocks then meet by (source, block index), and blocks and documents by the word
ranges of documents in their stream.

Sources are ordered by code point, null last, and weigh 1, 2, 3, repeating.
Targets share all words by weight, stop at ``MAX_EPOCHS`` times the source, and
the excess is shared again.  Streams are laid out in chunks by hash, so the
rows of a large source are spread over tasks; the layout follows ids and texts,
not files, and reruns agree.

Null texts have size 0 and are never taken.  Rows with equal ids count as
separate documents.  An empty table gives no rows; if no text has a word, all
targets are 0.  Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlens.llm import native, shared

BLOCK = 256             # words
SHARD_BLOCKS = 4096     # slots of an output shard, on average
MAX_EPOCHS = 3
CHUNK_ROWS = 20_000     # rows of a chunk of streams, on average
_RUN = 4096             # slots made from one row
_TASK_SLOTS = 1 << 20   # slots made in one task, on average
_SHARD_GROUP = 4096     # shards whose counts are summed in one window
_ROUNDS = 6             # of a permutation
#: Passes until an index falls inside: enough for every grid of up to 64 x 64, and beyond that
#: one more is needed with a chance below 1 in 64 ** 64; it would end the job, never a wrong index.
_PASSES = 64


def _ranked(rows: DataFrame, column: Column, name: str) -> DataFrame:
    """Adds the 0-based place in the order of a column; sorted by ranges, not in one task."""
    placed = shared.staged(rows.repartitionByRange(column).sortWithinPartitions(column)
                           .withColumn("at_", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at_", 33)
    sizes = placed.groupBy(part.alias("part_")).agg(F.count("*").alias("n_"))     # one row per partition
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    at = F.col("at_").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    return placed.withColumn("part_", part).join(F.broadcast(bases), "part_").withColumn(
        name, F.col("base_") + at).drop("at_", "part_", "base_")


def _key() -> Column:
    """The source as a key that null has too, in code-point order with null last."""
    return F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("a"), F.col("source"))).alias("key")


def sizes(docs: DataFrame) -> DataFrame:
    """row_no, doc_id, source key, words and a hash of the text."""
    numbered = shared.numbered(docs, "doc_id", "source", "text")
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(native.WORD)), F.lit(0)).cast("long")
    return numbered.select("row_no", "doc_id", _key(), words.alias("size"), F.xxhash64("text").alias("tie"))


def targets(sized: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """key, source_no, rows, source_size and target (double) of every source."""
    sums = sized.groupBy("key").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    sources = shared.staged(_ranked(sums, F.col("key"), "source_no").withColumn("weight", F.col("source_no") % 3 + 1),
                            "sources")
    whole = sources.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    if not whole.words:
        return sources.withColumn("target", F.lit(0.0))
    most = max_epochs * F.col("source_size")
    level, capped = whole.words / whole.weight, -1
    while True:         # the words that a unit of weight gets, once full sources are set aside
        full = sources.where(most <= F.lit(level) * F.col("weight")).agg(
            F.count("*").alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"),
            F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
        if full.n == capped or full.weight == whole.weight:
            break
        capped = full.n
        level = (whole.words - max_epochs * full.words) / (whole.weight - full.weight)
    return sources.withColumn("target", F.least(most.cast("double"), F.lit(level) * F.col("weight")))


def laid_out(sized: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """Every document with source_no and ``start``, the words of its stream before it."""
    known = shared.look_up(sized, sources.select("key", "source_no", "rows", "source_size", "target"), "key", "rows", rows)
    chunks = -(-rows // CHUNK_ROWS)
    chunked = known.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(max(1, chunks))))
    chunked = shared.staged(chunked, "mix-rows")
    sums = chunked.groupBy("source_no", "chunk").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source_no", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_no", "chunk").orderBy("doc_id", "tie", "size", "row_no").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = chunked.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(bases, ["source_no", "chunk"]).withColumn("start", F.col("base") + F.col("ahead")).drop(
        "base", "ahead", "chunk")


def permuted(index: Column, size: Column, key: Column) -> Column:
    """A keyed permutation of 0 .. size-1: alternate rounds add a hash of one coordinate to the other."""
    rows = F.greatest(F.ceil(F.sqrt(size.cast("double"))), F.lit(1)).cast("long")
    columns = F.ceil(size / rows).cast("long")

    def network(at: Column, grid: Column) -> Column:
        def round_(x: Column, r: Column) -> Column:
            low = x % grid["columns"]
            high = ((x - low) / grid["columns"]).cast("long")
            moved = (high + F.pmod(F.xxhash64(grid["key"], r, low), grid["rows"])) % grid["rows"]
            shifted = (low + F.pmod(F.xxhash64(grid["key"], r, high), grid["columns"])) % grid["columns"]
            return F.when(r % 2 == 0, moved * grid["columns"] + low).otherwise(high * grid["columns"] + shifted)
        return F.aggregate(F.sequence(F.lit(0), F.lit(_ROUNDS - 1)), at, round_)

    def walk(grid: Column) -> Column:
        inside = F.aggregate(F.sequence(F.lit(2), F.lit(_PASSES)), network(grid["at"], grid),
                             lambda x, _: F.when(x < grid["size"], x).otherwise(network(x, grid)))
        return native.bound(inside, lambda x: F.when(x < grid["size"], x).otherwise(
            F.raise_error(F.lit("an index did not return")).cast("long")))
    return native.bound(F.struct(index.cast("long").alias("at"), size.cast("long").alias("size"), key.alias("key"),
                                 rows.alias("rows"), columns.alias("columns")), walk)


def _runs(rows: DataFrame, count: str, first: Column, name: str, total: int) -> DataFrame:
    """Each row once for every number from ``first`` on, ``count`` of them, ``total`` in all; spread over tasks before that."""
    last = first + F.col(count) - 1
    cut = rows.where(F.col(count) > 0).withColumn("last_", last).withColumn(
        "first_", F.explode(F.sequence(first, last, F.lit(_RUN).cast("long"))))
    # A stated number of partitions: by the bytes of these short rows there would be too few.
    return cut.repartition(max(8, -(-total // _TASK_SLOTS)), "source_no", "first_").withColumn(name, F.explode(F.sequence(
        F.col("first_"), F.least(F.col("first_") + _RUN - 1, F.col("last_"))))).drop("first_", "last_")


def drawn(sources: DataFrame, total: int, shards: int) -> DataFrame:
    """source_no, shard, n and ``base``: how many slots of a source fall on a shard, and on shards before it."""
    none = F.lit(0).cast("long")
    draws = _runs(sources.select("source_no", "all_slots"), "all_slots", none, "draw", total)
    counts = draws.groupBy("source_no", F.pmod(F.xxhash64("source_no", "draw", F.lit(2)), F.lit(shards)).alias("shard")).agg(
        F.count("*").alias("n"))
    counts = shared.staged(counts.withColumn("group", F.floor(F.col("shard") / _SHARD_GROUP)), "shard-counts")

    def ahead(order: str, *keys: str) -> Column:
        before = Window.partitionBy("source_no", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(before), none)
    groups = counts.groupBy("source_no", "group").agg(F.sum("n").alias("n"))
    groups = groups.select("source_no", "group", ahead("group").alias("group_base"))
    inside = counts.withColumn("inside", ahead("shard", "group"))
    return inside.join(groups, ["source_no", "group"]).select(
        "source_no", "shard", "n", (F.col("group_base") + F.col("inside")).alias("base"))


def slots(sources: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """source_no, epoch, slot, block_no, words and shard of every block the mix takes."""
    size, take = F.col("source_size"), F.round("target").cast("long")
    some = sources.where(take > 0).select("source_no", size, F.floor(size / block).alias("full"), take.alias("take"))
    some = some.withColumn("per_epoch", F.ceil(size / block)).withColumn("rest", F.col("take") % size)
    some = some.withColumn("all_slots", ((F.col("take") - F.col("rest")) / size).cast("long") * F.col("per_epoch")
                           + F.ceil(F.col("rest") / block))
    made = some.agg(F.coalesce(F.sum("all_slots"), F.lit(0)).alias("n")).first().n
    counts = drawn(some, made, max(1, -(-made // shard_blocks))).join(some.drop("rest", "all_slots"), "source_no")
    each = _runs(counts, "n", F.col("base"), "number", made)
    slot = F.col("number") % F.col("per_epoch")
    each = each.withColumn("slot", slot).withColumn(
        "epoch", ((F.col("number") - F.col("slot")) / F.col("per_epoch")).cast("long"))
    words = F.least(size, F.col("take") - F.col("epoch") * size)
    left = F.least(F.lit(block).cast("long"), words - F.col("slot") * block)
    index = permuted(F.col("slot"), F.greatest("full", F.lit(1)), F.xxhash64("source_no", "epoch"))
    number = F.when(F.col("slot") < F.col("full"), index).otherwise(F.col("slot"))
    return each.select("source_no", "epoch", "slot", number.alias("block_no"), left.alias("words"), "shard")


def taken_ranges(placed: DataFrame, chosen: DataFrame, block: int = BLOCK) -> DataFrame:
    """row_no, epoch, shard, slot, first (word of the document) and words, joined by block index."""
    end = F.col("start") + F.col("size")
    held = placed.where("size > 0").select("row_no", "source_no", "start", end.alias("end"), F.explode(F.sequence(
        F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block_no"))
    begin = F.col("block_no") * block
    first = F.greatest(F.col("start"), begin)
    last = F.least(F.col("end"), begin + F.col("words"))
    # There are as many slots as blocks: never broadcast.
    joined = held.join(chosen.hint("merge"), ["source_no", "block_no"]).where(last > first)
    return joined.select("row_no", "source_no", "epoch", "shard", "slot", (first - F.col("start")).alias("first"),
                         (first - begin).alias("at"), (last - first).alias("words"))


def mix(docs: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """The documents with their source's size and target, and the word ranges that the mix takes of them."""
    shared.prepare(docs.sparkSession)
    sized = shared.staged(sizes(docs), "sizes")
    sources = shared.staged(targets(sized), "targets")
    placed = shared.staged(laid_out(sized, sources, sized.count()), "streams")
    return placed, shared.staged(taken_ranges(placed, slots(sources, block, shard_blocks), block), "mix-ranges")


def amounts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row."""
    placed, ranges = mix(docs, block)
    taken = ranges.groupBy("row_no").agg(F.sum("words").alias("taken"))
    return placed.join(taken, "row_no", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as documents: a row per document and epoch, with the columns of ``docs``.

    A document taken whole keeps its text; of others the words taken stand
    joined by single spaces.  ``docs`` must be read from files.
    """
    _, ranges = mix(docs, block)
    number, part = shared.free_name(docs, "mix_row_no"), shared.free_name(docs, "mix_part")
    parts = ranges.groupBy("row_no", "epoch").agg(F.struct(
        F.sum("words").alias("n"), F.sort_array(F.collect_list(F.struct("first", "words"))).alias("taken")).alias(part))
    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    rows = numbered.join(parts.select(F.col("row_no").alias(number), part), number)
    whole = F.regexp_count(F.col("text"), F.lit(native.WORD)) == F.col(f"{part}.n")
    cut = native.bound(native.words(F.col("text")), lambda w: F.array_join(F.flatten(F.transform(
        F.col(f"{part}.taken"), lambda p: F.slice(w, (p["first"] + 1).cast("int"), p["words"].cast("int")))), " "))
    rows = rows.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def sharded(docs: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The mix itself: shard, place (in the shard), source_no, epoch, slot, words and text of every block.

    A block's words stand joined by single spaces; blocks of a shard lie in pseudorandom
    order.  ``docs`` must be read from files.  Write it by ``shard`` to have the shards as files.
    """
    _, ranges = mix(docs, block, shard_blocks)
    parts = ranges.groupBy("row_no").agg(F.collect_list(F.struct(
        "source_no", "epoch", "shard", "slot", "at", "first", "words")).alias("parts"))
    texts = shared.numbered(docs, "text").join(parts, "row_no")
    pieces = texts.select(F.explode(native.bound(native.words(F.col("text")), lambda w: F.transform(
        F.col("parts"), lambda p: F.struct(p.alias("p"), F.array_join(F.slice(
            w, (p["first"] + 1).cast("int"), p["words"].cast("int")), " ").alias("text"))))).alias("e"))
    # A block holds at most ``block`` pieces, one word each.
    blocks = pieces.select("e.p.*", "e.text").groupBy("shard", "source_no", "epoch", "slot").agg(
        F.sum("words").alias("words"), F.sort_array(F.collect_list(F.struct("at", "text"))).alias("held"))
    order = Window.partitionBy("shard").orderBy(F.xxhash64("source_no", "epoch", "slot", F.lit(3)), "source_no", "epoch", "slot")
    return blocks.select("shard", (F.row_number().over(order) - 1).alias("place"), "source_no", "epoch", "slot", "words",
                         F.array_join(F.col("held.text"), " ").alias("text"))
