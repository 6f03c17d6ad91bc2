"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. A source's target is its weighted share of the budget, but at most ``max_repeat`` times its size; what a
   capped source cannot use goes to the others by weight (``source_targets``).
2. The budget in blocks of ``block`` words is apportioned to the sources by highest quotients target/(2k+1).
3. Each source's documents are dealt to shards of about ``shard_words`` words; the source's blocks are
   apportioned to its shards by highest quotients of their words, at most ``max_repeat`` times a shard's blocks.
4. In a shard, documents stand in a seeded order and are cut into blocks. A quota of q of n blocks takes every
   block q // n times, and the q % n blocks with the lowest seeded hashes once more.
5. A document takes the words of its taken blocks, repeats counted: at most ``max_repeat`` times its size.

Highest quotients are found without walking through seats: with v_i votes, V in all, S seats and n parties,
the divisor V/(S - n/2) surely grants no more than S, and V/(S + n/2) no fewer, so only the few quotients
between the two (about 2n in all) are ranked.

Windows are over the sources, over a source's shards (a row for each ``shard_words`` words of it) or within a shard.
Blocks are made where their shard was sent first, about TASK_BLOCKS a task. Draws are MD5 of the seed and doc_id, or
of the text where there is no id, so reruns agree.

Defined results: null text has size 0 and takes 0; a null source is a source of its own, last in order; rows
without a doc_id draw by their texts; equal rows are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, carried, digest_int, materialise, restored

SEED = "mix-1"
WEIGHTS = (3, 1, 2)
BLOCK = 64
SHARD_WORDS = 1 << 20
#: Blocks that one task makes and ranks.
TASK_BLOCKS = 250_000


def source_targets(sizes: DataFrame, budget_share: float = 1.5, max_repeat: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> with weight and target.

    A level L is found with sum of min(cap, weight * L) = budget: in ascending order of cap/weight, the first
    source whose level (what is left, shared among it and all after it) is at most its cap/weight. One row per
    source, in one window.
    """
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    s = sizes.withColumn("_rank", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(max_repeat)).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    order = Window.orderBy("_ratio", "_rank")
    s = s.withColumn("_budget", F.sum("source_size").over(everything) * F.lit(budget_share))
    s = s.withColumn("_before", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("_after", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_level", (F.col("_budget") - F.col("_before")) / F.col("_after"))
    s = s.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(everything)["_level"])
    return s.select("source", "source_size", "weight", F.least(F.col("_cap").cast("double"), F.col("weight") * F.col("_level")).alias("target"))


def apportion(parties: DataFrame, within: list[str], party: list[str], votes: str, seats: str, cap: str) -> DataFrame:
    """Add ``quota``: ``seats`` seats of each group ``within`` dealt to its parties by highest quotients votes/(2k+1).

    Ties go to the party that comes first by its columns. No party gets more than its ``cap``; seats that a
    capped party would win next go to the next quotient. ``seats`` is the same on all rows of a group.
    """
    group = Window.partitionBy(*within)
    v, n, total = F.col(votes).cast("double"), F.count("*").over(group), F.sum(F.col(votes).cast("double")).over(group)
    clash = {"_n", "_v", "_low", "_high", "_left", "_k", "_rank", "_more"} & set(parties.columns)
    if clash:
        raise ValueError(f"column names in use: {sorted(clash)}")
    p = parties.withColumns({"_n": n, "_v": total})
    low_seats, high_seats = F.col(seats) - F.col("_n") / 2, F.col(seats) + F.col("_n") / 2
    granted = lambda s: F.when((F.col("_v") > 0) & (s > 0), F.floor(v * s / F.col("_v") + 0.5)).otherwise(F.lit(0)).cast("long")
    p = p.withColumns({"_low": F.least(granted(low_seats), F.col(cap)), "_high": F.least(granted(high_seats) + 1, F.col(cap))})
    p = p.withColumn("_left", F.col(seats) - F.sum("_low").over(group))
    ranked = (
        p.filter((F.col("_high") > F.col("_low")) & (v > 0))
        .withColumn("_k", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)))
        .withColumn("_rank", F.row_number().over(group.orderBy((v / (2 * F.col("_k") + 1)).desc(), *[F.col(c).asc_nulls_last() for c in party], "_k")))
        .filter(F.col("_rank") <= F.col("_left"))
        .groupBy(*within, *party).agg(F.count("*").alias("_more"))
    )
    keys = list(dict.fromkeys([*within, *party]))
    ranked = ranked.select(*[F.col(c).alias(f"_of_{c}") for c in keys], "_more")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    return p.join(ranked, same, "left").select(*parties.columns, (F.col("_low") + F.coalesce(F.col("_more"), F.lit(0))).alias("quota"))


def _draw(name: str, *key: Column) -> Column:
    return digest_int(F.concat_ws(":", F.lit(f"{SEED}:{name}"), *key))


def _mix(docs: DataFrame, budget_share: float, max_repeat: int, block: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """(documents with their place, their words in each block and how often it's taken)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialise(docs.select("doc_id", "source", words.alias("size"), _draw("doc", key).alias("_draw"), _text_key().alias("_key")))

    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), budget_share, max_repeat)
    everything = Window.partitionBy()
    blocks_all = F.round(F.sum("target").over(everything) / block).cast("long")
    sources = sources.withColumns({"_one": F.lit(1), "_seats": blocks_all, "_cap": F.ceil(F.col("source_size") / block) * max_repeat})
    sources = apportion(sources, ["_one"], ["source"], "target", "_seats", "_cap").withColumnRenamed("quota", "_blocks")
    sources = sources.withColumn("_shards", F.ceil(F.col("source_size") / F.lit(shard_words)))
    sources = materialise(sources.select(F.col("source").alias("_source"), "source_size", "target", "_blocks", F.greatest(F.col("_shards"), F.lit(1)).alias("_shards")))

    placed = sized.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_shard", F.pmod(F.col("_draw"), F.col("_shards")))
    # A shard is named by its source as well; null sources need a name of their own in equi-joins.
    placed = placed.withColumn("_name", F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce(F.col("source"), F.lit(""))))
    shard = Window.partitionBy("_name", "_shard")
    start = F.sum("size").over(shard.orderBy("_draw", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = placed.withColumn("_start", start)

    shards = placed.groupBy("_name", "_shard").agg(F.sum("size").alias("_words"), F.first("_blocks").alias("_blocks"))
    shards = shards.withColumn("_count", F.ceil(F.col("_words") / block)).withColumn("_cap", F.col("_count") * max_repeat)
    shards = apportion(shards, ["_name"], ["_shard"], "_words", "_blocks", "_cap")
    blocks_of_all = sources.agg(F.sum("source_size")).first()[0] or 0
    picks = (
        shards.filter(F.col("_count") > 0)
        .repartition(int(blocks_of_all // (block * TASK_BLOCKS)) + 1, "_name", "_shard")  # the window below keeps this
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1)))
        .withColumn("_rank", F.row_number().over(shard.orderBy(_draw("block", F.col("_name"), F.col("_shard").cast("string"), F.col("_block").cast("string")), "_block")))
        .select("_name", "_shard", "_block", (F.floor(F.col("quota") / F.col("_count")) + F.when(F.col("_rank") <= F.col("quota") % F.col("_count"), 1).otherwise(0)).alias("_times"))
    )
    # A shard's taken blocks as a sorted list of their first words would not fit hot shards in one row, so blocks meet
    # the documents on (shard, block); a document spans size / block + 1 of them.
    end = F.col("_start") + F.col("size")
    spans = placed.filter(F.col("size") > 0).select(
        "doc_id", "_key", "source", "size", "source_size", "target", "_name", "_shard", "_start",
        F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((end - 1) / block))).alias("_block"),
    )
    # Few shards make many blocks within one stage, so their size as Spark sees it would have them broadcast.
    return placed, spans.join(picks.hint("merge"), ["_name", "_shard", "_block"])


def _text_key() -> Column:
    """Names a document by its id and its text."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(F.col("text").cast("string")).cast("string"))


def mix_documents(docs: DataFrame, budget_share: float = 1.5, max_repeat: int = 2, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each document."""
    placed, spans = _mix(docs, budget_share, max_repeat, block, shard_words)
    overlap = F.least(F.col("_start") + F.col("size"), (F.col("_block") + 1) * block) - F.greatest(F.col("_start"), F.col("_block") * block)
    doc = ["_name", "_shard", "_start"]  # one document of size > 0 each
    taken = (
        spans.groupBy(*doc, "doc_id", "source", "size", "source_size", "target")
        .agg(F.sum(overlap * F.col("_times")).cast("long").alias("taken"))
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )
    empty = placed.filter(F.col("size") == 0).select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return taken.unionAll(empty)


def mix_texts(docs: DataFrame, budget_share: float = 1.5, max_repeat: int = 2, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each time that words of a document are taken.

    The c-th row of a document has the words that are taken c times at least, in their order, joined by spaces;
    where those are all of them the text stays as it was. ``n_chars``, if there, is counted anew. Rows alike in
    id and text are mixed each; their other columns are those of the first by all columns.
    """
    _, spans = _mix(docs, budget_share, max_repeat, block, shard_words)
    low = F.greatest(F.col("_block") * block - F.col("_start"), F.lit(0))
    high = F.least((F.col("_block") + 1) * block - F.col("_start"), F.col("size"))
    # A document's spans: one for each block of its words.
    taken = spans.filter(F.col("_times") > 0).groupBy("_key", "_name", "_shard", "_start", "size").agg(
        F.sort_array(F.collect_list(F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), F.col("_times").alias("times")))).alias("_spans")
    )
    keyed = carried(docs, ["doc_id", "text"]).withColumn("_key", _text_key())
    if keyed.groupBy("_key").count().filter("count > 1").limit(1).count():
        keyed = keyed.withColumn("_first", F.row_number().over(Window.partitionBy("_key").orderBy("_row"))).filter("_first = 1").drop("_first")
    mixed = keyed.join(taken.select("_key", "size", "_spans"), "_key").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(max_repeat))))
    mixed = mixed.withColumn("_spans", F.filter("_spans", lambda s: s["times"] >= F.col("_copy"))).filter(F.size("_spans") > 0)
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(WORD), F.lit(0))
    parts = F.flatten(F.transform("_spans", lambda s: F.slice(F.col("_words"), s["low"] + 1, s["high"] - s["low"])))
    whole = F.aggregate("_spans", F.lit(0), lambda n, s: n + s["high"] - s["low"]) == F.col("size")
    mixed = mixed.withColumn("_words", F.when(~whole, words)).withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(parts, " ")))
    counted = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return restored(mixed, docs, text=F.col("text"), **counted)
