"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A key descends the tree. On each level every child draws ``ln(u) / weight`` from a hash of the key and
the child's name, and the largest draw wins, so a child wins in proportion to its weight. The draw of a
child depends on nothing but the key, its name and its weight (the sum of what is below it):

* where no weight changes, no key moves;
* where a subtree grows, keys move into it and nowhere else;
* inside a subtree whose weights are as before, every key stays where it was.

A layout is a value to be kept: ``uniform`` fills regions one after the other, and ``with_shard`` adds a shard in a
region of its own at the top of the tree, whatever the layout was, so that it takes keys only into itself.

Defined results: a null key hashes as the empty string; equal keys meet in one shard; an empty table gives
an empty result; a null text has size 1 and the CRC of no bytes (0).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import digest_int, materialise

SEED = "driftwell"
#: Chunks within a shard, for numbering. Fixed: the table of chunk counts has shards x CHUNKS rows at any input size.
CHUNKS = 4096


@dataclass(frozen=True)
class Topology:
    """weights[region][rack] is the list of (shard, weight) of that rack."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def uniform(shards: int, racks: int = 2, per_rack: int = 2) -> "Topology":
        """Shards of weight 1, filling rack by rack and region by region."""
        found: dict[int, dict[int, list[tuple[int, float]]]] = {}
        for s in range(shards):
            region, within = divmod(s, racks * per_rack)
            found.setdefault(region, {}).setdefault(within // per_rack, []).append((s, 1.0))
        return Topology(tuple(tuple(tuple(rack) for rack in region.values()) for region in found.values()))

    def with_shard(self, weight: float = 1.0) -> "Topology":
        """The layout with one more shard, in a region of its own; draws of all others stay as they were."""
        shard = 1 + max((s for region in self.regions for rack in region for s, _ in rack), default=-1)
        return Topology((*self.regions, (((shard, weight),),)))


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (digest_int(F.concat(F.lit(f"{SEED}:{name}:"), key)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.ln(u) / F.lit(float(weight))


def _winner(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """What stands below the child with the largest draw; the first one where draws tie."""
    if len(children) == 1:
        return children[0][2]
    best = F.array_max(F.array(*[F.struct(_draw(key, name, w).alias("d"), F.lit(-i).alias("i")) for i, (name, w, _) in enumerate(children)]))["i"]
    out = F.when(best == 0, children[0][2])
    for i, (_, _, below) in enumerate(children[1:], 1):
        out = out.when(best == -i, below)
    return out


def shard_of(key: Column, topology: Topology) -> Column:
    """The shard that a key (string) descends to. Only the draws on its path are evaluated."""
    key = F.coalesce(key, F.lit(""))
    regions = []
    for r, region in enumerate(topology.regions):
        racks = []
        for k, rack in enumerate(region):
            leaf = _winner(key, [(f"s{s}", w, F.lit(s)) for s, w in rack])
            racks.append((f"r{r}k{k}", sum(w for _, w in rack), leaf))
        regions.append((f"r{r}", sum(w for _, w, _ in racks), _winner(key, racks)))
    return _winner(key, regions)


def shard_documents(docs: DataFrame, shards: int = 8, layout: Topology | None = None) -> DataFrame:
    """Each document with its size, CRC, shard, gapless slot in the shard and its shard with one more of them.

    Slots number a shard's documents by chunk (a hash of doc_id, size and CRC), then doc_id, size and CRC. One chunk
    is sorted by one task; chunk counts, of a fixed number, give each chunk its first slot. The law is ``key``:
    doc_id and the layout decide, and one more shard (``with_shard``) takes rows only into itself.
    """
    layout = layout or Topology.uniform(shards)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        key.alias("_key"),
    )
    placed = materialise(
        sized.select(
            "doc_id", "size", "text_crc32",
            shard_of(F.col("_key"), layout).cast("int").alias("shard"),
            shard_of(F.col("_key"), layout.with_shard()).cast("int").alias("grown_shard"),
            F.pmod(digest_int(F.concat_ws(":", F.lit("slot"), "_key", F.col("size").cast("string"), F.col("text_crc32").cast("string"))), F.lit(CHUNKS)).cast("int").alias("_chunk"),
        )
    )
    counts = placed.groupBy("shard", "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_chunk").orderBy(F.col("doc_id").asc_nulls_last(), "size", "text_crc32")
    return (
        placed.withColumn("_row", F.row_number().over(within))
        .join(first, ["shard", "_chunk"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_row") - 1).cast("long").alias("slot"), "grown_shard")
    )
