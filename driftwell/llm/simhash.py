"""Near-duplicates by SimHash fingerprints and BK-trees.

1. A fingerprint has a bit for each of 64 positions: 1 if over half of the text's shingle hashes have it set.
2. Equal fingerprints are one class at once; only distinct fingerprints are compared.
3. Two fingerprints with at most ``radius`` differing bits, cut into ``radius + 2`` ranges of bits, agree in two
   ranges at least. So each fingerprint goes to the shard of each pair of ranges, named by those bits. No link
   is lost, and a shard of random fingerprints stays small at any size (25 bits name it for radius 3).
4. A shard is searched by BK-trees: a node's children are keyed by their Hamming distance to it, and a search
   follows only the edges whose key is within the radius of the distance to the node. Shards of more than
   TREE fingerprints are cut into trees of about TREE by a hash (``in_trees``); each tree is shipped, whole, to the
   tasks that probe it, as many as its probes need.
   For a wider net (``similar_documents``), fingerprints have more bits, each different shingle counts once, shards
   are named by bands of bits, and groups of candidates are then compared by the sets of shingles.
5. A tree's links leave as a spanning forest (at most one link for each fingerprint and tree); connected
   components join them over all shards.

Defined results: a text without words, or null, has fingerprint zero, which is linked like any other; words
are maximal runs of anything but ASCII white space; fewer words than a shingle has are one shingle; rows with
null ids are fingerprinted, and take part in linking, but name no component unless all of it has null ids
(then component_id is null); repeated rows share a component; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from .common import carried, if_small, materialise, restored, text_batches
from .components import connected_components

SHINGLE = 3
RADIUS = 3
TREE = 4096


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many rows of hashes[row, word] have each bit set: counts[word * 64 + bit].

    Lanes of eight bits are summed side by side in whole words, 255 rows at a time, which no lane overflows.
    """
    n, k = hashes.shape
    ones, counts = np.uint64(0x0101010101010101), np.zeros((k, 8, 8), np.int64)
    for at in range(0, n, 255 * 64):
        part = hashes[at : at + 255 * 64]
        full = np.zeros((-(-len(part) // 255) * 255, k), np.uint64)
        full[: len(part)] = part
        full = full.reshape(-1, 255, k)
        for b in range(8):
            lanes = ((full >> np.uint64(b)) & ones).sum(axis=1, dtype=np.uint64)
            counts[:, :, b] += np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, k, 8).sum(axis=0, dtype=np.int64)
    return counts.reshape(-1)


def widened(hashes: np.ndarray, words: int) -> np.ndarray:
    """hashes[row, word]: the hashes themselves, then hashes of them, as good as independent."""
    out = np.empty((len(hashes), words), np.uint64)
    out[:, 0] = hashes
    for w in range(1, words):
        x = hashes + np.uint64(0x9E3779B97F4A7C15 * w % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, w] = x ^ (x >> np.uint64(31))
    return out


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """A hash for each shingle, repeats too. bytes.split() and bytes.lower() know ASCII alone, as the rules ask."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(tokens) <= shingle:
        shingles = iter([b" ".join(tokens)] if tokens else [])
    else:
        shingles = map(b" ".join, zip(*[tokens[i:] for i in range(shingle)], strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in shingles), np.uint64)


def hash_fingerprint(h: np.ndarray, words: int = 1) -> bytes:
    """64 * words bits, least significant first."""
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 255 * 64):
        counts += bit_counts(widened(h[at : at + 255 * 64], words))
    return np.packbits(2 * counts > len(h), bitorder="little").tobytes()


def text_fingerprint(text: str | None, shingle: int = SHINGLE, words: int = 1) -> bytes:
    """The fingerprint of a text's shingles, each as often as it stands there."""
    return hash_fingerprint(shingle_hashes(text, shingle), words)


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long of the same 64 bits."""

    @F.pandas_udf(LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.frombuffer(b"".join(text_fingerprint(t, shingle) for t in texts), "<i8"))

    return of(text.cast("string"))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of a text's different shingles, ascending."""
    return np.unique(shingle_hashes(text, shingle))


def set_mark(hashes: np.ndarray) -> bytes:
    """A name of the set itself, which other sets don't have."""
    return hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=16).digest()


def wide_fingerprint(text: Column, shingle: int, words: int) -> Column:
    """(f, mark): a fingerprint of 64 * words bits of the set of shingles, as bytes, and the set's name."""

    @F.pandas_udf("f binary, mark binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        both = [(hash_fingerprint(h, words), set_mark(h)) for h in (shingle_set(t, shingle) for t in texts)]
        return pd.DataFrame(both, columns=["f", "mark"])

    return of(text.cast("string"))


class BKTree:
    """Fingerprints, each once; children keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Numbers of the nodes within the radius."""
        found, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            node = todo.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            edges = children[node]
            if len(edges) > 2 * radius + 1:
                todo += [edges[k] for k in range(d - radius, d + radius + 1) if k in edges]
            else:
                todo += [child for k, child in edges.items() if -radius <= k - d <= radius]
        return found

    def add(self, value: int) -> int:
        """The number of the value's node."""
        node = 0
        while node < len(self.values):
            d = (self.values[node] ^ value).bit_count()
            if not d:
                return node
            if d not in self.children[node]:
                self.children[node][d] = len(self.values)
                break
            node = self.children[node][d]
        self.values.append(value)
        self.children.append({})
        return len(self.values) - 1


class _Shard:
    """A tree and the classes of its nodes; yields links that join classes, so a forest."""

    def __init__(self, radius: int) -> None:
        self.tree, self.parent, self.radius = BKTree(), [], radius

    def root(self, node: int) -> int:
        while self.parent[node] != node:
            self.parent[node] = self.parent[self.parent[node]]
            node = self.parent[node]
        return node

    def grow(self, value: int) -> Iterator[int]:
        near = self.tree.near(value, self.radius)
        node = self.tree.add(value)
        if node == len(self.parent):
            self.parent.append(node)
        yield from self._meet(near, node)

    def probe(self, value: int) -> Iterator[int]:
        """The links of a fingerprint that the tree doesn't hold; it joins what it is near to."""
        near = self.tree.near(value, self.radius)
        if near:
            yield self.tree.values[near[0]]
            yield from self._meet(near[1:], near[0])

    def _meet(self, near: list[int], node: int) -> Iterator[int]:
        for other in near:
            a, b = self.root(other), self.root(node)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                yield self.tree.values[other]


def _link(radius: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by shard, tree and part, a tree's own fingerprints first."""
        last, shard = None, None
        for rows in batches:
            u, v = [], []
            for *key, role, f in rows[["_pair", "_bits", "_tree", "_part", "_role", "_f"]].itertuples(index=False, name=None):
                if key != last:
                    last, shard = key, _Shard(radius)
                value = f & 0xFFFFFFFFFFFFFFFF
                for other in (shard.probe if role == PROBES else shard.grow)(value):
                    if role != SHOWN:
                        u.append(f)
                        v.append(other - (1 << 64) if other >> 63 else other)
            yield pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    return link


#: What a fingerprint is to a tree: one of its own, whose links are told; one of its own in a further copy; a probe.
OWN, SHOWN, PROBES = 0, 1, 2
#: Probes of a part, in trees.
PART = 4


def in_trees(keyed: DataFrame, shard: list[str], tree: int, node: Column) -> DataFrame:
    """Deal the fingerprints of each shard to trees: rows with _tree, _part and _role.

    A shard of more than ``tree`` fingerprints is cut into trees by a hash. Each tree holds its own and is probed by
    those of later trees; where these are more than PART trees' worth, the tree is copied, and each copy gets a part
    of the probes, so that no task has more than a few trees' worth of rows, however large the shard is.
    """
    large = materialise(keyed.groupBy(*shard).agg(F.count("*").alias("_n")).filter(F.col("_n") > tree))
    large = if_small(large.select(*shard, F.ceil(F.col("_n") / tree).cast("int").alias("_trees")))
    own = F.pmod(F.xxhash64(node), F.col("_trees")).cast("int")
    placed = keyed.join(large, shard, "left").withColumn("_trees", F.coalesce("_trees", F.lit(1))).withColumn("_own", own)
    parts = lambda t: F.greatest(F.ceil((F.col("_trees") - 1 - t) / PART), F.lit(1)).cast("int")
    place = lambda t, p, role: F.struct(t.alias("_tree"), p.cast("int").alias("_part"), role.alias("_role"))
    copies = F.transform(F.sequence(F.lit(0), parts(F.col("_own")) - 1), lambda p: place(F.col("_own"), p, F.when(p == 0, OWN).otherwise(SHOWN)))
    probes = F.transform(F.sequence(F.lit(0), F.col("_own") - 1), lambda t: place(t, F.pmod(F.xxhash64(node, t), parts(t)), F.lit(PROBES)))
    places = F.when(F.col("_own") == 0, copies).otherwise(F.concat(copies, probes))
    dealt = placed.withColumn("_at", F.explode(places)).select(*keyed.columns, "_at.*")
    key = [*shard, "_tree", "_part"]
    return dealt.repartition(*key).sortWithinPartitions(*key, "_role")


def bit_ranges(radius: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of radius + 2 ranges of nearly equal width."""
    n = radius + 2
    starts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(starts, starts[1:], strict=False)]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Links (u, v) that join the column ``_f`` of distinct fingerprints into the classes of the radius."""
    ranges = bit_ranges(radius)
    cut = lambda i: F.shiftrightunsigned("_f", ranges[i][0]).bitwiseAND((1 << ranges[i][1]) - 1)
    pairs = list(combinations(range(len(ranges)), 2))
    named = F.array(*[F.struct(F.lit(n).alias("_pair"), F.shiftleft(cut(a), 32).bitwiseOR(cut(b)).alias("_bits")) for n, (a, b) in enumerate(pairs)])
    keyed = distinct.select("_f", F.explode(named).alias("_s")).select("_f", "_s._pair", "_s._bits")

    return in_trees(keyed, ["_pair", "_bits"], tree, F.col("_f")).mapInPandas(_link(radius), "u long, v long")


def similar_radius(similarity: float, bits: int, deviations: float = 1) -> int:
    """Differing bits to be expected of two sets with this Jaccard similarity, and some standard deviations more.

    Shingle sets of similarity s and like size have the cosine 2s / (1 + s); a bit differs where a random plane
    parts them, that is with the probability of their angle over pi.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


class _Candidates(_Shard):
    """A tree whose values have nodes."""

    def __init__(self, radius: int) -> None:
        super().__init__(radius)
        self.nodes: dict[int, int] = {}

    def forest(self, value: int, node: int, probes: bool) -> Iterator[int]:
        """Nodes that join the value to classes of near values."""
        for other in (self.probe if probes else self.grow)(value):
            yield self.nodes[other]
        if not probes:
            if value in self.nodes:
                yield self.nodes[value]
            self.nodes.setdefault(value, node)


def _link_wide(radius: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, shard = None, _Candidates(radius)
        for rows in batches:
            u, v = [], []
            for *key, role, node, f in rows[["_shard", "_tree", "_part", "_role", "_id", "_f"]].itertuples(index=False, name=None):
                if key != last:
                    last, shard = key, _Candidates(radius)
                for other in shard.forest(int.from_bytes(f, "little"), node, role == PROBES):
                    if role != SHOWN and other != node:
                        u.append(node)
                        v.append(other)
            yield pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    return link


def wide_links(distinct: DataFrame, radius: int, words: int, tree: int = TREE) -> DataFrame:
    """Candidate links (u, v) of ids (``_id``, ``_f``) that agree in a band of bits and differ in ``radius`` bits at most.

    Each tree gives a forest, which joins what any candidate pair of it joins. A shard is named by a band of 16 bits,
    so with n fingerprints it has n / 65536 on the average; more words give more bands, and pairs more chances to meet.
    """
    keyed = distinct.select("_id", "_f", F.explode(F.sequence(F.lit(0), F.lit(4 * words - 1))).alias("_band"))
    bits = F.conv(F.hex(F.substring("_f", F.col("_band") * 2 + 1, F.lit(2))), 16, 10).cast("int")
    keyed = keyed.select("_id", "_f", (F.col("_band") * 65536 + bits).alias("_shard"))
    return in_trees(keyed, ["_shard"], tree, F.col("_id")).mapInPandas(_link_wide(radius), "u long, v long")


#: A chunk of a group of candidates: members, and bytes of their texts.
CHUNK, CHUNK_BYTES = 1024, 2 << 20


def similar_pairs(left: list[tuple[int, set, np.ndarray]], right: list[tuple[int, set, np.ndarray]] | None, similarity: float, radius: int) -> Iterator[tuple[int, int]]:
    """Links (u, v) that join members (node, set, fingerprint) as all pairs of this Jaccard similarity or more would.

    Pairs within ``left`` or, if ``right`` is given, of one of either. Nearest fingerprints are tried first, pairs
    that are joined already or whose sizes are too different aren't tried.
    """
    members = left + (right or [])
    if not members:
        return
    prints, sizes = np.stack([f for _, _, f in members]), np.array([len(s) for _, s, _ in members])
    root = np.arange(len(members))
    for i in range(len(left) if right is not None else 1, len(members)):
        end = len(left) if right is not None else i
        far = np.bitwise_count(prints[:end] ^ prints[i]).sum(axis=1)
        fits = np.minimum(sizes[:end], sizes[i]) >= similarity * np.maximum(sizes[:end], sizes[i])
        near = np.flatnonzero((far <= radius) & fits & (root[:end] != root[i]))
        own = members[i][1]
        for j in near[np.argsort(far[near], kind="stable")]:
            if root[j] == root[i]:
                continue
            other = members[j][1]
            both = len(own & other)
            if both >= similarity * (len(own) + len(other) - both):
                root[root == root[i]] = root[j]
                yield members[i][0], members[j][0]


def confirmed_links(candidates: DataFrame, texts_of: Callable[[DataFrame], DataFrame], similarity: float, shingle: int, words: int) -> DataFrame:
    """Links (u, v) of ids whose sets of shingles have this Jaccard similarity, among those that candidate links join.

    Groups of candidates are compared within one task each; large ones are cut into chunks, and pairs of chunks are
    tasks of their own. ``texts_of`` gives (_id, _whole) of the ids asked for.
    """
    groups = materialise(connected_components(candidates).select(F.col("node").alias("_id"), F.col("component").alias("_group")))
    texts = texts_of(groups.select("_id")).select("_id", "_whole", F.octet_length("_whole").alias("_bytes"))
    sizes = groups.join(texts.select("_id", "_bytes"), "_id")
    sizes = sizes.groupBy("_group").agg(F.count("*").alias("_n"), F.sum("_bytes").alias("_b")).filter((F.col("_n") > CHUNK) | (F.col("_b") > CHUNK_BYTES))
    large = sizes.select("_group", F.greatest(F.ceil(F.col("_n") / CHUNK), F.ceil(F.col("_b") / CHUNK_BYTES)).cast("int").alias("_chunks"))
    placed = groups.join(if_small(materialise(large)), "_group", "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
    placed = placed.withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda c: F.struct(F.least(c, "_own").alias("_a"), F.greatest(c, "_own").alias("_b")))
    dealt = texts.join(placed.select("_id", "_group", "_own", F.explode(pairs).alias("_p")), "_id").select("_id", "_whole", "_group", "_own", "_p.*")
    radius, key = similar_radius(similarity, 64 * words, 4), ["_group", "_a", "_b"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group and pair of chunks."""
        last, sides = None, ([], [])

        def links() -> list[tuple[int, int]]:
            return list(similar_pairs(sides[0], sides[1] or None, similarity, radius))

        for rows in batches:
            found = []
            for *at, own, node, text in rows[[*key, "_own", "_id", "_whole"]].itertuples(index=False, name=None):
                if at != last:
                    found += links()
                    last, sides = at, ([], [])
                h = shingle_set(text, shingle)
                sides[own != at[1]].append((node, set(h.tolist()), np.frombuffer(hash_fingerprint(h, words), "<u8")))
            yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")
        yield pd.DataFrame(links(), columns=["u", "v"], dtype="int64")

    return dealt.repartition(*key).sortWithinPartitions(*key).mapInPandas(compare, "u long, v long")


def _hex(f: Column) -> Column:
    return F.lower(F.lpad(F.hex(f), 16, "0"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tree: int = TREE, texts: bool = False) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id, the smallest doc_id that links lead to, and component.

    ``component`` names the class even where no document of it has an id; ``text_mark``, if asked for, the row's text.
    """
    text_batches(docs.sparkSession)
    more = {"text_mark": _text_mark(F.col("text"))} if texts else {}
    marked = materialise(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("_f"), *[c.alias(k) for k, c in more.items()]))
    distinct = materialise(marked.groupBy("_f").agg(F.min("doc_id").alias("_least"))).withColumn("_id", F.col("_f"))
    return _classes(marked, distinct, connected_components(fingerprint_links(distinct.select("_f"), radius, tree)), None, list(more))


def _text_mark(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, words: int = 8, tree: int = TREE) -> DataFrame:
    """As near_duplicates(), linking documents whose sets of shingles have this Jaccard similarity.

    Equal sets are one class. Candidates are found by fingerprints of 64 * words bits of the sets, and groups of
    candidates are compared by the sets themselves. Pairs meet where they agree in one of 4 * words bands, which pairs
    of similarity 0.8 do with probability 0.91 for 8 words, and those of 0.9 nearly always; pairs that others join to
    one group meet as well. ``text_mark`` names the row's text.
    """
    text_batches(docs.sparkSession)
    marked = docs.select("doc_id", _text_mark(F.col("text")).alias("text_mark"), wide_fingerprint(F.col("text"), shingle, words).alias("_w"))
    marked = materialise(marked.select("doc_id", "text_mark", F.col("_w.f").alias("_f"), F.col("_w.mark").alias("_mark")))
    # Numbers of a written table don't change when a task runs again.
    distinct = marked.groupBy("_mark").agg(F.min("doc_id").alias("_least"), F.min("text_mark").alias("text_mark"), F.min("_f").alias("_f"))
    distinct = materialise(distinct).withColumn("_id", F.monotonically_increasing_id())
    radius = similar_radius(similarity, 64 * words, 3)
    candidates = wide_links(distinct.select("_id", "_f"), radius, words, tree)

    def texts_of(ids: DataFrame) -> DataFrame:
        """One text of each set, equal texts combined before they move far."""
        asked = materialise(distinct.join(ids, "_id", "left_semi").select("_id", F.col("text_mark").alias("_asked")))
        whole = docs.select(_text_mark(F.col("text")).alias("_asked"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_whole"))
        return materialise(whole.join(if_small(asked), "_asked").groupBy("_id").agg(F.first("_whole").alias("_whole")))

    found = connected_components(confirmed_links(candidates, texts_of, similarity, shingle, words))
    return _classes(marked, distinct, found, ["_mark"], ["text_mark"])


def _classes(marked: DataFrame, distinct: DataFrame, found: DataFrame, key: list[str] | None = None, more: list[str] | None = None) -> DataFrame:
    key = key or ["_f"]
    classes = distinct.join(found.select(F.col("node").alias("_id"), "component"), "_id", "left").withColumn("component", F.coalesce("component", "_id"))
    classes = materialise(classes.select(*key, "_least", "component"))
    # Written apart, so that a component with a third of all rows can be split where it meets its name.
    named = if_small(materialise(classes.groupBy("component").agg(F.min("_least").alias("component_id"))))
    known = classes.join(named, "component").select(*key, "component_id", "component")
    return marked.join(known, key).select("doc_id", _hex(F.col("_f")).alias("fingerprint"), "component_id", "component", *(more or []))


def keep_first(docs: DataFrame, similarity: float | None = None, radius: int = RADIUS, shingle: int = SHINGLE, words: int = 8) -> DataFrame:
    """The documents of ``docs`` without near-duplicates: one row of each component.

    Components are those of similar_documents() if a similarity is given, else those of near_duplicates(). Of a
    component, the row with the smallest id stays (rows without an id come last), of rows with one id that with the
    smallest MD5 of its text, of rows alike in both the smallest by all columns.
    """
    classes = similar_documents(docs, similarity, shingle, words) if similarity is not None else near_duplicates(docs, radius, shingle, texts=True)
    rows = materialise(classes.groupBy("component", "doc_id", "text_mark").agg(F.count("*").alias("_rows")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_mark"))
    kept = rows.groupBy("component").agg(first.alias("_first"), F.sum("_rows").alias("_all")).filter("_all > 1")
    kept = if_small(materialise(kept.select("component", "_first")))  # apart, so that a large component can be split
    told = materialise(rows.join(kept, "component").select("doc_id", "text_mark", "_rows", (F.col("_first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_first.text_mark") == F.col("text_mark"))).alias("_stays")))
    # Rows that go are told by id and text; most documents meet this one join alone, without a shuffle if those are few.
    gone = told.filter("not _stays or _rows > 1").select(F.col("doc_id").alias("_gone"), F.col("text_mark").alias("_mark"))
    whole = carried(docs, ["doc_id", "text"])
    same = F.col("doc_id").eqNullSafe(F.col("_gone")) & (_text_mark(F.col("text")) == F.col("_mark"))
    out = restored(whole.join(if_small(materialise(gone)), same, "left_anti"), docs)
    repeated = told.filter("_stays and _rows > 1").select(F.col("doc_id").alias("_gone"), F.col("text_mark").alias("_mark"))
    if not repeated.limit(1).count():
        return out
    many = whole.join(if_small(materialise(repeated)), same).withColumn("_first", F.row_number().over(Window.partitionBy("_gone", "_mark").orderBy("_row")))
    return out.unionByName(restored(many.filter("_first = 1"), docs))
