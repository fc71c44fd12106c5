"""Documents whose sets of word n-grams overlap, by size-banded tiles of bitmap signatures and exact intersection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from stratalens.llm.components import components, with_least
from stratalens.llm.text import only, words
from stratalens.session import materialize, small_batches

#: Fewest and most bits of the signature of a set, and sets on one side of a tile (in expectation).
BITS = (256, 8192)
BLOCK = 512
#: Rows (of a key or an id, about 40 bytes each) up to which a side that was counted is broadcast; beyond it, both
#: sides are shuffled.
BROADCAST_ROWS = 3_000_000
#: Words that a worker remembers the hashes of.
CACHE_WORDS = 150_000
#: Keys that a task holds before it deals them out, and the bits of a key that name their group.
HELD_KEYS, GROUP_BITS = 1 << 20, 12
#: Parts of a set, as a multiple of the fewest that lose no pair; small sets would take more to have hardly any empty ones.
MOST_PARTS = 2
#: Bits of the tag that stands for a node next to a key.
TAG_BITS = 32

_U = np.uint64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hash_of = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``size`` words; of fewer words, the whole as one."""
    tokens = words(text or "")
    n = len(tokens)
    if not n:
        return np.zeros(0, _U)
    if n < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), seed=n)], _U)
    ids = np.fromiter(map(_hash_of.__getitem__, tokens), _U, n)
    mixed = ids[: n - size + 1]
    for k in range(1, size):
        mixed = _mix(mixed) + ids[k : n - size + 1 + k]
    return np.unique(_mix(mixed))


def empty_parts(size: int, parts: int) -> float:
    """Empty parts that hardly any set of ``size`` hashes exceeds: their mean and four standard deviations."""
    one, two = (1 - 1 / parts) ** size, (1 - 2 / parts) ** size
    mean = parts * one
    return mean + 4 * math.sqrt(max(0.0, parts * (parts - 1) * two + mean - mean * mean))


class Bands:
    """Sizes in bands so narrow that linked sets lie in one band or in neighbours, and how finely
    the sets of a tile are cut.

    Sets of sizes a <= c with a Jaccard similarity of ``percent`` or more differ in at most
    (a + c)(100 - percent) / (100 + percent) hashes, d at most in a tile. Cut into more than d parts by ranges of
    the hash, they agree in all parts but d. So if one of the two has more than d parts that are not empty, they agree in one of those; else both
    have empty parts, and agree in some part, empty or not. A set with more than d such parts gives keys of these
    only, any other of all its parts, and no pair is lost. A key of an empty part is shared by all sets that give it, whatever
    they hold, so sets are cut so finely that few have to.
    """

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.ratio = 100 / percent
        self._parts: dict[int, tuple[int, int]] = {}

    def band(self, size: int) -> int:
        return math.floor(math.log(size) / math.log(self.ratio) + 1e-9)

    def parts(self, tile: int) -> tuple[int, int]:
        """Number of parts for pairs whose smaller set lies in band ``tile``, and in how many they differ at most; 0 and 0 if only equal
        sets link."""
        if tile not in self._parts:
            low = math.ceil(self.ratio**tile - 1e-9)
            while self.band(low) < tile:
                low += 1
            top = math.ceil(self.ratio ** (tile + 1)) + 1
            while top > 1 and self.band(top) > tile:
                top -= 1
            differ = (top + top * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)
            least = parts = differ + 2
            while parts < MOST_PARTS * least and empty_parts(low, parts) > parts - differ - 1:
                parts += 1
            self._parts[tile] = (parts, differ) if differ else (0, 0)
        return self._parts[tile]

    def keys(self, hashes: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Keys for parts of the set in the tile of its own band and in the one below."""
        own, out = self.band(len(hashes)), []
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(mixed, dtype=_U)))
        for tile in (own, own - 1):
            parts, differ = self.parts(tile) if tile >= 0 else (0, 0)
            if parts:
                place = ((hashes >> _U(32)) * _U(parts)) >> _U(32)
                cut = np.searchsorted(place, np.arange(parts + 1, dtype=_U))
                chosen = np.flatnonzero(cut[1:] != cut[:-1])
                if len(chosen) <= differ:
                    chosen = np.arange(parts)
                content = sums[cut[chosen + 1]] - sums[cut[chosen]]
                out.append(_mix(content + _mix(chosen.astype(_U) + _U((tile + 1) << 32))))
        return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def bitmap(hashes: np.ndarray, per_hash: int = 1) -> bytes:
    """A signature with at least ``per_hash`` bits for each hash of the set, up to the most: a hash turns over the bit whose number is the
    hash modulo the size, a power of two, so a longer signature can be folded to a shorter one. Hashes that two sets share
    cancel out where signatures are compared, so only those of one set can hide each other."""
    bits = min(max(BITS[0], 1 << max(0, per_hash * len(hashes) - 1).bit_length()), BITS[1])
    met = np.bincount((hashes & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((met & 1).astype(np.uint8)).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """The signature with ``size`` bytes, as 64-bit numbers."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8), axis=0)


def near_enough(total: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with ``total`` hashes together can reach the similarity. Each bit that two signatures don't
    share stands for a hash in one of the sets only, which bounds the overlap from above."""
    return 100 * (total - differ) >= percent * (total + differ)


def node_of(hashes: np.ndarray, mixed: np.ndarray) -> bytes | None:
    """128 bits that stand for the set: two sums over its hashes."""
    if not len(hashes):
        return None
    second = np.add.reduce(_mix(hashes ^ _U(0x9E3779B97F4A7C15)))
    return int(np.add.reduce(mixed)).to_bytes(8, "big") + int(second).to_bytes(8, "big")


def _tag(node: bytes, bits: int) -> int:
    return int.from_bytes(node[:8], "big") & ((1 << bits) - 1)


def _sets(base: DataFrame, size: int, per_hash: int) -> DataFrame:
    """``doc_id, n_shingles, node, tag, bits``: equal sets share the node, a 128-bit hash of the set.

    In each task, only the first row of a node carries bits, so copies are combined before the shuffle.
    """
    kind = base.schema["doc_id"].dataType.simpleString()
    tag_bits = TAG_BITS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            sizes, nodes, tags, bits = [], [], [], []
            for text in batch.column("text"):
                hashes = shingle_set(text.as_py(), size)
                node = node_of(hashes, _mix(hashes))
                sizes.append(len(hashes))
                nodes.append(node)
                tags.append(node and _tag(node, tag_bits))
                if node is None or node in seen:
                    bits.append(None)
                    continue
                bits.append(bitmap(hashes, per_hash))
                seen.add(node)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.binary()),
                    pa.array(tags, pa.int64()),
                    pa.array(bits, pa.binary()),
                ],
                ["doc_id", "n_shingles", "node", "tag", "bits"],
            )
        _hash_of.clear()  # the worker may serve other operators next

    return base.mapInArrow(build, f"doc_id {kind}, n_shingles bigint, node binary, tag bigint, bits binary")


def _shared_keys(base: DataFrame, size: int, percent: int) -> DataFrame:
    """``key, tag, hub, members``: the keys that sets of several tags give, with each tag, the least of their tags and how many
    they have. A key of two tags has one row only, that of the pair, without its number.

    Most keys are of one set only, and there are many, so they are neither written nor rows of their own: a key is cut to 44 bits (different
    keys that become equal only add candidates), and a task deals its keys out in groups by their upper bits, 8 bytes for
    the rest of a key and the tag. A group is one 4096th of all keys.
    """
    tag_bits = TAG_BITS

    def dealt(held: list[np.ndarray], tags: list[int]) -> pa.RecordBatch:
        packed = np.concatenate(held).view(_U)
        packed >>= _U(32 - GROUP_BITS)
        group = (packed >> _U(32)).astype(np.uint16)
        packed <<= _U(32)
        packed |= np.repeat(np.array(tags, _U), [len(k) for k in held])
        order = np.argsort(group, kind="stable")
        packed, group = packed[order], group[order]
        at = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
        parts = [packed[i:j].tobytes() for i, j in zip(at, [*at[1:], len(packed)])]
        return pa.RecordBatch.from_arrays([pa.array(group[at], pa.int32()), pa.array(parts, pa.binary())], ["group", "packed"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        held, tags, count = [], [], 0
        for batch in batches:
            for text in batch.column("text"):
                hashes = shingle_set(text.as_py(), size)
                mixed = _mix(hashes)
                node = node_of(hashes, mixed)
                if node is None or node in seen:
                    continue
                seen.add(node)
                held.append(bands.keys(hashes, mixed))
                tags.append(_tag(node, tag_bits))
                count += len(held[-1])
                if count >= HELD_KEYS:
                    yield dealt(held, tags)
                    held, tags, count = [], [], 0
        if count:
            yield dealt(held, tags)
        _hash_of.clear()

    def shared(group: int, parts: list[bytes]) -> pa.RecordBatch:
        packed = np.unique(np.concatenate([np.frombuffer(p, _U) for p in parts]))
        keys, tags = packed >> _U(32), (packed & _U(0xFFFFFFFF)).view(np.int64)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        counts = np.diff(np.append(first, len(keys)))
        hubs, members = np.repeat(tags[first], counts), np.repeat(counts, counts)
        chosen = (members > 2) | ((members == 2) & (tags != hubs))
        keys = np.where(members > 2, keys | _U(group << 32), _U(0)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x[chosen], pa.int64()) for x in (keys, tags, hubs, members)], ["key", "tag", "hub", "members"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            for group, packed in zip(batch.column("group").to_pylist(), batch.column("packed").to_pylist()):
                if group != at and parts:
                    yield shared(at, parts)
                    parts = []
                at = group
                parts.append(packed)
        if parts:
            yield shared(at, parts)

    groups = base.select("text").mapInArrow(deal, "group int, packed binary").repartition("group").sortWithinPartitions("group")
    return groups.mapInArrow(gather, "key bigint, tag bigint, hub bigint, members bigint")


def _same_tag(carriers: DataFrame) -> DataFrame:
    """``a, b``: the few pairs of different nodes with one tag, which keys can't tell apart."""
    several = carriers.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tag")
    nodes = materialize(carriers.select("tag", "node").join(bounded(materialize(several)), "tag"))
    other = nodes.select("tag", F.col("node").alias("b"))
    return materialize(nodes.withColumnRenamed("node", "a").join(other, "tag").where("a < b").select("a", "b"))


def _own_texts(known: DataFrame, size: int) -> DataFrame:
    """``node, text``; rows whose text has another node than the one that is asked for go."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for text, node in zip(batch.column("text"), batch.column("node")):
                hashes = shingle_set(text.as_py(), size)
                same.append(node_of(hashes, _mix(hashes)) == node.as_py())
            yield batch.filter(pa.array(same, pa.bool_()))
        _hash_of.clear()

    return known.select("node", "text").mapInArrow(check, "node binary, text string")


def _texts_of(pairs: DataFrame, base: DataFrame, carriers: DataFrame, size: int) -> DataFrame:
    """``node, text`` of the nodes that the pairs mention, one row a node."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    holders = carriers.select("node", F.col("doc_id").alias("holder")).join(wanted, "node")
    holders = bounded(materialize(holders.select("node", "holder")))
    known = base.join(holders, F.col("doc_id").eqNullSafe(F.col("holder")))
    return materialize(_own_texts(known, size).dropDuplicates(["node"]))


def _possible(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs that the signatures don't rule out."""
    left = signed.select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("bits").alias("a_bits"))
    right = signed.select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("bits").alias("b_bits"))
    both = pairs.join(right, "b").join(left, "a")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b in zip(batch.column("a_bits").to_pylist(), batch.column("b_bits").to_pylist()):
                shorter = min(len(a), len(b))
                kept.append(int(np.bitwise_count(folded(a, shorter) ^ folded(b, shorter)).sum()))
            total = batch.column("a_n").to_numpy() + batch.column("b_n").to_numpy()
            chosen = near_enough(total, np.array(kept, np.int64), percent)
            yield batch.select(["a", "b"]).filter(pa.array(chosen, pa.bool_()))

    return both.select("a", "b", "a_n", "b_n", "a_bits", "b_bits").mapInArrow(bound, "a binary, b binary")


def bounded(written: DataFrame) -> DataFrame:
    """Broadcast a written table that was counted and is small enough; leave any other to be shuffled."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def links_of(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (``a, b``) of nodes whose sets really reach the similarity, by intersection of their
    sorted arrays. Pairs lie sorted by ``a``, whose set is kept for the next pair."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    both = pairs.join(right, "b").join(left, "a").sortWithinPartitions("a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                a = batch.column("a")[i].as_py()
                if a != last:
                    last, mine = a, shingle_set(batch.column("a_text")[i].as_py(), size)
                other = shingle_set(batch.column("b_text")[i].as_py(), size)
                shared = len(np.intersect1d(mine, other, assume_unique=True))
                kept.append(100 * shared >= percent * (len(mine) + len(other) - shared))
            chosen = batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))
            if chosen.num_rows:
                yield chosen
        _hash_of.clear()

    return both.select("a", "b", "a_text", "b_text").mapInArrow(verify, "a binary, b binary")


def spanning(left: np.ndarray, right: np.ndarray, order: np.ndarray) -> list[int]:
    """Places in ``order`` of the pairs that join two parts when pairs of labels are joined one after another."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for k in order.tolist():
        a, b = find(int(left[k])), find(int(right[k]))
        if a != b:
            parent[a] = b
            kept.append(k)
    return kept


def _tile_pairs(rows: DataFrame, percent: int, forest: bool) -> DataFrame:
    """``a, b, key``: pairs of nodes of different labels within each tile that the signatures don't rule out: with ``forest``, the
    closest ones that join the tile's labels (fewer than there are labels), with the tile's key; else all, under key 0.

    ``rows``: ``key, i, j`` (the tile), ``side`` (0 for rows of block i), ``node, label`` (null: the node itself), ``n, bits``. Tiles
    follow one another in a task; one tile is held at a time.
    """

    def compare(tile: list[dict]) -> Iterator[tuple[bytes, bytes]]:
        sides = [[r for r in tile if r["side"] == s] for s in (0, 1)]
        inner = bool(tile) and tile[0]["i"] == tile[0]["j"]
        left, right = sides[0], sides[0] if inner else sides[1]
        if not left or not right:
            return
        shortest = min(len(r["bits"]) for r in tile)
        bits = [np.stack([folded(r["bits"], shortest) for r in s]) for s in (left, right)]
        sizes = [np.array([r["n"] for r in s], np.int64) for s in (left, right)]
        names: dict[bytes, int] = {}
        labels = [np.array([names.setdefault(r["label"] or r["node"], len(names)) for r in s]) for s in (left, right)]
        ones, others, apart = [], [], []
        for k in range(len(left)):
            first = k + 1 if inner else 0
            total = sizes[1][first:] + sizes[0][k]
            differ = np.bitwise_count(bits[1][first:] ^ bits[0][k]).sum(axis=1, dtype=np.int64)
            near = near_enough(total, differ, percent) & (labels[1][first:] != labels[0][k])
            chosen = np.flatnonzero(near)
            ones.append(np.full(len(chosen), k))
            others.append(chosen + first)
            apart.append(differ[chosen] / total[chosen])
        one, other = np.concatenate(ones), np.concatenate(others)
        picked = range(len(one))
        if forest:
            picked = spanning(labels[0][one], labels[1][other], np.argsort(np.concatenate(apart), kind="stable"))
        for k in picked:
            a, b = left[one[k]]["node"], right[other[k]]["node"]
            if a != b:
                yield (a, b) if a < b else (b, a)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: list[dict] = []
        at, found = None, set()
        for batch in batches:
            for row in batch.to_pylist():
                here = (row["key"], row["i"], row["j"])
                if here != at:
                    found.update((*pair, at[0] if forest else 0) for pair in compare(tile))
                    tile, at = [], here
                tile.append(row)
            if len(found) > 10_000:
                yield _pairs(found)
                found = set()
        found.update((*pair, at[0] if forest and at else 0) for pair in compare(tile))
        yield _pairs(found)

    def _pairs(found: set[tuple[bytes, bytes, int]]) -> pa.RecordBatch:
        ordered = sorted(found)
        kinds = (pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in ordered], kind) for k, kind in enumerate(kinds)], ["a", "b", "key"])

    tiles = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node")
    return tiles.select("key", "i", "j", "side", "node", "label", "n", "bits").mapInArrow(scan, "a binary, b binary, key bigint")


def _tiles(rows: DataFrame, labels: DataFrame, signed: DataFrame, block: int) -> DataFrame:
    """Rows of the keys that hold nodes of several labels, once for each tile that they are part of. A key of two nodes needs no tile:
    stars have compared its only pair."""
    heads = labels.select(F.col("node").alias("head"), F.col("label").alias("head_label"))
    labelled = rows.join(bounded(labels), "node", "left").join(bounded(heads), "head", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "node"))
    open_keys = labelled.where(F.col("label") != F.coalesce("head_label", "head")).select("key").distinct()
    members = labelled.join(bounded(materialize(open_keys)), "key", "left_semi")
    members = members.withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    members = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("key", "node", "label", "blocks", "own")
    members = members.join(signed.select("node", "n", "bits"), "node")
    spread = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select(
        "key",
        F.least("own", "with").alias("i"),
        F.greatest("own", "with").alias("j"),
        (F.col("own") > F.col("with")).cast("int").alias("side"),
        "node",
        F.nullif("label", "node").alias("label"),
        "n",
        "bits",
    )


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label`` after further links. Labels are joined, not nodes: only links between different labels count."""
    side = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))
    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    between = between.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a <> b")
    moved = materialize(components(between).select(F.col("node").alias("label"), F.col("label").alias("_to")))
    known = labels.join(moved, "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
    # Nodes that had no label were labels of their own.
    new = moved.join(labels.select(F.col("node").alias("label")), "label", "left_anti")
    return materialize(known.unionByName(new.select(F.col("label").alias("node"), F.col("_to").alias("label"))))


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
    bits_per_hash: int = 1,
    spanning: bool = True,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    A document's set holds its distinct runs of ``size`` words (A-Z lower-cased, between blanks).
    Two sets link when their Jaccard similarity is at least ``percent`` hundredths; the component is
    named by the smallest id that links reach. No link is lost: every pair that can link shares a key
    (``Bands``).

    1. Sets are hashed; equal sets are one node. Each set gives keys for the tiles of two size bands, and a
       bitmap signature.
    2. Keys of one node only are dropped: keys are shuffled in groups of 8 bytes each and not written; nodes are known by
       32-bit tags there, and nodes that share a tag are compared outright.
    3. Each node is compared with the first node of each of its keys, by signatures, then exactly; what links is
       joined, so a large group of near copies is mostly one component after as many comparisons as
       it has members.
    4. Keys of more than two nodes that still hold several components are cut into blocks of about ``block`` nodes; each
       pair of blocks is a tile, in which signatures rule out most pairs of different components at once. A tile first names
       the closest pairs that would join its components, fewer than it has components; they are intersected exactly and components
       grow. So a group whose members link with some of the others only, too, is one component before pairs are listed.
    5. What is still apart is tiled again, and now every pair of different components that the signatures leave in question is
       intersected exactly: no link is missed. ``bits_per_hash`` makes signatures longer: fewer pairs are left in question,
       and rows of tiles take more room. Without ``spanning`` this is the only pass over the tiles: the result is the same, with less room
       for rows of tiles and more for pairs of large groups that stars don't join.

    Rows go to Python workers in small batches, so that texts of two sets side by side take little of an executor's memory.
    Texts are hashed once for the signatures and once for the keys, which takes less room than to write the keys; they are read
    again only for nodes that are left in question.

    Edge cases: texts without words have an empty set and are linked with nothing; null ids take part in
    links but name no component; rows that repeat an id are judged each by their own text; an empty table gives
    an empty result; other columns are ignored.
    """
    base = only(docs, doc_id=id_col, text=text_col)
    with small_batches(docs.sparkSession):
        sets = materialize(_sets(base, size, bits_per_hash)).withColumn("row", F.monotonically_increasing_id())
        # Tasks have deduplicated their own rows; of the rest, one row stands for each node.
        first = sets.where("bits IS NOT NULL").groupBy("node").agg(F.min("row").alias("row")).select("row")
        carriers = sets.join(bounded(materialize(first)), "row", "left_semi")
        rows = materialize(_shared_keys(base, size, percent))
        alike = _same_tag(carriers)

        signed = carriers.select("node", "tag", F.col("n_shingles").alias("n"), "bits")
        wanted = rows.select("tag").union(rows.select("hub")).union(alike.join(carriers, F.col("a") == F.col("node")).select("tag"))
        signed = materialize(signed.join(bounded(materialize(wanted.distinct())), "tag"))
        nodes = materialize(signed.select("tag", "node", "n"))
        heads = bounded(nodes.select(F.col("tag").alias("hub"), F.col("node").alias("head"), F.col("n").alias("head_n")))
        nodes = bounded(nodes)
        stars = rows.where("tag <> hub").select("tag", "hub").distinct().join(nodes, "tag").join(heads, "hub")
        stars = stars.where(100 * F.least("n", "head_n") >= percent * F.greatest("n", "head_n"))
        stars = stars.select(F.col("head").alias("a"), F.col("node").alias("b")).union(alike)
        rows = rows.where("members > 2").join(nodes, "tag").join(heads, "hub").select("key", "node", "head", "members")
        stars = materialize(_possible(stars, signed, percent))
        links = materialize(links_of(stars, _texts_of(stars, base, carriers, size), size, percent))

        labels = materialize(components(links))
        for forest in (True, False) if spanning else (False,):
            found = _tile_pairs(_tiles(rows, labels, signed, block), percent, forest)
            found = materialize(found if forest else found.distinct())
            pairs = found.select("a", "b").distinct()
            labels = _joined(labels, links_of(pairs, _texts_of(pairs, base, carriers, size), size, percent))
            if forest:  # components only grow, so a key without a pair now has none later
                rows = rows.join(bounded(materialize(found.select("key").distinct())), "key", "left_semi")
    named = sets.select("doc_id", "n_shingles", "node").join(labels, "node", "left")
    named = named.withColumn("label", F.coalesce("label", "node"))
    found = with_least(named, "label", "doc_id", "component_id")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
