"""Merkle manifest of a dataset: a tree of digests per group of rows, a tree over the groups, and a proof for every row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from stratalens.session import materialize

#: Children of a node.
ARITY = 3
#: Levels between two that are stored: a subtree has at most 3^5 = 243 stored nodes.
EVERY = 5

_PROOF = "array<struct<left:string,right:string>>"
_ABOVE = f"struct<proof:{_PROOF},subroot:string,root:string>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields one after another: ``-`` for null, else the count of UTF-8 bytes, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf leads to with the siblings of its proof."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda level: F.concat(level["left"], level["right"])), "")


def _parents(nodes: list[str]) -> list[str]:
    return [sha256("".join(nodes[i : i + ARITY]).encode()).hexdigest() for i in range(0, len(nodes), ARITY)]


def _height(size: int) -> int:
    """Levels above ``size`` nodes until one remains."""
    levels = 0
    while size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with their place ``pos`` (from 0) in the order of their ``tree``, and its ``size``.

    Rows are range-partitioned by tree and order, so a tree of any size is spread over many slices; a slice's first place
    follows from the counts of the slices before, one row a slice and tree.
    """
    sliced = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    sliced = materialize(sliced.withColumn("at", F.monotonically_increasing_id()))  # slice number and row within it
    sliced = sliced.withColumn("slice", F.shiftright("at", 33))
    counts = sliced.groupBy("tree", "slice").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "tree",
        "slice",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy("tree")).alias("size"),
    )
    return sliced.join(starts, ["tree", "slice"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "slice", "shift")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole ``tree, block`` groups of sorted rows with the first row of each group. What is held
    back from one batch to the next is one group, a subtree at most."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        trees, blocks = rows.column("tree").to_pylist(), rows.column("block").to_pylist()
        starts = [0] + [i for i in range(1, len(trees)) if blocks[i] != blocks[i - 1] or trees[i] != trees[i - 1]]
        if len(starts) > 1:
            yield rows.slice(0, starts[-1]), starts[:-1]
        held = rows.slice(starts[-1])
    if held is not None:
        yield held, [0]


def _grouped(nodes: DataFrame, every: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(ARITY**every)).cast("long"))


def _reduce(nodes: DataFrame, every: int) -> DataFrame:
    """The stored nodes ``every`` levels up; the levels between are built in the task and let go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_groups(batches):
            digests, trees = rows.column("digest").to_pylist(), rows.column("tree").to_pylist()
            sizes, blocks = rows.column("size").to_pylist(), rows.column("block").to_pylist()
            made = []
            for a, b in zip(starts, [*starts[1:], len(digests)]):
                layer, levels = digests[a:b], min(every, _height(sizes[a]))
                for _ in range(levels):
                    layer = _parents(layer)
                made.append(layer[0])
            columns = [pa.array([v[a] for a in starts], t) for v, t in ((trees, pa.string()), (blocks, pa.int64()))]
            left = pa.array([-(-sizes[a] // ARITY**every) for a in starts], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, left, pa.array(made, pa.string())], ["tree", "pos", "size", "digest"])

    dealt = _grouped(nodes.where("size > 1").select("tree", "pos", "size", "digest"), every)
    dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return dealt.mapInArrow(run, "tree string, pos bigint, size bigint, digest string")


def _extract(nodes: DataFrame, above: DataFrame, every: int) -> DataFrame:
    """``nodes`` with the proof that leads from each to the root, given that of the stored nodes over their subtrees.

    ``above`` has ``tree, block, above``; its row comes first in its subtree's group. The subtree's missing levels
    are built again, the siblings along each path are taken from them, and the levels are let go.
    """
    extra = [c for c in nodes.columns if c not in ("tree", "pos", "size", "digest")]
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_groups(batches):
            digests, sizes = rows.column("digest").to_pylist(), rows.column("size").to_pylist()
            heads = rows.column("above").take(pa.array(starts)).to_pylist()
            lefts, rights, ends, subroots, roots = [], [], [0], [], []
            for a, b, head in zip(starts, [*starts[1:], len(digests)], heads):
                if a + 1 == b:
                    continue
                layer, beside = digests[a + 1 : b], []
                for _ in range(min(every, _height(sizes[a + 1]))):
                    pairs = []
                    for i in range(len(layer)):
                        run_start = i - i % ARITY
                        pairs.append(("".join(layer[run_start:i]), "".join(layer[i + 1 : run_start + ARITY])))
                    beside.append(pairs)
                    layer = _parents(layer)
                upper = [(level["left"], level["right"]) for level in head["proof"]]
                for i in range(b - a - 1):
                    for pairs in beside:
                        left, right = pairs[i]
                        lefts.append(left)
                        rights.append(right)
                        i //= ARITY
                    lefts += [left for left, _ in upper]
                    rights += [right for _, right in upper]
                    ends.append(len(lefts))
                subroots += [head["subroot"]] * (b - a - 1)
                roots += [head["root"]] * (b - a - 1)
            kept = rows.filter(pc.greater_equal(rows.column("pos"), 0)).combine_chunks()
            levels = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], ["left", "right"])
            proofs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), levels)
            found = pa.StructArray.from_arrays(
                [proofs, pa.array(subroots, pa.string()), pa.array(roots, pa.string())], ["proof", "subroot", "root"]
            )
            whole = kept.select(["tree", "pos", "digest", *extra]).append_column("above", found)
            yield from whole.to_batches()

    dealt = _grouped(nodes, every).withColumn("above", F.lit(None).cast(_ABOVE))
    heads = above.withColumn("pos", F.lit(-1).cast("long"))
    dealt = dealt.unionByName(heads, allowMissingColumns=True)
    dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("tree", "pos", "digest", *extra))
    return dealt.mapInArrow(run, f"{schema}, above {_ABOVE}")


class _Forest:
    """Trees over placed nodes, of which every few levels are stored."""

    def __init__(self, nodes: DataFrame, every: int) -> None:
        self.every = every
        self.levels = [nodes]
        largest = nodes.agg(F.max("size")).first()[0] or 0
        while largest > 1:
            self.levels.append(materialize(_reduce(self.levels[-1], every)))
            largest = -(-largest // ARITY**every)

    def roots(self) -> DataFrame:
        """``tree, digest, level``: the one node of each tree that remains, and the stored level it lies on."""
        found = [level.where("size = 1").select("tree", "digest", F.lit(j).alias("level")) for j, level in enumerate(self.levels)]
        roots = found[0]
        for more in found[1:]:
            roots = roots.unionByName(more)
        return roots

    def proofs(self, above_roots: DataFrame) -> DataFrame:
        """Every node of the lowest level with what is above it; ``above_roots`` has ``tree, level, above``."""
        tails = None
        for j in reversed(range(len(self.levels))):
            heads = above_roots.where(F.col("level") == j).select("tree", F.lit(0).cast("long").alias("block"), "above")
            if tails is not None:
                heads = heads.unionByName(tails.select("tree", F.col("pos").alias("block"), "above"))
            tails = _extract(self.levels[j], heads, self.every)
            if j:
                tails = materialize(tails.select("tree", "pos", "above"))
        return tails


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "source",
    order: str = "doc_id",
    carry: dict[str, Column] | None = None,
    every: int = EVERY,
) -> DataFrame:
    """``doc_id`` (named as ``order``), ``leaf, subroot, root, proof`` of every row.

    A row's leaf is the digest of its ``fields``. Per ``group``, leaves in rising ``order`` are joined three at a time until one node, the
    subroot, remains; the last run of a level may hold fewer, even one. Subroots in the order of their groups (null first, bytewise) lead to
    the root in the same way. ``proof`` lists, level by level up to the root, what stands to the left and to the right of the
    node in its run (:func:`fold`, :func:`proof_text`). ``carry`` adds expressions of the row, which are handed along.

    Texts are hashed where they are read and never moved. Of each tree only every ``every``-th level is stored (in the shared
    folder): leaves, then one node for 3^every of them, and so on. Proofs come from the top down: a task gets the stored
    nodes of one aligned subtree and the proof of the node above them, builds the levels between again, takes
    the siblings and lets the levels go. No task meets more than a subtree at a time, and a group of any size is spread over slices of its order.

    Edge cases: a null id comes first in its group and is hashed as ``-``; rows that repeat an id are ordered by leaf, equal rows each
    have a place of their own; a table of one row has its leaf as root and an empty proof; an empty table gives an empty result; other columns are ignored.
    """
    col = lambda name: F.col(f"`{name}`")
    kept = {"__id": col(order), **{f"__c{i}": c for i, c in enumerate((carry or {}).values())}}
    # Null before all other names, the empty one included.
    tree = F.coalesce(F.concat(F.lit("g"), col(group).cast("string")), F.lit(""))
    base = docs.select(tree.alias("tree"), leaf_digest(*[col(f) for f in fields]).alias("digest"), *[c.alias(n) for n, c in kept.items()])
    base = materialize(base.withColumn("row", F.monotonically_increasing_id()))
    trees = _Forest(_placed(base, ["__id", "digest", "row"]).drop("row"), every)
    roots = trees.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), "level", "digest")
    top = _Forest(_placed(roots, ["name"]), every)
    nothing = F.array().cast(_PROOF)
    summit = top.roots().select(
        "tree", "level", F.struct(nothing.alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root")).alias("above")
    )
    over = top.proofs(summit).select(
        F.col("name").alias("tree"),
        "level",
        F.struct(F.col("above.proof").alias("proof"), F.col("digest").alias("subroot"), F.col("above.root").alias("root")).alias("above"),
    )
    found = trees.proofs(materialize(over))
    return found.select(
        F.col("__id").alias(order),
        F.col("digest").alias("leaf"),
        "above.subroot",
        "above.root",
        "above.proof",
        *[F.col(f"__c{i}").alias(name) for i, name in enumerate(carry or {})],
    )
