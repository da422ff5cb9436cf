"""Operator 9, n-gram Jaccard join over a MinHash LSH forest with exact verification.

A text is its set of five-word shingles (a text of one to four words is one shingle); texts with
equal sets are one node. A node has a signature of ``DEPTH`` MinHash values in each of ``TREES`` trees.
A tree is the sorted list of its signatures, that is a prefix trie in order: nodes that share a prefix
stand next to each other, and how long a prefix two neighbours share says how deep they part. Nodes are
dealt to tasks by tree and first values, sorted there and read once; no bucket is ever a group.

Matched prefixes are shortened from the full depth until pairs at the threshold itself share one in some tree with
chance ``RECALL`` (``shortest``: 5 of 8 values). Nearer pairs do so with a higher chance, so the recall holds for every
mix of similarities, and nothing is estimated from the table. The further values only order a run.

Nodes that share a run (a matched prefix in some tree) are candidates. Connected candidates, in the order
of the first tree, are cut in blocks of up to ``BLOCK`` nodes and ``ROOM`` shingles (a longer text is
alone). A block is verified inside itself and with every block that it shares a run with: exactly, by
counts of shared shingles. So a chain of candidates costs its neighbouring blocks, not all pairs, and a
run of n nodes n rows, not pairs. A task returns one row per node (its links, and the node it hangs on).
Verified links make the classes.

Defined results: class_id is the least doc_id of the class; n_links counts the different texts (by
shingle set) at or above the threshold, copies apart; n_copies the other rows with an equal set.
Sets of fewer than four shingles have no links (no other set can be as near as 4 / 5).
Null texts and texts without words are classes of their own without links or copies. Null doc_ids
get no class_id from themselves. Repeated rows are copies; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import carried, filed, pieces_for, replaced, saved, slices, table, text_of, with_row_id
from .components import components

N, TREES, DEPTH, RECALL, BLOCK, ROOM, PACK, SEED = 5, 20, 8, 0.9995, 384, 1 << 20, 512, 5
#: Similarity at or above 4 / 5.
TOP, BOTTOM = 4, 5
#: Every ASCII blank as a space.
BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def recall_at(similarity: float, prefix: int) -> float:
    """Chance that a pair shares a prefix of that length in some tree."""
    return 1 - (1 - similarity**prefix) ** TREES


def shortest(threshold: float = TOP / BOTTOM) -> int:
    """The longest prefix that finds a pair at the threshold with ``RECALL``; four values at least, by which nodes are dealt."""
    return max(k for k in range(4, DEPTH + 1) if k == 4 or recall_at(threshold, k) >= RECALL)


@lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    odd = lambda n, kind, top: rng.integers(1, top, n, dtype=kind) * kind(2) + kind(1)
    return odd(N, np.uint64, 1 << 63), odd(TREES * DEPTH, np.uint32, 1 << 31), rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in turn, and the number of each text's; a distinct word is hashed once."""
    import xxhash

    lists = pc.split_pattern(pa.array([t.encode().translate(BLANKS) for t in texts], pa.large_binary()), b" ")
    words = lists.flatten().dictionary_encode()
    seen, which = words.dictionary.to_pylist(), words.indices.to_numpy()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
    full = np.fromiter(map(bool, seen), bool, len(seen))[which]
    text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    return known[which[full]], np.bincount(text[full], minlength=len(texts))


def _hashed(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    a, s = _constants()[0], np.full(max(0, len(h) - n + 1), n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            s = mixed(s * a[j] + h[j : len(h) - n + 1 + j])
    return s


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, counts = word_hashes(texts)
    every, at, out = _hashed(h, N), 0, []
    for n in counts.tolist():
        out.append(np.unique(every[at : at + n - N + 1]) if n >= N else _hashed(h[at : at + n], n) if n else h[:0])
        at += n
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """Least value of the set under each of the TREES * DEPTH hash functions."""
    _, a, b = _constants()
    x, low = (s >> np.uint64(32)).astype(np.uint32), np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 1024):
            low = np.minimum(low, (x[i : i + 1024, None] * a[None, :] + b[None, :]).min(axis=0))
        return low * np.uint32(0x9E3779B1)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and size, and of sets that can have links a pair of longs per tree (four 16-bit values each)."""
    for whole in batches:
        for batch in slices(whole, 3):
            node, size, forest = [], [], []
            for s in shingle_sets(batch.column(3).to_pylist()):
                with np.errstate(over="ignore"):
                    node.append(int(mixed(np.array([mixed(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0]) if len(s) else None)
                size.append(len(s))
                if len(s) >= TOP:
                    forest.append((signature(s) >> np.uint32(16)).astype(">u2").view(">i8").astype(np.int64))
                else:
                    forest.append(None)
            out = [*batch.columns[:3], pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(forest, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["file_no", "row_no", "doc_id", "node", "size", "forest"])


def _run_heads(batches: Iterator[pa.RecordBatch], prefix: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list]]:
    """Of a sorted part of the forest (tree, high, low, node): each batch with every row's head, the first row of its run in
    the batch, or -1 for a run that began in an earlier one; then that one's head row."""
    last, head = None, None
    cut = np.uint64(16 * (DEPTH - prefix))
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, high, low = (batch.column(k).to_numpy().astype(np.int64) for k in range(3))
        parts = np.column_stack([tree, high, (low.view(np.uint64) >> cut).view(np.int64)])
        new = np.ones(len(parts), bool)
        new[1:] = (parts[1:] != parts[:-1]).any(axis=1)
        new[0] = last is None or (parts[0] != last).any()
        at = np.maximum.accumulate(np.where(new, np.arange(len(parts)), -1))
        yield batch, at, new, head
        last = parts[-1]
        head = batch.slice(int(at[-1]), 1) if at[-1] >= 0 else head


JOINED = "tree int, node long, head long, part int, edge int, high long, low long"


def _joined(batches: Iterator[pa.RecordBatch], prefix: int) -> Iterator[pa.RecordBatch]:
    """tree, node and head (of its run) of every node that shares a run in this part, the heads themselves as well; and of
    the part's first and last runs (edge 0 and 1) their prefix and head, for a run may go on in the next part."""
    task = TaskContext.get()
    part, names, last = task.partitionId() if task else 0, [c.split()[0] for c in JOINED.split(", ")], None

    def edge(k: int, batch: pa.RecordBatch, row: int, head: int) -> pa.RecordBatch:
        tree, high, low = (int(batch.column(c)[row].as_py()) for c in range(3))
        cut = int((np.array([low], np.int64).view(np.uint64) >> np.uint64(16 * (DEPTH - prefix))).view(np.int64)[0])
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((tree, None, head, part, k, high, cut), kinds)], names)

    for batch, at, new, head in _run_heads(batches, prefix):
        node, tree = batch.column(3).to_numpy(), batch.column(0).to_numpy()
        rows = np.flatnonzero(~new)
        heads = np.where(at[rows] >= 0, node[np.maximum(at[rows], 0)], head.column(3)[0].as_py() if head is not None else 0)
        first = np.unique(at[rows][at[rows] >= 0])
        own = head is not None and len(rows) and at[rows[0]] < 0  # the earlier batch's head is told again: sets of blocks are distinct
        a = np.concatenate([node[rows], node[first], heads[:1] if own else node[:0]])
        b = np.concatenate([heads, node[first], heads[:1] if own else node[:0]])
        t = np.concatenate([tree[rows], tree[first], tree[rows[:1]] if own else tree[:0]])
        none = [pa.nulls(len(a), k) for k in (pa.int32(), pa.int32(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *none], names)
        if last is None:
            yield edge(0, batch, 0, int(node[0]))
        last = batch, int(node[at[-1]]) if at[-1] >= 0 else head.column(3)[0].as_py()
    if last is not None:
        yield edge(1, last[0], last[0].num_rows - 1, last[1])


def _blocked(batches: Iterator[pa.RecordBatch], most: int, room: int) -> Iterator[pa.RecordBatch]:
    """node and block of nodes sorted by root: blocks of up to ``most`` nodes and ``room`` shingles in turn, of one root each."""
    base, block, held, full, last = TaskContext.get().partitionId() << 40, 0, 0, 0, None
    for batch in batches:
        out = np.empty(batch.num_rows, np.int64)
        for i, (root, size) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
            if root != last or held == most or full + size > room:
                block, held, full, last = block + 1, 0, 0, root
            held, full = held + 1, full + size
            out[i] = base + block
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out)], ["node", "size", "block"])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of shared shingles of all pairs."""
    m = len(sets)
    if m == 2:
        both = np.intersect1d(*sets, assume_unique=True).size
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.int64)
    who = np.repeat(np.arange(m), list(map(len, sets)))
    values, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.diag(np.array(list(map(len, sets)), np.float32) * 0)
    keep = n[column] > 1  # the others are in no pair
    who, column = who[keep], column[keep]
    order = np.argsort(column, kind="stable")
    who, column = who[order], np.unique(column[order], return_inverse=True)[1] if len(order) else column
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        dense = np.zeros((m, 4096), np.float32)
        dense[who[a:b], column[a:b] - lo] = 1
        out += dense @ dense.T
    return np.rint(out).astype(np.int64)


def _verified(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per node of every pair of blocks in the pack: links found here and the node it hangs on."""
    node, links, on = [], [], []
    for (left, right), part in pdf.groupby(["left", "right"], sort=True):
        part = part.sort_values("node")
        ids, block = part.node.to_numpy(), part.block.to_numpy()
        sets = shingle_sets(part.text.tolist())
        size = np.array(list(map(len, sets)))
        both = shared_counts(sets)
        near = BOTTOM * both >= TOP * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(near, False)
        if left != right:
            near &= block[:, None] != block[None, :]
        head = np.arange(len(ids))
        while True:  # least reachable node, by rounds over the matrix
            least = np.minimum(head, np.where(near, head[None, :], len(ids)).min(axis=1, initial=len(ids)))
            least = least[least]
            if (least == head).all():
                break
            head = least
        node.append(ids)
        links.append(near.sum(axis=1))
        on.append(ids[head])
    return pd.DataFrame({"node": np.concatenate(node), "links": np.concatenate(links).astype(np.int64), "on": np.concatenate(on)})


class Join:
    """light: one row per document with its node; nodes: node, class_node, class_id, n_links, n_copies."""

    def __init__(self, docs: DataFrame):
        rows = with_row_id(filed(docs.select("doc_id", "text")))
        schema = "file_no long, row_no long, doc_id long, node long, size long, forest array<long>"
        signed = saved(rows.select("file_no", "row_no", "doc_id", text_of().alias("text")).mapInArrow(_signed, schema), "jaccard-signed")
        self.light = signed.select("file_no", "row_no", "doc_id", "node")
        some = signed.where("node is not null")
        one = F.min_by(F.struct("size", "forest"), F.struct("file_no", "row_no"))
        reps = some.groupBy("node").agg(F.min(F.struct("file_no", "row_no")).alias("at"), F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), one.alias("x"))
        reps = saved(reps.select("node", "at", "doc_id", "rows", "x.size", "x.forest"), "jaccard-nodes")

        runs = self._forest(reps)
        groups = components(runs.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")), "jaccard-groups")
        placed = groups.join(reps.select("node", "size", F.col("forest")[0].alias("high"), F.col("forest")[1].alias("low")), "node")
        placed = placed.repartitionByRange("root", "high", "low", "node").sortWithinPartitions("root", "high", "low", "node").select("root", "node", "size")
        blocks = saved(placed.mapInArrow(partial(_blocked, most=BLOCK, room=ROOM), "node long, size long, block long"), "jaccard-blocks")
        # pairs of blocks that share a run; a run lists its blocks, never its nodes
        met = runs.join(blocks, "node").select("tree", "head", "block").distinct()
        listed = met.groupBy("tree", "head").agg(F.array_sort(F.collect_list("block")).alias("all")).where(F.size("all") > 1)
        listed = listed.select("all", F.explode("all").alias("left")).select("left", F.explode(F.filter("all", lambda x: x > F.col("left"))).alias("right"))
        crossed = saved(listed.distinct(), "jaccard-block-pairs")
        own = blocks.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block", F.col("block").alias("left"), F.col("block").alias("right"))
        units = own.unionByName(crossed.select(F.col("left").alias("block"), "left", "right")).unionByName(crossed.select(F.col("right").alias("block"), "left", "right"))
        n_nodes, shingles = blocks.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        packs = max(pieces_for(n_nodes, PACK), pieces_for(shingles, ROOM))
        pack = F.when(F.col("left") == F.col("right"), F.pmod(F.xxhash64("left"), F.lit(packs))).otherwise(F.xxhash64("left", "right"))
        texts = rows.select("file_no", "row_no", text_of().alias("text")).join(blocks.select("node", "block").join(reps.select("node", "at.file_no", "at.row_no"), "node"), ["file_no", "row_no"])
        cells = texts.select("node", "block", "text").join(units, "block").withColumn("pack", pack).select("pack", "left", "right", "block", "node", "text")
        found = saved(cells.groupBy("pack").applyInPandas(_verified, "node long, links long, on long"), "jaccard-links")
        linked = components(found.where("links > 0").select(F.col("node").alias("a"), F.col("on").alias("b")), "jaccard-classes")
        links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
        nodes = reps.select("node", "doc_id", "rows").join(linked.withColumnRenamed("root", "class_node"), "node", "left").join(links, "node", "left")
        nodes = saved(nodes.select("node", "doc_id", "rows", F.coalesce("class_node", "node").alias("class_node"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "jaccard-nodes")
        ids = nodes.groupBy("class_node").agg(F.min("doc_id").alias("class_id"))
        self.nodes = nodes.join(ids, "class_node").select("node", "class_node", "class_id", "n_links", (F.col("rows") - 1).alias("n_copies"))

    def _forest(self, reps: DataFrame) -> DataFrame:
        """tree, node, head of all runs. Signatures of a tree lie sorted over as many tasks as their number asks for, not by
        first values, which many near copies share; a run that goes on in the next task gets one head afterwards."""
        values = F.array(*(F.struct(F.lit(t).alias("tree"), F.col("forest")[2 * t].alias("high"), F.col("forest")[2 * t + 1].alias("low")) for t in range(TREES)))
        rows = reps.where("forest is not null").select("node", F.explode(values).alias("p")).select("p.tree", "p.high", "p.low", "node")
        order = ["tree", "high", "low", "node"]
        spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        found = saved(spread.mapInArrow(partial(_joined, prefix=shortest()), JOINED), "jaccard-pieces")
        # the first and last runs of every task, in order: one row each, so as many as tasks, not nodes
        ends = found.where("edge is not null").orderBy("part", "edge").collect()
        heads, last = {}, None
        for r in ends:
            key = (r.tree, r.high, r.low)
            if last and last[0] == key and last[1] != r.head:
                heads[r.tree, r.head] = last[1]
            last = key, heads.get((r.tree, r.head), r.head)
        runs = found.where("edge is null").select("tree", "node", "head")
        if not heads:
            return runs
        spark = reps.sparkSession
        to = spark.createDataFrame([(t, a, b) for (t, a), b in heads.items()], "tree int, head long, first long")
        runs = runs.join(F.broadcast(to), ["tree", "head"], "left").select("tree", "node", F.coalesce("first", "head").alias("head"))
        both = to.select("tree", F.col("head").alias("node"), F.col("first").alias("head")).unionByName(to.select("tree", F.col("first").alias("node"), F.col("first").alias("head")))
        return runs.unionByName(both)

    def rows(self) -> DataFrame:
        """file_no, row_no, doc_id, class_id, n_links, n_copies, class_node."""
        found = self.light.join(self.nodes, "node", "left")
        return found.select("file_no", "row_no", "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"), "class_node")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Join(table(spark, sf_dir, "documents")).rows().select("doc_id", "class_id", "n_links", "n_copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class: the one with the least doc_id. Documents without words are kept."""
    docs = filed(docs)
    rows = Join(docs).rows()
    first = Window.partitionBy("class_node").orderBy(F.col("doc_id").asc_nulls_last(), "file_no", "row_no")
    grouped = rows.where("class_node is not null and (n_links > 0 or n_copies > 0)")
    heads = saved(grouped.withColumn("place", F.row_number().over(first)).where("place <= 1").select("file_no", "row_no"), "jaccard-heads")
    dropped = grouped.select("file_no", "row_no").join(heads, ["file_no", "row_no"], "left_anti")
    return carried(docs).join(dropped, ["file_no", "row_no"], "left_anti").select(*replaced(docs, {}))
