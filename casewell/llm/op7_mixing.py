"""Operator 7, mixing sources to target weights in fixed-length blocks.

Every source is one stream of its documents' words (in the order of a hash of identifier, text and
place in the file, not of the file's path), cut into blocks of ``BLOCK`` words. Each output shard of
about ``SHARD_SLOTS`` slots draws from a multinomial over the targets how many slots each source gets in
it; the shards draw apart, in tasks, and what a source was drawn too often or not often enough for its
target is taken from its last shards or dealt to shards by hash. The k-th slot of a source reads block
perm(k): a keyed pseudorandom permutation of its block numbers, a fresh one for each pass over the
source. Its last slot reads only the first words of its block, as many as are missing, so the totals
meet the targets to the word. Slots join blocks by (source, block).

Positions come from sums over hash buckets of about ``BUCKET`` rows, so a source that holds a third of
all rows is many tasks, not one. The driver sees one row per source and nothing per slot or shard.

Defined results: null text has size 0; sources go by code point, null last as a source of its own;
a source without words has target 0; a document of size 0 takes 0; repeated rows are told apart by
their place in the file; an empty table gives no rows; other columns are ignored. Reruns agree.
``mixed_blocks`` gives the output shards themselves, block by block; ``stage`` gives what the mix holds of
each document, as rows with the documents' own columns.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import carried, chars_of, crc32_text, filed, n_words, pieces_for, replaced, saved, table, text_of, with_row_id

BLOCK, SHARD_SLOTS, BUCKET, SEED = 128, 4096, 2048, 20_240
#: Shards that a task draws for.
SHARDS_A_TASK = 256


def weight_of(k: int) -> int:
    return (5, 2, 1)[k % 3]


def fill_targets(sizes: list[int], most: float = 3.0) -> list[float]:
    """Shares of the whole by weight; a target stops at ``most`` times its source and the excess is shared again."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(map(weight_of, open_))
        full = [k for k in open_ if unit * weight_of(k) > most * sizes[k]]
        if not full:
            for k in open_:
                target[k] = unit * weight_of(k)
            break
        for k in full:
            target[k] = most * sizes[k]
            left -= target[k]
            open_.remove(k)
    return target


def draw(shard: int, take: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sources and slots of each that an output shard draws: multinomial, with chances in proportion to ``slots``."""
    ends = np.cumsum(slots)
    hit = np.random.default_rng([SEED, shard]).integers(0, ends[-1], take)
    return np.unique(np.searchsorted(ends, hit, "right"), return_counts=True)


def draw_counts(spark: SparkSession, slots: list[int]) -> DataFrame:
    """shard, source_no, first (slot of the source), n: every source's slots, each once, in its shards."""
    held, total = np.array(slots, np.int64), int(sum(slots))
    n_shards = max(1, -(-total // SHARD_SLOTS))

    def shards(batches):
        for pdf in batches:
            for shard in pdf.id.tolist():
                which, n = draw(shard, total * (shard + 1) // n_shards - total * shard // n_shards, held) if total else (held[:0], held[:0])
                yield pd.DataFrame({"shard": np.full(len(which), shard, np.int64), "source_no": which.astype(np.int32), "n": n})

    drawn = spark.range(0, n_shards, 1, pieces_for(n_shards, SHARDS_A_TASK)).mapInPandas(shards, "shard long, source_no int, n long")
    drawn = saved(drawn.withColumn("group", F.expr(f"shard div {SHARDS_A_TASK}")), "mix-drawn")
    sums = drawn.groupBy("source_no", "group").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("source_no").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "group", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), "n")
    before = Window.partitionBy("source_no", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(sums.drop("n"), ["source_no", "group"])
    placed = placed.select("shard", "source_no", (F.col("ahead") + F.col("before")).alias("first"), "n")
    wanted = spark.createDataFrame([(k, int(n)) for k, n in enumerate(slots)], "source_no int, slots long")
    kept = placed.join(wanted, "source_no").withColumn("n", F.least("n", F.col("slots") - F.col("first"))).where("n > 0").drop("slots")
    got = sums.groupBy("source_no").agg(F.sum("n").alias("got"))
    lack = wanted.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("slots > got")
    # what a source still lacks, in runs of up to SHARD_SLOTS slots of which each goes to a shard of its own
    runs = lack.select("source_no", "slots", F.explode(F.sequence("got", F.col("slots") - 1, F.lit(SHARD_SLOTS))).alias("low"))
    more = runs.select("source_no", F.explode(F.sequence("low", F.least(F.col("slots"), F.col("low") + SHARD_SLOTS) - 1)).alias("first"))
    more = more.select(F.pmod(F.xxhash64("source_no", "first"), F.lit(n_shards)).alias("shard"), "source_no", "first", F.lit(1).cast("long").alias("n"))
    return kept.select("shard", "source_no", "first", "n").unionByName(more)


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of ``k`` under a keyed permutation of 0..n-1: a four-round Feistel network, walked until it lands below n."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask, out, todo = (np.uint64(1) << half) - np.uint64(1), k.astype(np.uint64).copy(), np.arange(len(k))
    key = key.astype(np.uint64)
    with np.errstate(over="ignore"):
        while len(todo):
            left, right, m = out[todo] >> half[todo], out[todo] & mask[todo], mask[todo]
            for r in range(4):
                f = (right + key[todo] + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f >> np.uint64(32)) & m)
            out[todo] = (left << half[todo]) | right
            todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def place_of(block: int, n: int, key: int) -> int:
    """The k that ``permuted`` sends to ``block``: the rounds backwards, walked until it lands below n."""
    half, word = max(1, math.ceil(math.log2(max(n, 2)) / 2)), (1 << 64) - 1
    mask, x = (1 << half) - 1, block
    while True:
        left, right = x >> half, x & mask
        for r in reversed(range(4)):
            f = ((left + key + r) * 0x9E3779B97F4A7C15) & word
            f = ((f ^ (f >> 29)) * 0xBF58476D1CE4E5B9) & word
            left, right = right ^ ((f >> 32) & mask), left
        x = (left << half) | right
        if x < n:
            return x


def key_of(turn, source_no):
    return (turn * 1_000_003 + source_no) * 97 + SEED


def slots_for(words: int, size: int, source_no: int) -> tuple[int, int]:
    """Slots that hold ``words`` words of a source, and the words of the last one."""
    if not words:
        return 0, 0
    n = -(-size // BLOCK)
    turn, rest = divmod(words - 1, size)
    rest, short = rest + 1, size - BLOCK * (n - 1)
    before = BLOCK * place_of(n - 1, n, key_of(turn, source_no))  # words of the pass ahead of its short block
    if rest <= before:
        more, last = -(-rest // BLOCK), (rest - 1) % BLOCK + 1
    elif rest <= before + short:
        more, last = before // BLOCK + 1, rest - before
    else:
        more, last = 1 + -(-(rest - short) // BLOCK), (rest - short - 1) % BLOCK + 1
    return turn * n + more, last


def _block_of(k: pd.Series, n: pd.Series, source_no: pd.Series) -> pd.Series:
    n_, turn = n.to_numpy(), k.to_numpy() // n.to_numpy()
    return pd.Series(permuted(k.to_numpy() % n_, n_, key_of(turn, source_no.to_numpy())))


def _read(parts: DataFrame) -> DataFrame:
    """Parts of documents cut to the words that their slot reads of the block."""
    return parts.where(F.col("at") < F.col("most")).withColumn("words", F.least("words", F.col("most") - F.col("at"))).drop("most")


class Mix:
    """rows: file_no, row_no, doc_id, size, source_no, start; sources: one row each; slots: shard, slot, source_no, block, turn, most (words it reads)."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        light = with_row_id(docs.select("doc_id", "text", "source")).select("file_no", "row_no", "doc_id", "source", n_words(text_of()).alias("size"), F.xxhash64("row_no", "doc_id", crc32_text()).alias("order"))
        light = saved(light, "mix-rows")  # one row per document, without its text
        found = sorted(light.groupBy("source").agg(F.sum("size"), F.count("*")).collect(), key=lambda r: (r[0] is None, r[0] or ""))
        sizes, n_rows = [r[1] for r in found], sum(r[2] for r in found)
        targets = fill_targets(sizes)
        n_blocks = [-(-x // BLOCK) for x in sizes]
        ends = [slots_for(min(3 * x, round(t)), x, k) for k, (t, x) in enumerate(zip(targets, sizes))]
        slots = [n for n, _ in ends]
        known = [(r[0], k, x, float(t), n, *end) for k, (r, x, t, n, end) in enumerate(zip(found, sizes, targets, n_blocks, ends))]
        self.sources = spark.createDataFrame(known, "source string, source_no int, source_size long, target double, n_blocks long, n_slots long, last long")
        named = self.sources.select(F.col("source").alias("known"), "source_no")
        if len(known) <= 10_000:  # else Spark chooses by what it measures
            named = F.broadcast(named)
        light = light.join(named, F.col("source").eqNullSafe(F.col("known")), "left").drop("known")
        light = light.withColumn("bucket", F.pmod(F.xxhash64("order"), F.lit(pieces_for(n_rows, BUCKET))).cast("int"))
        sums = light.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
        before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select("source_no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        within = Window.partitionBy("source_no", "bucket").orderBy("order", "row_no", "doc_id", "file_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        light = light.withColumn("running", F.sum("size").over(within)).join(offsets, ["source_no", "bucket"])
        self.rows = saved(light.select("file_no", "row_no", "doc_id", "size", "source_no", (F.col("offset") + F.col("running") - F.col("size")).alias("start")), "mix-places")
        counts = saved(draw_counts(spark, slots), "mix-counts")
        ended = self.sources.select("source_no", "n_blocks", "n_slots", "last")
        counts = counts.join(F.broadcast(ended) if len(known) <= 10_000 else ended, "source_no")
        counts = counts.repartition(pieces_for(sum(slots), 100_000), "shard", "source_no")
        slot = counts.select("shard", "source_no", "n_blocks", "n_slots", "last", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))
        slot = slot.withColumn("block", F.pandas_udf(_block_of, "long")("slot", "n_blocks", "source_no"))
        self.slots = slot.select("shard", "source_no", "slot", "block", F.expr("slot div n_blocks").cast("int").alias("turn"), F.when(F.col("slot") == F.col("n_slots") - 1, F.col("last")).otherwise(BLOCK).alias("most"))

    def pieces(self) -> DataFrame:
        """Parts of documents by block: from_word (in the document), words, and at, their place in the block."""
        rows = self.rows.where("size > 0")
        blocks = F.explode(F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}")))
        parts = rows.select("file_no", "row_no", "source_no", "size", "start", blocks.alias("block"))
        low = F.greatest("start", F.col("block") * BLOCK)
        high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
        return parts.select("file_no", "row_no", "source_no", "block", (low - F.col("start")).alias("from_word"), (high - low).alias("words"), (low - F.col("block") * BLOCK).alias("at"))

    def drawn(self) -> DataFrame:
        """Each slot's parts of documents: shard, slot, turn, file_no, row_no, from_word, words, at."""
        parts = self.slots.hint("merge").join(self.pieces(), ["source_no", "block"])  # slots are exploded: no size estimate holds
        return _read(parts)

    def taken(self) -> DataFrame:
        """file_no, row_no and the words that the mix takes of the row, repeats counted."""
        times = self.slots.groupBy("source_no", "block", "most").agg(F.count("*").alias("times"))
        parts = _read(self.pieces().join(times.hint("merge"), ["source_no", "block"]))
        return parts.groupBy("file_no", "row_no").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = Mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    rows = mix.rows.join(mix.taken(), ["file_no", "row_no"], "left")
    sources = mix.sources.select("source_no", "source_size", "target")
    return rows.join(sources, "source_no").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _pieces(batches):
    """The words of every part of a document, with single spaces between them."""
    import re

    import pyarrow as pa

    word = re.compile(r"[^\x20\x09-\x0D]+")
    names = ["shard", "source_no", "slot", "at"]
    for batch in batches:
        for doc_id, text, parts in zip(*(batch.column(k).to_pylist() for k in range(3))):
            words = word.findall(text)
            out = [pa.array([doc_id] * len(parts), pa.int64())] + [pa.array([p[c] for p in parts], pa.int32() if c == "source_no" else pa.int64()) for c in names]
            text_ = pa.array([" ".join(words[p["from_word"] : p["from_word"] + p["words"]]) for p in parts])
            yield pa.RecordBatch.from_arrays([*out, text_], ["doc_id", *names, "text"])


def _cut(batches):
    """Texts cut to the taken ranges of words; a range is (from, to)."""
    import re

    import pyarrow as pa

    word = re.compile(r"[^\x20\x09-\x0D]+")
    for batch in batches:
        texts, ranges, sizes = (batch.column(k).to_pylist() for k in (1, 2, 3))
        out = []
        for text, parts, size in zip(texts, ranges, sizes):
            merged: list[list[int]] = []
            for a, n in sorted((p["from_word"], p["words"]) for p in parts):
                if merged and merged[-1][1] == a:
                    merged[-1][1] = a + n
                else:
                    merged.append([a, a + n])
            if merged == [[0, size]]:
                out.append(text)
                continue
            at = [m.span() for m in word.finditer(text)]
            out.append("\n".join(text[at[a][0] : at[b - 1][1]] for a, b in merged))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc", "text_"])


def mixed_blocks(docs: DataFrame) -> DataFrame:
    """The output shards: shard, slot and source_no of every block, doc_id, at (where in the block its words stand) and text of its
    pieces. A shard's slots are ordered by a hash, so its sources are mixed inside it too."""
    docs = filed(docs)
    mix = Mix(docs)
    parts = mix.drawn().groupBy("file_no", "row_no").agg(F.collect_list(F.struct("shard", "source_no", "slot", "at", "from_word", "words")).alias("parts"))
    rows = with_row_id(docs.select("doc_id", "text")).join(parts, ["file_no", "row_no"]).select("doc_id", "text", "parts")
    schema = "doc_id long, shard long, source_no int, slot long, at long, text string"
    return rows.mapInArrow(_pieces, schema).withColumn("place", F.xxhash64("shard", "source_no", "slot"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per document and pass over its source, with the words that the drawn blocks take of it."""
    docs = filed(docs)
    mix = Mix(docs)
    parts = mix.drawn().groupBy("file_no", "row_no", "turn").agg(F.collect_list(F.struct("from_word", "words")).alias("parts"))
    parts = parts.join(mix.rows.select("file_no", "row_no", "size"), ["file_no", "row_no"])
    others = F.struct(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c != "text")).alias("doc")
    rows = carried(docs).join(parts, ["file_no", "row_no"]).select(others, "doc.text", "parts", "size")
    cut = rows.mapInArrow(_cut, f"doc {dict(rows.dtypes)['doc']}, text_ string")
    return cut.select(*replaced(docs, {"text": F.col("text_")} | chars_of(docs, F.col("text_"))))
