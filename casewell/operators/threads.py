"""Reply forests: roots, members and assembled threads of a message log (id, author, inbound, parent, created_at, text)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import stable_bucket
from ..scratch import saved


def last_per_id(log: DataFrame, position: str | None = None) -> DataFrame:
    """One row per id: the last by ``position``, or, without one, the largest row."""
    columns = [c for c in log.columns if c != "id"]
    order = F.col(position) if position else F.struct(*columns)
    return log.groupBy("id").agg(F.max_by(F.struct(*columns), order).alias("x")).select("id", "x.*")


#: Doublings between two written tables.
DOUBLINGS = 2


def _doubled(now: DataFrame) -> DataFrame:
    """Pointers of (id, at, done) moved as far again; a pointer to an absent id has ended."""
    ahead = now.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("done").alias("end"))
    moved = now.where("not done").join(ahead, "at", "left")
    moved = moved.select("id", F.coalesce("next", "at").alias("at"), F.coalesce("end", F.lit(True)).alias("done"))
    return now.where("done").unionByName(moved)


def _settle(edges: DataFrame) -> tuple[DataFrame, bool]:
    """Pointer doubling over (id, parent; null at a terminal): id, at, done; whether all are done. As many rounds as the
    number of rows asks for, which the first count of open pointers gives along."""
    now = saved(edges.select("id", F.coalesce("parent", "id").alias("at"), F.col("parent").isNull().alias("done")), "pointers")
    n, left = now.agg(F.count("*"), F.count_if(~F.col("done"))).first()
    rounds = max(1, math.ceil(math.log2(n + 2)) + 1)
    while left and rounds > 0:
        for _ in range(DOUBLINGS):
            now = _doubled(now)
        rounds -= DOUBLINGS
        now = saved(now, "pointers")
        left = now.where("not done").count()
    return now, not left


def thread_roots(log: DataFrame) -> DataFrame:
    """id, root of every message. A chain that leaves the log ends at the absent id; a message on a cycle is its
    own root, one that leads into a cycle gets the node where it enters."""
    edges = log.select("id", "parent").groupBy("id").agg(F.max("parent").alias("parent"))
    first, settled = _settle(edges)
    if settled:
        return first.select("id", F.col("at").alias("root"))
    loose = first.where("not done")
    # after so many steps exactly the nodes on cycles are pointed at; they end the walks of the rest
    cycle = saved(loose.select(F.col("at").alias("id")).distinct().withColumn("on_cycle", F.lit(True)), "cycles")
    cut = edges.join(loose.select("id"), "id").join(cycle, "id", "left").select("id", F.when(F.col("on_cycle").isNull(), F.col("parent")).alias("parent"))
    rest, _ = _settle(cut)
    return first.where("done").unionByName(rest).select("id", F.col("at").alias("root"))


def cycle_groups(log: DataFrame, roots: DataFrame) -> DataFrame:
    """root, group of roots that lie on one cycle (group: its least id)."""
    links = log.select("id", F.col("parent").alias("next")).join(roots.where("id = root").select("id"), "id").where("next is not null")
    links = links.join(roots.where("id = root").select(F.col("id").alias("next")), "next")
    now = saved(links.select("id", "next", F.least("id", "next").alias("low")), "cycle-walk")
    n = now.count()
    for _ in range(max(1, math.ceil(math.log2(n + 2)) + 1) if n else 0):
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("far"), F.col("low").alias("far_low"))
        now = saved(now.join(ahead, "next").select("id", F.col("far").alias("next"), F.least("low", "far_low").alias("low")), "cycle-walk")
    return now.select(F.col("id").alias("root"), F.col("low").alias("group"))


def thread_members(log: DataFrame, roots: DataFrame) -> DataFrame:
    """root, id of all descendants of every root that is in the log (itself too). Everything that leads into a cycle
    descends from every node on it."""
    inside = roots.join(log.select(F.col("id").alias("root")).distinct(), "root", "left_semi")
    groups = cycle_groups(log, roots)
    grouped = inside.join(groups, "root", "left")
    plain = grouped.where("group is null").select("root", "id")
    shared = grouped.where("group is not null").select("group", "id").join(groups, "group").select("root", "id")
    return plain.unionByName(shared)


def brand_semi(log: DataFrame, brands: list[str]) -> DataFrame:
    """Outbound messages by the candidate brands, in any case."""
    return log.where(~F.col("inbound") & F.lower("author").isin([b.lower() for b in brands]))


def brand_of_root(log: DataFrame, roots: DataFrame, brands: list[str]) -> DataFrame:
    """root, brand: the candidate brand that replied last (by id) owns the thread."""
    replies = brand_semi(log, brands).join(roots, "id")
    return replies.groupBy("root").agg(F.max_by(F.lower("author"), "id").alias("brand"))


def root_opener_filter(owned: DataFrame, log: DataFrame) -> DataFrame:
    """Owned roots that are in the log and inbound."""
    return owned.join(log.where("inbound").select(F.col("id").alias("root")), "root", "left_semi")


def cap_per_brand(owned: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` roots of every brand, in hash order; adds place."""
    hashed = stable_bucket(F.concat_ws(":", F.lit(str(seed)), "brand", F.col("root").cast("string")), 1_000_000_000)
    ranked = owned.withColumn("place", F.row_number().over(Window.partitionBy("brand").orderBy(hashed, "root")))
    return ranked.where(F.col("place") <= cap)


def assemble_threads(log: DataFrame, owned: DataFrame, members: DataFrame, compose: bool = True) -> DataFrame:
    """One row per owned root with at least one reply of its brand: opener, replies by id, customer turns."""
    wide = members.join(owned.select("root", "brand"), "root").join(log, "id")
    reply = ~F.col("inbound") & (F.lower("author") == F.col("brand"))
    opener = F.col("id") == F.col("root")
    raw = T.filled(F.col("text"))
    rows = wide.withColumn("clean", T.normalise(F.col("text"), compose)).groupBy("root", "brand").agg(
        F.max(F.when(opener, F.col("clean"))).alias("customer_msg"),
        F.max(F.when(opener, raw)).alias("customer_msg_raw"),
        F.array_sort(F.collect_list(F.when(reply, F.struct("id", F.col("clean").alias("text"), raw.alias("text_raw"))))).alias("brand_replies"),
        (F.count_if(F.col("inbound") & ~opener) + 1).cast("int").alias("customer_turns"),
        F.max(F.when(opener, F.col("created_at"))).alias("created_at"),
    )
    return rows.where(F.size("brand_replies") > 0).withColumn("thread_id", F.col("root").cast("string")).drop("root")


def build_threads(log: DataFrame, brands: list[str], cap: int | None = None, compose: bool = True) -> DataFrame:
    """The whole reconstruction: only ids and parents travel until the last join."""
    from ..sources.io import scan_structure

    structure = scan_structure(log)
    roots = thread_roots(structure)
    owned = root_opener_filter(brand_of_root(structure, roots, brands), structure)
    owned = cap_per_brand(owned, cap) if cap else owned
    return assemble_threads(log, owned, thread_members(structure, roots), compose)


def brand_volume(log: DataFrame, most: int = 40) -> DataFrame:
    return log.where(~F.col("inbound")).groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(most)


def first_reply(threads: DataFrame) -> DataFrame:
    return threads.withColumn("first_reply", F.element_at("brand_replies", 1)["text"])


def brand_profile(threads: DataFrame, brands: DataFrame) -> DataFrame:
    """Per brand over usable threads; a brand with none has threads = 0 and nothing else."""
    usable = first_reply(threads).where(T.is_usable(F.col("customer_msg")))
    reply = F.col("first_reply")
    share = lambda c: F.avg(c.cast("double"))
    found = usable.groupBy("brand").agg(
        F.count("*").alias("threads"),
        share(T.is_deflection(reply)).alias("dm_deflection_rate"),
        share(T.is_link_handoff(reply)).alias("link_handoff_rate"),
        share(T.is_handoff(reply)).alias("handoff_rate"),
        F.median(F.length(reply)).cast("int").alias("median_reply_chars"),
        share(~T.is_handoff(reply) & (F.length(reply) >= 80)).alias("substantive_rate"),
        share(F.col("customer_turns") > 1).alias("multi_turn_rate"),
        F.median(F.size("brand_replies")).alias("median_replies_per_thread"),
    )
    tokens = usable.select("brand", F.explode(T.ws_tokens(reply)).alias("token")).groupBy("brand").agg((F.count_distinct("token") / F.count("token")).alias("lexical_diversity"))
    joined = brands.select("brand").distinct().join(found, "brand", "left").join(tokens, "brand", "left")
    return joined.withColumn("threads", F.coalesce("threads", F.lit(0)))
