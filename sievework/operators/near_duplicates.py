"""Leader clustering of 64-bit fingerprints by Hamming distance.

Taken in keep order, the first row without a group leads one and claims every row without a group within
the threshold of itself. In parallel: a row leads exactly if no earlier row within the threshold leads, and
a claimed row belongs to its first such leader.

Candidates come from pigeonhole keys: of m blocks of bits, two values at distance <= t agree on at least
m - t. More blocks give longer keys, so m grows with the number of values. A bucket that is still too big
is split again by the same argument on its remaining bits. If a bucket cannot be split any further, only its
first rows act as possible leaders in a round, and the rows left undecided go to the next round: nothing
is capped, and the pairs looked at stay linear in the bucket. The last pass pairs the leaders that are left with the
rows of their bucket; leaders are further apart than the threshold, so they are few in a tight bucket.

Keys get shorter as the threshold grows: 20 bits at 4, 16 at 6, 8 at 12, 4 at 15. From 16 on the shortest key has
three bits or fewer and the work nears that of all pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.fingerprints import hamming
from sievework.operators.ranks import first_per_group
from sievework.session import cut_lineage

BUCKET_ROWS = 512
MAX_KEYS = 100
SPLIT_LEVELS = 3
# Splitting gives a value threshold + 1 keys for one; it stops before a value could have more keys than this.
MAX_SPLIT_KEYS = 500
# Keys that one task sorts, counts or pairs. Files of keys are small for their rows (a value repeats under all its keys), so
# neither the size of a file nor that of a shuffle tells how many tasks they need, nor whether they may be broadcast.
TASK_KEYS = 1 << 17
BUCKET = ["mask", "bits"]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _blocks(positions: list[int], n: int) -> list[int]:
    """Cut bit positions into n masks of nearly equal size."""
    cuts = [len(positions) * i // n for i in range(n + 1)]
    return [sum(1 << p for p in positions[a:b]) for a, b in zip(cuts, cuts[1:])]


def key_masks(rows: int, threshold: int) -> list[int]:
    """Masks of the pigeonhole keys: as few as give about 16 rows per bucket for evenly spread values."""
    if threshold >= 64:
        return [0]
    blocks = threshold + 1
    while blocks < 64 and comb(blocks + 1, threshold) <= MAX_KEYS:
        if (blocks - threshold) * (64 // blocks) + 4 >= log2(max(rows, 2)):
            break
        blocks += 1
    parts = _blocks(list(range(64)), blocks)
    return [sum(chosen) for chosen in combinations(parts, blocks - threshold)]


def split_mask(mask: int, threshold: int) -> list[int]:
    """Longer keys for rows that agree under `mask`; [] when too few bits remain to tell rows apart."""
    free = [p for p in range(64) if not mask >> p & 1]
    if len(free) <= threshold:
        return []
    return [mask | part for part in _blocks(free, threshold + 1)]


def _explode_keys(nodes: DataFrame, masks: list[int]) -> DataFrame:
    table = F.array(*[F.lit(_signed(m)).cast("bigint") for m in masks])
    return nodes.select("fp", "rank", F.explode(table).alias("mask")).withColumn(
        "bits", F.col("fp").bitwiseAND(F.col("mask")))


def _tasks(df: DataFrame, keys: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, ceil(keys / TASK_KEYS))


def _dealt(keys: DataFrame, rows: int) -> DataFrame:
    """Whole buckets in tasks of about TASK_KEYS of the `rows` keys."""
    return keys.repartition(_tasks(keys, rows), *BUCKET)


def _spread(nodes: DataFrame, keys: int) -> DataFrame:
    """Values in tasks that make about TASK_KEYS of all `keys` keys each: one task may read a whole file of values."""
    return nodes.repartition(_tasks(nodes, keys), "rank")


def bucket_keys(nodes: DataFrame, rows: int, threshold: int, bucket_rows: int) -> tuple[DataFrame, bool]:
    """(fp, rank, mask, bits) per candidate bucket, and whether a bucket above `bucket_rows` is left."""
    masks = key_masks(rows, threshold)
    n_keys = rows * len(masks)
    keys = _explode_keys(_spread(nodes, n_keys), masks)
    done: DataFrame | None = None
    for level in range(SPLIT_LEVELS + 1):
        if rows <= bucket_rows:
            return keys if done is None else done.unionByName(keys), False
        hot = cut_lineage(_dealt(keys, n_keys).groupBy(*BUCKET).agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows))
        if hot.isEmpty():
            return keys if done is None else done.unionByName(keys), False
        children = {m: split_mask(m, threshold) for m in masks}
        per_value = len(key_masks(rows, threshold)) * (threshold + 1) ** (level + 1)
        if level == SPLIT_LEVELS or not any(children.values()) or per_value > MAX_SPLIT_KEYS:
            break
        cold = keys.join(hot, BUCKET, "left_anti")
        done = cold if done is None else done.unionByName(cold)
        longer = F.create_map(*[x for m, subs in children.items() for x in (
            F.lit(_signed(m)).cast("bigint"),
            F.array(*[F.lit(_signed(s)).cast("bigint") for s in (subs or [m])]))])
        masks = sorted({s for m, subs in children.items() for s in (subs or [m])})
        in_hot = keys.join(hot, BUCKET, "left_semi")
        # written: the next level counts, filters and joins these rows again
        keys = cut_lineage(
            in_hot.select("fp", "rank", F.explode(longer[F.col("mask")]).alias("mask"))
            .withColumn("bits", F.col("fp").bitwiseAND(F.col("mask"))).distinct())
        n_keys = keys.count()
    return keys if done is None else done.unionByName(keys), True


def _earlier_pairs(left: DataFrame, right: DataFrame, threshold: int) -> DataFrame:
    """(src, dst) at distance <= threshold that share a bucket, src the earlier. Never by a broadcast: see TASK_KEYS."""
    a = left.select(*BUCKET, F.col("fp").alias("a"), F.col("rank").alias("src"))
    b = right.select(*BUCKET, F.col("fp").alias("b"), F.col("rank").alias("dst"))
    close = a.join(b.hint("merge"), BUCKET).filter((F.col("src") < F.col("dst")) & (hamming(F.col("a"), F.col("b")) <= threshold))
    return close.select("src", "dst").distinct()


def _settle(pairs: DataFrame, complete: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
    """Follow the pairs until nothing changes: (claimed ranks, pairs left between undecided rows).

    `complete` holds the ranks whose earlier neighbours are all among the pairs; None means all of them.
    """
    members: DataFrame | None = None
    active = pairs
    while not active.isEmpty():
        free = active.select("src").distinct().join(active.select(F.col("dst").alias("src")), "src", "left_anti")
        if complete is not None:
            free = free.join(complete.select(F.col("rank").alias("src")), "src", "left_semi")
        claimed = cut_lineage(active.join(free, "src", "left_semi").select(F.col("dst").alias("rank")).distinct())
        if claimed.isEmpty():
            break
        members = claimed if members is None else members.unionByName(claimed)
        active = active.join(claimed.select(F.col("rank").alias("dst")), "dst", "left_anti")
        active = cut_lineage(active.join(claimed.select(F.col("rank").alias("src")), "src", "left_anti"))
    return members, active


def leader_links(nodes: DataFrame, threshold: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """For distinct fingerprints with keep ranks (fp LONG, rank LONG, both unique): (rank, leader_rank) of
    every claimed row. Rows without a link lead themselves.
    """
    nodes = cut_lineage(nodes.select("fp", "rank"))
    undecided = nodes
    members: DataFrame | None = None
    while True:
        rows = undecided.count()
        keys, overfull = bucket_keys(undecided, rows, threshold, bucket_rows)
        if not overfull:
            keys = cut_lineage(keys)
            keys = _dealt(keys, keys.count())
            pairs = cut_lineage(_earlier_pairs(keys, keys, threshold))
            claimed, _ = _settle(pairs, None)
            if members is None:  # every pair was seen in one round
                if claimed is None:
                    return pairs.select(F.col("dst").alias("rank"), F.col("src").alias("leader_rank"))
                leading = pairs.join(claimed.select(F.col("rank").alias("src")), "src", "left_anti")
                return leading.groupBy(F.col("dst").alias("rank")).agg(F.min("src").alias("leader_rank"))
            members = members if claimed is None else members.unionByName(claimed)
            break
        keys = cut_lineage(keys)
        heads = cut_lineage(first_per_group(keys, BUCKET, ["rank"], bucket_rows))
        pairs = cut_lineage(_earlier_pairs(heads, keys, threshold))
        seen = heads.groupBy("rank").agg(F.count("*").alias("h"))
        complete = cut_lineage(keys.groupBy("rank").agg(F.count("*").alias("k")).join(seen, "rank")
                               .filter(F.col("h") == F.col("k")).select("rank"))
        claimed, left = _settle(pairs, complete)
        open_rows = undecided if claimed is None else undecided.join(claimed, "rank", "left_anti")
        leads = complete.join(left.select(F.col("dst").alias("rank")), "rank", "left_anti")
        if claimed is not None:
            members = claimed if members is None else members.unionByName(claimed)
            leads = leads.join(claimed, "rank", "left_anti")
        undecided = cut_lineage(open_rows.join(leads, "rank", "left_anti"))
        if undecided.isEmpty():
            break
    if members is None:
        return nodes.limit(0).select("rank", F.col("rank").alias("leader_rank"))
    # rounds fix who leads; the first leader of each claimed row is found over all leaders at once
    members = cut_lineage(members)
    keys, _ = bucket_keys(nodes, nodes.count(), threshold, bucket_rows)
    keys = cut_lineage(keys)
    leader_keys = keys.join(members, "rank", "left_anti")
    member_keys = keys.join(members, "rank", "left_semi")
    links = _earlier_pairs(leader_keys, member_keys, threshold)
    return links.groupBy(F.col("dst").alias("rank")).agg(F.min("src").alias("leader_rank"))
