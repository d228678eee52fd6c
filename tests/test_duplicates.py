"""Leader clustering against the sequential rule, and the outcomes of duplicate groups."""

import random
import re

import pytest

from sievework.functions.fingerprints import from_hex
from sievework.operators.duplicates import duplicate_report, duplicate_totals, resolve_duplicates
from sievework.operators import near_duplicates
from sievework.operators.near_duplicates import MAX_SPLIT_KEYS, bucket_keys, key_masks, leader_links, split_mask
from sievework.plans import all_queries
from pyspark.sql import functions as F


def sequential(values, threshold):
    free, links = [True] * len(values), {}
    for i, v in enumerate(values):
        if free[i]:
            free[i] = False
            for j in range(i + 1, len(values)):
                if free[j] and (v ^ values[j]).bit_count() <= threshold:
                    free[j] = False
                    links[j] = i
    return links


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def links_of(spark, values, threshold, bucket_rows=512):
    nodes = spark.createDataFrame([(signed(v), i) for i, v in enumerate(values)], "fp bigint, rank bigint")
    return {r["rank"]: r["leader_rank"] for r in leader_links(nodes, threshold, bucket_rows).collect()}


def flipped(rng, value, most):
    for _ in range(rng.randint(0, most)):
        value ^= 1 << rng.randrange(64)
    return value


def near_copies(rng, n):
    seeds = [rng.getrandbits(64) for _ in range(n // 3)]
    return list({flipped(rng, rng.choice(seeds), 6) for _ in range(n)})


def one_ball(rng, n):
    return list({flipped(rng, 0x0F0F0F0F12345678, 7) for _ in range(n)})


def shared_half(rng, n):
    return list({rng.getrandbits(32) for _ in range(n)})


@pytest.mark.parametrize("make,n,threshold,bucket_rows", [
    (near_copies, 300, 4, 512), (near_copies, 200, 4, 8), (one_ball, 150, 4, 16), (shared_half, 150, 4, 16),
    (near_copies, 60, 64, 8), (near_copies, 60, 0, 8), (near_copies, 80, 12, 16)])
def test_leaders_match_the_sequential_rule(spark, make, n, threshold, bucket_rows):
    rng = random.Random(n * 100 + threshold)
    values = make(rng, n)
    rng.shuffle(values)
    assert links_of(spark, values, threshold, bucket_rows) == sequential(values, threshold)


def test_no_chaining(spark):
    a, b, c = 0x0, 0xF, 0xFF
    assert links_of(spark, [a, b, c], 4) == {1: 0}
    assert links_of(spark, [b, a, c], 4) == {1: 0, 2: 0}
    assert links_of(spark, [2**64 - 1, 2**64 - 16, 0], 4) == {1: 0}


def test_keys_keep_every_close_pair():
    rng = random.Random(3)
    for rows in (100, 10**6, 10**9):
        masks = key_masks(rows, 4)
        assert len(masks) <= 100
        for _ in range(300):
            a = rng.getrandbits(64)
            b = flipped(rng, a, 4)
            hit = next(m for m in masks if a & m == b & m)
            assert any(a & s == b & s for s in split_mask(hit, 4))


FIELDS = ("image_id STRING, dataset_id STRING, status STRING, class_id STRING, source_label STRING, reason STRING, phash STRING, "
          "sha256 STRING, member_path STRING, split_source STRING, width INT, height INT")


def resolve(spark, rows, hot_rows=100_000):
    df = spark.createDataFrame(rows, FIELDS).withColumns({
        "archive": F.lit("z"), "duplicate_of": F.lit(None).cast("string"), "dup_group": F.lit(None).cast("string"),
        "phash64": from_hex(F.col("phash"))})
    priority = spark.createDataFrame([("a", 0), ("b", 1)], "dataset_id STRING, priority INT")
    result = resolve_duplicates(df, priority, hot_rows=hot_rows)
    return {r.image_id: r for r in result.manifest.collect()}, duplicate_report(result.groups)


def row(i, ds="a", status="use", cls="C1", label="l1", reason=None, phash="0000000000000000", sha=None, split="train", size=100):
    return (i, ds, status, cls, label, reason, phash, sha or i, f"p/{i}", split, size, size)


def test_held_and_used_copies_conflict(spark):
    rows, report = resolve(spark, [row("1"), row("2", status="hold", cls=None, label="l2")])
    assert {r.reason for r in rows.values()} == {"duplicate_label_conflict"}
    assert report.first().outcome == "label_conflict" and report.first().canonical is None


def test_same_class_from_two_sources_is_a_near_duplicate(spark):
    rows, report = resolve(spark, [row("2", ds="b", phash="000000000000000f"), row("1"), row("3", sha="1", split="test")])
    assert rows["1"].status == "use" and rows["2"].reason == "near_duplicate" and rows["3"].reason == "exact_duplicate"
    assert rows["2"].duplicate_of == rows["3"].duplicate_of == "1"
    got = report.first()
    assert (got.dup_group, got.size, got.canonical, got.cross_dataset, got.cross_split) == ("D00001", 3, "1", True, True)
    assert (got.datasets, got.labels) == ("a | b", "a:l1 | b:l1")
    totals = duplicate_totals(report).first()
    assert (totals.dup_groups, totals.items, totals.cross_dataset) == (1, 3, 1)


def test_expert_decisions(spark):
    rows, _ = resolve(spark, [row("1", size=500), row("2", cls="C2", reason="review:x")])
    assert rows["2"].status == "use" and (rows["1"].reason, rows["1"].duplicate_of) == ("near_duplicate", "2")
    rows, _ = resolve(spark, [row("1", reason="review:x"), row("2", cls="C2", reason="review:y"), row("3")])
    assert {r.reason for r in rows.values()} == {"duplicate_label_conflict"}
    rows, report = resolve(spark, [row("1", status="exclude", cls=None, reason="review:bad"), row("2"), row("3", status="exclude", reason="too_small")])
    assert rows["1"].reason == "review:bad" and (rows["2"].reason, rows["2"].duplicate_of) == ("duplicate_of_rejected", "1")
    assert rows["3"].dup_group is None and report.first().outcome == "copies_of_rejected"
    rows, report = resolve(spark, [row("1", reason="review:ok"), row("2", status="exclude", cls=None, reason="review:bad"), row("3")])
    assert report.first().outcome == "kept_one" and rows["2"].reason == "review:bad" and rows["3"].duplicate_of == "1"


def test_order_and_partitions_do_not_matter(spark):
    rng = random.Random(9)
    rows = [row(str(i), ds=rng.choice("ab"), phash=f"{v:016x}", label=rng.choice(["l1", "l1", "l2"]), size=rng.randint(1, 9))
            for i, v in enumerate(near_copies(rng, 60))]
    rows += [row(f"c{i}", phash=rows[0][6], sha="same") for i in range(30)]  # one group of copies, a third of the rows
    first, _ = resolve(spark, rows)
    rng.shuffle(rows)
    second, _ = resolve(spark, rows, hot_rows=5)
    assert first == second


@pytest.mark.parametrize("threshold", [4, 6, 12])
def test_a_tight_ball_is_exact_and_its_keys_stay_few(spark, threshold):
    """Values that share most of their bits overfill every bucket; a value has at most MAX_SPLIT_KEYS keys all the same."""
    rng = random.Random(threshold)
    centre = rng.getrandbits(64)
    values = list(dict.fromkeys(centre ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 9))) for _ in range(250)))
    values += [rng.getrandbits(64) for _ in range(60)]
    assert links_of(spark, values, threshold, 20) == sequential(values, threshold)
    nodes = spark.createDataFrame([(signed(v), i) for i, v in enumerate(values)], "fp BIGINT, rank BIGINT")
    keys, _ = bucket_keys(nodes, len(values), threshold, 20)
    most = keys.groupBy("rank").count().agg({"count": "max"}).first()[0]
    assert most <= max(MAX_SPLIT_KEYS, len(key_masks(len(values), threshold)))


def test_keys_are_never_broadcast(spark, monkeypatch):
    """Tables of keys are far larger than their files: every table made from them shuffles them, in tasks that grow with them."""
    plans, cut = [], near_duplicates.cut_lineage

    def noted(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return cut(df)

    monkeypatch.setattr(near_duplicates, "cut_lineage", noted)
    monkeypatch.setattr(near_duplicates, "TASK_KEYS", 500)
    rng = random.Random(5)
    values = list({rng.getrandbits(64) ^ b for _ in range(150) for b in (0, 3, 1 << 40)})
    assert links_of(spark, values, 4) == sequential(values, 4)
    joined = [p for p in plans if "bit_count" in p]
    assert joined and not any("Broadcast" in p for p in joined) and all("SortMergeJoin" in p for p in joined)
    keys = spark.range(5).select(F.col("id").alias("mask"), F.col("id").alias("bits"))
    assert near_duplicates._dealt(keys, 10_000).rdd.getNumPartitions() == 20


@pytest.mark.parametrize("name", ["cross_dataset_pairs", "curated_manifest", "curated_status", "duplicate_members",
                                  "duplicate_report", "duplicate_totals", "leakage_groups", "most_removed"])
def test_queries_on_duplicates_deal_their_keys(spark, sf_dir, monkeypatch, name):
    """One task must not pair a part of all keys that grows with the table: the tasks follow the number of keys."""
    pairs, cut = [], near_duplicates.cut_lineage

    def noted(df):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        if "bit_count" in plan:
            pairs.append(plan)
        return cut(df)

    monkeypatch.setattr(near_duplicates, "cut_lineage", noted)
    monkeypatch.setattr(near_duplicates, "TASK_KEYS", 20)
    all_queries()[name].plan(spark, sf_dir)
    tasks = [int(n) for plan in pairs for n in re.findall(r"hashpartitioning\(mask#\d+L, bits#\d+L, (\d+)\), REPARTITION", plan)]
    assert pairs and not any("Broadcast" in plan for plan in pairs) and len(tasks) == 2 * len(pairs)
    assert min(tasks) > spark.sparkContext.defaultParallelism


def test_keys_are_made_in_tasks_by_their_count(spark, monkeypatch):
    """A file of values is small, and one task may read all of it; it must not make and send all keys."""
    monkeypatch.setattr(near_duplicates, "TASK_KEYS", 500)
    rng = random.Random(11)
    nodes = spark.createDataFrame([(signed(rng.getrandbits(64)), i) for i in range(2000)], "fp BIGINT, rank BIGINT").coalesce(1)
    keys, overfull = bucket_keys(nodes, 2000, 4, 512)
    most = keys.groupBy(F.spark_partition_id().alias("task")).count().agg({"count": "max"}).first()[0]
    assert not overfull and keys.count() == 2000 * len(key_masks(2000, 4)) and most < 3 * 500
