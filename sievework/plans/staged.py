"""The manifest after quality rules and reviewer decisions, and after duplicates; with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.fingerprints import to_hex
from sievework.functions.text import stable_id
from sievework.operators.duplicates import DuplicateResult, resolve_duplicates
from sievework.operators.overrides import apply_valid_overrides
from sievework.operators.quality import apply_quality_rules
from sievework.plans import items as source
from sievework.session import cut_lineage

ACTION_OF_EVENT = {"purchase": "use", "error": "exclude", "view": "hold"}


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer decisions drawn from the events: many per item, the last one counts; some name no item."""
    events = source.table(spark, sf_dir, "events").filter(F.col("event_type").isin(list(ACTION_OF_EVENT)))
    action = F.create_map(*[F.lit(x) for pair in ACTION_OF_EVENT.items() for x in pair])[F.col("event_type")]
    return events.select(
        stable_id(F.lit("corpus"), F.lit("documents"), (F.col("user_id") * 7).cast("string")).alias("image_id"),
        action.alias("action"),
        F.when(F.col("event_type") == "purchase", F.when(F.col("value") > 5, "DOC_GOOD").otherwise("DOC_POOR")).alias("class_id"),
        F.when(F.col("value") > 1, F.concat(F.lit("by_"), F.col("event_type"))).alias("reason"),
        F.lit("reviewer").alias("decided_by"), F.col("ts").alias("decided_at"), F.lit("approved").alias("status"),
        F.col("event_id").alias("seq"))


def checked_items(spark: SparkSession, sf_dir: str, prints: bool = False) -> DataFrame:
    return apply_quality_rules(source.items(spark, sf_dir, prints), source.datasets(spark))


def staged(spark: SparkSession, sf_dir: str, prints: bool = False) -> DataFrame:
    return apply_valid_overrides(checked_items(spark, sf_dir, prints), decisions(spark, sf_dir), "seq")


def curated(spark: SparkSession, sf_dir: str) -> DuplicateResult:
    """The settled manifest, from the files."""
    # written once: resolving reads the manifest three times
    rows = cut_lineage(staged(spark, sf_dir, prints=True).withColumn("phash", to_hex(F.col("phash64"))))
    return resolve_duplicates(rows, source.datasets(spark).select("dataset_id", "priority"))


QUALITY_SQL = source.ITEMS_SQL + r""",
checked AS (
  SELECT * REPLACE (
    CASE WHEN small OR blurry THEN 'exclude' ELSE status END AS status,
    CASE WHEN small THEN 'too_small' WHEN blurry THEN 'too_blurry' ELSE reason END AS reason)
  FROM (
    SELECT *, coalesce(status IN ('use','hold') AND least(width, height) < 1 + priority % 3, false) AS small,
      coalesce(status IN ('use','hold') AND sharpness_256 < 40 + priority, false) AS blurry
    FROM items)
)"""

DECISIONS_SQL = r"""
decisions AS (
  SELECT substr(sha1('corpus|documents|' || user_id * 7), 1, 16) AS image_id,
    CASE event_type WHEN 'purchase' THEN 'use' WHEN 'error' THEN 'exclude' ELSE 'hold' END AS action,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN value > 5 THEN 'DOC_GOOD' ELSE 'DOC_POOR' END END AS class_id,
    CASE WHEN value > 1 THEN 'by_' || event_type END AS reason, 'reviewer' AS decided_by, ts AS decided_at,
    'approved' AS status, event_id AS seq
  FROM events WHERE event_type IN ('purchase', 'error', 'view')
), last_decision AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY seq DESC) AS rn FROM decisions) WHERE rn = 1
)"""

STAGED_SQL = QUALITY_SQL + "," + DECISIONS_SQL + r""",
staged AS (
  SELECT c.* REPLACE (
    coalesce(d.action, c.status) AS status,
    CASE WHEN d.action IS NULL THEN c.reason ELSE 'review:' || coalesce(d.reason, 'unspecified') END AS reason,
    CASE WHEN d.action IS NULL OR d.action = 'hold' THEN c.class_id WHEN d.action = 'use' THEN d.class_id END AS class_id)
  FROM checked c LEFT JOIN last_decision d ON c.image_id = d.image_id
)"""

# leaders by walking the fingerprints in keep order, then outcomes and row changes
CURATED_SQL = "WITH RECURSIVE " + STAGED_SQL + "," + source.FINGERPRINTS_SQL + r""",
part AS (
  SELECT s.*, f.phash64, starts_with(coalesce(s.reason, ''), 'review:') AS reviewed,
    row_number() OVER (ORDER BY starts_with(coalesce(s.reason, ''), 'review:') DESC,
      CASE s.status WHEN 'use' THEN 0 WHEN 'hold' THEN 1 ELSE 2 END,
      CAST(s.width AS BIGINT) * s.height DESC, s.priority, s.member_path) AS keep
  FROM staged s JOIN fps f ON s.doc_id = f.doc_id
  WHERE s.status IN ('use', 'hold') OR (s.status = 'exclude' AND starts_with(coalesce(s.reason, ''), 'review:'))
), nodes AS MATERIALIZED (
  SELECT phash64 AS fp, row_number() OVER (ORDER BY min(keep)) AS rank FROM part GROUP BY phash64
), walk AS (
  SELECT CAST(0 AS BIGINT) AS rank, CAST([] AS STRUCT(r BIGINT, fp BIGINT)[]) AS leaders, CAST(NULL AS BIGINT) AS leader_rank
  UNION ALL
  SELECT rank, CASE WHEN hit IS NULL THEN list_append(leaders, {'r': rank, 'fp': fp}) ELSE leaders END, coalesce(hit, rank)
  FROM (
    SELECT n.rank, n.fp, w.leaders, list_filter(w.leaders, lambda x: bit_count(xor(x.fp, n.fp)) <= 4)[1].r AS hit
    FROM walk w JOIN nodes n ON n.rank = w.rank + 1)
), placed AS (
  SELECT p.*, w.leader_rank FROM part p JOIN nodes n ON p.phash64 = n.fp JOIN walk w ON w.rank = n.rank
), groups AS (
  SELECT leader_rank, count(*) AS size, arg_min(image_id, keep) AS leader_id, arg_min(sha256, keep) AS leader_sha256,
    arg_min(reviewed AND status = 'exclude', keep) AS rejected, arg_min(phash64, keep) AS leader_phash64,
    count(DISTINCT CASE WHEN reviewed AND status = 'use' THEN class_id END) AS experts,
    count(DISTINCT coalesce(class_id, dataset_id || ':' || source_label)) AS identities,
    count(DISTINCT dataset_id) AS n_datasets, count(DISTINCT split_source) AS n_splits,
    string_agg(DISTINCT dataset_id, ' | ' ORDER BY dataset_id) AS datasets,
    string_agg(DISTINCT dataset_id || ':' || source_label, ' | ' ORDER BY dataset_id || ':' || source_label) AS labels
  FROM placed GROUP BY leader_rank HAVING count(*) > 1
), numbered AS (
  SELECT *, printf('D%05d', row_number() OVER (ORDER BY leader_rank)) AS dup_group,
    CASE WHEN rejected THEN 'copies_of_rejected'
         WHEN experts > 1 OR (experts = 0 AND identities > 1) THEN 'label_conflict' ELSE 'kept_one' END AS outcome
  FROM groups
), report AS (
  SELECT dup_group, size, outcome, outcome = 'label_conflict' AS label_conflict, datasets, n_datasets > 1 AS cross_dataset,
    n_splits > 1 AS cross_split, CASE WHEN outcome = 'kept_one' THEN leader_id END AS canonical, labels
  FROM numbered
), changes AS (
  SELECT p.image_id, g.dup_group,
    CASE WHEN g.outcome = 'label_conflict' AND NOT (p.reviewed AND g.experts < 2) THEN 'duplicate_label_conflict'
         WHEN p.reviewed OR p.image_id = g.leader_id THEN NULL
         WHEN g.outcome = 'copies_of_rejected' THEN 'duplicate_of_rejected'
         WHEN p.sha256 = g.leader_sha256 THEN 'exact_duplicate' ELSE 'near_duplicate' END AS change, g.leader_id
  FROM placed p JOIN numbered g ON p.leader_rank = g.leader_rank
), curated AS (
  SELECT s.* REPLACE (CASE WHEN c.change IS NOT NULL THEN 'exclude' ELSE s.status END AS status,
      coalesce(c.change, s.reason) AS reason), c.dup_group,
    CASE WHEN c.change IS NOT NULL AND c.change <> 'duplicate_label_conflict' THEN c.leader_id END AS duplicate_of
  FROM staged s LEFT JOIN changes c ON s.image_id = c.image_id
)"""
