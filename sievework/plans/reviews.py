"""Reviewer decisions and forms over the documents."""

from pyspark.sql import functions as F

from sievework.operators import overrides, review
from sievework.plans.catalogue import query
from sievework.plans.items import FINGERPRINTS_SQL, ITEMS_SQL, items, table, taxonomy
from sievework.plans.review_loop import put_decisions
from sievework.plans.staged import DECISIONS_SQL, STAGED_SQL, decisions, staged
from sievework.schema import OVERRIDES
from sievework.session import cut_lineage, shared_path
from sievework.sources.versions import VersionedTables

VERSION = "v1"
TAXONOMY_SQL = """
tax AS (SELECT * FROM (VALUES ('DOC_GOOD','en',true), ('DOC_POOR','en',true), ('DOC_FR','fr',true), ('DOC_SPAM','de',false),
  ('DOC_UNKNOWN','all',true)) t(class_id, crop, in_model)
), permitted AS (
  SELECT c.crop, t.class_id FROM (SELECT DISTINCT lang AS crop FROM documents) c
  JOIN tax t ON t.in_model AND (t.crop = 'all' OR t.crop = CASE c.crop WHEN 'es' THEN 'fr' ELSE c.crop END)
)"""
ALIASES = {"es": "fr"}
VERDICT_OF = {"click": "correct", "error": "wrong_unknown", "purchase": "wrong", "signup": "label", "view": "unsure"}


@query("WITH " + DECISIONS_SQL + " SELECT image_id, action, class_id, reason, decided_at, seq FROM last_decision")
def latest_decisions(spark, sf_dir):
    return overrides.latest_decisions(decisions(spark, sf_dir), "seq").select(
        "image_id", "action", "class_id", "reason", "decided_at", "seq")


@query("WITH " + DECISIONS_SQL + """, last AS (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY seq % 3 DESC, seq DESC) AS rn, count(*) OVER (PARTITION BY image_id) AS n FROM decisions)
SELECT image_id, action, class_id, reason, seq, n AS in_history, 3 AS version FROM last WHERE rn = 1""")
def versioned_decisions(spark, sf_dir):
    """The decisions in three imports, each one change of the current decisions and the history together."""
    store = VersionedTables(spark, shared_path(spark, "versions-"))
    rows = cut_lineage(decisions(spark, sf_dir))
    for part in range(3):
        state = put_decisions(store, rows.filter(F.col("seq") % 3 == part), OVERRIDES + ", seq BIGINT", "seq")
    history = store.read("history", OVERRIDES + ", seq BIGINT", state).groupBy("image_id").agg(F.count("*").alias("in_history"))
    current = store.read("decisions", OVERRIDES + ", seq BIGINT", state)
    return current.join(history, "image_id").select("image_id", "action", "class_id", "reason", "seq", "in_history", F.lit(state.version).alias("version"))


@query("WITH " + STAGED_SQL + " SELECT image_id, status, reason, class_id FROM staged")
def decided_manifest(spark, sf_dir):
    return staged(spark, sf_dir).select("image_id", "status", "reason", "class_id")


@query("WITH " + ITEMS_SQL + "," + DECISIONS_SQL + """ SELECT image_id, action, seq FROM decisions
WHERE image_id NOT IN (SELECT image_id FROM items)""")
def unknown_decisions(spark, sf_dir):
    return overrides.unknown_overrides(decisions(spark, sf_dir), items(spark, sf_dir)).select("image_id", "action", "seq")


@query("WITH " + ITEMS_SQL + "," + DECISIONS_SQL + "," + FINGERPRINTS_SQL + """
SELECT d.image_id, CASE WHEN d.value > 8 AND d.action = 'use' THEN 'unknown action'
    WHEN d.action = 'use' AND d.value > 6 THEN '''use'' needs a class of the taxonomy'
    WHEN d.action = 'use' AND i.image_id IS NOT NULL AND (f.phash64 IS NULL OR i.crop = 'fr') THEN 'item was never hashed' END AS problem
FROM (SELECT d.*, e.value FROM decisions d JOIN events e ON d.seq = e.event_id) d
LEFT JOIN items i ON d.image_id = i.image_id LEFT JOIN fps f ON i.doc_id = f.doc_id
WHERE problem IS NOT NULL""")
def decision_problems(spark, sf_dir):
    """Decisions made faulty by the value of their event: an action that does not exist, a class outside the taxonomy,
    a use of an item without a fingerprint (here: French texts)."""
    value = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "value")
    faulty = decisions(spark, sf_dir).join(value, "seq").withColumns({
        "action": F.when((F.col("action") == "use") & (F.col("value") > 8), "keep").otherwise(F.col("action")),
        "class_id": F.when((F.col("action") == "use") & (F.col("value") > 6), "DOC_NONE").otherwise(F.col("class_id"))}).drop("value")
    rows = items(spark, sf_dir, prints=True).select("image_id", F.when(F.col("crop") != "fr", F.col("phash64")).alias("phash64"))
    return overrides.override_violations(faulty, rows, taxonomy(spark))


@query("WITH " + DECISIONS_SQL + """, cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY decided_at DESC) AS rn FROM decisions WHERE action = 'use') WHERE rn = 1),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY decided_at DESC) AS rn FROM decisions WHERE action = 'hold') WHERE rn = 1)
SELECT coalesce(f.image_id, c.image_id) AS image_id, coalesce(f.action, c.action) AS action,
  CASE WHEN f.image_id IS NULL THEN c.class_id ELSE f.class_id END AS class_id, coalesce(f.decided_at, c.decided_at) AS decided_at
FROM cur c FULL JOIN fresh f ON c.image_id = f.image_id""")
def upserted_decisions(spark, sf_dir):
    rows = decisions(spark, sf_dir)
    merged = overrides.upsert_decisions(rows.filter("action = 'use'"), rows.filter("action = 'hold'"))
    return merged.select("image_id", "action", "class_id", "decided_at")


@query("WITH " + TAXONOMY_SQL + " SELECT crop, class_id FROM permitted")
def allowed_classes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("crop"))
    return review.allowed_classes(docs, taxonomy(spark), ALIASES)


def answers(spark, sf_dir):
    """A filled form: one row per event, some on unknown items, other versions or classes the crop lacks."""
    rows = items(spark, sf_dir).select("doc_id", "image_id", "dataset_id", "crop", "source_label", "class_id")
    events = table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") * 7).alias("doc_id"), "event_type", "value")
    verdict = F.create_map(*[F.lit(x) for pair in VERDICT_OF.items() for x in pair])[F.col("event_type")]
    return events.join(rows, "doc_id", "left").select(
        F.when(F.col("value") > 40, "v0").when(F.col("value") > 3, "v1").alias("manifest_version"),
        F.coalesce("image_id", F.concat(F.lit("x"), "doc_id")).alias("image_id"), "dataset_id", "crop", "source_label",
        F.coalesce("class_id", F.lit("(none)")).alias("current_class"),
        F.when(F.col("value") > 0.5, F.when(F.col("value") < 0.7, "Maybe").otherwise(verdict)).alias("verdict"),
        F.when(F.col("event_type").isin("purchase", "signup") & (F.col("value") > 2),
               F.when(F.col("value") > 12, "DOC_FR").otherwise("DOC_GOOD"))
        .when((F.col("event_type") == "view") & (F.col("value") > 30), "DOC_POOR").alias("correct_class"),
        F.lit("").alias("notes"), "event_id")


ANSWERS_SQL = "WITH " + ITEMS_SQL + "," + TAXONOMY_SQL + """, answers AS (
  SELECT e.event_id, CASE WHEN e.value > 40 THEN 'v0' WHEN e.value > 3 THEN 'v1' END AS manifest_version,
    coalesce(i.image_id, 'x' || e.user_id * 7) AS image_id, i.dataset_id, i.source_label, i.crop AS known_crop,
    coalesce(i.class_id, '(none)') AS current_class,
    CASE WHEN e.value > 0.5 THEN CASE WHEN e.value < 0.7 THEN 'maybe' ELSE CASE e.event_type WHEN 'click' THEN 'correct'
      WHEN 'error' THEN 'wrong_unknown' WHEN 'purchase' THEN 'wrong' WHEN 'signup' THEN 'label' WHEN 'view' THEN 'unsure' END END END AS verdict,
    CASE WHEN e.event_type IN ('purchase', 'signup') AND e.value > 2 THEN CASE WHEN e.value > 12 THEN 'DOC_FR' ELSE 'DOC_GOOD' END
      WHEN e.event_type = 'view' AND e.value > 30 THEN 'DOC_POOR' END AS correct_class
  FROM events e LEFT JOIN items i ON i.doc_id = e.user_id * 7
), checked AS (
  SELECT *, CASE WHEN verdict IS NULL THEN [] WHEN verdict = 'maybe' THEN ['unknown_verdict'] WHEN known_crop IS NULL THEN ['unknown_item']
    WHEN manifest_version = 'v0' THEN ['other_manifest_version'] ELSE list_filter([
      CASE WHEN verdict IN ('wrong', 'label') AND correct_class IS NULL THEN 'class_required'
        WHEN verdict NOT IN ('wrong', 'label') AND correct_class IS NOT NULL THEN 'class_must_be_empty'
        WHEN correct_class IS NOT NULL AND NOT EXISTS (SELECT 1 FROM permitted p WHERE p.crop = known_crop AND p.class_id = correct_class)
        THEN 'class_not_valid_for_crop' END,
      CASE WHEN verdict = 'correct' AND current_class = '(none)' THEN 'item_has_no_class' END], lambda x: x IS NOT NULL) END AS errors
  FROM answers
)"""


def checked_answers(spark, sf_dir):
    return review.check_form(answers(spark, sf_dir), items(spark, sf_dir).select("image_id", "crop"), taxonomy(spark), VERSION, ALIASES)


@query(ANSWERS_SQL + """ SELECT event_id, array_to_string(errors, ',') AS errors,
  CASE WHEN len(errors) = 0 THEN CASE verdict WHEN 'wrong' THEN 'use' WHEN 'label' THEN 'use' WHEN 'wrong_unknown' THEN 'exclude' WHEN 'unsure' THEN 'hold' END END AS action
FROM checked""")
def form_check(spark, sf_dir):
    return checked_answers(spark, sf_dir).select("event_id", F.concat_ws(",", "errors").alias("errors"), "action")


@query(ANSWERS_SQL + " SELECT error, count(*) AS answers FROM (SELECT unnest(errors) AS error FROM checked) GROUP BY 1")
def form_error_counts(spark, sf_dir):
    return review.form_errors(checked_answers(spark, sf_dir)).groupBy("error").agg(F.count("*").alias("answers"))


@query(ANSWERS_SQL + """ SELECT image_id, CASE verdict WHEN 'wrong_unknown' THEN 'exclude' WHEN 'unsure' THEN 'hold' ELSE 'use' END AS action,
  correct_class AS class_id, 'expert_' || verdict || ':audit' AS reason FROM checked
WHERE len(errors) = 0 AND verdict IS NOT NULL AND verdict <> 'correct'""")
def form_decisions(spark, sf_dir):
    rows = review.form_decisions(checked_answers(spark, sf_dir), "audit", "expert", F.lit("2024-05-01").cast("timestamp"))
    return rows.select("image_id", "action", "class_id", "reason")


@query(ANSWERS_SQL + """ SELECT dataset_id, source_label, count(*) AS audited, count(*) FILTER (verdict IN ('wrong', 'wrong_unknown')) AS wrong,
  round(count(*) FILTER (verdict IN ('wrong', 'wrong_unknown')) / count(*), 6) AS error_rate,
  count(*) FILTER (verdict IN ('wrong', 'wrong_unknown')) / count(*) > 0.05 AS review_all
FROM answers WHERE verdict IS NOT NULL GROUP BY 1, 2""")
def audit_error_rates(spark, sf_dir):
    return review.audit_error_rates(answers(spark, sf_dir)).withColumn("error_rate", F.round("error_rate", 6))


@query("WITH " + STAGED_SQL + """ SELECT 'v1' AS manifest_version, image_id, dataset_id, crop, source_label, coalesce(class_id, '(none)') AS current_class,
  NULL::VARCHAR AS verdict, NULL::VARCHAR AS correct_class, NULL::VARCHAR AS notes FROM staged WHERE dataset_id = 'src3' AND status = 'hold'""")
def relabel_form(spark, sf_dir):
    return review.blank_form(review.relabel_list(staged(spark, sf_dir), "src3"), VERSION)
