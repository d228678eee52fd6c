"""Counts over the manifest read from the given tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import is_image_path
from sievework.operators import profile
from sievework.operators.classify import apply_rules
from sievework.plans.catalogue import query
from sievework.plans.classification import PAGE_RULES, PAGE_SQL, WEB, page_members
from sievework.plans.items import DATASETS, ITEMS_SQL, SOURCES, items, table, taxonomy
from sievework.plans.staged import (
    QUALITY_SQL, STAGED_SQL, DECISIONS_SQL, checked_items, decisions, staged)
from sievework.operators.overrides import override_counts
from sievework.operators.classify import classify_members
from sievework.registry import class_map_table, map_violations

WITH_STAGED = "WITH " + STAGED_SQL
WITH_ITEMS = "WITH " + ITEMS_SQL


@query("WITH " + QUALITY_SQL + """
SELECT coalesce(dataset_id, 'Total') AS dataset_id, count(*) FILTER (status = 'use') AS "use", count(*) FILTER (status = 'hold') AS hold,
  count(*) FILTER (status = 'exclude') AS exclude, count(*) AS total FROM checked GROUP BY ROLLUP (dataset_id)""")
def status_by_dataset(spark, sf_dir):
    return profile.status_by_dataset(checked_items(spark, sf_dir))


@query(WITH_STAGED + " SELECT status, count(*) AS items FROM staged GROUP BY 1")
def status_totals(spark, sf_dir):
    return profile.status_totals(staged(spark, sf_dir))


@query(WITH_STAGED + """, n AS (SELECT class_id, dataset_id, count(*) AS n FROM staged WHERE status = 'use' GROUP BY 1, 2)
SELECT class_id, sum(n)::BIGINT AS items, string_agg(dataset_id || ' (' || n || ')', ', ' ORDER BY n DESC, dataset_id) AS sources
FROM n GROUP BY 1""")
def usable_by_class(spark, sf_dir):
    return profile.usable_by_class(staged(spark, sf_dir))


@query(WITH_STAGED + " SELECT dataset_id, source_label, reason, count(*) AS items FROM staged WHERE status = 'hold' GROUP BY 1, 2, 3")
def held_items(spark, sf_dir):
    return profile.held_items(staged(spark, sf_dir))


@query(WITH_STAGED + " SELECT reason, count(*) AS items FROM staged WHERE status = 'exclude' GROUP BY 1")
def exclusion_reasons(spark, sf_dir):
    return profile.exclusion_reasons(staged(spark, sf_dir))


REASONS = ["class_dropped", "too_small", "too_blurry", "review:by_error", "review:unspecified"]


@query(WITH_STAGED + " SELECT dataset_id, " + ", ".join(
    f"count(*) FILTER (reason = '{r}') AS \"{r}\"" for r in REASONS) + " FROM staged WHERE status = 'exclude' GROUP BY 1")
def exclusion_matrix(spark, sf_dir):
    out = staged(spark, sf_dir).filter(F.col("status") == "exclude")
    return profile.count_matrix(out, "dataset_id", "reason", REASONS)


def _section(name: str, df, key: str, value: str):
    return df.select(F.lit(name).alias("section"), F.coalesce(F.col(key).cast("string"), F.lit("-")).alias("key"), F.col(value).cast("double").alias("value"))


@query(WITH_STAGED + """, use AS (SELECT * FROM staged WHERE status = 'use'),
pairs AS (SELECT class_id, dataset_id, count(*) AS n FROM use GROUP BY 1, 2), crops AS (SELECT crop, class_id, count(*) AS n FROM use GROUP BY 1, 2),
s AS (
  SELECT 'status' AS section, status AS key, count(*)::DOUBLE AS value FROM staged GROUP BY 2
  UNION ALL SELECT 'usable', class_id, count(*) FROM use GROUP BY 2
  UNION ALL SELECT 'dominance', class_id, round_even(max(n) / sum(n), 2) FROM pairs GROUP BY 2
  UNION ALL SELECT 'classes', class_id, count(*) FROM use GROUP BY 2
  UNION ALL SELECT 'imbalance', crop, round_even(max(n) / min(n), 1) FROM crops GROUP BY 2
  UNION ALL SELECT 'majority', crop, round_even(max(n) / sum(n), 4) FROM crops GROUP BY 2
  UNION ALL SELECT 'excluded', reason, count(*) FROM staged WHERE status = 'exclude' GROUP BY 2
  UNION ALL SELECT 'held', dataset_id || '/' || source_label, count(*) FROM staged WHERE status = 'hold' GROUP BY 2
  UNION ALL SELECT 'totals', coalesce(dataset_id, 'Total'), count(*) FROM staged GROUP BY ROLLUP (dataset_id)
  UNION ALL SELECT 'two_classes', dataset_id, count(DISTINCT class_id) FROM use GROUP BY 2 HAVING count(DISTINCT class_id) >= 2)
SELECT section, coalesce(key, '-') AS key, value FROM s""")
def report_sections(spark, sf_dir):
    """Ten sections of the report from one table of counts: the manifest, and so the text, is read once."""
    counts = profile.count_items(staged(spark, sf_dir))
    use = counts.filter("status = 'use'")
    held = profile.held_items(counts).groupBy(F.concat_ws("/", "dataset_id", "source_label").alias("k")).agg(F.sum("items").alias("items"))
    return reduce(DataFrame.union, [
        _section("status", profile.status_totals(counts), "status", "items"),
        _section("usable", profile.usable_by_class(counts), "class_id", "items"),
        _section("dominance", profile.dominance(counts), "class_id", "largest_source_share"),
        _section("classes", profile.class_by_dataset(counts, SOURCES), "class_id", "total"),
        _section("imbalance", profile.imbalance(counts), "crop", "imbalance_ratio"),
        _section("majority", profile.majority_share(use, "crop", "class_id"), "crop", "majority_share"),
        _section("excluded", profile.exclusion_reasons(counts), "reason", "items"), _section("held", held, "k", "items"),
        _section("totals", profile.status_by_dataset(counts), "dataset_id", "total"),
        _section("two_classes", profile.scopes_with_labels(use, "dataset_id", "class_id"), "dataset_id", "labels")])


@query("WITH " + PAGE_SQL + """ SELECT 'pages' AS archive, 'rule 0' AS skip_reason, count(*) AS members FROM rules WHERE rule_no = 0 GROUP BY 1, 2""")
def skip_reasons(spark, sf_dir):
    pages = apply_rules(page_members(spark, sf_dir), PAGE_RULES).filter(F.col("rule_skip").isNotNull())
    return pages.groupBy("archive", F.concat(F.lit("rule "), F.col("rule_no").cast("string")).alias("skip_reason")).agg(F.count("*").alias("members"))


@query("WITH " + PAGE_SQL + """, m AS (
  SELECT 'pages' AS archive, url, CASE WHEN rule_no = 0 THEN 'skipped' WHEN regexp_matches(url, '\\.html$') THEN 'ignored'
    WHEN rule_no = -1 THEN 'unmatched' ELSE 'listed' END AS kind FROM rules)
SELECT m.archive, round_even(any_value(s.b) / 1073741824.0, 2)::DOUBLE AS size_gb, '2024-05-01' AS dated,
  count(*) FILTER (kind IN ('listed', 'unmatched')) AS listed, count(*) FILTER (kind = 'skipped') AS skipped,
  count(*) FILTER (kind = 'ignored') AS ignored, count(*) FILTER (kind = 'unmatched') AS unmatched,
  min(CASE WHEN kind = 'unmatched' THEN url END) AS example
FROM m, (SELECT sum(octet_length(encode(html))) * 1000 AS b FROM pages) s GROUP BY 1""".replace("\\\\", "\\"))
def archive_counts(spark, sf_dir):
    pages = apply_rules(page_members(spark, sf_dir), PAGE_RULES)
    kind = (F.when(F.col("rule_skip").isNotNull(), "skipped").when(F.col("member_path").rlike(r"\.html$"), "ignored")
            .when(F.col("rule_no") < 0, "unmatched").otherwise("listed"))
    archives = pages.groupBy("archive").agg((F.sum("size") * 1000).alias("file_bytes")).withColumns({
        "downloaded": F.lit(None).cast("string"), "modified": F.lit("2024-05-01").cast("date")})
    return profile.archive_counts(pages.withColumn("kind", kind), archives)


@query(r"""SELECT 'pages' AS archive, CASE WHEN ext = '' THEN '<none>' ELSE ext END AS ext, count(*) AS members
FROM (SELECT lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/.][^/]*(\.[^./]*)$', 1)) AS ext FROM pages)
WHERE ext NOT IN ('.jpg','.jpeg','.png','.bmp','.webp','.tif','.tiff') GROUP BY 2""")
def ignored_extensions(spark, sf_dir):
    pages = page_members(spark, sf_dir).withColumn("member_path", F.regexp_replace("member_path", "[?#].*$", ""))
    return profile.ignored_extensions(pages.filter(~is_image_path(F.col("member_path"))))


@query("WITH " + PAGE_SQL + """ SELECT 'web' AS dataset_id, source_label, count(*) AS items FROM labelled
WHERE rule_no IN (2, 3, 5) AND source_label NOT IN ('en', 'fr', 'de', 'org_page') GROUP BY 2""")
def unmapped_labels(spark, sf_dir):
    return profile.unmapped_labels(classify_members(page_members(spark, sf_dir), [WEB]))


@query(WITH_STAGED + " SELECT class_id, " + ", ".join(f"count(*) FILTER (dataset_id = '{s}') AS {s}" for s in SOURCES)
       + ", count(*) AS total FROM staged WHERE status = 'use' GROUP BY 1")
def class_by_dataset(spark, sf_dir):
    return profile.class_by_dataset(staged(spark, sf_dir), SOURCES)


@query(WITH_STAGED + """, n AS (SELECT crop, class_id, count(*) AS n FROM staged WHERE status = 'use' GROUP BY 1, 2)
SELECT crop, count(*) AS classes, min(n) AS smallest, max(n) AS largest, round_even(max(n) / min(n), 1)::DOUBLE AS imbalance_ratio FROM n GROUP BY 1""")
def imbalance(spark, sf_dir):
    return profile.imbalance(staged(spark, sf_dir))


@query(WITH_STAGED + """, n AS (SELECT class_id, dataset_id, count(*) AS n FROM staged WHERE status = 'use' GROUP BY 1, 2)
SELECT class_id, round_even(max(n) / sum(n), 2)::DOUBLE AS largest_source_share FROM n GROUP BY 1""")
def dominance(spark, sf_dir):
    return profile.dominance(staged(spark, sf_dir))


@query(WITH_STAGED + """, n AS (SELECT crop, class_id, count(*) AS n FROM staged WHERE status = 'use' GROUP BY 1, 2)
SELECT crop, round_even(max(n) / sum(n), 4)::DOUBLE AS majority_share FROM n GROUP BY 1""")
def majority_share(spark, sf_dir):
    return profile.majority_share(staged(spark, sf_dir).filter("status = 'use'"), "crop", "class_id")


@query(WITH_STAGED + """ SELECT dataset_id, count(DISTINCT class_id) AS labels FROM staged WHERE status = 'use'
GROUP BY 1 HAVING count(DISTINCT class_id) >= 2""")
def sources_with_two_classes(spark, sf_dir):
    return profile.scopes_with_labels(staged(spark, sf_dir).filter("status = 'use'"), "dataset_id", "class_id")


@query(WITH_STAGED + """ SELECT class_id FROM (VALUES ('DOC_GOOD'), ('DOC_POOR'), ('DOC_FR'), ('DOC_SPAM'), ('DOC_UNKNOWN')) t(class_id)
WHERE class_id NOT IN (SELECT class_id FROM staged WHERE status = 'use')""")
def coverage_gaps(spark, sf_dir):
    return profile.coverage_gaps(taxonomy(spark), staged(spark, sf_dir)).select("class_id")


@query("WITH " + ITEMS_SQL + "," + DECISIONS_SQL + """
SELECT 'review:' || coalesce(d.reason, 'unspecified') AS reason, count(*) AS items FROM decisions d
WHERE d.image_id IN (SELECT image_id FROM items) GROUP BY 1""")
def decision_counts(spark, sf_dir):
    return override_counts(decisions(spark, sf_dir), items(spark, sf_dir))


@query("""SELECT 'src' || i AS dataset_id, t AS target FROM range(20) r(i), (VALUES ('DOC_GOOD'), ('DOC_POOR')) v(t)
WHERE t NOT IN (SELECT 'DOC_' || CASE WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END FROM labels)""")
def label_map_violations(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("DOC_"), F.when(F.col("quality") == 1, "GOOD").otherwise("BAD")).alias("class_id")).distinct()
    return map_violations(class_map_table(spark, DATASETS), known).select("dataset_id", "target")
