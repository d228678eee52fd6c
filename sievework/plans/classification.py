"""Path rules, labels, ids and scalar columns over pages and documents."""

from pyspark.sql import functions as F

from sievework.functions import fingerprints as fp
from sievework.functions import text as tx
from sievework.operators.classify import classify_members, match_rule_table, skipped_members
from sievework.operators.scoring import input_error
from sievework.operators.rule_index import match_indexed
from sievework.plans.catalogue import query
from sievework.plans.items import FINGERPRINTS_SQL, ITEMS_SQL, items, table
from sievework.plans.staged import STAGED_SQL, staged
from sievework.registry import Archive, Dataset, PathRule
from sievework.session import small_table

PAGE_RULES = (
    PathRule(r"cheap-pills", skip="spam_host"),
    PathRule(r"[?&]utm_source=", exclude="tracking_copy"),
    PathRule(r"^https?://(?P<split>www|m|blog)\.[^/]+/(?P<label>[a-z]{2})/"),
    PathRule(r"^https?://[^/]+\.org/", label="Org Page_test"),
    PathRule(r"^https?://[^/]+\.net/[a-z]{2}/[0-9]+/?$"),
    PathRule(r"^http://[^/]+/(?P<label>[a-z]+)/[0-9]+"),
)
WEB = Dataset("web", "pages", 0, {"en": "WEB_EN", "fr": None, "de": "review", "org_page": "drop"}, {"en": 1, "de": 2},
              ("_valid", "_test"), (Archive("pages", PAGE_RULES),))


def page_members(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("archive"), F.col("url").alias("member_path"), F.col("page_id").alias("crc"),
        F.octet_length("html").cast("bigint").alias("size"))


PAGE_SQL = r"""
rules AS (
  SELECT page_id, url, html, CASE
    WHEN regexp_matches(url, 'cheap-pills') THEN 0 WHEN regexp_matches(url, '[?&]utm_source=') THEN 1
    WHEN regexp_matches(url, '^https?://(www|m|blog)\.[^/]+/([a-z]{2})/') THEN 2
    WHEN regexp_matches(url, '^https?://[^/]+\.org/') THEN 3
    WHEN regexp_matches(url, '^https?://[^/]+\.net/[a-z]{2}/[0-9]+/?$') THEN 4
    WHEN regexp_matches(url, '^http://[^/]+/([a-z]+)/[0-9]+') THEN 5 ELSE -1 END AS rule_no FROM pages
), labelled AS (
  SELECT *, CASE rule_no WHEN 2 THEN regexp_extract(url, '^https?://(www|m|blog)\.[^/]+/([a-z]{2})/', 1) END AS split_source,
    CASE rule_no WHEN 2 THEN regexp_extract(url, '^https?://(www|m|blog)\.[^/]+/([a-z]{2})/', 2) WHEN 3 THEN 'org_page'
      WHEN 5 THEN regexp_extract(url, '^http://[^/]+/([a-z]+)/[0-9]+', 1) END AS source_label FROM rules
)"""


@query("WITH " + PAGE_SQL + r"""
SELECT substr(sha1('web|pages|' || url), 1, 16) AS image_id, url AS member_path, split_source, source_label,
  CASE WHEN rule_no IN (-1, 1, 4) OR source_label = 'org_page' THEN 'exclude' WHEN source_label = 'en' THEN 'use' ELSE 'hold' END AS status,
  CASE WHEN rule_no = -1 THEN 'no_rule_matched' WHEN rule_no = 1 THEN 'tracking_copy' WHEN rule_no = 4 THEN 'rule_has_no_label'
    WHEN source_label = 'org_page' THEN 'class_dropped' WHEN source_label = 'fr' THEN 'pending_taxonomy'
    WHEN source_label = 'de' THEN 'needs_expert_review' WHEN source_label <> 'en' THEN 'label_not_in_class_map' END AS reason,
  CASE source_label WHEN 'en' THEN 'WEB_EN' END AS class_id,
  CASE source_label WHEN 'en' THEN 1 WHEN 'de' THEN 2 END AS severity, octet_length(encode(html)) AS file_bytes
FROM labelled WHERE rule_no <> 0""")
def classify_pages(spark, sf_dir):
    return classify_members(page_members(spark, sf_dir), [WEB]).select(
        "image_id", "member_path", "split_source", "source_label", "status", "reason", "class_id", "severity", "file_bytes")


@query("WITH " + PAGE_SQL + " SELECT 'spam_host' AS skip_reason, count(*) AS members FROM rules WHERE rule_no = 0 HAVING count(*) > 0")
def skipped_pages(spark, sf_dir):
    return skipped_members(page_members(spark, sf_dir), PAGE_RULES)


@query("WITH " + PAGE_SQL + """ SELECT page_id, CASE WHEN rule_no >= 0 THEN rule_no END AS ordinal,
  CASE rule_no WHEN 1 THEN 'tracking_copy' END AS exclude FROM rules""")
def match_page_rule_table(spark, sf_dir):
    rules = small_table(spark, [("web", "pages", i, tx.to_java_pattern(r.pattern)[0], r.label, r.exclude, r.skip)
                                for i, r in enumerate(PAGE_RULES)],
                        "dataset_id STRING, archive STRING, ordinal INT, pattern STRING, label STRING, exclude STRING, skip STRING")
    pages = page_members(spark, sf_dir).withColumn("dataset_id", F.lit("web")).withColumnRenamed("crc", "page_id")
    return match_rule_table(pages, rules, "page_id").select("page_id", "rule.ordinal", "rule.exclude")


@query("WITH " + PAGE_SQL + """ SELECT page_id, CASE WHEN rule_no >= 0 THEN rule_no END AS ordinal,
  CASE rule_no WHEN 1 THEN 'tracking_copy' END AS exclude, true AS few_tries FROM rules""")
def match_page_rules_indexed(spark, sf_dir):
    """The page rules behind 2,000 others that no page meets: no page tries more patterns than there are page rules."""
    others = [(None, PathRule(f"/shelf-{i:04d}/(?P<label>[^/]+)/")) for i in range(2000)]
    pages = match_indexed(page_members(spark, sf_dir), [*others, *[(None, r) for r in PAGE_RULES]])
    number = F.col("rule_no") - len(others)
    return pages.select(F.col("crc").alias("page_id"), F.when(number >= 0, number).alias("ordinal"), F.col("rule_exclude").alias("exclude"),
                        (F.col("rule_tries") <= len(PAGE_RULES)).alias("few_tries"))


@query(r"""SELECT p_partkey, regexp_replace(trim(regexp_replace(lower(p_name || '(' || p_type || ')_Test_valid'),
  '[^0-9a-z]+', '_', 'g'), '_'), '(_valid|_test)+$', '') AS label FROM part""")
def normalise_labels(spark, sf_dir):
    raw = F.concat("p_name", F.lit("("), "p_type", F.lit(")_Test_valid"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.normalise_label(raw, ["_valid", "_test"]).alias("label"))


@query(r"""SELECT CASE WHEN ext = '' THEN '<none>' ELSE ext END AS ext, count(*) AS pages,
  coalesce(sum(CASE WHEN ext IN ('.jpg','.jpeg','.png','.bmp','.webp','.tif','.tiff') THEN 1 ELSE 0 END), 0)::BIGINT AS images
FROM (SELECT lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/.][^/]*(\.[^./]*)$', 1)) AS ext FROM pages) GROUP BY 1""")
def page_extensions(spark, sf_dir):
    path = F.regexp_replace("url", "[?#].*$", "")
    ext = F.coalesce(F.nullif(tx.extension(path), F.lit("")), F.lit("<none>"))
    return table(spark, sf_dir, "pages").groupBy(ext.alias("ext")).agg(
        F.count("*").alias("pages"), F.count_if(tx.is_image_path(path)).alias("images"))


@query(r"""SELECT page_id, string_split(p, '!/')[1] AS outer_path,
  CASE WHEN contains(p, '!/') THEN substr(p, strpos(p, '!/') + 2) END AS inner_path
FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '/(en|fr|de)/', '.zip!/\1/') AS p FROM pages)""")
def nested_paths(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "/(en|fr|de)/", ".zip!/$1/")
    return table(spark, sf_dir, "pages").select(
        "page_id", tx.outer_path(path).alias("outer_path"), tx.inner_path(path).alias("inner_path"))


@query("""SELECT page_id, substr(sha1('web|pages|' || url), 1, 16) AS image_id,
  'pages|' || url || '|' || page_id || '|' || octet_length(encode(html)) AS cache_key, sha256(html) AS sha256 FROM pages""")
def ids_and_hashes(spark, sf_dir):
    size = F.octet_length("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", tx.stable_id(F.lit("web"), F.lit("pages"), F.col("url")).alias("image_id"),
        tx.cache_key(F.lit("pages"), F.col("url"), F.col("page_id"), size).alias("cache_key"),
        tx.content_hash(F.col("html")).alias("sha256"))


@query("WITH " + STAGED_SQL + """
SELECT image_id, coalesce(class_id, dataset_id || ':' || source_label) AS identity, coalesce(class_id, '(none)') AS shown_class,
  coalesce(class_id, 'hold:' || source_label) AS plot_label,
  substr(replace(dataset_id || '_' || crop, '_', ' '), 1, 18) || ' · ' || source_label AS caption,
  starts_with(coalesce(reason, ''), 'review:') AS reviewed FROM staged""")
def label_columns(spark, sf_dir):
    c = F.col
    return staged(spark, sf_dir).select(
        "image_id", tx.label_identity(c("class_id"), c("dataset_id"), c("source_label")).alias("identity"),
        tx.class_or_none(c("class_id")).alias("shown_class"), tx.class_or_hold(c("class_id"), c("source_label")).alias("plot_label"),
        tx.group_caption(F.concat_ws("_", "dataset_id", "crop"), c("source_label")).alias("caption"),
        tx.is_reviewed(c("reason")).alias("reviewed"))


@query("WITH " + ITEMS_SQL + """ SELECT dataset_id, source_label, min(class_id) AS group_class FROM items GROUP BY 1, 2""")
def class_per_group(spark, sf_dir):
    return items(spark, sf_dir).groupBy("dataset_id", "source_label").agg(F.min("class_id").alias("group_class"))


@query("WITH " + FINGERPRINTS_SQL + " SELECT doc_id, phash64, lower(printf('%016x', phash64)) AS phash FROM fps")
def text_fingerprint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fp.text_fingerprints(docs, "doc_id", "text").withColumn("phash", fp.to_hex(F.col("phash64")))


@query("""SELECT bit_count(xor(l_orderkey, l_partkey))::INTEGER AS distance, count(*) AS n FROM lineitem GROUP BY 1""")
def hamming_histogram(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(
        fp.hamming(F.col("l_orderkey"), F.col("l_partkey")).alias("distance")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '\.html|/$') THEN 415 WHEN octet_length(encode(html)) * 4096 > 10485760 THEN 413
  WHEN NOT contains(html, '</html>') THEN 422 END AS error_code FROM pages""")
def input_errors(spark, sf_dir):
    kind = F.when(F.col("url").rlike(r"\.html|/$"), "image/png").otherwise("text/plain")
    size = F.octet_length("html") * 4096
    return table(spark, sf_dir, "pages").select(
        "page_id", input_error(kind, size, F.contains("html", F.lit("</html>"))).alias("error_code"))


@query("WITH " + ITEMS_SQL + """, g AS (SELECT image_id, width AS w, height AS h, least(1.0::DOUBLE, 224.0::DOUBLE / width, 224.0::DOUBLE / height) AS s FROM items),
b AS (SELECT image_id, greatest(1, floor(w * s + 0.5))::INTEGER AS box_width, greatest(1, floor(h * s + 0.5))::INTEGER AS box_height FROM g)
SELECT image_id, box_width, box_height, ((224 - box_width) // 2)::INTEGER AS offset_x, ((224 - box_height) // 2)::INTEGER AS offset_y FROM b""")
def letterbox_geometry(spark, sf_dir):
    from sievework.functions.geometry import letterbox_columns
    return letterbox_columns(items(spark, sf_dir).select("image_id", "width", "height")).drop("width", "height")
