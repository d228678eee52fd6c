"""Column layouts of the tables that pass between jobs. A missing value is NULL."""

MANIFEST = (
    "image_id STRING, dataset_id STRING, crop STRING, archive STRING, member_path STRING, split_source STRING, "
    "source_label STRING, class_id STRING, severity INT, status STRING, reason STRING, duplicate_of STRING, "
    "dup_group STRING, sha256 STRING, phash STRING, width INT, height INT, mode STRING, is_grayscale BOOLEAN, "
    "file_bytes BIGINT, sharpness_256 DOUBLE, brightness DOUBLE, error_detail STRING")
HASHES = (
    "sha256 STRING, phash STRING, width INT, height INT, mode STRING, is_grayscale BOOLEAN, "
    "sharpness_256 DOUBLE, brightness DOUBLE, error STRING")
HASH_CACHE = f"key STRING, hash_version STRING, {HASHES}"
TAXONOMY = (
    "class_id STRING, crop STRING, name_en STRING, name_hi STRING, visible_on_leaf BOOLEAN, in_model BOOLEAN, "
    "status STRING")
SPLITS = "image_id STRING, dataset_id STRING, class_id STRING, split STRING"
FORM = (
    "manifest_version STRING, image_id STRING, dataset_id STRING, crop STRING, source_label STRING, "
    "current_class STRING, verdict STRING, correct_class STRING, notes STRING")
OVERRIDES = (
    "image_id STRING, action STRING, class_id STRING, reason STRING, decided_by STRING, decided_at TIMESTAMP, "
    "status STRING")
MEMBERS = "archive STRING, member_path STRING, crc BIGINT, size BIGINT"
FEATURES = "image_id STRING, features ARRAY<FLOAT>, split STRING, class_id STRING, dataset_id STRING"


def names(layout: str) -> list[str]:
    return [part.split()[0] for part in layout.split(", ")]
