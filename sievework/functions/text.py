"""Scalar column functions on identifiers, labels, paths and text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image file extensions that count as items.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff"]
NESTED_MARK = "!/"
REVIEW_PREFIX = "review:"
NO_CLASS = "(none)"


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of SHA-1 over the parts joined by '|'; the same on every run."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def cache_key(archive: Column, path: Column, crc: Column, size: Column) -> Column:
    return F.concat_ws("|", archive, path, crc.cast("string"), size.cast("string"))


def normalise_label(raw: Column, suffixes: Sequence[str] = ()) -> Column:
    """Lower-case, other characters to single underscores, then configured suffixes removed while any is left."""
    label = F.regexp_replace(F.lower(raw), "[^0-9a-z]+", "_")
    label = F.regexp_replace(label, "^_+|_+$", "")
    suffixes = [s for s in suffixes if s]
    if not suffixes:
        return label
    nested = any(a != b and a.endswith(b) for a in suffixes for b in suffixes)
    if not nested:
        # no suffix ends another one, so the run of suffixes is read off the end in one way only
        alternatives = "|".join(re.escape(s) for s in suffixes)
        return F.regexp_replace(label, f"(?<=.)(?:{alternatives})+$", "")

    def strip_once(value: Column, _step: Column) -> Column:
        for suffix in suffixes:
            fits = value.endswith(suffix) & (F.length(value) > len(suffix))
            shorter = F.substring(value, F.lit(1), F.length(value) - len(suffix))
            value = F.when(fits, shorter).otherwise(value)
        return value

    # a label has at most as many suffixes as characters
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(label), F.lit(1))), label, strip_once)


def extension(path: Column) -> Column:
    """Lower-case extension of the last path segment with its dot, '' when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))


def is_image_path(path: Column) -> Column:
    return extension(path).isin(IMAGE_EXTENSIONS)


def outer_path(path: Column) -> Column:
    return F.split(path, NESTED_MARK, 2)[0]


def inner_path(path: Column) -> Column:
    """Path inside a nested archive, NULL for a plain member."""
    return F.when(path.contains(NESTED_MARK), F.split(path, NESTED_MARK, 2)[1])


def to_java_pattern(pattern: str) -> tuple[str, dict[str, int]]:
    """A rule pattern with its named groups made plain, and the index of each name."""
    index = dict(re.compile(pattern).groupindex)
    plain = re.sub(r"\(\?P<\w+>", "(", pattern)
    return re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{index[m.group(1)]}", plain), index


def label_identity(class_id: Column, dataset_id: Column, source_label: Column) -> Column:
    """The class of a row; a row without one stands for its own source and label."""
    return F.coalesce(class_id, F.concat_ws(":", dataset_id, F.coalesce(source_label, F.lit(""))))


def is_reviewed(reason: Column) -> Column:
    return F.coalesce(reason, F.lit("")).startswith(REVIEW_PREFIX)


def class_or_none(class_id: Column) -> Column:
    return F.coalesce(class_id, F.lit(NO_CLASS))


def class_or_hold(class_id: Column, source_label: Column) -> Column:
    return F.coalesce(class_id, F.concat(F.lit("hold:"), source_label))


def group_caption(dataset_id: Column, source_label: Column) -> Column:
    return F.concat(F.substring(F.replace(dataset_id, F.lit("_"), F.lit(" ")), 1, 18), F.lit(" · "), source_label)


def words(text: Column) -> Column:
    """Lower-case whitespace tokens, without the empty one."""
    # white space made plain blanks first: splitting at one fixed character needs no regular expression
    blanks = F.translate(F.lower(text), "\t\n\x0b\f\r", "     ")
    return F.array_remove(F.split(blanks, " "), "")


def tokens(text: Column) -> Column:
    """Distinct words."""
    return F.array_distinct(words(text))
