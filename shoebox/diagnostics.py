"""Findings as rows: (severity, rule_id, code, paths), paths sorted, distinct and at most eight."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_PATHS = 8
SCHEMA = "severity string, rule_id string, code string, paths array<string>"

# The vocabulary of rules and codes that plan documents use.
REGULAR_MEDIA = "FS_REGULAR_MEDIA_V1"
SIDECAR_EXACT_NAME = "META_SIDECAR_EXACT_NAME_V1"
SIDECAR_BASENAME = "META_SIDECAR_BASENAME_V1"
TAKEOUT_TITLE = "META_GOOGLE_TAKEOUT_TITLE_V1"
TAKEOUT_SUPPLEMENTAL = "META_GOOGLE_TAKEOUT_SUPPLEMENTAL_V1"
TAKEOUT_ALBUM = "META_GOOGLE_TAKEOUT_ALBUM_V1"
TAKEOUT_ALIAS = "META_GOOGLE_TAKEOUT_CONTENT_ALIAS_V1"
LIVE_PHOTO = "PAIR_LIVE_PHOTO_BASENAME_V1"
APPLE_FOLDER_ALBUM = "META_APPLE_FOLDER_ALBUM_V1"
PICASA_CAPTION = "META_PICASA_CAPTION_V1"
PICASA_ALBUM = "META_PICASA_ALBUM_V1"
PICASA_FOLDER_ALBUM = "META_PICASA_FOLDER_ALBUM_V1"
PICASA_FILENAME_DATE = "META_PICASA_FILENAME_DATE_V1"
#: code -> (severity, rule_id)
CODES = {
    "native_paths_share_nfc_path": ("error", "FS_UNICODE_COLLISION_V1"),
    "portable_case_collision": ("error", "FS_CASE_COLLISION_V1"),
    "duplicate_basename_across_directories": ("warning", "FS_DUPLICATE_BASENAME_V1"),
    "symlink_not_followed": ("warning", "FS_SYMLINK_SKIPPED_V1"),
    "special_file_not_read": ("warning", "FS_SPECIAL_FILE_SKIPPED_V1"),
    "non_unicode_path": ("error", "FS_NON_UNICODE_PATH_V1"),
    "portable_path_too_long": ("error", "FS_PATH_LIMIT_EXCEEDED_V1"),
    "unreadable_directory": ("error", "FS_UNREADABLE_FILE_V1"),
    "unreadable_metadata": ("error", "FS_UNREADABLE_FILE_V1"),
    "unreadable_source_file": ("error", "FS_UNREADABLE_FILE_V1"),
    "source_changed_during_scan": ("error", "FS_SOURCE_CHANGED_V1"),
    "known_apple_export_noise": ("warning", "APPLE_EXPORT_NOISE_SKIPPED_V1"),
    "sidecar_without_media": ("warning", "META_ORPHAN_SIDECAR_V1"),
    "ambiguous_sidecar_match": ("error", "META_AMBIGUOUS_SIDECAR_V1"),
    "takeout_title_without_media": ("warning", "META_ORPHAN_SIDECAR_V1"),
    "takeout_metadata_without_media": ("warning", "META_ORPHAN_SIDECAR_V1"),
    "ambiguous_takeout_title": ("error", "META_GOOGLE_TAKEOUT_AMBIGUOUS_V1"),
    "ambiguous_takeout_metadata": ("error", "META_GOOGLE_TAKEOUT_AMBIGUOUS_V1"),
    "multiple_takeout_sidecars_for_media": ("error", "META_GOOGLE_TAKEOUT_AMBIGUOUS_V1"),
    "takeout_media_without_json": ("warning", "META_GOOGLE_TAKEOUT_UNMATCHED_MEDIA_V1"),
    "unsupported_takeout_metadata_family": ("warning", "META_GOOGLE_TAKEOUT_UNSUPPORTED_V1"),
    "invalid_takeout_json": ("error", "META_GOOGLE_TAKEOUT_JSON_INVALID_V1"),
    "takeout_json_size_limit_exceeded": ("error", "META_GOOGLE_TAKEOUT_JSON_OVERSIZED_V1"),
    "takeout_json_changed_during_scan": ("error", "FS_SOURCE_CHANGED_V1"),
    "conflicting_takeout_asset_metadata": ("error", "META_GOOGLE_TAKEOUT_CONFLICT_V1"),
    "conflicting_takeout_description": ("error", "META_GOOGLE_TAKEOUT_CONFLICT_V1"),
    "conflicting_takeout_timestamp": ("error", "META_GOOGLE_TAKEOUT_CONFLICT_V1"),
    "conflicting_takeout_location": ("error", "META_GOOGLE_TAKEOUT_CONFLICT_V1"),
    "content_identical_takeout_aliases": ("warning", "META_GOOGLE_TAKEOUT_CONTENT_ALIAS_V1"),
    "identical_takeout_archive_entry": ("warning", "ARCHIVE_TAKEOUT_DUPLICATE_IDENTICAL_V1"),
    "conflicting_takeout_archive_entry": ("error", "ARCHIVE_TAKEOUT_PATH_CONFLICT_V1"),
    "identical_archive_entry": ("warning", "ARCHIVE_APPLE_DUPLICATE_IDENTICAL_V1"),
    "conflicting_archive_entry": ("error", "ARCHIVE_APPLE_PATH_CONFLICT_V1"),
    "invalid_picasa_ini": ("error", "META_PICASA_INI_INVALID_V1"),
}
#: Archive codes of the other export kind that shares them.
PICASA_ARCHIVE_RULES = {"identical_archive_entry": "ARCHIVE_PICASA_DUPLICATE_IDENTICAL_V1", "conflicting_archive_entry": "ARCHIVE_PICASA_PATH_CONFLICT_V1"}


def finding(df: DataFrame, code: str, *paths: Column, rule: str | None = None) -> DataFrame:
    """One row for each row of df; paths are string or array columns."""
    severity, known = CODES[code]
    every = F.flatten(F.array(*[p if "array" in df.select(p).dtypes[0][1] else F.array(p) for p in paths]))
    return df.select(F.lit(severity).alias("severity"), F.lit(rule or known).alias("rule_id"), F.lit(code).alias("code"), F.slice(F.array_sort(F.array_distinct(every)), 1, MAX_PATHS).alias("paths"))


def gather(*parts: DataFrame) -> DataFrame:
    """All findings, once each."""
    return reduce(DataFrame.unionByName, parts).distinct()


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def first_paths(rows: DataFrame, *key: str, path: str = "path", n: int = MAX_PATHS) -> DataFrame:
    """W-5: (key..., paths): the n smallest distinct paths of each key. The ranking is cut in every task before its shuffle, so a key that
    a third of all rows share sends n rows a task."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(path))
    return rows.select(*key, path).distinct().withColumn("nth", rank).where(F.col("nth") <= n).groupBy(*key).agg(F.array_sort(F.collect_list(path)).alias("paths"))
