"""Schemas and fixed values of the catalogue."""

from __future__ import annotations

# Limits and versions that results depend on.
WINDOW_MS = 4000
WINDOW_FLOOR_MS = 500
CANDIDATE_LIMIT, CANDIDATE_SHARE = 2000, 0.80
DEFAULT_THRESHOLD, MAX_THRESHOLD = 14, 64
HASH_BITS, HASH_VERSION, THUMBNAIL_VERSION = 64, 2, 2
MAX_RATING, PAGE_LIMIT, DEFAULT_PAGE = 5, 200, 80
DISPLAY_EDGES, DEFAULT_EDGE = (768, 1024, 1280, 1536, 1920), 1024
#: Default and greatest size of a group on large and on small screens.
MIN_GROUP, LARGE_GROUPS, SMALL_GROUPS = 2, (10, 10), (4, 9)
ERRORS_SHOWN = 20
EXTENSIONS = ("jpg", "jpeg", "png", "webp")
SOURCES = ("exif_original", "exif_datetime", "filename_inferred", "filesystem_mtime", "unknown")
WEAK_SOURCES = ("filesystem_mtime", "unknown")

#: Schemas as text, so that they need no session.
PHOTO = (
    "id string, project_id string, path string, relative_path string, name string, captured_at bigint, timestamp_source string, "
    "d_hash string, d_hash_version int, rating int, fingerprint_mtime bigint, fingerprint_size bigint, is_missing boolean, "
    "thumbnail_path string, thumbnail_mtime bigint, thumbnail_size bigint, thumbnail_source string, thumbnail_version int, "
    "display_path string, display_edge int, analysis_error string, analysis_error_at bigint"
)
PROJECT = (
    "id string, name string, folder_path string, photo_count bigint, status string, created_at bigint, updated_at bigint, "
    "burst_threshold int, burst_threshold_learned_at bigint, display_edge int"
)
OVERRIDE = "project_id string, left_id string, right_id string, joined boolean, updated_at bigint"
RATING_EVENT = "project_id string, photo_id string, seq bigint, op string, rating int"
STATE = "project_id string, state_json string, updated_at bigint"
SETTING = "key string, value string, updated_at bigint"
SESSION = (
    "projectId string, settings struct<groupSize:int,groupBursts:boolean>, candidates array<string>, groups array<array<string>>, groupIndex int, "
    "selectedInGroup array<string>, multiSelect boolean, ratings map<string,int>, survivors array<string>, history array<struct<groupIndex:int,chosen:array<string>>>, "
    "targetRating int, burstMembers map<string,array<string>>, burstSettled array<string>, round int, stage string, updatedAt bigint, seed bigint"
)
