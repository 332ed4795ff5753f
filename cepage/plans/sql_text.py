"""SQL fragments for DuckDB that mirror the canonical forms, for the oracles."""

from __future__ import annotations

BLANKS = "chr(32)||chr(9)||chr(10)||chr(13)"


def folded(c: str) -> str:
    return f"nullif(lower(trim({c}, {BLANKS})), '')"


def uuid(c: str) -> str:
    t = folded(c)
    h = f"trim(replace(translate({t}, '{{}}()-', ''), 'urn:uuid:', ''), {BLANKS})"
    canonical = "||'-'||".join(f"substr({h},{a},{n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"CASE WHEN regexp_full_match({h}, '[0-9a-f]{{32}}') THEN {canonical} WHEN {h} <> '' THEN {t} END"


def uuid5(namespace: str, name: str) -> str:
    h = f"sha1(from_hex('{namespace.replace('-', '')}') || encode({name}))"
    variant = f"substr('89ab', CAST(concat('0x', substr({h}, 17, 1)) AS INT) % 4 + 1, 1)"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


def hash64(c: str) -> str:
    t = f"regexp_replace({folded(c)}, '^0x', '')"
    return f"CASE WHEN regexp_full_match({t}, '0*[0-9a-f]{{1,16}}') THEN CAST(concat('0x', right(repeat('0', 16) || {t}, 16)) AS UBIGINT) END"


def digest(c: str) -> str:
    t = f"regexp_replace({folded(c)}, '^(sha256:|0x)', '')"
    return f"CASE WHEN regexp_full_match({t}, '[0-9a-f]{{64}}') THEN {t} END"


def split(c: str) -> str:
    t = folded(c)
    return f"CASE WHEN {t} IN ('train', 'training') THEN 'train' WHEN {t} IN ('validation', 'valid', 'val', 'dev') THEN 'validation' WHEN {t} IN ('test', 'testing') THEN 'test' END"


def label(c: str) -> str:
    return folded(f"regexp_replace(translate({c}, '_-', '  '), '\\s+', ' ', 'g')")


IMAGES = f"""images AS (SELECT source_row, {uuid('image_id')} AS image_id, {uuid('original_id')} AS original_id, {uuid('group_id')} AS group_id,
  {label('class_name')} AS class_name, class_id, {digest('sha256')} AS digest, {split('split')} AS split, {hash64('dhash')} AS dh, {hash64('perceptual_hash')} AS ph,
  width, height, colour_mode, image_format, validation_errors, {folded('validation_status')} AS status, source_dataset, relative_path, filename, file_size_bytes,
  is_original, ingested_at FROM image_record)"""

PREDICTIONS = f"""pred AS (SELECT * EXCLUDE (rn, image_id), iid AS image_id FROM (SELECT *, {uuid('image_id')} AS iid,
  row_number() OVER (PARTITION BY experiment_id, {uuid('image_id')} ORDER BY ingested_at) AS rn FROM predictions_test) WHERE rn = 1 AND iid IS NOT NULL)"""
