"""Paper ids: spellings brought to a base id and a version, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two shapes of a base id (new style, old style) and what may stand around one.
NEW_STYLE = r"\d{4}\.\d{4,5}"
OLD_STYLE = r"[a-z]+(?:-[a-z]+)*(?:\.[a-z]{2})?/\d{7}"
RAW_ID = rf"(?i)^(?:(?:https?://)?[a-z0-9.-]+/(?:abs|pdf)/|arxiv:\s*)?({NEW_STYLE}|{OLD_STYLE})(?:v(\d+))?(?:\.pdf)?$"


def _bare(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")


def base_id(raw: Column) -> Column:
    """The base id of a spelling; null where it names no paper. Case: the archive lower, its subject class upper."""
    found = F.nullif(F.regexp_extract(_bare(raw), RAW_ID, 1), F.lit(""))
    archive, rest = F.substring_index(found, "/", 1), F.substring_index(found, "/", -1)
    head = F.lower(F.substring_index(archive, ".", 1))
    tail = F.when(F.contains(archive, F.lit(".")), F.concat(F.lit("."), F.upper(F.substring_index(archive, ".", -1)))).otherwise("")
    return F.when(F.contains(found, F.lit("/")), F.concat(head, tail, F.lit("/"), rest)).otherwise(found)


def version(raw: Column) -> Column:
    """The version of a spelling as BIGINT; null where it has none or names no paper."""
    return F.regexp_extract(_bare(raw), RAW_ID, 2).try_cast("bigint")


def base_id_strict(raw: Column) -> Column:
    """base_id, but a spelling that names no paper fails the query."""
    return F.when(raw.isNull(), F.lit(None)).otherwise(F.coalesce(base_id(raw), F.raise_error(F.concat(F.lit("not a paper id: "), raw))))


def base_id_lenient(raw: Column) -> Column:
    """base_id, but a spelling that names no paper is its own base id (outer space trimmed), without a version."""
    return F.coalesce(base_id(raw), _bare(raw))


#: The same in DuckDB's SQL, for checks.
def base_id_sql(raw: str) -> str:
    x = f"regexp_extract(trim({raw}, E' \\t\\n\\r'), '{RAW_ID}', 1)"
    head = f"lower(split_part(split_part({x}, '/', 1), '.', 1))"
    tail = f"CASE WHEN contains(split_part({x}, '/', 1), '.') THEN '.' || upper(split_part(split_part({x}, '/', 1), '.', 2)) ELSE '' END"
    return f"CASE WHEN contains({x}, '/') THEN {head} || {tail} || '/' || split_part({x}, '/', 2) ELSE nullif({x}, '') END"


def version_sql(raw: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(trim({raw}, E' \\t\\n\\r'), '{RAW_ID}', 2), '') AS BIGINT)"
