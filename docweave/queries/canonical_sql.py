"""SQL for the equality of extended JSON, on the shapes that the test tables hold."""

from __future__ import annotations


def number(text: str) -> str:
    """One text for each numeric value."""
    return f"'n' || CAST(CAST({text} AS DECIMAL(38, 9)) AS VARCHAR)"


def _at(json: str, key: str) -> str:
    return f"""json_extract_string({json}, '$."{key}"')"""


def canonical_id(json: str) -> str:
    """A text that is equal for equal ``_id``s: scalars, wrapped values, flat objects."""
    member = f"""json_extract_string({json}, '$."' || f || '"')"""
    return f"""CASE json_type({json})
      WHEN 'VARCHAR' THEN 's' || json_extract_string({json}, '$')
      WHEN 'BOOLEAN' THEN 'b' || CAST({json} AS VARCHAR)
      WHEN 'OBJECT' THEN CASE
        WHEN json_keys({json}) = ['$oid'] THEN 'o' || lower({_at(json, "$oid")})
        WHEN json_keys({json}) = ['$numberLong'] THEN {number(_at(json, "$numberLong"))}
        WHEN json_keys({json}) = ['$numberInt'] THEN {number(_at(json, "$numberInt"))}
        WHEN json_keys({json}) = ['$date'] THEN 't' || CASE json_type({json}, '$."$date"')
          WHEN 'VARCHAR' THEN epoch_ms(CAST({_at(json, "$date")} AS TIMESTAMPTZ))
          WHEN 'OBJECT' THEN CAST(json_extract_string({json}, '$."$date"."$numberLong"') AS BIGINT)
          ELSE CAST({_at(json, "$date")} AS BIGINT) END
        ELSE 'x' || array_to_string(list_transform(json_keys({json}), lambda f: f || '=' ||
          CASE json_type({json}, '$."' || f || '"') WHEN 'VARCHAR' THEN 's' || {member} ELSE {number(member)} END), ';') END
      ELSE {number(f"CAST({json} AS VARCHAR)")} END"""


def leaf(t: str = "t") -> str:
    """A text for a node of ``json_tree``, equal for equal values; containers by their kind."""
    value, full = f"json_extract_string({t}.value, '$')", f"{t}.fullkey"
    return f"""CASE
          WHEN {full} LIKE '%."$oid"' THEN 'o' || lower({value})
          WHEN {full} LIKE '%."$date"%' THEN 't' || CASE WHEN {t}.type = 'VARCHAR' AND {full} LIKE '%."$date"'
            THEN epoch_ms(CAST({value} AS TIMESTAMPTZ)) ELSE CAST({value} AS BIGINT) END
          WHEN {full} LIKE '%."$number%' OR {t}.type IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN {number(value)}
          WHEN {t}.type = 'VARCHAR' THEN 's' || {value}
          WHEN {t}.type IN ('ARRAY', 'OBJECT') THEN {t}.type
          ELSE {t}.type || coalesce(CAST({t}.value AS VARCHAR), '') END"""


def field_texts(table: str, row: str) -> str:
    """``r, field, c``: a text for each top-level field of ``v``, from its leaves in order."""
    return f"""SELECT {row} AS r, field, string_agg(place || '=' || leaf, ';' ORDER BY id) AS c FROM (
      SELECT d.{row}, t.id,
        regexp_extract(t.fullkey, '^\\$\\.([^.\\[]+)', 1) AS field,
        regexp_replace(t.fullkey, '\\."\\$[a-zA-Z]+"', '', 'g') AS place,
        {leaf()} AS leaf
      FROM {table} d, json_tree(CAST(d.v AS JSON)) t
      WHERE t.fullkey <> '$' AND NOT (t.type = 'OBJECT' AND coalesce(starts_with(json_keys(t.value)[1], '$'), false))
    ) GROUP BY ALL"""
