"""SQL counterparts, where SQL can express the operator."""

SQL: dict[str, str] = {}

_CLASS = """
SELECT '{src}' AS src, row_key, CASE
  WHEN list_max(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(t, '([.!?;:])[ \\t\\r]', '\\1' || chr(1), 'g'), '\\n', chr(1), 'g'), chr(1)), lambda x: length(x))) <= 2000 THEN 'sentence'
  WHEN list_max(list_transform(regexp_split_to_array(t, '[ \\t\\r\\n]'), lambda x: length(x))) <= 2000 THEN 'word'
  ELSE 'char' END AS cut_class
FROM (SELECT DISTINCT {key} AS row_key, text AS t FROM {src} WHERE length(text) > 2000 AND {key} IS NOT NULL)
"""
SQL["p6_found"] = _CLASS.format(src="legal_nodes", key="node_key") + " UNION ALL " + _CLASS.format(src="legal_chunks", key="chunk_key")

_BLANK = "[\\s\\x{00a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}]+"
SQL["p7_found"] = f"""
WITH m AS (
  SELECT DISTINCT ON (conversation_id, message_id) conversation_id, message_id, created_at,
    lower(regexp_replace(coalesce(role, ''), '{_BLANK}', '', 'g')) AS r,
    regexp_replace(coalesce(content, ''), '^{_BLANK}|{_BLANK}$', '', 'g') AS said
  FROM messages WHERE conversation_id IS NOT NULL),
w AS (SELECT *, CASE WHEN r IN ('user','usuario','usuário','human','humano','cliente') THEN 'u'
  WHEN r IN ('assistant','assistente','ai','ia','bot') THEN 'a' WHEN r IN ('system','sistema') THEN 's' ELSE '?' END AS who FROM m),
n AS (SELECT *, row_number() OVER o AS k, lag(who) OVER o AS bwho, lag(said) OVER o AS bsaid
  FROM w WHERE who <> 's' WINDOW o AS (PARTITION BY conversation_id ORDER BY created_at NULLS FIRST, message_id)),
d AS (SELECT * FROM n WHERE NOT (k > 1 AND who = bwho AND said = bsaid)),
g AS (SELECT *, count(*) FILTER (who = 'u') OVER (PARTITION BY conversation_id ORDER BY k) AS turn FROM d),
t AS (SELECT conversation_id, turn, bool_or(who = 'a' AND said <> '') AS replied FROM g WHERE turn > 0 GROUP BY ALL),
c AS (SELECT conversation_id, bool_or(said <> '') AS content, bool_or(who = '?' OR created_at IS NULL) OR arg_min(who, k) <> 'u' AS broken FROM n GROUP BY 1),
x AS (SELECT a.conversation_id, CASE WHEN NOT coalesce(c.content, false) THEN 'empty' WHEN c.broken THEN 'broken'
  WHEN EXISTS (SELECT 1 FROM t WHERE t.conversation_id = a.conversation_id AND NOT replied) THEN 'no_reply' END AS defect
  FROM (SELECT DISTINCT conversation_id FROM w) a LEFT JOIN c USING (conversation_id))
SELECT conversation_id, defect FROM x WHERE defect IS NOT NULL
"""
