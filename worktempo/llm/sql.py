"""The same results as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

QUALITY_RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), windows AS (
  SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)
), twice AS (
  SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, win) > 1
), repeated AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid
), m AS (
  SELECT rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
  FROM w LEFT JOIN repeated r USING (rid)
), rates AS (
  SELECT rid, lang, source, unnest([
    {'rate': 'symbol_rate', 'slack': 200, 'v': 1000 * n_symbols // greatest(n_words, 1)},
    {'rate': 'dup_rate', 'slack': 400, 'v': 1000 * n_dup_lines // greatest(n_lines, 1)},
    {'rate': 'repeat_rate', 'slack': 200, 'v': 1000 * n_repeat_words // greatest(n_words, 1)},
    {'rate': 'word_length', 'slack': 200, 'v': 100 * word_chars // greatest(n_words, 1)}], recursive := true)
  FROM m
), e AS (
  SELECT *, CASE WHEN v < 32 THEN 0 ELSE length(bin(v)) - 5 END AS shift FROM rates
), tops AS (
  SELECT *, CASE WHEN v < 32 THEN v ELSE ((v >> shift) + 1 << shift) - 1 END AS top FROM e
), keys AS (
  SELECT DISTINCT lang, source, rate, slack FROM tops
), leveled AS (
  SELECT 1 AS level, k.lang, k.source, k.rate, k.slack, t.top FROM keys k JOIN tops t
    ON k.lang IS NOT DISTINCT FROM t.lang AND k.source IS NOT DISTINCT FROM t.source AND k.rate = t.rate
  UNION ALL
  SELECT 2, k.lang, k.source, k.rate, k.slack, t.top FROM keys k JOIN tops t
    ON k.lang IS NOT DISTINCT FROM t.lang AND k.rate = t.rate
  UNION ALL
  SELECT 3, k.lang, k.source, k.rate, k.slack, t.top FROM keys k JOIN tops t ON k.rate = t.rate
), quartiles AS (
  SELECT level, lang, source, rate, slack, count(*) AS n, quantile_disc(top, 0.25) AS q1, quantile_disc(top, 0.75) AS q3
  FROM leveled GROUP BY ALL
), picked AS (
  SELECT * FROM quartiles WHERE n >= 50 OR level = 3
  QUALIFY row_number() OVER (PARTITION BY lang, source, rate ORDER BY level) = 1
), bad AS (
  SELECT t.rid, bool_or(t.v > q3 + 3 * (q3 - q1) + p.slack
      OR t.rate = 'word_length' AND t.v < q1 - 3 * (q3 - q1) - p.slack) AS out
  FROM tops t JOIN picked p ON t.lang IS NOT DISTINCT FROM p.lang AND t.source IS NOT DISTINCT FROM p.source
    AND t.rate = p.rate
  GROUP BY t.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT out AS kept
FROM m JOIN bad USING (rid)
"""

#: crc32 as lambdas over bytes: the table of its 256 remainders, made by the rule.
CRC_TABLE = """tab AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""
CRC = "xor(list_reduce([4294967295] || {bytes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

SPELLING = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS raw FROM documents),
small AS (
    SELECT doc, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
    FROM runs GROUP BY ALL),
hashed AS (
    SELECT run, k, {CRC.format(bytes='''flatten(list_transform(string_split(doc || ':' || run, ''),
        lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 + ord(x) // 64, 128 + ord(x) % 64] END))''')} AS h
    FROM small, tab),
words AS (
    SELECT word, CAST(sum(k) AS BIGINT) AS n
    FROM (SELECT k, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
          FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
holes AS (
    SELECT word, n, pos, left(word, pos - 1) || substr(word, pos + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM words)),
pairs AS (
    SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
tops AS (
    SELECT word, count(*) AS n_near, max(n) AS most, first(other ORDER BY n DESC, other) AS best FROM pairs GROUP BY word),
known AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN best END AS form,
           CASE WHEN most >= 10 * n THEN most END AS form_n
    FROM words LEFT JOIN tops USING (word)),
up AS (
    SELECT word, form AS root FROM known WHERE form IS NOT NULL
    UNION ALL SELECT up.word, k.form FROM up JOIN known k ON k.word = up.root WHERE k.form IS NOT NULL),
ends AS (SELECT up.word, up.root FROM up JOIN known k ON k.word = up.root WHERE k.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM known LEFT JOIN ends USING (word)
"""

#: One step of the search over edits: states 0 to 3 as (cost, audit), inserts first, then the row.
BLANK = r"[\x20\x09-\x0D]"


def moved(source: str, cost: str, letters: str) -> str:
    return f"CASE WHEN {source} IS NOT NULL THEN {{'c': {source}.c + {cost}, 'a': {source}.a || '{letters}'}} END"


def kept(source: str, initial: str) -> str:
    return f"CASE WHEN NOT gone AND initial = '{initial}' THEN {moved(source, 'more', 'K')} END"


def changed(source: str) -> str:
    return f"CASE WHEN NOT gone THEN {moved(source, '3 + more', 'R')} END"


REPAIR = rf"""
WITH RECURSIVE {CRC_TABLE},
faulty AS (
    SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {CRC.format(bytes='''list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':'
               || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ord(x)::BIGINT)''')} % 20 AS fault
    FROM conversations, tab),
damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS again
    FROM faulty WHERE fault <> 0),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 256),
                                 sha256(role || chr(10) || text), again) AS pos FROM damaged),
faults AS (
    SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen,
           coalesce(regexp_extract(text, '([^\x20\x09-\x0D]){BLANK}*$', 1), '') NOT IN ('.', '!', '?') AS cut,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair
    FROM ranked),
each AS (
    SELECT conv_id, pos, left(role, 1) AS initial, is_blank OR seen AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS more FROM faults),
ids AS (SELECT DISTINCT conv_id FROM conversations),
searched AS (
    SELECT conv_id, 0 AS pos, {{'c': 0, 'a': ''}} AS s0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) AS s1,
           CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) AS s2, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) AS s3 FROM ids
    UNION ALL
    SELECT conv_id, pos + 1,
           list_min([{moved('p0', '4', 'D')}]),
           list_min([{moved('p1', '4', 'D')}, {kept('p0', 's')}]),
           list_min([{moved('p2', '4', 'D')}, {kept('p0', 'u')}, {kept('p1', 'u')}, {kept('p3', 'u')},
                     {changed('p0')}, {changed('p1')}, {changed('p3')}]),
           list_min([{moved('p3', '4', 'D')}, {kept('p2', 'a')}, {changed('p2')}])
    FROM (
        SELECT s.conv_id, s.pos, e.initial, e.gone, e.more, s0 AS p0, s1 AS p1,
               list_min([s2, {moved('s0', '3', 'I')}, {moved('s1', '3', 'I')}, {moved('s3', '3', 'I')}]) AS p2,
               list_min([s3, {moved('s2', '3', 'I')}, {moved('s0', '6', 'II')}, {moved('s1', '6', 'II')}]) AS p3
        FROM searched s JOIN each e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.pos = s.pos + 1)),
ended AS (
    SELECT conv_id, list_min([s0, s3, {moved('s2', '3', 'I')}, {moved('s1', '6', 'II')}, {moved('s0', '6', 'II')}]) AS best
    FROM searched QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
edits AS (
    SELECT conv_id, k, substr(best.a, k, 1) AS edit, k - (length(left(best.a, k)) - length(replace(left(best.a, k), 'I', ''))) AS pos,
           k - (length(left(best.a, k)) - length(replace(left(best.a, k), 'D', ''))) AS place
    FROM (SELECT conv_id, best, unnest(range(1, length(best.a) + 1)) AS k FROM ended)),
told AS (
    SELECT e.conv_id, e.place, e.edit, f.role, coalesce(CASE WHEN e.edit <> 'I' THEN f.text END, '') AS text,
           max(CASE WHEN e.place = 1 AND e.edit = 'K' AND f.role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS shift
    FROM edits e LEFT JOIN ranked f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.pos = e.pos AND e.edit <> 'I'
    WHERE e.edit <> 'D'),
written AS (
    SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                      || ':' || text, chr(10) ORDER BY place)) AS digest FROM told GROUP BY conv_id),
figures AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(is_blank) AS blank,
           count_if(seen AND NOT is_blank) AS duplicate, count_if(cut AND NOT seen AND NOT is_blank) AS truncated,
           count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(e.best.c AS BIGINT) AS cost, e.best.a AS audit,
       coalesce(w.digest, sha256('')) AS repaired_sha256
FROM ids i JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM i.conv_id
"""

CHAT = r"""
WITH rows_ AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
    SELECT *, role = 'assistant' AS own, length(replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C'), '[', '%5B'))
           + 1 + length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) AS chars
    FROM rows_)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (own), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (own), '')) AS loss_sha256,
       CAST(sum(chars + CASE WHEN own THEN length('<s></s>') ELSE length('[INST][/INST]') END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

ORACLE: dict[str, str] = {
    "op10_quality_rules": QUALITY_RULES, "op11_spelling_variants": SPELLING, "op12_conversation_repair": REPAIR,
    "op13_chat_format": CHAT,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
