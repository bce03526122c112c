"""SQL counterparts of the registered text queries, where SQL can express them.

Left out, and tested against brute force or held-out rows instead: near-duplicate
classes, language identification, packing and token ids (trained or tokenised
values), and personal data and secrets (match places, which SQL has no function for).
"""

from __future__ import annotations

from ebbline.llm.license_scan import COPYRIGHT_LINE, NOTICES, SPELLINGS, TEXTS
from ebbline.llm.quality_rules import RULES, STOP_WORDS

SPACE = r"[\x20\x09-\x0D]+"

TOP_K = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.r <> q.r AND len(q.e) = len(c.e)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 20
"""

_WORDS = f"""
cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS ws FROM documents
), t AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS p, len(ws) AS n FROM cut
)"""

SUBSTRING_DEDUP = f"""
WITH {_WORDS}, win AS (
  SELECT *, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h
  FROM t
), earliest AS (
  SELECT h, min(doc_id) AS m FROM win WHERE p <= n - 50 GROUP BY h
), hit AS (
  SELECT win.doc_id, win.p, win.n, win.word,
    CASE WHEN win.p <= win.n - 50 AND earliest.m < win.doc_id THEN 1 ELSE 0 END AS starts
  FROM win LEFT JOIN earliest USING (h)
), judged AS (
  SELECT doc_id, p, word,
    max(starts) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS removed
  FROM hit
), kept AS (
  SELECT doc_id, count(*) AS n_words, sum(removed) AS n_removed,
    string_agg(word, ' ' ORDER BY p) FILTER (WHERE removed = 0) AS text
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""


def _bounds() -> str:
    terms = []
    for rule in RULES:
        per = rule.per or "1"
        if rule.low is not None:
            terms.append(f"{rule.measure} * {rule.scale} >= {per} * {rule.low}")
        if rule.high is not None:
            terms.append(f"{rule.measure} * {rule.scale} <= {per} * {rule.high}")
    return " AND ".join(terms)


def quality_rules() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys([*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]))
    return f"""
WITH {_WORDS}, win AS (
  SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g
  FROM t
), twice AS (
  SELECT *, CASE WHEN p <= n - 8 AND count(*) OVER (PARTITION BY doc_id, g, p <= n - 8) > 1 THEN 1 ELSE 0 END AS starts
  FROM win
), covered AS (
  SELECT doc_id, word, max(starts) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c
  FROM twice
), by_word AS (
  SELECT doc_id, sum(length(word)) AS word_chars, sum(c) AS n_repeat_words,
    count(*) FILTER (WHERE word IN ({stop})) AS n_stop_words
  FROM covered GROUP BY doc_id
), split AS (
  SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols
  FROM documents
), m AS (
  SELECT cut.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_stop_words, 0) AS BIGINT) AS n_stop_words,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM cut JOIN split USING (doc_id) LEFT JOIN by_word USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {_bounds()} AS kept
FROM m
"""


def license_scan() -> str:
    def canonical(text: str) -> str:
        plain = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', chr(10), 'g')"
        plain = f"trim(regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for spelling, one in SPELLINGS:
            plain = f"replace({plain}, '{spelling}', '{one}')"
        return plain

    rows = ", ".join(
        "('" + name + "', '" + text.replace("'", "''") + "')" for name, text in (*NOTICES, *TEXTS)
    )
    return f"""
WITH known AS (
  SELECT DISTINCT license, md5({canonical("text")}) AS digest FROM (VALUES {rows}) AS k(license, text)
), units AS (
  SELECT doc_id, 0 AS unit, coalesce(text, '') AS part FROM documents
  UNION ALL
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS unit, unnest(ls) AS part
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) WHERE len(ls) > 1
), forms AS (
  SELECT doc_id, unit, {canonical("part")} AS form FROM units
), hits AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS found, count(DISTINCT unit) AS n,
    bool_or(unit = 0) AS whole
  FROM forms JOIN known ON md5(form) = digest WHERE form <> '' GROUP BY doc_id
)
SELECT d.doc_id, coalesce(found, '') AS licenses, CAST(coalesce(n, 0) AS BIGINT) AS n_units,
  coalesce(whole, false) AS whole_text
FROM documents d LEFT JOIN hits USING (doc_id)
"""


FILL_MIDDLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, x, regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tok,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM t
), cut AS (
  SELECT *, CAST(len(tok) AS BIGINT) AS n, least(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS a,
    greatest(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS b,
    CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), pieces AS (
  SELECT *, array_to_string(tok[1:a], '') AS p, array_to_string(tok[a + 1:b], '') AS m,
    array_to_string(tok[b + 1:n], '') AS s
  FROM cut
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM pieces
"""

_EARLY = "2e0 * {u} / (1.5e0 + sqrt(greatest(2.25e0 - 2e0 * {u}, 0e0)))"
_STEADY = "2e0 * {u} / (1e0 + sqrt(greatest(1e0 + 0e0 * {u}, 0e0)))"
_LATE = (
    "CASE WHEN {u} >= 0.25e0 THEN 0.5e0 + 2e0 * ({u} - 0.25e0) / (0.5e0 + sqrt(greatest(0.25e0 + 8e0 * ({u} - 0.25e0), 0e0)))"
    " ELSE 2e0 * {u} / (0.5e0 + sqrt(0.25e0)) END"
)


def _reached(begin: str) -> str:
    u = f"(CAST({begin} AS DOUBLE) / target)"
    early, steady, late = (form.format(u=u) for form in (_EARLY, _STEADY, _LATE))
    return f"CASE rank % 3 WHEN 0 THEN {early} WHEN 1 THEN {steady} ELSE {late} END"


MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS place
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST([3, 1, 2][rank % 3 + 1] AS DOUBLE) AS w, 2 * CAST(source_size AS DOUBLE) AS most FROM sources
), levels AS (
  SELECT most / w AS full_at,
    sum(most) OVER () * 0.75e0 - coalesce(sum(most) OVER (ORDER BY most / w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0e0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0e0) AS open_weight
  FROM weighed
), level AS (
  SELECT rest, open_weight FROM levels WHERE rest / open_weight <= full_at ORDER BY full_at LIMIT 1
), targets AS (
  SELECT source, source_size, rank, least(most, rest * w / open_weight) AS target FROM weighed, level
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.rank, t.target, CAST(floor(t.target) AS BIGINT) AS wanted,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id NULLS FIRST, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), used AS (
  SELECT *, greatest(least(wanted - before, size), 0) AS one, greatest(least(wanted - before - source_size, size), 0) AS two
  FROM placed
)
SELECT doc_id, size, source_size, target, one + two AS taken,
  CASE WHEN one > 0 THEN {_reached("before")} END AS position,
  CASE WHEN two > 0 THEN {_reached("before + source_size")} END AS second_position
FROM used
"""


def _before(edit: str, cost: int, value: str) -> str:
    """A cost of ten digits and edits, with an edit put before."""
    return f"lpad(CAST(CAST(substr({value}, 1, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || '{edit}' || substr({value}, 11)"


def _edited(state: int) -> str:
    """The lightest edit of a row met in a state, before any row is inserted."""
    target = {0: {"s": "v1", "u": "v2"}, 1: {"u": "v2"}, 2: {"a": "v3"}, 3: {"u": "v2"}}[state]
    given = "v3" if state == 2 else "v2"
    extra = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    keeps = " ".join(f"WHEN left(role, 1) = '{i}' THEN {_before('K', extra, v)}" for i, v in target.items())
    return f"""least({_before('D', 2, f'v{state}')},
      CASE WHEN fault IN ('blank', 'duplicate') THEN NULL {keeps} END,
      CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {_before('R', f'1 + {extra}', given)} END)"""


CONVERSATION_REPAIR = rf"""
WITH RECURSIVE bytes AS (
  SELECT list(crc ORDER BY b) AS crcs FROM (
    SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc
    FROM (SELECT CAST(unnest(range(0, 256)) AS BIGINT) AS b))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
      lambda c: CAST(ord(c) AS BIGINT)) AS codes
  FROM conversations
), fated AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), codes),
    lambda c, b: xor(c >> 8, crcs[1 + (xor(c, b) & 255)])), CAST(4294967295 AS BIGINT)) % 20 AS fate
  FROM keyed, bytes
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(0, CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated WHERE fate <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS ending
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM ordered
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), best AS (
  SELECT conv_id, n AS i, '0000000000' AS v0, '0000000010II' AS v1, '0000000005I' AS v2, '0000000000' AS v3 FROM counted
  UNION ALL
  SELECT conv_id, i - 1, least(e0, {_before('I', 5, 'w2')}), least(e1, {_before('I', 5, 'w2')}), w2, w3
  FROM (
    SELECT *, least(e2, {_before('I', 5, 'e3')}) AS w2, least(e3, {_before('I', 5, 'e2')}) AS w3
    FROM (
      SELECT b.conv_id, b.i, {", ".join(f"{_edited(s)} AS e{s}" for s in range(4))}
      FROM best b JOIN judged j ON b.conv_id IS NOT DISTINCT FROM j.conv_id AND b.i = j.i
    )
  )
), chosen AS (
  SELECT conv_id, CAST(substr(v0, 1, 10) AS BIGINT) AS cost, substr(v0, 11) AS audit FROM best WHERE i = 0
), letters AS (
  SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS pos FROM chosen
), edits AS (
  SELECT conv_id, pos, substr(audit, pos, 1) AS edit, length(replace(left(audit, pos), 'I', '')) AS i FROM letters
), lines AS (
  SELECT e.conv_id, e.pos, e.edit, CASE WHEN e.edit = 'K' THEN j.role END AS role,
    CASE WHEN e.edit = 'I' THEN '' ELSE j.text END AS text,
    row_number() OVER (PARTITION BY e.conv_id ORDER BY e.pos) AS place
  FROM edits e LEFT JOIN judged j ON e.conv_id IS NOT DISTINCT FROM j.conv_id AND e.i = j.i
  WHERE e.edit <> 'D'
), led AS (
  SELECT *, coalesce(first_value(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place), '') = 's' AS system_first
  FROM lines
), repaired AS (
  SELECT conv_id, string_agg(coalesce(role, CASE WHEN place % 2 = CASE WHEN system_first THEN 0 ELSE 1 END
    THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY place) AS whole
  FROM led GROUP BY conv_id
), every AS (
  SELECT DISTINCT conv_id FROM conversations
)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM every e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN chosen h ON e.conv_id IS NOT DISTINCT FROM h.conv_id
  LEFT JOIN repaired r ON e.conv_id IS NOT DISTINCT FROM r.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_top_k": TOP_K,
        "op3_license_scan": license_scan(),
        "op4_substring_dedup": SUBSTRING_DEDUP,
        "op9_quality_rules": quality_rules(),
        "op11_conversation_repair": CONVERSATION_REPAIR,
        "op12_mixing": MIXING,
        "op13_fill_middle": FILL_MIDDLE,
    }
