"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .secrets import ACCESS, HEX, MAX_OWNERS, MAX_REPOSITORIES, RUN

_DOCS = "d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)"
_WORDS = r"[^\x20\x09-\x0D]+"
_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(kind: int, pattern: str) -> str:
    p = _quoted(pattern)
    return f"SELECT doc_id, source, {kind} AS kind, regexp_extract_all(t, {p}) AS whole, string_split_regex(t, {p}) AS gaps FROM d"


SECRETS = f"""WITH {_DOCS}, found AS ({' UNION ALL '.join(_found(k, p) for k, p in enumerate((_ASSIGN, ACCESS, HEX, RUN)))}),
each AS (SELECT doc_id, source, kind, gaps, whole, unnest(range(1, len(whole) + 1)) AS i FROM found),
placed AS (SELECT doc_id, source, kind, whole[i] AS w, coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda g: length(g))), 0) AS start FROM each),
valued AS (SELECT *, start + length(w) AS stop, CASE WHEN kind = 0 THEN regexp_extract(w, {_quoted(_ASSIGN)}, 2) ELSE w END AS value FROM placed),
kept AS (SELECT * FROM valued WHERE CASE kind WHEN 0 THEN length(value) >= 12 WHEN 1 THEN length(w) >= 18 WHEN 2 THEN length(w) >= 16 ELSE regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[a-z]') END),
owners AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) AS owners FROM kept GROUP BY value),
judged AS (SELECT *, owners > {min(MAX_OWNERS, MAX_REPOSITORIES)} AS copied FROM kept JOIN owners USING (value)),
stay AS (SELECT * FROM judged a WHERE kind < 3 OR (NOT copied AND NOT EXISTS (SELECT 1 FROM judged b WHERE b.doc_id = a.doc_id AND b.kind < 3 AND b.start < a.stop AND a.start < b.stop))),
named AS (SELECT *, concat(CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END, ':', CAST(start AS BIGINT), ':', CAST(stop AS BIGINT)) AS label FROM stay)
SELECT d.doc_id, count(label) FILTER (kind = 0) AS n_assign, count(label) FILTER (kind = 1) AS n_access, count(label) FILTER (kind = 2) AS n_hex, count(label) FILTER (kind = 3) AS n_owned,
  sha256(coalesce(string_agg(label, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(label, ',' ORDER BY start, kind), '') AS spans,
  count(label) FILTER (copied) AS n_copied, count(label) FILTER (NOT copied) AS n_live
FROM d LEFT JOIN named n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

SUFFIXES = f"""WITH {_DOCS}, h AS (SELECT doc_id, hex(encode(t)) AS x, octet_length(encode(t)) AS n FROM d),
windows AS (SELECT doc_id, i, md5(substring(x, 2 * i + 1, 200)) AS w FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM h WHERE n >= 100)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
marked AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS fresh FROM later),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM runs UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(substring(x, 2 * s + 1, 2 * (coalesce(e, n) - s)), '' ORDER BY s) AS x FROM gaps g JOIN h USING (doc_id) GROUP BY g.doc_id),
total AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS r, count(*) AS c FROM runs GROUP BY doc_id)
SELECT h.doc_id, h.n AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(coalesce(kept.x, h.x))) AS kept_sha256 FROM h LEFT JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)"""

LINES = rf"""WITH {_DOCS}, l AS (SELECT doc_id, string_split(t, chr(10)) AS lines FROM d),
windows AS (SELECT doc_id, i, array_to_string(lines[i:i + 2], chr(10)) AS w FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l WHERE len(lines) >= 3)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM windows WHERE regexp_matches(w, '[^\x20\x09-\x0D]')) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM later),
each AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM l),
kept AS (SELECT e.doc_id, string_agg(line, chr(10) ORDER BY e.i) FILTER (g.i IS NULL) AS t, count(g.i) AS n FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id)
SELECT doc_id, n AS lines_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM kept"""

WORD_WINDOWS = f"""WITH {_DOCS}, w AS (SELECT doc_id, regexp_extract_all(t, '{_WORDS}') AS words FROM d),
windows AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM again),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) FILTER (g.i IS NULL) AS t, count(g.i) AS n FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

_FIELDS = (
    ("word_chars * 1.0 / n < 2.2 OR word_chars * 1.0 / n > 12", "word_chars * 1.0 / n BETWEEN 3 AND 9"),
    ("n_symbols * 8 > n", "n_symbols * 50 <= n"),
    ("n_dup_lines * 3 > n_lines", "n_dup_lines = 0"),
    ("n_repeat_words * 4 > n", "n_repeat_words * 10 <= n"),
    ("n_upper * 4 > c", "n_upper * 8 <= c"),
    ("n_exclaims * 8 > n", "n_exclaims * 50 <= n"),
    ("n_function * 25 < n", "n_function * 10 >= n"),
    ("n_ends * 4 < n_lines", "n_ends * 2 >= n_lines"),
)
_R = len(_FIELDS)
_VOTES = "[" + ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for bad, good in _FIELDS) + "]"
_LIKELIHOOD = f"exp(ln(c['pi']) + list_sum(list_transform(range(1, {_R + 1}), lambda r: ln(c['t'][r][CASE x['v'][r] WHEN -1 THEN 1 WHEN 1 THEN 2 ELSE 3 END]))))"
_N = "list_sum(list_transform(q, lambda x: x['n']))"
_SHARE = f"CASE WHEN k = 0 THEN 0.8::DOUBLE ELSE (0.2 / {_R})::DOUBLE END"


def _votes(vote: int) -> str:
    return f"list_sum(list_transform(q, lambda x: CASE WHEN x['v'][r] = {vote} THEN x['g'][k + 1] ELSE 0.0 END))"


def _two(weight: float, bad: float) -> str:
    return f"list_transform([({weight * bad}::DOUBLE * {_N} + {_votes(-1)}) / ({weight}::DOUBLE * {_N} + {_votes(-1)} + {_votes(1)})], lambda b: [b, 1 - b, 1.0::DOUBLE])[1]"


_OWN = "[" + ", ".join(f"({0.03 * x}::DOUBLE * {_N} + {_votes(v)}) / (0.03::DOUBLE * {_N} + {_votes(-1)} + {_votes(1)} + {_votes(0)})" for x, v in ((0.9, -1), (0.02, 1), (0.08, 0))) + "]"
_STEP = f"""list_transform(range(0, {_R + 1}), lambda k: {{'pi': (0.01::DOUBLE * {_N} * {_SHARE} + list_sum(list_transform(q, lambda x: x['g'][k + 1]))) / (1.01::DOUBLE * {_N}),
  't': list_transform(range(1, {_R + 1}), lambda r: CASE WHEN k = 0 THEN {_two(0.1, 0.02)} WHEN r = k THEN {_OWN} ELSE {_two(0.001, 0.3)} END)}})"""
_START = f"list_transform(range(0, {_R + 1}), lambda k: {{'pi': {_SHARE}, 't': list_transform(range(1, {_R + 1}), lambda r: CASE WHEN k = 0 THEN [0.02::DOUBLE, 0.98::DOUBLE, 1.0::DOUBLE] WHEN r = k THEN [0.9::DOUBLE, 0.02::DOUBLE, 0.08::DOUBLE] ELSE [0.3::DOUBLE, 0.7::DOUBLE, 1.0::DOUBLE] END)}})"


def quality(function_words: list[str], iterations: int) -> str:
    known = ", ".join(f"'{w}'" for w in dict.fromkeys(function_words))
    return rf"""WITH RECURSIVE {_DOCS}, w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORDS}') AS words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_WORDS}')) AS lines FROM d),
triples AS (SELECT doc_id, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
repeats AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM triples) WHERE n > 1) GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(k, 0) AS n_repeat_words, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '!')) AS n_exclaims,
  len(list_filter(words, lambda x: lower(x) IN ({known}))) AS n_function, len(list_filter(lines, lambda l: regexp_matches(l, '[.!?"][\x20\x09-\x0D]*\z'))) AS n_ends FROM w LEFT JOIN repeats USING (doc_id)),
voted AS (SELECT *, {_VOTES} AS v FROM (SELECT *, greatest(n_words, 1) AS n, greatest(word_chars, 1) AS c FROM s)),
pats AS (SELECT list({{'v': v, 'n': n}}) AS pats FROM (SELECT v, count(*)::DOUBLE AS n FROM voted GROUP BY v)),
em(i, p) AS (SELECT 0, {_START} UNION ALL SELECT i + 1, {_STEP} FROM (
  SELECT i, list_transform(pats, lambda x: {{'v': x['v'], 'n': x['n'], 'g': list_transform([list_transform(p, lambda c: {_LIKELIHOOD})], lambda l: list_transform(l, lambda y: x['n'] * y / list_sum(l)))[1]}}) AS q FROM em, pats WHERE i < {iterations})),
fitted AS (SELECT p FROM em WHERE i = {iterations}),
scored AS (SELECT *, l[1] / list_sum(l) AS posterior FROM (SELECT *, list_transform(p, lambda c: list_transform([{{'v': v}}], lambda x: {_LIKELIHOOD})[1]) AS l FROM voted, fitted)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM scored)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= 0.5 AS kept, floor(posterior * 1000000.0 + 0.5) / 1000000.0 AS posterior FROM failed"""
