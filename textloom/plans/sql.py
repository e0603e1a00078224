"""DuckDB SQL for the registered queries that SQL can express, written apart from the Spark plans."""

from __future__ import annotations

from textloom.config import GB_US_SPELLING

RUN = "[\\p{L}\\p{M}\\p{N}''’-]+"
TOKEN = RUN + "|[^\\s\\p{Z}\\p{L}\\p{M}\\p{N}''’-]+"
V = "v AS (SELECT * FROM variation QUALIFY row_number() OVER (PARTITION BY variation_id ORDER BY ingested_at) = 1)"
P = "p AS (SELECT DISTINCT ON (pair_id) pair_id, case_id, base, compared FROM pairwise)"
W = "w AS (SELECT case_id AS work_id, siglum, ordinal, text FROM witness WHERE case_id IS NOT NULL AND siglum IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id, siglum ORDER BY ordinal, witness_id, text) = 1)"
MONO = W + ", c AS (SELECT w.* FROM w WHERE work_id IN (SELECT case_id FROM case_meta WHERE lexicon_name IS NULL))"
F = f"""{V}, {P}, {W},
f AS (SELECT v.pair_id AS pair, variation_id AS v_no, variation_type, base_reading, compared_reading, base_location.char_from AS b_from, base_location.char_to AS b_to,
  compared_location.char_from AS c_from, compared_location.char_to AS c_to, crosses_page, confidence,
  length(b.text) + length(regexp_replace(b.text, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g')) AS base_len, length(k.text) + length(regexp_replace(k.text, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g')) AS compared_len
  FROM v JOIN p USING (pair_id) LEFT JOIN w b ON b.work_id = p.case_id AND b.siglum = p.base LEFT JOIN w k ON k.work_id = p.case_id AND k.siglum = p.compared)"""
R = f"{V}, {P}, r AS (SELECT v.* EXCLUDE (work_id), p.base, p.compared FROM v JOIN p USING (pair_id))"
# Text of the collation cases without excluded regions, and its comparable words with their pages and hyphens split.
KEYS = f"""{MONO},
u AS (SELECT work_id, siglum, regexp_replace(text, '(?is)<!--\\s*no[_-]collate\\b.*?(-->|\\z)', E'\\n', 'g') AS text FROM c WHERE text IS NOT NULL),
b AS (SELECT work_id, siglum, regexp_replace(text, '(?m)<!--\\s*page\\s*break\\s*-->|^[ \\t]*---[ \\t]*\\r?$', E'\\f', 'g') AS text FROM u),
g AS (SELECT work_id, siglum, unnest(string_split(text, E'\\f')) AS part, generate_subscripts(string_split(text, E'\\f'), 1) - 1 AS page FROM b),
h AS (SELECT work_id, siglum, page, unnest(regexp_extract_all(part, '{RUN}')) AS run, generate_subscripts(regexp_extract_all(part, '{RUN}'), 1) AS n FROM g),
s AS (SELECT work_id, siglum, page, n, unnest(x) AS unit, generate_subscripts(x, 1) AS k FROM (SELECT *, CASE WHEN regexp_matches(run, '^.+-.+$') AND NOT regexp_matches(run, '^-+$') THEN regexp_extract_all(run, '(?:^-+)?[^-]+(?:-$)?|-+') ELSE [run] END AS x FROM h)),
keys AS (SELECT work_id, siglum, page, row_number() OVER (PARTITION BY work_id, siglum ORDER BY page, n, k) - 1 AS cidx, nullif(strip_accents(lower(unit)), '') AS key FROM s WHERE unit <> '-')"""
GRAMS = """, grams AS (SELECT *, concat_ws(chr(31), key{more}) AS gram FROM (SELECT *{leads} FROM keys) WHERE k{last} IS NOT NULL),
uniq AS (SELECT work_id, siglum, gram, min(cidx) AS pos, min(page) AS page FROM grams GROUP BY ALL HAVING count(*) = 1)"""


def _grams(n: int) -> str:
    leads = "".join(f", lead(key, {k}) OVER (PARTITION BY work_id, siglum ORDER BY cidx) AS k{k}" for k in range(1, n))
    text = GRAMS.format(more="".join(f", k{k}" for k in range(1, n)), leads=leads, last=n - 1)
    return text.replace("GROUP BY ALL", "GROUP BY work_id, siglum, gram")


SUCCESSIVE = "SELECT work_id, base, compared FROM (SELECT work_id, siglum AS compared, lag(siglum) OVER (PARTITION BY work_id ORDER BY ordinal, siglum) AS base FROM c) WHERE base IS NOT NULL"
PINS = f"""WITH {KEYS}{_grams(3)}, pr AS ({SUCCESSIVE}),
pins AS (SELECT pr.work_id, base, compared, a.pos AS a_start, b.pos AS b_start, CASE WHEN a.page = b.page THEN 2 ELSE 1 END AS weight
  FROM pr JOIN uniq a ON a.work_id = pr.work_id AND a.siglum = base JOIN uniq b ON b.work_id = pr.work_id AND b.siglum = compared AND b.gram = a.gram)"""
LEXICON = """l AS (SELECT DISTINCT coalesce(lexicon_name || '/', '') || coalesce(group_no::VARCHAR, '') AS grp, lower(trim(form)) AS form FROM lexicon WHERE form IS NOT NULL AND trim(form) <> ''),
pv AS (SELECT form, min(least_form) AS "pivot" FROM l JOIN (SELECT grp, min(form) AS least_form FROM l GROUP BY grp HAVING count(*) > 1) USING (grp) GROUP BY form)"""
PAGED = "d AS (SELECT doc_id, regexp_replace(text, '(?m)<!--\\s*page\\s*break\\s*-->|^[ \\t]*---[ \\t]*\\r?$', E'\\f', 'g') AS text FROM documents)"
DOCS = f"""{PAGED}, t AS (SELECT doc_id, unnest(string_split(text, E'\\f')) AS part, generate_subscripts(string_split(text, E'\\f'), 1) - 1 AS page FROM d),
n AS (SELECT doc_id, page, unnest(string_split(part, E'\\n')) AS line_text, generate_subscripts(string_split(part, E'\\n'), 1) AS k FROM t),
x AS (SELECT doc_id, page, k, regexp_extract_all(line_text, '{TOKEN}') AS ts FROM n),
y AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY k) - 1 AS line, ts FROM x WHERE len(ts) > 0)"""
UNITS = f"""r AS (SELECT unnest(regexp_extract_all(text, '{RUN}')) AS run FROM d),
un AS (SELECT unnest(CASE WHEN regexp_matches(run, '^.+-+[^-]') THEN regexp_extract_all(run, '(?:^-+)?[^-]+(?:-$)?|-+') ELSE [run] END) AS unit FROM r)"""
SPELL = ", ".join(f"('{a}', '{b}')" for a, b in sorted(GB_US_SPELLING.items()))


def bucket(at: str, n: int) -> str:
    return f"least({n - 1}, greatest(0, floor({at} * {n} / base_len)))::INT"


SHOWN = "CASE WHEN coalesce({0}, '') = '' THEN '∅' ELSE {0} END"
CITE = """CASE WHEN {0}.line = {0}.end_line THEN 'p.' || ({0}.page + 1) || ' · line ' || ({0}.line + 1) || ' · ' ||
  CASE WHEN {0}.first_word = {0}.last_word THEN 'word ' || ({0}.first_word + 1) ELSE 'words ' || ({0}.first_word + 1) || '–' || ({0}.last_word + 1) END
  ELSE 'p.' || ({0}.page + 1) || ' · lines ' || ({0}.line + 1) || '–' || ({0}.end_line + 1) || ' · words ' || ({0}.first_word + 1) || '…' || ({0}.last_word + 1) END"""
QUOTED = "CASE WHEN coalesce({0}, '') = '' THEN '∅ (omitted)' ELSE '“' || {0} || '”' END"
CSV_COLUMN = "CASE WHEN regexp_matches({0}, '[\",\\r\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"
CSV_ROW = "base AS pair_base, compared AS pair_compared, variation_type AS type, confidence, base_reading, compared_reading, coalesce(base_location.cite, '') AS base_cite, coalesce(compared_location.cite, '') AS compared_cite, crosses_page::VARCHAR AS crosses_page"
TYPES = ("insertion", "deletion", "substitution", "transposition", "variantSpelling")
SNAKE = {"variantSpelling": "variant_spelling"}
COUNTS = ", ".join(f"count(*) FILTER (variation_type = '{t}') AS n_{SNAKE.get(t, t)}" for t in TYPES)

_TENTH = "CASE WHEN round({0} * 10) % 10 = 0 THEN round({0})::BIGINT::VARCHAR ELSE format('{{:.1f}}', round({0} * 10) / 10) END || '%'"
_MANY = "format('{{:,}}', {0}) || ' ' || CASE WHEN {0} = 1 THEN '{1}' ELSE '{2}' END"
_SHARE = "floor({0} / n_variants * 100 + 0.5)::BIGINT || '%'"
NARRATIVE = f"""WITH {F},
t AS (SELECT pair, {COUNTS}, count(*) AS n_variants, max(base_len) AS base_len, count(*) FILTER (variation_type = 'transposition' AND crosses_page) AS across, count(*) FILTER (variation_type = 'transposition' AND confidence = 'likely') AS likely,
  coalesce(sum(greatest(0, b_to - b_from)) FILTER (variation_type <> 'insertion'), 0) AS changed FROM f GROUP BY pair),
k AS (SELECT pair, least(2, greatest(0, floor(floor((b_from + b_to) / 2) * 3 / base_len))) AS part, greatest(1, b_to - b_from) AS width FROM f WHERE variation_type <> 'insertion' AND b_from IS NOT NULL AND base_len > 0),
s AS (SELECT pair, [coalesce(sum(width) FILTER (part = 0), 0) / sum(width), coalesce(sum(width) FILTER (part = 1), 0) / sum(width), coalesce(sum(width) FILTER (part = 2), 0) / sum(width)] AS thirds FROM k GROUP BY pair),
l AS (SELECT pair, abs(c_from - b_from / base_len * compared_len) / compared_len AS off, c_from >= lag(c_from) OVER (PARTITION BY pair ORDER BY b_from, v_no) AS in_step FROM f WHERE b_from IS NOT NULL AND c_from IS NOT NULL AND base_len > 0 AND compared_len > 0),
q AS (SELECT pair, round(max(off) * 100, 6) AS drift, round(count(*) FILTER (in_step) / nullif(count(*) - 1, 0) * 100, 6) AS mono FROM l GROUP BY pair HAVING count(*) > 1),
g AS (SELECT t.*, thirds, drift, mono, round(CASE WHEN t.base_len > 0 THEN changed / t.base_len * 100 ELSE 0 END, 6) AS pct,
  greatest(n_substitution, n_deletion, n_insertion, n_transposition) AS top,
  list_filter([CASE WHEN n_substitution > 0 THEN {_MANY.format('n_substitution', 'substitution', 'substitutions')} || ' (' || {_SHARE.format('n_substitution')} || ')' END, CASE WHEN n_deletion > 0 THEN {_MANY.format('n_deletion', 'deletion', 'deletions')} END,
    CASE WHEN n_insertion > 0 THEN {_MANY.format('n_insertion', 'insertion', 'insertions')} END, CASE WHEN n_transposition > 0 THEN {_MANY.format('n_transposition', 'moved passage', 'moved passages')} END], lambda x: x IS NOT NULL) AS parts
  FROM t LEFT JOIN s USING (pair) LEFT JOIN q USING (pair))
SELECT pair, concat_ws(' ',
  'The compared text differs at ' || {_MANY.format('n_variants', 'point', 'points')} || CASE WHEN pct >= 0.05 THEN ', touching about ' || {_TENTH.format('pct')} || ' of the base text.' ELSE '.' END,
  CASE WHEN top > 0 THEN 'The dominant kind is ' || CASE top WHEN n_substitution THEN 'substitution' WHEN n_deletion THEN 'deletion' WHEN n_insertion THEN 'insertion' ELSE 'transposition (a moved passage)' END || ' (' || {_SHARE.format('top')} || '). In all: '
    || CASE len(parts) WHEN 1 THEN parts[1] WHEN 2 THEN parts[1] || ' and ' || parts[2] ELSE array_to_string(parts[1:len(parts) - 1], ', ') || ', and ' || parts[len(parts)] END || '.' END,
  CASE WHEN thirds IS NULL THEN NULL WHEN list_min(thirds) > 0.25 AND list_max(thirds) < 0.42 THEN 'The changes are spread fairly evenly across the whole work.' WHEN list_max(thirds) > 0.5 THEN 'The changes concentrate in the ' || ['first', 'middle', 'final'][list_position(thirds, list_max(thirds))] || ' third of the work.' ELSE 'The changes fall mostly in two thirds of the work.' END,
  CASE WHEN n_transposition > 0 THEN format('{{:,}}', n_transposition) || CASE WHEN n_transposition = 1 THEN ' passage was' ELSE ' passages were' END || ' relocated' || CASE WHEN across > 0 THEN ' (' || format('{{:,}}', across) || ' across a page boundary)' ELSE '' END || CASE WHEN likely > 0 THEN '; ' || format('{{:,}}', likely) || ' of these are *possible* moves' ELSE '' END || '.' END,
  CASE WHEN n_variant_spelling > 0 THEN {_MANY.format('n_variant_spelling', 'accidental difference was', 'accidental differences were')} || ' also recorded.' END,
  CASE WHEN drift IS NULL THEN NULL WHEN drift <= 8 AND mono >= 98 THEN 'The alignment is sound: shared points stay within ' || {_TENTH.format('drift')} || ' of the ideal diagonal and ' || {_TENTH.format('mono')} || ' advance in step.' ELSE 'The alignment is worth checking: shared points lie up to ' || {_TENTH.format('drift')} || ' off the ideal diagonal; ' || {_TENTH.format('mono')} || ' monotonic.' END) AS text FROM g"""

QUERIES: dict[str, str] = {
    "token_words": f"WITH {PAGED} SELECT doc_id, surface, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{RUN}')) AS surface FROM d) WHERE surface <> '-' GROUP BY ALL",
    "token_places": f"WITH {DOCS} SELECT doc_id, page, line, unnest(ts) AS surface, generate_subscripts(ts, 1) - 1 AS word_index FROM y",
    "token_offsets": f"WITH {PAGED}, x AS (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS ts FROM d) SELECT doc_id, len(ts) AS tokens, list_sum(list_transform(ts, lambda z: length(z)))::BIGINT AS chars FROM x WHERE len(ts) > 0",
    "normal_forms": f"WITH {PAGED}, {UNITS} SELECT unit AS surface, strip_accents(lower(unit)) AS normalized, count(*) AS n FROM un WHERE unit <> '-' GROUP BY ALL",
    "spelling_folds": f"SELECT surface, b AS normalized, n FROM (SELECT lower(w) AS surface, count(*) AS n FROM (SELECT unnest(regexp_extract_all(replace(text, '-', ' '), '{RUN}')) AS w FROM documents) GROUP BY 1) JOIN (VALUES {SPELL}) s(a, b) ON surface = a",
    "comparable_tokens": f"WITH {PAGED} SELECT doc_id, len(regexp_extract_all(replace(text, '-', ' '), '{RUN}')) AS comparable FROM d WHERE regexp_matches(text, '[^\\s\\p{{Z}}]')",
    "key_frequency": f"WITH {KEYS} SELECT work_id, siglum, key, count(*) AS n FROM keys WHERE key IS NOT NULL GROUP BY ALL",
    "successive_pairs": f"WITH {MONO} {SUCCESSIVE}",
    "base_pairs": f"WITH {MONO} SELECT work_id, base, siglum AS compared FROM (SELECT *, first_value(siglum) OVER (PARTITION BY work_id ORDER BY ordinal, siglum) AS base FROM c) WHERE base <> siglum",
    "promoted_order": f"WITH {MONO} SELECT work_id, siglum, row_number() OVER (PARTITION BY work_id ORDER BY CASE WHEN siglum = 'MS' THEN 0 ELSE 1 END, ordinal, siglum) - 1 AS ordinal FROM c",
    "unique_bigrams": f"WITH {KEYS}{_grams(2)} SELECT work_id, siglum, count(*) AS grams, sum(pos)::BIGINT AS positions FROM uniq GROUP BY ALL",
    "unique_trigrams": f"WITH {KEYS}{_grams(3)} SELECT work_id, siglum, count(*) AS grams, sum(pos)::BIGINT AS positions FROM uniq GROUP BY ALL",
    "anchor_pins": f"{PINS} SELECT * FROM pins",
    "plausible_pins": f"""{PINS}, z AS (SELECT work_id, siglum, count(*) AS n FROM keys GROUP BY ALL),
q AS (SELECT pins.*, abs(b_start - floor(a_start * y.n / x.n + 0.5))::INT AS deviation, least(6000, greatest(200, floor(greatest(x.n, y.n) * 0.03))) AS reach
  FROM pins JOIN z x ON x.work_id = pins.work_id AND x.siglum = base JOIN z y ON y.work_id = pins.work_id AND y.siglum = compared)
SELECT work_id, base, compared, a_start, b_start, deviation FROM q WHERE deviation <= reach""",
    "anchor_density": f"WITH {KEYS}, n AS (SELECT work_id, siglum, key, count(*) AS n FROM keys GROUP BY ALL) SELECT work_id, siglum, sum(n)::BIGINT AS tokens, count(*) FILTER (n = 1) AS unique_tokens, round(count(*) FILTER (n = 1) / sum(n), 6) AS density FROM n GROUP BY ALL",
    "lexicon_pivots": f"WITH {LEXICON} SELECT form, \"pivot\" FROM pv",
    "pivoted_keys": f"WITH {KEYS.replace('IS NULL))', 'IS NOT NULL))')}, {LEXICON} SELECT work_id, siglum, keys.key AS normalized, pv.\"pivot\" AS key, count(*) AS n FROM keys JOIN pv ON form = keys.key WHERE pv.\"pivot\" <> keys.key GROUP BY work_id, siglum, keys.key, pv.\"pivot\"",
    "pair_tallies": f"WITH {F} SELECT pair, {COUNTS}, count(*) AS n_variants FROM f GROUP BY pair",
    "dominant_kind": f"WITH {F} SELECT pair, variation_type AS dominant_type, n AS dominant_n FROM (SELECT pair, variation_type, count(*) AS n FROM f WHERE variation_type <> 'variantSpelling' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY pair ORDER BY n DESC, list_position(['substitution', 'deletion', 'insertion', 'transposition'], variation_type)) = 1",
    "extent_metrics": f"WITH {F}, e AS (SELECT pair, coalesce(sum(greatest(0, b_to - b_from)) FILTER (variation_type <> 'insertion'), 0)::BIGINT AS changed_chars, max(base_len) AS base_len FROM f GROUP BY pair) SELECT pair, changed_chars, base_len, round(CASE WHEN base_len > 0 THEN changed_chars / base_len * 100 ELSE 0 END, 6) AS changed_pct FROM e",
    "thirds_cluster": f"""WITH {F}, k AS (SELECT pair, least(2, greatest(0, floor(floor((b_from + b_to) / 2) * 3 / base_len))) AS part, greatest(1, b_to - b_from) AS width FROM f WHERE variation_type <> 'insertion' AND b_from IS NOT NULL AND base_len > 0),
s AS (SELECT pair, coalesce(sum(width) FILTER (part = 0), 0)::BIGINT AS first_third, coalesce(sum(width) FILTER (part = 1), 0)::BIGINT AS middle_third, coalesce(sum(width) FILTER (part = 2), 0)::BIGINT AS final_third, sum(width) AS t FROM k GROUP BY pair)
SELECT pair, first_third, middle_third, final_third, CASE WHEN least(first_third / t, middle_third / t, final_third / t) > 0.25 AND greatest(first_third / t, middle_third / t, final_third / t) < 0.42 THEN 'even'
  WHEN first_third / t > 0.5 THEN 'concentrated: first_third' WHEN middle_third / t > 0.5 THEN 'concentrated: middle_third' WHEN final_third / t > 0.5 THEN 'concentrated: final_third' ELSE 'mostly two' END AS clustering FROM s""",
    "alignment_quality": f"""WITH {F}, k AS (SELECT pair, abs(c_from - b_from / base_len * compared_len) / compared_len AS off, c_from >= lag(c_from) OVER (PARTITION BY pair ORDER BY b_from, v_no) AS in_step FROM f WHERE b_from IS NOT NULL AND c_from IS NOT NULL AND base_len > 0 AND compared_len > 0),
q AS (SELECT pair, count(*) AS points, round(max(off) * 100, 6) AS drift_pct, round(count(*) FILTER (in_step) / nullif(count(*) - 1, 0) * 100, 6) AS monotonic_pct FROM k GROUP BY pair HAVING count(*) > 1)
SELECT *, drift_pct <= 8 AND monotonic_pct >= 98 AS sound FROM q""",
    "change_histogram": f"WITH {F} SELECT pair, {bucket('b_from', 80)} AS bucket, variation_type, count(*) AS n FROM f WHERE b_from IS NOT NULL AND base_len > 0 GROUP BY ALL",
    "heat_strip": f"WITH {F}, k AS (SELECT pair, unnest(range({bucket('b_from', 160)}, {bucket('greatest(b_from, b_to - 1)', 160)} + 1))::INT AS bucket, CASE WHEN variation_type = 'insertion' THEN 6 ELSE greatest(1, b_to - b_from) END AS weight FROM f WHERE b_from IS NOT NULL AND base_len > 0) SELECT pair, bucket, sum(weight)::BIGINT AS heat FROM k GROUP BY ALL",
    "story_segments": f"WITH {F}, k AS (SELECT pair, {bucket('b_from', 12)} AS segment, b_from, v_no FROM f WHERE b_from IS NOT NULL AND base_len > 0) SELECT pair, segment, count(*) OVER (PARTITION BY pair, segment) AS n, row_number() OVER (PARTITION BY pair, segment ORDER BY b_from, v_no) AS example_no, v_no FROM k QUALIFY example_no <= 6",
    "redline": f"WITH {F}, k AS (SELECT pair, v_no, b_from, coalesce(max(b_to) OVER (PARTITION BY pair ORDER BY b_from, b_to, v_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reached FROM f WHERE b_from IS NOT NULL) SELECT pair, v_no FROM k WHERE b_from >= reached",
    "span_slices": f"WITH {F}, h AS (SELECT * FROM f WHERE b_to > b_from), e AS (SELECT DISTINCT pair, unnest([b_from, b_to]) AS lo FROM h), s AS (SELECT pair, lo, lead(lo) OVER (PARTITION BY pair ORDER BY lo) AS hi FROM e) SELECT s.pair, lo AS \"at\", hi AS \"to\", arg_min(v_no, [b_to - b_from, v_no]) AS v_no FROM s JOIN h ON h.pair = s.pair AND b_from <= lo AND b_to >= hi WHERE hi IS NOT NULL GROUP BY s.pair, lo, hi",
    "pair_check": f"WITH {V}, s AS (SELECT DISTINCT ON (pair_id) pair_id, n_insertion AS stored_insertion, n_deletion AS stored_deletion, n_substitution AS stored_substitution, n_transposition AS stored_transposition, n_variant_spelling AS stored_variant_spelling FROM pairwise), k AS (SELECT pair_id, {COUNTS} FROM v GROUP BY pair_id), b AS (SELECT s.*, {', '.join(f'coalesce(n_{SNAKE.get(t, t)}, 0) AS n_{SNAKE.get(t, t)}' for t in TYPES)} FROM s LEFT JOIN k USING (pair_id)) SELECT * FROM b WHERE {' OR '.join(f'stored_{SNAKE.get(t, t)} <> n_{SNAKE.get(t, t)}' for t in TYPES)}",
    "displaced_words": f"""WITH {V}, g AS (SELECT pair_id, variation_id, unnest(regexp_extract_all(lower(base_reading), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS word FROM v WHERE variation_type = 'deletion' AND NOT within_transposition), i AS (SELECT pair_id, variation_id, unnest(regexp_extract_all(lower(compared_reading), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS word FROM v WHERE variation_type = 'insertion' AND NOT within_transposition)
SELECT pair_id, word, deleted_in, inserted_in FROM (SELECT pair_id, word, max(variation_id) AS deleted_in FROM g GROUP BY ALL HAVING count(*) = 1) JOIN (SELECT pair_id, word, max(variation_id) AS inserted_in FROM i GROUP BY ALL HAVING count(*) = 1) USING (pair_id, word)""",
    "shared_insertions": f"WITH {V} SELECT case_id, trim(regexp_replace(lower(compared_reading), ' +', ' ', 'g'), ' ') AS reading, list_sort(list(DISTINCT pair_id)) AS pairs, count(*) AS n FROM v WHERE variation_type = 'insertion' AND compared_reading IS NOT NULL GROUP BY case_id, reading",
    "moved_deviation": f"WITH {F} SELECT pair, v_no, abs(c_from - floor(b_from * compared_len / base_len + 0.5))::INT AS deviation FROM f WHERE variation_type = 'transposition' AND b_from IS NOT NULL AND c_from IS NOT NULL AND base_len > 0 AND compared_len IS NOT NULL",
    "cites": f"WITH {V} SELECT variation_id, {CITE.format('base_location')} AS cite FROM v WHERE base_location IS NOT NULL",
    "csv_rows": f"WITH {R} SELECT {CSV_ROW} FROM r",
    "csv_lines": f"WITH {R}, k AS (SELECT {CSV_ROW} FROM r) SELECT " + " || ',' || ".join(CSV_COLUMN.format(f"coalesce({c}, '')") for c in "pair_base pair_compared type confidence base_reading compared_reading base_cite compared_cite crosses_page".split()) + " AS line FROM k",
    "pairwise_apparatus": f"WITH {R} SELECT variation_id, coalesce(base_tokens.tok_from, compared_tokens.tok_from, 0) AS position, base_tokens.tok_from AS base_position, {SHOWN.format('base_reading')} AS lemma, variation_type AS type, {SHOWN.format('compared_reading')} AS reading FROM r",
    "report_entries": f"""WITH {R} SELECT variation_id, '  [' || variation_id || '] ' || CASE variation_type WHEN 'insertion' THEN 'INSERTION' WHEN 'deletion' THEN 'DELETION' WHEN 'substitution' THEN 'SUBSTITUTION' WHEN 'transposition' THEN 'TRANSPOSITION (moved)' ELSE 'ACCIDENTAL (spelling/case)' END
|| CASE WHEN crosses_page THEN '  (ACROSS PAGES)' ELSE '' END || CASE WHEN within_transposition THEN '  (within a moved passage)' ELSE '' END || CASE WHEN variation_type = 'transposition' AND confidence = 'likely' THEN '  (POSSIBLE move)' ELSE '' END
|| E'\\n      ' || base || ': ' || {QUOTED.format('base_reading')} || ' @ ' || coalesce(base_location.cite, '—') || E'\\n      ' || compared || ': ' || {QUOTED.format('compared_reading')} || ' @ ' || coalesce(compared_location.cite, '—') AS text FROM r""",
    "cross_page": f"WITH {V} SELECT variation_id, base_location.page AS base_page, compared_location.page AS compared_page FROM v WHERE base_location.page <> compared_location.page",
    "perspective": f"WITH {R} SELECT case_id, siglum, variation_type, count(*) AS n FROM (SELECT case_id, unnest([base, compared]) AS siglum, variation_type FROM r) GROUP BY ALL",
    "escaped": f"WITH {V} SELECT variation_id, replace(replace(replace(base_reading, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM v WHERE base_reading IS NOT NULL",
    "ordered_witnesses": f"WITH {MONO} SELECT work_id, siglum, CASE siglum WHEN 'TS' THEN 0 ELSE 1 END AS ordinal FROM c WHERE siglum IN ('TS', 'MS')",
    "run_summary": f"WITH {W}, {R}, z AS (SELECT work_id, count(*) AS witnesses, sum(coalesce(length(text) + length(regexp_replace(text, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g')), 0))::BIGINT AS chars FROM w GROUP BY work_id), k AS (SELECT case_id AS work_id, {COUNTS} FROM r GROUP BY case_id) SELECT z.*, {', '.join(f'coalesce(n_{SNAKE.get(t, t)}, 0) AS n_{SNAKE.get(t, t)}' for t in TYPES)} FROM z LEFT JOIN k USING (work_id)",
    "witness_sizes": f"WITH {KEYS}, k AS (SELECT work_id, siglum, count(*) AS n FROM keys WHERE key IS NOT NULL GROUP BY ALL) SELECT c.work_id, c.siglum, coalesce(length(text) + length(regexp_replace(text, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g')), 0)::INT AS chars, coalesce(n, 0) AS tokens FROM c LEFT JOIN k ON k.work_id = c.work_id AND k.siglum = c.siglum",
    "covering_changes": f"WITH {F} SELECT p.pair, p.v_no AS place, min(h.v_no) AS v_no FROM f p JOIN f h ON h.pair = p.pair AND h.b_from <= p.b_from AND coalesce(p.b_to, p.b_from) <= coalesce(h.b_to, h.b_from) AND h.c_from IS NOT NULL GROUP BY p.pair, p.v_no",
    "insertion_mates": f"""WITH {V}, q AS (SELECT DISTINCT ON (pair_id) pair_id, compared AS witness FROM pairwise), a AS (SELECT case_id AS work_id, variation_id AS v_no, witness, coalesce(compared_reading, '') AS reading FROM v JOIN q USING (pair_id) WHERE variation_type = 'insertion' AND case_id IS NOT NULL),
n AS (SELECT DISTINCT work_id, trim(regexp_replace(lower(reading), ' +', ' ', 'g'), ' ') AS node, witness FROM a),
m AS (SELECT n.work_id, node, min(v_no) FILTER (reading = node) AS own, min(v_no) AS other FROM n JOIN a ON a.work_id = n.work_id AND a.witness = n.witness GROUP BY n.work_id, node)
SELECT work_id, node, coalesce(own, other) AS v_no, own IS NOT NULL AS by_reading FROM m""",
    "narratives": NARRATIVE,
    "self_collation": "SELECT 0::BIGINT AS work_id, '' AS base, '' AS compared, 0 AS v_no, '' AS variation_type, '' AS base_reading, '' AS compared_reading, NULL AS base_tokens, NULL AS compared_tokens, NULL AS base_location, NULL AS compared_location, false AS crosses_page, false AS within_transposition, '' AS confidence, 0 AS insertion_anchor WHERE false",
}
