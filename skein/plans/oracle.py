"""DuckDB SQL for the registered queries: the same columns from the same tables."""

from __future__ import annotations

from skein.plans import adapters as ad
from skein.plans.adapters import LOG_SQL, PASSAGES_SQL, SOURCES_SQL, quoted, tokens_sql

TOKENS_SQL = f"toks AS MATERIALIZED (SELECT id, unnest(list_distinct(list_concat(list_concat({tokens_sql('text')}, {tokens_sql('title')}), {tokens_sql('chapter_ref')}))) AS term FROM passages)"
PLACES_SQL = f"""fields AS (SELECT id, 'text' AS field, {tokens_sql('text')} AS w FROM passages UNION ALL SELECT id, 'title', {tokens_sql('title')} FROM passages UNION ALL SELECT id, 'chapter_ref', {tokens_sql('chapter_ref')} FROM passages),
places AS MATERIALIZED (SELECT id, field, unnest(range(0, len(w))) AS pos, unnest(w) AS term FROM fields)"""
OPEN, CLOSE = "chr(57344)", "chr(57345)"
#: Letters beyond ASCII in the fixtures, and capitals that stand for them where edit distance counts bytes.
LETTERS = "ßäçèéêíñóöü"


def batch_sql(*asked: str) -> str:
    return "q AS (SELECT * FROM (VALUES " + ", ".join(f"('q{i}', {quoted(x)})" for i, x in enumerate(asked)) + ") AS v(query_id, q))"


def parse_sql() -> str:
    """p: query_id, q, phrases, keywords of q."""
    return r"""p AS (SELECT query_id, trim(q) AS q, list_transform(regexp_extract_all(q, '"([^"]+)"', 1), lambda x: trim(x, E' \t\n\r')) AS phrases,
  list_filter(string_split_regex(regexp_replace(q, '"[^"]+"', ' ', 'g'), '\s+'), lambda x: x <> '') AS keywords FROM q)"""


def terms_sql(synonyms: bool = False) -> str:
    out = f"""pt AS (SELECT query_id, 'phrase' AS kind, u AS unit, {tokens_sql('phrase')} AS w FROM (SELECT query_id, unnest(range(0, len(phrases))) AS u, unnest(phrases) AS phrase FROM p)),
kt AS (SELECT query_id, 'keyword' AS kind, 0 AS unit, {tokens_sql("array_to_string(keywords, ' ')")} AS w FROM p),
allt AS (SELECT * FROM pt UNION ALL SELECT * FROM kt{' UNION ALL SELECT * FROM st' if synonyms else ''}),
terms AS (SELECT query_id, kind, unit, len(w) AS n, unnest(range(0, len(w))) AS tp, unnest(w) AS term FROM allt)"""
    if synonyms:
        pairs = ", ".join(f"({quoted(t)}, {quoted(s)})" for t, many in ad.SYNONYMS for s in many)
        out = f"""syn AS (SELECT * FROM (VALUES {pairs}) AS v(term, s)),
st AS (SELECT query_id, 'synonym' AS kind, row_number() OVER () AS unit, [t] AS w FROM (
  SELECT DISTINCT query_id, unnest({tokens_sql('s')}) AS t FROM (SELECT query_id, unnest(keywords) AS k FROM p WHERE len(phrases) = 0) JOIN syn ON lower(k) = syn.term)),
""" + out
    return out


UNITS_SQL = "units AS (SELECT query_id, kind, unit, id FROM (SELECT query_id, kind, unit, id, n, tp FROM cand JOIN toks USING (term)) GROUP BY query_id, kind, unit, id, n HAVING count(DISTINCT tp) = n)"
MATCH_SQL = """flags AS (SELECT query_id, id, bool_or(kind = 'phrase') AS fp, bool_or(kind = 'keyword') AS fk, bool_or(kind = 'synonym') AS fs FROM units GROUP BY query_id, id),
matches AS (SELECT query_id, id, NOT direct AS by_synonym FROM (SELECT query_id, id, fs, (fp OR len(phrases) = 0) AND (fk OR len(keywords) = 0) AS direct FROM flags JOIN p USING (query_id)) WHERE direct OR fs)"""


def matches_sql(asked: str, synonyms: bool = False, fuzzy: bool = False, strict: bool = False, passages: str = PASSAGES_SQL) -> str:
    parts = [asked, passages, TOKENS_SQL, parse_sql(), terms_sql(synonyms)]
    if fuzzy:
        mapped = lambda x: f"translate({x}, '{LETTERS}', 'ABCDEFGHIJK')"
        parts += [
            "radius AS (SELECT *, CASE WHEN kind = 'keyword' THEN least(6, CAST(round(length(term) * 0.2) AS INT)) ELSE 0 END AS k FROM terms)", f"vocab AS (SELECT term, {mapped('term')} AS m FROM (SELECT DISTINCT term FROM toks))",
            f"cand AS (SELECT query_id, kind, unit, n, tp, term FROM radius WHERE k = 0 UNION ALL SELECT query_id, kind, unit, n, tp, vocab.term FROM radius JOIN vocab ON k > 0 AND abs(length(vocab.term) - length(radius.term)) <= k AND levenshtein(m, {mapped('radius.term')}) <= k)",
        ]
    else:
        parts.append("cand AS (SELECT query_id, kind, unit, n, tp, term FROM terms" + (" WHERE kind <> 'phrase'" if strict else "") + ")")
    if strict:
        runs = "SELECT DISTINCT query_id, kind, unit, id FROM (SELECT query_id, kind, unit, id, field, pos - tp AS b, n, tp FROM terms JOIN places USING (term) WHERE kind = 'phrase') GROUP BY query_id, kind, unit, id, field, b, n HAVING count(DISTINCT tp) = n"
        parts += [PLACES_SQL, UNITS_SQL.replace("units AS (", "loose AS ("), f"units AS (SELECT * FROM loose UNION ALL {runs})"]
    else:
        parts.append(UNITS_SQL)
    return "WITH " + ",\n".join([*parts, MATCH_SQL])


BENCH_PHRASES = """q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, '"' || array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') || '"' AS q FROM benchmark)"""
INDEXED = PASSAGES_SQL.replace("passages AS (", "all_passages AS (") + ",\n" + SOURCES_SQL + ",\npassages AS (SELECT a.* FROM all_passages a JOIN sources s ON a.source_id = s.id AND s.enabled)"


def escape_sql(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


def highlight_sql(text: str, terms: str) -> str:
    """``terms``: an SQL list, none empty."""
    escaped = rf"list_transform(list_sort(list_transform({terms}, lambda t, i: {{'n': -length(t), 'i': i, 't': t}})), lambda x: regexp_replace(x.t, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g'))"
    marked = rf"regexp_replace({text}, '(' || array_to_string({escaped}, '|') || ')', {OPEN} || '\1' || {CLOSE}, 'gi')"
    return f"replace(replace({escape_sql(marked)}, {OPEN}, '<mark><span class=\"sr-only\">highlighted: </span>'), {CLOSE}, '</mark>')"


def clip_steps(source: str, extra: str = "") -> str:
    """cl: columns of ``source`` (text, terms, context) and clip."""
    bare = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9'']', '', 'g')"
    hit = f"list_filter(range(1, len(w) + 1), lambda i: len(list_filter(wanted, lambda t: len(list_filter(range(1, len(t) + 1), lambda j: coalesce(contains(plain[i + j - 1], t[j]), false))) = len(t))) > 0)[1]"
    return rf"""c1 AS (SELECT *, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w, list_transform(terms, lambda t: list_transform(string_split_regex(t, '\s+'), lambda x: {bare('x')})) AS wanted FROM {source}),
c2 AS (SELECT *, list_transform(w, lambda x: {bare('x')}) AS plain FROM c1),
c3 AS (SELECT *, {hit} AS hit, len(w) AS n FROM c2),
c4 AS (SELECT *, greatest(1, hit - context) AS a, least(n, hit + context) AS z FROM c3),
cl AS (SELECT *, CASE WHEN hit IS NULL THEN {escape_sql("array_to_string(w[1:context], ' ')")} || CASE WHEN n > context THEN '…' ELSE '' END
  ELSE CASE WHEN a > 1 THEN '…' ELSE '' END || {highlight_sql("array_to_string(w[a:z], ' ')", 'terms')} || CASE WHEN z < n THEN '…' ELSE '' END END AS clip FROM c4)"""


GROUPED_Q = batch_sql("erst heon", '"in the" erst', "thion")
GROUPED_SQL = (
    matches_sql(GROUPED_Q, synonyms=True, fuzzy=True, passages=INDEXED)
    + """,
hl AS (SELECT query_id, list_transform(list_concat(phrases, keywords), lambda x: lower(x)) AS terms FROM p),
r AS (SELECT m.query_id, s.sort_order AS group_pos, row_number() OVER (PARTITION BY m.query_id, source_id ORDER BY sequence, passages.id) AS pos, source_id, passages.id AS passage_id, sequence, text, terms, context_words AS context,
       display_mode, text || chr(10) || chr(10) || '— ' || s.title || ', ' || chapter_ref || ', ' || page_ref AS cited, by_synonym
      FROM matches m JOIN passages ON m.id = passages.id JOIN sources s ON s.id = source_id JOIN hl USING (query_id)),
"""
    + clip_steps("r")
    + f"""
SELECT query_id, group_pos, pos, source_id, passage_id, sequence, CASE WHEN display_mode = 'full-text' THEN {highlight_sql('text', 'terms')} ELSE clip END AS kwic,
       CASE WHEN display_mode = 'full-text' THEN cited END AS citation, by_synonym AS matched_by_synonym FROM cl"""
)

BLOCKS_SQL = r"""b0 AS (SELECT doc_id, unnest(range(0, len(x))) AS block_pos, trim(unnest(x), E' \t\n\r') AS block FROM (SELECT doc_id, string_split_regex(text, '\n{2,}') AS x FROM marked)),
b1 AS (SELECT *, CAST(nullif(regexp_extract(block, '^<<<PAGE (\d+)>>>$', 1), '') AS INT) AS m FROM b0 WHERE block <> ''),
blocks AS (SELECT doc_id, block_pos, block, page, m FROM (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_pos ROWS UNBOUNDED PRECEDING), 1) AS page FROM b1) WHERE m IS NULL)"""
PARAS_SQL = r"paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_pos) AS seq, page, block AS text FROM blocks WHERE len(list_filter(string_split_regex(block, '\s+'), lambda x: x <> '')) >= 20)"
CHAPTERS_SQL = "chapters AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', 'The {n}', {a}, {z})" for n, a, z in ad.CHAPTERS) + ") AS v(name, title, a, z))"


def split_ctes(source: str, keys: str, text: str = "text") -> str:
    """CTEs (of WITH RECURSIVE) that end in parts (keys, part, text): ``text`` of ``source`` cut as long paragraphs are."""
    return rf"""cut_s AS (SELECT {keys}, string_split(regexp_replace(trim(coalesce({text}, ''), E' \t\n\r'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS rest FROM {source}),
cut_w AS (
  SELECT {keys}, CAST([] AS VARCHAR[]) AS parts, rest, list_transform(rest, lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> ''))) AS sizes, false AS done FROM cut_s
  UNION ALL
  SELECT {keys},
         CASE WHEN total <= 300 THEN list_append(parts, array_to_string(rest, ' ')) WHEN len(rest) = 1 OR best = 1 AND n > 300 THEN list_concat(parts, [array_to_string(words[1:150], ' '), array_to_string(words[151:], ' ')])
              ELSE list_append(parts, array_to_string(rest[1:best], ' ')) END,
         CASE WHEN total <= 300 OR len(rest) = 1 THEN [] ELSE rest[best + 1:] END, CASE WHEN total <= 300 OR len(rest) = 1 THEN [] ELSE sizes[best + 1:] END, total <= 300 OR len(rest) <= best
  FROM (SELECT *, CAST(CASE WHEN len(sizes) = 1 THEN total ELSE list_sum(sizes[1:best]) END AS BIGINT) AS n, list_filter(string_split_regex(rest[1], '\s+'), lambda w: w <> '') AS words
        FROM (SELECT *, CAST(list_sum(sizes) AS BIGINT) AS total, list_position(far, list_min(far)) AS best
              FROM (SELECT *, list_transform(range(1, len(sizes) + 1), lambda i: abs(list_sum(sizes[1:i]) - 150)) AS far FROM cut_w WHERE NOT done AND len(rest) > 0)))),
parts AS (SELECT {keys}, unnest(range(0, len(parts))) AS part, unnest(parts) AS text FROM cut_w WHERE done)"""


N_WORDS_SQL = r"len(list_filter(string_split_regex(%s, '\s+'), lambda x: x <> ''))"
CHAPTERED_SQL = f"""WITH {ad.marked_sql()}, {BLOCKS_SQL}, {PARAS_SQL}, {CHAPTERS_SQL},
x AS (SELECT doc_id, seq, min_by(name, a) AS name, min_by(title, a) AS title FROM paras LEFT JOIN chapters ON page BETWEEN a AND z GROUP BY doc_id, seq)
SELECT doc_id, seq, coalesce(name, 'Front Matter') AS chapter_ref, coalesce(title, 'Front Matter') AS chapter_title FROM x"""
HEADER = "RUNNING HEAD\\n42\\n"
STRIP_SQL = f"""WITH {ad.marked_sql(HEADER)},
l AS (SELECT doc_id, unnest(range(0, len(x))) AS line_no, trim(unnest(x), E' \\t\\n\\r') AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM marked)),
m AS (SELECT *, CAST(regexp_matches(s, '^<<<PAGE \\d+>>>$') AS INT) AS mk FROM l),
nr AS (SELECT *, coalesce(lag(mk, 1) OVER w, 0) + coalesce(lag(mk, 2) OVER w, 0) + coalesce(lead(mk, 1) OVER w, 0) + coalesce(lead(mk, 2) OVER w, 0) AS near FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
auto AS (SELECT doc_id, s FROM nr WHERE near > 0 AND s <> '' AND length(s) < 40 AND mk = 0 GROUP BY doc_id, s HAVING sum(near) >= 3),
r AS (SELECT m.doc_id, line_no, CASE WHEN mk = 1 OR m.s = '' THEN NULL WHEN regexp_matches(m.s, '^Licensed under') THEN 'pattern: ^Licensed under' WHEN regexp_matches(m.s, '^\\d+$') THEN 'digit-only' WHEN auto.s IS NOT NULL THEN 'auto header/footer' END AS reason
      FROM m LEFT JOIN auto ON m.doc_id = auto.doc_id AND m.s = auto.s)
SELECT doc_id, line_no, reason FROM r WHERE reason IS NOT NULL"""

DIRTY = ad.replaced_sql("coalesce(text, '')", ad.DIRT)
BROKEN = ad.replaced_sql("coalesce(text, '')", ad.BREAKS).replace("\n", "' || chr(10) || '")
LIGATURE_STEPS = "t"
for _sign, _letters in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬅ", "st"), ("ﬆ", "st"), ("ǳ", "dz")):
    LIGATURE_STEPS = f"replace({LIGATURE_STEPS}, '{_sign}', '{_letters}')"
NORMALIZE_SQL = (
    f"WITH d AS (SELECT doc_id, {DIRTY} AS t FROM documents),\n"
    + rf"a AS (SELECT doc_id, t, translate(regexp_replace({LIGATURE_STEPS}, '\r\n?', chr(10), 'g'), '‘’‚‛“”„', {quoted(chr(39) * 4 + chr(34) * 3)}) AS u FROM d),"
    + "\n"
    + r"b AS (SELECT doc_id, t, regexp_replace(u, '([0-9_\p{L}\p{M}\p{N}])\s*[–—]\s*([0-9_\p{L}\p{M}\p{N}])', '\1 — \2', 'g') AS u FROM a)"
    + "\n"
    + r"SELECT doc_id, CAST(len(regexp_extract_all(t, '[ﬃﬄﬀﬁﬂﬅﬆǳ]')) AS INT) AS ligatures, md5(regexp_replace(regexp_replace(u, '[ \t]+', ' ', 'g'), '(?m)[ \t]+$', '', 'g')) AS text FROM b"
)
OVER_LINE, OVER_PARAGRAPH = r"([A-Za-z]+)-\n[ \t]*([A-Za-z]+)", r"([A-Za-z]+)-\n{2,}[ \t]*([a-z]+)"
KEEP = "(lower(x.l || '-' || x.r) IN ('self-will', 'step-work', 'so-called') OR NOT regexp_matches(x.l, '(?i)[aeiou]') OR NOT regexp_matches(x.r, '(?i)[aeiou]'))"


def repair_sql(source: str, pattern: str, joined: tuple[str, ...] = ()) -> str:
    unless = f" AND lower(x.l || x.r) NOT IN ({', '.join(map(quoted, joined))})" if joined else ""
    pairs = f"list_transform(range(1, len(l) + 1), lambda i: {{'l': l[i], 'r': r[i]}})"
    said = f"list_transform({pairs}, lambda x: CASE WHEN {KEEP}{unless} THEN x.l || '-' || x.r ELSE x.l || x.r END)"
    return (
        f"(SELECT doc_id, array_to_string(list_transform(range(1, len(pieces)), lambda i: pieces[i] || said[i]), '') || pieces[len(pieces)] AS t FROM (SELECT doc_id, pieces, {said} AS said FROM "
        f"(SELECT doc_id, string_split_regex(t, '{pattern}') AS pieces, regexp_extract_all(t, '{pattern}', 1) AS l, regexp_extract_all(t, '{pattern}', 2) AS r FROM {source})))"
    )


REPAIR_SQL = rf"""WITH d AS (SELECT doc_id, {BROKEN} AS t FROM documents), p1 AS {repair_sql('d', OVER_PARAGRAPH)}, p2 AS {repair_sql('p1', OVER_LINE)},
bl AS (SELECT doc_id, list_transform(string_split_regex(t, '\n{{2,}}'), lambda b: trim(b, E' \t\n\r')) AS x FROM p2)
SELECT doc_id, md5(array_to_string(list_filter(list_transform(x, lambda b: CASE WHEN regexp_matches(b, '^<<<PAGE (\d+)>>>$') THEN b ELSE trim(regexp_replace(replace(b, chr(10), ' '), ' {{2,}}', ' ', 'g')) END), lambda b: b <> ''), chr(10) || chr(10))) AS text FROM bl"""
CANDIDATES_SQL = f"cand AS (SELECT doc_id, unnest(range(0, len(l))) AS place, unnest(l) AS left_, unnest(r) AS right_ FROM (SELECT doc_id, regexp_extract_all(t, '{OVER_LINE}', 1) AS l, regexp_extract_all(t, '{OVER_LINE}', 2) AS r FROM (SELECT doc_id, {BROKEN} AS t FROM documents)))"
DECIDED_SQL = """decided AS (SELECT *, CASE WHEN lower(left_ || '-' || right_) IN ('self-will', 'step-work', 'so-called') THEN 'custom compound' WHEN lower(left_ || right_) IN (%s) THEN 'dict match' WHEN lower(left_ || '-' || right_) IN (%s) THEN 'dict hyphenated'
  WHEN NOT regexp_matches(left_, '(?i)[aeiou]') OR NOT regexp_matches(right_, '(?i)[aeiou]') THEN 'no vowel (abbrev)' ELSE 'default join' END AS decision FROM cand)"""
SLUG_SQL = r"regexp_replace(regexp_replace(lower(chapter), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
CHAPTER_SLUG_SQL = r"regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(chapter), '[\s–—-]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g'), 1, 30), '-+$', '')"
FAULTY_SQL = PASSAGES_SQL + """,
faulty AS (SELECT CASE WHEN sequence % 50 IN (7, 32) THEN 'doc-' || (sequence - sequence % 50) WHEN sequence % 97 = 5 THEN '' ELSE id END AS id, CASE WHEN sequence % 59 = 1 THEN 'nowhere' WHEN sequence % 50 = 32 THEN 'src2' ELSE 'src0' END AS source_id, CASE WHEN sequence % 43 = 2 THEN NULL ELSE title END AS title, sequence,
  CASE WHEN sequence % 31 = 3 THEN ' ' || chr(10) || ' ' ELSE text END AS text FROM passages)"""
#: Words of ASCII letters alone.
WORDS_SQL = r"list_filter(regexp_extract_all(%s, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]+'))"
DAILY_PAGES_SQL = r"""cal AS (SELECT CAST(d AS DATE) AS d FROM range(DATE '2000-01-01', DATE '2001-01-01', INTERVAL 1 DAY) AS t(d)),
pg AS (SELECT doc_id, DATE '2000-01-01' + CAST(doc_id % 366 AS INTEGER) AS dt,
              array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n?|[\n\f\v]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), ' ') AS body FROM documents),
good AS (SELECT strftime(dt, '%m-%d') AS date, monthname(dt) || ' ' || day(dt) AS chapter_ref, 'THE TITLE OF ' || min(doc_id) AS title, min_by(body, doc_id) AS text FROM pg WHERE day(dt) % 5 <> 0 GROUP BY dt)"""
CLIP_INPUT = "i AS (SELECT id, text, ['in the', 'tiona', 'der'] AS terms, 8 AS context FROM passages)"


def oracle_sql() -> dict[str, str]:
    strict, observed = matches_sql(BENCH_PHRASES, strict=True), matches_sql(BENCH_PHRASES, fuzzy=True)
    pairs = lambda sql: sql + "\nSELECT query_id, id FROM matches"
    return {
        "sources_enabled": f"WITH {SOURCES_SQL} SELECT id, title, display_mode, context_words, sort_order FROM sources WHERE enabled",
        "source_cards": f"""WITH {SOURCES_SQL} SELECT id, title, CASE copyright WHEN 'public-domain' THEN 'Public domain' ELSE 'Protected' END AS copyright, CASE display_mode WHEN 'full-text' THEN 'Full text' WHEN 'snippet' THEN 'Snippet' ELSE 'Concordance only' END AS display_mode,
            CASE WHEN NOT enabled THEN 'Soon' WHEN display_mode = 'full-text' THEN 'Full-Text' WHEN display_mode = 'snippet' THEN 'Snippet' ELSE 'Concordance' END AS status FROM sources""",
        "passage_counts": f"WITH {PASSAGES_SQL} SELECT source_id, count(*) AS passages FROM passages GROUP BY ROLLUP (source_id)",
        "postings_tf": f"WITH {PASSAGES_SQL}, {PLACES_SQL} SELECT term, field, count(DISTINCT id) AS passages, count(*) AS times FROM places GROUP BY term, field",
        "postings_top_terms": f"WITH {PASSAGES_SQL}, {TOKENS_SQL} SELECT term, count(*) AS passages FROM toks GROUP BY term ORDER BY passages DESC, term LIMIT 50",
        "index_version": f"""WITH {PASSAGES_SQL}, h AS (SELECT source_id, count(*) AS passages, sum(CAST(('0x' || substr(sha256(id || chr(1) || coalesce(title, '') || chr(1) || coalesce(chapter_ref, '') || chr(1) || text), 1, 12)) AS BIGINT)) AS s FROM passages GROUP BY source_id)
            SELECT source_id, passages, substr(sha256(passages || ':' || s), 1, 16) AS version FROM h""",
        "registry_version": f"WITH {SOURCES_SQL} SELECT substr(sha256(string_agg(id || ':' || title || '|' || display_mode || '|' || copyright || chr(10), '' ORDER BY id)), 1, 16) AS version FROM sources",
        "query_parse": f"""WITH q AS (SELECT item_id AS query_id, 'fear "' || substr(text, 1, length(text) // 2) || '" ' || substr(text, length(text) // 2 + 1) AS q FROM benchmark), {parse_sql()}
            SELECT query_id AS item_id, array_to_string(phrases, '|') AS phrases, array_to_string(keywords, '|') AS keywords,
            array_to_string(list_transform(list_filter(list_transform(list_concat(phrases, keywords), lambda x, i: {{'x': lower(x), 'i': i}}), lambda e: list_position(list_transform(list_concat(phrases, keywords), lambda y: lower(y)), e.x) = e.i), lambda e: e.x), '|') AS terms FROM p""",
        "search_keyword_and": pairs(matches_sql(batch_sql("the of", "Chapter thion", "nicht  und"), fuzzy=True)),
        "search_fuzzy": pairs(matches_sql(batch_sql("thionn eree", "queenele", "to"), fuzzy=True)),
        "search_phrase_observed": pairs(observed),
        "search_phrase_strict": pairs(strict),
        "search_multi_phrase": pairs(matches_sql(batch_sql('"nicht ein" "elle de"', '"erst"'))),
        "search_phrase_and_keyword": pairs(matches_sql(batch_sql('"the of" erst', '" " erst', '"in the" "de la" to'), fuzzy=True)),
        "search_synonyms": matches_sql(batch_sql("thion", "Erst the", '"thion"'), synonyms=True, fuzzy=True) + "\nSELECT query_id, id, by_synonym FROM matches",
        "search_grouped": GROUPED_SQL,
        "search_source_filter_order": matches_sql(batch_sql("the erst", "nicht"), fuzzy=True, passages=INDEXED)
        + """, f AS (SELECT * FROM (VALUES ('q0', 'src3', 0), ('q0', 'src1', 1), ('q0', 'src9', 2), ('q1', 'src2', 0), ('q1', 'src0', 1)) AS v(query_id, source_id, group_pos))
            SELECT m.query_id, group_pos, row_number() OVER (PARTITION BY m.query_id, passages.source_id ORDER BY sequence, passages.id) AS pos, passages.source_id, passages.id AS passage_id
            FROM matches m JOIN passages ON m.id = passages.id JOIN f ON f.query_id = m.query_id AND f.source_id = passages.source_id""",
        "search_topics_batch": matches_sql("q AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{t.lower()}')" for t in ad.TOPICS) + ") AS v(query_id, q))", fuzzy=True) + "\nSELECT query_id, count(*) AS result_count FROM matches GROUP BY query_id",
        "kwic_clip": f"WITH {PASSAGES_SQL}, {CLIP_INPUT}, {clip_steps('i')} SELECT id, clip AS kwic FROM cl",
        "kwic_full": f"WITH {PASSAGES_SQL} SELECT id, {highlight_sql('text', repr(['in', 'inn.', 'the', 'é', '&']))} AS kwic FROM passages",
        "citations": f"""WITH {PASSAGES_SQL}, {SOURCES_SQL} SELECT passages.id, CASE WHEN display_mode = 'full-text' THEN text || chr(10) || chr(10) || '— ' || s.title || ', ' || chapter_ref || ', ' || page_ref END AS citation FROM passages JOIN sources s ON s.id = source_id""",
        "exception_hints": "WITH q AS (SELECT conv_id || '-' || turn AS query_id, lower(trim(array_to_string(string_split(text, ' ')[1:2], ' '), E' \\t\\n\\r')) AS q FROM conversations), e AS (SELECT * FROM (VALUES "
        + ", ".join(f"({quoted(t)}, {quoted(x.lower())})" for t, m in ad.EXCEPTIONS for x in m) + ") AS v(title, m)) SELECT DISTINCT query_id, title, 'About ' || title AS body FROM q JOIN e ON q <> '' AND (contains(q, m) OR contains(m, q))",
        "adjacent_passages": "SELECT conv_id AS source_id, conv_id || '-' || turn AS id, turn AS sequence, lag(conv_id || '-' || turn) OVER w AS previous_id, lead(conv_id || '-' || turn) OVER w AS next_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, conv_id || '-' || turn)",
        "passage_lookup": f"WITH {PASSAGES_SQL} SELECT id, source_id, sequence, text FROM passages WHERE id = 'doc-7' AND source_id = 'src7'",
        "page_carry_forward": f"WITH {ad.marked_sql()}, {BLOCKS_SQL} SELECT doc_id, block_pos, page, md5(block) AS block FROM blocks",
        "segment_paragraphs": f"""WITH RECURSIVE {ad.marked_sql()}, {BLOCKS_SQL}, {PARAS_SQL}, long AS (SELECT * FROM paras WHERE {N_WORDS_SQL % 'text'} > 300), {split_ctes('long', 'doc_id, seq, page')},
every AS (SELECT doc_id, seq, page, 0 AS part, text FROM paras WHERE {N_WORDS_SQL % 'text'} <= 300 UNION ALL SELECT doc_id, seq, page, part, text FROM parts WHERE {N_WORDS_SQL % 'text'} >= 20)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq, part) AS INT) AS seq, 'p.' || page AS page_ref, md5(text) AS text FROM every""",
        "chapter_assign": CHAPTERED_SQL,
        "chapter_distribution": f"SELECT chapter_ref, count(*) AS passages FROM ({CHAPTERED_SQL}) GROUP BY chapter_ref",
        "strip_headers": STRIP_SQL,
        "normalize_text": NORMALIZE_SQL,
        "hyphen_decisions": f"WITH {CANDIDATES_SQL}, {DECIDED_SQL % (quoted('tion') + ', ' + quoted('being'), quoted('tion-x') + ', ' + quoted('ti-on'))} SELECT doc_id, place, left_ AS \"left\", right_ AS \"right\", decision, CASE WHEN decision IN ('dict match', 'default join') THEN left_ || right_ ELSE left_ || '-' || right_ END AS replacement FROM decided",
        "hyphen_counts": f"WITH {CANDIDATES_SQL}, {DECIDED_SQL % (quoted('?'), quoted('?'))} SELECT count(*) AS total, count(*) FILTER (decision = 'default join') AS joined, count(*) FILTER (decision <> 'default join') AS kept, count(*) FILTER (decision = 'default join') AS defaulted FROM decided",
        "hyphen_repair": REPAIR_SQL,
        "passage_ids": f"SELECT doc_id, source || '-' || {CHAPTER_SLUG_SQL} || '-p' || printf('%04d', doc_id) AS id, {SLUG_SQL} AS slug FROM (SELECT *, 'Chapter ' || (doc_id % 9) || ' — How It’s  Done -- in ' || lang AS chapter FROM documents)",
        "validate_passages": f"""WITH {FAULTY_SQL}, {SOURCES_SQL}, m AS (SELECT *, id <> '' AND row_number() OVER (PARTITION BY source_id, id ORDER BY sequence) > 1 AS again FROM faulty), r AS (
            SELECT id AS row, 'id must be a non-empty string' AS rule FROM m WHERE id = '' UNION ALL SELECT id, 'duplicate id' FROM m WHERE again UNION ALL SELECT id, 'title must be a string' FROM m WHERE title IS NULL
            UNION ALL SELECT id, 'text must be a non-empty string' FROM m WHERE trim(text, E' \\n\\t\\r') = '' UNION ALL SELECT id, 'sourceId must match registry id' FROM m WHERE source_id NOT IN (SELECT id FROM sources)) SELECT row, rule, count(*) AS times FROM r GROUP BY row, rule""",
        "validate_registry": f"""WITH {SOURCES_SQL}, f AS (SELECT CASE WHEN sort_order = 6 THEN 'src5' ELSE id END AS id, sort_order AS n, CASE WHEN sort_order % 5 = 2 THEN NULL ELSE copyright END AS copyright FROM sources), m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) > 1 AS again FROM f)
            SELECT id AS row, 'duplicate id' AS rule FROM m WHERE again UNION ALL SELECT id, 'displayMode is unknown' FROM m WHERE n % 4 = 1 UNION ALL SELECT id, 'copyright is unknown' FROM m WHERE copyright IS NULL UNION ALL SELECT id, 'enabled must be a boolean' FROM m WHERE n = 3""",
        "validate_final": f"""WITH {FAULTY_SQL}, f AS (SELECT * FROM faulty WHERE id <> ''), g AS (SELECT source_id, sequence, row_number() OVER (PARTITION BY source_id ORDER BY sequence, id) AS e FROM f), r AS (
            SELECT source_id || '#' || min(e) AS row, 'sequence has a gap' AS rule FROM g WHERE sequence <> e GROUP BY source_id UNION ALL SELECT id, 'duplicate id' FROM f GROUP BY id HAVING count(*) > 1
            UNION ALL SELECT id, 'text is blank' FROM f WHERE trim(text, E' \\n\\t\\r') = '' UNION ALL SELECT id, 'text has a line end' FROM f WHERE contains(text, chr(10))) SELECT row, rule, count(*) AS times FROM r GROUP BY row, rule""",
        "audit_flags": f"""WITH {PASSAGES_SQL}, m AS (SELECT id, CAST(len({WORDS_SQL % 'text'}) AS INT) AS n_words, CAST(len(regexp_extract_all(text, '[^a-zA-Z\\s]')) AS INT) AS non_alpha, CAST(length(text) AS INT) AS n_chars FROM passages),
            f AS (SELECT *, CASE WHEN n_words BETWEEN 20 AND 29 THEN 'short' WHEN n_chars > 0 AND non_alpha / n_chars > 0.05 THEN 'non-alpha' END AS flag FROM m) SELECT id, flag, n_words, non_alpha, n_chars FROM f WHERE flag IS NOT NULL""",
        "audit_unknown_words": f"""WITH {PASSAGES_SQL}, {TOKENS_SQL}, known AS (SELECT term FROM toks GROUP BY term HAVING count(*) >= 20), w AS (SELECT id, unnest(range(0, len(x))) AS pos, unnest(x) AS word FROM (SELECT id, {WORDS_SQL % 'text'} AS x FROM passages)),
            u AS (SELECT * FROM w WHERE length(word) > 3 AND word <> upper(word) AND lower(word) NOT IN (SELECT term FROM known))
            SELECT id, count(*) AS n_unknown, array_to_string(list_slice(list(word ORDER BY pos), 1, 5), ' ') AS first_unknown FROM u GROUP BY id HAVING count(*) >= 3""",
        "audit_top_words": f"""WITH {PASSAGES_SQL}, w AS (SELECT sequence, id, unnest(range(0, len(x))) AS pos, unnest(x) AS word FROM (SELECT sequence, id, {WORDS_SQL % 'lower(text)'} AS x FROM passages))
            SELECT word, count(*) AS times FROM w GROUP BY word ORDER BY times DESC, min((sequence, id, pos)) LIMIT 20""",
        "html_extract": r"""WITH x AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title,
            trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages)
            SELECT page_id, coalesce(nullif(title, ''), 'Daily Reflection') AS title, nullif(text, '') AS text FROM x""",
        "daily_calendar": f"WITH {DAILY_PAGES_SQL} SELECT strftime(d, '%m-%d') AS date, monthname(d) || ' ' || day(d) AS label, count(doc_id) FILTER (day(d) % 5 <> 0) AS pages FROM cal LEFT JOIN pg ON dt = d GROUP BY d",
        "daily_parse": f"WITH {DAILY_PAGES_SQL} SELECT 'dr-' || date AS id, title, row_number() OVER (ORDER BY date) AS sequence, date, chapter_ref, md5(text) AS text FROM good",
        "resume_missing": f"WITH {DAILY_PAGES_SQL} SELECT strftime(d, '%m-%d') AS date FROM cal WHERE strftime(d, '%m-%d') NOT IN (SELECT date FROM good)",
        "raw_overlap": f"""WITH {SOURCES_SQL}, f AS (SELECT * FROM (VALUES ('src1-part.txt'), ('Source 12.pdf'), ('notes.md'), ('SRC3.html'), ('source-seven (final).txt')) AS v(name)),
            r AS (SELECT name, regexp_replace(regexp_replace(lower(regexp_replace(name, '\\.[^.]*$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS raw_slug FROM f), s AS (SELECT id, id AS entry_slug, replace(lower(title), ' ', '-') AS title_slug, id || ' ' || title || ' ' || short_title AS a FROM sources)
            SELECT name, id, raw_slug, entry_slug, title_slug, CAST(len(list_intersect(list_distinct(regexp_extract_all(raw_slug, '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(entry_slug || ' ' || title_slug || ' ' || a), '[a-z0-9]+')))) AS INT) AS overlap FROM r, s""",
        "log_sanitize": f"""WITH {LOG_SQL}, x AS (SELECT ts, CASE WHEN CAST(key AS BIGINT) % 11 = 0 THEN repeat(q, 200) ELSE q END AS q, result_count, source_filter FROM log)
            SELECT ts, substr(q, 1, 500) AS q, greatest(result_count, 0) AS result_count, coalesce(array_to_string(list_filter(source_filter, lambda x: x IS NOT NULL), ', '), 'all') AS source_filter FROM x WHERE trim(q, E' \\t\\n') <> ''""",
        "log_fifo": f"WITH {LOG_SQL} SELECT key, ts, q FROM log ORDER BY key DESC LIMIT 100",
        "stats_queries": f"WITH {LOG_SQL} SELECT lower(q) AS norm, min_by(q, key) AS q, count(*) AS count, sum(result_count) AS total_results, max_by(ts, key) AS last_seen FROM asked GROUP BY 1",
        "stats_top_queries": f"WITH {LOG_SQL}, g AS (SELECT lower(q) AS norm, min_by(q, key) AS q, count(*) AS count, sum(result_count) AS total_results, max_by(ts, key) AS last_seen FROM asked GROUP BY 1) SELECT q, count, total_results, last_seen FROM g ORDER BY count DESC, lower(q) LIMIT 10",
        "stats_recent": f"WITH {LOG_SQL} SELECT key, ts, q, result_count, coalesce(array_to_string(source_filter, ', '), 'all') AS source_filter FROM asked ORDER BY ts DESC, key LIMIT 20",
        "stats_filter_usage": f"WITH {LOG_SQL} SELECT source_id, count(*) AS count FROM (SELECT unnest(source_filter) AS source_id FROM asked) WHERE trim(source_id, E' \\t\\n') <> '' GROUP BY source_id",
        "stats_summary": f"WITH {LOG_SQL} SELECT count(*) AS total_records, min(ts) AS oldest_ts, max(ts) AS latest_ts FROM asked",
        "teasers": rf"""WITH {PASSAGES_SQL}, c AS (SELECT id, text, substr(text, 1, 60) AS cut, regexp_extract(substr(text, 1, 60), '(?s)^(.+) [^ ]*$', 1) AS s FROM passages) SELECT id, CASE WHEN length(text) > 60 THEN CASE WHEN s <> '' THEN s ELSE cut END || '…' ELSE text END AS teaser FROM c""",
        "log_stream": "SELECT event_type AS q, count(*) AS records, sum(greatest(floor(value), 0)) AS results FROM events WHERE trim(event_type) <> '' GROUP BY event_type",
    }
