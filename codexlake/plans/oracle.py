"""DuckDB SQL for the registered queries, on the same tables."""

from __future__ import annotations

from codexlake.functions import rules as R
from codexlake.operators import corpus
from codexlake.plans import incremental
from codexlake.plans.queries import SALT
from codexlake.streaming import state

_STOP = ", ".join(f"'{w}'" for w in corpus.STOPWORDS)
_ASCII = "trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z ]', '', 'g'), ' +', ' ', 'g'))"
_FOLD = "lower(strip_accents(replace(replace(replace({0}, 'ä', 'ä'), 'ö', 'ö'), 'ü', 'ü')))"
_PARTICLES = "('von','van','de','di','da','der','zu','zer','im','am','the','of','und')"


def _norm(c: str) -> str:
    return f"array_to_string(list_filter(string_split_regex(lower(strip_accents({c})), '\\s+'), lambda t: t <> '' AND t NOT IN {_PARTICLES}), ' ')"


_TERMS = """
    words AS (SELECT doc_id, unnest(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS w,
                     generate_subscripts(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> ''), 1) AS i FROM documents),
    terms AS (SELECT doc_id, i, trim(lower(w), '.,;:''"§$%()[]{}–—') AS term FROM words),
    counted AS (SELECT * FROM terms WHERE length(term) > 2 AND NOT regexp_full_match(term, '[0-9]+'))"""
_READINGS = f"readings AS (SELECT * FROM (SELECT conv_id, turn, {_ASCII} AS text FROM conversations) WHERE text <> '')"
_ALL_READINGS = f"readings AS (SELECT conv_id, turn, {_ASCII} AS text FROM conversations)"
_CER = "CASE WHEN length({0}) = 0 THEN CASE WHEN length({1}) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein({0}, {1}) / length({0}) END"
_PAIRS = f"{_READINGS}, pairs AS (SELECT a.conv_id, a.turn AS a, b.turn AS b, CAST({_CER.format('a.text', 'b.text')} AS DOUBLE) AS cer FROM readings a JOIN readings b ON a.conv_id = b.conv_id AND a.turn < b.turn)"
_ENGINES = f"""{_ALL_READINGS}, cers AS (SELECT r.conv_id, 'engine' || r.turn AS engine, r.turn AS ord, CAST({_CER.format('f.text', 'r.text')} AS DOUBLE) AS cer
    FROM readings r JOIN readings f ON f.conv_id = r.conv_id AND f.turn = 0 WHERE r.turn > 0)"""
_LATEST = """latest AS (SELECT json_extract_string(props, '$.k') AS doc, user_id AS voter, arg_max(event_type, event_id) AS candidate, max(event_id) AS ord FROM events GROUP BY 1, 2)"""
_TALLY = f"{_LATEST}, tally AS (SELECT doc, candidate, count(*) AS votes FROM latest GROUP BY 1, 2)"
_OVERRIDES = "overrides AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS inferred FROM events)"
_JUDGED = "judged AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"
_OFFERED = """offered AS (SELECT conv_id, 'turn/' || arg_max(turn, length(coalesce(text, '')) * 1000 - turn) AS best, count(*) AS n FROM conversations GROUP BY 1),
    compared AS (SELECT c.conv_id, c.conv_id % 2 AS bucket, o.best AS winner, 'turn/' || c.turn AS loser, CASE WHEN o.n > 4 THEN 0.5 ELSE 1.0 END AS weight
                 FROM conversations c JOIN offered o USING (conv_id) WHERE c.conv_id % 7 <> 0 AND 'turn/' || c.turn <> o.best)"""

_SLUG = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', '-', 'g'), '-')"
_INDEX = f"""mentions AS (SELECT p_partkey AS ord, p_brand AS doc_id, p_name AS name, p_type AS type, CASE WHEN p_partkey % 9 = 0 THEN 'g' || (p_partkey % 45) ELSE '' END AS gnd,
        'h' || p_size AS hls, CAST(p_size AS VARCHAR) AS context, {_norm('p_name')} AS norm FROM part),
    keyed AS (SELECT *, CASE WHEN gnd <> '' THEN 'gnd-' || gnd ELSE norm || chr(9) || type END AS key FROM mentions),
    merged AS (SELECT key, CASE WHEN max(gnd) <> '' THEN arg_max(name, length(name) * 1000000 - ord) ELSE arg_min(name, ord) END AS name, arg_min(type, ord) AS type, arg_min(gnd, ord) AS gnd,
        arg_min(hls, ord) AS hls0, min(ord) AS first_ord, count(DISTINCT doc_id || chr(9) || context) AS n_mentions, count(DISTINCT doc_id) AS n_docs FROM keyed GROUP BY key),
    based AS (SELECT *, CASE WHEN gnd <> '' THEN key ELSE {_SLUG.format('name')} END AS base FROM merged),
    idx AS (SELECT key, CASE WHEN row_number() OVER w > 1 THEN base || '-' || row_number() OVER w ELSE base END AS slug, name, type, gnd, CASE WHEN gnd <> '' THEN hls0 ELSE '' END AS hls,
        '' AS wikidata, n_docs, n_mentions, first_ord FROM based WINDOW w AS (PARTITION BY base ORDER BY first_ord))"""

_PERSONS = f"""persons AS (SELECT p_partkey AS pid, CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS source, p_name || ' ' || (p_partkey % 25) AS name,
        CASE WHEN p_size > 10 THEN p_size * 20 + 1000 END AS lo, CASE WHEN p_size > 10 THEN (p_size * 20 + 1000) || '-' || (p_size * 20 + 1005) END AS life_dates,
        CASE WHEN p_partkey % 10 = 0 THEN p_brand END AS gnd_id, p_type FROM part),
    named AS (SELECT *, {_norm("name")} AS norm FROM persons),
    edges AS (SELECT DISTINCT a.pid AS a, b.pid AS b, CASE WHEN a.gnd_id = b.gnd_id THEN 'high' WHEN a.lo IS NULL OR b.lo IS NULL THEN 'medium' ELSE 'high' END AS confidence
        FROM named a JOIN named b ON a.pid < b.pid AND (a.gnd_id = b.gnd_id OR a.norm = b.norm AND coalesce(a.lo - 25 <= b.lo + 5 AND b.lo - 25 <= a.lo + 5, true)))"""
_COMPONENTS = f"""{_PERSONS}, links AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
    reach AS (SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
    comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""

_SCRIPT = "CASE {0} WHEN 'gotische textura' THEN 'textura' WHEN 'blackletter' THEN 'fraktur' WHEN 'deutsche kurrent' THEN 'kurrent' ELSE '' END"
_RANKED = f"""models AS (SELECT 'm' || p_partkey AS model_id, p_partkey AS ordinal, ['textura','fraktur','kurrent','bastarda','kursive'][p_size % 5 + 1] AS m_script,
        ['de','la','fr','mul'][p_partkey % 4 + 1] AS m_lang, p_size % 6 + 12 AS c1, p_size % 6 + 13 AS c2, CASE WHEN p_size > 25 THEN 'medieval register' ELSE 'modern' END AS notes FROM (SELECT min(p_partkey) AS p_partkey, max(p_size) AS p_size FROM part GROUP BY p_brand, p_type)),
    criteria AS (SELECT doc_id, {_SCRIPT.format("['gotische textura','blackletter','deutsche kurrent',''][doc_id % 4 + 1]")} AS script, lang, doc_id % 7 + 11 AS century, doc_id % 5 = 0 AS charter FROM documents),
    raw AS (SELECT c.doc_id, m.model_id, m.ordinal, m.notes,
        CASE WHEN c.script = '' THEN 0 WHEN c.script = m.m_script THEN 60 WHEN contains(c.script, m.m_script) OR contains(m.m_script, c.script) THEN 30 ELSE -35 END
        + CASE WHEN c.lang = m.m_lang THEN 30 WHEN contains(c.lang, m.m_lang) OR contains(m.m_lang, c.lang) THEN 15 ELSE 0 END
        + CASE WHEN abs(c.century - c1) <= 1 OR abs(c.century - c2) <= 1 THEN 20 WHEN abs(c.century - c1) <= 2 OR abs(c.century - c2) <= 2 THEN 10 ELSE 0 END
        + CASE WHEN c.charter AND contains(m.notes, 'register') THEN 10 ELSE 0 END AS s FROM criteria c CROSS JOIN models m),
    scored AS (SELECT doc_id, model_id, ordinal, greatest(0, least(100, CASE WHEN s = 0 AND contains(notes, 'medieval') THEN 5 ELSE s END)) AS score FROM raw),
    ranked AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal) AS rank, model_id, score FROM scored)"""

_GRAPH = f"""{_JUDGED}, picked AS (SELECT * FROM judged WHERE quality = 1),
    graph AS (
        SELECT 'doc:' || doc_id AS s, 'rdf:type' AS p, 'crm:E31_Document' AS o, 'iri' AS kind FROM judged
        UNION SELECT 'doc:' || doc_id, 'rdfs:label', CAST(doc_id AS VARCHAR), 'literal' FROM judged
        UNION SELECT 'doc:' || doc_id, 'dc:lang', lang, 'literal' FROM judged
        UNION SELECT 'reading:' || doc_id || '/' || source, 'rdf:type', 'crm:E33_Linguistic_Object', 'iri' FROM judged
        UNION SELECT 'reading:' || doc_id || '/' || source, 'prov:wasGeneratedBy', 'run:' || doc_id || '/' || source, 'iri' FROM judged
        UNION SELECT 'doc:' || doc_id, 'crm:P128_carries', 'reading:' || doc_id || '/' || source, 'iri' FROM judged
        UNION SELECT 'run:' || doc_id || '/' || source, 'rdf:type', 'prov:Activity', 'iri' FROM judged
        UNION SELECT 'run:' || doc_id || '/' || source, 'prov:wasAssociatedWith', 'model:model-' || source, 'iri' FROM judged
        UNION SELECT 'model:model-' || source, 'rdf:type', 'prov:SoftwareAgent', 'iri' FROM judged
        UNION SELECT 'model:model-' || source, 'rdfs:label', 'model-' || source, 'literal' FROM judged
        UNION SELECT 'selection:' || doc_id, 'rdf:type', 'prov:Entity', 'iri' FROM picked
        UNION SELECT 'selection:' || doc_id, 'prov:wasAttributedTo', 'agent:' || lang, 'iri' FROM picked
        UNION SELECT 'selection:' || doc_id, 'prov:generatedAtTime', '2024-01-01', 'literal' FROM picked
        UNION SELECT 'doc:' || doc_id, 'ex:closestReading', 'selection:' || doc_id, 'iri' FROM picked
        UNION SELECT 'selection:' || doc_id, CASE WHEN toxic = 1 THEN 'prov:wasDerivedFrom' ELSE 'ex:endorses' END, 'reading:' || doc_id || '/' || source, 'iri' FROM picked)"""

_FIELDS = ", ".join(f"'{f}'" for f in state.INVALIDATION)
_INPUTS = f"inputs AS (SELECT user_id AS doc_id, [{_FIELDS}][event_id % {len(state.INVALIDATION)} + 1] AS field, event_type AS value, event_id AS ord FROM events)"
_MATRIX = ", ".join(f"('{f}', '{s}', '{m}')" for f, (dirty, stale) in state.INVALIDATION.items() for m, stages in (("dirty", dirty), ("stale", stale)) for s in stages)
_STAGES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(state.STAGES))
_LANGUAGE = " ".join(f"WHEN contains(s, '{x}') THEN '{R.LANGUAGES[x]}'" for x in sorted(R.LANGUAGES, key=len, reverse=True))


def _rate(hits: str) -> str:
    return f"CAST(count(*) FILTER ({hits}) AS BIGINT)"


def _sets(level: str, columns: list[str], rows: str, hit: str, total: str, hits: str) -> str:
    others = [c for c in ("bucket", "day", "engine") if c in columns]
    cols = ", ".join(c if c == level else f"CAST(NULL AS VARCHAR) AS {c}" for c in others)
    group = f"GROUP BY {level}" if level != "overall" else ""
    return f"SELECT '{level}' AS level, {cols}, count(*) AS {total}, {_rate('WHERE ' + hit)} AS {hits}, {_rate('WHERE ' + hit)} / count(*) AS rate FROM {rows} {group}"


_SELECTIONS = f"""{_OVERRIDES}, selections AS (SELECT inferred AS auto_pick, event_type AS bucket, event_type, value, inferred AS engine, strftime(ts, '%Y-%m-%d') AS day FROM overrides),
    agreeing AS (SELECT *, auto_pick = event_type OR (value > 50 AND auto_pick = 'view') AS agreed FROM selections WHERE event_type <> 'error' AND auto_pick IS NOT NULL),
    decided AS (SELECT *, event_type <> 'error' AS accepted FROM selections)"""

def _regret(by: str, rows: str) -> str:
    """Percentiles of v per group of the table e that ``rows`` lays down."""
    return f"""WITH {rows},
        r AS (SELECT {by}, v, row_number() OVER (PARTITION BY {by} ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY {by}) AS n FROM e WHERE v IS NOT NULL)
        SELECT e.{by}, coalesce(max(m.n), 0) AS measured, max(u.unmeasurable) AS unmeasurable, max(m.median_regret) AS median_regret, max(m.p90) AS p90_regret, max(m.top) AS max_regret
        FROM (SELECT DISTINCT {by} FROM e) e
        JOIN (SELECT {by}, count(*) FILTER (WHERE v IS NULL) AS unmeasurable FROM e GROUP BY 1) u USING ({by})
        LEFT JOIN (SELECT {by}, max(n) AS n, median(v) AS median_regret, max(CASE WHEN r = least(n - 1, round_even(0.9 * (n - 1), 0)) THEN v END) AS p90, max(v) AS top FROM r GROUP BY 1) m USING ({by}) GROUP BY 1"""


_REVIEW = """m AS (SELECT p_brand AS doc_id, p_partkey AS ord, trim(p_name) AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth FROM part WHERE p_partkey % 2 = 0 AND (p_partkey % 3 = 0 OR p_partkey % 5 = 0))"""
_DUMP = """dump AS (SELECT string_split(p_name, ' ')[1] AS name, p_type AS variant, CASE p_partkey % 3 WHEN 0 THEN 'place' WHEN 1 THEN 'person' END AS type, min(p_partkey) AS ord FROM part GROUP BY 1, 2, 3),
    names AS (SELECT 'a' || ord AS id, name, ord, lower(unnest([name, variant])) AS low FROM dump WHERE coalesce(type, '') IN ('', 'person')),
    q AS (SELECT DISTINCT p_name AS query, lower(trim(p_name)) AS t FROM part),
    hits AS (SELECT DISTINCT query, id, name, ord FROM q JOIN names ON t = low OR (length(low) >= 4 AND (contains(t, low) OR contains(low, t)))),
    found AS (SELECT query, id, name, row_number() OVER (PARTITION BY query ORDER BY ord, id) AS nth FROM hits)"""

SQL: dict[str, str] = {
    "corpus_term_stats": f"""WITH {_TERMS} SELECT (SELECT count(*) FROM documents) AS doc_count, (SELECT count(*) FROM words) AS total_words,
        (SELECT count(DISTINCT term) FROM counted) AS total_unique_words, (SELECT CAST(sum(length(text)) AS BIGINT) FROM documents) AS total_chars""",
    "corpus_top_terms": f"""WITH {_TERMS}, freq AS (SELECT term, count(*) AS freq, min((doc_id, i)) AS first FROM counted WHERE term NOT IN ({_STOP}) GROUP BY term)
        SELECT CAST(row_number() OVER (ORDER BY freq DESC, first) AS INTEGER) AS rank, term, freq FROM freq ORDER BY freq DESC, first LIMIT 30""",
    "doc_quality_flags": r"""WITH chars AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\S')) AS c FROM documents) GROUP BY 1, 2),
        alphabet AS (SELECT doc_id, max(n) AS top, sum(n) AS total, count(*) AS distinct_chars FROM chars GROUP BY 1),
        parts AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '') AS words,
            list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> '') AS lines FROM documents),
        flags AS (SELECT p.doc_id, p.text, a.total IS NOT NULL AND (a.top > 0.6 * a.total OR a.distinct_chars < 12
            OR len(list_filter(p.lines, lambda l: replace(l, l[1], '') = '')) > 0.7 * len(p.lines)
            OR (length(p.text) >= 30 AND len(list_distinct(p.words)) < 0.15 * len(p.words))) AS degenerate FROM parts p LEFT JOIN alphabet a USING (doc_id)),
        trimmed AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM flags)
        SELECT doc_id, degenerate, CAST(CASE WHEN t = '' THEN 0.0 WHEN len(regexp_extract_all(t, '\p{L}')) < 0.1 * length(t) THEN 0.2 WHEN length(t) < 20 THEN 0.3 WHEN degenerate THEN 0.1 ELSE 0.8 END AS DOUBLE) AS quality FROM trimmed""",
    "doc_chunks": """WITH steps AS (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 500 THEN 1 ELSE (length(text) - 1) // 450 + 1 END)) AS nth FROM documents)
        SELECT doc_id, CAST(nth AS INTEGER) AS nth, CAST(nth * 450 AS INTEGER) AS start, substr(text, nth * 450 + 1, 500) AS chunk FROM steps""",
    "search_index": "SELECT doc_id, substr(coalesce(text, ''), 1, 300) AS snippet, lang, source FROM documents",
    "catalogue_search": """SELECT doc_id, source FROM (SELECT *, lower(strip_accents(concat_ws(' ', lang, source, substr(coalesce(text, ''), 1, 300)))) AS hay FROM documents)
        WHERE contains(hay, 'the') AND contains(hay, 'src1') AND contains(hay, 'en')""",
    "storage_overview": "SELECT source AS grp, count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS bytes, CAST(floor(sum(length(text)) / 4) AS BIGINT) AS est_tokens FROM documents GROUP BY 1",
    "run_totals": "SELECT event_type, count(*) AS runs, CAST(sum(user_id) AS BIGINT) AS seconds, CAST(sum(length(props)) AS BIGINT) AS tokens, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1",
    "text_functions": rf"""SELECT p_partkey, {_SLUG.format('p_name')} AS slug, {_norm('p_name')} AS norm,
        array_to_string(list_filter(string_split_regex(lower(p_type), '[^\w]+'), lambda t: t <> '' AND t NOT IN {_PARTICLES}), ' ') AS person_norm,
        array_to_string(list_transform(string_split(trim(regexp_replace(lower(p_name || ',  ' || p_brand), '\s+', ' ', 'g')), ' '), lambda t: trim(t, '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~')), ' ') AS tokens FROM part""",
    "language_scripts": f"""WITH stated AS (SELECT doc_id, text, lang, lower('Sprache: ' || CASE lang WHEN 'de' THEN 'Mittelhochdeutsch' WHEN 'fr' THEN 'Altfranzösisch' WHEN 'es' THEN 'spanisch' ELSE 'unknown' END) AS s FROM documents)
        SELECT doc_id, CASE {_LANGUAGE} ELSE '' END AS code, false AS implausible FROM stated""",
    "years_and_centuries": """WITH y AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS a, CAST(year(o_orderdate) + o_custkey % 400 AS INTEGER) AS b FROM orders)
        SELECT o_orderkey, least(a, b) AS lo, greatest(a, b) AS hi, CAST(round_even(((a // 100 + 1) + (b // 100 + 1)) / 2, 0) AS INTEGER) AS century FROM y""",
    "tolerant_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(1 AS INTEGER) AS objects FROM events",
    "pairwise_cer": f"WITH {_PAIRS} SELECT * FROM pairs",
    "max_pairwise_cer": f"WITH {_PAIRS} SELECT conv_id, max(cer) AS max_cer, count(*) AS pairs FROM pairs GROUP BY 1",
    "max_symmetric_cer": f"WITH {_READINGS} SELECT a.conv_id, max(CAST({_CER.format('a.text', 'b.text')} AS DOUBLE)) AS max_cer FROM readings a JOIN readings b ON a.conv_id = b.conv_id AND a.turn <> b.turn GROUP BY 1",
    "gate_blocked": f"WITH {_PAIRS} SELECT conv_id, max(cer) > 0.8 AS block FROM pairs GROUP BY 1",
    "cer_best_engine": f"WITH {_ENGINES} SELECT conv_id, arg_min(engine, (cer, ord)) AS best_engine, min(cer) AS best_cer FROM cers GROUP BY 1",
    "cer_engine_means": f"WITH {_ENGINES} SELECT engine, round(sum(cer) / (SELECT count(DISTINCT conv_id) FROM cers), 6) AS mean_cer FROM cers GROUP BY 1",
    "page_quality": f"WITH {_ENGINES} SELECT conv_id, round(avg(greatest(0.0, least(1.0, 1 - cer))), 9) AS qa_score FROM cers GROUP BY 1",
    "token_offsets": """WITH t AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '')) AS token, generate_subscripts(list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> ''), 1) - 1 AS pos FROM conversations)
        SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, token, CAST(coalesce(sum(length(token) + 1) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_start FROM t""",
    "votes_latest": f"WITH {_LATEST} SELECT * FROM latest",
    "votes_tally": f"WITH {_TALLY} SELECT * FROM tally",
    "votes_winner": f"""WITH {_TALLY}, lead AS (SELECT doc, CAST(sum(votes) AS BIGINT) AS cast_votes, max(votes) AS hi FROM tally GROUP BY 1),
        single AS (SELECT t.doc, max(candidate) AS candidate, count(*) AS n FROM tally t JOIN lead l ON l.doc = t.doc AND t.votes = l.hi GROUP BY 1)
        SELECT l.doc, cast_votes, CASE WHEN n = 1 AND cast_votes >= 3 THEN candidate END AS winner, CASE WHEN n = 1 AND cast_votes >= 3 THEN hi END AS winner_votes FROM lead l JOIN single s USING (doc)""",
    "override_rates": f"""WITH {_OVERRIDES} SELECT 'field' || (event_id % 4) AS field, count(*) AS total, count(*) FILTER (WHERE event_type IS DISTINCT FROM inferred) AS overrides,
        count(*) FILTER (WHERE event_type IS DISTINCT FROM inferred) / count(*) AS override_rate FROM overrides GROUP BY 1""",
    "selection_agreement": f"WITH {_SELECTIONS} " + " UNION ALL ".join(_sets(x, ["bucket", "engine"], "agreeing", "agreed", "decided", "agreed") for x in ("overall", "bucket", "engine")),
    "coverage_rollup": f"WITH {_SELECTIONS} " + " UNION ALL ".join(_sets(x, ["day", "engine"], "decided", "accepted", "decided", "accepted") for x in ("overall", "day", "engine")),
    "regret_percentiles": _regret("event_type", "e AS (SELECT event_type, CASE WHEN event_id % 10 > 0 THEN value END AS v FROM events)"),
    "text_regret": _regret("bucket", f"""{_ALL_READINGS}, best AS (SELECT conv_id, arg_max(turn, length(coalesce(text, '')) * 1000 - turn) AS best FROM conversations GROUP BY 1),
        e AS (SELECT b.conv_id % 3 AS bucket, CASE WHEN a.text <> '' AND h.text <> '' THEN CAST({_CER.format('a.text', 'h.text')} AS DOUBLE) END AS v
              FROM best b LEFT JOIN readings a ON a.conv_id = b.conv_id AND a.turn = 0 LEFT JOIN readings h ON h.conv_id = b.conv_id AND h.turn = b.best WHERE b.best <> 0)"""),
    "fusion_gain": f"""WITH {_ENGINES}, b AS (SELECT conv_id, min(cer) AS best_cer FROM cers GROUP BY 1), l AS (SELECT conv_id, arg_max(text, turn) AS fused FROM readings GROUP BY 1),
        f AS (SELECT l.conv_id, CASE WHEN l.fused <> '' THEN CAST({_CER.format('r.text', 'l.fused')} AS DOUBLE) END AS fused_cer FROM l JOIN readings r ON r.conv_id = l.conv_id AND r.turn = 0)
        SELECT conv_id, round(best_cer, 9) AS best_cer, round(fused_cer, 9) AS fused_cer, fused_cer < best_cer AS fusion_beats_best FROM b LEFT JOIN f USING (conv_id)""",
    "routing_prior": f"""WITH {_JUDGED}, c AS (SELECT lang, 'q' || quality AS model, count(*) AS wins, sum(count(*)) OVER (PARTITION BY lang) AS total FROM judged GROUP BY 1, 2)
        SELECT lang, model, wins, CAST(total AS BIGINT) AS total, round(least(wins / total - 0.5, 0.15), 4) AS prior_score FROM c WHERE total >= 10 AND wins / total > 0.5""",
    "model_winrates": f"""WITH {_JUDGED} SELECT lang, 'm' || quality AS model, count(*) FILTER (WHERE doc_id % 3 = 0 OR toxic = quality) AS wins, count(*) AS total,
        count(*) FILTER (WHERE doc_id % 3 = 0 OR toxic = quality) / count(*) AS win_rate FROM judged GROUP BY 1, 2""",
    "path_preferences": "SELECT CASE WHEN value > 30 THEN event_type ELSE 'vlm' END AS path, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1",
    "preference_pairs": f"WITH {_OFFERED} SELECT conv_id, bucket, winner, loser, weight FROM compared",
    "pseudonymise": f"SELECT event_id, substr(sha256('{SALT}' || user_id), 1, 16) AS voter FROM events",
    "model_topk": f"WITH {_RANKED} SELECT doc_id, CAST(rank AS INTEGER) AS rank, model_id, round(score / 100, 6) AS score FROM ranked WHERE rank <= 3",
    "routing_gate": f"""WITH {_RANKED}, g AS (SELECT doc_id, max(CASE WHEN rank = 1 THEN score END) AS top, max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END) AS gap FROM ranked WHERE rank <= 2 GROUP BY 1),
        r AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'marked uncertain' WHEN top < 40 THEN 'score too low' WHEN gap < 15 THEN 'lead too small' END AS reason FROM g)
        SELECT doc_id, reason, reason IS NOT NULL AS block, CASE WHEN reason IS NOT NULL THEN 'human' ELSE 'model' END AS decided_by FROM r""",
    "ranked_candidates": """SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY (length(text) % 5 = 0), CASE WHEN turn = 0 THEN 0 ELSE length(text) % 3 END DESC, length(text) DESC, turn) AS INTEGER) AS auto_rank FROM conversations""",
    "entity_index": f"WITH {_INDEX} SELECT * FROM idx",
    "entity_register": f"WITH {_INDEX} SELECT upper(name[1]) AS initial, count(*) AS entries, CAST(sum(n_mentions) AS BIGINT) AS mentions FROM idx GROUP BY 1",
    "entity_lookup": f"""WITH {_INDEX}, q AS (SELECT DISTINCT upper(p_name) AS query FROM part)
        SELECT query, arg_min(slug, (-n_mentions, first_ord)) AS slug FROM q JOIN idx ON {_norm('query')} = {_norm('name')} GROUP BY 1""",
    "entity_by_gnd": f"WITH {_INDEX} SELECT gnd, arg_min(slug, first_ord) AS slug FROM idx WHERE gnd <> '' GROUP BY 1",
    "entity_by_name_type": f"""WITH {_INDEX}, q AS (SELECT DISTINCT upper(p_name) AS name, p_type AS type FROM part)
        SELECT q.name, q.type, arg_min(slug, first_ord) AS slug FROM q JOIN idx ON {_norm('q.name')} = {_norm('idx.name')} AND idx.type = q.type GROUP BY 1, 2""",
    "dump_search": f"WITH {_DUMP} SELECT query, CAST(nth AS INTEGER) AS nth, id, name FROM found WHERE nth <= 5",
    "review_list": f"WITH {_REVIEW} SELECT doc_id, ord, CAST(nth AS INTEGER) AS nth FROM m WHERE nth <= 5",
    "review_items": f"""WITH {_REVIEW}, {_DUMP} SELECT m.doc_id, m.ord, m.name, coalesce(string_agg(found.id, ',' ORDER BY found.nth) FILTER (WHERE found.nth <= 3), '') AS candidates
        FROM m LEFT JOIN found ON found.query = m.name WHERE m.nth <= 5 GROUP BY 1, 2, 3""",
    "vocabulary_match": """WITH v AS (SELECT string_split(p_name, ' ')[1] AS entry, min(p_partkey) AS ord FROM part GROUP BY 1), t AS (SELECT DISTINCT p_name AS term FROM part),
        hits AS (SELECT term, entry, ord, lower(term) = lower(entry) AS equal FROM t LEFT JOIN v ON lower(term) = lower(entry) OR (length(entry) >= 4 AND (contains(lower(term), lower(entry)) OR contains(lower(entry), lower(term)))))
        SELECT term, arg_min(entry, (NOT equal, ord)) AS entry FROM hits GROUP BY 1""",
    "link_cascade": """WITH f AS (SELECT p_name AS name, min(p_brand) AS target FROM part WHERE p_size > 48 GROUP BY 1), h AS (SELECT p_name AS name, min(p_type) AS target FROM part WHERE p_size < 3 GROUP BY 1),
        x AS (SELECT p_name AS name, min(p_brand) AS target FROM part WHERE p_size = 25 GROUP BY 1)
        SELECT p_partkey, p.p_name AS name, coalesce(f.target, h.target, x.target) AS target, CASE WHEN f.target IS NOT NULL THEN 'federation' WHEN h.target IS NOT NULL THEN 'hub' WHEN x.target IS NOT NULL THEN 'dump' ELSE 'none' END AS method,
        CASE WHEN f.target IS NOT NULL THEN 'high' WHEN h.target IS NOT NULL THEN 'medium' WHEN x.target IS NOT NULL THEN 'low' ELSE 'unverified' END AS confidence
        FROM part p LEFT JOIN f ON f.name = p_name LEFT JOIN h ON h.name = p_name LEFT JOIN x ON x.name = p_name""",
    "resolve_edges": f"WITH {_PERSONS} SELECT * FROM edges",
    "resolve_components": f"WITH RECURSIVE {_COMPONENTS} SELECT node, component FROM comp",
    "resolve_merged": f"""WITH RECURSIVE {_COMPONENTS}, placed AS (SELECT n.*, coalesce(c.component, n.pid) AS cluster FROM named n LEFT JOIN comp c ON c.node = n.pid),
        strong AS (SELECT c.component, max(CASE e.confidence WHEN 'high' THEN 3 ELSE 2 END) AS r FROM edges e JOIN comp c ON c.node = e.a GROUP BY 1),
        names AS (SELECT cluster, count(DISTINCT v) AS n FROM (SELECT cluster, unnest([name, p_type]) AS v FROM placed) GROUP BY 1),
        m AS (SELECT cluster, arg_max(name, (length(name), -pid)) AS name, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, arg_min(gnd_id, pid) FILTER (WHERE gnd_id IS NOT NULL) AS gnd_id,
            arg_min(life_dates, pid) FILTER (WHERE life_dates IS NOT NULL) AS life_dates, count(*) AS n_members FROM placed GROUP BY 1)
        SELECT m.cluster, name, sources, CASE WHEN r IS NULL OR r = 3 THEN 'high' ELSE 'medium' END AS confidence, gnd_id, life_dates, CAST(names.n AS INTEGER) AS n_variants, n_members,
        coalesce(r = 2, false) AND n_members > 1 AS needs_review FROM m JOIN names USING (cluster) LEFT JOIN strong ON strong.component = m.cluster""",
    "cosine_topk": """WITH s AS (SELECT q.vec_id AS query, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS sim FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0)
        SELECT query, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "triples": f"WITH {_GRAPH} SELECT * FROM graph",
    "triple_counts": f"WITH {_GRAPH} SELECT p, CASE WHEN p = 'rdf:type' THEN o ELSE '' END AS what, count(*) AS triples, count(DISTINCT s) AS subjects FROM graph GROUP BY 1, 2",
    "provenance_bgp": f"""WITH {_GRAPH} SELECT a.s AS doc, a.o AS reading, b.o AS run, c.o AS model, d.o AS selection FROM graph a JOIN graph b ON b.s = a.o AND b.p = 'prov:wasGeneratedBy'
        JOIN graph c ON c.s = b.o AND c.p = 'prov:wasAssociatedWith' LEFT JOIN graph d ON d.s = a.s AND d.p = 'ex:closestReading' WHERE a.p = 'crm:P128_carries'""",
    "publication_scope": f"""WITH {_JUDGED} SELECT reason, count(*) AS withheld FROM (SELECT CASE WHEN toxic = 1 THEN 'flagged document' WHEN quality = 1 AND doc_id % 3 <> 0 THEN 'person without authority' END AS reason FROM judged) WHERE reason IS NOT NULL GROUP BY 1""",
    "stage_states": f"""WITH {_INPUTS}, matrix(field, stage, mark) AS (VALUES {_MATRIX}), stages(nth, stage) AS (VALUES {_STAGES}), docs AS (SELECT DISTINCT user_id AS doc_id FROM events),
        hits AS (SELECT doc_id, stage, bool_or(mark = 'dirty') AS d, bool_or(mark = 'stale') AS t, max(ord) AS o FROM inputs JOIN matrix USING (field) GROUP BY 1, 2)
        SELECT doc_id, CAST(nth AS INTEGER) AS nth, stage, CASE WHEN d THEN 'dirty' ELSE 'pending' END AS status, coalesce(t, false) AS stale, coalesce(o, 0) AS version FROM docs CROSS JOIN stages LEFT JOIN hits USING (doc_id, stage)""",
    "pinned_criteria": f"WITH {_INPUTS} SELECT doc_id, field, arg_max(value, ord) AS value, max(ord) AS ord FROM inputs WHERE field IN ('century', 'lang', 'script', 'document_type') GROUP BY 1, 2",
    "new_orders": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')",
    "streaming_replay": f"WITH {_LATEST} SELECT * FROM latest",
}

_HUB_SQL = """records AS (
        SELECT CASE WHEN p_partkey % 2 = 0 THEN 'PERSON' ELSE 'PLACE' END AS kind, 'hub_' || p_partkey AS id, p_name AS name, p_partkey % 4 < 2 AS known, 'wd:Q' || p_partkey AS item,
               CASE WHEN p_partkey % 3 = 0 THEN 'gnd:' || p_size END AS gnd, CASE WHEN p_size > 25 THEN p_type END AS notes, p_size, p_partkey FROM part),
    nodes AS (SELECT *, CASE WHEN known THEN item ELSE 'hub:' || lower(kind) || '/' || md5(id) END AS node FROM records),
    terms AS (SELECT DISTINCT p_type AS term, 'hub:vocabulary/' || md5(p_type) AS node FROM part)"""
_HUB_GRAPH = """
    SELECT node AS s, 'rdf:type' AS p, CASE kind WHEN 'PERSON' THEN 'crm:E21_Person' ELSE 'crm:E53_Place' END AS o, 'iri' AS kind FROM nodes
    UNION SELECT node, 'rdfs:label', name, 'literal@de' FROM nodes
    UNION SELECT node, 'crm:P1_is_identified_by', node || '/name', 'iri' FROM nodes
    UNION SELECT node || '/name', 'rdf:type', CASE kind WHEN 'PERSON' THEN 'crm:E82_Actor_Appellation' ELSE 'crm:E48_Place_Name' END, 'iri' FROM nodes
    UNION SELECT node || '/name', 'rdfs:label', name, 'literal@de' FROM nodes
    UNION SELECT node, 'rdf:type', item, 'iri' FROM nodes WHERE known
    UNION SELECT node, 'schema:sameAs', item, 'iri' FROM nodes WHERE known AND kind = 'PERSON'
    UNION SELECT node, 'schema:sameAs', gnd, 'iri' FROM nodes WHERE gnd IS NOT NULL
    UNION SELECT node, 'geo:lat', p_size || '.0', 'literal^^xsd:double' FROM nodes WHERE kind = 'PLACE'
    UNION SELECT node, 'geo:long', p_partkey || '.0', 'literal^^xsd:double' FROM nodes WHERE kind = 'PLACE'
    UNION SELECT node, 'rdfs:comment', notes, 'literal@de' FROM nodes WHERE notes IS NOT NULL
    UNION SELECT node, 'rdf:type', 'sdhss:Concept', 'iri' FROM terms
    UNION SELECT node, 'rdfs:label', term, 'literal@de' FROM terms
    UNION SELECT node, 'sdhss:canonicalForm', term, 'literal@de' FROM terms
    UNION SELECT node, 'sdhss:category', '', 'literal@de' FROM terms"""

SQL |= {
    "search_entities": """SELECT doc_id, string_agg(name, ';' ORDER BY ord) AS entities FROM (
        SELECT p_partkey // 8 AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE lower(p_type) END AS name, min(p_partkey) AS ord FROM part GROUP BY 1, 2) GROUP BY 1""",
    "edit_distances": f"WITH {_ALL_READINGS} SELECT r.conv_id, r.turn, CAST(levenshtein(f.text, r.text) AS INTEGER) AS edits FROM readings r JOIN readings f ON f.conv_id = r.conv_id AND f.turn = 0",
    "engine_plan": """WITH models AS (SELECT p_partkey // 16 AS doc_id, p_partkey, p_size, CASE p_partkey % 5 WHEN 0 THEN 'kraken' WHEN 1 THEN 'trocr' ELSE 'vlm' END AS engine FROM part),
        n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, engine ORDER BY p_size, p_partkey) AS nth FROM models)
        SELECT CAST(doc_id AS BIGINT) AS doc_id, p_partkey, engine, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE engine WHEN 'vlm' THEN 0 ELSE nth END, engine, p_size, p_partkey) AS INTEGER) AS step FROM n""",
    "both_passes": "SELECT conv_id, turn, CAST(min(n) AS INTEGER) AS pass_no FROM (SELECT conv_id, turn, text, 1 AS n FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, text, 2 FROM conversations WHERE turn % 3 > 0) GROUP BY conv_id, turn, text",
    "stacked_lines": r"""WITH lines AS (SELECT conv_id, turn, regexp_replace(unnest(string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0B\x0C]')), '^\s+|\s+$', '', 'g') AS line,
               generate_subscripts(string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0B\x0C]'), 1) AS i FROM conversations),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS nth FROM lines WHERE line <> '')
        SELECT conv_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE nth <= 100), '')) AS reconciled_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN numbered USING (conv_id) GROUP BY 1""",
    "page_documents": r"""SELECT conv_id AS doc_id, count(*) AS n_pages, count(*) FILTER (WHERE regexp_matches(text, '[A-Z]')) AS n_unmerged,
        sha256(string_agg('--- p' || turn || ' ---' || chr(10) || CASE WHEN regexp_matches(text, '\S') THEN text ELSE '' END, chr(10) || chr(10) ORDER BY turn)) AS text_sha256 FROM conversations GROUP BY 1""",
    "hub_summary": """SELECT 'persons' AS kind, count(*) AS n FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'places', count(*) FROM part WHERE p_partkey % 2 = 1
        UNION ALL SELECT 'controlled_vocabulary', count(DISTINCT p_type) FROM part""",
    "hub_graph": f"WITH {_HUB_SQL} {_HUB_GRAPH}",
    "fusion_decisions": f"""WITH {_JUDGED}, d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'no-merge (CER)' WHEN 1 THEN 'vote' END AS strategy, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 8) / 8 END AS cer,
            toxic = 1 AS arbitrated, CASE WHEN quality = 1 THEN true END AS skipped, 'fusion:' || doc_id AS s FROM judged WHERE doc_id % 3 < 2 OR doc_id % 2 = 0)
        SELECT 'doc:' || doc_id AS s, 'ex:hasFusionDecision' AS p, s AS o, 'iri' AS kind FROM d
        UNION SELECT s, 'rdf:type', unnest(['prov:Activity', 'ex:FusionDecision']), 'iri' FROM d
        UNION SELECT s, 'rdfs:label', CASE WHEN doc_id % 3 = 0 THEN 'No-merge decision' ELSE 'Fusion decision' END, 'literal' FROM d
        UNION SELECT s, 'ex:fusionStrategy', strategy, 'literal' FROM d WHERE strategy IS NOT NULL
        UNION SELECT s, 'ex:merged', CAST(doc_id % 3 <> 0 AS VARCHAR), 'literal^^xsd:boolean' FROM d
        UNION SELECT s, 'ex:agreementCer', CAST(cer AS VARCHAR), 'literal^^xsd:double' FROM d WHERE cer IS NOT NULL
        UNION SELECT s, 'ex:decisionReason', 'readings differ beyond the band in which they may be blended', 'literal' FROM d WHERE doc_id % 3 = 0
        UNION SELECT s, 'ex:arbitrated', CAST(arbitrated AS VARCHAR), 'literal^^xsd:boolean' FROM d WHERE arbitrated IS NOT NULL
        UNION SELECT s, 'ex:judgeSkipped', 'true', 'literal^^xsd:boolean' FROM d WHERE skipped""",
    "entity_identifiers": f"""WITH e AS (SELECT p_brand AS doc, 'entity:' || {_SLUG.format('p_type')} AS s, p_type AS name, p_size, 'identifier:hub/h' || p_size AS node FROM part)
        SELECT s, 'crm:P1_is_identified_by' AS p, node AS o, 'iri' AS kind FROM e UNION SELECT node, 'rdf:type', 'crm:E42_Identifier', 'iri' FROM e
        UNION SELECT node, 'rdfs:label', 'h' || p_size, 'literal' FROM e UNION SELECT node, 'crm:P2_has_type', 'hub', 'literal' FROM e
        UNION SELECT s, 'rdf:type', 'ex:PLACE', 'iri' FROM e UNION SELECT s, 'rdfs:label', name, 'literal' FROM e
        UNION SELECT s, 'owl:sameAs', '{R.AUTHORITIES['gnd']}g1', 'iri' FROM e WHERE p_size = 1 UNION SELECT 'doc:' || doc, 'schema:mentions', s, 'iri' FROM e""",
    "working_readings": f"""WITH {_JUDGED} SELECT doc_id, CASE WHEN lang = 'de' THEN 'working' ELSE source END AS key FROM judged
        UNION ALL SELECT doc_id, CASE WHEN lang = 'de' THEN 'working-fused' ELSE 'working' END FROM judged""",
    "stage_outcomes": f"""WITH stages(nth, stage) AS (VALUES {_STAGES}), docs AS (SELECT DISTINCT user_id AS doc_id FROM events),
        log AS (SELECT user_id AS doc_id, event_id % {len(state.STAGES)} AS nth, CASE (event_id // 7) % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'error' ELSE 'dirty' END AS status, event_id AS ord FROM events),
        d AS (SELECT doc_id, nth, max(ord) FILTER (WHERE status = 'dirty') AS dirty FROM log GROUP BY 1, 2),
        o AS (SELECT doc_id, nth, arg_min(status, ord) AS status, min(ord) AS ord FROM log JOIN d USING (doc_id, nth) WHERE status <> 'dirty' AND ord > coalesce(dirty, -1) GROUP BY 1, 2)
        SELECT doc_id, CAST(nth AS INTEGER) AS nth, stage, coalesce(o.status, CASE WHEN dirty IS NOT NULL THEN 'dirty' END, 'pending') AS status, false AS stale, coalesce(o.ord, dirty, 0) AS version
        FROM docs CROSS JOIN stages LEFT JOIN d USING (doc_id, nth) LEFT JOIN o USING (doc_id, nth)""",
}



def _first(spellings: dict, text: str) -> str:
    """The value of the first spelling that the text holds."""
    return "CASE " + " ".join(f"WHEN contains(lower({text}), '{k}') THEN {v!r}" for k, v in spellings.items()) + " END"


#: The stand-in descriptions of documents: prose, and for a third each a full and a partial structured one.
_DESCRIBED = """SELECT doc_id, 'Eine ' || ['Urkunde', 'Chronik', 'Karte', 'Handschrift'][1 + doc_id % 4] || ' in ' || CASE lang WHEN 'de' THEN 'Mittelhochdeutsch' WHEN 'fr' THEN 'Altfranzösisch' ELSE 'einer Sprache' END
                || ', ' || ['kursive', 'bastarda', 'Schrift'][1 + doc_id % 3] || CASE doc_id % 5 WHEN 0 THEN ', ' || (doc_id % 11 + 10) || '. Jahrhundert' WHEN 1 THEN ', 1250 - 1399' WHEN 2 THEN ', um 1' || (doc_id % 90 + 10) || '7' ELSE '' END AS prose,
            CASE WHEN doc_id % 3 = 0 THEN 'gotische textura' END AS schrift, CASE WHEN doc_id % 3 = 0 THEN 'Latein' END AS sprache, CASE WHEN doc_id % 3 < 2 THEN (doc_id % 7 + 12) || '. Jh.' END AS datierung FROM documents"""

#: Minorisation-maximisation on one row per bucket that holds its models, wins and matrix as lists.
_STRENGTHS = f"""RECURSIVE {_OFFERED},
    won AS (SELECT bucket, winner, loser, sum(weight) AS w FROM compared GROUP BY 1, 2, 3),
    models AS (SELECT bucket, list(model ORDER BY model) AS models FROM (SELECT bucket, winner AS model FROM won UNION SELECT bucket, loser FROM won) GROUP BY 1),
    cells AS (SELECT m.bucket, m.models, a, b, coalesce(x.w, 0) AS w, coalesce(x.w, 0) + coalesce(y.w, 0) AS met
              FROM (SELECT bucket, models, a, unnest(models) AS b FROM (SELECT bucket, models, unnest(models) AS a FROM models)) m
              LEFT JOIN won x ON x.bucket = m.bucket AND x.winner = a AND x.loser = b LEFT JOIN won y ON y.bucket = m.bucket AND y.winner = b AND y.loser = a),
    lines AS (SELECT bucket, models, a, CAST(sum(w) AS DOUBLE) AS wins, list(CAST(met AS DOUBLE) ORDER BY b) AS met FROM cells GROUP BY 1, 2, 3),
    base AS MATERIALIZED (SELECT bucket, models, list(wins ORDER BY a) AS wins, list(met ORDER BY a) AS met, len(models) AS n FROM lines GROUP BY 1, 2),
    steps AS (
        SELECT bucket, 0 AS i, list_transform(models, lambda m: CAST(1 AS DOUBLE)) AS p, CAST(1 AS DOUBLE) AS moved FROM base
        UNION ALL
        SELECT bucket, i, new, list_max(list_transform(list_zip(new, p), lambda z: abs(z[1] - z[2]))) FROM (
            SELECT bucket, i, p, CASE WHEN list_avg(raw) > 0 THEN list_transform(raw, lambda x: greatest(x / list_avg(raw), 1e-9)) ELSE raw END AS new FROM (
                SELECT s.bucket, s.i + 1 AS i, s.p, list_transform(list_zip(b.wins, list_transform(list_zip(b.met, s.p), lambda r: list_sum(list_transform(list_zip(r[1], s.p), lambda z: z[1] / greatest(r[2] + z[2], 1e-9))))), lambda z: CASE WHEN z[2] > 0 THEN z[1] / z[2] ELSE 1e-9 END) AS raw
                FROM steps s JOIN base b ON b.bucket = s.bucket WHERE s.moved >= 1e-9 AND s.i < 200))),
    ends AS (SELECT bucket, arg_max(p, i) AS p FROM steps GROUP BY 1),
    strengths AS (
        SELECT bucket, unnest(models) AS model, unnest(p) AS strength, unnest(wins) AS wins, unnest(list_transform(met, lambda r: list_sum(r))) AS comparisons, list_sum(p) AS s, n FROM base JOIN ends USING (bucket)),
    totals AS (SELECT bucket, CAST(sum(w) AS DOUBLE) AS total FROM won GROUP BY 1),
    rated AS (
        SELECT t.bucket, total, total >= 10 AS sufficient, model, strength, wins, comparisons, strength / greatest(strength + CASE WHEN n > 1 THEN (s - strength) / (n - 1) ELSE 1 END, 1e-9) AS win_prob_vs_field
        FROM totals t LEFT JOIN strengths x ON x.bucket = t.bucket AND total >= 10)"""

SQL |= {
    "engine_models": f"""WITH {_RANKED}, lines AS (SELECT 'l' || s_suppkey AS model_id, s_suppkey AS ordinal, ['de', 'mul', 'fr'][1 + s_suppkey % 3] AS m_lang, ['htr', 'layout', 'line-ocr', 'htr'][1 + s_suppkey % 4] AS task, lower(s_name) || ' of century ' || (s_suppkey % 6 + 12) AS about FROM supplier),
        l AS (SELECT doc_id, model_id, CASE WHEN c.lang = m_lang THEN 0.6 WHEN m_lang = 'mul' AND c.lang <> '' THEN 0.3 ELSE 0 END + 0.2 + CASE WHEN contains(about, CAST(century AS VARCHAR)) THEN 0.2 ELSE 0 END AS score, ordinal FROM criteria c, lines WHERE task <> 'layout' AND doc_id % 4 = 1),
        party AS (SELECT arg_min(model_id, ordinal) AS model_id FROM models WHERE contains(model_id, 'm1'))
        SELECT doc_id, CAST(rank AS INTEGER) AS rank, model_id, round(score / 100, 6) AS score FROM ranked WHERE doc_id % 4 = 0 AND rank <= 3
        UNION ALL SELECT doc_id, 1, model_id, round(score / 100, 6) FROM scored SEMI JOIN party USING (model_id) WHERE doc_id % 4 = 2
        UNION ALL SELECT doc_id, CAST(rank AS INTEGER), model_id, round(CAST(score AS DOUBLE), 6) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal) AS rank FROM l) WHERE rank <= 3""",
    "eligible_pairs": """SELECT conv_id, turn, CAST(pos - 1 AS INTEGER) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
        WHERE pos < n AND turn % 3 <> 2 AND (conv_id + turn) % 5 <> 0 AND regexp_replace(coalesce(text, ''), '\\s', '', 'g') <> ''""",
    "search_records": """WITH d AS (SELECT *, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z .,]', '', 'g'), ' +', ' ', 'g')) AS t FROM documents)
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 700 + 1200 AS VARCHAR) ELSE '' END AS date, CASE WHEN doc_id % 3 < 2 THEN lang ELSE '' END AS lang, '' AS script, source AS entities,
               CASE WHEN length(t) > 300 THEN substr(t, 1, 300) || '…' ELSE t END AS snippet, doc_id || '/' AS url FROM d""",
    "bradley_terry": f"WITH {_STRENGTHS} SELECT bucket, total, sufficient, model, round(strength, 6) AS strength, round(wins, 6) AS wins, round(comparisons, 6) AS comparisons, round(win_prob_vs_field, 6) AS win_prob_vs_field FROM rated",
    "strength_priors": f"WITH {_STRENGTHS} SELECT bucket, model, round(least(greatest(win_prob_vs_field - 0.5, 0), 0.15), 4) AS prior_score FROM rated WHERE sufficient AND round(least(greatest(win_prob_vs_field - 0.5, 0), 0.15), 4) > 0",
    "kmeans_labels": """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
        it AS (
            SELECT 0 AS i, list(x ORDER BY h) AS c, true AS go FROM (SELECT x, sha256('0:' || vec_id) AS h FROM v ORDER BY h LIMIT 8)
            UNION ALL
            SELECT i + 1, list(coalesce(m, old) ORDER BY k), bool_or(m IS NOT NULL AND m <> old) FROM (
                SELECT i, k, any_value(old) AS old, list(s ORDER BY d) FILTER (WHERE s IS NOT NULL) AS m FROM (
                    SELECT o.i, o.k, o.old, d, s FROM (SELECT i, unnest(range(8)) AS k, unnest(c) AS old FROM it WHERE go AND i < 100) o LEFT JOIN (
                        SELECT k, d, (CAST(t // 4294967296 AS DOUBLE) * 4294967296 + CAST(t % 4294967296 AS DOUBLE)) / n / 1099511627776 AS s FROM (SELECT k, d, count(*) AS n, sum(CAST(floor(x * 1099511627776) AS BIGINT)) AS t FROM (
                            SELECT list_position(f, list_min(f)) - 1 AS k, unnest(x) AS x, generate_subscripts(x, 1) AS d FROM (
                                SELECT x, list_transform(c, lambda m: list_sum(list_transform(list_zip(m, x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS f FROM it, v WHERE go AND i < 100)) GROUP BY k, d)) n ON n.k = o.k) GROUP BY i, k) GROUP BY i)
        SELECT vec_id, CAST(list_position(f, list_min(f)) - 1 AS INTEGER) AS "cluster" FROM (
            SELECT vec_id, list_transform(c, lambda m: list_sum(list_transform(list_zip(m, x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS f FROM v, (SELECT c FROM it ORDER BY i DESC LIMIT 1))""",
    "scope_metrics": f"""WITH {_JUDGED}, r AS (SELECT CASE WHEN toxic = 1 THEN 'flagged' WHEN quality = 1 AND doc_id % 3 <> 0 THEN 'without_authority' ELSE 'kept' END AS m FROM judged)
        SELECT metric, CASE metric WHEN 'all' THEN (SELECT count(*) FROM r) ELSE (SELECT count(*) FROM r WHERE m = metric) END AS value FROM (VALUES ('all'), ('kept'), ('flagged'), ('persons'), ('without_authority')) t(metric)""",
    "released_graph": f"""WITH {_JUDGED}, shown AS (SELECT * FROM judged WHERE toxic <> 1), kept AS (SELECT DISTINCT doc_id, source, quality, doc_id % 3 = 0 AS known FROM shown WHERE NOT (quality = 1 AND doc_id % 3 <> 0)),
        docs AS (SELECT DISTINCT doc_id, source, quality, lang FROM shown), runs AS (SELECT count(*) AS n FROM docs), models AS (SELECT count(DISTINCT source) AS n FROM docs),
        picked AS (SELECT count(*) AS n FROM docs WHERE quality = 1), slugs AS (SELECT count(DISTINCT (source, quality)) AS n, count(DISTINCT (source, quality)) FILTER (WHERE known) AS linked FROM kept), mentioned AS (SELECT count(DISTINCT (doc_id, source, quality)) AS n FROM kept)
        SELECT what, CAST(CASE what WHEN 'documents' THEN (SELECT n FROM runs) WHEN 'readings' THEN (SELECT n FROM runs) WHEN 'mentions' THEN (SELECT n FROM mentioned)
            WHEN 'triples' THEN (SELECT 7 * runs.n + 2 * models.n + 5 * picked.n + 2 * slugs.n + linked + mentioned.n FROM runs, models, picked, slugs, mentioned) WHEN 'flagged' THEN (SELECT count(*) FROM judged WHERE toxic = 1) WHEN 'without_authority' THEN (SELECT count(*) FROM judged WHERE toxic <> 1 AND quality = 1 AND doc_id % 3 <> 0) ELSE 0 END AS BIGINT) AS n
        FROM (VALUES ('documents'), ('readings'), ('mentions'), ('triples'), ('flagged'), ('persons'), ('without_authority')) t(what)""",
    "provenance_paths": f"""WITH {_GRAPH} SELECT a.s AS doc, c.o AS model, d.o AS selection FROM graph a JOIN graph b ON b.s = a.o AND b.p = 'prov:wasGeneratedBy'
        JOIN graph c ON c.s = b.o AND c.p = 'prov:wasAssociatedWith' JOIN graph d ON d.s = a.s AND d.p = 'ex:closestReading' WHERE a.p = 'crm:P128_carries'""",
    "broader_terms": """WITH RECURSIVE e AS (SELECT p_partkey AS s, p_partkey // 3 AS o FROM part WHERE p_partkey > 0), up AS (SELECT s, o FROM e UNION SELECT up.s, e.o FROM up JOIN e ON e.s = up.o)
        SELECT 'part:' || s AS part, 'part:' || o AS above FROM up JOIN part ON p_partkey = o AND p_size = 1""",
    "word_error_rates": f"""WITH RECURSIVE r AS (SELECT conv_id, turn, list_filter(string_split({_ASCII}, ' '), lambda w: w <> '') AS w FROM conversations),
        p AS (SELECT r.conv_id, r.turn, f.w AS a, r.w AS b, row_number() OVER () AS id FROM r JOIN r f ON f.conv_id = r.conv_id AND f.turn = 0),
        cells AS (SELECT id, a, b, 0 AS j, unnest(range(len(a) + 1)) AS i, unnest(range(len(a) + 1)) AS e FROM p),
        t AS (SELECT id, j, i, e FROM cells
              UNION ALL
              SELECT id, j, i, i + min(best - i) OVER (PARTITION BY id ORDER BY i) FROM (
                  SELECT t.id, t.j + 1 AS j, t.i, CASE WHEN t.i = 0 THEN t.e + 1 ELSE least(t.e + 1, lag(t.e) OVER (PARTITION BY t.id ORDER BY t.i) + CASE WHEN p.a[t.i] = p.b[t.j + 1] THEN 0 ELSE 1 END) END AS best
                  FROM t JOIN p ON p.id = t.id WHERE t.j < len(p.b)))
        SELECT conv_id, turn, round(CASE WHEN len(a) = 0 THEN CASE WHEN len(b) = 0 THEN 0.0 ELSE 1.0 END ELSE e / len(a) END, 9) AS wer FROM p JOIN t ON t.id = p.id AND t.j = len(b) AND t.i = len(a)""",
    "described_criteria": f"""WITH d AS ({_DESCRIBED}),
        m AS (SELECT *, regexp_extract(prose, '(\\d{{4}}) - (\\d{{4}})', 1) AS y1, regexp_extract(prose, '(\\d{{4}}) - (\\d{{4}})', 2) AS y2, regexp_extract(prose, '\\b(1\\d)\\d{{2}}\\b', 1) AS y FROM d)
        SELECT doc_id, CASE WHEN schrift IS NOT NULL THEN 'textura' ELSE {_first({x: x for x in R.SCRIPTS}, "prose")} END AS script, CASE WHEN sprache IS NOT NULL THEN 'la' ELSE {_first(R.LANGUAGES, "prose")} END AS lang,
               CAST(coalesce({_first(R.CENTURIES, "datierung")}, {_first(R.CENTURIES, "prose")}, CASE WHEN y1 <> '' THEN round_even((CAST(y1 AS INTEGER) / 100 + CAST(y2 AS INTEGER) / 100) / 2, 0) END, CASE WHEN y <> '' THEN CAST(y AS INTEGER) + 1 END) AS INTEGER) AS century,
               {_first(R.DOCUMENT_TYPES, "prose")} AS document_type FROM m""",
    "spelled_centuries": f"SELECT doc_id, CAST({_first(R.CENTURIES, 't')} AS INTEGER) AS century FROM (SELECT doc_id, (doc_id % 14 + 9) || CASE doc_id % 4 WHEN 0 THEN '. Jh.' WHEN 1 THEN '. JAHRHUNDERT' WHEN 2 THEN '. Jahrhunderts' ELSE ' Jh' END || CASE WHEN doc_id % 9 = 0 THEN ' (Mittelalter)' ELSE '' END AS t FROM documents)",
}
SQL |= incremental.SQL
