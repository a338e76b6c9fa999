"""DuckDB SQL of the detection of Latin texts: policy and votes as window functions and joins."""

from __future__ import annotations

import math

from glyphmill.functions.language import _ENGLISH, _LETTERS, _VOTES, LATIN_TAGS
from glyphmill.operators.detect import FIELD, TECHNICAL


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(literal(x) if isinstance(x, str) else repr(x) for x in row) + ")" for row in rows)


#: The path's look-ahead is a plain group where only its being there is asked.
_TESTS = [p.pattern.replace("(?=$|", "(?:$|") for p in TECHNICAL]
_TECH = " OR ".join(f"regexp_matches(line, {literal(t)})" for t in _TESTS)
_VOTE_ROWS = values((w, lang, 1.6 / math.sqrt(len(langs))) for w, langs in _VOTES.items() for lang in langs)

#: Common table expressions that end in decisions(doc_id, script_chars, eligible, gate_passed,
#: lang, confidence, reliable, accepted, path, final_tag, fallback_reason): a row for each text
#: that isn't empty, of Latin letters only, at the default gate.
DECISIONS = f"""
docs AS (SELECT doc_id, text, regexp_extract_all(text, '\\p{{Latin}}+') AS ws FROM documents WHERE text <> ''),
letters AS (SELECT doc_id, text, len(array_to_string(ws, '')) AS script_chars, len(ws) AS runs, trim(regexp_replace(text, '[^\\p{{Latin}}]+', ' ', 'g')) AS normal FROM docs),
raw_lines AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS i FROM docs),
lines AS (SELECT doc_id, i, trim(line, chr(9) || chr(11) || chr(12) || chr(13) || ' ' || chr(160)) AS line FROM raw_lines),
line_kinds AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '\\p{{Latin}}+')) AS words, line IN ('', '---', '```') AS blank FROM lines),
judged AS (SELECT *, NOT blank AND words > 0 AND ({_TECH} OR (words <= 8 AND regexp_matches(line, {literal(FIELD.pattern)}))) AS tech FROM line_kinds),
blocks AS (SELECT *, sum(CASE WHEN blank OR tech THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM judged),
sums AS (SELECT doc_id, block, sum(words) AS words, count(*) AS n, bool_or(regexp_matches(line, '[.!?]')) AS ends FROM blocks WHERE NOT blank AND NOT tech AND words > 0 GROUP BY doc_id, block),
prose AS (SELECT doc_id, sum(words) AS prose FROM sums WHERE words >= 4 AND (ends OR words >= CASE WHEN n <= 1 THEN 5 ELSE 8 END) GROUP BY doc_id),
techs AS (SELECT doc_id, sum(words) AS tech FROM judged WHERE tech GROUP BY doc_id),
gate AS (SELECT l.doc_id, l.text, l.normal, l.script_chars, l.runs, l.runs >= 4 AND coalesce(p.prose, 0) >= 4 AND coalesce(p.prose, 0) >= coalesce(t.tech, 0) AS gate_passed FROM letters l LEFT JOIN prose p USING (doc_id) LEFT JOIN techs t USING (doc_id)),
words AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM docs) GROUP BY doc_id, w),
votes(w, lang, weight) AS (VALUES {_VOTE_ROWS}),
hints(lang, chars) AS (VALUES {values(_LETTERS.items())}),
distinct_words AS (SELECT DISTINCT w, regexp_full_match(w, '[\\x00-\\x7F]*') AS plain FROM words),
word_votes AS (
  SELECT d.w, v.lang, v.weight FROM distinct_words d JOIN votes v ON v.w = lower(d.w)
  UNION ALL SELECT d.w, 'eng', 0.7 FROM distinct_words d WHERE d.plain AND lower(d.w) NOT IN (SELECT w FROM votes) AND regexp_matches(lower(d.w), {literal(_ENGLISH.pattern)})
  UNION ALL SELECT d.w, h.lang, 0.5 FROM distinct_words d JOIN hints h ON NOT d.plain AND regexp_matches(lower(d.w), '[' || h.chars || ']')),
scores AS (SELECT doc_id, lang, round(sum(weight * n), 9) AS score FROM words JOIN word_votes USING (w) GROUP BY doc_id, lang),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS r, coalesce(lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, lang), 0.0) AS second FROM scores),
guesses AS (
  SELECT doc_id, lang, score, round(least(1.0, 0.35 * least(1.0, score / (0.45 * runs)) + 0.65 * least(1.0, (score - second) / score * 1.6)), 4) AS confidence
  FROM ranked JOIN gate USING (doc_id) WHERE r = 1 AND score > 0),
looks AS (
  SELECT g.*, u.lang, u.confidence, coalesce(u.confidence >= 0.6 AND u.score >= 1.4, false) AS reliable, g.script_chars >= 24 AS eligible, g.normal <> '' AND g.normal <> g.text AS twice
  FROM gate g LEFT JOIN guesses u USING (doc_id)),
paths AS (
  SELECT *, CASE WHEN NOT eligible OR lang IS NULL OR NOT gate_passed THEN NULL WHEN reliable AND confidence >= 0.75 THEN 'reliable' WHEN twice AND reliable AND confidence >= 0.7 THEN 'corroborated' END AS took FROM looks),
tags(lang, tag) AS (VALUES {values(LATIN_TAGS.items())}),
decisions AS (
  SELECT doc_id, CAST(script_chars AS INTEGER) AS script_chars, eligible, gate_passed, CASE WHEN eligible THEN lang END AS lang, CASE WHEN eligible THEN CAST(confidence AS DOUBLE) END AS confidence, reliable, took IS NOT NULL AS accepted, coalesce(took, 'fallback') AS path,
    CASE WHEN took IS NOT NULL THEN tag ELSE 'und-Latn' END AS final_tag,
    CASE WHEN took IS NOT NULL THEN NULL WHEN NOT eligible THEN 'notEligible' WHEN lang IS NULL THEN 'noCandidate' WHEN NOT gate_passed THEN 'qualityGate' WHEN twice AND confidence >= 0.7 AND NOT reliable THEN 'corroborationUnreliable' ELSE 'belowThreshold' END AS fallback_reason
  FROM paths LEFT JOIN tags USING (lang))"""
