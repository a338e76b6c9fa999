"""Queries of the ten operators over the driver's tables, and SQL where it can say them."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.llm import bpe, chat, jaccard, lines, mixing, neardup, secrets, suffix, topk, toxicity
from glyphmill.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"), length=50)


def op3_topk_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.linked_conversations(table(spark, sf_dir, "conversations"))
    return out.withColumn("parent_turn", F.coalesce("parent_turn", F.lit(-1)))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"), num=80, den=100, width=5)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"))


def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 on mail made of the conversations, which quote nothing themselves: each message
    quotes the one before it and, one level deeper, the one before that."""
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    quote = lambda text, mark: F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))
    rows = table(spark, sf_dir, "conversations").withColumns({"one": F.lag("text").over(before), "two": F.lag("text", 2).over(before)})
    mail = F.concat(F.coalesce(F.concat(F.lit("B wrote:\n"), F.coalesce(F.concat(F.lit("> A wrote:\n"), quote(F.col("two"), "> > ")), F.lit("")), quote(F.col("one"), "> "), F.lit("\n")), F.lit("")), "text")
    return chat.linked_conversations(rows.withColumn("text", mail)).withColumn("parent_turn", F.coalesce("parent_turn", F.lit(-1)))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7 that SQL can say: sizes and targets, without draws."""
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source", "source_size", "target")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_suffix_dedup, op3_topk_maxscore, op4_bpe_roundtrip, op5_embedding_near_dedup, op6_quotation_linking, op7_source_mixing, op8_secret_scan, op9_ngram_jaccard, op10_line_dedup, quoted_replies, mix_targets)}

#: DuckDB SQL for the queries that SQL can express.
def spans_sql() -> str:
    """CTEs that end in spans(r, start, stop, n, kind): the rules' matches in docs(r, t). Places
    are sums of the lengths of matches and of what lies between them."""
    either = lambda m: f"[{m[0].lower()}{m[0].upper()}]"
    patterns = {
        "assign": re.sub("[a-z]", either, "(?:password|passwd|secret|token|api_?key)").replace("(?:", "(") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": "AKIA[A-Z0-9]{16,}",
        "hex": "[0-9a-f]{24,}",  # runs are maximal, so short ones needn't be found and dropped
    }
    parts = []
    for n, rule in enumerate(secrets.RULES):
        p = "'" + patterns.get(rule.kind, rule.pattern).replace("'", "''") + "'"
        least = f"WHERE len(regexp_extract(s, {p}, {rule.group})) >= {rule.least}" if rule.group else ""
        parts.append(f"""
m{n} AS (SELECT r, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS ps FROM docs WHERE regexp_matches(t, {p})),
e{n} AS (SELECT r, unnest(ms) AS s, unnest(ps[1:len(ms)]) AS p, generate_subscripts(ms, 1) AS i FROM m{n}),
f{n} AS (SELECT r, s, sum(len(p) + len(s)) OVER (PARTITION BY r ORDER BY i) AS stop FROM e{n}),
s{n} AS (SELECT r, CAST(stop - len(s) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, {n} AS n, '{rule.kind}' AS kind FROM f{n} {least})""")
    return ",".join(parts) + ",\nspans AS (" + " UNION ALL ".join(f"SELECT * FROM s{n}" for n in range(len(secrets.RULES))) + ")"


WORDS_SQL = r"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)"
MAIL = """(SELECT conv_id, turn, role, coalesce('B wrote:' || chr(10) || coalesce('> A wrote:' || chr(10) || '> > ' || replace(two, chr(10), chr(10) || '> > ') || chr(10), '')
  || '> ' || replace(one, chr(10), chr(10) || '> ') || chr(10) || chr(10), '') || text AS text
  FROM (SELECT *, lag(text) OVER w AS one, lag(text, 2) OVER w AS two FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)))"""
ORACLE_SQL: dict[str, str] = {
    "quoted_replies": f"SELECT * REPLACE (coalesce(parent_turn, -1) AS parent_turn) FROM ({chat.ORACLE.replace('FROM conversations', 'FROM ' + MAIL)})",
    "op6_quotation_linking": f"SELECT * REPLACE (coalesce(parent_turn, -1) AS parent_turn) FROM ({chat.ORACLE})",
    "op8_secret_scan": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),{spans_sql()},
a AS (SELECT r, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, n, stop) FILTER (WHERE n < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, n, stop) AS spans FROM spans GROUP BY r)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN a USING (r)""",
    # the level of the targets: sources are capped in the order of what a unit of weight may give them
    "mix_targets": f"""
WITH d AS (SELECT doc_id, source, {WORDS_SQL} AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, sum(source_size) OVER w AS capped, sum(weight) OVER () - sum(weight) OVER w AS free, count(*) OVER w AS k, 2.0 * lead(source_size) OVER w / lead(weight) OVER w AS following FROM n
  WINDOW w AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT 0 AS k, 1.5 * total / sum(weight) AS level, min(2.0 * source_size / weight) AS following FROM n GROUP BY total
  UNION ALL SELECT k, (1.5 * total - 2.0 * capped) / free, following FROM o WHERE free > 0),
b AS (SELECT arg_min(level, k) AS level FROM l WHERE level <= following OR following IS NULL)
SELECT d.doc_id, d.size, d.source, n.source_size, CASE WHEN n.total = 0 THEN 0.0 ELSE least(n.source_size * 2.0, n.weight * b.level) END AS target
FROM d JOIN n ON n.source IS NOT DISTINCT FROM d.source CROSS JOIN b""",
    "op2_suffix_dedup": """
WITH b AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS d, hex(encode(coalesce(text, ''))) AS h FROM documents
), ps AS (SELECT r, d, h, unnest(range(1, len(h) // 2 + 1)) AS i FROM b),
w AS (SELECT r, d, i, CASE WHEN len(h) // 2 - i >= 49 THEN substring(h, 2 * i - 1, 100) END AS s, substring(h, 2 * i - 1, 2) AS byte FROM ps),
f AS (SELECT s, min(d) AS low FROM w WHERE s IS NOT NULL GROUP BY s HAVING count(DISTINCT d) > 1),
g AS (SELECT w.r, w.i, w.byte, CASE WHEN f.low < w.d THEN 1 ELSE 0 END AS hit FROM w LEFT JOIN f ON f.s = w.s),
c AS (SELECT r, i, byte, max(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM g),
e AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS start FROM c),
t AS (SELECT r, sum(gone) AS n_removed, sum(start) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM e GROUP BY r)
SELECT b.doc_id, CAST(len(b.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(t.n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(t.kept, ''))) AS kept_sha256 FROM b LEFT JOIN t ON t.r = b.r""",
    "op3_topk_maxscore": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0
), n AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 20""",
    "op5_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
    coalesce(label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok
  FROM embeddings
), link AS (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE a.ok AND b.ok AND list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.98
), reach AS (
  SELECT r AS a, r AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), low AS (
  SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a
), n AS (SELECT a AS r, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, low.component_id, v.vec_id IS NOT DISTINCT FROM low.component_id AS kept
FROM v JOIN low ON low.r = v.r LEFT JOIN n ON n.r = v.r""",
    # words ordered from the rarest on: sets that reach 0.8 share one of the first ones
    "op10_line_dedup": r"""
WITH b AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS r, doc_id, text FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM b WHERE text IS NOT NULL),
s AS (SELECT r, i, line, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS w FROM l),
c AS (SELECT row_number() OVER () AS c, w, min((r, i)) AS low FROM s WHERE len(w) > 0 GROUP BY w),
x AS (SELECT c, len(w) AS n, unnest(w) AS t FROM c),
k AS (SELECT t, count(*) AS k FROM x GROUP BY t),
p AS (SELECT c, n, t FROM (SELECT x.c, x.n, x.t, row_number() OVER (PARTITION BY x.c ORDER BY k.k, x.t) AS nth FROM x JOIN k USING (t)) WHERE nth <= n - (4 * n + 4) // 5 + 1),
d AS (SELECT DISTINCT p.c AS a, q.c AS b FROM p JOIN p q ON p.t = q.t AND p.c < q.c AND 5 * least(p.n, q.n) >= 4 * greatest(p.n, q.n)),
e AS (SELECT d.a, d.b, ca.low AS la, cb.low AS lb, len(list_intersect(ca.w, cb.w)) AS m, len(ca.w) + len(cb.w) AS n FROM d JOIN c ca ON ca.c = d.a JOIN c cb ON cb.c = d.b),
f AS (SELECT a AS c, min(lb) AS low FROM e WHERE 5 * m >= 4 * (n - m) GROUP BY a UNION ALL SELECT b, min(la) FROM e WHERE 5 * m >= 4 * (n - m) GROUP BY b),
g AS (SELECT c.w, least(min(c.low), min(f.low)) AS low FROM c LEFT JOIN f USING (c) GROUP BY c.w),
h AS (SELECT s.r, s.i, s.line, coalesce(g.low < (s.r, s.i), false) AS gone FROM s LEFT JOIN g ON g.w = s.w),
t AS (SELECT r, count(*) AS n_lines, count_if(gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM h GROUP BY r)
SELECT b.doc_id, CAST(coalesce(t.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256 FROM b LEFT JOIN t USING (r)""",
    "op9_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM w
), x AS (SELECT r, unnest(sh) AS t FROM s),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.r < b.r GROUP BY a.r, b.r),
l0 AS (SELECT p.a, p.b FROM p JOIN s sa ON sa.r = p.a JOIN s sb ON sb.r = p.b WHERE 100 * p.c >= 80 * (len(sa.sh) + len(sb.sh) - p.c)),
l AS (SELECT a, b FROM l0 UNION ALL SELECT b, a FROM l0),
reach AS (SELECT r AS a, r AS b FROM s UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
low AS (SELECT reach.a AS r, min(s.doc_id) AS component_id FROM reach JOIN s ON s.r = reach.b GROUP BY reach.a),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(n.n, 0) AS n_similar, low.component_id
FROM s JOIN low ON low.r = s.r LEFT JOIN n ON n.r = s.r""",
}
