"""The named queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewright.llm import ann, bitsliced, bpe, chat, imatch, langid, line_dedup, lm, mixing, near_dedup, quality, spelling, url_graph
from tradewright.llm.common import table

WORD = r"[^\x20\x09-\x0D]+"


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


OP2_SQL = f"""
WITH sized AS (SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM src),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS r FROM w),
c AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
      sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_from, sum(source_size) OVER () AS total FROM o),
l AS (SELECT min(r) AS r FROM c WHERE source_size > 0 AND weight * (3 * total - 4 * full_before) <= 2 * source_size * 2 * weights_from),
lev AS (SELECT CAST(3 * total - 4 * full_before AS DOUBLE) AS num, CAST(2 * weights_from AS DOUBLE) AS den, r AS lr FROM c WHERE r = (SELECT r FROM l)),
t AS (SELECT c.source, c.source_size, CASE WHEN lr IS NOT NULL AND c.r >= lr THEN CAST(weight AS DOUBLE) * num / den ELSE CAST(2 * source_size AS DOUBLE) END AS target FROM c LEFT JOIN lev ON true),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
q AS (SELECT *, target - whole * source_size AS rest FROM p),
keyed AS (SELECT source, k, sum(size) AS size FROM sized GROUP BY source, k),
run AS (SELECT source, k, size, sum(size) OVER (PARTITION BY source ORDER BY k) AS upto FROM keyed),
one AS (SELECT run.source, run.k, (2 * upto - size <= 2 * rest) AS more FROM run JOIN q ON run.source IS NOT DISTINCT FROM q.source)
SELECT s.doc_id, s.size, q.source_size, q.target, CAST(s.size * (q.whole + CASE WHEN one.more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN q ON s.source IS NOT DISTINCT FROM q.source JOIN one ON s.source IS NOT DISTINCT FROM one.source AND s.k = one.k
"""


def op3_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP4_SQL = """
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
dup AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.*, coalesce(k.doc_id <> d.owner, false) AS gone FROM keyed k LEFT JOIN dup d ON k.key = d.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
       ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, w.doc_id = c.m AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = w.doc_id
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_languages(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge_pages(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return bpe.digests(encoded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", "rule")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op11_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = imatch.edited_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return seen.select("doc_id", "n_chars", F.sha2(F.col("edited_text"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_FAMILY = [f"substr(k, 1, 1) = '{f}'" for f in range(imatch.FAMILIES)]
_LOWEST = ", ".join(f"substr(min(k) FILTER (WHERE {own}), 2, 4) AS low{f}" for f, own in enumerate(_FAMILY))
_BOUNDS = ", ".join(f"'{f}' || repeat('0', 4 - len(ltrim(low{f}, '0'))) || translate(substr(ltrim(low{f}, '0'), 1, 1), '245689abcde', '3777fffffff') || repeat('f', greatest(len(ltrim(low{f}, '0')) - 1, 0)) || 'g' AS to{f}"
                    for f in range(imatch.FAMILIES))
_HASHES = " || ".join(f"coalesce(substr(md5(to{f} || string_agg(k, ' ' ORDER BY k) FILTER (WHERE {own} AND k < to{f})), 1, 16), '{imatch.NO_TERM}')" for f, own in enumerate(_FAMILY))
_TO = ", ".join(f"to{f}" for f in range(imatch.FAMILIES))
_PART = ["substr({a}, %d, 16)" % (16 * i + 1) for i in range(imatch.PARTS)]
_AGREE = " + ".join("CASE WHEN %s = %s AND %s <> '%s' THEN 1 ELSE 0 END" % (x, x.replace("{a}", "{b}"), x, imatch.NO_TERM) for x in _PART)
_HELD = " + ".join("CASE WHEN %s <> '%s' OR %s <> '%s' THEN 1 ELSE 0 END" % (x, imatch.NO_TERM, x.replace("{a}", "{b}"), imatch.NO_TERM) for x in _PART)
_LIKE = f"coalesce(CAST({_AGREE} AS DOUBLE) / nullif({_HELD}, 0), 1.0::DOUBLE)"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT *, lead(doc_id) OVER w AS after, lead(text) OVER w AS later, first_value(doc_id) OVER w AS head, first_value(text) OVER w AS opening FROM d WINDOW w AS (ORDER BY doc_id)),
e AS (SELECT doc_id, n, text, coalesce(after, head) AS next_id, substr(text, 1, n - n // 2) || substr(coalesce(later, opening), 1, n // 2) AS edited FROM o),
both_texts AS (SELECT doc_id, 0 AS which, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
held AS (SELECT doc_id, which, unnest(list_distinct(regexp_extract_all(translate(text, {_LOWER}), '{TERM}'))) AS t FROM both_texts),
lex AS (SELECT t FROM held WHERE which = 0 GROUP BY t HAVING count(*) * {imatch.RAREST} >= (SELECT count(*) FROM d) AND count(*) * {imatch.COMMONEST} <= (SELECT count(*) FROM d)),
marked AS (SELECT held.*, translate(substr(md5(held.t), 1, 1), '89abcdef', '01234567') || substr(md5(held.t), 2) || held.t AS k, lex.t IS NOT NULL AS inside, max(CASE WHEN lex.t IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, which) AS any_inside
  FROM held LEFT JOIN lex ON held.t = lex.t),
kept AS (SELECT doc_id, which, t, k FROM marked WHERE inside OR any_inside = 0),
lows AS (SELECT doc_id, which, {_LOWEST} FROM kept GROUP BY doc_id, which),
bounds AS (SELECT doc_id, which, {_BOUNDS} FROM lows),
prints AS (SELECT kept.doc_id, kept.which, substr(md5(string_agg(k, ' ' ORDER BY k)), 1, 16) || {_HASHES} AS fp FROM kept JOIN bounds USING (doc_id, which) GROUP BY kept.doc_id, kept.which, {_TO}),
named AS (SELECT doc_id, which, coalesce(fp, repeat('0', {16 * imatch.PARTS})) AS fp FROM both_texts LEFT JOIN prints USING (doc_id, which)),
joined AS (SELECT e.doc_id, e.n, e.edited, x.fp, y.fp AS edited_fp, z.fp AS next_fp FROM e JOIN named x ON x.doc_id = e.doc_id AND x.which = 0
  JOIN named y ON y.doc_id = e.doc_id AND y.which = 1 JOIN named z ON z.doc_id = e.next_id AND z.which = 0)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, fp AS fingerprint, edited_fp AS edited_fingerprint,
       {_LIKE.format(a="fp", b="edited_fp")} AS near_edited, {_LIKE.format(a="fp", b="next_fp")} AS near_next
FROM joined
"""


def op12_bitsliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP12_SQL = f"""
WITH held AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{TERM}')) AS t FROM documents),
tfs AS (SELECT doc_id, t, count(*) AS tf FROM held GROUP BY doc_id, t),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
norms AS (SELECT doc_id, 25 + (75 * n * docs) // words AS m FROM sizes, total),
weights AS (SELECT t, CAST(floor(1000.0::DOUBLE * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tfs GROUP BY t), total),
asked AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{TERM}')) AS t FROM benchmark) GROUP BY item_id, t),
scores AS (SELECT item_id, tfs.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (t) JOIN tfs USING (t) JOIN norms ON norms.doc_id = tfs.doc_id GROUP BY item_id, tfs.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scores WHERE score > 0)
SELECT item_id, CAST(r AS INT) AS rank, doc_id, score FROM ranked WHERE r <= 10
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b))"
OP13_SQL = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS tab),
held AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run),
bytes AS (SELECT *, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS x FROM held),
hashed AS (SELECT doc_id, run, n, xor(list_reduce(range(CAST(len(x) // 2 AS BIGINT)), lambda c, i:
  xor(c // 256, tab[1 + xor(c % 256, (strpos('0123456789ABCDEF', substr(x, CAST(2 * i + 1 AS BIGINT), 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(x, CAST(2 * i + 2 AS BIGINT), 1)) - 1)]), 4294967295), 4294967295) AS h
  FROM bytes, crc),
slips AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slips WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
skips AS (SELECT word, n, i, substr(word, 1, i) AS p, substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT DISTINCT a, an, b, bn FROM (
  SELECT x.word AS a, x.n AS an, y.word AS b, y.n AS bn FROM skips x JOIN skips y ON x.p = y.p AND x.s = y.s AND x.word <> y.word
  UNION ALL SELECT x.word, x.n, w.word, w.n FROM skips x JOIN words w ON w.word = x.p || x.s
  UNION ALL SELECT w.word, w.n, x.word, x.n FROM skips x JOIN words w ON w.word = x.p || x.s)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY bn DESC, encode(b)) AS r, count(*) OVER (PARTITION BY a) AS n_near FROM near),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 2 * words.n THEN b END AS form, CASE WHEN bn >= 2 * words.n THEN bn END AS form_n
  FROM words LEFT JOIN ranked ON ranked.a = words.word AND r = 1),
walk AS (SELECT word, word AS here, 0 AS steps FROM forms UNION ALL SELECT walk.word, forms.form, steps + 1 FROM walk JOIN forms ON forms.word = walk.here WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(here, steps) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN roots USING (word)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_nn_descent, op2_source_mixing, op3_attention_lm, op4_line_dedup, op5_minhash_near_dedup, op6_language_id, op7_url_filters, op8_byte_bpe, op9_quality_rules, op10_chat_formatting,
    op11_imatch_fingerprints, op12_bitsliced_search, op13_spelling_variants)}
SQL = {"op2_source_mixing": OP2_SQL, "op4_line_dedup": OP4_SQL, "op5_minhash_near_dedup": OP5_SQL, "op11_imatch_fingerprints": OP11_SQL,
       "op12_bitsliced_search": OP12_SQL, "op13_spelling_variants": OP13_SQL}
