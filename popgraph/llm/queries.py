"""The queries opN_<name> and their SQL; each applies one operator to the whole of its table."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import decontaminate, fingerprint, language_mix, near_dup, packing, quality_gam, run_dedup, sharding, spelling, token_store, toxicity, turn_repair, url_filter


#: File of /opt/tokenizers that operators 5 and 10 take ids from.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_winnowing_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, removed = _table(spark, sf_dir, "documents"), "removed_words"
    while removed in docs.columns:
        removed = f"_{removed}"
    out = run_dedup.remove_repeats(docs, removed=removed)
    return out.select("doc_id", F.col(removed).alias("removed_words"), F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


#: The rules that operator 4's contract states.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op4_sorted_digest_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "rule string, verdict string"))


def op5_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = quality_gam.score(docs, quality_gam.fit(docs, labels.where(~C.held_out())))
    return out.select("doc_id", C.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_one_permutation_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(_table(spark, sf_dir, "documents"))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_mix.fit(docs.where(~C.held_out()).select("lang", "text"))
    out = language_mix.predict(docs, model)
    return out.select("doc_id", C.held_out().alias("held_out"), "lang_pred", "score")


def op9_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~C.held_out()))
    out = toxicity.score(docs, model)
    return out.select("doc_id", C.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.shared_path(spark, "token-files")
    token_store.write_token_files(_table(spark, sf_dir, "documents"), path, TOKENIZER)
    return token_store.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_partenum_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the runs whose crc32 31 divides one code point goes first; what is left of them all is grouped."""
    found = spelling.runs(_table(spark, sf_dir, "documents"))
    h = spelling.crc32_of(F.col("doc_id"), F.col("word"))
    at = (h % F.length("word")).cast("int")
    less = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
    found = found.select(F.when(h % 31 == 0, less).otherwise(F.col("word")).alias("word"))
    return spelling.group_variants(spelling.count_words(found))


def op12_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def damaged_turns(turns: DataFrame) -> DataFrame:
    """What operator 13's contract does to conversations before they are repaired."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (spelling.crc32_of(*key) % 20).alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("h") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def op13_viterbi_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    found = turn_repair.digest(turn_repair.repair(damaged_turns(turns))).withColumnRenamed("conv_id", "k")
    out = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("k")), "left").drop("k")
    return out.fillna(0, out.columns[1:7]).fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
  ) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * p.c >= 75 * (na.n + nb.n - p.c)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN comp c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract(coalesce(text, ''), '^[\x20\x09-\x0D]*') AS head,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS parts, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM g) WHERE r > 1
), split AS (
  SELECT doc_id, l, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws
  FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS l, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d))
), lines AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY l) AS k, array_to_string(ws, ' ') AS t, len(ws) AS n,
    sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY l) - len(ws) AS a
  FROM split WHERE len(ws) > 0
), near AS (
  SELECT *, max(CASE WHEN n >= 4 THEN k END) OVER (PARTITION BY doc_id ORDER BY k) AS back,
    min(CASE WHEN n >= 4 THEN k END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead
  FROM lines
), all_lines AS (SELECT doc_id, list(t ORDER BY k) AS ts FROM lines GROUP BY doc_id),
runs AS (
  SELECT n.doc_id, a, n, back AS place, 'after' || array_to_string(ts[back:k], chr(10)) AS g FROM near n JOIN all_lines x ON x.doc_id = n.doc_id WHERE back IS NOT NULL
  UNION ALL
  SELECT n.doc_id, a, n, ahead, 'before' || array_to_string(ts[k:ahead], chr(10)) FROM near n JOIN all_lines x ON x.doc_id = n.doc_id WHERE ahead > k
), gone_lines AS (
  SELECT DISTINCT doc_id, unnest(range(CAST(a AS BIGINT) + 1, CAST(a AS BIGINT) + n + 1)) AS i
  FROM (SELECT doc_id, a, n, row_number() OVER (PARTITION BY g ORDER BY doc_id, place) AS r FROM runs) WHERE r > 1
), w AS (
  SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part FROM d
), f AS (
  SELECT w.doc_id, w.i, part, greatest(CASE WHEN x.i IS NULL THEN 0 ELSE 1 END,
    coalesce(max(CASE WHEN l.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0)) AS gone
  FROM w LEFT JOIN later l ON l.doc_id = w.doc_id AND l.i = w.i LEFT JOIN gone_lines x ON x.doc_id = w.doc_id AND x.i = w.i
), k AS (
  SELECT doc_id, sum(gone) AS removed, coalesce(string_agg(part, '' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM f GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(removed, 0) AS BIGINT) AS removed_words, length(head || coalesce(kept, '')) AS kept_chars, md5(head || coalesce(kept, '')) AS kept_md5
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

OP4_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), rules(rule, h, q, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), m AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id
"""

#: View crc_table, and crc32 (reflected polynomial 0xEDB88320) of a text over it.
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)
)"""


def _crc_sql(text: str) -> str:
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(1, CAST(length({digits}) AS BIGINT), 2), lambda p: CAST('0x' || substr({digits}, p, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295)"


OP11_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE}, found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), counted AS (SELECT doc_id, w, count(*) AS c, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS k FROM found GROUP BY ALL),
hashed AS (SELECT w, c, {_crc_sql("k")} AS h FROM counted, crc_table),
words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY 1 HAVING sum(c) >= 2
), less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT x.word, y.word AS other, y.n AS m FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.rest
), best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY 1),
forms AS (SELECT b.word, n_near, m, min(other) AS other FROM best b JOIN near USING (word, m) GROUP BY 1, 2, 3),
out AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN forms USING (word)
), walk(word, root) AS (SELECT word, word FROM out UNION SELECT walk.word, out.form FROM walk JOIN out ON out.word = walk.root WHERE out.form IS NOT NULL)
SELECT o.word, o.form, w.root, o.n, CAST(o.n_near AS BIGINT) AS n_near, o.form_n
FROM out o JOIN (SELECT word, root FROM walk WHERE root NOT IN (SELECT word FROM out WHERE form IS NOT NULL)) w ON w.word = o.word
"""

OP13_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE}, keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), hashed AS (SELECT conv_id, turn, role, text, {_crc_sql("k")} % 20 AS h FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, LATERAL (SELECT unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))
), convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
rows AS (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail
  FROM damaged JOIN convs ON damaged.conv_id IS NOT DISTINCT FROM convs.conv_id
), judged AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1]) OVER (PARTITION BY c ORDER BY i) || role[1] AS pair
  FROM rows
), counted AS (
  SELECT c, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM judged GROUP BY c
), inserts(s, t, extra, letters, added) AS (
  SELECT s, s, 0, '', '' FROM range(4) r(s)
  UNION ALL VALUES (0, 2, 3, 'I', chr(10) || 'user:'), (1, 2, 3, 'I', chr(10) || 'user:'), (3, 2, 3, 'I', chr(10) || 'user:'), (2, 3, 3, 'I', chr(10) || 'assistant:'),
    (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')
), best(c, i, s, ranked, kept) AS (
  SELECT c, 0, t, lpad(CAST(extra AS VARCHAR), 9, '0') || letters, added FROM convs, inserts WHERE s = 0
  UNION ALL
  SELECT c, i, t, min(lpad(CAST(cost + extra AS VARCHAR), 9, '0') || audit || letters), arg_min(kept || added, lpad(CAST(cost + extra AS VARCHAR), 9, '0') || audit || letters) FROM (
    SELECT c, i + 1 AS i, o.s, paid + o.price AS cost, done || o.letter AS audit, kept0 || o.more AS kept FROM (
      SELECT b.c, b.i, CAST(substr(ranked, 1, 9) AS BIGINT) AS paid, substr(ranked, 10) AS done, kept AS kept0, b.s AS s0, j.role, j.text, j.fault FROM best b JOIN judged j ON j.c = b.c AND j.i = b.i + 1
    ), LATERAL (
      SELECT s0 AS s, 4 AS price, 'D' AS letter, '' AS more
      UNION ALL SELECT CASE WHEN s0 = 2 THEN 3 ELSE 2 END, 3 + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'R', chr(10) || CASE WHEN s0 = 2 THEN 'assistant:' ELSE 'user:' END || text WHERE fault NOT IN ('blank', 'duplicate')
      UNION ALL SELECT CASE role[1] WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'K', chr(10) || role || ':' || text
        WHERE fault NOT IN ('blank', 'duplicate') AND ((role[1] = 's' AND s0 = 0) OR (role[1] = 'u' AND s0 <> 2) OR (role[1] = 'a' AND s0 = 2))
    ) o
  ) JOIN inserts USING (s) GROUP BY c, i, t
), ended AS (SELECT c, min(ranked) AS ranked, arg_min(kept, ranked) AS kept FROM best JOIN counted USING (c) WHERE i = n AND s IN (0, 3) GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(substr(ranked, 1, 9) AS BIGINT), 0) AS cost, coalesce(substr(ranked, 10), '') AS audit, sha256(coalesce(substr(kept, 2), '')) AS repaired_sha256
FROM convs LEFT JOIN counted USING (c) LEFT JOIN ended USING (c)
"""

QUERIES = {
    "op1_minhash_odd_sketch": op1_minhash_odd_sketch,
    "op2_simhash_decontamination": op2_simhash_decontamination,
    "op3_winnowing_line_dedup": op3_winnowing_line_dedup,
    "op4_sorted_digest_urls": op4_sorted_digest_urls,
    "op5_first_fit_packing": op5_first_fit_packing,
    "op6_additive_quality": op6_additive_quality,
    "op7_one_permutation_fingerprint": op7_one_permutation_fingerprint,
    "op8_language_mixture": op8_language_mixture,
    "op9_lexicon_toxicity": op9_lexicon_toxicity,
    "op10_elias_fano_tokens": op10_elias_fano_tokens,
    "op11_partenum_spelling": op11_partenum_spelling,
    "op12_best_fit_shards": op12_best_fit_shards,
    "op13_viterbi_turn_repair": op13_viterbi_turn_repair,
}

SQL = {
    "op1_minhash_odd_sketch": OP1_SQL,
    "op3_winnowing_line_dedup": OP3_SQL,
    "op4_sorted_digest_urls": OP4_SQL,
    "op11_partenum_spelling": OP11_SQL,
    "op13_viterbi_turn_repair": OP13_SQL,
}
