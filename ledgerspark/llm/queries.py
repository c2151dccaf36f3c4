"""One query per operator, over its whole table, and the SQL that checks those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import bpe_tree, chat_tools, conversation_repair, document_fingerprints, lexical_packing, maxent_lm, ngram_jaccard, quality_compression, secret_crf, source_divergence, substring_dedup, template_decontamination, warc_writer
from ledgerspark.llm._tables import shared_folder, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary file, installed with Python on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _crc(column: str) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


#: name, field, type, required of the tools in ``conversation_calls``.
SCHEMAS = [
    ("search", "query", "string", True),
    ("search", "limit", "integer", True),
    ("lookup", "query", "string", True),
    ("lookup", "strict", "boolean", False),
    ("compute", "limit", "number", True),
]


def conversation_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Calls and results read out of the conversations: an assistant's turn calls a tool with its whole text, the user's next turn answers it with its own.

    The tool and the arguments follow the turn's length, so some arguments miss their schema;
    some calls need the assistant's turn before, some that and the one before it.
    """
    turns = table(spark, sf_dir, "conversations")
    n = F.char_length("text")
    name = lambda turn: F.format_string("call_%d_%d", F.col("conv_id"), turn)
    quoted = F.regexp_extract(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("q"))), r'(?s)^\{"q":(.*)\}$', 1)
    calls = turns.where("role = 'assistant'").select(
        name(F.col("turn")).alias("call_id"),
        F.col("conv_id").alias("conversation"),
        F.col("turn").alias("seq"),
        F.when(n % 4 == 0, "search").when(n % 4 == 1, "lookup").when(n % 4 == 2, "compute").otherwise("translate").alias("name"),
        F.concat(F.lit('{ "query": '), quoted, F.lit(', "limit": '), (n % 17).cast("string"), F.when(n % 5 == 0, ', "strict": true').otherwise(""), F.lit("}")).alias("arguments"),
        F.filter(F.array(F.when((n % 2 == 0) & (F.col("turn") >= 3), name(F.col("turn") - 2)), F.when((n % 6 == 0) & (F.col("turn") >= 5), name(F.col("turn") - 4))), lambda x: x.isNotNull()).alias("needs"),
    )
    results = turns.where("role = 'user' AND turn > 0").select(name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op1_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tool call of the conversations, linked, levelled, checked and serialised, and every orphan result."""
    calls, results = conversation_calls(spark, sf_dir)
    schemas = spark.createDataFrame(SCHEMAS, "name string, field string, type string, required boolean")
    return chat_tools.link_tool_calls(calls, results, schemas)


OP1_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, length(text) AS n, text FROM conversations
), calls AS (
  SELECT 'call_' || conv_id || '_' || turn AS call_id, conv_id, turn, n, CAST(to_json(coalesce(text, '')) AS VARCHAR) AS q,
    CASE n % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' WHEN 2 THEN 'compute' ELSE 'translate' END AS name
  FROM t WHERE role = 'assistant'
), results AS (
  SELECT 'call_' || conv_id || '_' || (turn - 1) AS call_id, min(text) AS content, count(*) AS k
  FROM t WHERE role = 'user' AND turn > 0 GROUP BY 1
), needs AS (
  SELECT call_id, 'call_' || conv_id || '_' || (turn - 2) AS need FROM calls WHERE n % 2 = 0 AND turn >= 3
  UNION SELECT call_id, 'call_' || conv_id || '_' || (turn - 4) FROM calls WHERE n % 6 = 0 AND turn >= 5
), bad(call_id) AS (
  SELECT call_id FROM needs WHERE need NOT IN (SELECT call_id FROM calls)
  UNION SELECT needs.call_id FROM needs JOIN bad ON needs.need = bad.call_id
), walk(call_id, depth) AS (
  SELECT call_id, 0 FROM calls
  UNION SELECT needs.call_id, depth + 1 FROM needs JOIN walk ON needs.need = walk.call_id
), level AS (
  SELECT call_id, max(depth) AS level FROM walk WHERE call_id NOT IN (SELECT call_id FROM bad) GROUP BY 1
), checked AS (
  SELECT *, CASE name
      WHEN 'search' THEN CASE WHEN n % 5 = 0 THEN 'extra:strict' ELSE '' END
      WHEN 'lookup' THEN 'extra:limit'
      WHEN 'compute' THEN CASE WHEN n % 5 = 0 THEN 'extra:query,extra:strict' ELSE 'extra:query' END
      ELSE 'unknown_tool' END AS problems FROM calls
)
SELECT c.conv_id AS conversation, c.call_id, c.turn AS seq, CAST(l.level AS INTEGER) AS level,
  CASE WHEN l.level IS NULL THEN 'circular' WHEN problems <> '' THEN 'invalid' WHEN r.k IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
  problems, coalesce(r.k, 0) AS n_results,
  '{"arguments":{"limit":' || (n % 17) || ',"query":' || q || CASE WHEN n % 5 = 0 THEN ',"strict":true' ELSE '' END || '},"id":"' || c.call_id
    || '","name":"' || name || '","result":' || CASE WHEN r.content IS NULL THEN 'null' ELSE CAST(to_json(r.content) AS VARCHAR) END || '}' AS json
FROM checked c LEFT JOIN level l USING (call_id) LEFT JOIN results r USING (call_id)
UNION ALL
SELECT NULL, call_id, NULL, NULL, 'orphan', NULL, k, NULL FROM results WHERE call_id NOT IN (SELECT call_id FROM calls)
"""


def op2_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from the archives."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    manifest = warc_writer.write_warc(table(spark, sf_dir, "pages"), folder)
    return warc_writer.read_warc(manifest, folder)


def op3_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    return lexical_packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id for every document: three-word shingles, similarity 0.9."""
    return ngram_jaccard.near_copies(table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op5_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the fixed patterns' spans, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_crf.scan(docs, secret_crf.fit(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf")


def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality_compression.fit(docs, table(spark, sf_dir, "labels"))
    return quality_compression.score(docs, model).select(
        "doc_id",
        F.coalesce(_crc("doc_id") % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return document_fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id and the evidence, for every document that holds a benchmark item."""
    found = template_decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op9_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document."""
    return maxent_lm.scores(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank: distances of all sources of a language, and the terms that set a source apart."""
    return source_divergence.divergence(table(spark, sf_dir, "documents"), min_docs=10, top_terms=10)


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), word AS (
  SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), vocabulary AS (
  SELECT lang, term, count(*) AS total FROM word GROUP BY 1, 2 HAVING count(DISTINCT row_id) >= 10
), cell AS (
  SELECT lang, source, term, count(*) AS n FROM word SEMI JOIN vocabulary USING (lang, term) GROUP BY 1, 2, 3
), size AS (
  SELECT lang, count(*) AS v, sum(total) AS lang_total FROM vocabulary GROUP BY 1
), grp AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS group_total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN cell c ON g.lang = c.lang AND g.source = c.source GROUP BY 1, 2
), dense AS (
  SELECT g.lang, g.source, y.term, y.total, coalesce(c.n, 0) AS n, s.lang_total, s.v,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.group_total + 2 * s.v) AS p
  FROM grp g JOIN vocabulary y USING (lang) JOIN size s USING (lang) LEFT JOIN cell c ON c.lang = g.lang AND c.source = g.source AND c.term = y.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
), shared AS (
  SELECT *, 1 + (1000000000::HUGEINT * (total + 2)) // (lang_total + 2 * v) AS q FROM dense WHERE n > 0
), term AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM shared WHERE p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM term) WHERE rank <= 10
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired text of every conversation, after damage."""
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes
  FROM conversations
), dealt AS (
  SELECT conv_id, turn, role, text, xor(list_reduce([4294967295] || bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM dealt WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)
), faulty AS (
  SELECT conv_id, i, turn, role, left(role, 1) AS initial, text, before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM numbered
), takes(state, initial, goal) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')
), free(state, goal) AS (VALUES ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')
), named(state, role) AS (VALUES ('u', 'user'), ('a', 'assistant')
), gap AS (
  SELECT state, state AS goal, 0 AS cost, '' AS letters, CAST([] AS VARCHAR[]) AS lines FROM (VALUES (''), ('s'), ('u'), ('a')) v(state)
  UNION ALL SELECT free.state, goal, 2, 'I', [role || ':'] FROM free JOIN named n ON n.state = free.goal
  UNION ALL SELECT f.state, g.goal, 4, 'II', [n.role || ':', m.role || ':'] FROM free f JOIN free g ON g.state = f.goal JOIN named n ON n.state = f.goal JOIN named m ON m.state = g.goal
), edge AS (
  SELECT gap.state, goal, 'D' AS kind, CAST(NULL AS VARCHAR) AS initial, cost + 3 AS cost, letters || 'D' AS letters, lines, CAST(NULL AS VARCHAR) AS rerole FROM gap
  UNION ALL SELECT gap.state, free.goal, 'R', NULL, cost + 2, letters || 'R', lines, n.role FROM gap JOIN free ON free.state = gap.goal JOIN named n ON n.state = free.goal
  UNION ALL SELECT gap.state, takes.goal, 'K', takes.initial, cost, letters || 'K', lines, NULL FROM gap JOIN takes ON takes.state = gap.goal
), best(conv_id, i, state, least) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '', {'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])} FROM faulty
  UNION ALL
  SELECT b.conv_id, f.i, e.goal, min({'cost': b.least.cost + e.cost + CASE WHEN e.kind <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': b.least.audit || e.letters,
    'lines': list_concat(b.least.lines, e.lines, CASE WHEN e.kind = 'D' THEN [] ELSE [coalesce(e.rerole, f.role) || ':' || f.text] END)})
  FROM best b JOIN faulty f ON f.conv_id = b.conv_id AND f.i = b.i + 1 JOIN edge e ON e.state = b.state AND (e.initial IS NULL OR e.initial = f.initial) AND (e.kind = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  GROUP BY b.conv_id, f.i, e.goal
), counted AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY 1
), ended AS (
  SELECT b.conv_id, min({'cost': b.least.cost + g.cost, 'audit': b.least.audit || g.letters, 'lines': list_concat(b.least.lines, g.lines)}) AS least
  FROM best b JOIN counted c ON c.conv_id = b.conv_id AND c.n = b.i JOIN gap g ON g.state = b.state WHERE g.goal IN ('', 'a') GROUP BY 1
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(least.cost, 0) AS BIGINT) AS cost, coalesce(least.audit, '') AS audit, sha256(coalesce(array_to_string(least.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id = o.conv_id LEFT JOIN ended e ON e.conv_id = o.conv_id
"""


def op13_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    path = tokenizer_path("byte_bpe_50k.json")
    found = bpe_tree.decoded(bpe_tree.encoded(table(spark, sf_dir, "documents"), path), path)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_tools": op1_chat_tools,
    "op2_warc_writer": op2_warc_writer,
    "op3_lexical_packing": op3_lexical_packing,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_secret_crf": op5_secret_crf,
    "op6_compression_quality": op6_compression_quality,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_template_decontamination": op8_template_decontamination,
    "op9_maxent_lm": op9_maxent_lm,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_bpe_tree": op13_bpe_tree,
}

ORACLE_SQL: dict[str, str] = {"op1_chat_tools": OP1_SQL, "op11_source_divergence": OP11_SQL, "op12_conversation_repair": OP12_SQL}
