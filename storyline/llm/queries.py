"""The operators' queries over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import chat, conversations, lm, packing, passages, phrases, secret_scan, sentencepiece_viterbi, simhash, toxicity, vectors, warc


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies; read on the driver only. A folder of one's own goes before the installed files."""
    if folder := os.environ.get("STORYLINE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, toxicity.training_labels(read(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select(
        "doc_id", (toxicity.id_remainder("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_markov")


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(spans)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = chat.format_preferences(*chat.swapped_replies(read(spark, sf_dir, "conversations")))
    return formatted.select("pair_id", "n_common", "prompt", "chosen", "rejected", _listed("chosen_spans"), _listed("rejected_spans"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(read(spark, sf_dir, "documents"))
    return scored.select(
        "doc_id", (lm.id_remainder("doc_id", lm.MODULUS) == lm.HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_top_k(read(spark, sf_dir, "embeddings"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.audit(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def decayed(pages: DataFrame) -> DataFrame:
    """A replica with faults planted by page number: some pages cut short, some lost."""
    number = F.coalesce(F.col("page_id"), F.lit(0))
    html = F.when(number % 97 == 5, F.expr("substring(html, 1, length(html) - 1)")).otherwise(F.col("html"))
    return pages.where(number % 101 != 7).withColumn("html", html)


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return warc.audit(pages, decayed(pages))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(conversations.repair(*conversations.damaged(read(spark, sf_dir, "conversations"))))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_embedding_near_dedup, op3_toxicity, op4_secret_scans, op5_chat_formatting,
        op6_simhash_near_dedup, op7_lm_scoring, op8_exact_top_k, op9_sentencepiece, op10_warc_fixity, op11_phrase_collocations, op12_conversation_repair,
        op13_suffix_array_dedup,
    )
}

_CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, strlen({0}) + 1), lambda i: ord({0}[i])::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
_LENGTH = "octet_length(encode({}))"
SQL = {
    "op2_embedding_near_dedup": """
WITH RECURSIVE links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN least c ON c.a = e.vec_id""",
    "op8_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op5_chat_formatting": """
WITH own AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
placed_replies AS (SELECT pair_id, turn, coalesce(text, '') AS text, ((turn % 101 * 37 + pair_id % 101 * 61) % 101 + 101) % 101 AS place
                   FROM own WHERE role = 'assistant' AND turn IS NOT NULL),
replies AS (SELECT pair_id, arg_max(turn, (place, turn)) AS at, arg_max(text, (place, turn, text)) AS reply FROM placed_replies GROUP BY pair_id),
sides AS (
  SELECT 0 AS side, pair_id, turn, role, text FROM own
  UNION ALL
  SELECT 1, o.pair_id, o.turn, o.role, CASE WHEN o.role = 'assistant' AND o.turn = r.at THEN coalesce(p.reply, '') ELSE o.text END
  FROM own o LEFT JOIN replies r ON r.pair_id = o.pair_id LEFT JOIN replies p ON p.pair_id = xor(o.pair_id, 1)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM sides),
differing AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, min(coalesce(c.n, r.n)) FILTER (
    WHERE c.n IS NULL OR r.n IS NULL OR c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text) - 1 AS common, max(coalesce(c.n, r.n)) AS most
  FROM (FROM ranked WHERE side = 0) c FULL JOIN (FROM ranked WHERE side = 1) r ON c.pair_id = r.pair_id AND c.n = r.n GROUP BY 1),
parts AS (
  SELECT d.pair_id, coalesce(common, most) AS n_common, side, n, role, '<|' || coalesce(role, '') || '|>' || chr(10) AS head,
         replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM ranked JOIN differing d USING (pair_id)),
placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, side, n > n_common ORDER BY n) AS until FROM parts)
SELECT pair_id, CAST(any_value(n_common) AS INTEGER) AS n_common,
  coalesce(string_agg(head || body, '' ORDER BY n) FILTER (WHERE side = 0 AND n <= n_common), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY n) FILTER (WHERE side = 0 AND n > n_common), '') AS chosen,
  coalesce(string_agg(head || body, '' ORDER BY n) FILTER (WHERE side = 1 AND n > n_common), '') AS rejected,
  coalesce(string_agg((until - length(body)) || ':' || until, ',' ORDER BY n) FILTER (WHERE side = 0 AND n > n_common AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg((until - length(body)) || ':' || until, ',' ORDER BY n) FILTER (WHERE side = 1 AND n > n_common AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY pair_id""",
    "op10_warc_fixity": f"""
WITH texts AS (
  SELECT r, page_id, 'WARC/1.0' || c || 'WARC-Type: response' || c || 'WARC-Target-URI: ' || coalesce(url, '') || c || 'WARC-Record-ID: <urn:page:'
    || page_id || '>' || c || 'Content-Type: text/html' || c || 'Content-Length: ' || {_LENGTH.format("html")} || c || c || html || c || c AS record
  FROM (SELECT 0 AS r, page_id, url, html, chr(13) || chr(10) AS c FROM pages
        UNION ALL SELECT 1, page_id, url, CASE WHEN page_id % 97 = 5 THEN html[:-2] ELSE html END, chr(13) || chr(10) FROM pages WHERE page_id % 101 <> 7)),
records AS (SELECT r, page_id, page_id >> 8 AS volume, sha256(record) AS sha256, {_LENGTH.format("any_value(record)")} AS length, count(*) AS copies
            FROM texts GROUP BY r, page_id, sha256(record)),
placed AS (SELECT *, sum(length * copies) OVER (PARTITION BY r, volume ORDER BY page_id, sha256) - length * copies AS start FROM records)
SELECT a.page_id, a.volume, CAST(a.start AS BIGINT) AS start, a.length, a.copies, a.sha256,
  CASE WHEN EXISTS (SELECT 1 FROM placed b WHERE b.r = 1 AND b.page_id = a.page_id AND b.sha256 = a.sha256 AND b.copies = a.copies) THEN 'ok'
       WHEN EXISTS (SELECT 1 FROM placed b WHERE b.r = 1 AND b.page_id = a.page_id) THEN 'corrupt' ELSE 'missing' END AS status
FROM placed a WHERE a.r = 0""",
    "op11_phrase_collocations": """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words), (VALUES (1), (2), (3), (4)) t(m) WHERE i + m - 1 <= len(w)),
counts AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM counts WHERE m = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND a >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.m, c.a, k, l.a AS l, r.a AS r, 2000000::HUGEINT * c.a // (l.a::HUGEINT + r.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 : c.m], ' ')),
scored AS (SELECT lang, phrase, m, a, arg_min({'l': l, 'r': r, 'score': score}, (score, k)) AS cut FROM cuts GROUP BY ALL),
inside AS (
  SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, m, a, s, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM candidates)) GROUP BY ALL),
ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY cut.score DESC, a DESC, s.phrase) AS rank, s.phrase, a, cut.l AS l, cut.r AS r, CAST(n AS BIGINT) AS n, CAST(cut.score AS BIGINT) AS score
  FROM scored s JOIN totals USING (lang) LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE coalesce(100::HUGEINT * longer, 0) < 80::HUGEINT * a)
SELECT * FROM ranked WHERE rank <= 2000""",
    "op12_conversation_repair": f"""
WITH RECURSIVE named AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name,
  dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g FROM conversations),
faulty AS (SELECT conv_id, g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32.format("name")} % 20 AS kind FROM named),
damaged AS (
  SELECT g, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM faulty, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS pos, left(role, 1) AS initial FROM damaged),
judged AS (
  SELECT *, lag(initial) OVER (PARTITION BY g ORDER BY pos) || initial AS met,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
         WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY pos) > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
next(p, n) AS (VALUES ('.', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
inserted AS (
  SELECT p, p AS at, 0 AS cost, '' AS audit, '' AS body FROM next
  UNION ALL SELECT p, n, 2, 'I', chr(10) || CASE n WHEN 'u' THEN 'user:' ELSE 'assistant:' END FROM next
  UNION ALL SELECT a.p, b.n, 4, 'II', chr(10) || CASE a.n WHEN 'u' THEN 'user:' ELSE 'assistant:' END || chr(10) || CASE b.n WHEN 'u' THEN 'user:' ELSE 'assistant:' END
  FROM next a JOIN next b ON b.p = a.n),
kinds(op) AS (VALUES ('K'), ('R'), ('D')),
moves AS (
  SELECT j.g, j.pos, i.p, CASE op WHEN 'K' THEN j.initial WHEN 'R' THEN n.n ELSE i.at END AS q,
    i.cost + CASE op WHEN 'K' THEN 0 WHEN 'R' THEN 2 ELSE 3 END + CAST(op <> 'D' AND fault = 'truncated' AS INTEGER) AS cost, i.audit || op AS audit,
    i.body || CASE op WHEN 'K' THEN chr(10) || j.role || ':' || j.text WHEN 'R' THEN chr(10) || CASE n.n WHEN 'u' THEN 'user:' ELSE 'assistant:' END || j.text ELSE '' END AS body
  FROM judged j, inserted i JOIN next n ON n.p = i.at, kinds
  WHERE CASE op WHEN 'D' THEN true WHEN 'K' THEN fault NOT IN ('blank', 'duplicate') AND (j.initial = n.n OR j.initial = 's' AND i.at = '.')
        ELSE fault NOT IN ('blank', 'duplicate') END),
walk AS (
  SELECT g, 1::BIGINT AS pos, '.' AS state, 0::HUGEINT AS cost, '' AS audit, '' AS body FROM (SELECT DISTINCT g FROM faulty)
  UNION ALL
  SELECT w.g, w.pos + 1, m.q, min(w.cost + m.cost), arg_min(w.audit || m.audit, (w.cost + m.cost, w.audit || m.audit)), arg_min(w.body || m.body, (w.cost + m.cost, w.audit || m.audit))
  FROM walk w JOIN moves m ON m.g = w.g AND m.pos = w.pos AND m.p = w.state GROUP BY w.g, w.pos, m.q),
sizes AS (SELECT g, any_value(conv_id) AS conv_id, coalesce((SELECT max(pos) FROM placed p WHERE p.g = f.g), 0) AS n FROM faulty f GROUP BY g),
ended AS (
  SELECT w.g, w.cost + i.cost AS cost, w.audit || i.audit AS audit, w.body || i.body AS body
  FROM walk w JOIN sizes s ON s.g = w.g AND w.pos = s.n + 1 JOIN inserted i ON i.p = w.state AND i.at IN ('.', 'a')),
best AS (SELECT g, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit, arg_min(body, (cost, audit)) AS body FROM ended GROUP BY g),
counts AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE met NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(substr(body, 2)) AS repaired_sha256
FROM sizes JOIN best USING (g) LEFT JOIN counts USING (g)""",
    "op13_suffix_array_dedup": """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT r, id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT r, id, h, unnest(range(strlen(h) // 2 - 49)) AS i FROM docs WHERE strlen(h) >= 100)),
least AS (SELECT s, min(id) AS m FROM strings GROUP BY s),
hits AS (SELECT r, i FROM strings JOIN least USING (s) WHERE m < id),
begun AS (SELECT r, i, CAST(coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50, true) AS INTEGER) AS b FROM hits),
runs AS (SELECT *, sum(b) OVER (PARTITION BY r ORDER BY i) AS run FROM begun),
spans AS (SELECT r, run, min(i) AS a, max(i) + 50 AS e FROM runs GROUP BY ALL),
gaps AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
kept AS (
  SELECT g.r, sum(e - a) AS removed, count(*) AS n, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(e) + 1) AS hex
  FROM gaps g JOIN docs d ON d.r = g.r GROUP BY g.r)
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(coalesce(hex, h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)""",
}
