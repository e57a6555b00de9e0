"""One query per operator, with production parameters over whole tables, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweave.llm import chat_format, code_compression, decontamination, filter_audit, language_id, near_duplicates, neighbour_quality, piece_sampling, quality_rules, secret_spans, substring_dedup, suffix_dedup, token_files
from schemaweave.llm.shared import remainder, shared_path, stored, tune, with_group



def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file; the operators take paths as parameters."""
    import public_tokenizers

    return public_tokenizers.path(name)



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    model = language_id.train(docs, ~held)
    return language_id.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"))
    return token_files.read(spark, path, digests=True)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    measures = stored(quality_rules.measure(docs, F.col("lang")), "measures")
    certified = quality_rules.certify(measures, labels.select("doc_id", (F.col("quality") == 1).alias("good")))
    return quality_rules.apply_rules(measures, certified).select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op4_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sample_pieces(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), digests=True)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"), window=200)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    probe = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.inline(F.array(*[F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for i, r in enumerate(("user", "assistant"))])))
    messages = rows.unionByName(probe).select("conv_id", "turn", "role", chat_format.text_parts(F.col("text")).alias("parts"))
    out = chat_format.format_conversations(messages)
    back = chat_format.with_loss_text(out).withColumn("turns", chat_format.read_turns(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = remainder(F.col("doc_id"), 5) == 0
    model = neighbour_quality.fit(docs, labels, ~held)
    scored = neighbour_quality.score_rows(docs.select("doc_id", "text"), model)
    score = F.col(neighbour_quality.SCORE)
    return scored.select("doc_id", held.alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_words(table(spark, sf_dir, "documents"), window=20)


def op11_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = code_compression.compress(table(spark, sf_dir, "embeddings"))
    coded = stored(coded, "codes")
    labels = coded.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error"))
    return with_group(coded, "label", labels, "n").select("vec_id", "code", "error", "label_error", F.lit(code_compression.digest(books)).alias("codebooks_sha256"))


def op12_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_spans.digests(secret_spans.find(docs, secret_spans.train(docs)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = labels.select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    rows = filter_audit.measure(docs, F.col("source"), marks)
    return filter_audit.audit(rows, filter_audit.FILTERS)


def queries() -> dict:
    return {"op1_language_id": op1_language_id, "op2_token_files": op2_token_files, "op3_quality_rules": op3_quality_rules, "op4_piece_sampling": op4_piece_sampling, "op5_suffix_dedup": op5_suffix_dedup, "op6_chat_format": op6_chat_format, "op7_near_duplicates": op7_near_duplicates, "op8_decontamination": op8_decontamination, "op9_neighbour_quality": op9_neighbour_quality, "op10_substring_dedup": op10_substring_dedup, "op11_code_compression": op11_code_compression, "op12_secret_spans": op12_secret_spans, "op13_filter_audit": op13_filter_audit}


OP6_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, 8 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + 8 + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 7 AS chars FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), starts AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
    SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w))
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM starts, range(5) AS r(k) WHERE c > 1 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, stratum, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    MAP {{'symbols': 1000 * n_symbols // nullif(n_words, 0), 'dup_lines': 1000 * n_dup_lines // nullif(n_words, 0), 'word_length': 100 * word_chars // nullif(n_words, 0), 'repeats': 1000 * n_repeat_words // nullif(n_words, 0)}} AS v
  FROM m
), tests(rule, cutoff) AS (VALUES {tests}
), counts AS (
  SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (WHERE v[rule] > cutoff) AS k
  FROM b, tests WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL
), certified AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM counts
  WHERE k < n * {share} AND (
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share}))) FROM range(k + 1) AS r(i)
  ) <= 0.05 / ((SELECT count(DISTINCT stratum) FROM counts) * {n_tests})
  GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM certified c WHERE c.stratum = b.stratum AND v[c.rule] > c.cutoff) AS kept
FROM b
"""


OP5_SQL = r"""
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents  -- two characters a byte
), pieces AS (
  SELECT doc_id, c * 2048 AS base, substring(h, CAST(4096 * c + 1 AS BIGINT), 2 * (2048 + 199)) AS piece FROM (SELECT doc_id, h, unnest(range(length(h) // 4096 + 1)) AS c FROM h)
), starts AS (
  SELECT doc_id, base + i AS s, md5(substring(piece, CAST(2 * i + 1 AS BIGINT), 400)) AS g FROM (SELECT doc_id, base, piece, unnest(range(length(piece) // 2 - 199)) AS i FROM pieces WHERE length(piece) >= 400)
), again AS (
  SELECT doc_id, s FROM starts WHERE g IN (SELECT g FROM starts GROUP BY g HAVING count(*) > 1)
), islands AS (
  SELECT doc_id, min(s) AS a, max(s) + 200 AS b FROM (
    SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM (
      SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS new FROM again))
  GROUP BY doc_id, island
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER w, 0) AS first, a AS stop FROM islands WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT h.doc_id, coalesce(max(b), 0), max(length(h)) // 2 FROM h LEFT JOIN islands USING (doc_id) GROUP BY h.doc_id
), kept AS (
  SELECT doc_id, string_agg(substring(h, CAST(2 * first + 1 AS BIGINT), CAST(2 * (stop - first) AS BIGINT)), '' ORDER BY first) AS k FROM gaps JOIN h USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce((SELECT sum(b - a) FROM islands i WHERE i.doc_id = h.doc_id), 0) AS BIGINT) AS n_removed,
  (SELECT count(*) FROM islands i WHERE i.doc_id = h.doc_id) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM h JOIN kept USING (doc_id)
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links) l ON l.a = reach.b
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""

OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM (
    SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w))
), covered AS (
  SELECT DISTINCT doc_id, i + k AS p FROM starts, range(20) AS t(k) WHERE r > 1
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w) ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS first FROM d GROUP BY t
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), rows AS (
  SELECT part, CAST(len(ws) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INT)
    + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(doc_id > first AS INT) AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)
), profiles AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM rows GROUP BY ALL
), letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders(filter_order, used) AS (
  SELECT letter, bit FROM letters UNION ALL SELECT filter_order || letter, used + bit FROM orders, letters WHERE used & bit = 0
), steps AS (
  SELECT filter_order, CAST(step AS INT) AS step, bit, (SELECT coalesce(sum(l.bit), 0) FROM letters l WHERE position(l.letter IN filter_order) < step)::INT AS before
  FROM orders, range(1, 6) AS r(step), letters WHERE used = 31 AND filter_order[step] = letter
), counts AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (WHERE fails & (before | bit) = 0) AS kept, sum(n) FILTER (WHERE fails & before = 0 AND fails & bit > 0) AS removed,
    sum(n) FILTER (WHERE fails & before > 0 AND fails & bit > 0) AS redundant, sum(n) FILTER (WHERE fails = bit) AS unique_fails,
    sum(g) FILTER (WHERE fails & before = 0 AND fails & bit > 0) AS good_lost, sum(x) FILTER (WHERE fails & before = 0 AND fails & bit > 0) AS toxic_lost
  FROM profiles, steps GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM counts
"""


def op11_sql(rounds: int = 4) -> str:
    """One pair of tables for each round: the entry of each part, and the codebooks made of them. Sums of products of integers are exact in doubles."""
    of = lambda k: f"""
assigned{k} AS MATERIALIZED (
  SELECT vec_id, p, min(CAST(list_inner_product(v, v) - 2 * list_inner_product(v, z) + list_inner_product(z, z) AS BIGINT) * 256 + e) AS code FROM pieces JOIN book{k} USING (p) GROUP BY vec_id, p
)"""  # noqa: E731
    next_ = lambda k: f"""
sums{k} AS (
  SELECT p, code % 256 AS e, i, floor(sum(v[i]) / count(*)) AS x FROM (SELECT p, code, v, unnest(range(1, len(v) + 1)) AS i FROM assigned{k} JOIN pieces USING (vec_id, p)) GROUP BY ALL
), book{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(n.z, b.z) AS z FROM book{k} b LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS z FROM sums{k} GROUP BY p, e) n USING (p, e)
)"""  # noqa: E731
    tables = ",".join(of(k) + "," + next_(k) for k in range(rounds)) + "," + of(rounds)
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS c, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS MATERIALIZED (
  SELECT vec_id, label, place, p, list_slice(c, CAST(p * len(c) // 4 + 1 AS BIGINT), CAST((p + 1) * len(c) // 4 AS BIGINT)) AS v FROM kept, range(4) AS r(p)
), book0 AS MATERIALIZED (
  SELECT p, place AS e, v AS z FROM pieces WHERE place < 256
), {tables}, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', code % 256), '' ORDER BY p) AS code, CAST(sum(code // 256) AS BIGINT) AS error FROM assigned{rounds} JOIN kept USING (vec_id) GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(z, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded
"""


def oracle_sql() -> dict[str, str]:
    tests = [(rule, cutoff) for rule, (_, cutoffs) in quality_rules.RULES.items() for cutoff in cutoffs]
    op3 = OP3_SQL.format(tests=", ".join(map(str, tests)), n_tests=len(tests), share=0.05 / len(quality_rules.RULES))
    return {"op3_quality_rules": op3, "op5_suffix_dedup": OP5_SQL, "op6_chat_format": OP6_SQL, "op7_near_duplicates": OP7_SQL, "op10_substring_dedup": OP10_SQL, "op11_code_compression": op11_sql(), "op13_filter_audit": OP13_SQL}
