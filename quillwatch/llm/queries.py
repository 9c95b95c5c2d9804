"""Registered queries of the operators of this folder, each next to the SQL that states the same result where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwatch.llm import bpe, byte_bpe, chat, decontam, fim, merkle, minhash, quality, secret_scan, substring, topk, toxicity, warc
from quillwatch.llm.training import remainder, small_batches
from quillwatch.sources.shared import materialize, new_folder
from quillwatch.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


CHAT_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
o AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t) AS before,
    length(regexp_replace(regexp_replace(t, '##(\\*)# ', '##\1\\# ', 'g'), '<(\\*)/(turn|part)>', '<\1\\/\2>', 'g')) AS n_text,
    length(regexp_replace(regexp_replace(regexp_replace(role, '##(\\*)# ', '##\1\\# ', 'g'), '<(\\*)/(turn|part)>', '<\1\\/\2>', 'g'), ':(\\*)' || chr(10), ':\1\\' || chr(10), 'g')) AS n_role
  FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_text + CASE WHEN before IS NULL OR before <> role THEN 4 + n_role + 2 + 8 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""


@query("op1_chat_format", CHAT_SQL)
def op1(spark: SparkSession, root: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, root, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.format_chats(rows).select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"),
                                          F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"])), "").alias("loss"))
    lines = F.flatten(F.transform("turns", lambda t: F.transform(t["parts"], lambda p: F.concat(t["role"], F.lit("\n"), p, F.lit("\n")))))
    return back.select("conv_id", lines.alias("lines"), "loss", "formatted").select(
        "conv_id", F.size("lines").cast("long").alias("n_turns"), F.sha2(F.array_join("lines", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query("op2_decontam")
def op2(spark: SparkSession, root: str) -> DataFrame:
    small_batches(spark)
    return decontam.find(table(spark, root, "documents"), table(spark, root, "benchmark"))


@query("op3_toxicity")
def op3(spark: SparkSession, root: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, root, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, root, "labels"), remainder(F.col("doc_id"), 5) != 0)
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return toxicity.classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op4_substring")
def op4(spark: SparkSession, root: str) -> DataFrame:
    small_batches(spark)
    return substring.repeated(table(spark, root, "documents"))


def vocabulary() -> str:
    """Path of the public vocabulary file that the queries use."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op5_bpe")
def op5(spark: SparkSession, root: str) -> DataFrame:
    small_batches(spark)
    words = bpe.read_vocabulary(vocabulary())
    rows = table(spark, root, "documents").select("doc_id", bpe.encoder(words)(F.coalesce("text", F.lit(""))).alias("ids"))
    rows = rows.select("doc_id", "ids", bpe.decoder(words)(F.col("ids")).alias("decoded"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_quality")
def op6(spark: SparkSession, root: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, root, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, root, "labels"), remainder(F.col("doc_id"), 3) != 1)
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return quality.classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op7_minhash")
def op7(spark: SparkSession, root: str) -> DataFrame:
    small_batches(spark)
    found = minhash.cluster(table(spark, root, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def owner_of_source() -> tuple[Column, Column]:
    """The owner is a document's source; a repository is its source and language."""
    return F.col("source"), F.concat_ws("/", "source", "lang")


@query("op8_secret_scan")
def op8(spark: SparkSession, root: str) -> DataFrame:
    found = secret_scan.find(table(spark, root, "documents"), *owner_of_source())
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
                        secret_scan.listed(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"))


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""


@query("op9_topk", TOPK_SQL)
def op9(spark: SparkSession, root: str) -> DataFrame:
    return topk.search(table(spark, root, "embeddings"), F.col("vec_id") % 100 == 0)


WARC_SQL = """
WITH r AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
d AS (SELECT page_id, octet_length(encode(p)) AS n, p, sha1(p) AS h FROM r),
f AS (SELECT *, min(page_id) OVER (PARTITION BY p) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, CAST(k // 4 * 5 + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


@query("op10_warc", WARC_SQL)
def op10(spark: SparkSession, root: str) -> DataFrame:
    path = new_folder(spark, "warc")
    warc.write_archives(table(spark, root, "pages"), path)
    return warc.page_records(materialize(warc.read_archives(spark, path), "warc-records"))


def byte_ranks() -> tuple[str, str]:
    """The public ranks that the query uses, and their word pattern."""
    import public_tokenizers
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


@query("op11_byte_bpe")
def op11(spark: SparkSession, root: str) -> DataFrame:
    small_batches(spark)
    ranks = byte_ranks()
    rows = table(spark, root, "documents").select("doc_id", byte_bpe.encoder(*ranks)(F.coalesce("text", F.lit(""))).alias("ids"))
    rows = rows.select("doc_id", "ids", byte_bpe.decoder(*ranks)(F.col("ids")).alias("decoded"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


FIM_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines FROM documents),
c AS (
  SELECT *, len(lines) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(lines) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(lines) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (
  SELECT doc_id, n, form, text, coalesce(array_to_string(lines[1:least(a, b)], ''), '') AS prefix, coalesce(array_to_string(lines[least(a, b) + 1:greatest(a, b)], ''), '') AS middle,
    coalesce(array_to_string(lines[greatest(a, b) + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


@query("op12_fill_in_middle", FIM_SQL)
def op12(spark: SparkSession, root: str) -> DataFrame:
    small_batches(spark)
    made = fim.transform(table(spark, root, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def manifest_fields(n_chars: Column) -> list[Column]:
    return [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]


@query("op13_merkle_manifest")
def op13(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    changed = F.when(remainder(F.col("doc_id"), 7) == 0, merkle.leaf(*manifest_fields(F.col("n_chars") + 1)))
    carry = F.struct("doc_id", changed.alias("changed"))
    rows = merkle.manifest(docs, merkle.leaf(*manifest_fields(F.col("n_chars"))), F.col("lang"), F.col("doc_id"), carry)
    back = merkle.folded(F.coalesce("carry.changed", "leaf"), F.col("path"))
    rows = rows.select("carry.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
