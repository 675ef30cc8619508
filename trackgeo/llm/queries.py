"""The registered queries: each applies its operator to its whole table and derives the digests it returns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackgeo.llm import (
    bitmask_codes, chat, decontaminate, gru, packing, periodic_runs, quality, simhash, substrings, token_lists, token_scan, toxicity,
    url_filters)
from trackgeo.llm.common import words_column
from trackgeo.session import new_path

TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
CATEGORIES = ["low_quality", "toxic"]
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filters.filter_urls(table(spark, sf, "pages").select("page_id", "url"), rules).drop("url")


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fits AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM named)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM fits"""


def op2_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = chat.read_back(chat.format_chat(chat.canonical_turns(rows), "conv_id", "turn"))
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
        .alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


def _sql_escape(value: str) -> str:
    out = f"replace({value}, '\\', '\\e')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{('\\l' if c[0] == '<' else '\\b') + c[1:]}')"
    return out


OP2_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum({len(chat.TURN) + len(chat.END) + 2}
             + length(replace({_sql_escape('role')}, chr(10), '\\n')) + length({_sql_escape('text')})) AS size
  FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       size::BIGINT AS formatted_chars FROM whole"""


def op3_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = substrings.dedup_substrings(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
flat AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM words),
windows AS (
  SELECT doc_id, pos, array_to_string(w[pos:pos + {substrings.WIDTH - 1}], ' ') AS seq FROM flat
  WHERE pos <= len(w) - {substrings.WIDTH - 1}),
firsts AS (SELECT seq, min(doc_id) AS least FROM windows GROUP BY seq),
hit AS (
  SELECT DISTINCT doc_id, pos + unnest(range({substrings.WIDTH})) AS pos FROM windows JOIN firsts USING (seq) WHERE doc_id > least),
kept AS (
  SELECT f.doc_id, string_agg(f.w[f.pos], ' ' ORDER BY f.pos) AS text, count(*) AS n
  FROM flat f ANTI JOIN hit h ON f.doc_id = h.doc_id AND f.pos = h.pos GROUP BY f.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)"""


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    models = toxicity.fit_chain(docs, toxic_labels(spark, sf), CATEGORIES)
    return toxicity.score_chain(docs, models, CATEGORIES).select(
        "doc_id", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in CATEGORIES], F.col("rejected").alias("toxic"))


def toxic_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    trusted = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return quality.judge_quality(docs, trusted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark)
    token_scan.write_token_files(table(spark, sf, "documents"), path, public_tokenizers.path(TOKENIZER))
    return token_scan.scan_token_files(spark, path).select("doc_id", "n_tokens")


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op8_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, sf, "documents"), public_tokenizers.path(TOKENIZER))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex(F.get("fingerprint", F.lit(0))), 16, "0")).alias("fingerprint"), "component_id")


def op10_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return gru.score_texts(table(spark, sf, "documents"))


def op11_token_lists(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark)
    token_lists.write_token_lists(table(spark, sf, "documents"), path, public_tokenizers.path(BYTE_TOKENIZER))
    return token_lists.checksums(token_lists.read_token_lists(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    coded, books = bitmask_codes.encode_vectors(table(spark, sf, "embeddings"))
    return coded.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
                        F.lit(bitmask_codes.codebooks_digest(books)).alias("codebooks_sha256"))


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """Each tenth document (by CRC) repeats a stretch of its words from some place on; the others stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    bound = F.transform(F.array(words_column(F.col("text"))), lambda w: F.struct(w.alias("w"), F.size(w).alias("n")))
    cut = F.transform(bound, lambda s: F.struct(
        s["w"].alias("w"), s["n"].alias("n"), F.pmod(F.floor(h / 10), s["n"]).cast("int").alias("a")))
    stepped = F.transform(cut, lambda s: F.struct(s["w"].alias("w"), s["n"].alias("n"), s["a"].alias("a"), (
        1 + F.floor((s["n"] - s["a"]) / (3 + F.pmod(F.floor(h / 10), F.lit(8))))).cast("int").alias("p")))
    planted = F.transform(stepped, lambda s: F.concat(F.slice(s["w"], F.lit(1), s["a"]), F.slice(F.flatten(F.array_repeat(
        F.slice(s["w"], s["a"] + 1, s["p"]), F.ceil((s["n"] - s["a"]) / s["p"]).cast("int"))), F.lit(1), s["n"] - s["a"])))
    chosen = (h % 10 == 0) & F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return docs.withColumn("text", F.when(chosen, F.array_join(F.get(planted, F.lit(0)), " ")).otherwise(F.col("text")))


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = _with_planted_periods(table(spark, sf, "documents").select("doc_id", "text"))
    return periodic_runs.mark_runs(docs, carry=["doc_id"]).select(
        "doc_id", "n_runs", *periodic_runs.BEST, periodic_runs.runs_digest().alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_url_filters, op2_chat_format, op3_substring_dedup, op4_toxicity, op5_quality_rules, op6_token_counts,
        op7_decontamination, op8_best_fit_packing, op9_simhash, op10_lm_scoring, op11_token_lists,
        op12_vector_codes, op13_periodic_runs)}
ORACLES = {"op1_url_filters": OP1_SQL, "op2_chat_format": OP2_SQL, "op3_substring_dedup": OP3_SQL}
