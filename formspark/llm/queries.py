"""The registered queries of this package: one for each operator, over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from formspark.llm import audio, bpe, filter_audit, langid, masked_lm, minhash, preferences, quality, resampling, shards, simhash, wrapper
from formspark.llm.common import read, remainder, shared_folder
from formspark.llm.decontaminate import decontaminate

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
ORDER_KEY = 20_011


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the conditional log-probabilities of every document's words."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return masked_lm.score(docs, masked_lm.train(docs)).select("doc_id", "n_words", "log_likelihood", "per_word")


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of the documents' byte ids as read back from the shards: its slot, its number in the stream, its digest."""
    folder = f"{shared_folder(spark)}/order-{uuid.uuid4().hex}"
    order = shards.write_order(read(spark, sf_dir, "documents"), "text", folder, key=ORDER_KEY)
    return shards.read_order(spark, order).select("slot", "shard", "place", "sequence", F.length("record").cast("long").alias("n_ids"), F.sha2("record", 256).alias("sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from ``labels``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with its neighbour's last reply, as prompt and two masked completions."""
    pairs = preferences.format_preferences(*preferences.swapped_replies(read(spark, sf_dir, "conversations")))

    def spans(name: str) -> Column:
        return F.array_join(F.transform(name, lambda s: F.concat_ws("-", s["start"], s["stop"])), ",").alias(name)

    return pairs.select("pair_id", "part", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"), "prompt_turns")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return wrapper.main_text(read(spark, sf_dir, "pages"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the bytes they decode to, for every document."""
    return bpe.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY).select(
        "doc_id", bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, and whether its text is unlike what that language shows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.drop("lang"), langid.fit(langid.learnable(docs)))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie inside a window of a benchmark item, and the items met."""
    found = decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest document linked to it."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@F.pandas_udf(BinaryType())
def _melody(vectors: pd.Series) -> pd.Series:
    return pd.Series([audio.melody(v) for v in vectors], dtype=object)


@F.pandas_udf(BinaryType())
def _clip(sounds: pd.Series, ids: pd.Series) -> pd.Series:
    return pd.Series([audio.clip(x, 10 * audio.HOP, 54 * audio.HOP, int(k)) for x, k in zip(sounds, ids, strict=True)], dtype=object)


def op10_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings made from the vectors of ``embeddings``: each one's class of equal fingerprints (kind
    ``member``), and the classes that hold a noisy clip of every recording whose id is divisible by 50 (kind ``link``)."""
    sounds = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), _melody("embedding").alias("pcm"))
    clips = sounds.where(F.col("id") % 50 == 0).select("id", _clip("pcm", "id").alias("pcm"))
    classes, links = audio.align(audio.fingerprints(clips), audio.fingerprints(sounds))
    members = classes.select(F.lit("member").alias("kind"), "id", "class_id", *[F.lit(None).cast("bigint").alias(n) for n in ("offset", "votes", "bit_errors", "bits")])
    return members.unionByName(links.withColumn("kind", F.lit("link")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order of five filters removes at every step, for each language."""
    return filter_audit.audit_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of shingles of every document and the smallest document linked to it."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document towards the benchmark's words, and the rank of the best twentieth."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = resampling.resample(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pseudo_likelihood, op2_training_order, op3_quality, op4_preferences, op5_main_text, op6_byte_bpe, op7_language, op8_decontaminate, op9_simhash, op10_chroma, op11_filter_audit, op12_minhash, op13_importance_resampling)}
ORACLE_SQL: dict[str, str] = {
    "op4_preferences": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
l AS (SELECT conv_id, max({'turn': turn, 'text': text}) AS m FROM t WHERE role = 'assistant' GROUP BY conv_id),
s AS (SELECT l.conv_id, l.m.turn AS last_turn, o.m.text AS reply FROM l LEFT JOIN l AS o ON o.conv_id = xor(l.conv_id, 1)),
k AS (SELECT t.*, s.last_turn, s.reply, coalesce(t.turn = s.last_turn AND role = 'assistant', false) AS swapped FROM t LEFT JOIN s USING (conv_id) WHERE s.last_turn IS NULL OR t.turn <= s.last_turn),
b AS (SELECT conv_id, turn, role, text, true AS c, false AS r FROM k
  UNION ALL SELECT conv_id, turn, role, CASE WHEN swapped THEN reply ELSE text END, false, true FROM k WHERE NOT swapped OR reply IS NOT NULL),
g AS (SELECT conv_id, turn, role, text, bool_or(c) AS c, bool_or(r) AS r FROM b GROUP BY ALL),
f AS (SELECT conv_id, min(turn) AS low, min(turn) FILTER (WHERE NOT (c AND r)) AS cut FROM g GROUP BY conv_id),
p AS (SELECT g.*, (turn - low) // 1000 AS part, coalesce(turn < cut, true) AS common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece FROM g JOIN f USING (conv_id)),
w AS (SELECT *, coalesce(sum(CASE WHEN NOT common AND c THEN length(piece) ELSE 0 END) OVER prior, 0)::BIGINT AS c_at, coalesce(sum(CASE WHEN NOT common AND r THEN length(piece) ELSE 0 END) OVER prior, 0)::BIGINT AS r_at
  FROM p WINDOW prior AS (PARTITION BY conv_id, part ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id AS pair_id, part,
  coalesce(string_agg(piece, '' ORDER BY turn, role, text) FILTER (WHERE common), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY turn, role, text) FILTER (WHERE NOT common AND c), '') AS chosen,
  coalesce(string_agg(piece, '' ORDER BY turn, role, text) FILTER (WHERE NOT common AND r), '') AS rejected,
  coalesce(string_agg((c_at + length(role) + 5) || '-' || (c_at + length(piece)), ',' ORDER BY turn, role, text) FILTER (WHERE NOT common AND c AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((r_at + length(role) + 5) || '-' || (r_at + length(piece)), ',' ORDER BY turn, role, text) FILTER (WHERE NOT common AND r AND role = 'assistant'), '') AS rejected_mask,
  count(*) FILTER (WHERE common)::INTEGER AS prompt_turns
FROM w GROUP BY conv_id, part""",
    "op11_filter_audit": """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT p.k || q.k || r.k || s.k || t.k AS filter_order FROM k p, k q, k r, k s, k t
  WHERE p.k NOT IN (q.k, r.k, s.k, t.k) AND q.k NOT IN (r.k, s.k, t.k) AND r.k NOT IN (s.k, t.k) AND s.k <> t.k),
s AS (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM o),
x AS (SELECT m.*, s.filter_order, s.step, substr(s.filter_order, s.step, 1) AS letter, list_transform(string_split(s.filter_order, ''), lambda z: CASE z WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS fails FROM m, s),
y AS (SELECT *, coalesce(list_position(fails, true), 6) AS gone, fails[step] AS here, len(list_filter(fails, lambda z: z)) = 1 AS alone FROM x),
z AS (SELECT part, filter_order, step, letter, sum(CASE WHEN gone > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN here AND gone < step THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN here AND alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN gone = step THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM z""",
    "op12_minhash": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingles FROM w),
e AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
l AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(doc_id, there) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.there),
c AS (SELECT doc_id, min(there) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""",
}
