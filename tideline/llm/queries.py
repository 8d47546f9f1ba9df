"""The corpus operators as named queries over whole tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer_path

from tideline.llm import bitplanes, bpe, fingerprints, jaccard, language_model, merkle, mixing, neighbours, pieces, sharding, substrings, toxicity, whitening

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/documents.parquet")


@query
def op1_jaccard_join(spark, root):
    return jaccard.jaccard_components(documents(spark, root), k=3, num=9, den=10)


@query
def op4_substring_dedup(spark, root):
    cut = substrings.remove_repeats(documents(spark, root), width=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op3_sharding(spark, root):
    docs = sharding.sharded(documents(spark, root).select("doc_id", "text"), shards=16, plain_scan=True)
    content = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(content).cast("long") + 1).alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_mix_sources(spark, root):
    docs = documents(spark, root).select("doc_id", "source")
    return mixing.mix_sources(docs)


@query
def op7_toxicity(spark, root):
    labels = spark.read.parquet(f"{root}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.toxicity(documents(spark, root).select("doc_id", "text"), labels)
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op9_fingerprints(spark, root):
    table = fingerprints.fingerprint_table(documents(spark, root))
    return fingerprints.with_classes(table, radius=3).drop("hi", "lo")


@query
def op8_token_ids(spark, root):
    return bitplanes.token_id_table(documents(spark, root), tokenizer_path("byte_bpe_50k.json"))


def encoded_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids, and whether decoding gives back the text."""
    vocabulary = pieces.load_pieces(tokenizer_path("piece_bpe_32k.model"))
    both = pieces.decode_pieces(pieces.encode_pieces(docs, vocabulary), vocabulary)
    low, high = int(vocabulary.byte_ids.min()), int(vocabulary.byte_ids.max())
    return both.select(
        *[c for c in docs.columns if c != "text"], F.size("ids").cast("long").alias("n_pieces"),
        F.size(F.filter("ids", lambda i: i.between(low, high))).cast("long").alias("n_byte_pieces"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


@query
def op6_piece_encoding(spark, root):
    return encoded_documents(documents(spark, root).select("doc_id", "text"))


@query
def op10_nearest_neighbours(spark, root):
    return neighbours.nearest(spark.read.parquet(f"{root}/embeddings.parquet"))


@query
def op5_language_model(spark, root):
    return language_model.score_texts(documents(spark, root))


@query
def op11_bpe(spark, root):
    vocabulary = bpe.load_vocabulary(tokenizer_path("byte_bpe_50k.json"))
    encoded = bpe.encode_texts(documents(spark, root).select("doc_id", "text"), vocabulary).drop("text")
    both = bpe.decode_texts(encoded, vocabulary)
    return both.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op12_merkle_manifest(spark, root):
    return merkle.document_proofs(documents(spark, root))


def _hash_of(text: str) -> str:
    """DuckDB SQL of a row's leaf, with ``text`` as its text."""
    parts = [f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
             for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


# Trees level by level; every level of the groups' trees has the number of its group, the tree over them is group -1.
SQL["op12_merkle_manifest"] = f"""WITH RECURSIVE
docs AS (
  SELECT *, {_hash_of("text")} AS leaf, {_hash_of("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered,
    xor(list_reduce([4294967295] || list_transform(split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
      lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, z: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) AS crc
  FROM documents),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp FROM (SELECT DISTINCT lang FROM docs)),
placed AS (
  SELECT d.*, grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM docs d JOIN langs l ON d.lang IS NOT DISTINCT FROM l.lang),
low(grp, level, pos, node, n) AS (
  SELECT grp, 0, pos, leaf, count(*) OVER (PARTITION BY grp) FROM placed
  UNION ALL
  SELECT grp, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 7) // 8
  FROM low WHERE n > 1 GROUP BY grp, level, pos // 8),
top(level, pos, node, n) AS (
  SELECT 0, grp, node, count(*) OVER () FROM low WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 7) // 8
  FROM top WHERE n > 1 GROUP BY level, pos // 8),
height AS (SELECT grp, max(level) AS h FROM low GROUP BY grp),
nodes AS (
  SELECT grp, level, pos, node, n FROM low WHERE n > 1
  UNION ALL SELECT g.grp, h + level, pos, node, n FROM top, height g WHERE n > 1),
place AS (
  SELECT p.grp, p.pos, level, CASE WHEN level < h THEN p.pos // CAST(8 ** level AS BIGINT) ELSE p.grp // CAST(8 ** (level - h) AS BIGINT) END AS spot
  FROM placed p JOIN height USING (grp) JOIN (SELECT DISTINCT grp, level FROM nodes) USING (grp)),
runs AS (
  SELECT p.grp, p.pos, p.level,
    coalesce(string_agg(node, '' ORDER BY n.pos) FILTER (WHERE n.pos < spot), '') AS before,
    coalesce(string_agg(node, '' ORDER BY n.pos) FILTER (WHERE n.pos > spot), '') AS after
  FROM place p JOIN nodes n ON n.grp = p.grp AND n.level = p.level AND n.pos // 8 = spot // 8
  GROUP BY p.grp, p.pos, p.level),
proofs AS (SELECT grp, pos, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM runs GROUP BY grp, pos),
folds(grp, pos, level, node) AS (
  SELECT grp, pos, 0, CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END FROM placed
  UNION ALL
  SELECT f.grp, f.pos, f.level + 1, sha256(before || node || after)
  FROM folds f JOIN runs r ON f.grp = r.grp AND f.pos = r.pos AND f.level = r.level),
folded AS (SELECT grp, pos, arg_max(node, level) AS node FROM folds GROUP BY grp, pos)
SELECT doc_id, leaf, s.node AS subroot, t.node AS root, coalesce(proof, sha256('')) AS proof_sha256,
  f.node AS folded_root, f.node = t.node AS verified
FROM placed p JOIN folded f USING (grp, pos) LEFT JOIN proofs USING (grp, pos)
JOIN (SELECT grp, node FROM low WHERE n = 1) s USING (grp), (SELECT node FROM top WHERE n = 1) t"""


@query
def op13_embedding_whitening(spark, root):
    return whitening.whiten(spark.read.parquet(f"{root}/embeddings.parquet"))
