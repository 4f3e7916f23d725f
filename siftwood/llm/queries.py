"""Queries of the operators for training data, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwood.llm import docpairs, packing, pii, provenance, secrets, splitting, tokenization
from siftwood.session import text_batches
from siftwood.tables import table

#: Tokens of a container.
CAPACITY = 2048


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id and boundary of every chunk above 512 estimated tokens."""
    text_batches(spark)
    return splitting.boundaries(table(spark, folder, "chunks").select("chunk_id", "text"))


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every chunk above 512 estimated tokens, with their lines and an overlap of 32 tokens."""
    text_batches(spark)
    return splitting.split_oversized(table(spark, folder, "chunks").select("chunk_id", "start_line", "text"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """file_id and reason of every file that nobody in the repository wrote by hand."""
    text_batches(spark)
    return provenance.found(table(spark, folder, "files"), table(spark, folder, "chunks"))


def p2_handwritten(spark: SparkSession, folder: str) -> DataFrame:
    """file_id, rel_path, role and size of the files that are left."""
    text_batches(spark)
    told = provenance.classified(table(spark, folder, "files"), table(spark, folder, "chunks"))
    return told.where("reason is null").select("file_id", "rel_path", "role", "size")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """symbol_id of every function and method whose doc says something."""
    return docpairs.pairs(table(spark, folder, "symbols")).select("symbol_id")


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """symbol_id, signature and description of the same."""
    return docpairs.pairs(table(spark, folder, "symbols"))


def p4_source(spark: SparkSession, folder: str) -> DataFrame:
    """The documented functions found in the text of chunks by the grammars of their languages."""
    text_batches(spark)
    return docpairs.source_pairs(table(spark, folder, "chunks"), table(spark, folder, "files"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id and line of every credential, and of every chunk into which one runs."""
    text_batches(spark)
    return secrets.found(table(spark, folder, "chunks"))


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id, file_id, text and n_masks of every chunk with its credentials masked."""
    text_batches(spark)
    return secrets.redact(table(spark, folder, "chunks"))


def p5_files(spark: SparkSession, folder: str) -> DataFrame:
    """file_id and redacted, brought up to date."""
    text_batches(spark)
    return secrets.updated_files(table(spark, folder, "files"), secrets.redact(table(spark, folder, "chunks")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, kind and found of every distinct value of personal information."""
    text_batches(spark)
    return pii.found(table(spark, folder, "documents"))


def p9_sanitized(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, text and n_replaced of every document with placeholders for what was found."""
    text_batches(spark)
    return pii.sanitized(table(spark, folder, "documents"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and the token ids of every document."""
    text_batches(spark)
    return tokenization.encode(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """bin_id, doc_id, piece, start and size: every document in containers of 2,048 tokens."""
    text_batches(spark)
    documents = table(spark, folder, "documents").select("doc_id", "text")
    sizes = tokenization.count_tokens(documents, ["doc_id"])
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """containers, tokens, and the share of the containers' space that is used."""
    packed = p8_packed(spark, folder).where("bin_id is not null")
    told = packed.groupBy("bin_id").agg(F.sum("size").alias("used")).agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"))
    return told.withColumn("share", F.round(F.col("tokens") / (F.col("containers") * CAPACITY), 6))


def p1_cover(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id, bytes, and what must be 0: bytes no piece covers, pieces above the limit, overlaps above 32 tokens."""
    one = p1_pieces(spark, folder)
    after = F.lead("start_byte").over(Window.partitionBy("chunk_id").orderBy("piece_no"))
    rows = one.select("chunk_id", "start_byte", "end_byte", F.octet_length("text").alias("n"), F.coalesce(after, F.col("end_byte")).alias("next"))
    size = F.max("end_byte")
    gaps = F.sum(F.greatest(F.col("next") - F.col("end_byte"), F.lit(0))) + F.min("start_byte")
    return rows.groupBy("chunk_id").agg(size.alias("bytes"), gaps.alias("gaps"), F.count_if(F.col("n") > 2048).alias("large"), F.count_if(F.col("end_byte") - F.col("next") > 128).alias("wide"))


def p5_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id, characters and line ends of every masked chunk: those of the chunk itself, since masks keep offsets and lines."""
    return p5_redacted(spark, folder).select("chunk_id", F.length("text").alias("chars"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("line_ends"))


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and the digest of the text that its ids decode to."""
    return tokenization.decode(p7_ids(spark, folder), "doc_id").select("doc_id", F.md5("text").alias("digest"))


def p9_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and characters of every document, told from its sanitised text, the placeholders taken out and the spans put back."""
    mark = F.lit(0)
    for kind, text in pii.PLACEHOLDERS.items():
        mark = mark + F.size(F.filter("spans", _of_kind(kind))) * len(text)
    spans = F.aggregate("spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"])
    return p9_sanitized(spark, folder).select("doc_id", (F.length("text") - mark + spans).alias("chars"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_handwritten, p4_found, p4_pairs, p4_source, p5_found, p5_redacted, p5_files, p7_ids, p8_packed, p8_fill, p9_found, p9_sanitized, p1_cover, p5_lengths, p7_round_trip, p9_lengths)}

SQL = {
    "p1_found": """
WITH c AS (
  SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL AND (strlen(text) + 3) // 4 > 512
), l AS (
  SELECT c.chunk_id, u.i, string_split(c.text, chr(10))[u.i] AS line
  FROM c, LATERAL (SELECT unnest(range(1, len(string_split(c.text, chr(10))) + 1)) AS i) u
), m AS (
  SELECT chunk_id, i, strlen(line) AS bytes, trim(line, ' ' || chr(9) || chr(13)) = '' AS blank FROM l
), r AS (
  SELECT chunk_id, bytes, blank, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id ORDER BY i) AS run FROM m
), t AS (
  SELECT chunk_id, run, (sum(bytes) + count(*) - 1 + 3) // 4 AS run_tokens, max((bytes + 3) // 4) AS line_tokens
  FROM r WHERE NOT blank GROUP BY 1, 2
), w AS (
  SELECT chunk_id, max((bytes + 3) // 4) AS line_tokens FROM m GROUP BY 1
)
SELECT c.chunk_id, CASE WHEN coalesce(max(t.run_tokens), 0) <= 512 THEN 'blank' WHEN max(w.line_tokens) <= 512 THEN 'line' ELSE 'inside' END AS boundary
FROM c LEFT JOIN t USING (chunk_id) JOIN w USING (chunk_id) GROUP BY c.chunk_id
""",
    "p1_cover": "SELECT DISTINCT chunk_id, strlen(text) AS bytes, 0 AS gaps, 0 AS large, 0 AS wide FROM chunks WHERE (strlen(text) + 3) // 4 > 512",
    "p5_lengths": "SELECT DISTINCT chunk_id, length(text) AS chars, length(text) - length(replace(text, chr(10), '')) AS line_ends FROM chunks",
    "p7_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p9_lengths": "SELECT doc_id, length(text) AS chars FROM documents",
}
