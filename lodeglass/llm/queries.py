"""Queries of the problems tagged llm, over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeglass.llm.credentials import credentials, mask_credentials
from lodeglass.llm.documented import documented_functions, with_code
from lodeglass.llm.handwritten import file_origins
from lodeglass.llm.leakage import leaked_passages, leaks_by_item
from lodeglass.llm.packing import fill, pack_documents
from lodeglass.llm.personal import personal_spans, redact_personal
from lodeglass.llm.pieces import split_oversized
from lodeglass.llm.validity import acceptance, parsed_files, parser_disagreement
from lodeglass.session import table


def p1_origins(spark: SparkSession, root: str) -> DataFrame:
    return file_origins(table(spark, root, "files"), table(spark, root, "file_content"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return p1_origins(spark, root).where("origin is not null").select("file_id").distinct()


def p2_credentials(spark: SparkSession, root: str) -> DataFrame:
    return credentials(table(spark, root, "files"), table(spark, root, "file_content"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return p2_credentials(spark, root).select("file_id", "line_no").distinct()


def p2_masked(spark: SparkSession, root: str) -> DataFrame:
    contents = table(spark, root, "file_content").select("file_id", "path", "content")
    return mask_credentials(contents, credentials(table(spark, root, "files"), contents, unnamed=True))


def p4_parsed(spark: SparkSession, root: str) -> DataFrame:
    return parsed_files(table(spark, root, "files"), table(spark, root, "file_content"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return p4_parsed(spark, root).where("not valid").select("file_id").distinct()


def p4_rates(spark: SparkSession, root: str) -> DataFrame:
    return acceptance(p4_parsed(spark, root))


def p4_disagreement(spark: SparkSession, root: str) -> DataFrame:
    return parser_disagreement(p4_parsed(spark, root), table(spark, root, "files"))


def p5_pairs(spark: SparkSession, root: str) -> DataFrame:
    symbols = table(spark, root, "symbols")
    return with_code(documented_functions(symbols, table(spark, root, "file_content")), symbols)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return documented_functions(table(spark, root, "symbols"), table(spark, root, "file_content")).select("symbol_id").distinct()


def p7_pieces(spark: SparkSession, root: str) -> DataFrame:
    return split_oversized(table(spark, root, "file_content"), table(spark, root, "symbols"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return p7_pieces(spark, root).select("item_kind", "item_key").distinct()


def p7_cover(spark: SparkSession, root: str) -> DataFrame:
    """What each item's pieces cover: bytes of its own, pieces within the limit, gaps or overlaps that are too long."""
    item = Window.partitionBy("item_kind", "item_key").orderBy("piece_no")
    pieces = p7_pieces(spark, root).withColumn("before", F.lag("end_byte").over(item))
    wrong = F.col("before").isNotNull() & ((F.col("own_start_byte") != F.col("before")) | (F.col("own_start_byte") - F.col("start_byte") > 8_000) | (F.col("own_start_byte") <= F.col("start_byte")))
    return pieces.groupBy("item_kind", "item_key").agg(
        F.sum(F.col("end_byte") - F.col("own_start_byte")).cast("long").alias("bytes"), F.count_if(F.col("end_byte") - F.col("start_byte") > 24_000).cast("long").alias("too_long"), F.count_if(wrong).cast("long").alias("wrong_joins")
    )


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    return pack_documents(table(spark, root, "documents"))


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    return fill(p8_containers(spark, root))


def p9_passages(spark: SparkSession, root: str) -> DataFrame:
    return leaked_passages(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return p9_passages(spark, root).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, root: str) -> DataFrame:
    return leaks_by_item(p9_passages(spark, root))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return personal_spans(table(spark, root, "documents")).select("doc_id", "pii_kind", "line_no").distinct()


def p10_redacted(spark: SparkSession, root: str) -> DataFrame:
    return redact_personal(table(spark, root, "documents")).select("doc_id", "text", "pii_found")


_P7 = """
SELECT DISTINCT 'file' AS item_kind, CAST(file_id AS VARCHAR) AS item_key FROM file_content WHERE strlen(content) > 24000
UNION SELECT DISTINCT 'symbol', id FROM symbols WHERE end_byte - start_byte > 24000
"""


_P7_COVER = """
SELECT 'file' AS item_kind, CAST(file_id AS VARCHAR) AS item_key, CAST(strlen(max(content)) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS wrong_joins
FROM file_content WHERE strlen(content) > 24000 AND file_id IS NOT NULL GROUP BY file_id
UNION ALL SELECT DISTINCT 'symbol', id, CAST(end_byte - start_byte AS BIGINT), 0, 0 FROM symbols WHERE end_byte - start_byte > 24000
"""


def queries() -> dict:
    own = (p1_found, p1_origins, p2_found, p2_credentials, p2_masked, p4_found, p4_parsed, p4_rates, p4_disagreement, p5_found, p5_pairs, p7_found, p7_pieces, p7_cover, p8_containers, p8_fill, p9_found, p9_passages, p9_items, p10_found, p10_redacted)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict:
    return {"p7_found": _P7, "p7_cover": _P7_COVER}
