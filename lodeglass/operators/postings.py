"""Full-text index of symbols: positional postings, and BM25 of phrase prefixes over four weighted columns.

Words are runs of letters and digits in lower case. A phrase is a run of words in one column, of which the last may be
a prefix. Numbers of documents and lengths are global: filters on kind or language don't change a score.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeglass.functions.text import phrases, words

# Weights of the columns, and the constants of BM25.
COLUMN_WEIGHTS = {"name": 3.0, "qualified_name": 2.0, "signature": 1.0, "summary": 1.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _hits(tokens: Column, phrase: Sequence[str]) -> Column:
    """How often a phrase prefix stands in an array of words."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda x: x.startswith(phrase[0])))

    def here(x: Column, i: Column) -> Column:
        tests = [x == phrase[0]] + [F.get(tokens, i + k) == w for k, w in enumerate(phrase[1:-1], 1)] + [F.get(tokens, i + len(phrase) - 1).startswith(phrase[-1])]
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))

    return F.size(F.filter(tokens, here))


def _idf(total: Column, n: Column) -> Column:
    raw = F.log((total - n + 0.5) / (n + 0.5))
    return F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)


def _score(parts: Sequence[tuple[Column, Column]], length: Column, mean: Column) -> Column:
    """-sum of idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * D / avgD)); the lower the better."""
    norm = K1 * ((1 - B) + B * length / mean)
    return -reduce(lambda a, b: a + b, (idf * f * (K1 + 1) / (f + norm) for idf, f in parts))


def bm25(symbols: DataFrame, query: str, key: str | None = None) -> DataFrame:
    """The symbols with bm25_score, null for those without a hit; all null if the query has no phrase.

    One scan of the symbols for the global numbers, which are one row, and one for the scores; nothing is shuffled.
    Null columns have no words. Repeated rows count as often as they come, unless `key` tells them apart: then each key
    counts once in the global numbers, for which key and numbers alone are shuffled, and every row gets its score.
    """
    found = phrases(query)
    if not found:
        return symbols.withColumn("bm25_score", F.lit(None).cast("double"))
    tokens = {c: words(c) for c in COLUMN_WEIGHTS}
    weighted = [reduce(lambda a, b: a + b, (F.lit(w) * _hits(tokens[c], p) for c, w in COLUMN_WEIGHTS.items())) for p in found]
    length = reduce(lambda a, b: a + b, (F.size(t) for t in tokens.values())).cast("double")
    counted = symbols.select("*", length.alias("_length"), *(f.alias(f"_f{k}") for k, f in enumerate(weighted)))
    numbers = ["_length", *(f"_f{k}" for k in range(len(found)))]
    once = counted if key is None else counted.groupBy(key).agg(*(F.max(c).alias(c) for c in numbers))
    totals = once.agg(F.count("*").cast("double").alias("_n"), F.avg("_length").alias("_mean"), *(F.count_if(F.col(f"_f{k}") > 0).cast("double").alias(f"_n{k}") for k in range(len(found))))
    joined = counted.join(F.broadcast(totals))  # one row
    any_hit = reduce(lambda a, b: a | b, (F.col(f"_f{k}") > 0 for k in range(len(found))))
    score = _score([(_idf(F.col("_n"), F.col(f"_n{k}")), F.col(f"_f{k}")) for k in range(len(found))], F.col("_length"), F.col("_mean"))
    return joined.select(*symbols.columns, F.when(any_hit, score).alias("bm25_score"))


def build_postings(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths): term, id, col, pos of every word, and the number of words of every symbol. Write postings
    sorted by term, so that a search for prefixes reads only the row groups that hold them."""
    per = [symbols.select("id", F.lit(c).alias("col"), F.posexplode(words(c)).alias("pos", "term")) for c in COLUMN_WEIGHTS]
    postings = reduce(lambda a, b: a.unionByName(b), per).select("term", "id", "col", "pos")
    lengths = symbols.select("id", reduce(lambda a, b: a + b, (F.size(words(c)) for c in COLUMN_WEIGHTS)).alias("length"))
    return postings, lengths


def write_postings(symbols: DataFrame, path: str, partitions: int | None = None) -> None:
    """Postings sorted by term in ranges, lengths beside them."""
    postings, lengths = build_postings(symbols)
    ranged = postings.repartitionByRange(partitions, "term", "id") if partitions else postings.repartitionByRange("term", "id")
    ranged.sortWithinPartitions("term", "id", "col", "pos").write.mode("overwrite").parquet(f"{path}/postings")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")


def bm25_from_postings(postings: DataFrame, lengths: DataFrame, query: str) -> DataFrame:
    """id and bm25_score of the symbols with a hit, from postings: prefix filters reach the scan, phrases of several
    words are joined on successive positions, and only symbols with a hit are shuffled."""
    found = phrases(query)
    if not found:
        return lengths.select("id", F.lit(None).cast("double").alias("bm25_score")).limit(0)
    weight = F.create_map(*(F.lit(x) for kv in COLUMN_WEIGHTS.items() for x in kv))
    parts = []
    for k, p in enumerate(found):
        at = postings.where(F.col("term").startswith(p[0]) if len(p) == 1 else F.col("term") == p[0]).select("id", "col", "pos")
        for n, w in enumerate(p[1:], 1):
            last = n == len(p) - 1
            step = postings.where(F.col("term").startswith(w) if last else F.col("term") == w).select("id", "col", (F.col("pos") - n).alias("pos"))
            at = at.join(step, ["id", "col", "pos"], "left_semi")
        parts.append(at.select("id", F.lit(k).alias("k"), weight[F.col("col")].alias("w")))
    hits = reduce(lambda a, b: a.unionByName(b), parts).groupBy("id", "k").agg(F.sum("w").alias("f"))
    numbers = hits.groupBy("k").agg(F.count("*").cast("double").alias("n"))
    totals = lengths.agg(F.count("*").cast("double").alias("total"), F.avg("length").alias("mean"))
    scored = hits.join(F.broadcast(numbers), "k").join(F.broadcast(totals)).join(lengths, "id")  # a row a phrase, and one row
    norm = K1 * ((1 - B) + B * F.col("length") / F.col("mean"))
    return scored.groupBy("id").agg((-F.sum(_idf(F.col("total"), F.col("n")) * F.col("f") * (K1 + 1) / (F.col("f") + norm))).alias("bm25_score"))


def content_hits(contents: DataFrame, query: str) -> Column:
    """Whether any phrase prefix of the query stands in column content; null if the query has none."""
    found = phrases(query)
    if not found:
        return F.lit(None).cast("boolean")
    tokens = words("content")
    return reduce(lambda a, b: a | b, (_hits(tokens, p) > 0 for p in found))


def first_candidates(rows: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first n rows in an order: each partition keeps n, then n of those."""
    return rows.orderBy(*order).limit(n)


def ranks(rows: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """The rows of a result that is small by a limit, numbered in an order."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))
