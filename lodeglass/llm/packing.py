"""Items of varying length put into containers of fixed capacity: best fit planned over lengths, not over items.

Items are counted per length; there are no more lengths than the capacity has units, so the driver plans best-fit
decreasing over the counts. The plan says which ranks of a length go into which containers. Every item then takes the
slot of its rank within its length. Ranks are taken within salted parts of a length, so that a length that most items
have isn't gathered in one place.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodeglass.session import cut


@dataclass(frozen=True)
class Slots:
    """`each` items of `length` in every container from `container` on; their ranks begin at `rank`, there are `count`
    containers, and the items stand at `position` and `offset` in them."""

    length: int
    rank: int
    count: int
    each: int
    container: int
    position: int
    offset: int


def plan_containers(counts: dict[int, int], capacity: int) -> tuple[list[Slots], int]:
    """Best-fit decreasing over counts: every length, from the longest, goes into the fullest containers that can take
    it. Containers with the same content are planned as one. Returns the slots and the number of containers."""
    free: list[int] = []  # sorted distinct free space
    at: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}  # by free space: (content, containers)

    def put(space: int, content: tuple, n: int) -> None:
        if space not in at:
            at[space] = []
            insort(free, space)
        at[space].append((content, n))

    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        left = counts[length]
        while left:
            k = bisect_left(free, length)
            if k == len(free):
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * length, ((length, each),), full)
                if rest:
                    put(capacity - rest * length, ((length, rest),), 1)
                break
            space = free[k]
            content, n = at[space].pop()
            if not at[space]:
                del at[space]
                free.pop(k)
            each = min(space // length, left)  # as many as fit, as best fit would go on with the same container
            take = min(n, left // each)
            left -= take * each
            put(space - each * length, (*content, (length, each)), take)
            if n > take:
                put(space, content, n - take)
    slots, ranks, container = [], dict.fromkeys(counts, 0), 0
    for space in free:
        for content, n in at[space]:
            position = offset = 0
            for length, each in content:
                slots.append(Slots(length, ranks[length], n, each, container, position, offset))
                ranks[length] += n * each
                position += each
                offset += each * length
            container += n
    return slots, container


class _Plan:
    """Slots in arrays, for looking up many ranks at once."""

    def __init__(self, slots: list[Slots]):
        order = sorted(slots, key=lambda s: (s.length, s.rank))
        self.key = np.array([(s.length << 44) + s.rank for s in order], dtype=np.int64)
        self.rank, self.each, self.container, self.position, self.offset, self.length = (np.array([getattr(s, f) for s in order], dtype=np.int64) for f in ("rank", "each", "container", "position", "offset", "length"))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, (length.astype(np.int64) << 44) + rank, side="right") - 1
        n = rank - self.rank[k]
        nth = n % self.each[k]
        return self.container[k] + n // self.each[k], self.position[k] + nth, self.offset[k] + nth * self.length[k]


@lru_cache(maxsize=2)
def load_encoding(path: str, pattern: str):
    """A public byte-level BPE vocabulary given as ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _pieces(encoding, text: str, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(piece_no, first_token, tokens, start_byte, end_byte): one for a text that fits, else pieces of `capacity` tokens
    or a few less, so that no character is cut."""
    tokens = encoding.encode_ordinary(text)
    if len(tokens) <= capacity:
        return [(0, 0, len(tokens), 0, -1)] if tokens else []
    data = text.encode("utf-8", "replace")
    ends = np.cumsum([len(encoding.decode_single_token_bytes(t)) for t in tokens])
    out, first, start = [], 0, 0
    while first < len(tokens):
        stop = min(first + capacity, len(tokens))
        while first + 1 < stop < len(tokens) and int(ends[stop - 1]) < len(data) and 0x80 <= data[int(ends[stop - 1])] < 0xC0:
            stop -= 1
        out.append((len(out), first, stop - first, start, int(ends[stop - 1])))
        first, start = stop, int(ends[stop - 1])
    return out


def token_items(documents: DataFrame, capacity: int, vocabulary: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece_no, first_token, tokens, start_byte, end_byte (-1: the whole text) of every text with tokens."""
    schema = T.StructType([T.StructField(doc_id, documents.schema[doc_id].dataType), *(T.StructField(c, T.IntegerType()) for c in ("piece_no", "first_token", "tokens", "start_byte", "end_byte"))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(vocabulary, pattern)
        for batch in batches:
            rows = []
            for n, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    rows += [(n, *p) for p in _pieces(encoding, t, capacity)]
            if rows:
                at, *cols = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, pa.int32()) for c in cols)], [f.name for f in schema])

    return documents.select(doc_id, text).mapInArrow(scan, schema)


def pack_items(items: DataFrame, capacity: int, *, key: tuple[str, ...], size: str, group_rows: int = 200_000) -> DataFrame:
    """The items with container, position in it and offset (units before the item in its container), which replace
    columns of these names.

    Sizes must be 1 to capacity; the histogram the driver gets has at most `capacity` rows. Equal keys are kept, each
    with a slot of its own. Items of one size are ranked in hashed parts of about group_rows rows.
    """
    items = cut(items.drop("container", "position", "offset"))
    counts = {r[0]: r[1] for r in items.groupBy(size).count().toLocalIterator()}
    slots, _ = plan_containers(counts, capacity)
    spark = items.sparkSession
    plan = spark.sparkContext.broadcast(_Plan(slots))
    parts = F.create_map(*(x for k, n in sorted(counts.items()) if n > group_rows for x in (F.lit(k), F.lit(-(-n // group_rows))))) if any(n > group_rows for n in counts.values()) else None
    part = F.pmod(F.xxhash64(*key), F.coalesce(parts[F.col(size)], F.lit(1)).cast("long")) if parts is not None else F.lit(0).cast("long")
    placed = items.withColumn("__part__", part)
    before = (
        placed.groupBy(size, "__part__").count()
        .select(size, "__part__", (F.sum("count").over(Window.partitionBy(size).orderBy("__part__")) - F.col("count")).alias("__before__"))
    )
    ranked = placed.withColumn("__rank__", F.row_number().over(Window.partitionBy(size, "__part__").orderBy(*key)) - 1)
    if parts is not None:
        ranked = ranked.join(before, [size, "__part__"]).withColumn("__rank__", (F.col("__rank__") + F.col("__before__")).cast("long"))

    @F.pandas_udf("struct<container long, position int, offset int>")
    def slot(length, rank):
        import pandas as pd

        c, p, o = plan.value.find(length.to_numpy(), rank.to_numpy().astype(np.int64))
        return pd.DataFrame({"container": c, "position": p.astype(np.int32), "offset": o.astype(np.int32)})

    return ranked.withColumn("__slot__", slot(F.col(size), F.col("__rank__").cast("long"))).select(*items.columns, "__slot__.container", "__slot__.position", "__slot__.offset")


def pack_documents(documents: DataFrame, *, capacity: int = 2048, vocabulary: str | None = None, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece_no, first_token, tokens, start_byte, end_byte, container, position, offset of every text or piece.

    Texts of more than `capacity` tokens are cut into pieces; all others stay whole. Null and empty texts have no tokens
    and no row. Repeated rows are packed as often as they come. vocabulary is the path of a public one.
    """
    if vocabulary is None:
        vocabulary, own = public_vocabulary()
        pattern = pattern or own
    return pack_items(token_items(documents, capacity, vocabulary, pattern, doc_id=doc_id, text=text), capacity, key=(doc_id, "piece_no"), size="tokens")


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, the least number of containers any packing needs, and the share of space used."""
    total = packed.agg(F.count_distinct("container").cast("long").alias("containers"), F.sum("tokens").cast("long").alias("tokens"))
    return total.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).cast("long").alias("least"), F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("used"))
