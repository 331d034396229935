"""Context under a token budget: seeds, bundles, ranked context and task context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeglass.functions import validation
from lodeglass.functions.text import byte_slice, token_estimate
from lodeglass.operators.graph import CodeIndex, expand
from lodeglass.operators.ranking import symbol_order
from lodeglass.operators.search import ranked_symbols, symbol_json, unique_symbols
from lodeglass.schema import EngineConfig

#: What an item costs besides its source.
ITEM_TOKENS = 8
# Words that tell what a task is about, in order of precedence.
INTENTS = {"debug": r"\b(error|fail|bug|broken|crash|regression|debug)\b", "refactor": r"\b(refactor|rename|extract|migrate|restructure)\b", "audit": r"\b(audit|review|security|risk|compliance)\b"}
EXCLUSIONS = ("budget", "duplicate", "unsupported", "relation_depth")


def infer_intent(query: Column | str | None) -> Column:
    """What kind of task a query is."""
    text = F.lower(F.coalesce(F.lit(query) if isinstance(query, str) or query is None else query, F.lit("")))
    out = F.lit("explore")
    for name, words in reversed(INTENTS.items()):
        out = F.when(text.rlike(words), name).otherwise(out)
    return out


def _place(n: Column) -> Column:
    return F.array(F.lit("0"), F.lpad(n.cast("string"), 9, "0"))


def lexical_seeds(index: CodeIndex, query: str, *, n: int = 5, config: EngineConfig = EngineConfig()) -> DataFrame:
    """id, order, reason, score and rank of the n best symbols for a query."""
    order = symbol_order(config.collation)
    best = ranked_symbols(index.symbols, query, config=config).orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return best.select("id", _place(F.col("rank")).alias("order"), "reason", F.col("score").cast("bigint").alias("score"), F.col("rank").cast("int").alias("rank"))


def explicit_seeds(index: CodeIndex, ids: tuple[str, ...]) -> DataFrame:
    """The symbols of some ids in their order, scored from the number of ids down; unknown ids are left out."""
    asked = index.symbols.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, ids))).alias("pos", "id"))
    known = asked.join(unique_symbols(index.symbols).select("id"), "id", "left_semi")
    return known.select("id", _place(F.col("pos") + 1).alias("order"), F.lit("explicit_symbol_id").alias("reason"), F.greatest(F.lit(1), F.lit(len(ids)) - F.col("pos")).cast("bigint").alias("score"), (F.col("pos") + 1).cast("int").alias("rank"))


def merged_seeds(index: CodeIndex, query: str | None, ids: tuple[str, ...], config: EngineConfig = EngineConfig()) -> DataFrame:
    """Explicit seeds, then lexical ones that aren't among them."""
    if not ids:
        return lexical_seeds(index, query, config=config)
    own = explicit_seeds(index, ids)
    if query is None:
        return own
    more = lexical_seeds(index, query, config=config).join(own.select("id"), "id", "left_anti")
    return own.unionByName(more.withColumn("order", F.transform("order", lambda x, i: F.when(i == 1, F.concat(F.lit("1"), F.substring(x, 2, 8))).otherwise(x))))


def with_source(rows: DataFrame, index: CodeIndex) -> DataFrame:
    """The rows (id, ...) with their symbols, the exact bytes of their source, and its tokens; symbols whose file has no
    content are left out."""
    contents = index.contents.where("content is not null").select("file_id", "content")
    symbols = rows.join(unique_symbols(index.symbols), "id")
    return symbols.join(contents, "file_id").dropDuplicates(["id"]).withColumn("source", byte_slice(F.col("content"), F.col("start_byte"), F.col("end_byte"))).drop("content").withColumn("source_tokens", token_estimate("source"))


def prefix_budget(candidates: DataFrame, budget: int, *, order: str = "order", cost: str = "token_count", least: int = 1) -> DataFrame:
    """The candidates in order until the first that would exceed the budget. No item costs less than `least`, so no more
    than budget / least + 1 of them are ordered in one place."""
    first = candidates.orderBy(order).limit(budget // least + 1)
    running = first.withColumn("used", F.sum(cost).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return running.where(F.col("used") <= budget).drop("used")


def greedy_budget(candidates: DataFrame, budget: int, *, key: str = "id", order: str = "order", cost: str = "cost", chunk: int = 10_000) -> list[str]:
    """Keys of the candidates taken in order, each if it still fits. The driver looks at `chunk` rows of key, order and
    cost at a time, only at those that can still fit, and stops when nothing can."""
    rows = candidates.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(cost).cast("long").alias("c"))
    least = rows.agg(F.min("c")).first()[0]
    taken, left, after = [], budget, None
    while least is not None and left >= least:
        fits = rows.where(F.col("c") <= left)
        if after is not None:
            fits = fits.where(F.struct("o", "k") > F.struct(F.array(*map(F.lit, after[0])), F.lit(after[1])))
        part = fits.orderBy("o", "k").limit(chunk).collect()
        for r in part:
            if r["c"] <= left:
                taken.append(r["k"])
                left -= r["c"]
        if len(part) < chunk:
            break
        after = (list(part[-1]["o"]), part[-1]["k"])
    return taken


def bundle_candidates(index: CodeIndex, seeds: DataFrame, *, depth: int | None = 1, dependencies: bool = True, importers: bool = False, references: bool = False) -> DataFrame:
    """role, reason, symbol, source and token_count of the seeds and what they lead to, with their order."""
    reached = expand(index, seeds, depth=depth, dependencies=dependencies, importers=importers, references=references)
    rows = reached.select("id", "order", F.when(F.col("depth") == 0, "target").otherwise("dependency").alias("role"), F.get("reasons", 0).alias("reason"), "depth")
    return with_source(rows, index).withColumn("token_count", (F.col("source_tokens") + ITEM_TOKENS).cast("bigint"))


@dataclass(frozen=True)
class Bundle:
    """candidates: all that was considered; items: what the budget takes; summary: one row with the budget, the tokens of
    all candidates, those used, and whether something was left out."""

    candidates: DataFrame
    items: DataFrame
    summary: DataFrame


def _bundle(candidates: DataFrame, budget: int) -> Bundle:
    items = prefix_budget(candidates, budget, least=ITEM_TOKENS + 1)
    sums = candidates.agg(F.coalesce(F.sum("token_count"), F.lit(0)).alias("estimated_tokens")).join(F.broadcast(items.agg(F.coalesce(F.sum("token_count"), F.lit(0)).alias("used_tokens"), F.count("*").alias("item_count"))))  # one row each
    summary = sums.select(F.lit(budget).cast("bigint").alias("token_budget"), F.col("estimated_tokens").cast("bigint").alias("estimated_tokens"), F.col("used_tokens").cast("bigint").alias("used_tokens"), F.col("item_count").cast("bigint").alias("item_count"), (F.col("estimated_tokens") > budget).alias("truncated"))
    return Bundle(candidates, items, summary)


def context_bundle(index: CodeIndex, *, query: str | None = None, symbol_ids=(), token_budget: int | None = None, config: EngineConfig = EngineConfig(), **relations) -> Bundle:
    """The best three seeds, explicit ones if there are any, and what they lead to, until the budget is full."""
    query, ids = validation.seeds(query, symbol_ids)
    seeds = explicit_seeds(index, ids) if ids else lexical_seeds(index, query, config=config)
    return _bundle(bundle_candidates(index, seeds.where("rank <= 3"), **relations), token_budget or config.limits.token_budget)


def ranked_context(index: CodeIndex, query: str, *, token_budget: int | None = None, config: EngineConfig = EngineConfig(), **relations) -> tuple[DataFrame, Bundle]:
    """The five best candidates with rank, score, reason and whether the bundle took them; the bundle expands three."""
    validation.query_text(query)
    seeds = lexical_seeds(index, query, config=config)
    bundle = _bundle(bundle_candidates(index, seeds.where("rank <= 3"), **relations), token_budget or config.limits.token_budget)
    taken = bundle.items.where("role = 'target'").select("id", F.lit(True).alias("_taken"))
    candidates = seeds.join(taken, "id", "left").join(unique_symbols(index.symbols), "id").withColumn("selected", F.coalesce("_taken", F.lit(False))).drop("_taken", "order")
    return candidates, bundle


@dataclass(frozen=True)
class TaskContext:
    """items: what fits, with role, reason, symbol, source and provenance; summary: one row; exclusions: reason, count."""

    items: DataFrame
    summary: DataFrame
    exclusions: DataFrame


def task_context(index: CodeIndex, *, query: str | None = None, symbol_ids=(), intent: str | None = None, payload_token_budget: int | None = None, depth: int | None = 1, dependencies: bool = True, importers: bool = False, references: bool = False, config: EngineConfig = EngineConfig()) -> TaskContext:
    """Seeds and relations under a budget on the whole payload: items that don't fit are passed over, later ones that do
    are taken. An item costs a quarter of the characters of its JSON; the envelope a quarter of its own."""
    query, ids = validation.seeds(query, symbol_ids)
    budget = payload_token_budget or config.limits.token_budget
    if budget < config.limits.least_payload_budget:
        raise ValueError(f"the payload budget must be at least {config.limits.least_payload_budget}")
    intent = validation.intent(intent)
    depth = validation.relation_depth(depth)
    seeds = merged_seeds(index, query, ids, config)
    reached = expand(index, seeds, depth=depth, dependencies=dependencies, importers=importers, references=references)
    role = F.when(F.col("depth") > 0, "relation").when(F.array_contains("reasons", "explicit_symbol_id"), "anchor").otherwise("match")
    rows = with_source(reached.select("id", "order", "depth", role.alias("role"), F.get("reasons", 0).alias("reason"), F.size("reasons").alias("meetings")), index)
    priced = rows.withColumn("cost", (F.ceil((F.length(symbol_json()) + F.length(F.to_json(F.struct("role", "reason", "source")))) / 4)).cast("long"))
    envelope = -(-(180 + len(query or "")) // 4)
    taken = greedy_budget(priced, budget - envelope)
    spark = index.symbols.sparkSession
    chosen = spark.createDataFrame([(k,) for k in taken], "id string")
    items = priced.join(F.broadcast(chosen), "id", "left_semi")  # bounded by the budget
    totals = priced.agg(F.count("*").alias("n"), F.coalesce(F.sum("cost"), F.lit(0)).alias("all"), F.count_if((F.col("depth") == depth) & (F.col("depth") > 0)).alias("deep"), F.coalesce(F.sum(F.col("meetings") - 1), F.lit(0)).alias("twice"))
    got = items.agg(F.count("*").alias("m"), F.coalesce(F.sum("cost"), F.lit(0)).alias("used"), F.coalesce(F.sum("source_tokens"), F.lit(0)).alias("source"))
    met = reached.agg(F.count("*").alias("reached"))
    one = totals.join(F.broadcast(got)).join(F.broadcast(met))  # one row each
    counts = {"budget": F.col("n") - F.col("m"), "duplicate": F.col("twice"), "unsupported": F.col("reached") - F.col("n"), "relation_depth": F.col("deep")}
    exclusions = one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("reason"), counts[k].cast("bigint").alias("count")) for k in EXCLUSIONS))).alias("x")).select("x.*").where("count > 0")
    summary = one.select(
        infer_intent(query).alias("intent") if intent is None else F.lit(intent).alias("intent"), F.lit(budget).cast("bigint").alias("payload_token_budget"), (F.col("used") + envelope).cast("bigint").alias("used_payload_tokens"),
        (F.col("all") + envelope).cast("bigint").alias("estimated_payload_tokens"), F.col("source").cast("bigint").alias("source_tokens"), ((F.col("n") > F.col("m")) | (F.col("deep") > 0)).alias("truncated"), F.lit(depth).alias("relation_depth"),
    )
    return TaskContext(items, summary, exclusions)
