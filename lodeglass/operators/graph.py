"""File dependencies: resolution of imports, neighbours of symbols, and bounded breadth-first expansion."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.functions import validation
from lodeglass.operators.search import unique_symbols
from lodeglass.session import cut


@dataclass(frozen=True)
class CodeIndex:
    """The tables of an index that retrieval reads."""

    files: DataFrame
    contents: DataFrame
    symbols: DataFrame
    imports: DataFrame
    dependencies: DataFrame


def _normal(path: Column) -> Column:
    """A path without . and .. segments; a path that leads out of the root keeps its leading ..; absolute ones stay so."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    step = lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))
    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), folded)).otherwise(folded)


# What is appended to an import without its extension, in order of preference.
RESOLUTION = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def import_candidates(importer: Column, source: Column) -> Column:
    """The paths a relative or absolute import may mean, best first; none for packages."""
    s = F.trim(source)
    folder = F.when(F.instr(importer, "/") == 0, F.lit("")).otherwise(F.regexp_replace(importer, r"[^/]*$", ""))
    base = _normal(F.when(s.startswith("/"), s).otherwise(F.concat(folder, s)))
    bare = F.regexp_replace(base, r"\.[^./\\]+$", "")
    found = F.array_distinct(F.concat(F.array(base), F.transform(F.array(*map(F.lit, RESOLUTION)), lambda x: F.concat(bare, x))))
    return F.when(s.startswith(".") | s.startswith("/"), found).otherwise(F.array().cast("array<string>"))


def resolve_dependencies(files: DataFrame, imports: DataFrame) -> DataFrame:
    """importer_file_id, importer_path, target_path and source of every import that leads to a known file."""
    known = files.where("path is not null").select("path").distinct()
    paths = files.where("file_id is not null and path is not null").select(F.col("file_id"), F.col("path").alias("importer_path")).distinct()
    wanted = imports.select("file_id", "source").distinct().join(paths, "file_id")
    tried = wanted.select("file_id", "importer_path", "source", F.posexplode(import_candidates(F.col("importer_path"), F.col("source"))).alias("pos", "path"))
    hit = tried.join(known, "path").groupBy("file_id", "importer_path", "source").agg(F.min_by("path", "pos").alias("target_path"))
    return hit.select(F.col("file_id").alias("importer_file_id"), "importer_path", "target_path", "source")


def copy_dependencies(dependencies: DataFrame, checkout_id: str) -> DataFrame:
    """The edges of one checkout."""
    return dependencies.select(F.lit(checkout_id).alias("checkout_id"), "importer_path", "target_path", "source").distinct()


def direct_importers(dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """path of the files that import a changed one (column path) and haven't changed themselves."""
    hit = dependencies.join(changed.select(F.col("path").alias("target_path")).distinct(), "target_path", "left_semi")
    return hit.select(F.col("importer_path").alias("path")).distinct().join(changed.select("path"), "path", "left_anti")


def _standing() -> Column:
    return F.struct((~F.col("exported")).alias("a"), (F.col("kind") != "class").alias("b"), (F.col("kind") != "function").alias("c"), F.col("start_line").alias("d"), F.col("id").alias("id"))


def representative_symbols(symbols: DataFrame) -> DataFrame:
    """file_path and id of the symbol that stands for each file: exported ones first, then classes, then functions, then
    the first line."""
    s = symbols.select("file_path", "id", F.coalesce("exported", F.lit(False)).alias("exported"), "kind", "start_line")
    return s.groupBy("file_path").agg(F.min(_standing())["id"].alias("id"))


def imports_by_edge(index: CodeIndex) -> DataFrame:
    """importer_path, target_path, source, specifiers of every edge and import statement."""
    imports = index.imports.select(F.col("file_id").alias("importer_file_id"), "source", "specifiers")
    return index.dependencies.join(imports, ["importer_file_id", "source"]).select("importer_path", "target_path", "source", "specifiers").distinct()


def dependency_picks(index: CodeIndex, edges: DataFrame | None = None) -> DataFrame:
    """importer_path, id, reason and place (order among the importer's picks) of the symbols that imports mean: for each
    specifier the first symbol of its name in the target, or, if no specifier of a statement finds one, the symbol that
    stands for the target."""
    edges = imports_by_edge(index) if edges is None else edges
    symbols = index.symbols.where("id is not null").select("id", "file_path", "name", "qualified_name", "kind", "start_line", "exported")  # repeated rows don't change a minimum
    key = ["importer_path", "target_path", "source", "statement"]
    asked = edges.withColumn("statement", F.xxhash64("specifiers")).select(*key, F.posexplode_outer("specifiers").alias("pos", "s")).select(*key, "pos", F.col("s.importedName").alias("wanted"))
    order = F.struct((~F.coalesce(F.col("exported"), F.lit(False))).alias("a"), F.col("start_line").alias("b"), F.col("id").alias("id"))
    names = F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("wanted")
    by_name = symbols.select(F.col("file_path").alias("target_path"), names, order.alias("o")).where("wanted is not null").groupBy("target_path", "wanted").agg(F.min("o")["id"].alias("id"))
    found = F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id"))).alias("found")  # of one statement
    statements = asked.join(by_name, ["target_path", "wanted"], "left").groupBy(*key).agg(found)
    stand_in = representative_symbols(symbols).select(F.col("file_path").alias("target_path"), F.array(F.struct(F.lit(0).alias("pos"), "id")).alias("stand_in"))
    meant = F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(F.col("stand_in"))).alias("m")
    reason = F.when(F.col("source").startswith("."), "imports_matched_file").otherwise("reexport_match")
    every = statements.join(stand_in, "target_path", "left").select("importer_path", "target_path", "source", meant).select("importer_path", "m.id", F.struct("target_path", "source", "m.pos").alias("place"), reason.alias("reason"))
    return every.groupBy("importer_path", "id").agg(F.min(F.struct("place", "reason")).alias("m")).select("importer_path", "id", "m.reason", "m.place")


def importer_picks(index: CodeIndex) -> DataFrame:
    """target_path, id, reason and place of the symbols that stand for the files importing a target."""
    edges = index.dependencies.select("importer_path", "target_path").distinct()
    stand = representative_symbols(index.symbols.where("id is not null")).withColumnRenamed("file_path", "importer_path")
    return edges.join(stand, "importer_path").select("target_path", "id", F.lit("imported_by_match").alias("reason"), F.col("importer_path").alias("place"))


def reference_picks(index: CodeIndex, edges: DataFrame | None = None) -> DataFrame:
    """target_path, name, id, reason and place of the symbols that stand for the files whose imports from a target name
    something."""
    edges = imports_by_edge(index) if edges is None else edges
    named = edges.select("importer_path", "target_path", F.explode("specifiers").alias("s")).select("importer_path", "target_path", F.col("s.importedName").alias("name")).distinct()
    stand = representative_symbols(index.symbols.where("id is not null")).withColumnRenamed("file_path", "importer_path")
    return named.join(stand, "importer_path").select("target_path", "name", "id", F.lit("references_match").alias("reason"), F.col("importer_path").alias("place"))


def neighbours(index: CodeIndex, frontier: DataFrame, *, dependencies: bool = True, references: bool = False, importers: bool = False) -> DataFrame:
    """parent, id, reason and order of all neighbours of the symbols of a frontier (id, file_path, name, order): what they
    depend on, then what refers to them, then what imports their file. Only edges that touch the frontier are read on.
    """
    here = frontier.select(F.col("id").alias("parent"), F.col("order").alias("parent_order"), "file_path", "name")
    paths = here.select("file_path").distinct()
    after = lambda rank, *place: F.concat(F.col("parent_order"), F.array(F.lit(str(rank)), *(F.coalesce(p.cast("string"), F.lit("")) for p in place)))
    parts = []
    if dependencies:
        out = cut(index.dependencies.join(paths.withColumnRenamed("file_path", "importer_path"), "importer_path", "left_semi"))
        targets = out.select(F.col("target_path").alias("file_path")).distinct()
        near = CodeIndex(index.files, index.contents, index.symbols.join(targets, "file_path", "left_semi"), index.imports.join(out.select(F.col("importer_file_id").alias("file_id")).distinct(), "file_id", "left_semi"), out)
        picks = dependency_picks(near)
        hop = here.join(picks.withColumnRenamed("importer_path", "file_path"), "file_path")
        parts.append(hop.select("parent", "id", "reason", after(0, F.col("place.target_path"), F.col("place.source"), F.lpad(F.col("place.pos").cast("string"), 6, "0")).alias("order")))
    if references or importers:
        inn = index.dependencies.join(paths.withColumnRenamed("file_path", "target_path"), "target_path", "left_semi")
        narrow = CodeIndex(index.files, index.contents, index.symbols, index.imports, inn)
        if references:
            hop = here.join(reference_picks(narrow).withColumnRenamed("target_path", "file_path"), ["file_path", "name"])
            parts.append(hop.select("parent", "id", "reason", after(1, F.col("place")).alias("order")))
        if importers:
            hop = here.join(importer_picks(narrow).withColumnRenamed("target_path", "file_path"), "file_path")
            parts.append(hop.select("parent", "id", "reason", after(2, F.col("place")).alias("order")))
    if not parts:
        return frontier.select(F.col("id").alias("parent"), "id", F.lit("").alias("reason"), "order").limit(0)
    return reduce(lambda a, b: a.unionByName(b), parts)


def expand(index: CodeIndex, seeds: DataFrame, *, depth: int | None = 1, dependencies: bool = True, references: bool = False, importers: bool = False) -> DataFrame:
    """id, depth, reasons (all under which a symbol was met) and order (of its first meeting) of the seeds (id, order,
    reason) and of everything within some hops, at most three.

    Order is an array that sorts as a walk would meet the symbols: hop by hop, in the order of the parents, dependencies
    before references before importers. Each hop's new symbols are stored in the shared folder.
    """
    depth = validation.relation_depth(depth)
    symbols = unique_symbols(index.symbols).select("id", "file_path", "name")
    first = seeds.groupBy("id").agg(F.min(F.struct("order", "reason")).alias("m")).select("id", F.lit(0).alias("depth"), F.col("m.order").alias("order"), F.array("m.reason").alias("reasons"))
    known = cut(first.join(symbols.select("id"), "id", "left_semi"))
    frontier = known
    met = []
    for hop in range(1, depth + 1):
        near = cut(neighbours(index, frontier.join(symbols, "id"), dependencies=dependencies, references=references, importers=importers))
        met.append(near.select("id", "reason", F.lit(hop).alias("hop")))
        new = near.join(known.select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("order", "reason")).alias("m")).select("id", F.lit(hop).alias("depth"), F.concat(F.array(F.lit(str(hop))), "m.order").alias("order"), F.array("m.reason").alias("reasons"))
        new = cut(new)
        known = known.unionByName(new)
        frontier = new
        if hop < depth and new.isEmpty():
            break
    again = reduce(lambda a, b: a.unionByName(b), met).groupBy("id").agg(F.array_sort(F.collect_set("reason")).alias("more"))
    return known.join(again, "id", "left").select("id", "depth", F.array_distinct(F.concat("reasons", F.coalesce("more", F.array().cast("array<string>")))).alias("reasons"), "order")


def discover(index: CodeIndex, seeds: DataFrame, **options) -> DataFrame:
    """The symbols within some hops of the seeds with depth and reasons, as a search shows them: by depth, exported ones
    first, then path and line. Unless asked for, no relation is followed."""
    options = {"dependencies": False, "references": False, "importers": False} | options
    return expand(index, seeds, **options).join(unique_symbols(index.symbols), "id").drop("order")


def compact_folders(folders: DataFrame, column: str = "path") -> DataFrame:
    """The folders without those that lie in another one of them."""
    own = folders.select(column).distinct()
    parts = F.split(column, "/")
    above = own.select(F.col(column).alias("below"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(n < F.size(parts), F.array_join(F.slice(parts, F.lit(1), n), "/")))).alias(column)).where(F.col(column).isNotNull())
    inside = above.join(own, column, "left_semi").select(F.col("below").alias(column)).distinct()
    return own.join(inside, column, "left_anti")
