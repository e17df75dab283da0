"""Call graph: resolution, neighbours, walks, communities, impact."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower

ANY_CASE = ("apex", "php")
ROUNDS = 50


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` without its lineage: written to the shared folder of spark.checkpoint.dir and read again."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_own: list[str] = []


def _local_folder() -> str:
    """A folder for sessions on one machine that name none."""
    if not _own:
        import atexit
        import shutil
        import tempfile

        _own.append(tempfile.mkdtemp(prefix="quillspan-graph-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def on_branch(symbols: DataFrame, branch_symbols: DataFrame, branch: str) -> DataFrame:
    return joined(symbols, branch_symbols.where(F.col("branch") == branch).select(F.col("symbol_id").alias("id")), "id", "left_semi")


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that sends neither side to the driver, however small it looks: rounds of walks would send it again and again."""
    return left.join(right.hint("merge"), on, how)


def name_key(name: Column, language: Column) -> Column:
    """Equal for names that the language takes as equal."""
    return F.when(language.isin(*ANY_CASE), ascii_lower(name)).otherwise(name)


# ---- neighbours
def callers(edges: DataFrame, symbols: DataFrame, branch_symbols: DataFrame, name: str, branch: str, call_type: str | None = None) -> DataFrame:
    """Edges from symbols of the branch to a name, with the caller's name and file. PHP and Apex callers disregard case."""
    sources = on_branch(symbols, branch_symbols, branch).select(F.col("id").alias("from_symbol_id"), F.col("name").alias("caller"), F.col("file_path").alias("caller_path"), "language")
    found = edges.join(sources, "from_symbol_id").where(name_key(F.col("target_name"), F.col("language")) == name_key(F.lit(name), F.col("language")))
    return found.where(F.col("call_type") == call_type) if call_type else found


def callees(edges: DataFrame, branch_symbols: DataFrame, symbol: int, branch: str, call_type: str | None = None) -> DataFrame:
    held = branch_symbols.where(F.col("branch") == branch).select(F.col("symbol_id").alias("from_symbol_id"))
    found = edges.where(F.col("from_symbol_id") == symbol).join(held, "from_symbol_id", "left_semi")
    return found.where(F.col("call_type") == call_type) if call_type else found


def resolved(edges: DataFrame, symbols: DataFrame, branch_symbols: DataFrame, branch: str) -> DataFrame:
    """(id, src, dst, call_type) of the branch's edges: the stored target if it is on the branch, else the only symbol of that name (any case), else null."""
    own = on_branch(symbols, branch_symbols, branch)
    unique = own.groupBy(F.lower("name").alias("target_key")).agg(F.count("*").alias("n"), F.min("id").alias("by_name")).where("n = 1").select("target_key", "by_name")
    held = own.select(F.col("id").alias("to_symbol_id"), F.col("id").alias("stored"))
    out = joined(joined(edges, own.select(F.col("id").alias("from_symbol_id")), "from_symbol_id", "left_semi"), held, "to_symbol_id", "left")
    out = joined(out.withColumn("target_key", F.lower("target_name")), unique, "target_key", "left")
    return out.select("id", F.col("from_symbol_id").alias("src"), F.coalesce("stored", "by_name").alias("dst"), "call_type")


def callers_of_symbol(edges: DataFrame, symbols: DataFrame, branch_symbols: DataFrame, symbol: int, branch: str) -> DataFrame:
    return resolved(edges, symbols, branch_symbols, branch).where(F.col("dst") == symbol)


def resolve_symbol(symbols: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """At most 5 candidates with an outcome: resolved if there is one, ambiguous if more."""
    hits = symbols.where(F.col("name") == name)
    if path:
        hits = hits.where((F.col("file_path") == path) | F.col("file_path").endswith("/" + path))
    n = hits.agg(F.count("*").alias("n"))
    return hits.crossJoin(n).select("id", "file_path", "start_line", F.when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("outcome")).orderBy("file_path", "start_line", "id").limit(5)


def centrality(edges: DataFrame, symbols: DataFrame, branch_symbols: DataFrame, branch: str) -> DataFrame:
    """(id, callers, callees, total): edges in, resolved; edges out, all of them."""
    links = resolved(edges, symbols, branch_symbols, branch)
    own = on_branch(symbols, branch_symbols, branch).select("id")
    into = links.where("dst is not null").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    out = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees"))
    n = own.join(into, "id", "left").join(out, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("callers", "callees")])
    return n.withColumn("total", F.col("callers") + F.col("callees"))


# ---- walks
def reach(links: DataFrame, roots: DataFrame, direction: str = "callees", depth: int = 10) -> DataFrame:
    """(id, depth) of all that can be reached from ``roots`` (id), themselves left out, at the least depth.

    One join a level, each written out; the links are worked out once. ``both``
    is the union of the two directed walks.
    """
    if direction == "both":
        links = cut(links.select("src", "dst"), "links")
        two = reach(links, roots, "callees", depth).union(reach(links, roots, "callers", depth))
        return two.groupBy("id").agg(F.min("depth").alias("depth"))
    step = cut(links.where("dst is not null").select(F.col("src" if direction == "callees" else "dst").alias("id"), F.col("dst" if direction == "callees" else "src").alias("next")).distinct(), "step")
    seen = cut(roots.select(F.col("id"), F.lit(0).alias("depth")).distinct(), "reach")
    front = seen
    for d in range(1, depth + 1):
        new = joined(joined(front, step, "id").select(F.col("next").alias("id")).distinct(), seen, "id", "left_anti").withColumn("depth", F.lit(d))
        front = cut(new, "front")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.where("depth > 0")


def shortest_path(links: DataFrame, start: int, goal: int, depth: int = 10) -> DataFrame:
    """(step, id) along a shortest path of at most ``depth`` calls, the least parent at every step; no rows without one."""
    spark = links.sparkSession
    step = cut(links.where("dst is not null").select(F.col("src").alias("id"), F.col("dst").alias("next")).distinct(), "step")
    seen = cut(spark.createDataFrame([(start, None, 0)], "id long, parent long, depth int"), "path")
    front, found = seen, start == goal
    for d in range(1, depth + 1):
        if found:
            break
        new = joined(joined(front, step, "id").groupBy("next").agg(F.min("id").alias("parent")).select(F.col("next").alias("id"), "parent"), seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        front = cut(new, "front")
        if front.isEmpty():
            break
        seen = seen.union(front)
        found = not front.where(F.col("id") == goal).isEmpty()
    path = []
    if found:
        at = goal
        while at is not None:  # at most depth + 1 point lookups
            row = seen.where(F.col("id") == at).first()
            path.append(at)
            at = row["parent"]
    return spark.createDataFrame([(i, x) for i, x in enumerate(reversed(path))], "step int, id long")


# ---- communities
def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that undirected links connect.

    Large and small stars in turn (Kiveris et al.): a round moves the links of
    each node to its least neighbour, first those to greater nodes, then those
    to smaller ones, until every component is one star around its least id.
    Rounds grow with the logarithm of the nodes, and nothing is joined.
    """
    least = Window.partitionBy("u")
    ways = cut(links.where("dst is not null and src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "ways")
    before = None
    while True:
        now = ways.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:
            break
        before = now
        both = ways.union(ways.select("v", "u")).withColumn("m", F.min(F.least("u", "v")).over(least))
        large = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", F.min("v").over(least)).select(F.explode(F.array(*[F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in ("u", "v")])).alias("w")).select("w.*")
        ways = cut(small.where("u != v").distinct(), "ways")
    return ways.toDF("id", "component").union(ways.select("v", "v").distinct())


def _propagate(part: pd.DataFrame) -> pd.DataFrame:
    near: dict[int, set[int]] = {}
    for a, b in zip(part["src"], part["dst"], strict=True):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    label = {x: x for x in near}
    order = sorted(near, key=lambda x: (-len(near[x]), x))
    for _ in range(ROUNDS):
        moved = False
        for x in order:
            votes: dict[int, int] = {}
            for y in near[x]:
                votes[label[y]] = votes.get(label[y], 0) + 1
            best = min(votes, key=lambda v: (-votes[v], v))
            moved |= best != label[x]
            label[x] = best
        if not moved:
            break
    return pd.DataFrame({"id": list(label), "label": list(label.values())}, dtype="int64")


def communities(links: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(id, label): label propagation in each connected component, by falling degree, ties to the smallest label.

    The order within a component is sequential by definition, so a component is
    one task; ``seeds`` (id) restricts the work to their components.
    """
    pairs = cut(links.where("dst is not null and src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "pairs")
    part = components(pairs)
    if seeds is not None:
        part = joined(part, joined(part, seeds, "id", "left_semi").select("component").distinct(), "component", "left_semi")
    return joined(pairs, part.withColumnRenamed("id", "src"), "src").groupBy("component").applyInPandas(_propagate, "id long, label long")


def couplings(links: DataFrame, labels: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, coupling, examples): distinct calls between two communities, the first five as ``from>to``."""
    pairs = links.where("dst is not null").select("src", "dst").distinct()
    l = labels.select("id", "label")
    crossing = pairs.join(l.toDF("src", "ls"), "src").join(l.toDF("dst", "ld"), "dst").where("ls != ld")
    out = crossing.groupBy(F.least("ls", "ld").alias("a"), F.greatest("ls", "ld").alias("b")).agg(F.count("*").alias("coupling"), F.slice(F.array_sort(F.collect_list(F.struct("src", "dst"))), 1, 5).alias("e"))
    return out.where(F.col("coupling") >= least).select("a", "b", "coupling", F.array_join(F.transform("e", lambda x: F.concat_ws(">", x["src"].cast("string"), x["dst"].cast("string"))), ",").alias("examples"))


def hubs(links: DataFrame, labels: DataFrame, least: int = 2) -> DataFrame:
    """(id, neighbours): symbols with that many distinct neighbours in other communities."""
    ways = links.where("dst is not null and src != dst").select("src", "dst")
    ways = ways.union(ways.select("dst", "src")).distinct()
    l = labels.select("id", "label")
    crossing = ways.join(l.toDF("src", "ls"), "src").join(l.toDF("dst", "ld"), "dst").where("ls != ld")
    return crossing.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("neighbours")).where(F.col("neighbours") >= least)


def community_summary(labels: DataFrame, least: int = 2) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("members"), F.min("id").alias("first")).where(F.col("members") >= least)


def module_edges(links: DataFrame, symbols: DataFrame, depth: int = 2) -> DataFrame:
    """(source, target, weight, calls, methods): calls between path prefixes of ``depth`` segments."""
    module = symbols.select("id", F.substring_index("file_path", "/", depth).alias("module"))
    both = links.where("dst is not null").join(module.toDF("src", "source"), "src").join(module.toDF("dst", "target"), "dst").where("source != target")
    return both.groupBy("source", "target").agg(F.count("*").alias("weight"), F.count_if(F.col("call_type") == "Call").alias("calls"), F.count_if(F.col("call_type") == "MethodCall").alias("methods"))


def subgraph(links: DataFrame, symbols: DataFrame, directory: str, most: int = 5000) -> DataFrame:
    """(id, degree): symbols below a directory that resolved edges connect there, the best connected first."""
    inside = symbols.where(F.col("file_path").startswith(directory.strip("/") + "/")).select("id")
    kept = links.where("dst is not null").join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi")
    degree = kept.select(F.col("src").alias("id")).union(kept.select("dst")).groupBy("id").agg(F.count("*").alias("degree"))
    return degree.orderBy(F.desc("degree"), "id").limit(most)


def impact(links: DataFrame, symbols: DataFrame, changed: DataFrame, labels: DataFrame, depth: int = 5) -> DataFrame:
    """One row: symbols in changed files (path), callers that they reach, hubs among both, and the risk."""
    direct = symbols.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    reached = reach(links, direct, "callers", depth)
    every = direct.union(reached.select("id")).distinct()
    touched = hubs(links, labels).join(every, "id", "left_semi").agg(F.count("*").alias("hubs"))
    out = direct.agg(F.count("*").alias("direct")).crossJoin(reached.agg(F.count("*").alias("reached"))).crossJoin(touched)
    total = F.col("direct") + F.col("reached")
    return out.withColumn("risk", F.when((total < 5) & (F.col("hubs") == 0), "LOW").when((total > 20) | (F.col("hubs") > 1), "HIGH").otherwise("MEDIUM"))
