"""Static references, cycles and a prerequisite-first order.

References resolve by equality joins: the dotted suffixes of every module are rows, so that a suffix test is one. Only
cycles and the order itself need a program; they run once a snapshot, side by side for all snapshots.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Mapping
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import labels
from spanloom.functions import text as X


def components(nodes: Iterable[str], needs: Mapping[str, Iterable[str]]) -> list[tuple[str, ...]]:
    """Strongly connected components, by the path-based algorithm with two stacks; what is reachable counts too."""
    number: dict[str, int] = {}
    done: set[str] = set()
    open_, roots = [], []
    out: list[tuple[str, ...]] = []
    for first in sorted(set(nodes)):
        if first in number:
            continue
        work: list[tuple[str, list[str]]] = []

        def visit(node: str) -> None:
            number[node] = len(number)
            open_.append(node)
            roots.append(node)
            work.append((node, sorted(needs.get(node, ()), reverse=True)))

        visit(first)
        while work:
            node, todo = work[-1]
            if todo:
                target = todo.pop()
                if target not in number:
                    visit(target)
                elif target not in done:
                    while number[roots[-1]] > number[target]:
                        roots.pop()
                continue
            work.pop()
            if roots[-1] == node:
                roots.pop()
                members = []
                while not members or members[-1] != node:
                    members.append(open_.pop())
                done.update(members)
                out.append(tuple(sorted(members)))
    return out


def order(nodes: Iterable[str], needs: Mapping[str, Iterable[str]], key: Callable[[str], Hashable]) -> tuple[list[str], list[tuple[str, ...]]]:
    """(nodes with prerequisites first, cycles). Among what is free the component with the least member key comes next."""
    parts = components(nodes, needs)
    part_of = {n: i for i, p in enumerate(parts) for n in p}
    keys = {n: (key(n), n) for n in part_of}
    least = [min(keys[n] for n in p) for p in parts]
    before = [{part_of[t] for n in p for t in needs.get(n, ())} - {i} for i, p in enumerate(parts)]
    after: dict[int, list[int]] = {}
    for i, b in enumerate(before):
        for t in b:
            after.setdefault(t, []).append(i)
    waiting = [len(b) for b in before]
    free = [(least[i], i) for i, n in enumerate(waiting) if not n]
    heapify(free)
    out: list[str] = []
    while free:
        _, i = heappop(free)
        out += sorted(parts[i], key=keys.__getitem__)
        for t in after.get(i, ()):
            waiting[t] -= 1
            if not waiting[t]:
                heappush(free, (least[t], t))
    return out, sorted(p for p in parts if len(p) > 1)


def order_nodes(nodes: DataFrame, edges: DataFrame, scope: str = "snapshot_id") -> DataFrame:
    """Order every scope's graph. nodes: scope, node, key (array of strings, compared in turn); edges: scope, node, needs.

    Gives scope, node, number (from 1), component (its least member), in_cycle. Nodes that only edges name are ordered too,
    with an empty key.
    """
    lists = edges.where(F.col("node").isNotNull() & F.col("needs").isNotNull()).groupBy(scope, "node").agg(F.collect_set("needs").alias("needs"))
    rows = nodes.select(scope, "node", "key").join(lists, [scope, "node"], "full_outer")

    def each(graphs: pd.Series) -> pd.Series:
        out = []
        for g in graphs:
            keys = {r["node"]: tuple(r["key"]) if r["key"] is not None else () for r in g}
            needs = {r["node"]: list(r["needs"]) for r in g if r["needs"] is not None}
            numbers, cycles = order(keys, needs, lambda n: keys.get(n, ()))
            root = {n: c[0] for c in cycles for n in c}
            out.append([{"node": n, "number": i, "component": root.get(n, n), "in_cycle": n in root} for i, n in enumerate(numbers, 1)])
        return pd.Series(out)

    # One row a scope: a whole batch of graphs goes to Python at once.
    placed = F.pandas_udf(each, "array<struct<node:string,number:int,component:string,in_cycle:boolean>>")
    graphs = rows.groupBy(scope).agg(F.collect_list(F.struct("node", "key", "needs")).alias("g"))
    return graphs.select(scope, F.explode(placed("g")).alias("n")).select(scope, "n.*")


def module_suffixes(symbols: DataFrame) -> DataFrame:
    """Symbols with every dotted suffix of their module: snapshot_id, suffix, name, target."""
    parts = F.split(X.module_name(F.col("path")), r"\.")
    all_ = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return symbols.select("snapshot_id", F.explode(all_).alias("suffix"), "name", F.col("symbol_id").alias("target"))


def resolve(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Candidates of every reference: its columns and targets (array of symbol ids).

    A name bound within the declaration has none. A bare name is first a symbol of its own path; else its root must be
    exactly one top import of that path, relative levels being trimmed from the path's package, and the name in the
    imported module is what is meant.
    """
    root = F.element_at(F.split("name", r"\."), 1)
    refs = refs.withColumns({"root": root, "tail": F.expr("substring(name, length(split(name, '[.]')[0]) + 2)")}).where(~F.array_contains("local_bindings", F.col("root")))
    own = symbols.groupBy("snapshot_id", "path", F.col("name").alias("root")).agg(F.collect_list("symbol_id").alias("own"))
    alias = imports.where("top_level").groupBy("snapshot_id", "path", F.col("local").alias("root")).agg(F.count("*").alias("n"), F.first(F.struct("module", "name", "level", "aliased")).alias("alias")).where("n = 1").drop("n")
    known = refs.join(own, ["snapshot_id", "path", "root"], "left").join(alias, ["snapshot_id", "path", "root"], "left")
    local = (F.col("tail") == "") & (F.size(F.coalesce("own", F.array().cast("array<string>"))) > 0)
    package = F.split(X.module_name(F.col("path")), r"\.")
    kept = F.slice(package, F.lit(1), F.greatest(F.lit(0), F.size(package) - F.col("alias.level")))
    relative = F.array_join(F.when(F.col("alias.module") != "", F.array_append(kept, F.col("alias.module"))).otherwise(kept), ".")
    module = F.when(F.col("alias.level") > 0, relative).otherwise(F.col("alias.module"))
    last = F.element_at(F.split("tail", r"\."), -1)
    upto = F.regexp_replace("tail", r"\.?[^.]+$", "")
    from_name = F.col("alias.name").isNotNull() & (F.col("tail") == "")
    whole = F.col("alias.name").isNull() & F.col("alias").isNotNull() & (F.col("tail") != "")
    aliased = whole & F.coalesce(F.col("alias.aliased"), F.lit(False))
    wanted = known.withColumns({
        "is_local": local,
        "want_name": F.when(local, None).when(from_name, F.col("alias.name")).when(whole, last),
        "want_module": F.when(from_name, module).when(aliased, F.when(upto != "", F.concat_ws(".", module, upto)).otherwise(module)).when(whole, F.regexp_replace("name", r"\.[^.]+$", "")),
    })
    wanted = wanted.withColumn("want_name", F.when((F.col("want_module") != "") & (F.col("want_name") != "*"), F.col("want_name")))
    keys = ["snapshot_id", "want_module", "want_name"]
    targets = module_suffixes(symbols).select("snapshot_id", F.col("suffix").alias("want_module"), F.col("name").alias("want_name"), "target").groupBy(*keys).agg(F.collect_set("target").alias("there"))
    found = wanted.join(targets, keys, "left")
    none = F.array().cast("array<string>")
    return found.withColumn("targets", F.when(F.col("is_local"), F.col("own")).otherwise(F.coalesce("there", none))).select(*[c for c in refs.columns if c not in ("root", "tail")], "targets")


def symbol_edges(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved) of head symbols: references with exactly one candidate, and those with several.

    Of equal (source, target, type) the first by traversal stands; a symbol's references to itself are none.
    """
    resolved = resolve(refs, symbols, imports)
    kind = F.concat(F.when(F.col("is_test"), "test_").otherwise(""), F.when(F.col("is_call"), "calls").otherwise("references"))
    sure = resolved.where(F.size("targets") == 1).select("snapshot_id", F.col("symbol_id").alias("source"), F.element_at("targets", 1).alias("target"), kind.alias("type"), "path", "line", "idx", "ord", "seq").where("source <> target")
    first = Window.partitionBy("snapshot_id", "source", "target", "type").orderBy("idx", "ord", "seq")
    edges = sure.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    unresolved = resolved.where(F.size("targets") > 1).select("snapshot_id", F.col("symbol_id").alias("source"), F.col("name").alias("reference"), "line", F.lit(labels.AMBIGUOUS).alias("reason"))
    return edges, unresolved
