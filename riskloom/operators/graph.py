"""Graph measures of call and import graphs.

Edges are (src, dst) of one id type, distinct and without loops. Iterative measures have two forms with one result: DataFrame rounds whose state
is a table in the shared folder, and for graphs of at most KERNEL_EDGES edges (counted first) a numpy kernel in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import is_entry_point
from ..sources.shared import drop_stored, stored

KERNEL_EDGES = 1_000_000
DAMPING, ROUNDS, CLOSE = 0.85, 30, 1e-6


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def degrees(edges: DataFrame, all_nodes: DataFrame | None = None) -> DataFrame:
    """(id, fan_in, fan_out)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    if all_nodes is not None:
        ends = ends.unionByName(all_nodes.select("id", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def _in_one_task(edges: DataFrame, all_nodes: DataFrame, kernel, schema: str) -> DataFrame:
    """kernel(ids, src, dst) -> DataFrame of pandas, with src and dst as positions in the sorted ids."""
    kind = all_nodes.schema["id"].dataType.simpleString()
    both = edges.select("src", "dst").unionByName(all_nodes.select(F.col("id").alias("src"), F.lit(None).cast(kind).alias("dst")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        x = pd.concat(parts)
        e = x[x["dst"].notna()]
        ids = np.unique(np.concatenate([x["src"].to_numpy(), e["dst"].to_numpy().astype(x["src"].dtype)]))
        yield kernel(ids, np.searchsorted(ids, e["src"].to_numpy()), np.searchsorted(ids, e["dst"].to_numpy().astype(ids.dtype)))

    return both.repartition(1).mapInPandas(run, schema.replace("ID", kind))


def _small(edges: DataFrame, limit: int, all_nodes: DataFrame | None = None) -> bool:
    """Whether edges, and nodes where given, number at most ``limit``."""
    return all(x.limit(limit + 1).count() <= limit for x in (edges, all_nodes) if x is not None)


def pagerank(edges: DataFrame, all_nodes: DataFrame | None = None, damping: float = DAMPING, rounds: int = ROUNDS, close: float = CLOSE, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """(id, pagerank) by pulling; what flows into nodes without callees is lost. Ends when no rank moves by ``close``."""
    everyone = all_nodes if all_nodes is not None else nodes(edges)
    if _small(edges, kernel_edges, everyone):

        def kernel(ids: np.ndarray, src: np.ndarray, dst: np.ndarray) -> pd.DataFrame:
            n = len(ids)
            out, r = np.bincount(src, minlength=n), np.full(n, 1 / max(n, 1))
            for _ in range(rounds):
                new = (1 - damping) / n + damping * np.bincount(dst, weights=r[src] / out[src], minlength=n)
                moved, r = np.abs(new - r).max(), new
                if moved < close:
                    break
            return pd.DataFrame({"id": ids, "pagerank": r})

        return _in_one_task(edges, everyone, kernel, "id ID, pagerank double")
    n = everyone.count()
    degree = edges.groupBy("src").agg(F.count("*").alias("d"))
    spread = stored(edges.join(degree, "src"), "edges")
    now = stored(everyone.select("id", F.lit(1 / n).alias("r")), "ranks")
    for _ in range(rounds):
        got = spread.join(now, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("r") / F.col("d")).alias("s"))
        then = stored(now.join(got, F.col("id") == F.col("to"), "left").select("id", (F.lit((1 - damping) / n) + damping * F.coalesce("s", F.lit(0.0))).alias("r"), F.col("r").alias("was")), "ranks")
        moved = then.agg(F.max(F.abs(F.col("r") - F.col("was")))).first()[0]
        drop_stored(now)
        now = then
        if moved is None or moved < close:
            break
    return now.select("id", F.col("r").alias("pagerank"))


def dependency_depth(edges: DataFrame, all_nodes: DataFrame | None = None, entries: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """(id, depth): the fewest calls from an entry point; NULL where none leads. Entries (id) are those named like one, or without such, nodes that nothing calls."""
    everyone = stored(all_nodes if all_nodes is not None else nodes(edges), "nodes")
    if entries is None:
        entries = everyone.filter(is_entry_point(F.col("id").cast("string")))
        if not entries.limit(1).count():
            entries = everyone.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    seen = stored(everyone.join(entries.select("id").distinct(), "id", "left_semi").select("id", F.lit(0).cast("long").alias("depth")), "depth")
    if _small(edges, kernel_edges, everyone):
        # Entries come as edges from a node to itself, which no graph has.
        flagged = edges.select("src", "dst").unionByName(seen.select(F.col("id").alias("src"), F.col("id").alias("dst")))

        def kernel(ids: np.ndarray, src: np.ndarray, dst: np.ndarray) -> pd.DataFrame:
            depth, d = np.full(len(ids), -1), 0
            depth[src[src == dst]] = 0
            while (depth == d).any():
                to = dst[depth[src] == d]
                depth[to[depth[to] < 0]] = d + 1
                d += 1
            return pd.DataFrame({"id": ids, "depth": pd.Series(np.where(depth < 0, np.nan, depth)).astype("Int64")})

        return _in_one_task(flagged, everyone, kernel, "id ID, depth long")
    front, d = seen, 0
    while front.limit(1).count():
        d += 1
        found = edges.join(front, F.col("src") == F.col("id")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        front = stored(found.select("id", F.lit(d).cast("long").alias("depth")), "depth")
        seen = stored(seen.unionByName(front), "depth")
    return everyone.join(seen, "id", "left")


def _tarjan(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The strongly connected component of each node, as its least node."""
    order = np.argsort(src, kind="stable")
    to, at = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    index, low, on, comp, stack, count = [-1] * n, [0] * n, [False] * n, [0] * n, [], 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, at[root])]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        on[root] = True
        while work:
            v, i = work.pop()
            if i < at[v + 1]:
                work.append((v, i + 1))
                w = to[i]
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    on[w] = True
                    work.append((w, at[w]))
                elif on[w]:
                    low[v] = min(low[v], index[w])
                continue
            if low[v] == index[v]:
                cut = stack.index(v) if len(stack) < 64 else len(stack) - 1 - stack[::-1].index(v)
                part, stack = stack[cut:], stack[:cut]
                least = min(part)
                for w in part:
                    on[w], comp[w] = False, least
            if work:
                u = work[-1][0]
                low[u] = min(low[u], low[v])
    return np.array(comp, np.int64)


def strong_components(edges: DataFrame, all_nodes: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """(id, scc_id, scc_size); a component is named by its least id.

    In rounds: each node takes the least id that reaches it; the nodes that reach that id back, within those of one label, are a component. They go,
    and the rest repeat.
    """
    everyone = all_nodes if all_nodes is not None else nodes(edges)
    if _small(edges, kernel_edges, everyone):

        def kernel(ids: np.ndarray, src: np.ndarray, dst: np.ndarray) -> pd.DataFrame:
            comp = _tarjan(len(ids), src, dst)
            return pd.DataFrame({"id": ids, "scc_id": ids[comp], "scc_size": np.bincount(comp, minlength=len(ids))[comp]})

        return _in_one_task(edges, everyone, kernel, "id ID, scc_id ID, scc_size long")

    def spread(e: DataFrame, start: DataFrame, same: bool) -> DataFrame:
        """Least labels carried along edges until nothing changes."""
        now = stored(start, "labels")
        while True:
            step = e.join(now, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "label")
            then = stored(now.unionByName(step).groupBy("id").agg(F.min("label").alias("label")), "labels")
            if not then.join(now, ["id", "label"], "left_anti").limit(1).count():
                return then
            now = then

    left, live, done = stored(edges, "edges"), stored(everyone.select("id"), "nodes"), None
    while live.limit(1).count():
        label = spread(left, live.select("id", F.col("id").alias("label")), False)
        a, b = label.select(F.col("id").alias("src"), F.col("label").alias("la")), label.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
        inner = stored(left.join(a, "src").join(b, "dst").filter("la = lb").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "edges")
        found = spread(inner, label.filter("id = label"), True)
        done = stored(found if done is None else done.unionByName(found), "components")
        live = stored(live.join(found, "id", "left_anti"), "nodes")
        left = stored(left.join(live.select(F.col("id").alias("src")), "src", "left_semi").join(live.select(F.col("id").alias("dst")), "dst", "left_semi"), "edges")
    size = done.groupBy("label").agg(F.count("*").alias("scc_size"))
    return done.join(size, "label").select("id", F.col("label").alias("scc_id"), "scc_size")


def betweenness(edges: DataFrame, exact_up_to: int = 2000, pivots: int = 256, most_edges: int = 20_000_000, all_nodes: DataFrame | None = None) -> DataFrame:
    """(id, betweenness), directed, over (n - 1)(n - 2), where n counts all_nodes (id), those without edges too; these have 0.

    From all sources up to exact_up_to nodes, else from ``pivots`` evenly placed ones, scaled.

    Sources are spread over tasks; each task needs the whole adjacency, which is broadcast as two integer arrays behind a check of its size. A source
    costs what it reaches: arrays over all nodes are made once a task, and only what was reached is added up and cleared. Nodes of 0 come from one task.
    """
    spark = edges.sparkSession
    if not _small(edges, most_edges, all_nodes):
        raise ValueError(f"more than {most_edges} edges or nodes: betweenness needs the graph in each task's memory")
    table = edges.select("src", "dst").toPandas()
    kind = edges.schema["src"].dataType.simpleString()
    more = [all_nodes.select("id").toPandas()["id"].to_numpy()] if all_nodes is not None else []
    ids = np.unique(np.concatenate([table["src"].to_numpy(), table["dst"].to_numpy(), *more]))
    n = len(ids)
    src, dst = np.searchsorted(ids, table["src"].to_numpy()), np.searchsorted(ids, table["dst"].to_numpy())
    order = np.lexsort((dst, src))
    graph = spark.sparkContext.broadcast((dst[order].astype(np.int64), np.searchsorted(src[order], np.arange(n + 1)), ids))
    picked = np.arange(n) if n <= exact_up_to else np.array([i * n // pivots for i in range(pivots)])
    scale = (1.0 if n <= exact_up_to else n / pivots) / ((n - 1) * (n - 2)) if n > 2 else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to, at, names = graph.value
        total, dist, sigma, delta, whole = np.zeros(n), np.full(n, -1), np.zeros(n), np.zeros(n), False
        for b in batches:
            for s in b["s"]:
                whole |= s == picked[0]
                levels, steps = [np.array([s])], []
                dist[s], sigma[s] = 0, 1.0
                while len(levels[-1]):
                    f = levels[-1]
                    k = at[f + 1] - at[f]
                    if not k.any():
                        break
                    u = np.repeat(f, k)
                    w = to[np.repeat(at[f] - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())]
                    dist[w[dist[w] < 0]] = len(levels)
                    ok = dist[w] == len(levels)
                    np.add.at(sigma, w[ok], sigma[u[ok]])
                    steps.append((u[ok], w[ok]))
                    levels.append(np.unique(w[ok]))
                for u, w in reversed(steps):
                    np.add.at(delta, u, sigma[u] / sigma[w] * (1 + delta[w]))
                delta[s] = 0
                seen = np.concatenate(levels)
                total[seen] += delta[seen]
                dist[seen], sigma[seen], delta[seen] = -1, 0, 0
        out = np.arange(n) if whole else np.flatnonzero(total)
        yield pd.DataFrame({"id": names[out], "b": total[out]})

    sources = spark.createDataFrame(pd.DataFrame({"s": picked}), "s long").repartition(max(1, min(64, len(picked) // 32)))
    return sources.mapInPandas(run, f"id {kind}, b double").groupBy("id").agg((F.sum("b") * scale).alias("betweenness"))


def reachable(parents: DataFrame, tips: DataFrame) -> DataFrame:
    """(sha): commits that the tips (sha) reach through parents (sha, parent), the tips included; in frontier rounds."""
    seen = stored(tips.select("sha").distinct(), "reach")
    front = seen
    while front.limit(1).count():
        front = stored(parents.join(front, "sha").select(F.col("parent").alias("sha")).filter("sha is not null").distinct().join(seen, "sha", "left_anti"), "front")
        seen = stored(seen.unionByName(front), "reach")
    return seen


def graph_metrics(edges: DataFrame, all_nodes: DataFrame | None = None, skip_above: int | None = None, exact_up_to: int = 2000, pivots: int = 256) -> DataFrame | None:
    """(id, fan_in, fan_out, pagerank, betweenness, scc_id, scc_size, depth); None above ``skip_above`` nodes."""
    everyone = all_nodes if all_nodes is not None else nodes(edges)
    if skip_above is not None and everyone.limit(skip_above + 1).count() > skip_above:
        return None
    out = degrees(edges, everyone).join(pagerank(edges, everyone), "id").join(betweenness(edges, exact_up_to, pivots, all_nodes=everyone), "id")
    return out.join(strong_components(edges, everyone), "id").join(dependency_depth(edges, everyone), "id")
