"""Differences of two snapshots, and storage deltas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import drop_stored, stored

METRICS = ["cc", "nd", "fo", "ns"]


def deltas(parent: DataFrame | None, current: DataFrame) -> DataFrame:
    """Both (function_id, cc, nd, fo, ns, lrs, band, suppression_reason) -> one row for each function of either.

    status: new, deleted, modified or unchanged (metrics, score or band; place isn't compared). delta_*: after less before for modified rows,
    negated before for deleted ones. Without a parent everything is new.
    """
    c = F.col
    keep = [*METRICS, "lrs", "band", "suppression_reason"]
    after = current.select("function_id", *[c(x).alias(f"after_{x}") for x in keep], F.lit(True).alias("_in"))
    if parent is None:
        before = after.limit(0).select("function_id", *[c(f"after_{x}").alias(f"before_{x}") for x in keep], F.lit(True).alias("_was"))
    else:
        before = parent.select("function_id", *[c(x).alias(f"before_{x}") for x in keep], F.lit(True).alias("_was"))
    j = before.join(after, "function_id", "full")
    differ = F.abs(c("after_lrs") - c("before_lrs")) > 2.220446049250313e-16
    for x in [*METRICS, "band"]:
        differ = differ | (c(f"after_{x}") != c(f"before_{x}"))
    status = F.when(c("_was").isNull(), "new").when(c("_in").isNull(), "deleted").when(differ, "modified").otherwise("unchanged")
    j = j.withColumn("status", status)
    d = lambda x: F.when(c("status") == "modified", c(f"after_{x}") - c(f"before_{x}")).when(c("status") == "deleted", -c(f"before_{x}"))
    j = j.withColumns({f"delta_{x}": d(x) for x in [*METRICS, "lrs"]})
    moved = c("before_band") != c("after_band")
    j = j.withColumns({"band_from": F.when(moved, c("before_band")), "band_to": F.when(moved, c("after_band"))})
    reason = F.when(c("status") == "deleted", c("before_suppression_reason")).otherwise(c("after_suppression_reason"))
    return j.withColumn("suppression_reason", reason).drop("_in", "_was", "before_suppression_reason", "after_suppression_reason")


def diff_top(d: DataFrame, n: int) -> DataFrame:
    """The n greatest changes, unchanged rows left out."""
    c = F.col
    size = F.when(c("status") == "new", c("after_lrs")).when(c("status") == "deleted", c("before_lrs")).otherwise(F.abs("delta_lrs"))
    return d.filter("status <> 'unchanged'").withColumn("change", size).orderBy(F.desc("change"), "function_id").limit(n)


def rename_hints(parent: DataFrame, current: DataFrame, near_lines: int = 10) -> DataFrame:
    """(function_id, rename_hint): of deleted functions the new one that each probably became.

    Candidates: the same name in another file, or the same file within some lines. Deleted functions choose in the order of their ids, each
    the first new one left. Only functions that compete with each other have to be walked in order: those of one run of near lines in a file, and of
    runs that share a name or a function. Such parts are walked side by side, each from its functions; candidate pairs, of which a run of n has n * n
    / 4, aren't made. A task holds the new functions of one part.
    """
    c = F.col
    name = lambda: F.when(c("function_id").startswith(F.concat("file", F.lit("::"))), F.substring(c("function_id"), F.length("file") + 3, 1 << 20)).otherwise(c("function_id"))
    one = lambda df, other, old: df.join(other.select("function_id"), "function_id", "left_anti").filter("file is not null").select(F.lit(old).alias("old"), c("function_id").alias("id"), "file", c("line").cast("long").alias("line"), name().alias("name"))
    rows = one(parent, current, True).unionByName(one(current, parent, False))
    order = Window.partitionBy("file").orderBy("line", "id")
    begins = F.coalesce(c("line") - F.lag("line").over(order) > near_lines, F.lit(True))
    runs = rows.withColumn("_b", F.when(begins, c("line"))).withColumn("_b", F.last("_b", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = stored(runs.withColumn("part", F.concat(F.coalesce(c("_b").cast("string"), F.lit("")), F.lit(":"), "file")).drop("_b"), "renames")
    keys = rows.select("part", "old", F.explode(F.array(F.struct(F.lit(True).alias("by_name"), c("name").alias("key")), F.struct(F.lit(False).alias("by_name"), c("id").alias("key")))).alias("k")).select("part", "old", "k.*")
    wide = keys.groupBy("by_name", "key").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.min("old").alias("x"), F.max("old").alias("y")).filter("a < b and (not by_name or x < y)")
    links = stored(keys.join(wide.select("by_name", "key"), ["by_name", "key"]).select("part", F.struct("by_name", "key").alias("key")).distinct(), "links")
    if links.limit(1).count():
        rows = rows.join(joined_parts(links).withColumnRenamed("label", "_l"), "part", "left").withColumn("part", F.coalesce("_l", "part")).drop("_l")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, gone, best = None, None, -1
        for b in batches:
            out = []
            for p, old, key, file, line, label in zip(b["part"], b["old"], b["id"], b["file"], b["line"], b["name"]):
                if gone is not None and (p != part or key != gone):
                    if best >= 0:
                        taken[best] = True
                        out.append((gone, ids[best]))
                    gone, best = None, -1
                if p != part:
                    part, ids, taken, by_name, by_line, head = p, [], [], {}, {}, {}
                if not old:
                    if not ids or ids[-1] != key:
                        ids.append(key)
                        taken.append(False)
                    by_name.setdefault(label, []).append((len(ids) - 1, file))
                    if line == line:
                        by_line.setdefault((file, int(line)), []).append((len(ids) - 1, None))
                    continue
                gone = key
                near = [(file, m) for m in range(int(line) - near_lines, int(line) + near_lines + 1)] if line == line else []
                for where, lists in [(label, by_name), *((k, by_line) for k in near)]:
                    got = lists.get(where)
                    if not got:
                        continue
                    i = head.get(where, 0)
                    while i < len(got) and taken[got[i][0]]:
                        i += 1
                    head[where] = i
                    while i < len(got) and (taken[got[i][0]] or got[i][1] == file):
                        i += 1
                    if i < len(got) and (best < 0 or got[i][0] < best):
                        best = got[i][0]
            yield pd.DataFrame(out, columns=["function_id", "rename_hint"])
        if best >= 0:
            yield pd.DataFrame([(gone, ids[best])], columns=["function_id", "rename_hint"])

    both = rows.groupBy("part").agg(F.min("old").alias("x"), F.max("old").alias("y")).filter("x < y").select("part")
    return rows.join(both, "part", "left_semi").repartition("part").sortWithinPartitions("part", "old", "id").mapInPandas(walk, "function_id string, rename_hint string")


def joined_parts(links: DataFrame) -> DataFrame:
    """links (part, key) -> (part, label): the least part that shared keys lead to, in rounds; what a label itself was given is taken over at once."""
    now = stored(links.select("part", F.col("part").alias("label")).distinct(), "labels")
    while True:
        least = links.join(now, "part").groupBy("key").agg(F.min("label").alias("l"))
        near = links.join(least, "key").groupBy("part").agg(F.min("l").alias("l"))
        jump = now.select(F.col("part").alias("label"), F.col("label").alias("j"))
        then = stored(now.join(near, "part").join(jump, "label").select("part", F.least("l", "j").alias("label")), "labels")
        if not then.join(now, ["part", "label"], "left_anti").limit(1).count():
            return then
        drop_stored(now)
        now = then


def with_rename_hints(d: DataFrame, hints: DataFrame) -> DataFrame:
    return d.join(hints, "function_id", "left")


def storage_delta(base: DataFrame, target: DataFrame, key: str = "function_id") -> DataFrame:
    """The rows that turn base into target: target's columns and op (added, modified, removed)."""
    cols = [x for x in target.columns if x != key]
    b = base.select(key, F.struct(*cols).alias("_b"))
    t = target.select(key, F.struct(*cols).alias("_t"))
    j = b.join(t, key, "full")
    op = F.when(F.col("_b").isNull(), "added").when(F.col("_t").isNull(), "removed").when(~F.col("_b").eqNullSafe(F.col("_t")), "modified")
    j = j.withColumn("op", op).filter(F.col("op").isNotNull()).withColumn("_r", F.coalesce("_t", "_b"))
    return j.select(key, *[F.col(f"_r.{x}").alias(x) for x in cols], "op")


def apply_storage_delta(base: DataFrame, change: DataFrame, key: str = "function_id") -> DataFrame:
    kept = base.join(change.select(key), key, "left_anti")
    return kept.unionByName(change.filter("op <> 'removed'").select(*base.columns))


def upsert(base: DataFrame, rows: DataFrame, key: str = "function_id") -> DataFrame:
    """base with rows replacing those of the same key."""
    return base.join(rows.select(key), key, "left_anti").unionByName(rows.select(*base.columns))
