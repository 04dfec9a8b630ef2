"""Joins beyond equality: priority picks, greatest lower bound, longest prefix, suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import ancestors


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, payload: list[str]) -> DataFrame:
    """left with the payload of the right row of the same keys with the greatest right_at <= left_at; NULL where there is none.

    A union and one ordered window instead of a range join: each side is shuffled once by the keys. Of right rows at the same place the
    greatest payload counts.
    """
    pay = F.struct(F.col(right_at), *[F.col(c) for c in payload])
    r = right.groupBy(*keys, F.col(right_at).alias("_at")).agg(F.max(pay).alias("_pay")).select(*keys, "_at", F.lit(0).alias("_side"), "_pay", F.lit(None).alias("_row"))
    row = F.struct(*[F.col(c) for c in left.columns])
    a = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), row.alias("_row"))
    both = r.withColumn("_row", F.lit(None).cast(a.schema["_row"].dataType)).unionByName(a.withColumn("_pay", F.lit(None).cast(r.schema["_pay"].dataType)))
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_hit", F.last("_pay", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select("_row.*", *[F.col(f"_hit.{c}").alias(c) for c in [right_at, *payload]])


def nearest_function(hunks: DataFrame, spans: DataFrame) -> DataFrame:
    """hunks (file, old_start) and function starts (file, function_id, start_line) -> hunks with the nearest function at or above."""
    return asof_backward(hunks, spans, ["file"], "old_start", "start_line", ["function_id"])


def interval_touches(hunks: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """Touches of each function by changed lines: hunks (sha, file, ts, start, length) that overlap spans (file, function_id, start_line, end_line).

    Only distinct places meet, not commits and functions: hunks become weighted pieces (file, start, stop), equal pieces are added up, and equal spans
    are looked up once. Of a commit's hunks in a file, in order and without those inside others, a span overlaps a run of neighbours; each hunk weighs
    1 and each two neighbours -1 at the place (next start, own stop), which a span meets if it overlaps both, so the weights add up to one a commit.
    Both sides are cut into buckets of ``width`` lines, so the overlap is an equality join with a filter; a pair counts in the first bucket that both
    share. Functions of several spans, whose commits can't be added up, are joined with the hunks themselves.
    """
    c, span = F.col, ["file", "start_line", "end_line"]
    cut = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))

    def meet(h: DataFrame, s: DataFrame) -> DataFrame:
        low = F.least("start", "stop")
        on = h.withColumn("bucket", cut(low, c("stop"))).join(s.withColumn("bucket", cut(c("start_line"), c("end_line"))), ["file", "bucket"]).filter("start <= end_line and start_line <= stop")
        return on.filter(c("bucket") == F.greatest(F.floor(low / width), F.floor(c("start_line") / width)))

    h = hunks.withColumn("stop", c("start") + F.greatest(c("length"), F.lit(1)) - 1).filter("file is not null and stop is not null")
    each = spans.filter("file is not null and start_line is not null and end_line is not null").groupBy("function_id").agg(F.collect_set(F.struct(*span)).alias("_at"))
    reach = F.max("stop").over(Window.partitionBy("file", "sha").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1))
    piece = lambda stop, weight, ts: F.struct("start", stop.alias("stop"), weight.alias("w"), ts.alias("ts"))
    r = h.select("file", "sha", "start", "stop", "ts").withColumn("_reach", reach)
    outer = c("sha").isNotNull() & (c("_reach").isNull() | (c("stop") > c("_reach")))
    own = piece(c("stop"), outer.cast("long"), c("ts"))
    both = F.array(own, piece(c("_reach"), F.lit(-1).cast("long"), F.lit(None).cast(h.schema["ts"].dataType)))
    pieces = r.select("file", F.inline(F.when(outer & c("_reach").isNotNull(), both).otherwise(F.array(own)))).groupBy("file", "start", "stop").agg(F.sum("w").alias("w"), F.max("ts").alias("ts"))
    one = each.filter(F.size("_at") == 1).select("function_id", c("_at")[0].alias("_s")).select("function_id", "_s.*")
    seen = meet(pieces, one.select(*span).distinct()).groupBy(*span).agg(F.sum("w").alias("touches"), F.max("ts").alias("last_ts"))
    out = one.join(seen, span).select("function_id", "touches", "last_ts")
    many = each.filter(F.size("_at") > 1)
    if many.limit(1).count():
        rest = meet(h, many.select("function_id", F.inline("_at"))).groupBy("function_id").agg(F.countDistinct("sha").alias("touches"), F.max("ts").alias("last_ts"))
        out = out.unionByName(rest)
    return out


def priority_pick(candidates: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first candidate of each group."""
    return candidates.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter("_r = 1").drop("_r")


def resolve_callees(calls: DataFrame, functions: DataFrame, imports: DataFrame | None = None, skip_self_candidate: bool = True) -> DataFrame:
    """Call edges (src, dst) from calls (caller, caller_file, name) and functions (function_id, file, name, ord).

    A name goes to a function of the same file, else of an imported file (src_file, dst_file), else to the first in order. With
    skip_self_candidate that last resort passes over the caller; without, a caller that comes first gives no edge. Edges are distinct, none to self.
    """
    # Each lookup is reduced to one row a key before the calls meet it, so a common name costs no more than a rare one.
    calls = calls.select("caller", "caller_file", "name").distinct()
    place = F.struct("ord", F.col("function_id").alias("dst"))
    defs = functions.groupBy("file", "name").agg(F.min(place).alias("d"))
    own = defs.select(F.col("file").alias("caller_file"), "name", F.col("d.dst").alias("own"))
    c = calls.join(own, ["caller_file", "name"], "left")
    if imports is not None:
        known = imports.select(F.col("src_file").alias("caller_file"), F.col("dst_file").alias("file")).distinct()
        # Only the (file, name) pairs that are called go through the imports.
        asked = calls.join(own, ["caller_file", "name"], "left_anti").select("caller_file", "name").distinct()
        near = asked.join(known, "caller_file").join(defs, ["file", "name"]).groupBy("caller_file", "name").agg(F.min("d").alias("d"))
        c = c.join(near.select("caller_file", "name", F.col("d.dst").alias("imported")), ["caller_file", "name"], "left")
    else:
        c = c.withColumn("imported", F.lit(None).cast(functions.schema["function_id"].dataType))
    # The first two of a name: the second is for a caller that is the first itself.
    first = functions.groupBy("name").agg(F.min(place).alias("d"))
    rest = functions.join(first, "name").filter(F.col("function_id") != F.col("d.dst")).groupBy("name").agg(F.min(place).alias("e"))
    c = c.join(first.join(rest, "name", "left").select("name", F.col("d.dst").alias("first"), F.col("e.dst").alias("second")), "name", "left")
    last = F.when(F.col("first") == F.col("caller"), F.col("second")).otherwise(F.col("first")) if skip_self_candidate else F.col("first")
    best = c.select("caller", F.coalesce("own", "imported", last).alias("dst"))
    return best.filter("dst <> caller").select(F.col("caller").alias("src"), "dst").distinct()


def resolve_imports(raw: DataFrame, files: DataFrame) -> DataFrame:
    """raw (src_file, candidates ARRAY<STRING>) and files (file) -> (src_file, dst_file): the first candidate path that is a file, not the source itself."""
    each = raw.withColumn("_id", F.monotonically_increasing_id()).select("_id", "src_file", F.posexplode("candidates").alias("ord", "dst_file"))
    hit = each.join(files.select(F.col("file").alias("dst_file")).distinct(), "dst_file")
    best = hit.groupBy("_id", "src_file").agg(F.min_by("dst_file", "ord").alias("dst_file"))
    return best.filter("src_file <> dst_file").select("src_file", "dst_file").distinct()


def suffix_match(left: DataFrame, right: DataFrame, left_path: str, right_path: str) -> DataFrame:
    """left semi-joined with right where one path equals the other or ends in '/' and the other: each left path is exploded into its suffixes, so the join is by equality."""
    parts = F.split(F.col(left_path), "/")
    n = F.size(parts)
    tails = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "/"))
    hit = left.select(left_path).distinct().withColumn("_tail", F.explode(tails)).join(right.select(F.col(right_path).alias("_tail")).distinct(), "_tail").select(left_path).distinct()
    return left.join(hit, left_path, "left_semi")


def subsystem(functions: DataFrame, manifests: DataFrame) -> DataFrame:
    """functions (file) with ``subsystem``: the deepest directory above the file that has a manifest (manifests: directory); NULL for none."""
    files = functions.select("file").distinct().withColumn("directory", F.explode(ancestors(F.col("file"))))
    depth = F.when(F.col("directory") == ".", 0).otherwise(F.size(F.split("directory", "/")))
    best = files.join(manifests.select("directory").distinct(), "directory").groupBy("file").agg(F.max_by("directory", depth).alias("subsystem"))
    return functions.join(best, "file", "left")


def neighbor_churn(edges: DataFrame, churn: DataFrame) -> DataFrame:
    """(id, neighbor_churn): the churn (id, churn_lines) of a node's callees added up; NULL for 0."""
    s = edges.join(churn.select(F.col("id").alias("dst"), "churn_lines"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("churn_lines").alias("_s"))
    return s.select("id", F.nullif("_s", F.lit(0)).alias("neighbor_churn"))
