"""Mixing sources to target weights by a low-discrepancy schedule.

Slot t of the mixture takes the point frac((t + 1) * phi) of the golden-ratio sequence (or the base-2 van der Corput point) and goes to the source
in whose interval of the cumulative weights that point falls, so any stretch of slots is close to the weights. Slots are ranked within
their source. Each source's documents are shuffled by a keyed hash and its token stream is cut into equal-token blocks; a document
belongs to the block in which its first token lies. Slot number r of a source plays that source's block r.

Sources run out at different times, and nothing is dropped or repeated for that: the mixture has phases. A source of b blocks and weight w lasts
until the virtual time b / w. Phase 0 ends when the first source runs out, and each phase ends at twice the time of the one before. In
a phase the sources that last through it keep their weights; one that runs out in it spreads what it has left over the whole phase; then it is
out of the cumulative weights. So every document of a source with a weight has a slot, and there are as many phases as the times have doublings.

Ranks and token offsets are prefix sums over a whole source, of which one may be most of the corpus. They are taken in two levels: totals of
buckets, whose prefix sums are small, then a window within each bucket. No task sorts a whole source. Sources are a table, of any
length; points meet their intervals in an as-of window by cells of [0, 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, drop_stored, fresh, read, stored

PHI = 0.6180339887498949
#: Exponent on the sources' token shares where no weights are given, as usual for flattening large sources.
ALPHA = 0.7
BLOCK_TOKENS = 2048
SEED = 17
#: Rows that a bucket of the two-level prefix sums should hold.
BUCKET_ROWS = 50_000


def tokens(text: Column) -> Column:
    """White-space separated tokens of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def _van_der_corput(t: Column) -> Column:
    """The bits of t reversed behind the binary point."""
    return F.conv(F.reverse(F.lpad(F.bin(t), 52, "0")), 2, 10).cast("double") / F.lit(float(1 << 52))


def points(t: Column, sequence: str = "golden") -> Column:
    """The low-discrepancy point in [0, 1) of slot t."""
    if sequence == "golden":
        x = (t + 1).cast("double") * F.lit(PHI)
        return x - F.floor(x)
    if sequence == "van_der_corput":
        return _van_der_corput(t + 1)
    raise ValueError(f"no such sequence: {sequence}")


def _prefix(df: DataFrame, group: str, bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """df with ``out``: the sum of ``value`` over the rows of the group that come before, where bucket is the leading part of the order."""
    totals = df.groupBy(F.col(group).alias("_g"), F.col(bucket).alias("_b")).agg(F.sum(value).alias("_v"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_g", "_b", F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(base, F.col(group).eqNullSafe(F.col("_g")) & (F.col(bucket) == F.col("_b"))).withColumn(out, F.col("_base") + F.col("_in")).drop("_in", "_g", "_b", "_base", "_v")


#: Slots that surely give an interval its points, as shares of what the interval's length asks for: the largest gap of T points is below SPARSE / T, and long intervals are short of at most SLACK points.
SPARSE, SLACK = {"golden": 1.9, "van_der_corput": 4.0}, 80


def phases(sources: DataFrame, sequence: str = "golden") -> tuple[DataFrame, list[tuple[int, int]]]:
    """sources (source, blocks, raw) -> (phase, source, lo, hi, quota, base): of each phase the intervals of [0, 1), the blocks a source plays and those it has played before; and (first slot, slots) of each phase, of which there are at most the doublings of a double."""
    spark = sources.sparkSession
    x = sources.withColumn("x", F.col("blocks") / F.col("raw"))
    first, last = x.agg(F.min("x"), F.max("x")).first()
    if first is None:
        return spark.createDataFrame([], "phase int, source string, lo double, hi double, quota long, base long"), []
    times = [0.0]
    while times[-1] < last:
        times.append(first * 2.0 ** (len(times) - 1))
    times = spark.createDataFrame([(p, a, b) for p, (a, b) in enumerate(zip(times[:-1], times[1:]))], "phase int, v0 double, v1 double")

    def played(v: Column) -> Column:
        return F.when(F.col("x") <= v, F.col("blocks")).otherwise(F.least(F.floor(F.col("raw") * v), F.col("blocks")))

    each = x.join(F.broadcast(times), F.col("x") > F.col("v0")).withColumn("base", played(F.col("v0"))).withColumn("quota", played(F.col("v1")) - F.col("base")).filter("quota > 0")
    upto = F.sum("quota").over(Window.partitionBy("phase").orderBy("source").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("quota").over(Window.partitionBy("phase"))
    each = each.withColumn("_upto", upto).withColumn("_total", total)
    each = each.withColumn("lo", (F.col("_upto") - F.col("quota")).cast("double") / F.col("_total")).withColumn("hi", F.col("_upto").cast("double") / F.col("_total"))
    need = F.ceil(F.least(F.lit(SPARSE[sequence]) * (F.col("quota") + 1), (F.col("quota") + SLACK).cast("double")) * F.col("_total") / F.col("quota"))
    each = stored(each.select("phase", "source", "lo", "hi", "quota", "base", need.alias("_need")), "phases")
    spans, at = [], 0
    for p, n in sorted((r[0], r[1]) for r in each.groupBy("phase").agg(F.max("_need")).collect()):
        spans.append((p, at, n))
        at += n
    return each.drop("_need"), spans


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, sequence: str = "golden") -> DataFrame:
    """docs (doc_id, text, source) -> (slot, source, block, doc_id, n_tokens): all documents by their slot in the mixture.

    weights: of each source, any scale; sources that aren't named get none, and their documents no slot. Without it a source weighs its tokens
    (1 at least) to the power alpha. Slots whose source has played its share of the phase are passed over, so slots have gaps. Nothing is repeated, and
    nothing left over. A NULL source is the source ''. Documents without tokens take no room: they belong to the block that their place in
    the shuffle falls into. Repeated rows count as often as they come; rows equal in hash, id and tokens may change places. A NULL doc_id is
    shuffled as ''. An empty table gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = stored(docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col("text")).alias("n_tokens"), key.alias("_key")), "mixrows")
    per = rows.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
    per = per.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / block_tokens)).cast("long"))
    if weights is None:
        per = per.withColumn("raw", F.pow(F.greatest(F.col("n"), F.lit(1)).cast("double"), F.lit(float(alpha))))
    else:
        named = spark.createDataFrame([(s, float(w)) for s, w in weights.items() if w > 0], "source string, raw double")
        per = per.join(named, "source")
    per = stored(per, "sources")
    each, spans = phases(per, sequence)
    if not spans:
        return spark.createDataFrame([], "slot long, source string, block long, doc_id long, n_tokens long")
    n_slots = spans[-1][1] + spans[-1][2]
    cells = 1 << max(0, (n_slots // BUCKET_ROWS).bit_length())
    # Which phase a slot is in: phases are few, as their number is that of doublings.
    begins = F.array(*[F.lit(at) for _, at, _ in spans])
    numbers = F.array(*[F.lit(p) for p, _, _ in spans])
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), points(F.col("id"), sequence).alias("u"), F.element_at(numbers, F.size(F.filter(begins, lambda b: b <= F.col("id")))).alias("phase"))
    slots = slots.select("phase", F.floor(F.col("u") * cells).alias("_cell"), "u", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("source"), "slot")
    # An interval's mark stands at its begin, and again at the begin of each later cell that it reaches into.
    begin = F.floor(F.col("lo") * cells)
    marks = each.withColumn("_cell", F.explode(F.sequence(begin, F.greatest(begin, F.ceil(F.col("hi") * cells) - 1))))
    marks = marks.select("phase", "_cell", F.greatest("lo", F.col("_cell") / cells).alias("u"), F.lit(0).alias("_kind"), "source", F.lit(None).cast("long").alias("slot"))
    where = Window.partitionBy("phase", "_cell").orderBy("u", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    slots = slots.unionByName(marks).withColumn("source", F.last("source", ignorenulls=True).over(where)).filter("_kind = 1")
    slots = slots.select("slot", "phase", "source", F.concat(F.col("phase").cast("string"), F.lit(":"), F.col("source")).alias("_run"), F.floor(F.col("slot") / BUCKET_ROWS).alias("_chunk"))
    slots = _prefix(slots, "_run", "_chunk", [F.col("slot")], F.lit(1), "_rank")
    slots = slots.join(each, ["phase", "source"]).filter(F.col("_rank") < F.col("quota")).select("slot", "source", (F.col("base") + F.col("_rank")).alias("block"))
    bits = max(1, (per.agg(F.sum("k")).first()[0] // BUCKET_ROWS).bit_length())
    rows = rows.withColumn("_bucket", F.substring("_key", 1, -(-bits // 4)))
    placed = _prefix(rows, "source", "_bucket", [F.col("_key"), F.col("doc_id"), F.col("n_tokens")], F.col("n_tokens"), "_before").join(per.select("source", "blocks"), "source")
    placed = placed.withColumn("block", F.least(F.floor(F.col("_before") / block_tokens), F.col("blocks") - 1))
    return slots.join(placed, ["source", "block"]).select("slot", "source", F.col("block").cast("long").alias("block"), "doc_id", "n_tokens")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """The documents of sources that have a weight, with the columns of docs, in the order of their slots, then of doc_id and the text's hash.

    The order is of the whole table: each partition, and each file that is written of it, is the next stretch of the mixture. Texts cross the network
    twice, by id and by slot. Rows of one source and id go where the first of them does. An empty table gives no rows.
    """
    s, i, t = fresh(docs, "_s", "_i", "_t")
    plan = schedule(docs.select("doc_id", "text", "source"), weights, alpha, block_tokens, seed)
    plan = plan.groupBy(F.col("source").alias(s), F.col("doc_id").alias(i)).agg(F.min("slot").alias(t))
    same = (F.coalesce(col("source").cast("string"), F.lit("")) == F.col(s)) & docs["doc_id"].cast("long").eqNullSafe(F.col(i))
    return docs.join(plan, same).orderBy(t, i, F.xxhash64(docs["text"])).select(*[docs["`" + c.replace("`", "``") + "`"] for c in docs.columns])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents, sources weighted by their tokens to the power 0.7."""
    return schedule(read(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH d AS (
  SELECT coalesce(source, '') AS source, doc_id, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::BIGINT AS n_tokens
  FROM documents),
per AS (SELECT source, greatest(1, ceil(sum(n_tokens) / {BLOCK_TOKENS}.0))::BIGINT AS blocks, pow(greatest(sum(n_tokens), 1)::DOUBLE, {ALPHA}) AS raw FROM d GROUP BY source),
x AS (SELECT *, blocks / raw AS x, min(blocks / raw) OVER () AS x0, max(blocks / raw) OVER () AS x1 FROM per),
v AS (SELECT *, CASE WHEN phase = 0 THEN 0 ELSE x0 * pow(2, phase - 1) END AS v0, x0 * pow(2, phase) AS v1
      FROM (SELECT *, unnest(range(0, ceil(log2(x1 / x0))::BIGINT + 2)) AS phase FROM x)),
q AS (SELECT phase, source, CASE WHEN x <= v0 THEN blocks ELSE least(floor(raw * v0)::BIGINT, blocks) END AS base,
             CASE WHEN x <= v1 THEN blocks ELSE least(floor(raw * v1)::BIGINT, blocks) END AS upto FROM v WHERE x > v0),
c AS (SELECT phase, source, base, (upto - base)::BIGINT AS quota, (sum(upto - base) OVER (PARTITION BY phase))::BIGINT AS total,
             (sum(upto - base) OVER (PARTITION BY phase ORDER BY source ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM q WHERE upto > base),
i AS (SELECT *, (run - quota)::DOUBLE / total AS lo, run::DOUBLE / total AS hi, ceil(least({SPARSE["golden"]}::DOUBLE * (quota + 1), (quota + {SLACK})::DOUBLE) * total / quota)::BIGINT AS need FROM c),
f AS (SELECT phase, max(need) AS n FROM i GROUP BY phase),
o AS (SELECT phase, n, coalesce(sum(n) OVER (ORDER BY phase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM f),
t AS (SELECT phase, begin + unnest(range(n)) AS slot FROM o),
u AS (SELECT phase, slot, (slot + 1)::DOUBLE * {PHI} - floor((slot + 1)::DOUBLE * {PHI}) AS u FROM t),
s AS (SELECT slot, source, base, quota, row_number() OVER (PARTITION BY phase, source ORDER BY slot) - 1 AS r FROM u JOIN i USING (phase) WHERE u >= lo AND u < hi),
p AS (SELECT d.source, doc_id, n_tokens, least(floor(coalesce(sum(n_tokens) OVER (PARTITION BY d.source ORDER BY k, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {BLOCK_TOKENS}), per.blocks - 1)::BIGINT AS block
      FROM d JOIN per USING (source))
SELECT slot, s.source, p.block::BIGINT AS block, doc_id, n_tokens FROM s JOIN p ON s.source = p.source AND p.block = s.base + s.r WHERE s.r < s.quota
"""
