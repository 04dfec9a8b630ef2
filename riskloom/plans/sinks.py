"""Renderings: JSON, JSON lines, SARIF, text and HTML. Tables are reduced by the cluster; what is rendered whole is a bounded head of them."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import BANDS, driver_action, rank_score
from ..operators import aggregates as A
from ..operators.quantiles import top_n, top_per_group

#: Rows that a text or HTML view shows at most unless told otherwise.
SHOWN = 500


def snapshot_jsonl(functions: DataFrame, commit: dict) -> DataFrame:
    """(value): one JSON object for each function, the commit in each."""
    meta = F.struct(*[F.lit(v).alias(k) for k, v in commit.items()])
    return functions.withColumn("commit", meta).select(F.to_json(F.struct("commit", *functions.columns)).alias("value"))


def write_jsonl(functions: DataFrame, commit: dict, path: str) -> None:
    snapshot_jsonl(functions, commit).write.mode("overwrite").text(path)


def sarif_results(functions: DataFrame) -> DataFrame:
    """(rule_id, level, message, uri, line) of functions of moderate risk and above."""
    level = F.when(F.col("band") == "critical", "error").when(F.col("band") == "high", "warning").otherwise("note")
    text = F.concat(F.lit("Function "), F.col("function_id"), F.lit(" has "), F.col("band"), F.lit(" risk of "), F.format_string("%.2f", "lrs"))
    return functions.filter(F.col("band").isin("moderate", "high", "critical")).select(F.concat(F.lit("risk-"), F.col("band")).alias("rule_id"), level.alias("level"), text.alias("message"), F.regexp_replace("file", "^\\./", "").alias("uri"), F.col("line").cast("long").alias("line"))


def sarif(functions: DataFrame, tool: str = "riskloom") -> str:
    """A SARIF 2.1.0 log."""
    rules = [{"id": f"risk-{b}", "shortDescription": {"text": f"Function of {b} risk"}, "defaultConfiguration": {"level": x}} for b, x in (("moderate", "note"), ("high", "warning"), ("critical", "error"))]
    rows = sarif_results(functions).orderBy("uri", "line", "message").toLocalIterator()
    results = [{"ruleId": r["rule_id"], "level": r["level"], "message": {"text": r["message"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["uri"]}, "region": {"startLine": max(1, r["line"])}}}]} for r in rows]
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}]}, indent=2)


def agent_view(functions: DataFrame, pairs: DataFrame | None = None) -> str:
    """A JSON view for triage: the five riskiest functions of each quadrant, file risk, and hidden coupling."""
    f = functions.withColumn("score", rank_score()).withColumn("action", driver_action(F.col("driver"), F.col("quadrant")))
    keep = ["function_id", "file", "line", "band", "driver", "action", "score"]
    top = top_per_group(f, ["quadrant"], [F.desc("score"), F.col("function_id")], 5).select("quadrant", "rank", *keep).orderBy("quadrant", "rank").collect()
    files = A.file_risk_view(functions).orderBy(F.desc("file_risk_score"), "file").limit(10).collect()
    out = {"schema_version": 4, "triage": {}, "file_risk": [r.asDict() for r in files], "co_change": []}
    for r in top:
        out["triage"].setdefault(r["quadrant"], []).append({k: r[k] for k in keep})
    if pairs is not None:
        out["co_change"] = [r.asDict() for r in pairs.orderBy(F.desc("coupling_ratio"), "file_a", "file_b").limit(20).collect()]
    return json.dumps(out, indent=2, default=str)


def _cell(x, width: int) -> str:
    s = f"{x:.2f}" if isinstance(x, float) else "" if x is None else str(x)
    return s[: width - 1] + "…" if len(s) > width else s.ljust(width)


def table(rows: list, columns: dict[str, int]) -> str:
    """Fixed-width text."""
    return "\n".join([" ".join(n.upper().ljust(w) for n, w in columns.items()), *[" ".join(_cell(r[n], w) for n, w in columns.items()) for r in rows]])


def text_report(functions: DataFrame, top: int = 20) -> str:
    """The riskiest functions in a table."""
    order = [F.desc(rank_score()) if "activity_risk" in functions.columns else F.desc("lrs"), F.col("file"), F.col("line")]
    return table(top_n(functions, order, top).collect(), {"lrs": 7, "band": 9, "line": 6, "function_id": 70})


def grouped_report(functions: DataFrame, top: int = 20) -> str:
    """By band, the riskiest first, with a footer of counts."""
    counts = {r["band"]: r["count"] for r in A.band_distribution(functions, F.col("lrs")).collect()}
    rows = top_per_group(functions, ["band"], [F.desc("lrs"), F.col("file"), F.col("line")], top).orderBy(F.desc("lrs"), "file", "line").collect()
    parts = []
    for b in reversed(BANDS):
        some = [r for r in rows if r["band"] == b]
        if some:
            parts += [f"{b} ({counts[b]})", table(some, {"lrs": 7, "line": 6, "function_id": 70}), ""]
    return "\n".join([*parts, f"{sum(counts.values())} functions"])


def policy_text(results: list) -> str:
    """Blocking results, then warnings by policy."""
    lines = []
    for severity, title in (("blocking", "Policy failures"), ("warning", "Policy warnings")):
        some = [r for r in results if r["severity"] == severity]
        if some:
            lines += [f"{title} ({len(some)})", *[f"  {r['id']}: {r['message']}" for r in some]]
    return "\n".join(lines or ["No policy results"])


def diff_text(rows: list) -> str:
    """A section for each status."""
    lines = []
    for status in ("new", "modified", "deleted"):
        some = [r for r in rows if r["status"] == status]
        if some:
            lines += [f"{status} ({len(some)})", *[f"  {r['function_id']}  {_cell(r['before_lrs'], 7).strip() or '-'} -> {_cell(r['after_lrs'], 7).strip() or '-'}" for r in some]]
    return "\n".join(lines or ["No changes"])


def trends_text(velocities: list, stability: list, refactors: list) -> str:
    return "\n".join(["Velocity", *[f"  {r['function_id']}  {r['velocity']:+.3f} ({r['direction']})" for r in velocities], "Stability", *[f"  {r['function_id']}  {r['overlap_ratio']:.2f} ({r['stability']})" for r in stability], "Refactorings", *[f"  {r['function_id']}  {r['improvement_delta']:+.2f} ({r['outcome']})" for r in refactors]])


def _html_table(rows: list, columns: list[str]) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(_cell(r[c], 200).strip())}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def history_rows(snapshots: DataFrame, last: int = 30) -> DataFrame:
    """(k, functions, total_risk, critical, high, moderate, low) of the last snapshots."""
    recent = snapshots.select("k").distinct().orderBy(F.desc("k")).limit(last)
    g = snapshots.join(F.broadcast(recent), "k").groupBy("k").agg(F.count("*").alias("functions"), F.sum("lrs").alias("total_risk"), *[F.count(F.when(F.col("band") == b, 1)).alias(b) for b in reversed(BANDS)])
    return g.orderBy("k")


def scatter_rows(functions: DataFrame) -> DataFrame:
    """(function_id, x, y, band): risk against activity."""
    return functions.select("function_id", F.col("lrs").alias("x"), F.coalesce(F.col("touch_count_30d").cast("double"), F.col("churn_lines").cast("double"), F.lit(0.0)).alias("y"), F.upper(F.substring("band", 1, 1)).alias("band"))


def summary_cards(functions: DataFrame) -> DataFrame:
    """One row (total, fire, debt, high_plus)."""
    n = lambda c, x: F.count(F.when(c, 1)).alias(x)
    return functions.agg(F.count("*").alias("total"), n(F.col("quadrant") == "fire", "fire"), n(F.col("quadrant") == "debt", "debt"), n(F.col("band").isin("high", "critical"), "high_plus"))


def next_actions(functions: DataFrame, n: int = 3) -> DataFrame:
    """The functions to see to first: fire before debt before watch, then by score, touches and structure."""
    rank = F.when(F.col("quadrant") == "fire", 0).when(F.col("quadrant") == "debt", 1).when(F.col("quadrant") == "watch", 2).otherwise(3)
    f = functions.withColumn("score", rank_score()).withColumn("action", driver_action(F.col("driver"), F.col("quadrant")))
    return f.orderBy(rank, F.desc("score"), F.desc("touch_count_30d"), F.desc("lrs"), "function_id").limit(n)


def html_snapshot(functions: DataFrame, history: DataFrame | None = None, title: str = "Risk report", shown: int = SHOWN) -> str:
    """A page: cards, next actions, quadrants, patterns, files, history and the riskiest functions."""
    card = summary_cards(functions).first()
    f = functions.withColumn("score", rank_score())
    parts = [f"<h1>{html.escape(title)}</h1>", "<p>" + ", ".join(f"{k}: {card[k]}" for k in ("total", "fire", "debt", "high_plus")) + "</p>"]
    parts += ["<h2>Next</h2>", _html_table(next_actions(functions).collect(), ["function_id", "quadrant", "action", "score"])]
    triage = top_per_group(f, ["quadrant"], [F.desc("score"), F.col("function_id")], 5).orderBy("quadrant", "rank").collect()
    parts += ["<h2>Triage</h2>", _html_table(triage, ["quadrant", "rank", "function_id", "score"])]
    if "patterns" in functions.columns:
        parts += ["<h2>Patterns</h2>", _html_table(A.pattern_breakdown(functions).orderBy(F.desc("count"), "pattern").collect(), ["pattern", "count"])]
    parts += ["<h2>Files</h2>", _html_table(A.file_risk_view(functions).orderBy(F.desc("file_risk_score"), "file").limit(shown).collect(), ["file", "file_risk_score", "function_count", "max_cc", "loc"])]
    points = [r.asDict() for r in scatter_rows(functions).orderBy(F.desc("x"), "function_id").limit(shown).collect()]
    parts.append(f'<script type="application/json" id="scatter">{json.dumps(points).replace("</", "<\\/")}</script>')
    if history is not None and len(rows := history_rows(history).collect()) >= 2:
        parts += ["<h2>History</h2>", _html_table(rows, ["k", "functions", "total_risk", "critical", "high", "moderate", "low"])]
    parts += ["<h2>Functions</h2>", _html_table(f.orderBy(F.desc("score"), "function_id").limit(shown).collect(), ["function_id", "line", "band", "lrs", "score"])]
    return "<!DOCTYPE html><html><head><meta charset='utf-8'><title>" + html.escape(title) + "</title></head><body>" + "".join(parts) + "</body></html>"


def html_delta(deltas: DataFrame, policies: DataFrame | None = None, title: str = "Risk changes", shown: int = SHOWN) -> str:
    counts = deltas.groupBy("status").count().orderBy("status").collect()
    changed = deltas.filter("status <> 'unchanged'").orderBy(F.desc(F.abs(F.coalesce("delta_lrs", "after_lrs"))), "function_id").limit(shown).collect()
    parts = [f"<h1>{html.escape(title)}</h1>", _html_table(counts, ["status", "count"])]
    if policies is not None:
        parts += ["<h2>Policies</h2>", _html_table(policies.limit(shown).collect(), ["id", "severity", "function_id", "message"])]
    parts += ["<h2>Functions</h2>", _html_table(changed, ["function_id", "status", "before_lrs", "after_lrs", "delta_lrs", "band_from", "band_to"])]
    return "<!DOCTYPE html><html><head><meta charset='utf-8'><title>" + html.escape(title) + "</title></head><body>" + "".join(parts) + "</body></html>"
