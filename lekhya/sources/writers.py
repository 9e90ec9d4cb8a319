"""Writers: dataset files, extraction results and evaluation reports."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhya.operators.metrics import METRICS


def write_datasets(acts: DataFrame, folder: str) -> None:
    """acts(act_source, act_metadata, chunks) as JSON lines, a folder per act."""
    acts.write.mode("overwrite").partitionBy("act_source").json(folder)


def nested_chunks(chunks: DataFrame, group: str = "doc") -> DataFrame:
    """Chunks of each act as one list in order; an act is one row."""
    rest = [c for c in chunks.columns if c not in (group, "ord")]
    rows = F.array_sort(F.collect_list(F.struct("ord", F.to_json(F.struct(*rest)).alias("j"))))
    kind = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in chunks.schema if f.name in rest) + ">"
    return chunks.groupBy(group).agg(F.transform(rows, lambda r: F.from_json(r["j"], kind)).alias("chunks"))


def write_results(results: DataFrame, folder: str) -> None:
    """Extraction results, one JSON object per act."""
    results.write.mode("overwrite").json(folder)


def write_report(report: DataFrame, path: str, config: dict) -> dict:
    """A report (method, K, metrics) with its configuration as one JSON file.

    A report has a few rows per method; it is the one thing collected.
    """
    results: dict[str, dict[str, float]] = {}
    for r in report.orderBy("method", "K").collect():
        results.setdefault(r["method"], {}).update({f"{m}@{r['K']}": r[m] for m in METRICS})
    out = {"timestamp": datetime.now(UTC).isoformat(), "config": config, "results": results}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, ensure_ascii=False, indent=2)
    return out


def show(hits: DataFrame, n: int = 10, width: int = 80) -> str:
    """Search hits as lines of text: rank, score, source and preview."""
    rows = hits.orderBy("qid", "rank").limit(n).collect()
    return "\n".join(f"{r['qid']} {r['rank']:>2} {r['score']:.4f} {r['act_source']} {(r['text'] or '')[:width]}" for r in rows)
