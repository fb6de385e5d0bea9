"""Sinks: JSON, CSV and HTML reports, the store of runs, the exit gate."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webassay.operators import crawl, rules

CSV_COLUMNS = ("severity", "category", "finding_id", "url", "message", "evidence", "fix")


def csv_rows(findings: DataFrame, target: str) -> DataFrame:
    """The seven columns of the CSV report; site findings carry the target's address."""
    return findings.select(*[F.coalesce(F.col(c), F.lit(target)).alias(c) if c == "url" else F.col(c) for c in CSV_COLUMNS]).orderBy(rules.severity_rank(F.col("severity")), "category", "finding_id", "url")


def write_csv(findings: DataFrame, target: str, path: str) -> None:
    csv_rows(findings, target).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def json_report(target: str, summary: DataFrame, score: DataFrame, findings: DataFrame, pages: DataFrame) -> DataFrame:
    """JSON documents by kind: one row each for the summary and score, one for each page with its findings.

    A crawl's report is a folder of lines, so no page list is ever gathered.
    """
    by_page = findings.where("url is not null").groupBy("url").agg(F.array_sort(F.collect_list(F.struct("finding_id", "severity", "evidence"))).alias("findings"))
    page_rows = pages.join(by_page, "url", "left").select(F.lit("page").alias("kind"), F.to_json(F.struct("*")).alias("json"))
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(F.lit(target).alias("target"), "*")).alias("json"))
    site = findings.where("url is null").select(F.lit("site_finding").alias("kind"), F.to_json(F.struct("finding_id", "severity", "evidence")).alias("json"))
    return one(summary, "summary").unionByName(one(score, "score")).unionByName(site).unionByName(page_rows)


def text_summary(findings: DataFrame, scored: DataFrame, most: int = 20) -> str:
    """A few lines for a terminal: the score, and the ids with the gravest findings. Only counts by id come to the driver."""
    head = scored.first()
    counted = findings.groupBy("finding_id", "severity").agg(F.count("*").alias("n")).orderBy(rules.severity_rank(F.col("severity")), F.desc("n"), "finding_id").limit(most).collect()
    width = max((len(r.finding_id) for r in counted), default=0)
    return "\n".join([f"score {head.overall:.1f} ({head.grade}), {head.pages} pages" if head else "no pages", *(f"{r.severity:<9} {r.finding_id:<{width}} {r.n:>7}" for r in counted)])


STYLE = "body{font:15px sans-serif;max-width:70em;margin:2em auto}td{padding:.4em;border-top:1px solid #ccc;vertical-align:top}"


def _table(head: list[str], rows: list[list]) -> str:
    cells = "".join("<tr>" + "".join(f"<td>{escape(str(x))}</td>" for x in r) + "</tr>" for r in rows)
    return "<table><tr>" + "".join(f"<th>{escape(h)}" for h in head) + f"</tr>{cells}</table>"


def html_report(title: str, findings: DataFrame, groups: int = 200, urls: int = 10, lenses: DataFrame | None = None, categories: DataFrame | None = None, worst: int = 100) -> str:
    """A self-contained page: scores, findings grouped by id, the gravest first, each with some of its addresses, and the pages with the most.

    Only grouped rows come to the driver: at most ``groups`` ids of ``urls`` addresses, and ``worst`` pages.
    """
    grouped = crawl.grouped_findings(findings, urls)
    top = grouped.orderBy(rules.severity_rank(F.col("severity")), F.desc("n"), "finding_id").limit(groups).collect()
    out = [f"<!doctype html><html lang=en><meta charset=utf-8><title>{escape(title)}</title><style>{STYLE}</style><h1>{escape(title)}</h1>"]
    if lenses is not None:
        out.append(_table(["Lens", "Score"], [[r.lens, r.score] for r in lenses.orderBy("lens").collect()]))
    if categories is not None:
        out.append(_table(["Category", "Score"], [[r.category, r.score] for r in crawl.categories_in_order(categories).collect()]))
    out.append(_table(["Severity", "Finding", "What", "To do", "Count", "Addresses"], [[r.severity, r.finding_id, r.message or "", r.fix or "", r.n, ", ".join(r.urls) or "site"] for r in top]))
    rank = rules.severity_rank(F.col("severity"))
    by_page = findings.where("url is not null").groupBy("url").agg(F.count_if(rank == 1).alias("critical"), F.count_if(rank == 2).alias("warning"), F.count_if(rank == 3).alias("notice"))
    pages = by_page.orderBy(F.desc("critical"), F.desc("warning"), "url").limit(worst).collect()
    out.append(_table(["Page", "Critical", "Warnings", "Notices"], [[r.url, r.critical, r.warning, r.notice] for r in pages]))
    return "".join(out) + "</html>"


def append_run(findings: DataFrame, run: DataFrame, path: str) -> None:
    """Append a run (run_id, target, score, ...) and its findings to the store, partitioned by target so that history reads prune."""
    run.write.mode("append").partitionBy("target").parquet(f"{path}/runs")
    if len(run.limit(2).collect()) != 1:
        raise ValueError("a run is one row")
    keyed = findings.join(F.broadcast(run.select("run_id", "target")), F.lit(True))
    keyed.select("run_id", "target", "severity", "finding_id", "category", "url", "evidence").write.mode("append").partitionBy("target").parquet(f"{path}/run_findings")


def exit_code(findings: DataFrame, pages: DataFrame, at: str = "critical") -> int:
    """1 if there is no page, or a finding at least as grave as ``at``; else 0."""
    limit = rules.SEVERITIES.index(at) + 1
    return int(pages.isEmpty() or not findings.where(rules.severity_rank(F.col("severity")) <= limit).isEmpty())


def views(spark, **tables: DataFrame) -> None:
    """Register tables (pages, links, findings, edges, detections, runs) for ``spark.sql``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
