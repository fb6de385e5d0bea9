"""``python -m webassay --pages pages.parquet --out reports [target]``: audit page records and write the reports."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import functions as F

from webassay.operators import catalogue, technology
from webassay.plans import job, report
from webassay.session import build_session
from webassay.settings import Settings


def main(argv: list[str] | None = None) -> int:
    args = Settings.parser().parse_args(argv)
    settings = Settings.of(args)
    spark = build_session()
    pages = spark.read.parquet(args.pages)
    own = catalogue.read_json(Path(settings.rules).read_text()) if settings.rules else None
    found = job.audit(spark, pages, settings.target or None)
    detections = technology.merged(technology.detect(found.pages.withColumn("site", F.lit(settings.target)), ["site"], own), ["site"])
    found.extra["detections"] = detections
    report.write_csv(found.findings, settings.target, f"{args.out}/findings")
    job.report(found, settings.target).write.mode("overwrite").partitionBy("kind").text(f"{args.out}/report")
    print(report.text_summary(found.findings, found.score))
    return report.exit_code(found.findings, pages, settings.fail_on)


if __name__ == "__main__":
    sys.exit(main())
