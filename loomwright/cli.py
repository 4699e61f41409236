"""Command line: extract the pages of a table and write each site's collection and report.

    python -m loomwright.cli SF_DIR OUTPUT [--site HOST] [--force] [--threshold 0.2]
"""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from loomwright.functions.dialect import SPARK
from loomwright.operators import reports
from loomwright.operators.ranking import by_score
from loomwright.session import materialize, spread, table
from loomwright.sources import files


def generate(spark: SparkSession, sf_dir: str, output: str, site: str | None = None, threshold: float = reports.THRESHOLD, force: bool = False) -> None:
    """Writes OUTPUT/llms (text by site) and OUTPUT/reports; does nothing if they are there, unless forced."""
    if not force and files.exists(spark, f"{output}/llms"):
        return
    spread(table(spark, sf_dir, "pages")).createOrReplaceTempView("pages")
    rows = spark.sql(reports.judged(SPARK, threshold))
    outcomes = materialize(rows if site is None else rows.where(rows["site"] == site))
    outcomes.createOrReplaceTempView("page_outcomes")
    by_score(outcomes.where("status = 'ok'"), "site", "url", name="n").createOrReplaceTempView("numbered_pages")
    now = datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    dated = lambda text: text.replace(reports.GENERATED, now)
    files.write_sections(spark.sql(dated(reports.collection(rows="SELECT * FROM numbered_pages")(SPARK))), f"{output}/llms")
    report = spark.sql(dated(reports.site_report(SPARK)))
    report.select("site", report["report"].alias("value")).write.partitionBy("site").mode("overwrite").text(f"{output}/reports")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loomwright", description=__doc__.split("\n")[0])
    p.add_argument("sf_dir")
    p.add_argument("output")
    p.add_argument("--site", help="only this host")
    p.add_argument("--threshold", type=float, default=reports.THRESHOLD)
    p.add_argument("--force", "--force-reindex", action="store_true", help="write again what is there")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("loomwright").getOrCreate()
    generate(spark, a.sf_dir, a.output, a.site, a.threshold, a.force)


if __name__ == "__main__":
    main()
