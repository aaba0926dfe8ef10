"""The whole analysis in one call: every table, test, model and dataset written to a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from canvass.operators.relate import group_frequency
from canvass.plans import survey
from canvass.session import materialized
from canvass.sources import sinks

REPORTS = {"tblA3": "fs", "tblA4": "buf", "tblA5": "hab", "tblA6": "det", "tblA7": "con"}


def publish(
    responses: DataFrame, dictionary: survey.Dictionary, regions: DataFrame, names: DataFrame,
    attributes: DataFrame, out: str,
) -> list[str]:
    """Run the analysis on a conformed survey table and write its results under ``out``.

    The derived table is stored once in the shared folder and read, a few columns
    at a time, by everything that follows. Returns the paths written.

    ``tables/<name>``       the eleven tables as CSV, rows in block and level order
    ``workbook``            the same tables as one parquet bundle
    ``probit/``             coefficients, effects and fits by family
    ``probit_tables/<name>``  the five coefficient reports
    ``sig_tbl``, ``chi_tbl``  sign matrix and independence tests, quoted CSV
    ``region_map``, ``region_counts``, ``checks``, ``fv_interval``  the remaining datasets, CSV
    """
    derived = survey.collapse_inputs(survey.derive(survey.attach_region(responses, regions, names), dictionary))
    written: list[str] = []

    def to(name: str) -> str:
        written.append(f"{out}/{name}")
        return written[-1]

    with materialized(derived, "derived") as stored:
        tables = survey.all_tables(stored, dictionary)
        for name, table in tables.items():
            sinks.write_table(table, to(f"tables/{name}"))
        sinks.write_bundle(tables, to("workbook"))

        models = survey.probit_models(stored)
        sinks.write_models(models, to("probit"))
        signs = survey.probit_signs(models).orderBy("dep_ord").drop("dep_ord")
        sinks.write_quoted_table(signs, to("sig_tbl"))
        sinks.write_reports(
            {name: survey.probit_report(models, family) for name, family in REPORTS.items()}, to("probit_tables"))

        tests = survey.in_test_order(survey.independence_tests(stored, dictionary))
        sinks.write_quoted_table(tests, to("chi_tbl"))
        sinks.write_table(survey.region_map_data(attributes, stored), to("region_map"))
        sinks.write_table(group_frequency(stored, "region_epa"), to("region_counts"))
        sinks.write_table(survey.farm_checks(stored), to("checks"))
        sinks.write_table(survey.acreage_interval(stored), to("fv_interval"))
    return written
