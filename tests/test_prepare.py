"""CSV files to clean Parquet tables, views, SQL files, and the whole job chain."""

from __future__ import annotations

import json
import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from basketry.operators import quality
from basketry.params import CohortParams, JobParams, PlacementCodes, PromoParams, QualityParams
from basketry.plans.analyze import analyze, write_results
from basketry.plans.prepare import prepare, read_measures, read_stats
from basketry.plans.quality_gate import quality_report, read_report, run_gate
from basketry.sources import storage, tables
from basketry.sources.schemas import PROCESSED_TABLES, RAW_SCHEMAS

WEEKS, HOUSEHOLDS, PRODUCTS = 12, 12, 6


def write_csv(folder, table, rows, header=None):
    names = header or [field.name for field in RAW_SCHEMAS[table].fields]
    text = "\n".join(",".join("" if v is None else str(v) for v in row) for row in [names, *rows])
    (folder / f"{table}.csv").write_text(text + "\n", encoding="utf-8")


def raw_lines():
    """Every household buys two products each week, one visit per week and day."""
    for week in range(1, WEEKS + 1):
        for household in range(1, HOUSEHOLDS + 1):
            day = (week - 1) * 7 + 1 + household % 7
            basket = household * 1000 + week
            for step in range(2):
                product = (household + week + step) % PRODUCTS + 1
                sales = 1 + household * 0.25 + (household * week * product) % 7
                yield (household, basket, day, product, 1, sales, 1 + household % 2, 0, 900,
                       week, 0, 0)


@pytest.fixture(scope="module")
def raw_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    lines = list(raw_lines())
    extra = [
        lines[0],
        (1, 1, 1, 1, 0, 0.0, 1, 0, 900, 1, 0, 0),
        (1, 2, 1, 1, 1, 0.0, 1, 0, 900, 1, 0, 0),
        (1, 3, 1, 1, None, 5.0, 1, 0, 900, 1, 0, 0),
    ]
    write_csv(folder, "transaction_data", [*lines, *extra])
    write_csv(
        folder,
        "product",
        [(p, 7, " GROCERY ", "National", "C", f"S{p % 2}", "  ")
         for p in range(1, PRODUCTS + 1)],
    )
    write_csv(
        folder, "hh_demographic", [("A", "B", "C", "Owner", "E", "D", "K", h) for h in (1, 2, 3)]
    )
    placed = [
        (p, store, week, 0, "A" if p == 1 and week == 8 else 0)
        for p in range(1, PRODUCTS + 1) for store in (1, 2) for week in range(1, WEEKS + 1)
    ]
    write_csv(folder, "causal_data", placed)
    return str(folder)


@pytest.fixture(scope="module")
def processed(spark, raw_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("processed"))
    return folder, prepare(spark, raw_dir, folder, PlacementCodes())


def test_counts(processed):
    rows = {row["table_name"]: row for row in processed[1].collect()}
    lines = rows["transaction_data"]
    clean = WEEKS * HOUSEHOLDS * 2
    assert lines["rows_raw"] == clean + 4
    assert lines["duplicates_removed"] == 1
    assert lines["zero_quantity_removed"] == lines["non_positive_sales_removed"] == 1
    assert (lines["null_value_removed"], lines["rows_clean"]) == (1, clean)
    assert lines["removed_share_of_raw"] == pytest.approx(2 / (clean + 4))
    assert rows["product"]["rows_clean"] == PRODUCTS
    assert rows["product"]["zero_quantity_removed"] is None


def test_written_tables(spark, processed):
    folder, _ = processed
    got = tables.read_tables(spark, folder)
    assert set(got) == set(PROCESSED_TABLES)
    assert got["transaction_data"].count() == WEEKS * HOUSEHOLDS * 2
    assert got["product"].first()["department"] == "GROCERY"
    assert got["product"].first()["curr_size_of_product"] is None
    demographics = got["hh_demographic"].first()
    assert (demographics["classification_4"], demographics["classification_5"]) == ("D", "E")
    assert got["promo_product_week"].count() == WEEKS * PRODUCTS


def test_weeks_are_folders_and_prune(spark, processed):
    folder, _ = processed
    weeks = {name for name in os.listdir(f"{folder}/causal_data") if name.startswith("week_no=")}
    assert weeks == {f"week_no={week}" for week in range(1, WEEKS + 1)}
    frame = spark.read.parquet(f"{folder}/transaction_data").where(F.col("week_no") <= 2)
    assert len(frame.inputFiles()) >= WEEKS
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(week_no" in plan
    assert frame.count() == 2 * HOUSEHOLDS * 2


def test_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "week_no INT, name STRING")
    tables.write_table(frame, path, "week_no")
    tables.write_table(frame.where("week_no = 2"), path, "week_no")
    assert [tuple(row) for row in spark.read.parquet(path).collect()] == [("b", 2)]


def test_sql_file_with_parameters(spark, processed, tmp_path):
    tables.register_views(tables.read_tables(spark, processed[0]))
    (tmp_path / "count_lines.sql").write_text(
        "SELECT count(*) AS n FROM transaction_data WHERE week_no BETWEEN :low AND :high",
        encoding="utf-8",
    )
    row = tables.run_sql_file(spark, str(tmp_path), "count_lines", {"low": 2, "high": 3}).first()
    assert row["n"] == 2 * HOUSEHOLDS * 2


def test_bad_value_raises(spark, tmp_path):
    write_csv(tmp_path, "hh_demographic", [("A", "B", "C", "Owner", "E", "D", "K", "x")])
    with pytest.raises((PySparkException, Py4JJavaError), match="hh_demographic|causal_data"):
        tables.read_raw(spark, str(tmp_path), "hh_demographic").collect()


def test_swapped_header_raises(spark, tmp_path):
    names = [field.name for field in RAW_SCHEMAS["causal_data"].fields]
    write_csv(tmp_path, "causal_data", [(1, 2, 3, 0, 0)], [names[1], names[0], *names[2:]])
    with pytest.raises((PySparkException, Py4JJavaError), match="hh_demographic|causal_data"):
        tables.read_raw(spark, str(tmp_path), "causal_data").collect()


def test_gate_and_analysis(spark, processed, tmp_path):
    """The whole chain; two sub-commodities, one promotion."""
    got = tables.read_tables(spark, processed[0])
    window = run_gate(got, QualityParams(min_week=1, max_week=WEEKS), str(tmp_path / "quality"))
    assert (window.start_week, window.end_week) == (1, WEEKS)
    params = JobParams(
        cohorts=CohortParams(period_weeks=2, min_cohort_size=1, report_periods=(1, 2)),
        promo=PromoParams(pre_weeks=2, min_pre_weeks_with_sales=1, excluded_departments=()),
    )
    data = {
        **read_report(spark, str(tmp_path / "quality")),
        "prepare_stats": read_stats(spark, processed[0]),
    }
    results = analyze(got, window, params, data)
    write_results(results, str(tmp_path / "results"))
    metrics = {
        (row["section"], row["metric"], row["label"]): row["value"]
        for row in spark.read.json(str(tmp_path / "results/results_metrics")).collect()
    }
    assert metrics["business", "total_baskets", ""] == WEEKS * HOUSEHOLDS
    assert metrics["rfm", "share_bought_in_last_week", ""] == 1.0
    assert metrics["cohorts", "retention_period_1", ""] == 1.0
    assert metrics["promo", "treated_units", "units"] == 1
    assert metrics["promo", "products_without_sub_commodity", ""] == 0
    assert metrics["cohorts", "households", "0"] == HOUSEHOLDS
    assert "p_value" in {m for s, m, label in metrics if (s, label) == ("churning_loyal", "avg_basket_value")}
    summary = {
        (row["section"], row["metric"], row["label"]): row["value"]
        for row in spark.read.json(str(tmp_path / "results/data_summary")).collect()
    }
    assert summary["tables", "rows_clean", "transaction_data"] == WEEKS * HOUSEHOLDS * 2
    assert summary["tables", "duplicates_removed", "transaction_data"] == 1
    assert summary["analysis_window", "end_week", ""] == WEEKS
    assert summary["totals", "households", ""] == HOUSEHOLDS
    used = {r["name"]: r["value"] for r in spark.read.json(str(tmp_path / "results/parameters")).collect()}
    assert used["cohorts.report_periods"] == "[1, 2]" and used["window.end_week"] == str(WEEKS)
    assert results["rfm_segments"].agg(F.sum("households")).first()[0] == HOUSEHOLDS


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert storage.shared_folder(spark) == folder
    staged = storage.stage(spark.range(5).toDF("id"), "five")
    assert staged.count() == 5
    assert folder in staged.inputFiles()[0]


def test_cluster_without_shared_folder_is_refused(spark):
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, name, default=None):
            return self.values.get(name, default)

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session())


def test_report_of_window_is_json(spark, lines, tmp_path):
    frame = lines([(1, 1, 1, 5)])
    window = quality.analysis_window(quality.weekly_activity(frame), 0.9, 1)
    window.write.json(str(tmp_path / "w"))
    part = next(p for p in (tmp_path / "w").iterdir() if p.suffix == ".json")
    assert json.loads(part.read_text().splitlines()[0])["start_week"] == 1


def test_results_are_written_in_their_order(spark, tmp_path):
    """File after file, a written result comes in the order readers expect."""
    numbers = [(i * 7919) % 500 for i in range(500)]
    frames = {
        "rfm_segments": spark.createDataFrame(
            [(f"s{i}", 500 - i) for i in numbers], "segment STRING, segment_order INT"
        ).repartition(5),
        "weekly_kpi": spark.createDataFrame(
            [(i if i else None, float(i)) for i in numbers], "week_no INT, revenue DOUBLE"
        ).repartition(5),
    }
    write_results(frames, str(tmp_path))

    def written(name):
        files = sorted((tmp_path / name).glob("part-*.json"))
        return [json.loads(line) for file in files for line in file.read_text().splitlines()]

    assert [r["segment_order"] for r in written("rfm_segments")] == list(range(1, 501))
    weeks = [r.get("week_no") for r in written("weekly_kpi")]
    assert weeks == [None, *range(1, 500)]


def test_the_gate_needs_no_other_look_at_what_prepare_observed(spark, processed, tmp_path):
    """Same report; with the observed measures, the checks read neither lines nor placements."""
    got = tables.read_tables(spark, processed[0])
    params = QualityParams(min_week=1, max_week=WEEKS)
    measured = read_measures(spark, processed[0], params)
    assert {"transaction_data", "causal_data"} <= set(measured)
    run_gate(got, params, str(tmp_path / "plain"))
    run_gate(got, params, str(tmp_path / "measured"), measured)
    reports = [read_report(spark, str(tmp_path / name)) for name in ("plain", "measured")]
    for name, frame in reports[0].items():
        assert sorted(map(repr, frame.collect())) == sorted(map(repr, reports[1][name].collect()))
    checks = quality_report(got, params, measured)["checks"]
    read = checks.inputFiles()
    assert any("/product/" in file for file in read)
    assert not any("/transaction_data/" in file or "/causal_data/" in file for file in read)


def test_observed_measures_equal_those_of_the_written_tables(spark, processed):
    got = tables.read_tables(spark, processed[0])
    params = QualityParams()
    for name, row in read_measures(spark, processed[0], params).items():
        assert tuple(row.first()) == tuple(got[name].agg(*quality.measures(name, params)).first())
