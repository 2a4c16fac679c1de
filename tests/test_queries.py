"""A sample of the registered queries against their SQL, and streams against batches."""

from __future__ import annotations

import duckdb
import oracle
import pytest

import __spark_entry__
from gridloom.streaming.events import windowed

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "agg_sumifs", "agg_countif", "agg_subtotal_4", "agg_error_value", "math_divide", "math_round", "math_gcd", "text_proper", "text_find", "text_text_percent", "logic_switch", "info_iserr", "date_eomonth", "date_date", "fin_npv", "eng_dec2hex", "grid_filter_conjunction", "grid_filter_then_sort",
    "grid_distinct", "grid_find", "grid_gather", "format_color_scale", "lookup_vlookup", "lookup_xlookup", "lookup_hlookup", "lookup_approximate", "lookup_match_unsorted", "win_rank_grouped", "win_mode", "win_running_total", "dyn_sequence", "text_textjoin_column", "stream_window", "workbook_evaluate",
    "math_long_formula", "info_type", "date_second", "grid_sort_whole", "grid_find_document", "formula_vlookup", "formula_xlookup", "formula_lookup_last_of_equals", "formula_match", "formula_rank", "formula_sort_unique_filter", "formula_rand", "csv_ragged", "csv_quoted_lines", "csv_whole_files", "xlsx_cells", "docx_blocks", "pptx_shapes",
    "formula_sumif_key", "formula_share", "agg_several_columns", "formula_hlookup", "formula_fill_remaining", "formula_cross_sheet_range", "text_fraction", "agg_median_columns", "formula_user_table", "grid_view_descending", "format_rules", "lineage_precedents", "csv_blank_end",
]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_its_sql(spark, con, name):
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), con.execute(__spark_entry__.oracle_sql()[name]).df()
    assert oracle.difference(got, want) is None


def test_the_contract():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 200


def test_the_flagship_query_runs(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_a_stream_gives_what_the_batch_gives(spark, tmp_path):
    formulas = {"n": "COUNT(value)", "most": "MAX(value)"}
    events = spark.read.parquet(f"{SF}/events.parquet")
    batch = windowed(events, "ts", "1 day", formulas, ["event_type"]).toPandas()
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windowed(stream, "ts", "1 day", formulas, ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("windows").toPandas()
    assert oracle.difference(got, batch) is None


def test_conditions_agree_with_their_sql_on_negative_zeros_and_nulls(spark, tmp_path):
    values = [-0.0, 0.0, None, -0.3, -0.5, 0.25, 0.05, 4999.96, 5000.0, 5000.5, -12.5, -999.99]
    spark.createDataFrame(list(enumerate(values)), "c_custkey long, c_acctbal double").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    own = duckdb.connect()
    own.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = own.execute(__spark_entry__.oracle_sql()["text_conditions"]).fetchall()
    got = __spark_entry__.queries()["text_conditions"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and dict(want)[0] == "-0.0"
