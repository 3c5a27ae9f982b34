"""A sample of the registry against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from statera.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = """
op_J1_reconcile op_A5_recon_cells op_A7_reliability_bins op_W3_choose_thresholds op_S5_csv_reader op_S6_xlsx_reader
op_S19_guarded_extract op_P17_carry_decisions op_T4_corrections_stream op_A14_list_price op_M1_attach_signals op_M2_encode
op_A4_field_accuracy op_A16_other_median_date op_W4_sweep_curve op_W5_sweep_recovery op_W13_interleave op_A12_summary_tile
op_R6_run_notes op_P15_counterpart_picker op_R24_call_accounting op_G1_ledger_generator op_G2_vin_maker op_G3_statement_composer
op_G7_rendered_values op_W15_reuse_numbering op_S2_pdf_text_layer op_S14_csv_sink op_S16_ceilings op_S6a_zip_bomb
op_S6c_cell_text op_S7_pdf_fields op_P10_routing_fallback op_R7_document_rows op_R10_exception_row op_R11_crop_source
op_R14_review_detail op_U13_add_column op_U14_replace_all op_S12_table_sink op_Z1_stream_tumbling op_Z3_stream_sessions
op_Z4_stream_dedup op_F7_canonical_text op_J7d_total_score op_S8a_answer_fields op_S8b_self_consistency op_W16_even_pitch_runs
op_W16_table_rows op_W9_deep_page op_A9_sweep_points op_A23_dollars_at_risk op_R25_amount_draw op_W2_rank_pairing op_T2_batch_order
""".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return int(v) if isinstance(v, float) and v == int(v) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(map(str, ([plain(v) for v in r] for r in df.select(*[f"`{c}`" for c in cols]).collect())))
    res = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    theirs = sorted(map(str, ([plain(r[names.index(c)]) for c in cols] for r in res.fetchall())))
    assert ours == theirs


def test_every_query_is_named_once():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert len(registry.QUERIES) > 190
