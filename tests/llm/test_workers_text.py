from test_workers import run_elsewhere


def test_text_queries_run_from_another_folder(tmp_path):
    got = run_elsewhere(tmp_path, "op1_packing", "op2_token_counts", "op3_lm_scoring", "op5_simhash_near_dedup", "op9_quality_rules")
    assert len(got) == 5 and all(int(n) >= 200 for n in got.values())
