import __spark_entry__ as entry_module

# SQL lacks the hash, the seeded order or the file format of these; brute force checks them.
WITHOUT_SQL = {
    "op1_importance_resampling",
    "op2_length_buckets",
    "op3_chat_format",
    "op4_license_scan",
    "op6_simhash",
    "op7_merkle",
    "op9_mix",
    "op10_token_files",
    "op11_product_quantisation",
    "op13_token_alignment",
    "pipeline",
}


def test_text_queries_and_their_statements():
    text, statements = entry_module.text_queries()
    assert set(text) == WITHOUT_SQL | {"op5_line_windows", "op8_line_rules", "op12_merkle_manifest"}
    assert set(statements) == set(text) - WITHOUT_SQL
