import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lexiforge.queries import ORACLE, QUERIES

ROOT, SF = Path(entry.__file__).parent, "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLE)


def test_the_rest_stands_alone(tmp_path):
    """Without the subpackage, its tests and the pipeline everything else imports."""
    shutil.copytree(ROOT / "lexiforge", tmp_path / "lexiforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_terms' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
    for path in (ROOT / "lexiforge").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"(from|import) [\w.]*llm", path.read_text()), path


@pytest.mark.parametrize("name", ["tok_pages_html_url", "idx_postings_tf", "idx_doc_stats", "idx_cosine_norms_15", "bool_nested_parens", "bool_match_not", "phrase_repeated_term", "phrase_and_term", "bm25_qtf", "smart_ltc_ltc", "smart_apb_btu", "search_top_k_batch", "eval_ndcg", "eval_map", "codec_delta_encode", "codec_delta_decode", "codec_vbyte_bytes", "codec_block_bytes", "codec_block_decode", "codec_block_counts", "saved_postings", "saved_cosine_norms", "src_line_tokens", "merged_postings", "merged_doc_stats", "merged_cosine_norms", "saved_top_bm25", "saved_top_boolean", "saved_phrase_and_term", "saved_top_ltc_ltc", "saved_top_Lpc_ltb", "bool_stopword_leaf", "src_text_files", "tok_drop_digits_short", "tok_stopwords", "doc_ids", "bool_pruned_token", "smart_repeated_ltc_ltc", "smart_repeated_Ltu_Ltu", "smart_repeated_apn_lpc", "smart_repeated_lnn_ann", "smart_boolean_phrase_ltu_ltn", "smart_boolean_nnb_nnn", "tok_stemmed", "stem_terms", "default_bm25", "default_boolean", "search_many_mixed", "smart_grid_3600"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    value = lambda x: round(float(x), 6) if isinstance(x, float) else x
    want = sorted(tuple(map(value, r)) for r in found.fetchall())
    assert sorted(tuple(map(value, r)) for r in df.select(*columns).collect()) == want
