"""Tasks must run on executors where this package is not installed."""

import pathlib
import subprocess
import sys
import textwrap

ROOT = pathlib.Path(__file__).resolve().parent.parent.parent


def test_tasks_do_not_import_the_package(tmp_path):
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {str(ROOT)!r})
        from geomarket import session
        from geomarket.llm import queries
        spark = session.local_session(cpus=2, memory="2g")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        for name in ("op1_suffix_dedup", "op2_token_counts", "op3_best_fit_packing", "op4_personal_data",
                     "op5_decontamination", "op7_toxicity", "op10_jaccard_join", "op11_prefix_trie", "op12_embedding_whitening",
                     "op13_warc_normaliser"):
            assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
        print("all ran")
    """)
    (tmp_path / "job.py").write_text(script)
    done = subprocess.run(
        [sys.executable, "job.py"], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False)
    assert "all ran" in done.stdout, done.stderr[-2000:]
