"""The pipeline against its stages by brute force, and the entry points without the subpackage."""

import os
import shutil
import subprocess
import sys

import corpus_pipeline
import test_llm_decontaminate
import test_llm_jaccard
import test_llm_mixing
import test_llm_tokens
from conftest import rows_of, text_of
from tastegrid.llm import langid, tokens
from tokenizers import Tokenizer

ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def brute(spark, rows, items):
    """What each stage keeps, stage by stage, and the final digests."""
    model = langid.train(rows_of(spark, rows))
    lettered, chances = langid.posterior(model, [row[1] for row in rows])
    kept = [
        (row[0], row[1], row[2] or model.languages[chance.argmax()], row[3])
        for row, ok, chance in zip(rows, lettered, chances)
        if ok and chance.max() >= corpus_pipeline.LEAST_LIKELY
    ]
    sizes = [len(kept)]
    least = {doc: component for doc, _, component in test_llm_jaccard.brute(kept, 5, 80)}
    kept = [row for row in dict.fromkeys(kept) if least[row[0]] == row[0]]
    sizes.append(len(kept))
    leaked = {found[0] for found in test_llm_decontaminate.brute(kept, items)}
    kept = [row for row in kept if row[0] not in leaked]
    sizes.append(len(kept))
    chosen = {found[0] for found in test_llm_mixing.brute(kept, corpus_pipeline.MIX)}
    kept = [row for row in kept if row[0] in chosen]
    return [*sizes, len(kept)], test_llm_tokens.expected(Tokenizer.from_file(tokens.tokenizer_path()), kept)


def test_run_equals_brute_force(spark, many_rows, tmp_path):
    import random

    draw = random.Random(8)
    items = [(k, text_of(draw, 12)) for k in range(5)]
    rows = [row for row in many_rows if row[0] < 330]
    rows += [(1000 + k, text_of(draw, 40) + " " + items[k % 5][1], "en", "src0") for k in range(10)]
    rows += [(2000, None, "en", "src1"), (2001, "", "en", "src1"), (2002, "123 !!", None, None), rows[0]]
    rows += [(2003, text_of(draw, 50), None, None)]
    folder = str(tmp_path)
    rows_of(spark, rows).write.parquet(f"{folder}/documents.parquet")
    test_llm_decontaminate.items_of(spark, items).write.parquet(f"{folder}/benchmark.parquet")
    sizes, want = brute(spark, rows, items)
    found = corpus_pipeline.run(spark, folder).orderBy("start").collect()
    assert [tuple(row) for row in found] == want
    assert len(rows) > sizes[0] > sizes[1] > sizes[2] > sizes[3] == len(found) > 0


def test_stages_of_no_rows(spark, empty_docs, tmp_path):
    test_llm_decontaminate.items_of(spark, [(1, "a b c d e f")]).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = empty_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == empty_docs.columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_stages_keep_odd_rows_and_columns(spark, edge_docs, tmp_path):
    test_llm_decontaminate.items_of(spark, []).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = edge_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == edge_docs.columns and docs.count() > 0
    ids = [row["doc_id"] for row in docs.collect()]
    read = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(str(row["doc_id"]) for row in read) == sorted(map(str, ids))


def test_entry_points_work_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": ""})
