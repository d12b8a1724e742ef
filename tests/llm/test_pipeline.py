import subprocess
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from ruleloom.llm.mixing import mix_plan
from ruleloom.llm.sentencepiece_coding import MODEL


def test_stages_on_a_small_corpus(spark, tmp_path):
    """Each stage's decisions take effect on all that the one before it kept."""
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=MODEL)
    near = "one two three four five six seven eight nine ten " * 3
    token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(i, f"the house number w{i} stands by the river and the people w{i}a like it very much indeed", "en", f"s{i % 3}") for i in range(30)]
    rows += [(50, near, "en", "s0"), (51, near, "en", "s1"), (52, None, None, "s0"), (53, "12 34 !", "en", "s0"), (54, f'the key is here token = "{token}" and so on it goes', "en", "s2"), (55, "", None, None)]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], "").write.parquet(str(tmp_path / str(k)))
        out.append(spark.read.parquet(str(tmp_path / str(k))))
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in out]
    assert set(ids[0]) - set(ids[1]) == {52, 53, 55}
    assert set(ids[1]) - set(ids[2]) == {51} and ids[3] == ids[2]
    assert all(d.columns == docs.columns for d in out[1:5])
    changed = out[3].where("doc_id = 54").first()
    assert token not in changed.text and "[secret]" in changed.text and changed.n_chars == len(changed.text)
    want = {r.doc_id: r["__copies"] for r in mix_plan(out[3]).collect()}
    assert {i: ids[4].count(i) for i in want} == want
    texts = {r.doc_id: r.text for r in out[4].collect()}
    assert all(list(r.ids) == lib.encode(texts[r.doc_id]) and r.round_trip for r in out[5].collect()) and len(ids[5]) == len(ids[4])


def staged(spark, docs, folder):
    """What each stage returns, written and read again."""
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], "").write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Repeated rows, null ids, a very long text, ties, and columns named as the operators' own."""
    long = " ".join(f"the river number w{i} runs by the old house" for i in range(20_000))
    rows = [(1, long, "en", "a", len(long)), (2, "the people of the house like the river very much indeed", None, None, None)]
    rows += [(3, "a letter to the people who live by the old river house today", "en", "a", 60)] * 2
    rows += [(None, "the rain was on the road and in the fields near the town", "en", "b", 57), (None, "the rain was on the road and in the fields near the town", "en", "b", 57), (4, None, None, None, None), (5, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.select("*", *(F.lit(7).alias(c) for c in ("row", "n", "key", "score", "lang_pred", "per_letter", "findings", "redacted", "copies", "size")))
    out = staged(spark, clash, str(tmp_path))
    assert all(d.columns == clash.columns for d in out[1:5])
    ids = [sorted((r.doc_id or 0) for r in d.select("doc_id").collect()) for d in out]
    assert ids[1] == [0, 0, 1, 2, 3, 3] and ids[2] == ids[3] == [0, 1, 2, 3]
    assert out[3].where("doc_id = 1").first().text == long and {r.row for r in out[4].collect()} <= {7}
    assert out[5].where(~F.col("round_trip")).count() == 0


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert [d.count() for d in staged(spark, docs, str(tmp_path))] == [0] * 6


def test_run_matches_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and got.where(~F.col("round_trip")).count() == 0


def test_the_rest_stands_without_the_subpackage(tmp_path):
    """Imports of the entry module in a copy without the subpackage and the pipeline."""
    import shutil
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "ruleloom", tmp_path / "ruleloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op')])"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, timeout=120)
    assert said.returncode == 0 and said.stdout.strip().endswith("[]"), said.stderr
