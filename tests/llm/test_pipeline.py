"""The pipeline's stages against plain Python, each on what the one before wrote."""

import random
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline as cp
from tests.llm.test_duplicates import brute, classes
from vacantia.llm import decontaminate as d
from vacantia.llm.queries import QUERIES

D = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, D).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def test_columns(stages):
    assert all(after.columns == before.columns for before, after in stages[:-1])


def test_quality_rules(spark, stages):
    before, after = stages[0]
    kept = {r["doc_id"] for r in QUERIES["op10_ngram_quality"](spark, D).where("kept").collect()}
    assert {i for i, _ in rows_of(after)} == kept and 0 < len(kept) < before.count()


def test_near_duplicates(stages):
    before, after = (rows_of(x) for x in stages[1])
    assert {i for i, _ in after} == {least for _, least, _ in classes(before)} and len(after) < len(before)


def test_repeated_passages(stages):
    before, after = (rows_of(x) for x in stages[2])
    want = {i: kept.decode("utf-8", "ignore") for i, _, _, kept in brute(before, cp.PASSAGE, "first")}
    assert {str(i): t for i, t in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2][1].collect())


def test_passage_of_51_short_words_is_cut_once(spark):
    rng = random.Random(3)
    short = "to be or so it is on us we do go up by my he at an if in as no me am".split()
    passage = " ".join(rng.choice(short) for _ in range(51))
    rows = [(i, f"{' '.join(f'{i}w{j}' for j in range(60))} {passage} {' '.join(f'{i}v{j}' for j in range(60))}") for i in range(4)]
    after = dict(rows_of(cp.repeated_passages(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), D)))
    assert len(passage) < 200 and after[0] == rows[0][1]
    assert all(passage not in after[i] and len(after[i]) <= len(rows[i][1]) - len(passage) for i in (1, 2, 3))


def test_benchmark_leaks(spark, stages):
    before, after = (rows_of(x) for x in stages[3])
    m = d.Matcher([r["text"] for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()], 0.1, 8)

    def leaks(text):
        return any(x in d.normal(text) or min(d.myers(d.letter_masks(x), len(x), d.normal(text)), default=len(x)) <= k for x, k in zip(m.items, m.budget, strict=True))
    sample = random.Random(1).sample(before, 25)
    assert {i for i, t in sample if not leaks(t)} == {i for i, _ in sample} & {i for i, _ in after}
    assert not any(x in d.normal(t) for _, t in after for x in m.items)


def test_tokens(stages):
    import sentencepiece
    from public_tokenizers import path
    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    before, after = rows_of(stages[4][0]), stages[4][1].collect()
    assert {(r["doc_id"], tuple(r["ids"]), r["text"], r["n_tokens"]) for r in after} == {(i, tuple(sp.encode(t, add_eos=True)), sp.decode(sp.encode(t)), len(sp.encode(t)) + 1) for i, t in before}


def test_run_equals_the_stages(spark, stages):
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in cp.run(spark, D).collect()) == Counter((r["doc_id"], tuple(r["ids"])) for r in stages[-1][1].collect())


def test_odd_rows_pass_all_stages(spark):
    text = " ".join(f"w{i}" for i in range(120))
    rows = [(1, text, None, None, 3, "x"), (2, text, "en", "s", 3, "x"), (2, text, "en", "s", 3, "x"), (None, text + " more", None, None, None, None), (3, None, None, None, None, None), (4, "", "en", "s", 0, "x"), (5, "é" * 900 + text[::-1], "en", "s", None, "x")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, D)
            if name != cp.STAGES[-1][0]:
                assert out.columns == docs.columns
            assert out.count() <= docs.count()


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert "op2_warc_store" in entry.oracle_sql()


def test_archive_twin(spark):
    import duckdb
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{D}/pages.parquet'")
    want = Counter(map(tuple, c.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({entry.oracle_sql()['op2_warc_store']})").fetchall()))
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in QUERIES["op2_warc_store"](spark, D).collect()) == want
