"""The pipeline against its stages done one by one without Spark."""

import duckdb
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from basketlens.llm import oracles
from basketlens.llm.queries import TOKENIZER
from tests.conftest import SMALL
from tests.llm import brute


def _kept(name, docs):
    """Run a query's SQL on some documents; rows as dictionaries."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW labels AS SELECT * FROM '{SMALL}/labels.parquet'")
    con.register("documents", docs)
    return con.execute(oracles.statements()[name]).to_arrow_table().to_pylist()


def _pick(docs, keys):
    return docs.filter([k in keys for k in docs.column("doc_id").to_pylist()])


def test_pipeline(spark):
    docs = duckdb.sql(f"SELECT * FROM '{SMALL}/documents.parquet'").to_arrow_table()
    sizes = [len(docs)]
    docs = _pick(docs, {r["doc_id"] for r in _kept("op1_quality_rules", docs) if r["kept"]})
    sizes.append(len(docs))
    pairs = list(zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()))
    docs = _pick(docs, set(brute.smallest_keys(pairs)))
    sizes.append(len(docs))
    pairs = list(zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()))
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    clean = {k for (k, _), (_, hit, _) in zip(pairs, brute.leaks(pairs, items)) if not hit}
    docs = _pick(docs, clean)
    sizes.append(len(docs))
    assert sizes == sorted(set(sizes), reverse=True), "every stage has something to remove"
    text = dict(zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()))
    texts, keys = [], []
    for r in sorted(_kept("op2_mix_sources", docs), key=lambda r: r["doc_id"]):
        for _ in range(r["taken"] // r["size"] if r["size"] else 0):
            keys.append(r["doc_id"])
            texts.append(text[r["doc_id"]])
    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    expected = [(k, *row) for k, row in zip(keys, brute.token_rows(texts, tokenizer))]
    found = corpus_pipeline.run(spark, SMALL).orderBy("start").collect()
    assert [tuple(r) for r in found] == expected


def test_stages_keep_columns_and_take_odd_tables(spark):
    """Nulls, empty and repeated rows, further columns, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, key int, own int"
    words = " ".join(f"word{i}" for i in range(30))
    made = [
        (1, words, "en", "a", 1, "r", 1, 1), (1, words, "en", "a", 1, "r", 1, 1), (None, words + " more", None, None, None, "r", 1, 1),
        (2, None, None, None, None, None, None, None), (3, "", "en", "b", 0, "r", 1, 1), (None, None, None, None, None, None, None, None),
        (4, "other " + " ".join(f"thing{i}" for i in range(5000)), "de", "b", 2, "r", 1, 1),
    ]
    for rows in (made, []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            if not rows:
                assert out.count() == 0
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
        assert last.count() == len(rows)
        assert last.where(F.col("n_tokens") < 1).count() == 0
