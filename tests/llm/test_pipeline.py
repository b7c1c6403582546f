"""The pipeline's stages and its whole run against plain Python, and the registered queries against their SQL."""

import hashlib
import os

import duckdb
import llm_brute as brute
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tallyspark.llm import queries  # noqa: F401
from tallyspark.llm.registry import ORACLE, QUERIES
from tallyspark.sources.tables import TABLES, read_table, table_path

SF = os.environ.get("TALLY_TEST_SF", "/root/testdata/sf0.001")


def run_brute(rows):
    """(doc_id, ids) of (doc_id, text, lang, source, n_chars) rows with known, distinct ids."""
    rows = [r for r in rows if brute.quality(r[1])[-1]]
    first = {i: c for i, c, _ in brute.near_duplicate_classes([r[:2] for r in rows])}
    rows = [r for r in rows if first[r[0]] == r[0]]
    cut = []
    for r, (b, gone) in zip(rows, brute.repeats([r[:2] for r in rows])):
        cut.append((r[0], bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore"), r[3]))
    mixed = [(cut[k][0], cut[k][1]) for *_, k, n in brute.mixture(cut) for _ in range(n)]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [(i, t.encode(x, add_special_tokens=False).ids) for i, x in mixed]


def test_run_matches_python(spark):
    rows = [tuple(r) for r in read_table(spark, SF, "documents").collect()]
    out = cp.run(spark, SF).collect()
    got = [(r["doc_id"], list(r["ids"])) for r in out]
    assert sorted(got) == sorted(run_brute(rows))
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in out:
        text = t.decode(list(r["ids"]), skip_special_tokens=False)
        assert r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_on_odd_rows(odd, clashing, none, spark):
    for docs in (odd, clashing, none):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            out.collect()
        assert cp.STAGES[-1][1](spark, docs, SF).count() == docs.count()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)

    def rows(frame):
        return sorted(repr(tuple(round(float(x), 6) if isinstance(x, float) else x for x in r))
                      for r in frame[columns].astype(object).itertuples(index=False))

    assert rows(got) == rows(want)


def test_whitening_query_gives_rows_per_vector_and_component(spark):
    n = read_table(spark, SF, "embeddings").count()
    assert QUERIES["op11_whitening"](spark, SF).count() == 32 * n


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"op11_whitening"}))
def test_query_gives_a_row_per_document(spark, name):
    n = read_table(spark, SF, "documents").count()
    assert QUERIES[name](spark, SF).count() == n
