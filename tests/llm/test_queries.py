"""The registered queries against their SQL and brute force, and the pipeline's stages."""

import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from adjudica.llm import oracle, queries
from tests.llm.test_near_copies import plain_set, similar


def test_names():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(oracle.ORACLES) <= set(queries.QUERIES)


@pytest.fixture(scope="module")
def duck(small):
    import glob
    import os

    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{files}')")
    return connection


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_oracle(name, spark, small, duck):
    found = queries.QUERIES[name](spark, small)
    columns = sorted(found.columns)
    plain = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    result = duck.execute(oracle.ORACLES[name])
    names = [d[0] for d in result.description]
    wanted = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == wanted


def test_stages(spark, odd, odd_rows, empty):
    """Each stage on odd rows: columns stay, what should go goes, nothing else does."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "best_fit_packing"]
    docs, rows = odd, odd_rows
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "unused").cache()
        if name != "best_fit_packing":
            assert out.columns == odd.columns
        texts = Counter(r[0] for r in out.select(out.columns[1] if name == "best_fit_packing" else "text").collect())
        if name == "language_id":
            lettered = Counter(r[1] for r in rows if any(c.isalpha() for c in r[1] or ""))
            assert texts <= lettered and texts.total() > 0.8 * lettered.total()
        elif name == "exact_dedup":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
            before = {norm(r["text"]) for r in docs.collect()}
            assert Counter(map(norm, texts.elements())) == Counter(before)
        elif name == "near_dedup":
            before, after = ([plain_set(t) for t in (r["text"] for r in df.collect())] for df in (docs, out))
            assert all(not similar(a, b) for a, b in itertools.combinations(after, 2))
            assert all(any(similar(a, b) for b in after) for a in before)
        elif name == "best_fit_packing":
            assert out.agg(F.sum("length")).first()[0] > 0
        assert stage(spark, empty, "unused").count() == 0
        docs = out


def test_pipeline_runs(spark, small):
    packed = corpus_pipeline.run(spark, small).collect()
    used = Counter()
    for r in packed:
        used[r["sequence_id"]] += r["length"]
    assert packed and max(used.values()) <= 1024
