"""The pipeline against a plain version; the SQL of the queries that have it."""

import collections
import itertools
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from panelweave.llm import mixing, queries, quality

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got = con.execute(queries.SQL[name])
    names = [c[0] for c in got.description]
    want = collections.Counter(got.fetchall())
    df = queries.QUERIES[name](spark, SF)
    assert collections.Counter(tuple(r[n] for n in names) for r in df.collect()) == want


def firsts(texts):
    """Smallest id of each group tied by a Jaccard similarity of 0.8 or more of 5-word shingle sets, by all pairs."""
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(texts, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {top(i) for i in texts}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id: r for r in quality.keep_documents(docs).collect()}  # texts without their frequent lines; held against SQL elsewhere
    assert set(kept) == {r.doc_id for r in quality.quality_rules(docs).collect() if r.kept}
    lone = firsts({i: r.text for i, r in kept.items()})
    clean = {i for i in lone if not any(f" {x} " in f" {' '.join(re.findall(r'[^\W_]+', kept[i].text.lower()))} " for x in items)}
    mixed = [r.doc.doc_id for r in mixing.mix_sources(spark.createDataFrame([kept[i] for i in sorted(clean)], docs.schema)).collect()]
    tok, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i in sorted(mixed):
        ids = tok.encode(kept[i].text, add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == want and len(clean) < len(lone) < len(kept) < docs.count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
