"""The registered queries against their SQL, and the pipeline stage by stage against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import mixing, quality
from tessera.llm import queries as Q
from tests.llm.test_operators import near_truth, norm, truth_ids

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cur = con.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = Counter(tuple(r[names.index(c)] for c in columns) for r in cur.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == want


def test_query_columns(spark):
    for name, query in Q.QUERIES.items():
        if name not in ("op4_hilbert_packing", "op11_prefix_trie", "op12_url_filter", "op13_source_divergence"):  # a row a piece, node, page, item
            assert query(spark, SF).count() == 200, name


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        rows, was = docs.collect(), before.collect()
        if k < 4:
            assert docs.columns == columns
            whole = {r.doc_id: r for r in was}
            assert all(r == whole[r.doc_id] for r in rows)
        ids = sorted(r.doc_id for r in rows)
        if name == "quality":
            told = quality.classify(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert ids == sorted(r.doc_id for r in told.where("keep").collect()) and len(ids) < len(was)
        elif name == "exact_dedup":
            first = {}
            for r in was:
                first[norm(r.text)] = min(first.get(norm(r.text), r.doc_id), r.doc_id)
            assert ids == sorted(first.values())
        elif name == "near_dedup":
            assert ids == sorted(d for d, (_, c) in near_truth([(r.doc_id, r.text) for r in was]).items() if c == d)
        elif name == "mixing":
            plan = {r.doc_id: r for r in mixing.mix(before).collect()}
            assert Counter(ids) == Counter({d: r.taken // r.size for d, r in plan.items() if r.taken}) and max(Counter(ids).values()) <= 3
            words, most = Counter(), Counter()
            for r in plan.values():
                most[r.source] = max(most[r.source], r.size)
            for d in ids:
                words[plan[d].source] += plan[d].size
            for r in plan.values():  # each source's words meet its target to within one document
                assert abs(words[r.source] - r.target) <= max(most[r.source], 0.02 * r.target)
        else:
            pieces = defaultdict(int)
            for r in rows:
                pieces[r.doc_id] += r.length
            for r in was[:20]:
                assert pieces[r.doc_id] % len(truth_ids(r.text)) == 0
        kept.append(len(rows))
    assert all(kept)


def test_pipeline_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and "sequence_id" in got.columns
    by = defaultdict(list)
    for r in got.collect():
        by[r.sequence_id].append(r)
    for own in by.values():
        assert sorted((r.offset, r.length) for r in own)[0][0] == 0 and sum(r.length for r in own) <= 1024


def test_llm_is_not_imported_by_the_library():
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    for f in (root / "tessera").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"tessera\.llm|corpus_pipeline", f.read_text()), f
    assert zlib.crc32(np.array([1], "<u4").tobytes())
