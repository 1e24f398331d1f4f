"""Each opN_ query on the smallest tables: its contract's columns, by SQL where there is some, else by plain Python."""

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from offergrid.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name):
    return queries.queries()[name](spark, SF)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, twin = run(spark, name), con.sql(queries.ORACLE[name])
    cols = sorted(df.columns)
    assert sorted(twin.columns) == cols
    at = [twin.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in twin.fetchall()), key=str)


def test_op2(spark, docs):
    rows = run(spark, "op2_sharding").collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs.items())
    by = {}
    for r in rows:
        assert (r["law"], r["grown_shard"]) == ("rows", None)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_op3(spark, docs):
    rows = run(spark, "op3_toxicity").collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in docs}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_op4(spark, docs):
    rows = run(spark, "op4_mixing").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert len({(r["slot"], r["place"]) for r in rows}) == len(rows)


def test_op5(spark, docs):
    rows = {r["doc_id"]: r for r in run(spark, "op5_fingerprint").collect()}
    order = sorted(docs, reverse=True)
    for k, i in enumerate(order):
        t, n = docs[i] or "", docs[order[(k + 1) % len(order)]] or ""
        half = len(t) // 2
        assert (rows[i]["n_chars"], rows[i]["edited_sha256"]) == (len(t), sha(t[: len(t) - half] + n[:half]))
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    same = {}
    for i, t in docs.items():
        assert same.setdefault(t or "", rows[i]["fingerprint"]) == rows[i]["fingerprint"]
    assert len(set(same.values())) == len(same)


def test_op7(spark):
    rows = run(spark, "op7_html_extract").collect()
    given = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r["page_id"]: r["url"] for r in rows} == given
    assert all(r["n_chars"] == len(r["text"]) and not re.search(r"\s\s|^\s|\s$", r["text"]) for r in rows)


def test_op8(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    unit, got = x / np.linalg.norm(x, axis=1, keepdims=True), {}
    for r in run(spark, "op8_ann").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    hit = 0
    for q, found in got.items():
        s = unit @ unit[ids == q][0]
        assert sorted(found) == [1, 2, 3, 4, 5] and all(abs(score - s[ids == v][0]) < 1e-12 and v != q for v, score in found.values())
        s[ids == q] = -9
        hit += len({v for v, _ in found.values()} & set(ids[np.argsort(-s)[:5]].tolist()))
    assert hit >= 0.9 * 5 * len(got)


def test_op10(spark, docs):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in docs.items():
        own = enc.encode_ordinary(t or "")
        want[i] = (len(own), sha(" ".join(map(str, own))), sha(t or ""))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, "op10_bpe").collect()} == want
