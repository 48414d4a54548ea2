"""The registered queries over whole test tables, against plain Python versions and SQL."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as E
from binsight.llm.common import normal_words

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def run(spark, name, sf=SF, by="doc_id"):
    return E.queries()[name](spark, sf).toPandas().sort_values(by).reset_index(drop=True)


def remainder(ids, mod):
    return np.array([zlib.crc32(str(i).encode()) % mod for i in ids])


def test_all_are_registered():
    names = set(E.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


@pytest.mark.parametrize("name", ["op6_exact_topk", "op8_chat_formatting"])
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


def test_decontamination_finds_each_held_item(spark, docs):
    got = run(spark, "op1_benchmark_decontamination", LARGER)
    bench = pd.read_parquet(f"{LARGER}/benchmark.parquet")
    texts = pd.read_parquet(f"{LARGER}/documents.parquet")
    line = lambda t: f" {' '.join(normal_words(t))} "
    items = [(i, line(t)) for i, t in zip(bench.item_id, bench.text)]
    held = {(d, i) for d, t in zip(texts.doc_id, map(line, texts.text)) for i, item in items if item in t}
    assert held and set(zip(got.doc_id, got.item_id)) == held


def test_language_held_out_accuracy(spark):
    got = run(spark, "op2_language_id", LARGER)
    truth = pd.read_parquet(f"{LARGER}/documents.parquet").sort_values("doc_id").lang.to_numpy()
    held = remainder(got.doc_id, 4) == 2
    assert (got.held_out == held).all() and got.score.between(0, 1).all()
    assert (got.lang_pred.to_numpy() == truth)[held].mean() > 0.98


def test_simhash_against_all_pairs(spark, docs):
    def fp(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = run(spark, "op3_simhash_near_dedup")
    f = np.array([fp(t) for t in docs.text], np.uint64)
    assert list(got.fingerprint) == [f"{x:016x}" for x in f]
    comp = list(range(len(f)))
    for _ in range(len(f)):
        new = [min(comp[j] for j in np.flatnonzero(np.bitwise_count(f ^ x) <= 2)) for x in f]
        if new == comp:
            break
        comp = new
    assert list(got.component_id) == [docs.doc_id[c] for c in comp]


def test_packing_round_trip(spark, docs):
    got = run(spark, "op4_best_fit_packing", by=["doc_id", "piece"])
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, text in zip(docs.doc_id, docs.text):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = got[got.doc_id == d]
        at = 0
        for p, r in enumerate(mine.itertuples()):
            assert (r.piece, r.start) == (p, at) and r.length <= 1024 and (p == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024
    assert got.sequence_id.nunique() <= 1.01 * -(-got.length.sum() // 1024) + 1


def test_substrings_against_counting(spark, docs):
    got = run(spark, "op5_substring_dedup")
    words = [(t or "").encode().split() for t in docs.text]
    seen = collections.Counter(tuple(w[i:i + 35]) for w in words for i in range(len(w) - 34))
    for r, w in zip(got.itertuples(), words):
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i:i + 35])] > 1:
                keep[i:i + 35] = [False] * 35
        kept = [x for x, k in zip(w, keep) if k]
        assert (r.n_words, r.n_removed) == (len(w), len(w) - len(kept))
        assert r.kept_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(m):
        return sum(x if x < 10 else x - 9 for i, c in enumerate(reversed(digits(m))) for x in [int(c) * (1 + i % 2)]) % 10 == 0

    rules = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(m)),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15))
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0])]


def test_personal_data_base_spans(spark):
    got = run(spark, "op7_pii", LARGER)
    texts = pd.read_parquet(f"{LARGER}/documents.parquet").sort_values("doc_id").text
    for r, t in zip(got.itertuples(), texts):
        base = base_spans(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_language_model_counts_and_gain(spark, docs):
    got = run(spark, "op9_lm_scoring")
    tokens = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()).split() + [b" "] for t in docs.text]
    held = remainder(docs.doc_id, 10) == 0
    c = collections.Counter(x for t, h in zip(tokens, held) if not h for x in t)
    n, v = sum(c.values()), len(c)
    assert (got.held_out == held).all() and (got.train_tokens == n).all()
    assert list(got.n_tokens) == list(map(len, tokens))
    assert list(got.n_known) == [sum(x in c for x in t) for t in tokens]
    base = [sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t) for t in tokens]
    assert np.allclose(got.base_score, base)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_quality_held_out(spark):
    got = run(spark, "op10_quality_classifier", LARGER)
    labels = pd.read_parquet(f"{LARGER}/labels.parquet")
    assert (got.held_out == (remainder(got.doc_id, 3) == 1)).all() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    out = got[got.held_out].merge(labels, on="doc_id")
    good, bad = out.score[out.quality == 1].to_numpy(), out.score[out.quality == 0].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.95
