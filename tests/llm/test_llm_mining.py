"""Phrase collocations, periodic runs and embedding near-duplicates: the registered
queries over whole test tables and the operators on odd rows, against plain versions."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as E
from binsight.llm import covertree, periodic, phrases

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- phrases ---------------------------------------------------------------------------------

def plain_collocations(rows, least=30, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        drop = {q[i:i + k] for q, b in cand.items() for k in range(2, len(q)) for i in range(len(q) - k + 1)
                if 100 * b >= 80 * c[q[i:i + k]]}
        scored = []
        for p, a in cand.items():
            if p not in drop:
                s, _, left, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), left, r))
        out += [(lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_collocations_of_the_whole_table(spark):
    docs = pd.read_parquet(f"{LARGER}/documents.parquet")
    want = plain_collocations(zip(docs.lang, docs.text))
    assert len(want) > 100 and mined(E.queries()["op11_phrase_collocation"](spark, LARGER)) == want


@pytest.fixture(scope="module")
def prose():
    rnd = random.Random(4)
    vocab = ["New", "york", "CITY", "é", "漢字", "a\x00b", "of", "the", "x", "y"]
    rows = [(rnd.choice(["en", None, "und", "fr"]), "".join(rnd.choice(vocab) + rnd.choice([" ", " ", " ", "\t", ". ", "\n", "  ", ",", "\x1f"])
                                                            for _ in range(rnd.randint(0, 60)))) for _ in range(300)]
    rows += [("en", "new york city hall! " * 40), ("en", None), (None, ""), ("fr", " \t ..;"), ("xx", "alone")]
    return rows + [("long", "of the x, the york of x y " * 3000)] + rows[:20]


@pytest.mark.parametrize("chunk, piece, share", [(1_500_000, 1 << 20, 5_000_000), (700, 256, 100)])
def test_collocations_of_odd_texts(spark, prose, monkeypatch, chunk, piece, share):
    """Nulls, empty texts, repeated rows, long texts cut into slices, split stripes, clashing columns."""
    docs = spark.createDataFrame([(0, la, t, "p", 7, "w") for la, t in prose],
                                 "doc_id int, lang string, text string, phrase string, n int, prefix string").repartition(5)
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    monkeypatch.setattr(phrases, "SLICE", piece)
    monkeypatch.setattr(phrases, "SHARE", share)
    for least, top in ((30, 2000), (2, 15)):
        want = plain_collocations(prose, least, top)
        assert mined(phrases.collocations(docs, least=least, top=top)) == want
    # the workers see a changed constant only if it travels with the function
    cut = [b for t in (t for _, t in prose if t) for b, _ in phrases._slices(t.encode())]
    assert (max(map(len, cut)) < 600) == (piece == 256)


def test_collocations_in_small_chunks(prose):
    """Chunks that end inside a text count every occurrence once."""
    text = next(t for la, t in prose if la == "long")
    tokens = [x for part, last in phrases._slices(text.encode()) for x in part] + [b"\xff"]
    bitmap = np.full(phrases.BITS // 8, 255, np.uint8)
    import pyarrow as pa
    for size in (1, 2, 3):
        def count(cuts):
            got = collections.Counter()
            rest = []
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                now, more = rest + tokens[a:b], i < len(cuts) - 2
                batch = phrases._stripes_of(pa.array(now, pa.binary()), "x", size, bitmap, {})
                rest = now[max(0, len(now) - size):] if more else []
                for r in batch.to_pylist() if batch is not None else []:
                    for w, c in zip(r["next"].split(" "), np.frombuffer(r["count"], np.int64).tolist()):
                        got[r["prefix"], w] += c
            return got
        whole = count([0, len(tokens)])
        assert sum(whole.values()) > 1000
        assert count([0, 1, 2, 3, 50, 1000, 1001, 9000, len(tokens)]) == whole


def test_collocations_without_candidates(spark):
    docs = spark.createDataFrame([("en", "one two three")], "lang string, text string")
    assert phrases.collocations(docs).collect() == []
    empty = phrases.collocations(docs.filter("false"))
    assert empty.collect() == [] and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_phrase_hash_is_the_workers_hash(spark):
    import pyarrow as pa
    phrase = "des été 漢字"
    h = spark.createDataFrame([("fr", phrase)], "lang string, phrase string").selectExpr("lang", "split(phrase, ' ') as w")
    h = h.select(phrases.phrase_hash(h["lang"], h["w"]).alias("h"))
    bitmap = phrases._bitmap(h)
    assert 1 <= int(np.bitwise_count(bitmap).sum()) <= 2
    words = [w.encode() for w in phrase.split()]
    assert phrases._stripes_of(pa.array([*words, *words], pa.binary()), "fr", 3, bitmap, {}) is None
    found = phrases._stripes_of(pa.array([words[0]] * 5, pa.binary()), "fr", 3, np.full(phrases.BITS // 8, 255, np.uint8), {})
    assert found.to_pylist() == [{"lang": "fr", "prefix": "des des des", "part": 0, "next": "des", "count": (2).to_bytes(8, "little")}]


# --- periodic runs ---------------------------------------------------------------------------

def plain_runs(w):
    found, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1 if j == i else j
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len((text or "").encode().split())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    out = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2]))).encode()),
            sha(b" ".join(x for i, x in enumerate(w) if i not in out)))


def test_periodic_runs_of_the_whole_table(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    want = sorted(plain_row(i, t) for i, t in zip(docs.doc_id, docs.text))
    got = E.queries()["op12_periodic_runs"](spark, SF)
    got = got.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sum(r[1] for r in want) > 20 and sorted(tuple(r) for r in got.collect()) == want


def sequences():
    rnd = random.Random(1)
    for _ in range(400):
        n, k = rnd.randint(0, 260), rnd.choice([1, 2, 3, 5, 50])
        ids = [rnd.randrange(k) for _ in range(n)]
        for _ in range(rnd.randint(0, 3)) if n > 20 else ():
            a = rnd.randrange(n)
            p, end = rnd.randint(1, max(1, (n - a) // 3)), rnd.randint(a, n)
            for i in range(a, end):
                ids[i] = ids[a + (i - a) % p]
        yield ids
    yield [0] * 1000
    yield [i % 7 for i in range(1001)]
    yield ([0, 1] * 40 + [2]) * 6


def test_runs_equal_plain_enumeration(monkeypatch):
    for block in (1 << 20, 64):
        monkeypatch.setattr(periodic, "GRID_BLOCK", block)
        for ids in sequences():
            got = [x.tolist() for x in periodic.runs(np.array(ids, np.int64))]
            assert list(zip(*got)) == sorted(plain_runs(ids), key=lambda r: (r[0], r[2]))


def test_cover_and_extensions():
    diffs = {(a - b) % periodic.COVER_MOD for a in periodic.COVER for b in periodic.COVER}
    assert diffs == set(range(periodic.COVER_MOD))
    rnd = random.Random(2)
    for ids in sequences():
        n = len(ids)
        if n < 3:
            continue
        pairs = [sorted((rnd.randrange(n), rnd.randrange(n + 1))) for _ in range(40)]
        i, j = np.array([p for p in pairs if p[0] < p[1]]).T
        got = periodic.Lce(np.array(ids, np.int64)).of(i, j)
        for a, b, c in zip(i, j, got):
            assert ids[a:a + c] == ids[b:b + c] and (b + c == n or ids[a + c] != ids[b + c])


def test_periodic_runs_of_odd_rows(spark):
    beat = "la " * 9
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, beat), (4, beat), (None, beat + "end"), (5, "é x\x00 " * 4), (6, "a\xa0b " * 6),
            (7, "go stop " * 40_000 + beat * 2), (8, " ".join(f"w{i}" for i in range(60_000)))]
    docs = spark.createDataFrame([(i, t, 3, "r", 9) for i, t in rows], "doc_id long, text string, n_words int, runs string, period int")
    got = periodic.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert all(by[i][0]["runs"] == [] and by[i][0]["best"] is None and by[i][0]["collapsed"] == "" for i in (1, 2, 3))
    assert [tuple(x) for x in by[4][0]["runs"]] == [(0, 9, 1)] and len(by[4]) == 2 and by[4][0]["collapsed"] == "la"
    assert by[None][0]["collapsed"] == "la end" and tuple(by[5][0]["best"]) == (0, 8, 2) and by[6][0]["collapsed"] == "a\xa0b"
    assert [tuple(x) for x in by[7][0]["runs"]] == [(0, 80_000, 2), (80_000, 18, 1)] and by[7][0]["collapsed"] == "go stop la"
    assert by[8][0]["runs"] == [] and by[8][0]["n_words"] == 60_000
    assert periodic.periodic_runs(docs.filter("false")).collect() == []


def test_strongest_run_compares_exactly():
    # 10**15 / 3 rounds to the same float as a slightly smaller exact ratio
    length, period = np.array([10 ** 15, 10 ** 15 + 1, 8]), np.array([3, 3, 2])
    assert periodic.strongest(np.array([5, 9, 0]), length, period) == 1
    assert periodic.strongest(np.array([4, 2, 2]), np.array([8, 16, 8]), np.array([2, 4, 2])) == 2


# --- embeddings ------------------------------------------------------------------------------

def plain_links(rows, threshold=0.95):
    """(id, vector) rows -> (id, links, smallest reachable id, kept)."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.abs(v).max() if o else None for (_, v), o in zip(rows, ok)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    n = len(rows)
    adj = [[j for j in range(n) if i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    ids = [np.inf if i is None else i for i, _ in rows]
    low = list(ids)
    while True:
        new = [min([low[i], *(low[j] for j in adj[i])]) for i in range(n)]
        if new == low:
            break
        low = new
    return sorted((str(i), len(a), None if c == np.inf else int(c), i is not None and i == c) for (i, _), a, c in zip(rows, adj, low))


def clusters(rnd, n, dim, k, noise):
    centers = rnd.normal(size=(k, dim))
    return centers[rnd.integers(0, k, n)] + noise * rnd.normal(size=(n, dim))


def got_links(df):
    return sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize("block", [8192, 60])
def test_embeddings_of_every_kind(spark, block):
    rnd = np.random.default_rng(3)
    v = [x.tolist() for x in np.concatenate([clusters(rnd, 150, 6, 5, 0.3), clusters(rnd, 120, 6, 1, 0.02), clusters(rnd, 40, 6, 40, 1)])]
    rows = list(enumerate(v))
    rows += [(1000 + i, [2 * x for x in v[i]]) for i in range(5)] + [(5, v[5]), (5, v[160]), (None, v[6]), (None, None), (2000, v[7])]
    rows += [(3000, [0.0] * 6), (3001, [-0.0] * 6), (3002, []), (3003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3004, [float("nan")] * 6), (3005, [float("inf")] * 6),
             (3006, [1.0, 0.0]), (3007, [2.0, 0.1]), (3008, [-1.0, 0.0]), (3009, [1e300, 1e-300]), (3010, [5e-324, 0.0]), (None, [0.0, 1.0])]
    df = spark.createDataFrame([(i, x, "a", 1) for i, x in rows], "vec_id long, embedding array<double>, node string, rows int").repartition(4)
    assert got_links(covertree.near_duplicates(df, block=block)) == plain_links(rows)
    empty = covertree.near_duplicates(df.filter("false"))
    assert empty.collect() == [] and empty.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_embeddings_of_the_whole_table(spark):
    table = pd.read_parquet(f"{SF}/embeddings.parquet")
    got = got_links(E.queries()["op13_embedding_near_dedup"](spark, SF))
    assert got == plain_links(list(zip(table.vec_id.tolist(), table.embedding.tolist())))


def test_dual_traversal_counts_groups_without_listing_them():
    rnd = np.random.default_rng(0)
    x = clusters(rnd, 3000, 16, 1, 0.005)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree, links = covertree.CoverTree(x), covertree.Links(np.ones(3000, np.int64))
    listed = []
    across = links.across
    links.across = lambda a, b: (listed.append(len(a[0])), across(a, b))
    covertree.traverse(tree, None, links, 0.95)
    count, root = links.result()
    assert (count == 2999).all() and (root == 0).all() and sum(listed) < 3000


def test_cover_tree_invariants():
    rnd = np.random.default_rng(1)
    for dim, k, noise in ((2, 5, 0.1), (16, 30, 0.3), (64, 500, 1)):
        x = clusters(rnd, 700, dim, k, noise)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        tree = covertree.CoverTree(x, leaf=4)
        assert sorted(tree.order) == list(range(700))
        todo = [(tree.root.nodes[0], 2.0)]
        while todo:
            node, cover = todo.pop()
            for c in range(len(node.radius)):
                away = np.linalg.norm(tree.units[node.low[c]:node.high[c]] - node.centers[c], axis=1).max()
                assert away <= node.radius[c] + 1e-7 and node.radius[c] <= cover / 2 + 1e-7  # radii at least halve
                if node.nodes[c] is not None:
                    assert (node.nodes[c].centers == node.centers[c]).all(1).any()  # nested
                    todo.append((node.nodes[c], cover / 2))


@pytest.mark.parametrize("name", ["op11_phrase_collocation", "op12_periodic_runs", "op13_embedding_near_dedup"])
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=key)
