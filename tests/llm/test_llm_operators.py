"""Operators on small made-up tables: nulls, empty and long texts, ties, repeated
rows, empty tables, extra columns, and their own inner rules."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from binsight.llm import (chat, decontaminate, hpylm, langid, packing, pii, quality, simhash,
                          substrings, topk)
from binsight.llm.components import components

LONG = " ".join(f"word{i % 977}" for i in range(40_000))
PROSE = "The quick brown fox jumps over the lazy dog while seven other animals watch it from the hill. "
ROWS = [(1, PROSE * 3), (2, PROSE * 3), (2, PROSE * 3), (None, PROSE * 3), (3, None), (4, ""), (5, "   \n\t"), (6, LONG),
        (7, "mail me at a.b@c.org or +1 (743) 555-3824 now"), (None, None), (8, "7 8 9"), (9, "Öl é 漢字 😀 \x00 x")]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of every odd kind, with columns that clash with the operators' own names."""
    df = spark.createDataFrame([(i, t, "x", "s", 0, 5, "hit") for i, t in ROWS],
                               "doc_id long, text string, lang string, source string, n_chars long, hits int, spans string")
    return df


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)


ALL_IDS = sorted((i is None, i or 0) for i, _ in ROWS)
ITEMS = [(0, "Which animal jumps over the lazy dog in the story? Answer: the quick brown fox does it every day."),
         (1, None), (2, ""), (3, "too short"), (None, PROSE)]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("call", [
    lambda d: langid.identify(d, d), simhash.near_duplicates, pii.detect, lambda d: hpylm.score(d, d),
    substrings.remove_repeats], ids=["langid", "simhash", "pii", "hpylm", "substrings"])
def test_one_row_for_each_row(odd, empty, call):
    assert ids(call(odd).collect()) == ALL_IDS
    assert call(empty).collect() == []


def test_quality_edges(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (6, None), (1, 1)], "doc_id long, quality int")
    got = quality.quality(odd, odd, labels).collect()
    assert ids(got) == ALL_IDS and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality(empty, odd, labels).collect() == []
    assert {r["score"] for r in quality.quality(odd, odd, labels.filter("false")).collect()} == {0.5}


def test_decontamination_edges(odd, empty, bench):
    got = decontaminate.contamination(odd, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, None), (2, None), (None, None)}
    assert decontaminate.contamination(empty, bench).collect() == []
    assert decontaminate.contamination(odd, bench.filter("false")).collect() == []
    left = decontaminate.decontaminated(odd, bench)
    assert left.columns == odd.columns and left.count() == len(ROWS) - 4


def test_wand_equals_scoring_all():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.choices(vocab, k=rnd.randint(5, 12))) for _ in range(90)]
    postings = [(r, t, rnd.random() / 6) for r, x in enumerate(texts) for t in sorted(set(x.split()))]
    index = decontaminate.Index(list(enumerate(texts)), postings)
    for _ in range(200):
        terms = rnd.sample(range(len(index.lists)), 12)
        total = np.zeros(len(texts))
        for t in terms:
            for row, impact in index.lists[t]:
                total[row] += impact
        want = {i for i in range(len(texts)) if total[i] >= 0.35}
        assert {i for i, _ in index.search(terms, 0.35)} == want


def test_language_rejects_no_letters(odd):
    got = {r["doc_id"]: r for r in langid.identify(odd.filter("doc_id is not null"), odd).collect()}
    assert [got[i]["lang_pred"] for i in (3, 4, 5, 8)] == ["und"] * 4 and got[1]["lang_pred"] == "x"
    assert langid.accepted(odd, odd).columns == odd.columns


FOREIGN = "Съешь же ещё этих мягких французских булок да выпей чаю потому что вечером будет дождь. "


@pytest.mark.parametrize("languages", [["en", "fr", "de", "es"], ["en"]])
def test_foreign_and_random_texts_are_rejected_at_every_length(spark, languages):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.col("lang").isin(languages))
    held = F.expr("crc32(cast(doc_id as string)) % 4 = 0")
    model = langid.fit(docs.filter(~held))
    rnd = random.Random(3)
    for k in range(langid._SHORT, 22):
        size = (1 << k) // 4  # characters: three n-grams each
        noise = " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(size // 8))
        for text in (noise, (FOREIGN * (size // len(FOREIGN) + 1))[:size]):
            assert abs(langid.length_class(langid.counts(text)) - k) <= 1
            assert model.predict(text)[2], (k, text[:60])
    texts = [r["text"] for r in docs.filter(held).collect()]
    kept = [t for t in texts if not model.predict(t)[2]]
    assert len(kept) > 0.95 * len(texts)
    # beginnings of held-out texts stay as well
    heads = [t[:n] for t in kept for n in (60, 120) if len(t) > 200]
    assert sum(not model.predict(t)[2] for t in heads) > 0.97 * len(heads)


def test_a_language_of_many_copies_is_learned(spark):
    # of 3,000 copies of one text, a draw by rows takes all or none; here the text's hash is the largest
    made = spark.createDataFrame([(f"uno dos tres cuatro {'abcdefgh'[i % 8]} {'xyzuvw'[i % 6] * 3} {'k' * (i + 1)}",) for i in range(40)], "text string")
    late = made.orderBy(F.xxhash64("text").desc()).first()["text"]
    train = spark.range(3000).select(F.lit(late).alias("text"), F.lit("es").alias("lang")).unionByName(
        spark.createDataFrame([(PROSE + "fox " * i, "en") for i in range(20)], "text string, lang string"))
    model = langid.fit(train)
    assert set(model.names) == {"en", "es"} and model.predict(late)[0] == "es"


def test_ngram_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Über all, the 7 lights! 漢字 " * 30
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "_PIECE", 17)
    assert (langid.counts(text) == whole).all()


def test_bk_tree_and_split_shards(spark):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2 ** 64, 20, dtype=np.uint64)
    fps = {int(s) ^ (1 << int(a)) ^ (1 << int(b)) for s in seeds for a, b in rng.integers(0, 64, (25, 2))}
    u = np.array(sorted(fps), np.uint64)
    tree = simhash.BKTree(u)
    found = {(int(q), at) for near, at in tree.within(u, 2) for q in near}
    near = np.bitwise_count(u[:, None] ^ u[None]) <= 2
    assert found == {(int(a), int(b)) for a, b in np.argwhere(near)}
    df = spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fp long")

    def classes(block):
        c = {r["node"]: r["root"] for r in components(simhash.links(df, 2, block)).collect()}
        return {int(x): c.get(int(x), int(x)) for x in u.view(np.int64)}

    assert classes(20_000) == classes(3)


def test_keep_one(odd):
    left = simhash.keep_one(odd)
    assert left.columns == odd.columns
    rows = left.collect()
    assert sorted(str(r["doc_id"]) for r in rows if r["text"] == PROSE * 3) == ["1"]
    assert len([r for r in rows if not (r["text"] or "").strip()]) == 1  # blank texts are one component
    twice = odd.filter("doc_id = 2")
    assert simhash.keep_one(twice).count() == 1 and simhash.keep_one(odd.filter("false")).count() == 0


def test_components_on_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1000), (2001, 2000)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {2000: 2000, 2001: 2000}


def test_packing_edges(odd, empty):
    got = packing.pack(odd).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in ROWS}
    assert len([r for r in got if r["doc_id"] == 2]) == 2 and [r["length"] for r in got if r["doc_id"] == 3] == [1]
    assert packing.pack(empty).collect() == []
    placed = packing.pack(odd.filter("doc_id in (1, 6, 7)"))
    made = packing.token_sequences(odd.filter("doc_id in (1, 6, 7)"), placed).collect()
    assert all(len(r["input_ids"]) <= 1024 for r in made)
    assert sum(len(r["input_ids"]) for r in made) == sum(r["length"] for r in placed.collect())


@pytest.mark.parametrize("text", ["", " " * 20_000, "a" * 5000, "<|endoftext|> x", "é漢😀\x00", "I'll  WE'RE\n\n12345"])
def test_token_ids_equal_the_tokenizers(text):
    slow = packing._encoders(packing.TOKENIZER)[1]
    assert list(packing.token_ids(text)) == slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["x <|endoftext|> y", "<|endoftext|>", "<|endoftext|" + " " * 6000])
def test_token_ids_equal_the_unaltered_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(f"{packing.TOKENIZER}.json"))
    assert list(packing.token_ids(text)) == tok.encode(text, add_special_tokens=False).ids


def test_plan_covers_ranks_and_stays_near_the_bound():
    rng = np.random.default_rng(2)
    lengths, counts = np.unique(np.clip(rng.lognormal(5.5, 1, 20_000).astype(int), 1, 1024), return_counts=True)
    seg = packing.plan(list(map(int, lengths)), list(map(int, counts)))
    for size, n in zip(lengths, counts):
        mine = seg[seg[:, 0] == size]
        assert mine[0, 1] == 0 and mine[-1, 2] == n and (mine[1:, 1] == mine[:-1, 2]).all()
    used = int((seg[:, 4] + (seg[:, 2] - seg[:, 1]) // seg[:, 3]).max())
    assert used <= 1.002 * -(-int((lengths * counts).sum()) // 1024)
    chosen = packing.configurations(lengths, counts.astype(float), 1024)
    covered = np.zeros(len(lengths))
    for config, x in chosen.items():
        assert sum(c * lengths[j] for j, c in config) <= 1024
        for j, c in config:
            covered[j] += c * x
    assert (covered >= counts * (1 - 1e-6)).all()


@pytest.mark.parametrize("window", [1, 2, 5, 35])
def test_substrings_against_counting_on_periodic_texts(spark, window):
    rnd = random.Random(window)
    texts = [" ".join(rnd.choice("aab") for _ in range(rnd.choice([0, 3, 40, 90]))) for _ in range(25)] + ["a " * 80, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [(t or "").split() for t in texts]
    seen: dict = {}
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i:i + window])] = seen.get(tuple(w[i:i + window]), 0) + 1
    for r in substrings.remove_repeats(df, window=window).collect():
        w = words[r["doc_id"]]
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                keep[i:i + window] = [False] * window
        assert r["kept"].split() == [x for x, k in zip(w, keep) if k] and r["n_words"] == len(w)


def test_top_k_edges(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(700)] + [(800, None), (900, [1.0, None, 0.0, 0.0]),
            (901, [float("nan")] * 4), (None, [1.0] * 4), (902, [1.0, 2.0]), (5, [3.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "SHARD", 64)
    monkeypatch.setattr(topk, "LEAF", 4)
    monkeypatch.setattr(topk, "SAMPLE", 100)
    got = topk.top_k(df, df.filter("vec_id % 100 = 0"), query_block=3).collect()
    good = [(i, np.floor(1024 * np.array(v))) for i, v in rows if i is not None and v and len(v) == 4
            and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, v in good:
        if q % 100 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q)[:10]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.top_k(df, df.filter("false")).collect() == []


def test_personal_data_is_redacted_natively(odd):
    out = pii.redacted(odd, length_col="n_chars")
    assert out.columns == odd.columns
    row = out.filter("doc_id = 7").first()
    assert row["text"] == "mail me at <EMAIL> or <PHONE> now" and row["n_chars"] == len(row["text"])
    assert out.filter("doc_id = 3").first()["text"] is None and out.filter("doc_id = 6").first()["text"] == LONG
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_personal_data_on_awkward_runs(spark):
    rnd = random.Random(11)
    parts = ["a@b.c", "x.y+z@d-e.org", "_", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+1 (743) 555-3824", "1", ".", "-",
             " ", "é", "@", "😀", "+", "12", "\n"]
    texts = ["".join(rnd.choices(parts, k=9)) for _ in range(400)] + ["1" * 30_000, "1 " * 10_000, "a@b.c " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from tests.llm.test_llm_queries import base_spans
    for r in pii.detect(df).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == base_spans(texts[r["doc_id"]])


def test_labeler_em_finds_the_unreliable_labeler():
    rnd = random.Random(0)
    table: dict = {}
    for _ in range(4000):
        y = rnd.random() < 0.5
        votes = tuple(int(y if rnd.random() < p else not y) for p in (0.95, 0.9, 0.55, 0.9, 0.85))
        table[votes] = table.get(votes, 0) + 1
    rel, prior, _ = pii._em([("card", v, float(n)) for v, n in table.items()])
    assert rel["context"][1][1] < 0.65 and rel["strict"][1][1] > 0.88 and 0.4 < prior["card"] < 0.6


@pytest.mark.parametrize("source, want", [
    ("{{ 'a' + 'b' | upper }}{# no #}", "aB"), ("{% if 1 < 2 and not false %}y{% else %}n{% endif %}", "y"),
    ("{% for m in messages %}{{ loop.index }}{{ m['role'] }}{% if not loop.last %},{% endif %}{% endfor %}", "1user,2assistant"),
    ("a  {%- set x = 'q' -%}  {{ x }}", "aq"), ("{{ nothing.at.all }}", ""), ("{{ messages | length }}", "2")])
def test_template_language(source, want):
    rows = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]
    assert "".join(t for t, _ in chat.compile_template(source)(messages=rows)) == want


@pytest.mark.parametrize("source", ["{{ x.__class__() }}", "{% import os %}", "{{ x | system }}", "{% if x %}", "{{ }}", "{% endfor %}",
                                    "{{ a b }}"])
def test_templates_outside_the_language(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)


def test_constants_are_folded():
    tree = chat.fold_block(chat.parse("a{{ 'b' + 1 }}{% if 1 == 2 %}x{% elif true %}c{% else %}d{% endif %}")[1])
    assert tree == [("text", "ab1c")]


def test_chat_round_trip_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 40)
    hostile = ["</s>", "[INST]", "\\", "<\\", "[:]\n", "[ASSISTANT]", "", "\\\\[", "é😀" * 30]
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate(
        (r, x) for x in hostile for r in ("user", "assistant", None, "[INST]"))]
    rows += [(2, 0, "user", None), (2, 0, "user", None), (3, None, "assistant", "a"), (3, 1, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    import hashlib
    for c in (1, None, 2, 3):
        turns = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c))
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        said = "".join(x for *_, r, x in turns if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.filter("false"))).collect() == []


def test_language_model_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(PROSE * 5,), ("the end of the day and the start of the night " * 9,), ("",)], "text string")
    model = hpylm.fit(df)
    rows = model.probabilities().collect()
    back = np.array([t.back_off() for t in model.samples])
    unseen = np.array([t.parent(np.zeros(1), np.zeros(1))[0] for t in model.samples])
    for ctx in range(hpylm.CONTEXTS):
        total = float((back[:, ctx] * unseen).mean())
        for r in rows:
            own = dict(zip(r["ctx"], r["seen"])).get(ctx)
            total += float((back[:, ctx] * np.array(r["p"])).mean()) if own is None else own
        assert total == pytest.approx(1.0, abs=1e-9)


def test_language_model_learns_each_previous_word(spark):
    # both first words end alike, so their class is the same; only the word tells what follows
    rows = [(i, f"{a}ing {b}") for i, (a, b) in enumerate([("sing", "loud"), ("bring", "home")] * 40)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(0, "singing loud"), (1, "singing home"), (2, "bringing home"), (3, "bringing loud")], train.schema)
    got = {r["doc_id"]: r["score"] for r in hpylm.score(asked, train).collect()}
    assert got[0] > got[1] + 1 and got[2] > got[3] + 1


def test_language_model_word_contexts_sum_to_one(spark):
    df = spark.createDataFrame([(PROSE * 5,), ("the end of the day and the start of the night " * 9,), ("",)], "text string")
    model = hpylm.fit(df)
    words, backing = model.probabilities(), model.backing()
    known = words.collect()
    pairs = collections.defaultdict(dict)
    for r in model.seen(words, backing).collect():
        pairs[r["u"]][r["w"]] = 10 ** r["s"]
    unseen = [float(t.parent(np.zeros(1), np.zeros(1))[0]) for t in model.samples]
    contexts = backing.collect()
    assert len(contexts) > hpylm.CONTEXTS and {r["u"] for r in contexts} == set(pairs)
    for r in contexts:
        ctx = r["u"] & hpylm.CONTEXTS - 1
        share = [t.back_off()[ctx] for t in model.samples]
        total = float(np.mean([b * s * p for b, s, p in zip(r["back"], share, unseen)]))
        for w in known:
            each = dict(zip(w["ctx"], w["each"])).get(ctx) or [s * p for s, p in zip(share, w["p"])]
            total += pairs[r["u"]].get(w["w"], float(np.mean(np.multiply(r["back"], each))))
        assert total == pytest.approx(1.0, abs=1e-6)


def test_language_model_scores_alike_near_and_far(spark, odd, monkeypatch):
    near = sorted((str(r["doc_id"]), r["n_known"], round(r["score"], 3)) for r in hpylm.score(odd, odd).collect())
    monkeypatch.setattr(hpylm, "FREQUENT", 0.01)
    far = sorted((str(r["doc_id"]), r["n_known"], round(r["score"], 3)) for r in hpylm.score(odd, odd).collect())
    assert [x[:2] for x in near] == [x[:2] for x in far]
    assert all(abs(a[2] - b[2]) <= 2e-3 + 1e-6 * abs(a[2]) for a, b in zip(near, far))


def test_language_model_keeps_no_table_that_its_result_does_not_read(spark, odd, monkeypatch, tmp_path):
    from binsight.llm import common
    monkeypatch.setattr(common, "scratch_path", lambda spark, name: f"{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}-{np.random.rand()}")
    got = hpylm.score(odd, odd)
    assert sorted(x.name.rsplit("-", 2)[0] for x in tmp_path.iterdir()) == ["heads", "tail-sums"]
    assert got.count() == odd.count()


def test_language_model_packs_arrays_reversibly():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 64, 1000, np.uint64)
    for x in (hashes, np.sort(hashes), hashes[:1], hashes[:0], np.arange(1000), np.where(np.arange(1000) % 50, 3, 1 << 40),
              np.arange(9) << 40, np.array([-1, 5]), np.zeros(0, np.int64), rng.normal(size=9), np.full(9, 255)):
        got = hpylm._unpack(hpylm._pack(x))
        assert got.dtype == x.dtype and (got == x).all()
    assert len(hpylm._pack(np.ones(1000, np.int64))) < 1100


def test_language_model_scores_alike_in_any_buckets_and_slices(spark, odd, monkeypatch):
    rows = lambda: sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6))
                          for r in hpylm.score(odd, odd.filter("doc_id % 2 = 0")).collect())
    monkeypatch.setattr(hpylm, "FREQUENT", 0.01)
    whole = rows()
    monkeypatch.setattr(hpylm, "LEAST_BUCKETS", 3)
    monkeypatch.setattr(hpylm, "SLICE_TOKENS", 1)
    monkeypatch.setattr(hpylm, "BLOCK_TOKENS", 50)
    assert rows() == whole


def test_language_model_round_moves_no_pairs_by_row(spark, odd):
    model = hpylm.fit(odd.select(F.coalesce("text", F.lit("")).alias("text")), 0, 1)
    plan = hpylm._seated(model.seats, model.samples[0], 1, 1, 1, model.buckets)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_attention_gradient_lowers_the_loss():
    rng = np.random.default_rng(0)
    bags = [rng.normal(0, 1, (rng.integers(1, 6), quality.DIMS)).astype(np.float32) for _ in range(80)]
    y = (np.arange(80) % 2).astype(float)
    for b, t in zip(bags, y):
        b[-1, 3] += 4 * t  # one telling passage
    model = quality.train(bags, y, epochs=40)
    p = np.array([model.forward((b - model.mean) / model.scale, np.zeros(1, int))["p"][0] for b in bags])
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.95


def test_passage_encoding_covers_whole_text():
    x = quality.encode(LONG)
    assert len(x) == -(-40_000 // quality.PASSAGE_WORDS) and np.isfinite(x).all()
    assert quality.encode(None).shape == quality.encode(" \n").shape == (1, quality.DIMS)


def test_pipeline_stages(spark, odd, empty):
    sf = "/root/testdata/sf0.001"
    for start in (odd, empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == odd.columns, name
        assert packing.pack(docs).columns[0] == "doc_id"


def test_pipeline_against_plain_stages(spark):
    import re as _re

    import pandas as pd
    from binsight.llm.common import normal_words, read
    from tests.llm.test_llm_queries import base_spans
    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    found = {r["doc_id"]: r for r in langid.identify(docs, docs).collect()}
    one = corpus_pipeline.language_id(spark, docs, sf)
    assert {r["doc_id"] for r in one.collect()} == {i for i, r in found.items() if not r["rejected"]}
    two = corpus_pipeline.near_duplicates(spark, one, sf)
    comp = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(one).collect()}
    assert {r["doc_id"] for r in two.collect()} == set(comp.values())
    three = corpus_pipeline.decontamination(spark, two, sf)
    line = lambda t: f" {' '.join(normal_words(t))} "
    items = [line(t) for t in pd.read_parquet(f"{sf}/benchmark.parquet").text]
    texts = {r["doc_id"]: r["text"] for r in two.collect()}
    left = {i for i, t in texts.items() if not any(x in line(t) for x in items)}
    assert {r["doc_id"] for r in three.collect()} == left
    four = {r["doc_id"]: r["text"] for r in corpus_pipeline.personal_data(spark, three, sf).collect()}
    for i in left:
        spans = base_spans(texts[i])
        assert (four[i] == texts[i]) == (not spans)
        assert all(texts[i][a:b] not in four[i] for k, a, b in spans if k == "email")
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == left
    assert _re.sub(r"\D", "", str(packed.count()))


def test_every_benchmark_item_is_looked_for(spark):
    """Short items, unsegmented scripts, items beyond a shard, and many shards."""
    rnd = random.Random(9)
    long_item = " ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(150_000))
    chinese = "敏捷的棕色狐狸跳过了懒狗然后它又回到山上看着其他七只动物吃草"
    others = [(10 + i, " ".join(f"t{rnd.randrange(5000)}" for _ in range(40))) for i in range(60)]
    items = [(1, "whoami"), (2, "open the pod bay"), (3, chinese), (4, long_item), *others]
    docs = [(1, "Just type whoami now."), (2, "He said: Open the pod-bay doors"), (3, "open the bay pod the"), (4, f"前言 {chinese}。后记"),
            (5, "x " * 100 + long_item + " y" * 50), (6, others[7][1] + ". " + others[40][1]), (7, None), (8, "nothing here"),
            (9, chinese[:12] + "别的" + chinese[14:15])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([(i, t, 1, "h") for i, t in docs], "doc_id long, text string, shard int, hits string")
    want = {(1, 1), (2, 2), (4, 3), (5, 4), (6, 17), (6, 50)}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(table, bench).collect()}
    assert got == want
    assert len(list(decontaminate.indexes(bench, shard_words=800))) > 3
    left = decontaminate.decontaminated(table, bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 7, 8, 9] and left.columns == table.columns


def test_training_sample_depends_on_the_rows_alone(spark):
    rows = [(i, " ".join(f"{'good' if i % 2 else 'bad'}{j % 7}" for j in range(64 * (1 + i % 5)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    models = [quality.fit(docs.repartition(n), labels.repartition(7 - n), passages=70) for n in (1, 3, 6)]
    for m in models[1:]:
        assert all(np.array_equal(m.weights[k], models[0].weights[k]) for k in m.weights)
    assert not np.array_equal(quality.fit(docs, labels).weights["out"], models[0].weights["out"])


def test_most_shared_sequences_come_from_the_program(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = packing.pieces(docs).groupBy("length").agg(F.count("*").alias("n")).collect()
    report = {}
    packing.plan([r["length"] for r in found], [r["n"] for r in found], report=report)
    assert report["program"] > report["best_fit"]
    tokens = sum(r["length"] * r["n"] for r in found)
    assert sum(report.values()) <= -(-tokens // 1024) + 3
