"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose candidate spans. Five labelers vote on each (1 personal, 0 not,
2 no opinion): strict pattern, gazetteer, context words, surroundings and digit
variety. Spark counts how often each combination of votes and features occurs;
on this table, whose size is fixed by the value ranges, expectation-maximisation
estimates the labelers' reliabilities and a logistic classifier is trained on
the resulting posteriors. The classifier is then one SQL expression per span.

Patterns are written so that Java's matcher neither recurses nor rescans: a run
of characters is taken possessively and entered only at its start or where the
last match ended (``\\G``), which gives the same leftmost matches.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: name: (kind, pattern, cheap necessary condition: characters or a pattern)
PATTERNS = {
    "email": ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": ("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", None),
    "card": ("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?+[0-9])++", None),
    "phone": ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "email_words": ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++ ?[(\[]dot[)\]] ?[A-Za-z]{2,12}+", "at"),
    "phone_local": ("phone", r"(?<![0-9+.)(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![.-]?[0-9])", None),
    "ssn": ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", None),
    "ip6": ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", ":"),
}
_NEEDS = {"ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){12}", "phone_local": r"[0-9][ .-][0-9]{4}",
          "ssn": r"[0-9]-[0-9]{2}-[0-9]", "email_words": r"[(\[]at[)\]]"}
KINDS = ("email", "ip", "card", "phone", "ssn")  # order of the digests; the first four are the base kinds
BASE = KINDS[:4]

# FIXED VALUES: gazetteers and context words
TOP_DOMAINS = "com org net edu gov mil int info biz io de fr es it nl uk us eu ch at be ca au jp cn in br mx se no pl".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92".split()
ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|62)"
FOR_WORDS = r"e-?mail|mail|contact|write|reach|phone|tel|call|mobile|fax|card|visa|credit|account|ip|host|address|ssn|social|tel[eé]fono|correo|t[eé]l[eé]phone|kontakt"
AGAINST_WORDS = r"version|release|section|chapter|page|isbn|issn|doi|figure|table|serial|order|invoice|example only|build"

ADD_AT = 0.9  # probability at which the classifier adds a span
_CONTEXT = 24
_FOLD = 256  # rows folded at once
_VOTES = ("strict", "gazetteer", "context", "around", "variety")
_FEATURES = ("pattern", "ok", "gazetteer", "context", "before_class", "after_class", "digits", "length")


def _found(text: Column, pattern: str) -> Column:
    """All matches in order: array of (start, end, hit, before, after); positions in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern, -1)
    rows = F.zip_with(hits, F.zip_with(gaps, F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))),
                                       lambda g, n: F.struct(g.alias("gap"), n.alias("next"))),
                      lambda h, g: F.struct(h.alias("hit"), g["gap"].alias("gap"), g["next"].alias("next")))
    span = "struct<start:int,end:int,hit:string,before:string,after:string>"
    none = F.array().cast(f"array<{span}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"),
                       F.lower(F.right(x["gap"], F.lit(_CONTEXT))).alias("before"),
                       F.left(x["next"], F.lit(1)).alias("after")).cast(span)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return _in_blocks(F.filter(rows, lambda x: x["hit"].isNotNull()), none, step)["out"]


def _in_blocks(rows: Column, none: Column, step) -> Column:
    """Fold ``rows`` with ``step`` into struct(at, out), where each step appends to the array
    ``out``. Blocks of rows are folded into short arrays of their own, which are then
    appended as a whole: no step copies all that was found before."""
    begin = F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1)), F.lit(_FOLD))
    blocks = F.transform(begin, lambda i: F.slice(rows, i, _FOLD))

    def block(acc: Column, some: Column) -> Column:
        one = F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.transform(F.array(one), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out")))[0]

    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), block)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Doubles every second digit from the right; the sum must divide by ten."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x, i: x.cast("int") * (1 + i % 2))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _ok(name: str, hit: Column) -> Column:
    """Whether a match passes the checks of its pattern."""
    if name == "ip":
        return hit.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if name == "card":
        n = F.length(_digits(hit))
        return F.when(n.between(16, 19), _luhn(_digits(hit))).otherwise(False)
    if name == "phone":
        return F.length(_digits(hit)).between(8, 15)
    if name == "ssn":
        return ~hit.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _described(name: str, x: Column) -> Column:
    """A match with its votes and features."""
    kind = PATTERNS[name][0]
    hit, digits = x["hit"], _digits(x["hit"])
    ok = _ok(name, hit)
    yes = lambda c, other: F.when(c, F.lit(1)).otherwise(F.lit(other))
    if kind == "email":
        gaz = yes(F.lower(F.regexp_extract(F.right(hit, F.lit(16)), r"([A-Za-z]++)[)\]]?$", 1)).isin(TOP_DOMAINS), 2)
    elif name == "ip":
        gaz = F.when(hit.rlike(r"^(?:0|127|255)\."), F.lit(0)).otherwise(F.lit(2))
    elif kind == "card":
        gaz = yes(digits.rlike(ISSUER), 0)
    elif name == "phone":
        gaz = yes(digits.rlike("^(?:" + "|".join(CALLING_CODES) + ")"), 2)
    else:
        gaz = F.lit(2)
    context = F.when(x["before"].rlike(rf"\b(?:{AGAINST_WORDS})\b"), F.lit(0)).when(
        x["before"].rlike(rf"\b(?:{FOR_WORDS})\b"), F.lit(1)).otherwise(F.lit(2))
    side = lambda c: (F.when(F.coalesce(c, F.lit("")) == "", F.lit(0)).when(c.rlike(r"^\s"), F.lit(0))
                      .when(c.rlike(r"^[\p{L}\p{N}_]"), F.lit(1)).otherwise(F.lit(2)))
    before, after = side(F.right(x["before"], F.lit(1))), side(x["after"])
    distinct = F.size(F.array_distinct(F.split(digits, "")))
    many = F.when(F.length(digits) == 0, F.lit(0)).when(distinct <= 2, F.lit(1)).otherwise(F.lit(2))
    strict = yes(ok, 0) if name in BASE or name == "ssn" else F.lit(2)
    return F.struct(
        F.lit(name).alias("pattern"), F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
        (ok & F.lit(name in BASE)).alias("base"), ok.cast("int").alias("ok"), strict.alias("strict"),
        gaz.alias("gazetteer"), context.alias("context"),
        F.when((before == 1) | (after == 1), F.lit(0)).otherwise(F.lit(1)).alias("around"),
        F.when(many == 1, F.lit(0)).when(many == 2, F.lit(1)).otherwise(F.lit(2)).alias("variety"),
        before.alias("before_class"), after.alias("after_class"), many.alias("digits"),
        F.least(F.length(hit) / 8, F.lit(4)).cast("int").alias("length"))


def with_candidates(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """``docs`` with an array column ``out`` of all described candidate spans."""
    made = []
    df = docs
    for name, (_, pattern, chars) in PATTERNS.items():
        text = F.coalesce(F.col(text_col), F.lit(""))
        likely = F.contains(text, F.lit(chars)) if chars else F.lit(True)
        if name in _NEEDS:
            likely = likely & text.rlike(_NEEDS[name])
        col = free_name(df, f"{out}_{name}")
        df = df.withColumn(col, F.when(likely, _found(text, pattern)))
        made.append((name, col))
    def all_of(name: str, col: str) -> Column:
        found = F.coalesce(F.col(col), F.array().cast(df.schema[col].dataType))
        return F.transform(found, lambda x: _described(name, x))

    each = [all_of(name, col) for name, col in made]
    return df.withColumn(out, F.concat(*each)).drop(*(c for _, c in made))


@dataclass
class Model:
    reliability: dict  # labeler -> class -> vote -> probability
    prior: dict  # pattern -> probability of personal data
    weights: dict  # feature -> value -> weight; "bias"

    def probability(self, x: Column) -> Column:
        z = F.lit(float(self.weights["bias"]))
        for f in _FEATURES:
            known = self.weights[f]
            if known:
                table = F.create_map(*(F.lit(v) for kv in known.items() for v in kv))
                z = z + F.coalesce(F.element_at(table, x[f]), F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _em(rows: list[tuple[str, tuple[int, ...], float]], rounds: int = 60) -> tuple[dict, dict, list[float]]:
    """Reliabilities, priors and posteriors of (pattern, votes, count) rows.

    The first posterior is the share of positive votes among opinions; every
    estimate holds one pseudo-count that trusts a labeler four times in five.
    """
    post = []
    for _, votes, _ in rows:
        said = [v for v in votes if v != 2]
        post.append((1 + 2 * sum(said)) / (2 + 2 * len(said)))
    rel: dict = {}
    prior: dict = {}
    for _ in range(rounds):
        seen: dict = defaultdict(lambda: [1.0, 1.0])
        rel = {name: {y: {v: (0.6 if v == y else 0.15 if v != 2 else 0.25) * 4 for v in (0, 1, 2)} for y in (0, 1)}
               for name in _VOTES}
        for (pattern, votes, n), p in zip(rows, post):
            seen[pattern][0] += n * (1 - p)
            seen[pattern][1] += n * p
            for name, v in zip(_VOTES, votes):
                rel[name][1][v] += n * p
                rel[name][0][v] += n * (1 - p)
        prior = {k: b / (a + b) for k, (a, b) in seen.items()}
        for name in _VOTES:
            for y in (0, 1):
                total = sum(rel[name][y].values())
                rel[name][y] = {v: c / total for v, c in rel[name][y].items()}
        new = []
        for pattern, votes, _ in rows:
            odds = math.log(prior[pattern] / (1 - prior[pattern]))
            for name, v in zip(_VOTES, votes):
                odds += math.log(rel[name][1][v] / rel[name][0][v])
            new.append(1 / (1 + math.exp(-max(-40.0, min(40.0, odds)))))
        done = max((abs(a - b) for a, b in zip(new, post)), default=0) < 1e-7
        post = new
        if done:
            break
    return rel, prior, post


def _train(rows: list[tuple[tuple, float, float]], rounds: int = 300) -> dict:
    """Logistic weights from (feature values, count, posterior) rows, by gradient
    steps with momentum, counts damped so that frequent patterns do not drown rare ones."""
    w: dict = {f: {} for f in _FEATURES} | {"bias": 0.0}
    total = sum(math.sqrt(n) for _, n, _ in rows)
    speed: dict = defaultdict(float)
    for _ in range(rounds if rows else 0):
        slope: dict = defaultdict(float)
        for values, n, p in rows:
            z = w["bias"] + sum(w[f].get(v, 0.0) for f, v in zip(_FEATURES, values))
            miss = math.sqrt(n) / total * (p - 1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
            slope["bias", None] += miss
            for f, v in zip(_FEATURES, values):
                slope[f, v] += miss
        for (f, v), g in slope.items():
            old = w["bias"] if f == "bias" else w[f].get(v, 0.0)
            speed[f, v] = 0.9 * speed[f, v] + g - 0.0005 * old
            if f == "bias":
                w["bias"] = old + speed[f, v]
            else:
                w[f][v] = old + speed[f, v]
    return w


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Model from all texts. The collected table has a row for each combination of
    votes and features that occurs; their value ranges bound it, not the corpus."""
    c = free_name(docs, "candidates")
    x = free_name(docs, "x")
    names = tuple(dict.fromkeys(("pattern", *_VOTES, *_FEATURES)))
    table = (with_candidates(docs.select(text_col), text_col, c).select(F.explode(c).alias(x)).select(f"{x}.*")
             .groupBy(*names).agg(F.count("*").alias("n")).collect())
    table = sorted(table, key=lambda r: tuple(str(r[k]) for k in names))
    votes = [(r["pattern"], tuple(r[v] for v in _VOTES), float(r["n"])) for r in table]
    rel, prior, post = _em(votes)
    return Model(rel, prior, _train([(tuple(r[f] for f in _FEATURES), float(r["n"]), p) for r, p in zip(table, post)]))


def with_spans(docs: DataFrame, model: Model, text_col: str, out: str) -> DataFrame:
    """``docs`` with an array column ``out`` of (rank, start, end, kind, base),
    sorted: all base spans, and the candidates that the classifier adds where
    they overlap no base span."""
    c = free_name(docs, f"{out}_candidates")
    df = with_candidates(docs, text_col, c)
    rank = F.create_map(*(v for i, k in enumerate(KINDS) for v in (F.lit(k), F.lit(i))))
    slim = lambda x: F.struct(F.element_at(rank, x["kind"]).alias("rank"), x["start"].alias("start"),
                              x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"))
    b = free_name(df, f"{out}_base")
    df = df.withColumn(b, F.filter(c, lambda x: x["base"]))
    added = F.filter(c, lambda x: ~x["base"] & (x["ok"] == 1) & (model.probability(x) >= ADD_AT) & ~F.exists(
        b, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return df.withColumn(out, F.array_sort(F.transform(F.concat(F.col(b), added), slim))).drop(b, c)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, spans): the spans of every row of ``docs``, in code points, end exclusive.

    Without a model one is fitted on ``docs``. A null text is an empty one and has
    no spans; repeated rows and null ids are answered each; other columns are not
    looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_spans(rows, model or fit(rows), "text", "spans").select("doc_id", "spans")


def span_text(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"),
                                                                x["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = None,
             model: Model | None = None) -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in angle
    brackets (overlapping spans by the first one's); ``length_col``, if given,
    gets the new text's length where the text changed. Other columns stay; a null text stays null."""
    s = free_name(docs, "spans")
    text = F.col(text_col)
    df = with_spans(docs, model or fit(docs, text_col), text_col, s)
    ordered = F.array_sort(F.transform(s, lambda x: F.struct(x["start"], x["end"], x["kind"])))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        more = F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]),
                       F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    parts = F.array(_in_blocks(ordered, F.array().cast("array<string>"), step))
    rest = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))
    clean = F.when(F.size(s) > 0, F.transform(parts, rest)[0]).otherwise(text)
    new = free_name(df, "clean")
    df = df.withColumn(new, clean)
    put = {c: F.col(f"`{c}`") for c in docs.columns}
    put[text_col] = F.col(new).alias(text_col)
    if length_col and length_col in put:
        kind = docs.schema[length_col].dataType
        put[length_col] = F.when(F.size(s) > 0, F.length(new).cast(kind)).otherwise(F.col(length_col)).alias(length_col)
    return df.select(*put.values())
