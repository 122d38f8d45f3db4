"""Personal data by weak supervision, in DataFrame and SQL functions alone.

Candidates are the strict spans of the four base kinds, spans of looser form that no strict span overlaps (numbers written without
+, with other separators or a wrong checksum, mail addresses with spelt-out signs, IPv6) and secrets (access keys, tokens, hashes). Labelers look at
every candidate: its form and checksum (regex), fixed lists of prefixes and endings (gazetteer), words before the span (context) and the
characters beside it. Each votes yes, no or abstains. Expectation-maximisation over the counts of vote
patterns estimates every labeler's reliability without labels; its posteriors then train the final span
classifier, a logistic model on shape features of the span. Vote patterns and feature patterns are few by
construction (3 ** labelers times a fixed number of shapes), so their counts are what reaches the driver.

Strict spans stay whatever the classifier says; of the others, those it accepts are added.

Work is linear in the text, also with very many spans: what is appended span by span is gathered in chunks of CHUNK (`folded`), and a
span's surroundings come from the gaps between matches, never from counting through the text again.

Defined cases: null text is empty and has no spans; the digest of no spans is that of the empty string; repeated
rows are scanned each, equal ones alike; an empty table gives no rows; very long texts are scanned whole; other columns, whatever their names,
pass through the stage untouched. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm.common import bundled, picked, unbundled
from webstrata.sources.tables import materialise

KINDS = ["email", "ip", "card", "phone"]
#: Kinds in the order of results; the last is not one of the base's.
ALL_KINDS = [*KINDS, "secret"]
CHUNK = 256
# Possessive and anchored at the start of a run, or the end of the last match: the same matches as the plain
# patterns, in linear time and without recursion on very long runs.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't match; most texts end here.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9_%+-]++(?:\.[a-z0-9_%+-]++)*+ ?+(?:\[at\]|\(at\)|\{at\}) ?+[a-z0-9-]++(?:(?: ?(?:\.|\[dot\]|\(dot\)) ?)[a-z0-9-]++)++",
    "ip": r"(?i)(?<![0-9a-f:])[0-9a-f]{1,4}+(?::[0-9a-f]{1,4}+){7}(?![0-9a-f:])",
    "card": r"(?<![0-9.])[0-9]{4}(?:[\x20./_-]?[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:00[1-9][0-9]{0,2}[ /-]?|\(?[0-9]{3}\)?[ ./-])(?:[0-9]{2,4}[ ./-]){1,3}[0-9]{2,4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])(?:[0-9a-f]{16,}+|[0-9A-F]{16,}+|[A-Z0-9]{20,}+)(?![A-Za-z0-9])",
}
LOOSE_NEEDS = {
    "email": r"(?i)[\[({]at[\])}]", "ip": r"(?i)(?:[0-9a-f]{1,4}:){7}", "card": r"[0-9]{4}[\x20./_-]?[0-9]{4}", "phone": r"[0-9]{2}[ ./)-]{1,2}[0-9]{2}",
    "secret": r"[0-9a-f]{16}|[0-9A-F]{16}|[A-Z0-9]{20}",
}
#: Words that tell of a kind when they stand before a span.
CONTEXT = {
    "email": ["mail", "e-mail", "email", "contact", "write", "reach"], "ip": ["ip", "ipv6", "host", "address", "server", "addr"],
    "card": ["card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"],
    "phone": ["tel", "phone", "call", "fax", "mobile", "cell", "telefon", "téléphone", "teléfono"],
    "secret": ["password", "passwd", "pwd", "token", "secret", "key", "apikey", "bearer", "passwort", "contraseña"],
}
#: Beginnings or endings that real spans of a kind have.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$", "ip": r"^(?:[0-9a-fA-F]*[23][0-9a-fA-F]{3}:|(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.)",
    "card": r"^(?:4|5[1-5]|3[47]|6011|2[2-7])", "phone": r"^(?:00|\+[1-9]|\(?[2-9][0-9]{2}\)?)", "secret": r"^(?:AKIA|ASIA|AROA|AIDA)|^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$",
}
LABELERS = ["shape", "gazetteer", "context", "lonely"]
BEFORE = 24
ROUNDS = 50
ACCEPT = 0.9


def let(value: Column, use) -> Column:
    """Bind a value once."""
    return F.transform(F.array(value), use)[0]


def folded(items: Column, kind: str, zero: Column, state: str, step) -> Column:
    """array<kind>: what step(state, item) -> (array of new elements, next state) adds, item by item.

    Elements are appended to arrays of at most CHUNK items' worth, and these to one another: linear for all practical sizes,
    where appending to one array would copy it for each item."""
    return let(items, lambda bound: _folded(bound, kind, zero, state, step))


def _folded(items: Column, kind: str, zero: Column, state: str, step) -> Column:
    n = F.size(items)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    of = f"struct<out:array<{kind}>,state:{state}>"
    make = lambda out, s: F.struct(out.cast(f"array<{kind}>").alias("out"), s.cast(state).alias("state")).cast(of)

    def add(acc: Column, x: Column) -> Column:
        out, s = step(acc["state"], x)
        return let(make(out, s), lambda r: make(F.concat(acc["out"], r["out"]), r["state"]))

    def chunk(acc: Column, at: Column) -> Column:
        part = F.aggregate(F.slice(items, at, F.lit(CHUNK)), make(F.array(), acc["state"]), add)
        every = f"struct<out:array<array<{kind}>>,state:{state}>"
        return let(part, lambda p: F.struct(F.concat(acc["out"], F.array(p["out"])).alias("out"), p["state"].alias("state")).cast(every))

    start = F.struct(F.array().cast(f"array<array<{kind}>>").alias("out"), zero.cast(state).alias("state"))
    return F.aggregate(starts, start.cast(f"struct<out:array<array<{kind}>>,state:{state}>"), chunk, lambda acc: F.flatten(acc["out"]))


MATCH = "struct<s:int,e:int,m:string,before:string,after:string>"


def matches(text: Column, pattern: str, need: str, test=lambda m: F.lit(True)) -> Column:
    """array<MATCH> of the matches that pass, leftmost and non-overlapping, found from the gaps between all; before and after: up to
    BEFORE characters ahead, back to the start of the match before, and the next character.

    Only what passes is appended: texts can hold very many numbers that don't."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def items(both: Column) -> Column:
        return F.transform(both["found"], lambda m, i: F.struct(
            m.alias("m"), F.get(both["gaps"], i).alias("g"), F.coalesce(F.get(both["found"], i - 1), F.lit("")).alias("last"),
            F.substring(F.concat(F.get(both["gaps"], i + 1), F.coalesce(F.get(both["found"], i + 1), F.lit(""))), 1, 1).alias("after"),
        ))

    def step(at: Column, x: Column):
        s = at + F.length(x["g"])
        e = s + F.length(x["m"])
        before = F.substring(F.concat(x["last"], x["g"]), -BEFORE, BEFORE)
        one = F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), before.alias("before"), x["after"].alias("after")))
        return F.when(test(x["m"]), one).otherwise(F.array().cast(f"array<{MATCH}>")), e

    out = let(F.struct(gaps.alias("gaps"), found.alias("found")), lambda both: folded(items(both), MATCH, F.lit(0), "int", step))
    return F.when(text.rlike(need), out).otherwise(F.array().cast(f"array<{MATCH}>"))


def luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, digit sums added: a multiple of ten."""
    value = lambda d, i: F.when(i % 2 == 1, (d * 2) % 10 + F.floor(d * 2 / 10)).otherwise(d)
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: value(d.cast("int"), i).cast("int"))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z"))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


SPAN = "struct<kind:string,s:int,e:int,shape:string,votes:string>"


def described(k: str, x: Column) -> Column:
    """A match as SPAN: its shape for the classifier and the labelers' votes."""
    digits = F.regexp_replace(x["m"], "[^0-9]", "")
    told = F.lower(x["before"]).rlike(rf"(?:^|[^\p{{L}}])(?:{'|'.join(CONTEXT[k])})[^\p{{L}}]{{0,4}}(?:(?:is|at|us|no|number|nr|address)[^\p{{L}}]{{0,3}})?$")
    neighbours = F.concat(F.substring(x["before"], -1, 1), F.lit("|"), x["after"])
    form = {"card": F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False), "phone": F.length(digits).between(8, 15)}.get(k, F.lit(True))
    listed = x["m"].rlike(GAZETTEER[k])
    votes = [
        F.when(form, 1).otherwise(-1), F.when(listed, 1).otherwise(0 if k == "secret" else -1),
        F.when(told, 1).otherwise(0), F.when(neighbours.rlike(r"^[\s(\[<:,;=\"']?\|[\s)\]>.,;:!?\"']?$"), 0).otherwise(-1),
    ]
    shape = F.concat_ws("/", F.lit(k), F.least(F.length(digits), F.lit(20)).cast("string"), F.least(F.length(x["m"]), F.lit(40)).cast("string"))
    written = F.concat_ws(",", *(v.cast("string") for v in votes))
    return F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), shape.alias("shape"), written.alias("votes")).cast(SPAN)


def describe(k: str):
    return lambda x: described(k, x)


def strict_spans(text: Column) -> dict[str, Column]:
    test = lambda k: lambda m: passes(k, m)
    return {k: F.transform(matches(text, STRICT[k], NEEDS[k], test(k)), describe(k)) for k in KINDS}


def without_overlaps(loose: Column, taken: Column) -> Column:
    """The loose spans that no taken one overlaps: one pass forward with the furthest end so far, one back with the next start."""
    mark = lambda own: lambda x: F.struct(x["s"].alias("s"), F.lit(own).alias("own"), x["e"].alias("e"), x.cast(SPAN).alias("x"))
    item = f"struct<s:int,own:boolean,e:int,x:{SPAN}>"
    none = F.array().cast(f"array<{item}>")

    def ahead(end: Column, i: Column):
        return F.when(i["own"] & (i["s"] < end), none).otherwise(F.array(i)), F.when(i["own"], end).otherwise(F.greatest(end, i["e"]))

    def back(start: Column, i: Column):
        return F.when(i["own"] & (i["e"] <= start), F.array(i["x"])).otherwise(F.array().cast(f"array<{SPAN}>")), F.when(i["own"], start).otherwise(i["s"])

    every = F.array_sort(F.concat(F.transform(taken, mark(False)), F.transform(loose, mark(True)))).cast(f"array<{item}>")
    free = folded(F.reverse(folded(every, item, F.lit(-1), "int", ahead)), SPAN, F.lit(2**31 - 1), "int", back)
    return F.when((F.size(loose) == 0) | (F.size(taken) == 0), loose).otherwise(F.reverse(free))


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns with `strict` (per kind arrays of spans) and `loose` candidates; the text is left behind unless kept."""
    rows = picked(docs, *dict.fromkeys([*keep, "text"])).withColumn("_t", F.coalesce("text", F.lit("")))
    strict = strict_spans(F.col("_t"))
    rows = rows.select("*", F.struct(*(v.alias(k) for k, v in strict.items())).alias("strict"))
    taken = F.concat(*(F.col(f"strict.{k}") for k in KINDS))
    loose = F.concat(*(F.transform(matches(F.col("_t"), LOOSE[k], LOOSE_NEEDS[k]), describe(k)) for k in ALL_KINDS))
    anything = F.col("_t").rlike("|".join(f"(?:{n})" for n in LOOSE_NEEDS.values()))
    free = let(loose, lambda x: without_overlaps(x, taken))
    return rows.select(*keep, "strict", F.when(anything, free).otherwise(F.array().cast(f"array<{SPAN}>")).alias("loose"))


def estimated(patterns: dict[tuple[int, ...], float], rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], list[tuple[float, float]]]:
    """Posterior of each vote pattern and (sensitivity, specificity) of each labeler, by expectation-maximisation.

    Labelers are taken as independent given the truth; an abstention says nothing. Smoothed by two pseudo-counts."""
    n = len(next(iter(patterns), ()))
    rates, prior = [(0.8, 0.8)] * n, 0.5
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for p in patterns:
            yes, no = math.log(prior), math.log(1 - prior)
            for v, (sens, spec) in zip(p, rates, strict=True):
                if v:
                    yes += math.log(sens if v > 0 else 1 - sens)
                    no += math.log(1 - spec if v > 0 else spec)
            post[p] = 1 / (1 + math.exp(min(700, no - yes)))
        total = sum(patterns.values())
        prior = min(0.95, max(0.05, (sum(post[p] * c for p, c in patterns.items()) + 1) / (total + 2)))
        new = []
        for k in range(n):
            hit = sum(post[p] * c for p, c in patterns.items() if p[k] > 0)
            voted = sum(post[p] * c for p, c in patterns.items() if p[k])
            miss = sum((1 - post[p]) * c for p, c in patterns.items() if p[k] < 0)
            against = sum((1 - post[p]) * c for p, c in patterns.items() if p[k])
            new.append((min(0.99, max(0.5, (hit + 1.6) / (voted + 2))), min(0.99, max(0.5, (miss + 1.6) / (against + 2)))))
        rates = new
    return post, rates


def trained(rows: list[tuple[str, tuple[int, ...], float]], post: dict[tuple[int, ...], float], steps: int = 300) -> dict[tuple[str, tuple[int, ...]], float]:
    """Probability of each (shape, votes): logistic regression on their features with the posteriors as soft labels."""
    def features(shape: str, votes: tuple[int, ...]) -> list[str]:
        kind, digits, length = shape.split("/")
        return ["bias", f"k:{kind}", f"d:{kind}:{digits}", f"l:{kind}:{int(length) // 4}", *(f"v:{k}:{v}" for k, v in enumerate(votes))]

    weights: dict[str, float] = {}
    data = [(features(s, v), post[v], c) for s, v, c in rows]
    total = sum(c for *_, c in data) or 1
    score = lambda fs: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(f, 0.0) for f in fs)))))
    for _ in range(steps):
        slope: dict[str, float] = {}
        for fs, y, c in data:
            g = (score(fs) - y) * c / total
            for f in fs:
                slope[f] = slope.get(f, 0.0) + g
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) * 0.9995 - 2.0 * g
    return {(s, v): score(features(s, v)) for s, v, _ in rows}


def classifier(rows: DataFrame) -> Column:
    """From scanned rows: the array of all `shape|votes` that the trained classifier accepts.

    Distinct (shape, votes) are bounded: 5 kinds, 21 digit counts, 41 lengths and 3 ** 4 vote patterns at most."""
    every = F.concat(*(F.col(f"strict.{k}") for k in KINDS), F.col("loose"))
    counts = rows.select(F.explode(every).alias("x")).groupBy("x.shape", "x.votes").agg(F.count("*").alias("c")).collect()
    data = [(r["shape"], tuple(map(int, r["votes"].split(","))), float(r["c"])) for r in counts]
    by_votes: dict[tuple[int, ...], float] = {}
    for _, v, c in data:
        by_votes[v] = by_votes.get(v, 0.0) + c
    post, _ = estimated(by_votes)
    good = sorted(f"{s}|{','.join(map(str, v))}" for (s, v), p in trained(data, post).items() if p >= ACCEPT)
    return F.array(*map(F.lit, good)) if good else F.array().cast("array<string>")


def decided(rows: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """scanned rows with `base` and `spans`: array<struct<k, s, e>> by kind as listed, then start. Added ones don't overlap."""
    accepted = classifier(rows if learn_from is None else learn_from)
    order = {k: i for i, k in enumerate(ALL_KINDS)}
    kind = "struct<k:int,s:int,e:int>"
    numbered = lambda k: lambda x: F.struct(F.lit(order[k]).alias("k"), x["s"].alias("s"), x["e"].alias("e"))
    base = F.concat(*(F.transform(F.col(f"strict.{k}"), numbered(k)) for k in KINDS)).cast(f"array<{kind}>")
    number = F.create_map(*(F.lit(v) for kv in order.items() for v in kv))
    taken = F.filter("loose", lambda x: F.array_contains(accepted, F.concat(x["shape"], F.lit("|"), x["votes"])))
    candidates = F.array_sort(F.transform(taken, lambda x: F.struct(x["s"].alias("s"), number[x["kind"]].alias("k"), x["e"].alias("e"))))

    def step(at: Column, x: Column):
        late = x["s"] >= at
        one = F.array(F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")).cast(kind))
        return F.when(late, one).otherwise(F.array().cast(f"array<{kind}>")), F.when(late, x["e"]).otherwise(at)

    added = F.when(F.size("loose") > 0, folded(candidates, kind, F.lit(0), "int", step)).otherwise(F.array().cast(f"array<{kind}>"))
    return rows.withColumn("base", base).withColumn("spans", F.array_sort(F.concat(F.col("base"), added)))


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Texts are scanned once; the spans found, few for most documents, are kept for training and for the result. spans has those of the
    four listed kinds, secrets those beside them; n_added counts both kinds of additions, n_found all spans."""
    rows = decided(materialise(scanned(docs, ["doc_id"]), "pii"))
    listed, secret = F.filter("spans", lambda x: x["k"] < len(KINDS)), F.filter("spans", lambda x: x["k"] >= len(KINDS))
    return rows.select(
        "doc_id", *(F.size(f"strict.{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(listed).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"), written(secret).alias("secrets"), F.size("spans").cast("long").alias("n_found"),
    )


#: Characters of the pieces that a text is cut into, so that taking a part of it doesn't count through all of it.
PIECE = 1000


def redacted(text: Column, spans: Column) -> Column:
    """Text with each span replaced by its kind's mark; of overlapping spans the first by start is marked whole."""
    marks = F.array(*(F.lit(f"<{k.upper()}>") for k in ALL_KINDS))
    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k"))))
    cut = "struct<a:int,b:int,mark:string>"

    def step(at: Column, x: Column):
        end = -x["e"]
        one = F.struct(at.alias("a"), F.greatest(x["s"], at).alias("b"), F.when(x["s"] < at, "").otherwise(F.get(marks, x["k"])).alias("mark")).cast(cut)
        return F.when(end <= at, F.array().cast(f"array<{cut}>")).otherwise(F.array(one)), F.greatest(at, end)

    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))

    def part(p: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        some = F.slice(p, first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1)
        return F.when(b > a, F.substring(F.array_join(some, ""), a - first * PIECE + 1, b - a)).otherwise("")

    def joined(v: Column) -> Column:
        end = F.array_max(F.transform(spans, lambda x: x["e"]))
        kept = F.transform(v["cuts"], lambda c: F.concat(part(v["pieces"], c["a"], c["b"]), c["mark"]))
        return F.concat(F.array_join(kept, ""), F.substring(text, end + 1, F.length(text)))

    done = let(F.struct(folded(by_start, cut, F.lit(0), "int", step).alias("cuts"), pieces.alias("pieces")), joined)
    return F.when(F.size(spans) > 0, done).otherwise(text)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and secrets replaced by marks, n_chars counted anew. The classifier learns in a first scan."""
    every = F.concat(*(F.col(f"strict.{k}") for k in KINDS), F.col("loose"))
    learn_from = materialise(scanned(docs, []).where(F.size(every) > 0), "pii")
    source = bundled(docs)
    rows = decided(scanned(source, source.columns), learn_from)
    out = rows.withColumn("text", redacted(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return unbundled(out, docs)
