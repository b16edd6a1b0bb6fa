"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidate spans come from patterns. Three labelers vote (-1, 0, 1) on each: a format rule, a gazetteer, and the words
before it. Expectation-maximisation over the counted vote patterns estimates how reliable each labeler is for each kind,
and its posteriors train the final span classifier (naive Bayes over votes and shape features). Spans of the contract's
base kinds always stay; the classifier decides on the others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm.common import stored, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "name")
ROUNDS = 6
LEAST = 0.9
CONTEXT = 40
STEP = 512

# The contract's patterns, in forms that take one pass. A run that can't match from its first character
# is not tried again from each later one (lookbehind, or the end of the last match), and loops never give back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    # The first word of every pair in a run of capitalised words; the second is only looked at, as it may begin the next pair.
    "name": r"(?<![\p{L}\p{M}])\p{Lu}\p{M}*+\p{Ll}[\p{Ll}\p{M}]*+(?!\p{L})(?=\x20(\p{Lu}\p{M}*+\p{Ll}[\p{Ll}\p{M}]*+(?!\p{L})))",
}
#: Texts without a match of these hold no candidate of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "ssn": "-[0-9]{2}-", "iban": "[A-Z]{2}[0-9]{2}", "name": r"[\p{Ll}\p{M}]\x20\p{Lu}"}
# Gazetteers and context words.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "it", "uk", "eu", "info", "biz", "us", "ca", "ch", "at", "nl", "be")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91")
GIVEN_NAMES = ("James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "David", "Elizabeth", "William", "Barbara", "Richard", "Susan", "Joseph", "Jessica", "Thomas", "Sarah", "Charles", "Karen", "Anna", "Maria", "Peter", "Hans", "Klaus", "Sabine", "Jean", "Pierre", "Marie", "Juan", "Carlos", "Carmen", "Luis", "Ana", "Paul", "Laura", "Daniel", "Emma", "Sophie", "Lucas")
TITLES = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora?)\.?\s*$"
NEAR = {
    "email": r"(?i)(?:mail|contact|write to|reach)",
    "ip": r"(?i)(?:\bip\b|host|server|address|client|login)",
    "card": r"(?i)(?:card|visa|master|credit|payment|paid)",
    "phone": r"(?i)(?:phone|\btel|call|mobile|cell|fax)",
    "ssn": r"(?i)(?:ssn|social|security)",
    "iban": r"(?i)(?:iban|account|bank|konto|transfer)",
    "name": r"(?:name is|called|signed|[Dd]ear|[Ff]rom|[Rr]egards|by)\W*$",
}
AGAINST = r"(?i)(?:version|\bv\.?|isbn|order|invoice|serial|section|figure|example)\W*$"


def once(value: Column, use) -> Column:
    """use(value), with the value computed once: a lambda computes whatever it names anew for each element, but not its own element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column) -> Column:
    """Running sums of an array of numbers: in steps, so that a long array costs little more than its length."""
    zero = F.lit(0).cast("long")

    def sums(xs: Column, start: Column) -> Column:
        first = F.struct(start.alias("sum"), F.array().cast("array<long>").alias("all"))
        return F.aggregate(xs, first, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"] + x)).alias("all")))["all"]

    def in_steps(v: Column) -> Column:
        total = lambda xs: F.aggregate(xs, zero, lambda a, x: a + x)
        starts = F.sequence(F.lit(1), F.size(v), F.lit(STEP))
        own = lambda s: F.slice(v, s, STEP)
        return once(sums(F.transform(starts, lambda s: total(own(s))), zero), lambda ends: F.flatten(F.transform(starts, lambda s, k: sums(own(s), F.when(k == 0, zero).otherwise(F.get(ends, k - 1))))))

    return once(values, lambda v: F.when(F.size(v) <= STEP, sums(v, zero)).otherwise(in_steps(v)))


def luhn(digits: Column) -> Column:
    one = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(one, F.lit(0), lambda a, x: a + x) % 10 == 0


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def valid(kind: str, s: Column) -> Column:
    """The format rule of each kind; for the base kinds it is the contract's."""
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.length(digits_of(s)).between(14, 19) & luhn(digits_of(s))
    if kind == "phone":
        return F.length(digits_of(s)).between(10, 15)
    if kind == "ssn":
        return ~s.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "iban":
        return F.length(F.regexp_replace(s, " ", "")).between(15, 34)
    return F.lit(True)


def listed(kind: str, s: Column) -> Column:
    """The gazetteer's vote."""
    if kind == "email":
        yes = F.lower(F.substring_index(s, ".", -1)).isin(*TOP_DOMAINS)
    elif kind == "phone":
        yes = F.regexp_extract(s, r"^\+([0-9]+)", 1).rlike("^(?:" + "|".join(CALLING_CODES) + ")")
    elif kind == "card":
        yes = s.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)")
    elif kind == "ip":
        yes = ~s.rlike(r"^(?:0|127|255)\.")
    elif kind == "name":
        return F.when(F.substring_index(s, " ", 1).isin(*GIVEN_NAMES), 1).otherwise(-1)
    elif kind == "iban":
        yes = s.rlike("^(?:DE|FR|ES|IT|GB|NL|BE|AT|CH|PT|IE|PL|SE|DK|NO|FI)")
    else:
        yes = F.lit(None).cast("boolean")
    return F.when(yes, 1).when(~yes, -1).otherwise(0)


SPAN = "struct<start:long,no:int,end:long,base:boolean,v1:int,v2:int,v3:int,f1:int,f2:int,f3:int>"


def candidates(text: Column, kind: str) -> Column:
    """All leftmost, non-overlapping matches of a kind in the text that can count, with votes and features; for names all pairs of words.

    What stands before and after a match comes from the pieces between the matches, never from the whole text again: the work
    grows with the text, however many matches it holds. Context reaches back over one match at most.
    """
    no, pattern = KINDS.index(kind), PATTERNS[kind]
    base = kind in BASE
    found = [F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")]
    if kind == "name":
        found.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("seconds"))

    def zipped(f: Column) -> Column:
        gaps, hits = f["gaps"], f["hits"]
        ends = running(F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("g"), hits.alias("h")), lambda x: (F.length(x["g"]) + F.length(x["h"])).cast("long")))
        cols = [hits.alias("s"), ends.alias("end"), F.slice(gaps, 1, F.size(hits)).alias("gap"), F.concat(F.array(F.lit("")), hits).alias("last"), F.transform(F.slice(gaps, 2, F.size(hits)), lambda g: F.left(g, F.lit(1))).alias("next")]
        if kind == "name":
            cols.append(f["seconds"].alias("second"))
        return F.slice(F.arrays_zip(*cols), 1, F.size(hits))  # `last` is one longer

    def placed(x: Column) -> Column:
        before = F.right(F.when(F.length(x["gap"]) < CONTEXT, F.concat(F.right(x["last"], F.lit(CONTEXT)), x["gap"])).otherwise(x["gap"]), F.lit(CONTEXT))
        more = (F.concat(F.lit(" "), x["second"]), F.lit("")) if kind == "name" else (F.lit(""), x["next"])
        return F.struct(F.concat(x["s"], more[0]).alias("s"), (x["end"] - F.length(x["s"])).alias("start"), (x["end"] + F.length(more[0])).alias("end"), before.alias("before"), more[1].alias("after"))

    spans = F.transform(once(F.struct(*found), zipped), placed)
    spans = F.filter(spans, lambda x: valid(kind, x["s"])) if base else spans

    def voted(x: Column) -> Column:
        before, after = x["before"], x["after"]
        near = before.rlike(NEAR[kind]) | (before.rlike(TITLES) if kind == "name" else F.lit(False))
        votes = (F.when(valid(kind, x["s"]), 1).otherwise(-1), listed(kind, x["s"]), F.when(near, 1).when(before.rlike(AGAINST), -1).otherwise(0))
        shape = (F.least(F.floor(F.length(x["s"]) / 5), F.lit(8)), F.when(before.rlike(r"\s$"), 0).when(before == "", 1).when(before.rlike("[A-Za-z0-9]$"), 2).otherwise(3), F.when(after.rlike(r"\s"), 0).when(after == "", 1).when(after.rlike("[A-Za-z0-9]"), 2).otherwise(3))
        cols = [v.cast("int") for v in (*votes, *shape)]
        names = ("v1", "v2", "v3", "f1", "f2", "f3")
        return F.struct(x["start"].alias("start"), F.lit(no).alias("no"), x["end"].alias("end"), F.lit(base).alias("base"), *(c.alias(n) for c, n in zip(cols, names, strict=True)))

    return F.when(text.rlike(NEEDS[kind]), F.transform(spans, voted)).otherwise(F.array().cast(f"array<{SPAN}>"))


def spans_of(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every candidate of every whole text, sorted by start and kind."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", *(candidates(F.col("text"), k).alias(k) for k in KINDS))
    return rows.select("doc_id", F.array_sort(F.concat(*KINDS)).alias("spans"))


VOTES, SHAPE = ("v1", "v2", "v3"), ("f1", "f2", "f3")


def _ratios(weighted: DataFrame, cols: tuple[str, ...]) -> dict[str, float]:
    """Log odds of each value of each column, by kind: "no:column:value" -> log P(value | personal) - log P(value | not).

    weighted: counted patterns with y, the chance of being personal. The result has a row for each kind, column and value.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in cols)))
    sums = weighted.select("no", "n", "y", pairs.alias("p")).groupBy("no", "p.c", "p.v").agg(F.sum(F.col("n") * F.col("y")).alias("yes"), F.sum(F.col("n") * (1 - F.col("y"))).alias("not")).collect()
    total: dict[tuple, list[float]] = {}
    for r in sums:
        t = total.setdefault((r.no, r.c), [0.0, 0.0])
        t[0] += r["yes"] + 1
        t[1] += r["not"] + 1
    out = {f"{r.no}:{r.c}:{r.v}": math.log((r["yes"] + 1) / total[r.no, r.c][0]) - math.log((r["not"] + 1) / total[r.no, r.c][1]) for r in sums}
    for (no, c), (yes, no_) in total.items():
        if c == cols[0]:
            out[f"{no}:prior"] = math.log(yes / no_)
    return out


def _score(ratios: dict[str, float], cols: tuple[str, ...], span: Column | None = None) -> Column:
    """Chance of being personal, from log odds; a value never met counts 0."""
    at = (lambda c: span[c]) if span is not None else F.col
    known = F.create_map(*(F.lit(x) for kv in ratios.items() for x in kv)) if ratios else F.create_map(F.lit(""), F.lit(0.0))
    part = lambda key: F.coalesce(F.element_at(known, key), F.lit(0.0))
    odds = part(F.concat(at("no").cast("string"), F.lit(":prior")))
    for c in cols:
        odds = odds + part(F.concat(at("no").cast("string"), F.lit(f":{c}:"), at(c).cast("string")))
    return 1 / (1 + F.exp(-odds))


def train(spans: DataFrame, rounds: int = ROUNDS) -> dict[str, float]:
    """The span classifier's log odds, from all candidates. Votes and shapes are counted once; the rounds work on the counts."""
    counted = stored(spans.select(F.explode("spans").alias("s")).select("s.no", *(f"s.{c}" for c in (*VOTES, *SHAPE))).groupBy("no", *VOTES, *SHAPE).agg(F.count("*").alias("n")), "pii-votes")
    y = 1 / (1 + F.exp(-2 * (F.col("v1") + F.col("v2") + F.col("v3")) + 1))
    for _ in range(rounds):
        y = _score(_ratios(counted.withColumn("y", y), VOTES), VOTES)
    return _ratios(counted.withColumn("y", y), (*VOTES, *SHAPE))


def apart(spans: Column, score) -> Column:
    """Spans of which no two overlap: from left to right, of two that do the likelier, and of equals the first. spans: sorted by start."""
    none = F.array().cast(f"array<{SPAN}>")
    begin = F.struct(none.alias("all"), F.lit(None).cast(SPAN).alias("open"), F.lit(0.0).alias("score"))

    def step(a: Column, x: Column) -> Column:
        free = a["open"].isNull() | (a["open"]["end"] <= x["start"])
        better = free | (score(x) > a["score"])
        kept = F.when(free & a["open"].isNotNull(), F.concat(a["all"], F.array(a["open"]))).otherwise(a["all"])
        return F.struct(kept.alias("all"), F.when(better, x).otherwise(a["open"]).alias("open"), F.when(better, score(x)).otherwise(a["score"]).alias("score"))

    return F.aggregate(spans, begin, step, lambda a: F.when(a["open"].isNull(), a["all"]).otherwise(F.concat(a["all"], F.array(a["open"]))))


def clear_of(spans: Column, base: Column) -> Column:
    """The spans that overlap none of base (sorted by start): base is painted on a mask of the text, a byte a character, once for each kind."""
    out = spans
    for no in range(len(BASE)):
        mask = F.array_join(once(F.filter(base, _of_kind(no)), lambda own: F.transform(own, _painted(own))), "").cast("binary")
        out = once(F.struct(mask.alias("mask"), out.alias("spans")), lambda x: F.filter(x["spans"], lambda s: ~F.contains(F.substring(x["mask"], s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")), F.lit(b"1"))))
    return out


def _of_kind(no: int):
    return lambda s: s["no"] == no


def _painted(own: Column):
    """Spaces up to each span from the one before, and its length in ones."""
    return lambda s, i: F.concat(F.repeat(F.lit(" "), (s["start"] - F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(own, i - 1)["end"])).cast("int")), F.repeat(F.lit("1"), (s["end"] - s["start"]).cast("int")))


def scan(docs: DataFrame, least: float = LEAST, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of docs: counts of the base kinds, digest of the base spans, all spans, and n_more.

    A null or empty text has no spans (the digest is that of an empty string). Rows keep their doc_id, null or repeated;
    other columns are ignored. Spans of other kinds count from a chance of `least` on, if they overlap no base span; of names
    that overlap, the likelier.
    """
    spans = stored(spans_of(docs), "pii-spans")
    model = train(spans, rounds)
    likely = lambda s: _score(model, (*VOTES, *SHAPE), s)
    rows = spans.select("doc_id", F.filter("spans", lambda s: s["base"]).alias("b"), F.filter("spans", lambda s: ~s["base"] & (s["v1"] > 0) & (likely(s) >= least)).alias("m"))
    rows = stored(rows, "pii-likely")  # spans only, no texts
    rows = stored(rows.select("doc_id", "b", F.when((F.size("m") > 0) & (F.size("b") > 0), clear_of(F.col("m"), F.col("b"))).otherwise(F.col("m")).alias("m")), "pii-clear")
    name = KINDS.index("name")
    names = F.filter("m", lambda s: s["no"] == name)
    rows = rows.withColumn("m", F.when(F.size(names) > 1, F.concat(F.filter("m", lambda s: s["no"] != name), apart(names, likely))).otherwise(F.col("m")))
    names = F.array(*map(F.lit, KINDS))
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", F.get(names, s["no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter(F.transform("b", lambda s: s["no"]), lambda no: no == F.lit(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("b")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("b", "m"))).alias("spans"), F.size("m").cast("long").alias("n_more"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
