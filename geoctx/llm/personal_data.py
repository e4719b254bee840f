"""Personal data by weak supervision, in DataFrame functions only.

Patterns, gazetteers and context words vote on candidate spans; expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is; a span classifier is then trained on the resulting soft labels
and decides about the candidates that the strict patterns do not cover. Strict spans always stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoctx.catalog.base import Catalog
from geoctx.llm.common import documents
from geoctx.session import cut_lineage

CATALOG = Catalog()

# The strict patterns, in the order of the kinds. Repeated groups are possessive, as nothing follows them:
# the same matches, and Java's regex does not recurse once per repetition, which overflows its stack in long texts.
KINDS = ("email", "ip", "card", "phone")
STRICT = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider patterns: the same kinds as people write them to escape a scan, or without a leading plus sign.
WIDE = {
    "email": r"[A-Za-z0-9._%+-]++ ?(\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "ip": r"[0-9]{1,3}(\[\.\][0-9]{1,3}){3}",
    "card": r"[0-9]{4}([._/][0-9]{4}){3}",
    "phone": r"(\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|00[1-9][0-9() .-]{7,15}[0-9]",
}
#: Leftmost matches of these kinds begin where a run of their first characters or the search does; told so, the regex does
#: not try a long run again from each of its characters.
BEGINS = {("email", True): r"(?:(?<![A-Za-z0-9._%+-])|\G)", ("email", False): r"(?:(?<![A-Za-z0-9._%+-])|\G)", ("ip", True): r"(?:(?<![0-9])|\G)"}
#: What every match of the kind holds; a cheap test before the pattern. Strict cards: the 14 digits that the rule asks for.
NEEDS = {("email", True): "@", ("email", False): "at", ("ip", True): ".", ("ip", False): "[.]", ("phone", True): "+"}
NEEDS_LIKE = {("card", True): "[0-9](?:[ -]?[0-9]){13}", ("card", False): "[0-9]{4}", ("phone", False): "[0-9]{3}[ .-][0-9]{4}|00[1-9]"}
TOP_DOMAINS = "com org net edu gov io info biz de fr es uk it eu ch at us ca example".split()
CUES = {
    "email": "mail email e-mail contact reach write", "ip": "ip address host server client from login",
    "card": "card visa mastercard credit payment pay", "phone": "phone tel telephone call mobile fax cell",
}
COUNTER_CUES = "version isbn issn id order invoice price section page token hash serial part no"
#: Characters before and after a span that the context labelers look at.
CONTEXT = 40
LABELERS = ("strict", "valid", "gazetteer", "context", "edges")
#: Probability from which a wide candidate counts as personal data.
ACCEPT = 0.9


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a digit string is divisible by 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.coalesce(d.try_cast("int"), F.lit(0)) + 1)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _octets_fit(text: Column) -> Column:
    """Whether all four parts are at most 255, leading zeros aside."""
    parts = F.split(F.regexp_replace(text, r"[\[\]]", ""), r"\.")
    short = F.transform(parts, lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (p.try_cast("int") <= 255))


def _holds(kind: str, text: Column) -> Column:
    """The strict rule of a kind for a match of its strict pattern."""
    n = F.length(_digits(text))
    return {"email": F.lit(True), "ip": _octets_fit(text), "card": (n >= 14) & (n <= 19) & _luhn(_digits(text)), "phone": (n >= 10) & (n <= 15)}[kind]


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, kind, strict, start, stop, match, before, after``: all matches of all patterns.

    Positions count code points, ``stop`` is exclusive. Matches of a pattern are leftmost and do not overlap;
    strict matches that fail their kind's rule are left out without a retry. ``fp`` is the hash of the text;
    equal spans of rows equal in id and text are one row.
    """
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    base = base.select("doc_id", F.xxhash64("text").alias("fp"), "text", F.monotonically_increasing_id().alias("row"))
    none = F.array().cast("array<struct<kind:string,strict:boolean,n:int,gap:int,match:string,before:string,after:string>>")
    found = []
    for strict, patterns in ((True, STRICT), (False, WIDE)):
        for kind in KINDS:
            pattern = BEGINS.get((kind, strict), "") + patterns[kind]
            matches, gaps = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
            zipped = F.arrays_zip(matches.alias("m"), F.slice(gaps, F.lit(1), F.size(matches)).alias("g"), F.slice(gaps, F.lit(2), F.size(matches)).alias("h"))
            found.append(F.when(F.contains(F.col("text"), F.lit(NEEDS[kind, strict])) if (kind, strict) in NEEDS else F.col("text").rlike(NEEDS_LIKE[kind, strict]), F.transform(zipped, _piece(kind, strict))).otherwise(none))
    rows = base.select("doc_id", "fp", "row", F.explode(F.flatten(F.array(*found))).alias("c")).select("doc_id", "fp", "row", "c.*")
    order = Window.partitionBy("row", "kind", "strict").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("stop", F.sum(F.col("gap") + F.length("match")).over(order).cast("int"))
    placed = placed.select("doc_id", "fp", "kind", "strict", (F.col("stop") - F.length("match")).alias("start"), "stop", "match", "before", "after")
    holds = F.coalesce(*[F.when(F.col("kind") == k, _holds(k, F.col("match"))) for k in KINDS])
    return placed.where(~F.col("strict") | holds).dropDuplicates(["doc_id", "fp", "kind", "strict", "start"])


def _piece(kind: str, strict: bool):
    def piece(x: Column, i: Column) -> Column:
        gap, rest = F.coalesce(x["g"], F.lit("")), F.coalesce(x["h"], F.lit(""))
        return F.struct(F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), i.cast("int").alias("n"), F.length(gap).cast("int").alias("gap"), x["m"].alias("match"), F.lower(F.right(gap, F.lit(CONTEXT))).alias("before"), F.lower(F.left(rest, F.lit(CONTEXT))).alias("after"))

    return piece


def _words_in(text: Column, words: str | list[str]) -> Column:
    listed = "|".join(words.split() if isinstance(words, str) else words)
    return text.rlike(rf"(^|[^a-z])({listed})([^a-z]|$)")


def votes(spans: DataFrame) -> DataFrame:
    """One column per labeler: 1 for personal data, 0 against, -1 for no opinion."""
    kind, match, digits = F.col("kind"), F.col("match"), _digits(F.col("match"))
    n, by = F.length(digits), lambda d: F.coalesce(*[F.when(kind == k, v) for k, v in d.items()])
    yes = lambda c: F.when(c, 1).otherwise(0)
    domain = F.lower(F.element_at(F.split(match, r"(\.|\(dot\)|\[dot\]) ?"), -1))
    return spans.select(
        "*", yes(F.col("strict")).alias("v_strict"),
        by({"email": yes(match.rlike(r"[A-Za-z0-9]")), "ip": yes(_octets_fit(match) & ~match.rlike(r"(^|[.\]])0[0-9]")), "card": yes((n >= 14) & (n <= 19) & _luhn(digits)), "phone": yes((n >= 10) & (n <= 13))}).alias("v_valid"),
        by({"email": yes(domain.isin(TOP_DOMAINS)), "ip": F.when(match.rlike(r"^0|^255"), 0).otherwise(-1), "card": yes(digits.rlike("^(3[47]|4|5[1-5]|2[2-7]|6)")), "phone": F.when(digits.rlike("^(1|33|34|39|41|43|44|49|00)"), 1).otherwise(-1)}).alias("v_gazetteer"),
        F.when(by({k: _words_in(F.col("before"), w) for k, w in CUES.items()}), 1).when(_words_in(F.col("before"), COUNTER_CUES) & (kind != "email"), 0).otherwise(-1).alias("v_context"),
        yes(~F.col("before").rlike("[a-z0-9]$") & ~F.col("after").rlike("^[a-z0-9]")).alias("v_edges"),
    )


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern by expectation-maximisation over ``(votes, count)``; votes of -1 abstain.

    Labelers are independent given the truth. Counts are smoothed, and a start at 0.8 right fixes which side is
    which. No patterns give an empty result.
    """
    width = len(patterns[0][0]) if patterns else 0
    prior, right = 0.5, [[0.8, 0.8] for _ in range(width)]  # P(vote 1 | yes), P(vote 0 | no)

    def posterior(v: tuple[int, ...]) -> float:
        a, b = math.log(prior), math.log(1 - prior)
        for j, x in enumerate(v):
            if x >= 0:
                a += math.log(right[j][0] if x == 1 else 1 - right[j][0])
                b += math.log(right[j][1] if x == 0 else 1 - right[j][1])
        return 1 / (1 + math.exp(min(max(b - a, -500), 500)))

    for _ in range(rounds):
        soft = [(v, n, posterior(v)) for v, n in patterns]
        total, good = sum(n for _, n, _ in soft), sum(n * p for _, n, p in soft)
        prior = min(max((good + 1) / (total + 2), 1e-6), 1 - 1e-6) if total else prior
        for j in range(width):
            yes = sum(n * p for v, n, p in soft if v[j] >= 0)
            no = sum(n * (1 - p) for v, n, p in soft if v[j] >= 0)
            right[j] = [(sum(n * p for v, n, p in soft if v[j] == 1) + 4) / (yes + 5), (sum(n * (1 - p) for v, n, p in soft if v[j] == 0) + 4) / (no + 5)]
    return {v: posterior(v) for v, _ in patterns}


def _span_features() -> list[tuple[str, Column]]:
    """Categorical features of the final classifier: the votes and the look of the span."""
    digits = F.length(_digits(F.col("match")))
    return [
        *[(f"v_{x}", F.col(f"v_{x}").cast("string")) for x in LABELERS],
        ("digits", F.least(digits, F.lit(20)).cast("string")),
        ("length", F.least((F.length("match") / 4).cast("int"), F.lit(12)).cast("string")),
        ("left", F.when(F.col("before") == "", "edge").when(F.col("before").rlike("[a-z0-9]$"), "word").when(F.col("before").rlike(r"\s$"), "blank").otherwise("mark")),
        ("right", F.when(F.col("after") == "", "edge").when(F.col("after").rlike("^[a-z0-9]"), "word").when(F.col("after").rlike(r"^\s"), "blank").otherwise("mark")),
    ]


def classify(voted: DataFrame) -> DataFrame:
    """``voted`` with ``p``: the probability of a span classifier trained on the labelers' soft labels.

    Naive Bayes on kind and categorical features, from sums of posteriors over all candidates. Only counts of
    vote patterns (at most 4 kinds x 3^5) and of feature values (below 1,000) reach the driver.
    """
    names = [f"v_{x}" for x in LABELERS]
    by_kind: dict[str, list] = {}
    for r in voted.groupBy("kind", *names).count().collect():
        by_kind.setdefault(r.kind, []).append((tuple(r[c] for c in names), r["count"]))
    soft = {(k, *v): p for k, patterns in by_kind.items() for v, p in reliabilities(patterns).items()}
    if not soft:
        return voted.withColumn("p", F.lit(0.0))
    key = F.concat_ws(":", "kind", *[F.col(c).cast("string") for c in names])
    table = F.create_map(*[F.lit(x) for k, p in soft.items() for x in (":".join(map(str, k)), p)])
    features = _span_features()
    named = F.array(*[F.concat(F.lit(f"{n}="), c) for n, c in features])
    labelled = voted.withColumn("_soft", table[key]).withColumn("_features", named)
    sums = labelled.select("kind", "_soft", F.explode(F.concat(F.array(F.lit("all")), "_features")).alias("f")).groupBy("kind", "f").agg(F.sum("_soft").alias("yes"), F.sum(1 - F.col("_soft")).alias("no")).collect()
    total = {r.kind: (r.yes, r.no) for r in sums if r.f == "all"}
    weights = {f"{k}:": math.log((yes + 1) / (no + 1)) for k, (yes, no) in total.items()}
    weights |= {f"{r.kind}:{r.f}": math.log((r.yes + 0.5) / (total[r.kind][0] + 5)) - math.log((r.no + 0.5) / (total[r.kind][1] + 5)) for r in sums if r.f != "all"}
    lookup = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    logit = F.aggregate(F.transform("_features", lambda f: F.coalesce(lookup[F.concat("kind", F.lit(":"), f)], F.lit(0.0))), lookup[F.concat("kind", F.lit(":"))], lambda a, x: a + x)
    return labelled.withColumn("p", 1 / (1 + F.exp(-logit))).drop("_soft", "_features")


def personal_spans(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``doc_id, fp, kind, start, stop, match, strict, p``: strict spans, and wide ones the classifier accepts.

    A wide span that overlaps a strict one of the same kind adds nothing and is left out.
    """
    scored = cut_lineage(classify(votes(cut_lineage(candidates(docs)))))
    strict = scored.where("strict")
    wide = scored.where(~F.col("strict") & (F.col("p") >= accept))
    taken = strict.select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), F.col("kind").alias("_kind"), F.col("start").alias("_start"), F.col("stop").alias("_stop"))
    free = wide.join(taken, F.expr("fp = _fp AND doc_id <=> _id AND kind = _kind AND start < _stop AND _start < stop"), "left_anti")
    return strict.unionByName(free).select("doc_id", "fp", "kind", "start", "stop", "match", "strict", "p")


def personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base, spans`` for every row of ``docs (doc_id, text, ...)``.

    ``base`` lists the strict spans as kind:start:stop by start, then kind; ``spans`` all of them. NULL and empty
    texts have none. Rows that repeat id and text have the same spans each; NULL ids keep their rows; an empty
    table gives no rows; other columns are not looked at.
    """
    spans = personal_spans(docs, accept)
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)])
    listed = spans.groupBy(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")).agg(
        F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "stop", "kind", "strict"))).alias("all"),
        *[F.sum(F.when(F.col("strict") & (F.col("kind") == k), 1).otherwise(0)).alias(f"n_{k}") for k in KINDS],
    )
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    listed = listed.select("_id", "_fp", *[f"n_{k}" for k in KINDS], line(F.filter("all", lambda s: s["strict"])).alias("base"), line(F.col("all")).alias("spans"))
    every = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("fp"))
    joined = every.join(listed, F.expr("fp = _fp AND doc_id <=> _id"), "left")
    return joined.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"))


@CATALOG.add("op7_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
