"""Personal data by weak supervision. Only DataFrame functions.

Candidate spans come from patterns. Three labelers vote on each: a regex
labeler (checksums and value ranges), a gazetteer labeler (known top-level
domains, country codes, issuer digits, secret names) and a context labeler
(cue words before the span, characters that touch it). One pass over the
corpus counts candidates by kind, votes and a few bounded features;
expectation-maximisation over that table estimates each labeler's reliability
per kind, and its posteriors train the final span classifier (naive Bayes over
the features). Spans that pass the base rules always stay; the classifier adds
others that touch no base span and fail no rule (a number whose checksum is
wrong is never admitted).

The table that reaches the driver has at most kinds x votes x features rows,
whatever the corpus is. Offsets are running sums over a document's pieces (a
window), linear in the number of matches.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Base patterns of the contract, with possessive repeats and anchors that keep the match and drop the backtracking.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Length of an IBAN by country: what follows a complete one ("EUR", the next word) is not part of it.
IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBANS = [rf"(?:{of.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, of in IBAN.items()]
_IBANS.append(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")  # other countries
#: Looser candidates that only the classifier can admit.
ADDED = {
    "secret": r"(?:(?<![A-Za-z0-9_])|\G)[A-Za-z0-9_]{2,}+ ?[=:] ?\"[A-Za-z0-9+/_=-]{16,}+\"",
    "iban": rf"(?<![A-Za-z0-9])(?:{'|'.join(_IBANS)})(?![A-Za-z0-9])",
    "local": r"(?<![0-9+(])\(?[0-9]{3}\)[ .-]?[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
KINDS = [*BASE, *ADDED]
_QUICK = {"email": "@", "phone": "+", "secret": '"', "local": ")"}  # without this character there is no match
#: Gazetteers and cue words (fixed values).
DOMAINS = ["com", "net", "org", "edu", "gov", "io", "de", "fr", "es", "uk", "it", "nl", "eu", "info"]
COUNTRY = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91"]
SECRETS = ["token", "key", "apikey", "api_key", "secret", "password", "passwd", "pwd", "auth", "bearer"]
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel", "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta", "phone": "phone|tel|call|mobile|fax|telefon",
    "secret": "secret|credential|login|config", "iban": "iban|account|konto|compte|cuenta", "local": "phone|tel|call|mobile|fax|telefon",
}
CONTEXT = 24  # code points before a span that the context labeler reads
VOTES = ("regex_vote", "gazetteer_vote", "context_vote")
FEATURES = ("f_length", "f_digits", "f_left", "f_right")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Luhn checksum of the digits of x, which has at most 19."""
    d = F.transform(F.split(F.reverse(_digits(x)), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(
        F.when(c.try_cast("int") > 4, c.try_cast("int") * 2 - 9).otherwise(c.try_cast("int") * 2)))
    return F.coalesce(F.aggregate(d, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0))) % 10 == 0, F.lit(False))


def _mod97(x: Column) -> Column:
    """Checksum of an IBAN: its first four characters moved to the end, letters as 10 to 35, leave 1 modulo 97."""
    plain = F.regexp_replace(x, " ", "")
    c = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    step = lambda s, v: F.when(v.rlike("[A-Z]"), (s * 100 + F.ascii(v) - 55) % 97).when(v == "", s).otherwise((s * 10 + F.coalesce(v.try_cast("int"), F.lit(0))) % 97)
    return F.coalesce(F.aggregate(c, F.lit(0), step) == 1, F.lit(False))


def valid(kind: str, x: Column) -> Column:
    """Does a match of a base pattern pass the contract's check?"""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":  # at most three digits once leading zeros are gone
        return F.forall(F.split(x, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False)))
    n = F.length(_digits(x))
    return n.between(9, 15) if kind == "phone" else F.when(n.between(13, 19), _luhn(x)).otherwise(False)


def _votes(kind: str, x: Column, left: Column, right: Column) -> dict[str, Column]:
    """Votes 1 (personal data), 0 (not) or -1 (abstain) of the three labelers."""
    rule = valid(kind, x) if kind in BASE else {"secret": x.rlike(r'"[^"]*[0-9]') & x.rlike(r"^[0-9_]*[A-Za-z]"), "iban": _mod97(x),
                                                "local": F.length(_digits(x)) == 10}[kind]
    d = _digits(x)
    lists = {
        "email": F.lower(F.regexp_extract(x, r"\.([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS),
        "ip": ~F.regexp_extract(x, "^[0-9]+", 0).isin("0", "127", "255"),
        "card": F.substring(d, 1, 1).isin("3", "4", "5", "6"),
        "phone": F.substring(d, 1, 1).isin(*COUNTRY) | F.substring(d, 1, 2).isin(*COUNTRY),
        "secret": F.arrays_overlap(F.split(F.lower(F.regexp_extract(x, "^[A-Za-z0-9_]+", 0)), "[0-9_]+"), F.array(*[F.lit(w) for w in SECRETS])),
        "iban": F.substring(x, 1, 2).isin("DE", "FR", "ES", "GB", "IT", "NL", "BE", "CH", "AT"),
        "local": ~F.substring(d, 1, 1).isin("0", "1"),
    }[kind]
    cue = F.lower(left).rlike(rf"(?:^|[^a-z])(?:{CUES[kind]})s?[ :.#=]*$")
    glued = left.rlike(r"[A-Za-z0-9_=/]$") | right.rlike(r"^[A-Za-z0-9_/=]")
    return {"regex_vote": rule.cast("int"), "gazetteer_vote": lists.cast("int"),
            "context_vote": F.when(cue, 1).when(glued, 0).otherwise(-1)}


def _class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike("[0-9]"), 3).otherwise(4)


def _features(x: Column, left: Column, right: Column) -> dict[str, Column]:
    return {"f_length": F.least(F.floor(F.length(x) / 8), F.lit(9)).cast("int"),
            "f_digits": F.least(F.floor(F.length(_digits(x)) / 3), F.lit(7)).cast("int"),
            "f_left": _class(F.right(left, F.lit(1))), "f_right": _class(F.left(right, F.lit(1)))}


def _pieces(kind: str, text: Column) -> tuple[Column, Column]:
    """The text between matches (one more than matches) and the matches."""
    pattern = (BASE | ADDED)[kind]
    here = F.contains(text, F.lit(_QUICK[kind])) if kind in _QUICK else text.rlike("[0-9]")
    none = F.expr("cast(array() as array<string>)")
    return F.when(here, F.split(text, pattern, -1)).otherwise(F.array(text)), F.when(here, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none)


def candidates(docs: DataFrame, row: str, text: str) -> DataFrame:
    """Every candidate span: row, kind, start, end (code points, end exclusive), base, votes and features."""
    short = lambda p: F.struct(F.length(p).alias("n"), F.left(p, F.lit(1)).alias("first"), F.right(p, F.lit(CONTEXT)).alias("tail"))
    found = docs.select(row, *[c.alias(f"{kind}_{n}") for kind in KINDS for n, c in zip("pm", _pieces(kind, F.col(text)), strict=True)])

    def numbered(k: int, kind: str) -> Column:
        zipped = F.arrays_zip(F.transform(f"{kind}_p", short).alias("p"), F.col(f"{kind}_m").alias("m"))
        rows = F.transform(zipped, lambda z, i: F.struct(F.lit(k).alias("k"), i.alias("i"), z["p"].alias("p"), z["m"].alias("m")))
        return F.when(F.size(f"{kind}_m") > 0, rows).otherwise(empty)  # without a match there is nothing to place

    empty = F.expr("cast(array() as array<struct<k:int,i:int,p:struct<n:int,first:string,tail:string>,m:string>>)")
    rows = found.select(row, F.explode(F.flatten(F.array(*[numbered(k, kind) for k, kind in enumerate(KINDS)]))).alias("x")).select(row, "x.*")
    rows = rows.dropDuplicates([row, "k", "i"])  # equal rows have equal pieces
    w = Window.partitionBy(row, "k").orderBy("i")
    length = F.coalesce(F.length("m"), F.lit(0))
    rows = (rows.withColumn("end", F.sum((F.col("p.n") + length).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
                .withColumn("next", F.lead("p").over(w)).where(F.col("m").isNotNull()))
    x, left, right = F.col("m"), F.col("p.tail"), F.col("next.first")
    out = {"kind": F.lit(None).cast("string"), "base": F.lit(False)}
    out |= {v: F.lit(-1) for v in VOTES}
    for k, kind in reversed(list(enumerate(KINDS))):
        at = F.col("k") == k
        out["kind"] = F.when(at, F.lit(kind)).otherwise(out["kind"])
        out["base"] = F.when(at, valid(kind, x) if kind in BASE else F.lit(False)).otherwise(out["base"])
        for name, vote in _votes(kind, x, left, right).items():
            out[name] = F.when(at, vote).otherwise(out[name])
    out |= _features(x, left, right)
    return rows.select(row, "k", (F.col("end") - F.length("m")).alias("start"), "end", *[c.alias(n) for n, c in out.items()])


def reliabilities(counts: list[dict], rounds: int = 50, prior: float = 0.5) -> dict[str, dict]:
    """Expectation-maximisation per kind over counted vote patterns.

    counts: rows of kind, the three votes and n. Returns per kind the share of
    personal data and, for each labeler, the chance of each vote given the
    class. Starts from labelers that are right nine times in ten and is
    smoothed, so it can't swap the classes or divide by zero.
    """
    table = defaultdict(lambda: defaultdict(float))
    for r in counts:
        table[r["kind"]][tuple(r[v] for v in VOTES)] += r["n"]
    start = {1: {1: 0.7, 0: 0.1, -1: 0.2}, 0: {1: 0.1, 0: 0.7, -1: 0.2}}
    out = {}
    for kind, patterns in sorted(table.items()):
        share, chance = prior, [start] * len(VOTES)
        for _ in range(rounds):
            total, seen = {0: 1.0, 1: 1.0}, [{c: {v: 10 * start[c][v] for v in (1, 0, -1)} for c in (0, 1)} for _ in VOTES]
            for votes, n in sorted(patterns.items()):
                p = posterior({"share": share, "chance": chance}, votes)
                for c, weight in ((1, p * n), (0, (1 - p) * n)):
                    total[c] += weight
                    for j, v in enumerate(votes):
                        seen[j][c][v] += weight
            share = total[1] / (total[0] + total[1])
            chance = [{c: {v: s[c][v] / sum(s[c].values()) for v in s[c]} for c in s} for s in seen]
        out[kind] = {"share": share, "chance": chance}
    return out


def posterior(model: dict, votes: tuple[int, ...]) -> float:
    odds = math.log(model["share"]) - math.log(1 - model["share"])
    for chance, v in zip(model["chance"], votes, strict=True):
        odds += math.log(chance[1][v]) - math.log(chance[0][v])
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))


def train(spans: DataFrame) -> dict:
    """Labeler reliabilities and the span classifier's weights, from one count over all candidates."""
    counts = [r.asDict() for r in spans.groupBy("kind", *VOTES, *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()]
    models = reliabilities(counts)
    total, seen = defaultdict(lambda: [1.0, 1.0]), defaultdict(lambda: [1.0, 1.0])
    for r in counts:
        p = posterior(models[r["kind"]], tuple(r[v] for v in VOTES))
        for c, weight in ((1, p * r["n"]), (0, (1 - p) * r["n"])):
            total[r["kind"]][c] += weight
            for f in (*VOTES, *FEATURES):
                seen[r["kind"], f, r[f]][c] += weight
    bias = {kind: math.log(t[1] / t[0]) for kind, t in total.items()}
    weights = {k: math.log((s[1] / (total[k[0]][1] + 2)) / (s[0] / (total[k[0]][0] + 2))) for k, s in seen.items()}
    return {"models": models, "bias": bias, "weights": weights}


def _odds(model: dict) -> Column:
    """The classifier's log odds as a column over kind, votes and features."""
    def pick(values: dict) -> Column:
        return F.create_map(*[F.lit(x) for k, v in sorted(values.items()) for x in (k, float(round(v, 9)))])

    odds = F.coalesce(F.element_at(pick(model["bias"]), F.col("kind")), F.lit(-9.0)) if model["bias"] else F.lit(-9.0)
    for f in (*VOTES, *FEATURES):
        own = {f"{kind}/{value}": v for (kind, name, value), v in model["weights"].items() if name == f}
        if own:
            odds = odds + F.coalesce(F.element_at(pick(own), F.concat_ws("/", "kind", F.col(f).cast("string"))), F.lit(0.0))
    return odds


def find_spans(docs: DataFrame, text: str = "text", model: dict | None = None, threshold: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """docs with a column ``pii``: array of (k, kind, start, end, base), by kind as listed, then start.

    Null and empty texts have no spans; texts are read whole. Spans are keyed
    by 128 bits over id (where there is one) and text, so repeated rows share
    theirs and count once in training. Other columns stay, whatever their names, except
    one named pii. No rows give no rows. An added span is dropped when it
    overlaps a base span of any kind.
    """
    rest = [c for c in docs.columns if c not in (text, "pii")]
    own = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = [F.col("doc")[id_col].cast("string")] if id_col in rest else []
    keyed = own.withColumn("row", F.struct(F.xxhash64(*named, "text").alias("h"), F.xxhash64(F.lit(7), *named, "text").alias("g")))
    spans = candidates(keyed.select("row", "text"), "row", "text")
    if model is None:
        model = train(spans)
    taken = spans.select("row", "k", "kind", "start", "end", "base", ((_odds(model) >= math.log(threshold / (1 - threshold))) & (F.col("regex_vote") != 0)).alias("likely"))
    w = Window.partitionBy("row").orderBy("start")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(w.rangeBetween(0, Window.unboundedFollowing))
    clear = ~(F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False)))
    taken = taken.withColumn("clear", clear).where(F.col("base") | (F.col("likely") & F.col("clear")))
    grouped = taken.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "kind", "start", "end", "base"))).alias("pii"))
    none = F.expr("cast(array() as array<struct<k:int,kind:string,start:bigint,end:bigint,base:boolean>>)")
    out = keyed.join(grouped, "row", "left")
    return out.select(*[F.col("text").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns if c != "pii"],
                      F.coalesce("pii", none).alias("pii"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's row per document, from :func:`find_spans`."""
    base = F.filter("pii", lambda s: s["base"])
    of = lambda kind: F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
                        F.sha2(said(base), 256).alias("base_sha256"), said(F.col("pii")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", model: dict | None = None) -> DataFrame:
    """docs with every span of :func:`find_spans` replaced by its kind in brackets; null texts stay null.

    Overlapping spans are merged and carry the first one's kind.
    """
    found = find_spans(docs.withColumn("__null", F.col(text).isNull()), text, model)
    order = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # walk once: (text so far, end of the last span); a span inside an earlier one adds nothing
    pos = lambda n: F.greatest(n, F.lit(0)).cast("int")
    zero = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda s, x: F.struct(
        F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(F.substring(F.col(text), s["at"].cast("int") + 1, pos(x["start"] - s["at"])),
                                                                   F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))).otherwise(s["out"]).alias("out"),
        F.greatest(s["at"], x["end"]).alias("at"))
    clean = F.aggregate(order, zero, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col(text), s["at"].cast("int") + 1, 2**31 - 1)))
    clean = F.when(F.col("__null"), None).otherwise(F.when(F.size("pii") == 0, F.col(text)).otherwise(clean))
    return found.withColumn("__clean", clean).select(*[F.col("__clean").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != "pii"])
