"""PII: regular expressions propose spans, checksums confirm them, nearby context words adjust the score.

Spans are in code points, end exclusive. The base kinds (email, ip, card, phone) are kept whenever their own
check passes; further kinds (iban, ssn, secret) need a score of `min_score`, which context words raise. Secrets are keys
and tokens: runs of 20 characters or more with letters, digits and ten different characters, after a word that names
one or with a well-known prefix. Context is the end of what stands between a match and the one before, and of that one.

Handling of edge cases: a null text counts as empty and has no spans; a very long text is scanned whole, in time
linear in its matches but for the masking; repeated rows each keep their row; overlapping spans of different kinds are
all reported and masked as one stretch under the first one's name; an empty table gives an empty result; further
columns stay, but for one named as the output column, which `find_pii` replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where a run of a pattern's first class fails from its start it fails from inside too, so a match may only
# begin at a run's start or where the last match ended; that and possessive loops keep the scan linear.
#: kind -> (pattern, a substring that every match has, words that raise the score)
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", "address|server|host|ip"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None, "card|visa|credit|payment"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", "call|phone|tel|mobile"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None, "iban|account|bank"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", "ssn|social|security"),
    "secret": (r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+", None, "token|secret|key|passw|bearer|credential"),
}
BASE = ("email", "ip", "card", "phone")
#: How keys of well-known services begin.
SECRET_PREFIX = "^(AKIA|ASIA|gh[pousr]_|xox[abpr]-|sk-|eyJ)"
CONTEXT = 40  # characters
STEP = 256  # matches whose places are added up together
SPAN = "array<struct<start:int,kind:int,stop:int,score:double>>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")

    def add(acc: Column, x: Column) -> Column:
        d = x["d"] * x["w"]
        return acc + F.when(d > 9, d - 9).otherwise(d)

    weighted = F.transform(each, lambda c, i: F.struct(c.cast("int").alias("d"), (1 + i % 2).alias("w")))
    return F.aggregate(weighted, F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's ISO 7064 check holds (blanks ignored)."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    each = F.filter(F.split(turned, ""), lambda c: c != "")
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(each, F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(m, "\\."), part)
    if kind == "card":
        n = F.length(digits(m))
        return F.when(n.between(14, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(digits(m)).between(10, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)|-00-|-0000$")
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= 10)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """`body(value)`, with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(lengths: Column) -> Column:
    """Sums of all lengths before each one, by steps, so that no long list is copied for each of its elements."""
    steps = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STEP).cast("int"))

    def sums(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, first, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    own = lambda c: F.slice(lengths, c * STEP + 1, F.lit(STEP))
    whole = F.transform(steps, lambda c: F.aggregate(own(c), F.lit(0), lambda acc, x: acc + x))
    return _let(sums(whole, F.lit(0)), lambda bases: F.flatten(F.transform(steps, lambda c: sums(own(c), F.get(bases, c)))))


def _spans(text: Column, kind: str, number: int) -> Column:
    pattern, must, near = KINDS[kind]
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("g"), matches.alias("m"))

    def placed(found: Column) -> Column:
        at = _running(F.transform(found, lambda x: F.length(x["g"]) + F.length(x["m"])))
        return _let(at, lambda starts: F.transform(found, lambda x, i: F.struct((F.get(starts, i) + F.length(x["g"])).alias("start"), x["g"].alias("g"), x["m"].alias("m"), F.coalesce(F.get(found, i - 1)["m"], F.lit("")).alias("before"))))

    def scored(x: Column) -> Column:
        context = F.lower(F.right(F.concat(F.right(x["before"], F.lit(CONTEXT)), F.right(x["g"], F.lit(CONTEXT))), F.lit(CONTEXT)))
        checked = F.lit(0.8 if kind in ("card", "iban", "ip") else 0.5)
        if kind == "secret":
            checked = F.when(x["m"].rlike(SECRET_PREFIX), 0.8).otherwise(checked)
        score = checked + F.when(context.rlike(near), 0.2).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), (x["start"] + F.length(x["m"])).alias("stop"), score.alias("score"))

    may = F.contains(text, F.lit(must)) if must else F.lit(True)
    if kind not in ("email",):
        may = may & text.rlike("[0-9]")
    valid = lambda found: F.transform(F.filter(placed(found), lambda x: _valid(kind, x["m"])), scored)
    none = F.array().cast(SPAN)
    return F.when(may, _let(pairs, lambda found: F.when(F.size(found) > 0, valid(found)).otherwise(none))).otherwise(none)


def find_pii(docs: DataFrame, text_col: str = "text", min_score: float = 0.6, out_col: str = "pii") -> DataFrame:
    """`docs` with a column `out_col`: array<struct<start, kind, stop, score>> by start, then kind number as in KINDS.

    A row-by-row projection: no shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = [_spans(text, k, i) if k in BASE else F.filter(_spans(text, k, i), lambda x: x["score"] >= min_score) for i, k in enumerate(KINDS)]
    return docs.withColumn(out_col, F.array_sort(F.concat(*parts)))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["stop"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each stretch of overlapping spans replaced by its first one's kind, as [EMAIL]."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        more = F.array(F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.get(names, x["kind"]))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    joined = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1)))
    return F.when(F.size(spans) > 0, joined).otherwise(text)


def mask_pii(docs: DataFrame, text_col: str = "text", min_score: float = 0.6) -> DataFrame:
    """`docs` with its personal data masked in `text_col`; the other columns stay, a null text stays null."""
    keep = [F.col(c) for c in docs.columns]
    out = "_pii_spans" + "_" * max(map(len, docs.columns))  # clashes with no column
    found = find_pii(docs, text_col, min_score, out)
    return found.select(*[masked(F.col(text_col), F.col(out)).alias(text_col) if c == text_col else k for c, k in zip(docs.columns, keep, strict=True)])
