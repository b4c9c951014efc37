"""Operator 4: personal data.  Patterns propose spans, checksums confirm, context adjusts.

For each kind a regular expression proposes leftmost non-overlapping spans; a validator (Luhn
for cards, mod-97 and the country's length for IBANs, mod-11 for NHS numbers, ranges for
addresses, phones and social security numbers) drops failing ones; words near a span raise or
lower its score.  Base kinds (email, ip, card, phone) stay whatever their score.  The method's
own kinds need a score of ``LEAST``: a number that many things may be (ssn, nhs) is kept only with
a word near it that says so, an IBAN is dropped where the words near it call it a sample.

Only built-in functions: ``split`` and ``regexp_extract_all`` walk the same matches, so the
lengths of the parts between give each match's place.  A cheap test guards each kind.  The
patterns are possessive or of bounded length and start only where a run of their characters
starts, so they take linear time on long runs.  A narrow map: no shuffle, no Python on the
executors.

Cases: null text counts as empty; texts are read whole; overlapping spans of different kinds
are all reported; repeated rows get equal results; an empty table gives an empty result;
other columns, whatever their names, are kept by ``redact``, where a null text stays null.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import free_name, own_columns, table

NEAR = 40
STEP = 256
LEAST = 0.7
_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


#: The length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban_pattern() -> str:
    """A country's letters and as many characters as its IBANs have, spaces between them allowed."""
    lengths = sorted(set(IBAN_LENGTHS.values()))
    each = ("(?:{})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{}}}".format("|".join(c for c, m in IBAN_LENGTHS.items() if m == n), n - 4) for n in lengths)
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(each)})(?![A-Za-z0-9])"


class Kind(NamedTuple):
    name: str
    pattern: str
    guard: str  # a text without this has no match
    context: str  # words that raise the score
    score: float
    against: str = "(?!)"  # words that lower it


KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", r"(?i)mail|contact|write", 0.8),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", r"(?i)\bip\b|address|host|server", 0.6),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"(?:[0-9][\x20-]?){11}[0-9]", r"(?i)card|visa|master|credit|pay", 0.8),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", r"(?i)phone|tel|call|mobile|fax", 0.6),
    Kind("iban", _iban_pattern(), r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", r"(?i)iban|bank|account|konto", 0.7, r"(?i)\b(?:sample|example|dummy|invalid|test)\b"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?i)\bssn\b|social security", 0.5),
    Kind("nhs", r"(?<![0-9])[0-9]{3}\x20[0-9]{3}\x20[0-9]{4}(?![0-9])", r"[0-9]{3}\x20[0-9]{3}\x20[0-9]{4}", r"\bNHS\b|(?i)health service", 0.5),
)
BASE = ("email", "ip", "card", "phone")
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def mod97(iban: Column) -> Column:
    """ISO 7064 check: the first four characters moved to the end, letters as 10 to 35."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(value(c) >= 10, 100).otherwise(10) + value(c)) % 97),
    )
    return rest == 1


def mod11(digits: Column) -> Column:
    """The tenth digit is 11 less the rest of the weighted sum of the first nine."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda acc, k: acc + F.substr(digits, k, F.lit(1)).cast("int") * (11 - k))
    return (11 - total % 11) % 11 == F.substring(digits, 10, 1).cast("int")


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "nhs":
        return mod11(digits)
    return mod97(match) if kind == "iban" else F.lit(True)


def proposals(text: Column, kind: Kind, rank: int) -> Column:
    """Confirmed spans of one kind, in order, with their scores."""
    pieces = F.split(text, kind.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    steps = F.arrays_zip(
        F.slice(pieces, F.lit(1), F.size(found)).alias("before"), found.alias("match"), F.slice(pieces, F.lit(2), F.size(found)).alias("after")
    )
    none = F.lit("")

    def near(s, k):
        """What stands within NEAR characters on either side, beyond a neighbouring match too."""
        before = F.concat(F.coalesce(F.get(pieces, k - 1), none), F.coalesce(F.get(found, k - 1), none), s["before"])
        after = F.concat(s["after"], F.coalesce(F.get(found, k + 1), none), F.coalesce(F.get(pieces, k + 2), none))
        return F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR)))

    # lengths first: (gap, size) of each match, then places inside runs of STEP, then of the runs
    facts = F.transform(
        steps,
        lambda s, k: F.struct(
            F.length(s["before"]).alias("gap"),
            F.length(s["match"]).alias("size"),
            valid(kind.name, s["match"]).alias("ok"),
            near(s, k).rlike(kind.context).alias("near"),
            near(s, k).rlike(kind.against).alias("against"),
        ),
    )

    def place(state, fact):
        start = state["end"] + fact["gap"]
        score = F.lit(kind.score) + F.when(fact["near"], 0.2).otherwise(0.0) - F.when(fact["against"], 0.3).otherwise(0.0)
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + fact["size"]).alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))
        keep = fact["ok"] & (F.lit(kind.name in BASE) | (score >= LEAST))
        return F.struct((start + fact["size"]).alias("end"), F.when(keep, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("end"), F.array().cast(SPAN).alias("out"))
    last = F.greatest(F.floor((F.size(found) - 1) / STEP), F.lit(0)).cast("int")
    runs = F.transform(F.sequence(F.lit(0), last), lambda c: F.aggregate(F.slice(facts, c * STEP + 1, F.lit(STEP)), zero, place))

    def moved(run, c, runs):
        base = F.aggregate(F.slice(runs, F.lit(1), c), F.lit(0), lambda total, r: total + r["end"])
        return F.transform(
            run["out"],
            lambda s: F.struct((s["start"] + base).alias("start"), s["rank"], (s["end"] + base).alias("end"), s["kind"], s["score"]),
        )

    placed = F.element_at(
        F.transform(F.array(runs), lambda rs: F.flatten(F.transform(rs, lambda run, c: moved(run, c, rs)))), 1
    )
    guard = F.contains(text, F.lit("@")) if kind.guard == "@" else text.rlike(kind.guard)
    return F.when(guard, placed).otherwise(F.array().cast(SPAN))


def spans(text: Column) -> Column:
    """All confirmed spans by start, then kind as listed; never null."""
    body = F.coalesce(text, F.lit(""))
    return F.array_sort(F.flatten(F.array(*[proposals(body, kind, rank) for rank, kind in enumerate(KINDS)])))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", chars: str | None = None) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans become one.

    ``chars`` names a column that holds the text's length, to be kept right.
    """

    def step(state, s):
        apart = s["start"] >= state["end"]
        gap = F.substring(F.col(text), state["end"] + 1, s["start"] - state["end"])
        out = F.concat(state["out"], F.when(apart, F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
        return F.struct(out.alias("out"), F.greatest(state["end"], s["end"]).alias("end"))

    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("end"))
    at, new = free_name(docs, "spans"), free_name(docs, "redacted")
    found = docs.withColumn(at, spans(F.col(text)))
    clean = F.aggregate(at, zero, step, lambda s: F.concat(s["out"], F.substring(F.col(text), s["end"] + 1, F.length(text))))
    found = found.withColumn(new, F.when(F.size(at) > 0, clean).otherwise(F.col(text)))
    changed = {text: F.col(new)}
    if chars:
        changed[chars] = F.when(F.size(at) > 0, F.length(new).cast(docs.schema[chars].dataType)).otherwise(F.col(chars))
    return found.select(*[changed.get(c, own).alias(c) for c, own in zip(docs.columns, own_columns(docs))])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", spans(F.col("text")).alias("spans"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",")
    return found.select(
        "doc_id",
        *[of(kind) for kind in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        of("iban"),
        of("ssn"),
        of("nhs"),
        scores.alias("scores"),
    )
