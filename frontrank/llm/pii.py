"""Personal data by weak supervision, in DataFrame functions only.

Base spans are found by one regular expression a kind (email, ip, card, phone), checked afterwards, and always stay.
Further candidate spans (secret: long runs with digits or capitals; tel: national phone numbers) get votes of -1, 0 or 1
from four labelers: the shape of the span (regex), lists of known prefixes (gazetteer), the words before it (context)
and its make-up of letters and digits. Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is for each kind; the posteriors are then soft labels for the final classifier, a logistic regression over
votes and shape features. Candidates that it accepts and that overlap no base span are added.

Votes and features take few values, so what the driver sees is a bounded table of pattern counts over all documents
(at most 2 kinds * 3^4 votes * 4^3 shapes), whatever the size of the corpus.

Positions are found by marking each match in one pass of its regular expression and adding up the lengths of the parts,
in code points; sums run in blocks, and candidates meet base spans in one sorted list, so that work grows with the
number of matches and not with its square. Possessive and guarded forms of the expressions give the same matches in linear time: a run of
characters that can't be entered in its middle starts a match at its first character or where the last match ended.

Null and empty texts have no spans (base_sha256 is that of the empty string, spans is empty). Repeated rows give
repeated rows. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frontrank.llm.common import let, read, written

KINDS, ADDED = ("email", "ip", "card", "phone"), ("secret", "tel")
#: Characters before a span that the context labeler sees; rounds of expectation-maximisation; values summed at once.
BEFORE, ROUNDS, BLOCK = 24, 30, 256
#: Matches can't hold MARK, nor can the character that replaces it in a text.
MARK, NO_MARK = "\x01", "\x02"

# The base expressions, each with the same matches as the plain form in its comment.
PATTERN = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 13 to 19 digits: the whole run, so nothing that goes on before or after it
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9]|[A-Z]{8})[A-Za-z0-9_/+=-]{12,}+",
    "tel": r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
# What the labelers know.
SECRET_SHAPE = r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|A(?:KIA|SIA|ROA|IDA)[A-Z0-9]{8,}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9-]{16,}|[srp]k_(?:live|test)_[A-Za-z0-9]{10,}|AIza[A-Za-z0-9_-]{30,}|password=.+)$"
SECRET_PREFIX = r"^(?:A(?:KIA|SIA|ROA|IDA|BIA|CCA)|gh[pousr]_|github_pat_|glpat-|gl[dr]t-|sk-|[srp]k_|whsec_|xox[abeoprs]-|xapp-|eyJ|AIza|ya29|GOCSPX-|npm_|pypi-|hf_|do[por]_v1_|shp(?:at|ca|pa|ss)_|sq0[a-z]{3}-|EAAA|lin_api_|dapi|key-|(?:password|passwd|pwd|token|secret|api_?key)=)"
SECRET_BEFORE = r"(?i)(?:token|password|passwd|passphrase|pwd|secret|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|bearer|basic|authorization)[\s\"'=:]*$"
#: Words and short numbers with something between them; a run of letters and digits that changes between them twice.
JOINED_WORDS, MIXED = r"^(?:[A-Za-z]+|[0-9]{1,4})(?:[_/=+-]+(?:[A-Za-z]+|[0-9]{1,4}|$))*$", r"[A-Za-z][0-9]+[A-Za-z]|[0-9][A-Za-z]+[0-9]"
TEL_SHAPE = r"^(?:\([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})$"
TEL_PREFIX = r"^\(?(?:8(?:00|33|44|55|66|77|88)|20[1-9]|21[2-9]|30[1-57-9]|31[0-9]|40[1-9]|41[0-9]|50[1-9]|51[0-9]|55[159]|60[1-9]|61[0-9]|70[1-8]|71[2-9]|80[1-8]|81[2-8]|90[1-9]|91[0-9])"
TEL_NO_PREFIX = r"^\(?[01]"  # no area code begins so
TEL_BEFORE = r"(?i)(?:tel|phone|call|fon|fax|mobile|cell|whatsapp)[\s.:]*$"

_SPAN = "array<struct<s:int,e:int,m:string,before:string>>"
VOTES, SHAPES = ("regex", "gazetteer", "context", "makeup"), ("size", "digits", "capitals")


def running(values: Column, start: int, add: Callable[[Column, Column], Column]) -> Column:
    """What the values before each one add up to (add is associative); a block at a time, then the blocks' own totals."""

    def within(xs: Column) -> Column:
        zero = F.struct(F.lit(start).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def blocks(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda k: within(F.slice(xs, k * BLOCK + 1, BLOCK)))

    def carried(found: Column) -> Column:
        return F.flatten(F.zip_with(found, within(F.transform(found, lambda x: x["at"]))["out"], lambda x, c: F.transform(x["out"], lambda v: add(c, v))))

    return let(values, lambda xs: let(blocks(xs), carried))


def spans(text: Column, kind: str) -> Column:
    """Start, end, text and what stands before it, for every match of a kind's expression."""
    parts = F.split(F.regexp_replace(text, PATTERN[kind], f"{MARK}$0{MARK}"), MARK)

    def listed(p: Column, start: Column) -> Column:
        def one(i: Column) -> Column:
            m = F.get(p, i)
            return F.struct(F.get(start, i).alias("s"), (F.get(start, i) + F.length(m)).alias("e"), m.alias("m"), F.right(F.get(p, i - 1), F.lit(BEFORE)).alias("before"))

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: i % 2 == 1), one)

    none = F.expr(f"cast(array() as {_SPAN})")
    return let(parts, lambda p: F.when(F.size(p) == 1, none).otherwise(let(running(F.transform(p, F.length), 0, lambda x, y: x + y), lambda start: listed(p, start))))


def apart(found: Column, base: Column) -> Column:
    """Those spans (in order of their starts) that overlap none of base: in one list by start, none before reaches in, and none after begins inside."""
    far = 2**31 - 1
    both = F.concat(F.transform(base, lambda x: F.struct(x["s"].alias("s"), F.lit(-1).alias("i"), x["e"].alias("e"))), F.transform(found, lambda x, i: F.struct(x["s"].alias("s"), i.alias("i"), x["e"].alias("e"))))

    def free(xs: Column) -> Column:
        reach = running(F.transform(xs, lambda x: F.when(x["i"] < 0, x["e"]).otherwise(0)), 0, F.greatest)
        after = F.reverse(running(F.reverse(F.transform(xs, lambda x: F.when(x["i"] < 0, x["s"]).otherwise(far))), far, F.least))
        marked = F.zip_with(xs, F.arrays_zip(reach.alias("r"), after.alias("a")), lambda x, y: F.struct(x["i"].alias("i"), ((x["i"] >= 0) & (y["r"] <= x["s"]) & (y["a"] >= x["e"])).alias("free")))
        return F.transform(F.filter(marked, lambda x: x["free"]), lambda x: F.get(found, x["i"]))

    return F.when((F.size(found) == 0) | (F.size(base) == 0), found).otherwise(let(F.array_sort(both), free))


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$")
    if kind == "card":
        return F.call_function("luhn_check", digits_of(m))
    return F.length(digits_of(m)).between(9, 15) if kind == "phone" else F.lit(True)


def kept(kind: str, items: Column) -> Column:
    return F.filter(items, lambda x: valid(kind, x["m"]))


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, an array of base spans for each kind, and the candidates of each added kind."""
    text = F.translate(F.coalesce("text", F.lit("")), MARK, NO_MARK)
    some = {"email": F.contains(F.col("t"), F.lit("@")), "phone": F.contains(F.col("t"), F.lit("+"))}
    none = F.expr(f"cast(array() as {_SPAN})")
    fields = [F.when(some.get(k, F.lit(True)), kept(k, spans(F.col("t"), k))).otherwise(none).alias(k) for k in KINDS]
    fields += [spans(F.col("t"), k).alias(k) for k in ADDED]
    # The one-row generator keeps the optimizer from repeating the expressions wherever their results are used.
    once = docs.select("doc_id", text.alias("t")).select("doc_id", F.explode(F.array(F.struct(*fields))).alias("x"))
    slim = [F.transform(F.col(f"x.{k}"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in KINDS]
    base = F.concat(*(F.col(f"x.{k}") for k in KINDS))
    free = [apart(F.col(f"x.{k}"), base).alias(k) for k in ADDED]
    return once.select("doc_id", *slim, *free)


def votes(kind: str, c: Column) -> dict[str, Column]:
    m, before = c["m"], c["before"]

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    letters, digits = m.rlike("[A-Za-z]"), m.rlike("[0-9]")
    if kind == "secret":
        return {
            "regex": vote(m.rlike(SECRET_SHAPE), m.rlike(JOINED_WORDS) & ~m.rlike("^AKIA")),
            "gazetteer": vote(m.rlike(SECRET_PREFIX), F.lit(False)),
            "context": vote(before.rlike(SECRET_BEFORE), before.rlike(r"[.,;!?]\s*$")),
            "makeup": vote(m.rlike(MIXED), ~digits & ~m.rlike("^[A-Z0-9]+$") | ~letters | m.rlike(JOINED_WORDS)),
        }
    return {
        "regex": vote(m.rlike(TEL_SHAPE), F.lit(False)),
        "gazetteer": vote(m.rlike(TEL_PREFIX), m.rlike(TEL_NO_PREFIX)),
        "context": vote(before.rlike(TEL_BEFORE), before.rlike(r"[=#$€]\s*$")),
        "makeup": vote(m.rlike(r"\("), m.rlike(r"^[0-9]{3}\.[0-9]{3}\.")),
    }


def features(kind: str, c: Column) -> list[Column]:
    """Votes, and shape features of four values each."""
    m = c["m"]
    share = {"digits": F.length(digits_of(m)), "capitals": F.length(F.regexp_replace(m, "[^A-Z]", ""))}
    shapes = [F.least(F.lit(3), F.floor(F.length(m) / 12).cast("int")).alias("size"), *(F.least(F.lit(3), F.floor(n * 4 / F.length(m)).cast("int")).alias(k) for k, n in share.items())]
    return [v.alias(k) for k, v in votes(kind, c).items()] + shapes


def patterns(found: DataFrame, kind: str) -> list[tuple[tuple[int, ...], int]]:
    """How often each pattern of votes and shapes occurs among the candidates of all documents."""
    rows = found.select(F.explode(kind).alias("c")).select(*features(kind, F.col("c"))).groupBy(*VOTES, *SHAPES).count()
    return sorted((tuple(int(v) for v in r[:-1]), r[-1]) for r in rows.collect())  # 81 * 64 rows at most


def posteriors(counted: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> list[float]:
    """P(personal) for each pattern by expectation-maximisation over the labelers' reliabilities.

    Each labeler has, for each class, a probability for each of its three votes, smoothed by one vote; labelers are
    taken as independent given the class. The start is the majority vote.
    """
    n = len(VOTES)
    p = [1 / (1 + exp(-1.5 * sum(x[:n]))) for x, _ in counted]
    for _ in range(rounds):
        mass = [sum(c * q for (_, c), q in zip(counted, p, strict=True)), 0.0]
        mass[1] = sum(c for _, c in counted) - mass[0]
        tell = [[{v: 1.0 for v in (-1, 0, 1)} for _ in range(n)] for _ in range(2)]
        for (x, c), q in zip(counted, p, strict=True):
            for j in range(n):
                tell[0][j][x[j]] += c * q
                tell[1][j][x[j]] += c * (1 - q)
        p = []
        for x, _ in counted:
            odds = log((mass[0] + 1) / (mass[1] + 1)) + sum(log(tell[0][j][x[j]] / (mass[0] + 3)) - log(tell[1][j][x[j]] / (mass[1] + 3)) for j in range(n))
            p.append(1 / (1 + exp(-max(-30.0, min(30.0, odds)))))
    return p


def span_classifier(counted: list[tuple[tuple[int, ...], int]], soft: list[float], steps: int = 300, rate: float = 0.5) -> list[float]:
    """Weights (bias first) of a logistic regression on patterns weighted by the logarithm of their counts."""
    w = [0.0] * (1 + len(VOTES) + len(SHAPES))
    mass = [log(1 + c) for _, c in counted]
    for _ in range(steps):
        slope = [0.0] * len(w)
        for (x, _), q, m in zip(counted, soft, mass, strict=True):
            miss = m * (1 / (1 + exp(-max(-30.0, min(30.0, w[0] + sum(a * b for a, b in zip(w[1:], x, strict=True)))))) - q)
            slope[0] += miss
            for j, v in enumerate(x):
                slope[j + 1] += miss * v
        w = [a - rate * (s / sum(mass) + 1e-3 * a) for a, s in zip(w, slope, strict=True)]
    return w


def accepted(kind: str, w: list[float]) -> Column:
    """The candidates of a kind that the classifier takes for personal."""

    def takes(c: Column) -> Column:
        total = F.lit(w[0])
        for a, f in zip(w[1:], features(kind, c), strict=True):
            total = total + F.lit(a) * f
        return total >= 0

    return F.filter(F.col(kind), takes)


def pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and all spans for every row of docs."""
    found = written(found_spans(docs), "spans")
    added = {}
    for kind in ADDED:
        if counted := patterns(found, kind):
            added[kind] = accepted(kind, span_classifier(counted, posteriors(counted)))

    def listed(kind: str, items: Column) -> Column:
        return F.transform(items, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))

    base = F.concat(*(listed(k, F.col(k)) for k in KINDS))
    every = F.concat(base, *(listed(k, c) for k, c in added.items()))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(read(spark, sf_dir, "documents"))
