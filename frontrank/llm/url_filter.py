"""URL filter: rules first, then a logistic regression on hashed character n-grams, in DataFrame functions only.

A rule (host, path) fits its host and all its subdomains if the url's path starts with its path; the longest rule wins
(by host and path together). Other urls are judged by a logistic regression over the distinct n-grams of three to
five characters of host and path, hashed into DIM places; runs of digits are one symbol. It is trained from a small
labelled URL table (words of five topics, plain words with many that look like blocked ones, made-up names; every fifth
word is held out whole for the tests); its n-grams come from the same expressions as those of the pages. The table may have at most MOST rows, which is checked; only these rows' hashed places reach the driver,
which takes gradient steps over them.

Rules are few and are written into the plan: for each rule a comparison, no join. Pages aren't shuffled.

A null url, or one without `://`, has an empty host and path, fits no rule and gets the regression's answer for no
n-grams, which is `allow`. Of rules of equal length the one that comes later in the list wins; a score of just CUT is
blocked. Urls of any length are read whole. Repeated rows get the same answer. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frontrank.llm.common import read

DIM, GRAMS, MOST, STEPS, RATE, DECAY, CUT = 16_384, (3, 4, 5), 5000, 600, 40.0, 1e-5, 0.55

# Fixed values: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

# Words of urls that are blocked, by topic, and of urls that are not; NEAR are harmless words that look like blocked ones.
TOPICS = {
    "gambling": "casino poker slots roulette jackpot betting gambling lottery bingo blackjack baccarat wager bookmaker sportsbook freespins highroller odds payout croupier scratchcard".split(),
    "adult": "porn xxx sex escort camgirls nude milf erotic fetish hookup hentai swinger webcam stripper lesbian hardcore amateur playmate lingerie naughty".split(),
    "pharmacy": "viagra cialis pills pharmacy xanax steroids tramadol levitra valium ambien oxycodone modafinil generic prescription meds dosage tablets erection slimming botox".split(),
    "money": "payday loans forex bitcoin doubling cashback winner giveaway prize investment jackpots millionaire refinance trading profits rich earnings binary pyramid payouts".split(),
    "piracy": "warez crack keygen torrent serial nulled replica rolex fakebags cracked activator patcher rapidshare dvdrip leaked bootleg counterfeit unlocker hacked cheats".split(),
}
PLAIN = "news library museum gardening recipes weather university history science forum travel music docs city health sports school research journal archive gallery theatre cinema books cooking football cycling hiking painting poetry physics biology chemistry geology astronomy software developer engineering railway airport harbour council parliament hospital charity orchestra festival magazine bakery bicycle photography architecture climate energy history garden kitchen holiday family children teacher language grammar dictionary maps transport tickets events calendar recycling volunteers insurance election justice police economy market harvest forest wildlife birds river mountain island village castle church bridge tower station".split()
NEAR = "essex sussex middlesex sextant analytics therapist classic cocktail grapes pillow caterpillar cracker spinach hotel specialist socialist button pokemon pork popcorn porcelain slotcar betaversion alphabet lotus loaning tradition traditional prizewinning winery escorted seriality serialisation torrential crackle methods medieval tablecloth pharmacology investigative richmond wagering cashier generics".split()
MORE = "best free online top my the hot new big daily world live club zone page info".split()
ENDINGS = ["com", "net", "org", "info", "biz", "example.com", "example.org", "example.net"]
CONSONANTS, VOWELS = "bcdfghklmnprstvwz", "aeiou"
ROWS, HELD = (1000, 1500, 1500), (250, 350, 300)


def _url(rng: random.Random, host: list[str], path: list[str], bare: bool = False) -> str:
    """A url with these words in host and path, in the manner of real ones: joined or with hyphens, inflected, numbered."""
    words = [w + rng.choice(["", "", "", "s", "er", "ing", "24", "4u"]) for w in host]
    name = rng.choice(["", "-"]).join(words)
    front = rng.choice(["", "", "www.", "blog.", "shop.", "m."])
    if bare:
        return f"https://{front}{name}.{rng.choice(ENDINGS)}{rng.choice(['', '/'])}"
    parts = [rng.choice(["en", "de", "fr", "es", "index", "page", "tag", "a"]) if rng.random() < 0.5 else "", *path, str(rng.randrange(10_000)) if rng.random() < 0.7 else ""]
    return f"{rng.choice(['http', 'https'])}://{front}{name}.{rng.choice(ENDINGS)}/" + "/".join(p for p in parts if p) + rng.choice(["", "/", ".html", "?page=2"])


def _made_up(rng: random.Random) -> str:
    return "".join(rng.choice(CONSONANTS) + rng.choice(["", "", "h", "r"]) + rng.choice(VOWELS) + rng.choice(["", "", "n", "r", "s", "th", "nd", "ble", "tion"]) for _ in range(rng.randint(1, 4)))


def labelled_urls() -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """(url, label) for fitting and held out, label 1 to block.

    Words are held out whole: every fifth word of each list stands in held-out urls only, as the chief word of the host. A
    held-out url of a topic has at least one known word of that topic beside it. The last kind has made-up names, which
    nobody blocks.
    """
    known = {t: [w for i, w in enumerate(ws) if i % 5 != 4] for t, ws in TOPICS.items()}
    plain = [*PLAIN, *NEAR]
    parts: list[list[tuple[str, int]]] = []
    for held, counts in ((False, ROWS), (True, HELD)):
        rng, rows = random.Random(11 + held), []
        chief = lambda ws: [w for i, w in enumerate(ws) if (i % 5 == 4) == held]  # noqa: B023, E731
        for i in range(counts[0]):
            topic = list(TOPICS)[i % len(TOPICS)]
            own = rng.sample(known[topic], 3)
            bare = rng.random() < 0.3  # no path, as on a front page
            host = [rng.choice(chief(TOPICS[topic])), own[0] if bare or rng.random() < 0.7 else rng.choice(MORE)]
            if not held and i % 3 == 0:  # a known word is enough by itself; held-out words come with another of their topic
                host, own, bare = [host[0], rng.choice([rng.choice(MORE), _made_up(rng)])], own[:1], bare or rng.random() < 0.7
            rng.shuffle(host)
            rows.append((_url(rng, host, [], True) if bare else _url(rng, host, own[1:] if rng.random() < 0.5 else own[1:2]), 1))
        common = [w for i, w in enumerate(plain) if i % 5 != 4]
        for _ in range(counts[1]):
            host = [rng.choice(chief(plain)), rng.choice(common if rng.random() < 0.5 else MORE)][: rng.randint(1, 2)]
            rng.shuffle(host)
            rows.append((_url(rng, host, rng.sample(common, rng.randint(0, 2)), rng.random() < 0.2), 0))
        for _ in range(counts[2]):
            name = [_made_up(rng)] if rng.random() < 0.7 else [_made_up(rng), rng.choice(MORE)]
            rows.append((_url(rng, name, [_made_up(rng)] if rng.random() < 0.3 else [], rng.random() < 0.2), 0))
        parts.append(rows)
    seen = {u for u, _ in parts[0]}
    return parts[0], [r for r in parts[1] if r[0] not in seen]


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def places(host: Column, path: Column) -> Column:
    """Distinct hashed places of the n-grams of host and path, 0 to DIM - 1. A run of digits is one symbol: which number it is says nothing."""
    text = F.regexp_replace(F.concat(F.lit("^"), host, path, F.lit("$")), "[0-9]+", "0")

    def grams(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(DIM)).cast("int"))

    found = [F.when(F.length(text) >= n, grams(n)).otherwise(F.array().cast("array<int>")) for n in GRAMS]
    return F.when((host == "") & (path == ""), F.array().cast("array<int>")).otherwise(F.array_distinct(F.concat(*found)))


def trained(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights of all places and the bias, from (url, label)."""
    hashed = labelled.select(places(host_of(F.col("url")), path_of(F.col("url"))).alias("x"), F.col("label").cast("int").alias("y"))
    rows = [(sorted(r["x"]), r["y"]) for r in hashed.limit(MOST + 1).collect()]
    if len(rows) > MOST:
        raise ValueError(f"the labelled table has more than {MOST} rows")
    sizes, y = np.array([len(own) for own, _ in rows]), np.array([label for _, label in rows], float)
    flat, of = np.fromiter((i for own, _ in rows for i in own), np.int64, int(sizes.sum())), np.repeat(np.arange(len(rows)), sizes)
    value = 1 / np.sqrt(np.maximum(sizes, 1))[of]
    w, bias = np.zeros(DIM), 0.0
    share = np.where(y == 1, 1 / max(1, 2 * y.sum()), 1 / max(1, 2 * (1 - y).sum()))  # both classes count alike
    for _ in range(STEPS):
        total = np.bincount(of, w[flat] * value, len(rows))
        miss = (1 / (1 + np.exp(-(total + bias))) - y) * share
        bias -= RATE / 10 * miss.sum()
        w -= RATE * (np.bincount(flat, miss[of] * value, DIM) + DECAY * w)
    return [float(f"{v:.5g}") for v in w], float(bias)


def score(x: Column, w: list[float], bias: float) -> Column:
    """The probability of `block`, from hashed places."""
    table = F.from_json(F.lit(str(w)), "array<double>")
    total = F.aggregate(x, F.lit(0.0), lambda acc, i: acc + F.element_at(table, i + 1))
    return F.when(F.size(x) == 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.size(x))))))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as its text and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the longest comes last, so outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def judged(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score for every page."""
    w, bias = trained(labelled)
    split = F.struct(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = pages.select("page_id", F.explode(F.array(split)).alias("u")).select("page_id", "u.host", "u.path")  # evaluated once
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    scored = parts.withColumns({"rule": rule, "by_rule": verdict, "block_score": score(places(F.col("host"), F.col("path")), w, bias)})
    by_score = F.when(F.col("block_score") >= CUT, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_score).alias("verdict"), "block_score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "pages"), spark.createDataFrame(labelled_urls()[0], "url string, label int"), RULES)
