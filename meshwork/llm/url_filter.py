"""URL filter: host and path rules first, then logistic regression on hashed
character n-grams of host and path.  DataFrame and SQL functions only.

The model is trained from a small labelled table inside one SQL expression: a
fold over epochs of a fold over examples, each step a gradient step.  A part of the table, by name, is left out of training; there the
threshold is chosen.  Scoring is a fold over a URL's n-grams, so a query over
pages is a single scan without a shuffle.

The labelled table that comes with the operator is made of general words for
unwanted and for harmless subjects, joined with the same other words; it holds
no host of any table that is judged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights, and lengths of the character n-grams.
DIMENSIONS, GRAMS = 1 << 15, (3, 4)
#: Labelled rows that training reads at most; more is an error, not a cut.
MAX_LABELLED = 2000
EPOCHS, RATE, DECAY = 8, 1.0, 1e-4
#: One name in so many is left out of training, for the threshold.
ASIDE = 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules that the query applies.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

#: General words for subjects of hosts, and words that go with any of them.
UNWANTED = (
    "casino poker roulette jackpot slots betting bets lottery bingo blackjack viagra cialis pharmacy steroids pills diet porn xxx adult escort webcam nude dating "
    "ads adserver banner popup clicks tracker affiliate spam phishing malware payday loans credit replica counterfeit warez torrent keygen cracked"
).split()
HARMLESS = (
    "library museum gallery theatre orchestra cinema school university college academy hospital clinic council parliament embassy railway airport harbour bridge castle "
    "cathedral village river mountain valley island forest garden orchard bakery kitchen recipe breakfast coffee vineyard cycling running swimming football cricket "
    "tennis chess climbing sailing fishing painting pottery knitting sewing carpentry engineering physics chemistry biology geology astronomy history grammar poetry "
    "novel dictionary atlas weather almanac health education tourism transport insurance energy fashion furniture dentist doctor solicitor notary architect"
).split()
BESIDE = "best online live top my super world club hub shop store daily news guide".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: name, url, blocked (1 or 0); each subject alone and with some of the words beside it."""
    rows = []
    for label, subjects in ((1, UNWANTED), (0, HARMLESS)):
        for i, subject in enumerate(subjects):
            for j in range(7):
                k, other = 7 * i + j, BESIDE[(3 * i + 5 * j) % len(BESIDE)]
                name = (subject, f"{other}-{subject}", f"{subject}-{other}", f"{other}{subject}", f"{subject}{other}", f"{subject}{k % 97}", f"the{subject}")[j]
                host = f"{('', 'www.', 'blog.', 'm.')[k * 5 // 3 % 4]}{name}"
                rows.append((name, f"https://{host}.example.{('com', 'net', 'org')[k % 3]}/{('en', 'fr', 'de', 'es')[k * 7 // 5 % 4]}/{37 * k % 1000}", label))
    return spark.createDataFrame(rows, "name string, url string, blocked int")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def gram_slots(host: Column, path: Column) -> Column:
    """Weight slots of the n-grams of host and path, one for each occurrence."""

    def grams(text: Column, n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.crc32(F.substring(text, i, F.lit(n)).cast("binary")), F.lit(DIMENSIONS)).cast("int"))

    marked = (F.concat(F.lit("^"), host, F.lit("$")), F.concat(F.lit("/"), path, F.lit("$")))
    return F.concat(*(grams(text, n) for text in marked for n in GRAMS))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _dot(weights: Column, slots: Column) -> Column:
    """Sum of the slots' weights over the root of their number."""
    total = F.aggregate(slots, F.lit(0.0), lambda s, j: s + F.get(weights, j))
    return total / F.sqrt(F.greatest(F.size(slots), F.lit(1)).cast("double"))


def _checked(labelled: DataFrame, url: str, blocked: str) -> DataFrame:
    """host, path, y and aside (left out of training) of the rows with a label; too many rows are an error."""
    name = F.col("name") if "name" in labelled.columns else host_of(F.col(url))
    rows = labelled.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(blocked).cast("double").alias("y"), (F.pmod(F.crc32(name.cast("binary")), F.lit(ASIDE)) == 0).alias("aside")).where("y is not null")
    if rows.limit(MAX_LABELLED + 1).count() > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    return rows


def train(rows: DataFrame) -> list[float]:
    """Weights by stochastic gradient descent over rows (host, path, y); the bias comes last.

    The weights are a sum of the examples' n-grams, so the descent is a fold
    over one factor for each example, with the examples' products at hand, and
    costs the same at any number of slots.  Without any row all weights are 0,
    and every score 0.5.
    """
    slots = F.concat(gram_slots(F.col("host"), F.col("path")), F.array(F.lit(DIMENSIONS)))
    order = W.orderBy(F.crc32(F.concat("host", "path").cast("binary")), "host", "path", "y")
    named = rows.select("y", slots.alias("slots"), (F.row_number().over(order) - 1).alias("i")).withColumn("size", F.size("slots"))
    cells = named.select("i", "y", "size", F.explode("slots").alias("slot")).groupBy("i", "y", "slot", "size").agg(F.count(F.lit(1)).alias("c"))
    cells = cells.select("i", "y", "slot", (F.col("c") / F.sqrt(F.col("size").cast("double"))).alias("x")).cache()
    other = cells.select(F.col("i").alias("j"), "slot", F.col("x").alias("z"))
    products = cells.join(other, "slot").groupBy("i", "y", "j").agg(F.sum(F.col("x") * F.col("z")).alias("k"))
    near = F.transform(F.sort_array(F.collect_list(F.struct("j", "k"))), lambda p: p["k"])
    table = products.groupBy("i", "y").agg(near.alias("near")).agg(F.sort_array(F.collect_list(F.struct("i", "y", "near"))).alias("examples"))

    def step(factors: Column, example: Column) -> Column:
        margin = F.aggregate(F.zip_with(factors, example["near"], lambda f, k: f * k), F.lit(0.0), lambda s, x: s + x)
        move = lambda miss: lambda f, j: f * (1 - RATE * DECAY) - F.when(j == example["i"], RATE * miss).otherwise(0.0)
        return F.aggregate(F.array(_sigmoid(margin) - example["y"]), factors, lambda kept, miss: F.transform(kept, move(miss)))

    zero = F.transform("examples", lambda _: F.lit(0.0))
    epoch = lambda factors, _: F.aggregate(F.col("examples"), factors, step)
    factors = table.select(F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), zero, epoch)).alias("i", "factor"))
    weights = [0.0] * (DIMENSIONS + 1)
    for r in cells.join(factors, "i").groupBy("slot").agg(F.sum(F.col("factor") * F.col("x")).alias("w")).collect():  # DIMENSIONS + 1 rows at most
        weights[r["slot"]] = r["w"]
    cells.unpersist()
    return weights


def score_of(weights: list[float], host: Column, path: Column) -> Column:
    """The model's probability of block."""
    vector = F.split(F.lit(" ".join(map(repr, weights))), " ").cast("array<double>")
    return _sigmoid(_dot(vector, F.concat(gram_slots(host, path), F.array(F.lit(DIMENSIONS)))))


def best_threshold(scored: list[tuple[float, float]]) -> float:
    """Where blocking has the best F0.5 over (score, label), halfway to the next score below; 0.5 without both labels.

    F0.5 weighs precision over recall: a harmless page that is blocked is lost.
    """
    found, best, hits = 0.5, 0.0, 0.0
    positives = sum(y for _, y in scored)
    order = sorted(scored, reverse=True)
    for k, (score, y) in enumerate(order):
        hits += y
        below = order[k + 1][0] if k + 1 < len(order) else 0.0
        if below < score and 0 < positives < len(scored) and (value := 1.25 * hits / (k + 1 + 0.25 * positives)) > best:
            found, best = (score + below) / 2, value
    return found


def fit(labelled: DataFrame, url: str = "url", blocked: str = "blocked") -> tuple[list[float], float]:
    """(weights, threshold) from a labelled table, which is small by contract (``MAX_LABELLED``).

    Rows of one name, or of one host where there is no column ``name``, are
    all trained on or all left out.  Null labels teach nothing.
    """
    rows = _checked(labelled, url, blocked)
    weights = train(rows.where("not aside"))
    aside = rows.where("aside").select(score_of(weights, F.col("host"), F.col("path")).alias("score"), "y")
    return weights, best_threshold([(r["score"], r["y"]) for r in aside.collect()])


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; nulls where none does."""
    name = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name = F.when(fits, rule.name) if name is None else name.when(fits, rule.name)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, threshold: float | None = None) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, score.

    A null url, or one without ``://``, has empty host and path; like every url
    that no rule fits it gets the model's verdict: block from ``threshold`` on,
    which is chosen on the labelled rows that are left out where none is given.
    ``score`` is the model's probability of block.  Null page_ids and repeated
    rows are rows like others; an empty table gives an empty result.
    """
    weights, chosen = fit(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    split = pages.select(F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = split.withColumn("rule", name).withColumn("ruled", verdict).withColumn("score", score_of(weights, F.col("host"), F.col("path")))
    modelled = F.when(F.col("score") >= (chosen if threshold is None else threshold), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", modelled).alias("verdict"), "score")
