"""URL rules, and a logistic regression on hashed character n-grams for the rest, with SQL functions only."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import ascii_lower

#: Words, names and paths of the built-in labelled table. None is taken from data.
BLOCKED_WORDS = (
    "casino", "poker", "slots", "bet", "bets", "betting", "pills", "viagra", "spam", "links", "ads", "track", "click", "adult", "xxx", "porn",
    "dating", "loans", "free", "cheap",
)
ALLOWED_NAMES = (
    "morning-post", "evening-news", "weekly-chronicle", "daily-record", "gazette", "observer", "public-radio", "city-journal",
    "science-today", "natural-history", "astronomy", "chemistry-notes", "mathworld", "physics-class", "medical-journal",
    "health-service", "hospital", "family-doctor", "town-library", "national-archive", "old-maps", "museum-of-art", "gallery",
    "theatre-review", "orchestra", "folk-music", "film-society", "book-club", "poetry", "short-stories", "cooking-school",
    "grandmas-kitchen", "bread-and-butter", "gardening", "green-thumb", "birdwatchers", "hiking-trails", "mountain-guide",
    "sailing-club", "cycling", "football-league", "chess-club", "running-diary", "travel-notes", "city-guide", "hotel-riviera",
    "railway-timetable", "airport", "weather-service", "climate-data", "open-source", "developer-docs", "linux-users",
    "programming-blog", "database-journal", "hardware-review", "university", "college", "primary-school", "language-course",
    "dictionary", "encyclopedia", "translators", "parliament", "city-council", "justice-department", "tax-office", "fire-brigade",
    "charity", "church-of-saint-paul", "history-society", "genealogy", "woodworking", "car-repair", "bakery", "furniture",
    "architects", "engineering", "farmers-market", "fisheries", "pet-care", "veterinary", "photography", "watercolour", "knitting",
    "zeitung", "nachrichten", "stadtbibliothek", "rathaus", "wanderverein", "kochbuch", "journal-du-soir", "bibliotheque",
    "mairie", "cuisine-facile", "randonnee", "noticias", "periodico", "ayuntamiento", "cocina-casera", "viajeros", "northern-lights",
    "smith-and-sons", "hamilton", "whitethorn", "thornbury", "anderson", "theatreland", "heatherton", "kingston", "western-union-hall",
    "trading-standards", "addison", "madrid", "academy", "winchester", "windows-and-doors", "alphabets", "freedom-of-speech", "freshwater",
    "linkoping", "clinic", "essex", "middlesex", "cheapside", "betsy-ross", "elizabeth", "spanish-lessons", "pillar-of-stone",
)
ALLOWED_PATHS = (
    "/", "/index.html", "/about", "/news/4711", "/blog/2020/", "/wiki/thames", "/library/", "/artikel/33", "/es/noticias/7",
    "/fr/actu/12.html", "/en/1921", "/sport/18/", "/de/3.html",
)
ALLOWED_WORDS = (
    "garden", "roses", "council", "minutes", "history", "school", "music", "weather", "recipes", "river", "museum", "science",
    "travel", "market", "theatre", "notes", "letters", "people", "village", "bread",
)
_DOMAINS = ("com", "net", "org", "info", "co.uk", "de", "fr")
_HEADS = ("", "www.", "blog.", "m.", "shop.")
#: What goes with a blocked word in a name.
_JOINED, _BEFORE = ("-club", "24", "-now", "-4u"), ("my", "best-", "go", "top-")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table (url, label): 1 is blocked.

    A url is blocked for its host or for its path. For each there is one that is allowed and has the same other half,
    prefix and domain, so that these say nothing; more allowed ones make what says nothing allowed.
    """
    rows = []
    bad, good, paths, size = BLOCKED_WORDS, ALLOWED_WORDS, ALLOWED_PATHS, len(BLOCKED_WORDS)
    names = iter(ALLOWED_NAMES)
    for i in range(3 * size):
        word, other, head, tail = bad[i % size], bad[(5 * i + 8) % size], f"https://{_HEADS[i % 5]}", f".{_DOMAINS[i % 7]}"
        name = next(names)
        host = (word + _JOINED[i % 4], _BEFORE[i % 4] + word, f"{word}{'-' * (i % 2)}{other}")[i // size]
        path = paths[i % len(paths)]
        rows += [(f"{head}{host}{tail}{path}", 1), (f"{head}{name}{tail}{path}", 0)]
        if i % 2:
            cut, end = "/-"[i // 2 % 2], ("", "/12.html", "/", "/7")[i // 4 % 4]
            rows.append((f"{head}{name}{tail}/{bad[i // 2 % size]}{cut}{bad[(i // 2 * 5 + i // size + 3) % size]}{end}", 1))
            rows.append((f"{head}{name}{tail}/{good[i // 2 % size]}{cut}{good[(i // 2 * 5 + i // size + 3) % size]}{end}", 0))
    rows += [(f"https://{_HEADS[i % 5]}{name}.{_DOMAINS[i % 7]}{paths[i % len(paths)]}", 0) for i, name in enumerate(islice(names, size // 2))]
    return spark.createDataFrame(rows, "url string, label int")


def url_host(url: Column) -> Column:
    """From the first :// to the next /, ? or #, A-Z lower-cased; empty for null and without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """From the end of the host to the next ? or #; empty for null and without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ngram_buckets(host: Column, path: Column, sizes: Sequence[int], buckets: int) -> Column:
    """Distinct hash buckets of the character n-grams of the host and of the path, which hash apart."""
    def grams(mark: str, chars: Column, n: int) -> Callable[[Column], Column]:
        def bucket(i: Column) -> Column:
            gram = F.concat(*[F.element_at(chars, i + j) for j in range(n)])
            return F.pmod(F.xxhash64(F.lit(mark), gram), F.lit(buckets).cast("long")).cast("int")

        return bucket

    parts = []
    for mark, value in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", path)):
        chars = F.split(value, "")
        for n in sizes:
            steps = F.sequence(F.lit(1), F.greatest(F.length(value) - n + 1, F.lit(0)), F.lit(1))
            starts = F.when(F.length(value) >= n, steps).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(starts, grams(mark, chars, n)))
    return F.array_distinct(F.concat(*parts))


def train(
    labelled: DataFrame,
    url_col: str = "url",
    label_col: str = "label",
    sizes: Sequence[int] = (3, 4),
    buckets: int = 4096,
    steps: int = 150,
    rate: float = 2.0,
    decay: float = 0.002,
    max_rows: int = 2000,
) -> list[float]:
    """Weights of a logistic regression: one per bucket, and the intercept last.

    Gradient descent on the mean logistic loss with an L2 penalty, from zero. The weights are always a
    combination of the training rows, so the descent runs over one coefficient per row, inside one SQL
    expression, and the weights are summed up from the coefficients afterwards. Feature vectors are scaled
    to length 1. Rows without a label are ignored; at most ``max_rows`` labelled rows are used, those with
    the smallest hashes of their url: the table is meant to be small. At least one row is needed.
    """
    url = F.col(url_col)
    rows = (
        labelled.where(F.col(label_col).isNotNull())
        .select(F.coalesce(url, F.lit("")).alias("url"), F.col(label_col).cast("double").alias("y"))
        .dropDuplicates(["url", "y"])
        .orderBy(F.xxhash64("url"), "url", "y")
        .limit(max_rows)
        .withColumn("f", ngram_buckets(url_host(F.col("url")), url_path(F.col("url")), sizes, buckets))
    )
    one = rows.agg(F.array_sort(F.collect_list(F.struct("url", "y", "f"))).alias("t"))
    scale = lambda r: 1.0 / F.sqrt(F.greatest(F.size(r["f"]), F.lit(1)))
    alike = lambda a, b: F.size(F.array_intersect(a["f"], b["f"])) * scale(a) * scale(b) + 1.0
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    def descend(k: Column, y: Column) -> Column:
        def step(alpha: Column, _: Column) -> Column:
            def moved(a: Column, i: Column) -> Column:
                p = 1.0 / (1.0 + F.exp(-dot(F.get(k, i), alpha)))
                return a * (1 - rate * decay) - (p - F.get(y, i)) * F.lit(rate) / F.size(y)

            return F.transform(alpha, moved)

        zero = F.transform(y, lambda _: F.lit(0.0))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, step)

    # Arrays of one element bind their value to a lambda variable: named as columns, the table and its
    # products would be worked out again in every step.
    products = lambda t: F.transform(t, lambda a: F.transform(t, lambda b: alike(a, b)))
    labels = lambda t: F.transform(t, lambda a: a["y"])
    coefficients = lambda t: F.get(F.transform(F.array(products(t)), lambda k: F.get(F.transform(F.array(labels(t)), lambda y: descend(k, y)), F.lit(0))), F.lit(0))
    fitted = one.select(F.inline(F.transform(F.array("t"), lambda t: F.struct(t.alias("t"), coefficients(t).alias("alpha")))))
    each = fitted.select(F.explode(F.arrays_zip("t", "alpha")).alias("r")).select("r.t.f", "r.alpha")
    each = each.select("alpha", (F.col("alpha") / F.sqrt(F.greatest(F.size("f"), F.lit(1)))).alias("part"), "f")
    found = each.select(F.explode("f").alias("bucket"), "part").groupBy("bucket").agg(F.sum("part").alias("w"))
    found = found.unionByName(each.agg(F.lit(buckets).alias("bucket"), F.coalesce(F.sum("alpha"), F.lit(0.0)).alias("w")))
    weights = [0.0] * (buckets + 1)
    for r in found.collect():  # at most buckets + 1 rows
        weights[r.bucket] = float(r.w)
    return weights


def block_probability(host: Column, path: Column, weights: Sequence[float], sizes: Sequence[int] = (3, 4)) -> Column:
    """The regression's probability that a url is to be blocked."""
    buckets = len(weights) - 1
    table = F.from_json(F.lit(json.dumps(list(weights))), "array<double>")
    features = ngram_buckets(host, path, sizes, buckets)
    total = F.aggregate(features, F.lit(0.0), lambda s, b: s + F.element_at(table, b + 1))
    score = total / F.sqrt(F.greatest(F.size(features), F.lit(1))) + F.lit(float(weights[-1]))
    return 1.0 / (1.0 + F.exp(-score))


def rule_match(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct (length, rule, verdict), or null.

    A rule is (verdict, host/path). It fits its host and all subdomains, where the path starts with its own.
    """
    fits = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        prefix = slash + rest
        inside = (host == name) | F.endswith(host, F.lit("." + name))
        fits.append(
            F.when(
                inside & F.startswith(path, F.lit(prefix)),
                F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")),
            )
        )
    empty = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.array_max(F.array(empty, *fits))


def url_filter(
    pages: DataFrame,
    id_col: str,
    url_col: str,
    rules: Sequence[tuple[str, str]],
    labelled: DataFrame | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """Verdicts on urls: (id, host, path, rule, verdict, p_block).

    The longest fitting rule decides; where none fits, the regression blocks from ``threshold`` on. It is
    trained on ``labelled`` (url, label), by default the built-in table. Null urls and urls without ://
    have empty host and path and are judged like others. Every row, repeated ones too, gets one row; other
    columns are ignored.
    """
    weights = train(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    cut = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    judged = cut.withColumn("hit", rule_match(F.col("host"), F.col("path"), rules)).withColumn(
        "p_block", block_probability(F.col("host"), F.col("path"), weights)
    )
    own = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), own).alias("verdict"),
        "p_block",
    )
