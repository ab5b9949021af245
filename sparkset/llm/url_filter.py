"""URL filter: rules on host and path first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkset.llm.shared import let, own_column, read_texts

#: (verdict, host/path): a rule holds for its host and all subdomains, for paths that start with its path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Rules that stand in the plan as an expression; more of them are joined on the hosts they hold for.
MOST_IN_PLAN = 1000
GRAMS = (3, 4, 5)
BUCKETS = 4096
#: Labelled URLs that training may read.
MOST_LABELLED = 20_000
#: Score from which a URL is blocked: odds of 2 to 1, as the labelled table is balanced and the web is not.
THRESHOLD = 2 / 3

#: Words of unwanted hosts, by kind (gambling, medicine, adult, piracy, link farms, advertising, phishing, money), and of ordinary ones.
SPAM_WORDS = """
    casino poker slots betting bets bingo jackpot roulette lottery viagra cialis pills pharmacy meds slimming
    xxx adult porn sexy escort cams dating singles torrent warez keygen cracked serial download free movies
    seo backlinks spam bulk followers link farm ads adserver click track popup banner affiliate redirect
    verify giftcard prize winner claim crypto forex profit cash loans payday replica cheap discount
""".split()
PLAIN_WORDS = """
    library university museum garden recipe council weather railway school orchestra hospital software theatre science village
    history music geography chess cathedral parliament harbour newspaper book carpentry knitting sailing cycling mountain river forest
    bird pottery painting sculpture philosophy language archaeology economics statistics engineering physics chemistry biology astronomy geology
    botany grammar dictionary kindergarten observatory choir cinema local open data travel energy poetry kitchen
""".split()


def _labelled() -> list[tuple[str, int]]:
    """Small labelled table: made-up hosts of one or two words under reserved names. Both kinds have the same prefixes, domains and paths: only words tell."""
    prefixes, domains = ("", "www.", "m.", "blog."), ("example.com", "example.org", "example.net", "example", "test")
    paths = ("/en/{0}", "/de/{0}.html", "/fr/{0}/", "/es/{0}?page=2", "/news/2024/{0}", "/")
    rows = []
    for label, words in ((1, SPAM_WORDS), (0, PLAIN_WORDS)):
        for i, word in enumerate(words):
            others = [words[(i + step) % len(words)] for step in (7, 23)]
            for k, name in enumerate((word, f"{word}-{others[0]}", f"{others[1]}-{word}", word + others[1])):
                at = i * 4 + k
                rows.append((f"https://{prefixes[at // 4 % 4]}{name}.{domains[at % 5]}{paths[at % 6].format(at * 137 % 1000)}", label))
    return rows


LABELLED = _labelled()


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z lower-cased; empty where there is no ://."""
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _parts(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host, "/" + path


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (of equally long ones the last), as a struct of verdict and rule; null where none fits."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        of_host, of_path = _parts(rule)
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(of_path)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def ruled_by_join(addresses: DataFrame, rules, host_col: str = "host", path_col: str = "path") -> DataFrame:
    """``host_col``, ``path_col`` and ``ruled``, as by ``ruled``, of the distinct addresses that a rule fits; for any number of rules.

    Rules are gathered by host, so that an address meets each host that it lies in once: itself and what follows each of its dots.
    """
    spark = addresses.sparkSession
    rows = [(*_parts(rule), (len(rule), i), (verdict, rule)) for i, (verdict, rule) in enumerate(rules)]
    table = spark.createDataFrame(rows, "of string, start string, rank struct<length:int,place:int>, ruled struct<verdict:string,rule:string>")
    table = table.groupBy("of").agg(F.collect_list(F.struct("rank", "ruled", "start")).alias("rules"))
    labels = F.split(F.col(host_col), r"\.")
    domains = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    met = addresses.select(host_col, path_col).distinct().select(host_col, path_col, F.explode(F.array_distinct(domains)).alias("of")).join(table, "of")
    fitting = F.filter("rules", lambda r: F.col(path_col).startswith(r["start"]))
    best = met.select(host_col, path_col, F.array_max(fitting).alias("best")).where("best is not null").groupBy(host_col, path_col).agg(F.max("best").alias("best"))
    return best.select(host_col, path_col, F.col("best.ruled").alias("ruled"))


def gram_buckets(host: Column, path: Column) -> Column:
    """Buckets of the character n-grams of host and path, repeats included. Their ends are marked."""

    def grams(text: Column, n: int) -> Column:
        last = F.char_length(text) - n
        found = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(text, i + 1, F.lit(n)))
        return F.when(last >= 0, found).otherwise(F.array().cast("array<string>"))

    marked = [F.concat(F.lit("^h"), host, F.lit("$")), F.concat(F.lit("^p"), path, F.lit("$"))]
    bucket = lambda k: lambda g: F.pmod(F.xxhash64(g, F.lit(k)), F.lit(BUCKETS)).cast("int")
    of = lambda k: lambda text: F.concat(*[F.transform(grams(text, n), bucket(k)) for n in GRAMS])
    return F.concat(*[let(text, of(k)) for k, text in enumerate(marked)])


class UrlModel:
    """Weights of the buckets and an intercept. A URL's value is the intercept and its grams' weights over the root of their number."""

    def __init__(self, weights: list[float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, buckets: Column) -> Column:
        # the weights stand in the plan once, as a constant array
        weights = F.lit([float(w) for w in self.weights]).cast("array<double>")
        total = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(weights, b))
        return 1 / (1 + F.exp(-(F.lit(self.intercept) + total / F.sqrt(F.greatest(F.size(buckets), F.lit(1)).cast("double")))))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", regularisation: float = 0.001) -> UrlModel:
    """Logistic regression over the labelled table, which may have ``MOST_LABELLED`` rows. Rows with a null label don't count."""
    rows = labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label")).where("label is not null")
    if rows.limit(MOST_LABELLED + 1).count() > MOST_LABELLED:
        raise ValueError(f"at most {MOST_LABELLED} labelled URLs")
    rows = rows.select("label", gram_buckets(host_of(F.col("url")), path_of(F.col("url"))).alias("b"))

    def weights(b: Column) -> Column:
        """Weight of each bucket that there is, as in ``UrlModel.score``: its count over the root of the number of grams."""
        met = F.array_distinct(b)
        return F.map_from_arrays(met, F.transform(met, lambda x: F.size(F.filter(b, lambda y: y == x)) / F.sqrt(F.size(b).cast("double"))))

    dense = lambda m: F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.coalesce(F.try_element_at(m, k), F.lit(0.0)))
    rows = rows.select("label", array_to_vector(let(let(F.col("b"), weights), dense)).alias("features"))
    fitted = LogisticRegression(maxIter=60, regParam=regularisation, standardization=False).fit(rows.coalesce(1))
    return UrlModel([float(x) for x in fitted.coefficients], float(fitted.intercept))


def default_labelled(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in LABELLED])
    return spark.range(1).select(F.inline(rows))


def judge(pages: DataFrame, model: UrlModel, rules=RULES, url_col: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` without its other new names, plus host, path, rule, verdict (allow or block) and score.

    The longest fitting rule decides (of equally long ones the last); where none fits, a score of ``threshold`` or more blocks. Null urls and
    those without :// have an empty host and path and are judged like others; null ids and repeated rows stay. A column of
    ``pages`` that has the name of a new one is replaced. Up to ``MOST_IN_PLAN`` rules are one expression; more are joined.
    """
    new = {"host", "path", "rule", "verdict", "score"}
    carried = [c for c in pages.columns if c.lower() not in new]
    buckets, by_rule = (own_column(pages, n) for n in ("buckets_", "ruled_"))
    df = pages.select(*[F.col(f"`{c}`") for c in carried], host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    if len(rules) <= MOST_IN_PLAN:
        df = df.select("*", ruled(F.col("host"), F.col("path"), rules).alias(by_rule))
    else:
        here = df.select("host", "path")
        own_host, own_path = (own_column(pages, n) for n in ("host_", "path_"))
        found = ruled_by_join(here, rules).select(F.col("host").alias(own_host), F.col("path").alias(own_path), F.col("ruled").alias(by_rule))
        df = df.join(found, (F.col("host") == F.col(own_host)) & (F.col("path") == F.col(own_path)), "left").drop(own_host, own_path)
    df = df.select("*", gram_buckets(F.col("host"), F.col("path")).alias(buckets))
    df = df.select("*", model.score(F.col(buckets)).alias("score"))
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return df.select(*[f"`{c}`" for c in carried], "host", "path", F.col(f"{by_rule}.rule").alias("rule"), F.coalesce(f"{by_rule}.verdict", learned).alias("verdict"), "score")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    pages = read_texts(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, train(default_labelled(spark))).select("page_id", "host", "path", "rule", "verdict", "score")
