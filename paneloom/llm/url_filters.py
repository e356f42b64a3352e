"""URL filtering: explicit rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import least_hashed, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_length", "host_length", "path_length", "depth", "host_labels", "digit_share", "entropy", "n_params", "n_hyphens", "has_fragment", "is_https", "has_www", "first_segment_length", "suffix_share", "domain_share"]
#: Labelled URLs that trees are fitted on at most; those of the least hash, from all rows.
SAMPLE = 20_000
#: Folds of hosts; a labelled row's shares come from the other folds.
FOLDS = 5


@dataclass(frozen=True)
class Rule:
    """verdict for host, its subdomains, and paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.col("host").endswith("." + self.host)
        return host & F.col("path").startswith(self.path)


def with_parts(pages: DataFrame) -> DataFrame:
    """host, A-Z lower-cased, and path; both empty for a null url or one without ://."""
    url = F.coalesce("url", F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)})


def ruled(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule and verdict of the longest rule that fits; both null if none does."""
    df = df.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    ordered = sorted(rules, key=lambda r: -len(r.text))
    if not ordered:
        return df
    rule, verdict = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for r in ordered:
        rule, verdict = rule.when(r.fits(), r.text), verdict.when(r.fits(), r.verdict)
    return df.withColumns({"rule": rule, "verdict": verdict})


def lexical(df: DataFrame) -> DataFrame:
    """Features of the url alone, and suffix and domain, the host's last one and two labels."""
    url = F.coalesce("url", F.lit(""))
    length = F.greatest(F.length(url), F.lit(1))
    symbols = F.array_remove(F.split(url, ""), "")
    shares = F.transform(F.array_distinct(symbols), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / length)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)

    def n(pattern: str, of=url) -> Column:
        return F.length(F.regexp_replace(of, pattern, "")).cast("double")

    return df.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": n("[^/]+", F.col("path")),
            "host_labels": F.size(F.split("host", r"\.")).cast("double"),
            "digit_share": n("[^0-9]+") / length,
            "entropy": F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)),
            "n_params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
            "n_hyphens": n("[^-]+", F.col("host")),
            "has_fragment": F.contains(url, F.lit("#")).cast("double"),
            "is_https": F.startswith(url, F.lit("https://")).cast("double"),
            "has_www": F.startswith(F.col("host"), F.lit("www.")).cast("double"),
            "first_segment_length": F.length(F.regexp_extract("path", r"^/([^/]*)", 1)).cast("double"),
            "suffix": F.substring_index("host", ".", -1),
            "domain": F.substring_index("host", ".", -2),
        }
    )


def with_shares(df: DataFrame, labelled: DataFrame, *, out_of_fold: bool = False) -> DataFrame:
    """suffix_share and domain_share: blocked share of labelled rows, smoothed by two rows of a half.

    Folds are of hosts. A labelled row must not see its own label, so out_of_fold leaves
    the rows of its host's fold out of its shares.
    """
    for key in ("suffix", "domain"):
        folds = labelled.groupBy(key, "fold").agg(F.sum("label").alias("b"), F.count("*").alias("n"))
        known = folds.groupBy(key).agg(F.sum("b").alias("_b"), F.sum("n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("b", "n")))).alias("_own"))
        df = df.join(known, key, "left")
        own = F.try_element_at("_own", F.col("fold")) if out_of_fold else F.lit(None).cast("struct<b: double, n: bigint>")
        b, n = F.coalesce("_b", F.lit(0.0)) - F.coalesce(own["b"], F.lit(0.0)), F.coalesce("_n", F.lit(0)) - F.coalesce(own["n"], F.lit(0))
        df = df.withColumn(f"{key}_share", (b + 1) / (n + 2)).drop("_b", "_n", "_own")
    return df


@dataclass
class Trees:
    """Boosted trees, or one score for all rows where the labels are of one kind."""

    model: GBTClassificationModel | None
    share: float

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows (FEATURES) with score, that of being blocked."""
        if self.model is None:
            return rows.withColumn("score", F.lit(self.share))
        assembled = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows)
        return self.model.transform(assembled).withColumn("score", vector_to_array("probability")[1])


def fit(labelled: DataFrame, *, sample: int = SAMPLE, trees: int = 30, depth: int = 2, least: int = 20, step: float = 0.1, seed: int = 7) -> Trees:
    """Trees from lexical rows with label (1: blocked) and fold, at most sample of them; shares count all.

    The trees are small, slow (step) and split no fewer than least rows off: a few rules
    teach little about other hosts, and larger trees do worse there than no trees at all.

    Rows that repeat count as often as they are there; which rows the sample has does not
    depend on their order.
    """
    n, blocked = labelled.agg(F.count("*"), F.sum("label")).first()
    if not n or not 0 < blocked < n:
        return Trees(None, float(blocked or 0) / (n or 1))
    some = with_shares(least_hashed(labelled, sample, "url", "_row"), labelled, out_of_fold=True).select("label", *FEATURES)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(some)
    return Trees(GBTClassifier(featuresCol="_features", labelCol="label", maxIter=trees, maxDepth=depth, minInstancesPerNode=least, stepSize=step, seed=seed).fit(rows), float(blocked) / n)


def prepared(pages: DataFrame, rules: list[Rule], names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Lexical rows of all pages, and those that a rule fits, with label."""
    fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")
    rows = lexical(ruled(with_parts(pages.select(F.struct(*names).alias("_row"), "url")), rules)).withColumn("fold", fold)
    rows = written(rows, "urls")
    return rows, rows.where("verdict is not null").withColumn("label", (F.col("verdict") == "block").cast("double"))


def judged(pages: DataFrame, rules: list[Rule], **options) -> DataFrame:
    """pages with host, path, rule, verdict and score (of being blocked).

    URLs that a rule fits have its verdict and are the labelled rows. Trees are fitted on
    at most sample of them; statistics of suffixes count all. URLs without a rule are
    blocked at a score of one half or more. Without labelled rows of both verdicts the
    score is the share of blocked ones, or 0 if there are none. Of rules of one length
    the first wins. Rows that repeat are judged each, and alike. Columns of these names
    are replaced.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    rows, labelled = prepared(pages, rules, names)
    found = fit(labelled, **options).scored(with_shares(rows, labelled))
    verdict = F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return found.withColumn("verdict", verdict).select(*[F.col("_row").getField(n).alias(n) for n in names], "host", "path", "rule", "verdict", "score")


def held_out(pages: DataFrame, rules: list[Rule], **options) -> DataFrame:
    """label, score and constant of all labelled rows, those of a fold of hosts with shares and trees from the other folds.

    constant is the blocked share of the other folds, which a verdict without a method would go by.
    """
    _, labelled = prepared(pages, rules, pages.columns)
    out = None
    for fold in range(FOLDS):
        taught = labelled.where(F.col("fold") != fold)
        trees = fit(taught, **options)
        one = trees.scored(with_shares(labelled.where(F.col("fold") == fold), taught)).select("url", "host", "label", "score", F.lit(trees.share).alias("constant"))
        out = one if out is None else out.unionByName(one)
    return out


def judged_by_folds(found: DataFrame) -> DataFrame:
    """One row: how often score and the constant are right at one half, and their mean logarithmic losses."""

    def right(p: str) -> Column:
        return F.avg(((F.col(p) >= 0.5) == (F.col("label") == 1)).cast("double"))

    def loss(p: str) -> Column:
        q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.avg(-F.when(F.col("label") == 1, F.log(q)).otherwise(F.log(1 - q)))

    return found.agg(F.count("*").alias("n"), *[f(p).alias(f"{p}_{n}") for p in ("score", "constant") for n, f in (("accuracy", right), ("loss", loss))])
