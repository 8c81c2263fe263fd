"""URL filter by the ratio of two character language models, under host and path rules.

Rules allow or block a host with its subdomains and a path prefix; the longest rule that fits decides.  URLs that
a rule decides also train two variable-order Markov models of characters, one of accepted and one of rejected
URLs: Witten-Bell smoothing mixes each order with the one below, down to a uniform distribution.  Other URLs get
the mean log-likelihood difference per character, and are blocked if it falls below a threshold, calibrated so
that the two kinds of training URLs are told apart best (equal weight to both kinds, URLs held out by hash).

All counts and scores are Spark aggregations, windows and merge joins over distinct grams: no model is broadcast, so
the models may grow with the corpus.  Orders are mixed from the shortest up; each joins its distinct grams, not the URLs,
and a gram of one order has no more successors than the alphabet.  Only the grams that are so frequent that one task
would get too many of their places (FREQUENT at most, by the share that each must have) are matched by a broadcast.
Counts are of every training URL.

The host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the path what follows up to
`?`, `#` or the end.  The models train on and score all that follows the first `://`, with query and fragment.  Null
and URLs without `://` have an empty host and path, and like all URLs without a character to score (nothing after
`://`) get a ratio of 0.  If no training URL is of one kind, every score is 0 and
undecided URLs are allowed.  Addresses go by
themselves, not by a hash, so no two share a ratio.  Repeated rows give a row each and count each.  Only the id and URL columns are read; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FREQUENT, materialise, meet

#: (verdict, rule); the rules of the deal.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Longest context, in characters; size of the alphabet that unseen characters share.
ORDER, ALPHABET = 4, 256
#: One training URL in so many is held out of the counts to calibrate the threshold.
HELD_OUT = 5
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and the query and fragment of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), *_LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path, F.regexp_extract(rest, r"(?s)^[^?#]*(.*)$", 1)


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits (verdict, rule), or null."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits.append((((host == name) | host.endswith("." + name)) & path.startswith(slash + rest), verdict, rule))
    return reduce(lambda c, f: c.when(f[0], F.struct(F.lit(f[1]).alias("verdict"), F.lit(f[2]).alias("rule"))), fits[1:], F.when(fits[0][0], F.struct(F.lit(fits[0][1]).alias("verdict"), F.lit(fits[0][2]).alias("rule"))))


def _windows(urls: DataFrame) -> DataFrame:
    """(row, gram): for each character of the address its longest window, the context and the character."""
    padded = F.concat(F.repeat(F.lit("\x02"), F.lit(ORDER)), F.col("address"), F.lit("\x03"))
    grams = F.transform(F.sequence(F.lit(1), F.char_length("address") + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))
    return urls.select(*[c for c in urls.columns if c != "address"], F.explode(grams).alias("gram"))


def _model(grams: DataFrame) -> DataFrame:
    """(gram, accepted, rejected, places): log-probabilities of each gram's last character, for every gram in `grams`.

    grams: (gram, accepted, rejected, places) with the training counts of the longest windows (0 where not seen).
    """
    both = ["accepted", "rejected"]
    scored = None
    for order in range(ORDER + 1):
        own = grams.groupBy(F.expr(f"right(gram, {order + 1})").alias("g")).agg(*[F.sum(c).alias(c) for c in (*both, "places")])
        context = Window.partitionBy(F.expr(f"left(g, {order})"))
        own = own.select("*", *[F.sum(c).over(context).alias(f"n_{c}") for c in both], *[F.count_if(F.col(c) > 0).over(context).alias(f"t_{c}") for c in both])
        if scored is None:
            below = own.withColumns({f"p_{c}": F.lit(1.0 / ALPHABET) for c in both})
        else:
            lower = scored.select(F.col("g").alias("suffix"), *[f"p_{c}" for c in both]).hint("merge")
            below = own.withColumn("suffix", F.expr(f"right(g, {order})")).join(lower, "suffix")
        scored = materialise(below.select("g", "places", *[_mixed(c).alias(f"p_{c}") for c in both]), f"order{order}")
    return scored.select(F.col("g").alias("gram"), "places", *[F.ln(f"p_{c}").alias(c) for c in both])


def _mixed(c: str) -> Column:
    """Witten-Bell: seen share of this order, and the rest from the order below."""
    n, t = F.coalesce(f"n_{c}", F.lit(0)), F.coalesce(f"t_{c}", F.lit(0))
    return F.when(n + t == 0, F.col(f"p_{c}")).otherwise((F.coalesce(c, F.lit(0)) + t * F.col(f"p_{c}")) / (n + t))


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, ratio (mean log-likelihood difference; null where a rule decides)."""
    host, path, tail = parts(F.coalesce(F.col(url_col), F.lit("")))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.concat(host, path, tail).alias("address"))
    rule = ruled(F.col("host"), F.col("path"), RULES if rules is None else rules)
    rows = materialise(rows.withColumn("fit", rule).select(F.monotonically_increasing_id().alias("row"), "id", "host", "path", "address", "fit.verdict", "fit.rule"), "urls")

    # Equal addresses are scored once; n and the kind go along.  An empty one has nothing to score.
    urls = rows.filter("address <> ''").groupBy("address", "verdict").agg(F.count("*").alias("n"))
    held = (F.pmod(F.xxhash64("address"), F.lit(HELD_OUT)) == 0) | F.col("verdict").isNull()
    urls = materialise(urls.withColumns({"kind": F.col("verdict"), "counts": ~held}).select(F.monotonically_increasing_id().alias("url"), "address", "kind", "counts", "n"), "addresses")
    windows = _windows(urls)
    count = lambda kind: F.sum(F.when(F.col("counts") & (F.col("kind") == kind), F.col("n")).otherwise(0))
    grams = windows.groupBy("gram").agg(count("allow").alias("accepted"), count("block").alias("rejected"), F.count("*").alias("places"))
    model = _model(materialise(grams, "grams")).select("gram", (F.col("accepted") - F.col("rejected")).alias("gain"), "places")
    asked = windows.filter("NOT counts").select("url", "gram")
    total = model.agg(F.sum("places")).first()[0] or 0
    often = F.col("places") * FREQUENT >= total
    first = asked.join(F.broadcast(model.filter(often).select("gram", "gain")), "gram", "left").groupBy("url", F.when(F.col("gain").isNull(), F.col("gram")).alias("gram"))
    # A URL's frequent grams are added up at once; what is left meets the model gram by gram.
    first = materialise(first.agg(F.sum("gain").alias("gain"), F.count("*").alias("m")), "asked")
    rest = first.filter("gram IS NOT NULL").select("url", "gram", "m").join(model.select("gram", F.col("gain").alias("one")).hint("merge"), "gram")
    parts_ = first.filter("gram IS NULL").select("url", "gain", "m").unionByName(rest.select("url", (F.col("one") * F.col("m")).alias("gain"), "m"))
    ratio = parts_.groupBy("url").agg((F.sum("gain") / F.sum("m")).alias("ratio"))
    ratio = materialise(ratio.join(urls.select("url", "address", "kind", "counts", "n").hint("merge"), "url"), "ratios")
    cut = threshold(ratio.filter("kind IS NOT NULL AND NOT counts"))
    asked_for = ratio.filter("kind IS NULL").select("address", "ratio", F.col("n").alias("copies"))
    undecided = rows.filter("verdict IS NULL AND address <> ''")
    rest = rows.filter("verdict IS NOT NULL OR address = ''").withColumn("ratio", F.lit(None).cast("double"))
    out = meet(undecided, asked_for, ["address"]).drop("copies").unionByName(rest)
    score = F.coalesce("ratio", F.lit(0.0))
    verdict = F.coalesce("verdict", F.when(score < cut, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("verdict").isNull(), score).alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """The ratio that tells held-out accepted and rejected URLs apart best, each kind weighing the same.

    Candidates are the 2 * 99 percentiles of both kinds' ratios.  Without URLs of both kinds: minus infinity.
    """
    marks = [k / 100 for k in range(1, 100)]
    found = {r["kind"]: r["q"] for r in scored.groupBy("kind").agg(F.percentile_approx("ratio", marks, 10000).alias("q")).collect()}
    if len(found) < 2:
        return float("-inf")
    tried = sorted({*found["allow"], *found["block"]})
    below = [F.sum(F.when(F.col("ratio") < c, F.col("n")).otherwise(0)).alias(f"b{i}") for i, c in enumerate(tried)]
    counts = {r["kind"]: r for r in scored.groupBy("kind").agg(F.sum("n").alias("all"), *below).collect()}
    right = lambda i: counts["block"][f"b{i}"] / counts["block"]["all"] + 1 - counts["allow"][f"b{i}"] / counts["allow"]["all"]
    return tried[max(range(len(tried)), key=lambda i: (right(i), -i))]
