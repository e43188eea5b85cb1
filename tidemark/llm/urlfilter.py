"""URL filters: host and path rules, and the ratio of two character Markov models for the rest."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import dropped, stored
from tidemark.llm.text import small


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Words in a URL that mark a rejected example where the caller gives no labels; they decide no URL by themselves.
REJECTED_SEEDS = r"(?i)(casino|pills|spam|free-bets|poker|payday|viagra)"
#: Share of held-out accepted URLs that the threshold may reject.
MAX_LOSS = 0.005
#: Symbols of the longest context.
ORDER = 5
_START, _END = "\x02", "\x03"
#: A symbol is a code point of four bytes, so that a URL is cut in time proportional to its length.
_WIDTH = 4
#: Grams up to which a table of them is broadcast; they are wider than longs.
_GRAMS = 250_000
_CLASSES = ("fit_accepted", "fit_rejected", "accepted", "rejected")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty without ``://`` or for null."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    given = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(given, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(given, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is ``host`` or a parent of it and whose path starts ``path``."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.verdict == "block", r.host)):  # the last, longest one wins
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def _grams(url: Column) -> Column:
    """Every symbol of the URL behind its scheme, as it is, and an end mark, each with the ``ORDER`` symbols before it."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")
    symbols = F.encode(F.concat(F.lit(_START * ORDER), bare, F.lit(_END)), "UTF-32")
    size = _WIDTH * (ORDER + 1)
    return F.struct(symbols.alias("s"), F.sequence(F.lit(1), F.octet_length(symbols) - size + 1, F.lit(_WIDTH)).alias("at"))


def models(counts: DataFrame) -> DataFrame:
    """(gram, p_<class>, ...): each class's probability of a gram's last symbol behind its others.

    ``counts``: a stored table (gram, n_<class>, ...) of every gram met and how often each class has it. A model backs off
    from ``ORDER`` symbols of context to none by Witten-Bell smoothing: the weight of the shorter context is the number of
    distinct symbols seen behind the longer one, so one that was never seen leaves all weight to the shorter; behind no
    context, the rest goes evenly to all symbols of the corpus. The tables grow with the corpus: each order is joined
    with the one below by its grams, by shuffle unless it is small, and a context has at most one row for each symbol.
    """
    names = [c[2:] for c in counts.columns if c.startswith("n_")]
    levels = [counts]
    for k in range(ORDER):  # the last symbols of a gram: one fewer each time
        levels.append(stored(levels[-1].groupBy(F.substring("gram", _WIDTH + 1, _WIDTH * (ORDER - k)).alias("gram")).agg(*(F.sum(f"n_{c}").alias(f"n_{c}") for c in names)), "url-grams"))
    symbols = levels[-1]
    totals = symbols.agg(F.count("*").alias("v"), *(x for c in names for x in (F.sum(f"n_{c}").alias(f"t_{c}"), F.count_if(F.col(f"n_{c}") > 0).alias(f"d_{c}")))).first()
    v = float(totals["v"] + 1)
    below = symbols.select("gram", *(((F.col(f"n_{c}") + F.lit((totals[f"d_{c}"] or 0) / v)) / F.lit(float((totals[f"t_{c}"] or 0) + (totals[f"d_{c}"] or 0)))).alias(f"p_{c}") if totals[f"t_{c}"] else F.lit(1 / v).alias(f"p_{c}") for c in names))
    below = stored(below, "url-models")
    for k in range(1, ORDER + 1):
        behind = Window.partitionBy(F.substring("gram", 1, _WIDTH * k))
        seen = levels[ORDER - k].withColumns({x: f for c in names for x, f in ((f"t_{c}", F.sum(f"n_{c}").over(behind)), (f"d_{c}", F.sum((F.col(f"n_{c}") > 0).cast("long")).over(behind)))})
        joined = seen.withColumn("last", F.substring("gram", _WIDTH + 1, _WIDTH * k)).join(small(below, _GRAMS).withColumnRenamed("gram", "last"), "last")
        mixed = (F.when(F.col(f"t_{c}") > 0, (F.col(f"n_{c}") + F.col(f"d_{c}") * F.col(f"p_{c}")) / (F.col(f"t_{c}") + F.col(f"d_{c}"))).otherwise(F.col(f"p_{c}")).alias(f"p_{c}") for c in names)
        below, lower = stored(joined.select("gram", *mixed), "url-models"), below
        dropped(lower)
    for table in levels[1:]:
        dropped(table)
    return below


def scored(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", rejected: Column | None = None) -> DataFrame:
    """(id, host, path, rule, said, seed, rejected, accepted, held, held_score, score) of every row, stored.

    ``held_score`` comes from models of the hosts that are not held out (a fifth is, by hash), ``score`` from models of all.
    """
    host, path = parts(F.col(url_col))
    seed = F.coalesce(F.col(url_col), F.lit("")).rlike(REJECTED_SEEDS) if rejected is None else F.coalesce(rejected, F.lit(False))
    split = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), seed.alias("seed"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    marked = split.select("id", "host", "path", rule.alias("rule"), said.alias("said"), "seed", _grams(F.col("url")).alias("g"), (F.pmod(F.xxhash64("host", F.lit(5)), F.lit(5)) == 0).alias("held"))
    bad = F.col("seed") & F.col("said").isNull()
    good = ~bad & (F.coalesce("said", F.lit("allow")) == "allow")
    rows = stored(marked.withColumn("rejected", bad).withColumn("accepted", good).withColumn("row", F.monotonically_increasing_id()), "urls")

    classes = ["row", "rejected", "accepted", "held"]
    each = rows.select(*classes, F.explode("g.at").alias("at"), "g.s").select(*classes, F.substring("s", F.col("at"), F.lit(_WIDTH * (ORDER + 1))).alias("gram"))
    is_of = (~F.col("held") & F.col("accepted"), ~F.col("held") & F.col("rejected"), F.col("accepted"), F.col("rejected"))
    counts = stored(each.groupBy("gram").agg(*(F.count_if(x).alias(f"n_{c}") for c, x in zip(_CLASSES, is_of, strict=True))), "url-counts")
    ratios = models(counts).select("gram", F.log(F.col("p_fit_rejected") / F.col("p_fit_accepted")).alias("held_ratio"), F.log(F.col("p_rejected") / F.col("p_accepted")).alias("ratio"))
    table = stored(ratios, "url-ratios")
    scores = stored(each.select("row", "gram").join(small(table, _GRAMS), "gram").groupBy("row").agg(F.avg("held_ratio").alias("held_score"), F.avg("ratio").alias("score")), "url-scores")
    out = stored(rows.drop("g").join(scores, "row").drop("row"), "scored-urls")
    for used in (rows, counts, table, scores):
        dropped(used)
    return out


def threshold(rows: DataFrame) -> float:
    """The score above which a URL is rejected: no less than 0, and above all but ``MAX_LOSS`` of held-out accepted URLs.

    Without a rejected example nothing is rejected: the threshold is infinite.
    """
    accepted = F.when(F.col("held") & F.col("accepted"), F.col("held_score"))
    found = rows.agg(F.percentile_approx(accepted, F.lit(1 - MAX_LOSS), F.lit(10_000)).alias("limit"), F.count_if("rejected").alias("n")).first()
    return max(0.0, found["limit"] or 0.0) if found["n"] else float("inf")


def held_out_report(rows: DataFrame, limit: float) -> DataFrame:
    """(rejected, seed, n, blocked) over the held-out hosts' examples: how many URLs of each kind there are, and are blocked."""
    return rows.where("held and (rejected or accepted)").groupBy("rejected", "seed").agg(F.count("*").alias("n"), F.count_if(F.col("held_score") > limit).alias("blocked"))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", rejected: Column | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, score): the longest rule's verdict, else the models'.

    Examples are of what the models decide. Rejected ones: of URLs that no rule fits, those that ``rejected`` marks (by
    default: a seed word). URLs that a rule blocks are in neither class: rules block folders of good hosts, so that they
    would outnumber the rest and teach the models to repeat the rules. Accepted ones: all others. Two pairs of models are counted over all URLs: one without the held-out hosts,
    which sets the threshold, and one of all hosts, which judges. A score is the mean log ratio per symbol. Of rules that
    tie in length a block precedes an allow. Each row gives one row, repeated ones too; a null URL has an empty host and
    path and is scored as empty; a very long URL is scored whole; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    rows = scored(pages, rules, id_col, url_col, rejected)
    own = F.when(F.col("score") > threshold(rows), "block").otherwise("allow")
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "score")
