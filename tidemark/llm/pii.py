"""Personal data: base patterns, overlapping candidates, and boosted trees that select among them."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.store import dropped, stored
from tidemark.llm.text import small

#: Base kinds, and the kinds of all spans: secrets are found by candidates alone.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

#: The base patterns. Possessive repeats and look-behinds find the same leftmost matches in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The generators: wider forms, whose matches overlap each other and the base spans.
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[({](?i:at)[\])}]\x20?|\x20(?i:at)\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({](?i:dot)[\])}]\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+(?![0-9.])|(?:[0-9A-Fa-f]{0,4}+:){3,7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:]))",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+(])(?:\+|\(|\(\+)?[0-9](?:[\x20()./-]{0,3}[0-9]){6,14}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+={0,2}+",
}
#: Words before a candidate, by what they announce; the number of the last one met is the feature's value.
CUES = (
    r"tel|phone|call|fax|mobile|cell|whatsapp|dial|ring",
    r"mail|contact|write to|reach",
    r"card|visa|mastercard|amex|credit|debit|pay",
    r"host|server|address|addr|client|peer|ip",
    r"token|secret|api.?key|key|passw(?:or)?d|pwd|auth|bearer|credential",
    r"order|isbn|invoice|ref|serial|sha-?[0-9]*|md5|commit|checksum|digest|hash|version|release|section|part|date|id|no|nr|ticket|sku",
)
CUE_REACH = 28
#: Boosting: trees, step, and the precision on held-out examples that a threshold must reach.
TREES, STEP, PRECISION = 40, 0.3, 0.95
FEATURES = ("kind", "digits", "length", "plus", "marks", "letters", "check", "before", "after", "cue")
#: Labelled examples of each template that the trees are fitted to and calibrated on: a bounded sample, made by rule.
EXAMPLES = 120


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def _luhn(match: Column) -> Column:
    def worth(x: Column, i: Column) -> Column:
        v = x.cast("int") * (1 + i % 2)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(F.split(F.reverse(_digits(match)), ""), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_ADDRESS = rf"^{_PART}(?:\.{_PART}){{3}}$"
CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(_ADDRESS),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}
#: A text without a match of these has none of the pattern; far cheaper than the pattern itself.
_NEEDS = {("email", False): "@", ("email", True): r"@|[\x20\[({](?i:at)[\])}\x20]", ("phone", False): r"\+", ("ip", True): "[0-9]|:[A-Fa-f]{0,4}:"}


def _found(text: Column, pattern: str, need: str) -> Column:
    """The leftmost non-overlapping matches in order, each with the length of the gap before it and what stands around."""
    matches = F.regexp_extract_all(F.when(text.rlike(need), text), F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zipped = F.zip_with(F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), F.slice(gaps, 2, 1 << 30), lambda x, r: F.struct(F.length(x["g"]).alias("gap"), x["m"].alias("match"), F.right(x["g"], F.lit(CUE_REACH)).alias("left"), F.left(r, F.lit(1)).alias("right")))
    return F.when(F.size(matches) > 0, F.filter(zipped, lambda x: x["match"].isNotNull()))


def hits(texts: DataFrame) -> DataFrame:
    """(row, more, found): the matches of all patterns in ``texts`` (row, text, more), ``found`` null where there is none.

    ``found`` holds (k, wide, matches): kind number, whether a generator found them, and the matches in order.
    """
    named = [(k, wide, patterns[kind], _NEEDS.get((kind, wide), "[0-9]")) for wide, patterns in ((False, BASE), (True, CANDIDATES)) for k, kind in enumerate(KINDS) if kind in patterns]
    lists = texts.select("row", "more", *(_found(F.col("text"), p, need).alias(f"f{i}") for i, (_, _, p, need) in enumerate(named)))
    packed = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(wide).alias("wide"), F.col(f"f{i}").alias("matches")) for i, (k, wide, _, _) in enumerate(named)))
    return lists.select("row", "more", F.when(F.coalesce(*(F.col(f"f{i}") for i in range(len(named)))).isNotNull(), F.filter(packed, lambda x: x["matches"].isNotNull())).alias("found"))


def placed(found: DataFrame) -> DataFrame:
    """(row, more, k, wide, start, end, match, left, right): matches with their places in code points, end exclusive.

    A place is a running sum over the document's gaps and matches, so it takes one pass however many there are.
    """
    each = found.where("found is not null").select("row", "more", F.explode("found").alias("f")).select("row", "more", "f.k", "f.wide", F.posexplode("f.matches").alias("at", "m"))
    so_far = F.sum(F.col("m.gap").cast("long") + F.length("m.match")).over(Window.partitionBy("row", "k", "wide").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    ended = each.withColumn("end", so_far)
    return ended.select("row", "more", "k", "wide", (F.col("end") - F.length("m.match")).alias("start"), "end", "m.match", "m.left", "m.right")


def described(placed_: DataFrame) -> DataFrame:
    """``placed_`` with ``FEATURES``, small codes of a candidate's format and of the characters and words around it."""
    match, left, right = F.col("match"), F.col("left"), F.col("right")
    n, size, digits = F.length(_digits(match)), F.length(match), _digits(match)
    code = lambda x, bounds: sum((x >= b).cast("int") for b in bounds)
    side = lambda s: F.when(s == "", 0).when(s.rlike(r"^[\x20\x09-\x0D]$"), 1).when(s.rlike("^[A-Za-z]$"), 2).when(s.rlike(r"""^["'`]$"""), 3).otherwise(4)
    lower = F.lower(left)
    cue = reduce(lambda out, i: F.greatest(out, F.when(lower.rlike(rf"(?s)^.*(?<![a-z])(?:{CUES[i]})(?![a-z])[^\n]{{0,14}}$"), i + 1).otherwise(0)), range(len(CUES)), F.lit(0))
    small_parts = match.rlike(r"^(?:[0-9]|1[0-9])(?:\.(?:[0-9]|1[0-9])){3}$")
    check = F.when(F.col("k") == 2, _luhn(F.when(n > 0, match)).cast("int")).when(F.col("k") == 1, F.when(~F.contains(match, F.lit(":")), F.when(~match.rlike(_ADDRESS), 0).when(small_parts, 1).otherwise(2)).when(match.rlike("[A-Fa-f]") | (size > 12), 2).otherwise(0)).when(F.col("k") == 3, F.when(match.rlike(r"^[12][09][0-9]{2}[./-]|[./-][12][09][0-9]{2}$"), 0).otherwise(1)).when(F.col("k") == 0, match.rlike(r"\.[A-Za-z]{2,}$|(?i:dot)[\])}]?\x20?[A-Za-z]{2,}$").cast("int")).otherwise(F.when(match.rlike("^(?:AKIA|ghp_|sk-|xox[abp]-|eyJ)"), 2).when(left.rlike(r"""[=:]\x20?["'`]?$"""), 1).otherwise(0))
    letters = F.when(digits == match, 0).when(match.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 1).when(match.rlike("[a-z]") & match.rlike("[A-Z]"), 3).when(match.rlike("[A-Za-z]"), 2).otherwise(4)
    values = (F.col("k"), code(n, (7, 9, 10, 11, 13, 16, 17, 20)), code(size, (10, 13, 16, 20, 32, 36, 41, 64)), match.startswith("+").cast("int"), code(F.length(F.regexp_replace(match, r"[^\x20()./\[\]{}-]+", "")), (1, 2, 3, 4)), letters, check, side(F.right(left, F.lit(1))), side(right), cue)
    return placed_.select("*", *(v.cast("int").alias(f) for f, v in zip(FEATURES, values, strict=True)))


def _some(rng: random.Random, alphabet: str, n: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(n))


def _card(rng: random.Random, good: bool) -> str:
    """Sixteen digits that pass the Luhn check, or that don't."""
    body = [int(x) for x in _some(rng, "0123456789", 15)]
    total = sum(x if i % 2 else (2 * x - 9 * (x > 4)) for i, x in enumerate(body))
    last = -total % 10 if good else (-total + rng.randint(1, 9)) % 10
    return "".join(map(str, [*body, last]))


def labelled_examples(each: int = EXAMPLES, seed: int = 7) -> list[tuple[int, str, list[tuple[int, int, int]]]]:
    """(number, text, true spans (kind number, start, end)): texts made by rule, ``each`` of every template.

    A template is a kind, or none for what only looks like personal data, with cue words and a form. What is true is
    known from how a text is made, not from any pattern.
    """
    rng, out = random.Random(seed), []
    digits, hexa, alnum = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: _some(rng, "abcdefghilmnoprstu", rng.randint(2, 9))
    host = lambda: f"{word()}{rng.randint(1, 9)}.{rng.choice(('com', 'net', 'org', 'example.com', 'co.uk', 'de'))}"
    groups = lambda s, mark: mark.join(s[i : i + 4] for i in range(0, len(s), 4))
    octets = lambda low, high: ".".join(str(rng.randint(low, high)) for _ in range(4))
    templates: list[tuple[int | None, tuple[str, ...], Callable[[], str]]] = [
        (0, ("mail ", "contact ", "", "write to "), lambda: f"{word()}.{rng.randint(1, 99)}@{host()}"),
        (0, ("mail ", "contact: ", "", "reach me: "), lambda: f"{word()} [at] {word()} [dot] com"),
        (0, ("mail ", "contact: ", ""), lambda: f"{word()}(at){host()}"),
        (0, ("mail: ", "e-mail ", "contact "), lambda: f"{word()} at {word()} dot {rng.choice(('com', 'org', 'net'))}"),
        (None, ("", "we met "), lambda: f"{word()} at {word()}.5"),
        (1, ("host ", "server ", "ip: ", "", ""), lambda: octets(20, 255)),
        (1, ("host ", "address ", "ip ", ""), lambda: ":".join(_some(rng, hexa, 4) for _ in range(8))),
        (1, ("host ", "client ", ""), lambda: f"{_some(rng, 'abcdef', 2)}{_some(rng, digits, 2)}::{_some(rng, hexa, 4)}:{_some(rng, hexa, 4)}:{_some(rng, hexa, 4)}"),
        (None, ("version ", "section ", "release ", ""), lambda: octets(0, 19)),
        (None, ("", "at "), lambda: f"{rng.randint(0, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}:{rng.randint(10, 99)}"),
        (2, ("card ", "visa: ", "", "pay with "), lambda: groups(_card(rng, True), rng.choice(("", " ", "-", ".", "/", "  ")))),
        (None, ("", "order ", "serial ", "invoice "), lambda: groups(_card(rng, False), rng.choice(("", " ", "-", ".", "/")))),
        (None, ("", "no ", "id "), lambda: _card(rng, False)),
        (3, ("tel ", "call ", "phone: ", "", "fax "), lambda: f"+{rng.randint(1, 98)} ({_some(rng, digits, 3)}) {_some(rng, digits, 3)}-{_some(rng, digits, 4)}"),
        (3, ("tel ", "call ", "phone: ", "mobile ", ""), lambda: f"({_some(rng, digits, 3)}) {_some(rng, digits, 3)}-{_some(rng, digits, 4)}"),
        (3, ("tel ", "call ", "phone: ", "mobile "), lambda: rng.choice(("-", " ", ".")).join((_some(rng, digits, 3), _some(rng, digits, 3), _some(rng, digits, 4)))),
        (3, ("tel ", "call ", "fax "), lambda: f"0{_some(rng, digits, 3)}/{_some(rng, digits, 7)}"),
        (None, ("", "date ", "on "), lambda: f"{rng.choice(('19', '20'))}{_some(rng, digits, 2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"),
        (None, ("order ", "ref ", "id ", "", "ticket "), lambda: _some(rng, digits, rng.randint(7, 12))),
        (None, ("isbn ", ""), lambda: f"978-{rng.randint(1, 9)}-{_some(rng, digits, 2)}-{_some(rng, digits, 6)}-{rng.randint(0, 9)}"),
        (None, ("", "sku ", "part "), lambda: f"{_some(rng, digits, 2)}-{_some(rng, digits, 2)}-{_some(rng, digits, 4)}"),
        (4, ('token = "', "token: ", 'api_key = "', "secret=", 'password = "', "auth key '"), lambda: _some(rng, hexa, rng.choice((32, 40, 64)))),
        (4, ('TOKEN = "', 'KEY = "', "SECRET: "), lambda: _some(rng, hexa, 40).upper()),
        (4, ('token = "', 'key: "', "bearer ", "password="), lambda: _some(rng, alnum, rng.randint(20, 44)) + rng.choice(digits)),
        (4, ("", "key ", "use "), lambda: rng.choice(("AKIA", "ghp_", "sk-", "xoxb-")) + _some(rng, alnum, rng.randint(16, 36)) + rng.choice(digits)),
        (None, ("commit ", "sha1 ", "", "checksum ", "digest: ", "md5 = "), lambda: _some(rng, hexa, rng.choice((32, 40, 64)))),
        (None, ("", "see ", "id "), lambda: "-".join(_some(rng, hexa, n) for n in (8, 4, 4, 4, 12))),
        (None, ("", "file "), lambda: f"{word()}_{word()}_{word()}_{word()}_{rng.randint(1, 99)}"),
    ]
    for kind, cues, make in templates:
        for _ in range(each):
            before = " ".join(word() for _ in range(rng.randint(0, 6)))
            cue, value = rng.choice(cues), make()
            head = (before + " " if before else "") + cue
            close = cue[-1] if cue and cue[-1] in "\"'" else ""
            tail = close + (rng.choice((" ", ". ", ", ")) + " ".join(word() for _ in range(rng.randint(1, 5))) if rng.random() < 0.9 else "")
            out.append((len(out), head + value + tail, [] if kind is None else [(kind, len(head), len(head) + len(value))]))
    return out


class Tree(NamedTuple):
    """Two tests ``feature = value`` and a step for each of their four outcomes."""

    first: tuple[str, int]
    second: tuple[str, int]
    steps: tuple[float, float, float, float]


class Model(NamedTuple):
    """Trees, the least score of each kind that is selected, and (precision, recall) of each on held-out candidates."""

    start: float
    trees: tuple[Tree, ...]
    thresholds: dict[int, float]
    held_out: dict[int, tuple[float, float]]


def boost(table: list[dict[str, int]], trees: int = TREES, step: float = STEP) -> Model:
    """Logistic boosting of two-test trees by Newton steps on a table of feature codes with counts.

    Rows hold ``FEATURES``, ``held`` (1: held out) and the counts ``good`` and ``bad``: a few hundred, as they come from
    the bounded examples. A kind's threshold is the lowest score at which its held-out candidates reach the wanted
    precision; a kind that never does selects nothing.
    """
    codes = np.array([[r[f] for f in FEATURES] for r in table], np.int64).reshape(-1, len(FEATURES))
    good, bad, held = (np.array([r[c] for r in table], np.float64) for c in ("good", "bad", "held"))
    fit = held == 0
    n_good, n_bad = good[fit].sum(), bad[fit].sum()
    start, grown = float(np.log((n_good + 1) / (n_bad + 1))), []
    tests = sorted({(j, v) for j in range(len(FEATURES)) for v in set(codes[fit, j].tolist())})
    met = np.array([codes[:, j] == v for j, v in tests]).reshape(len(tests), -1)
    scores = np.full(len(table), start)

    def leaves(a: int, b: int) -> np.ndarray:
        return 2 * met[a] + met[b]

    def gains(grad: np.ndarray, hess: np.ndarray, a: int | None) -> int:
        """The test that, after test ``a`` if there is one, splits the loss best; of equal ones the first."""
        base = np.zeros(len(table), np.int64) if a is None else met[a].astype(np.int64)
        worth = np.zeros(len(tests))
        for side in (0, 1):
            here = base == side
            for yes in (met, ~met):
                inside = yes & here
                worth += (inside @ grad) ** 2 / (inside @ hess + 1)
        return int(np.argmax(np.round(worth, 9)))

    for _ in range(trees if n_good and n_bad else 0):
        p = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
        grad, hess = np.where(fit, good - (good + bad) * p, 0), np.where(fit, (good + bad) * p * (1 - p), 0)
        first = gains(grad, hess, None)
        second = gains(grad, hess, first)
        leaf = leaves(first, second)
        steps = step * np.bincount(leaf, grad, 4) / (np.bincount(leaf, hess, 4) + 1)
        scores = scores + steps[leaf]
        name = lambda t: (FEATURES[tests[t][0]], tests[t][1])
        grown.append(Tree(name(first), name(second), tuple(float(s) for s in steps)))
    thresholds, measured = {}, {}
    for k in range(len(KINDS)):
        mine = np.nonzero((held == 1) & (codes[:, 0] == k))[0]
        mine = mine[np.argsort(-scores[mine], kind="stable")]
        g, b = np.cumsum(good[mine]), np.cumsum(bad[mine])
        last = [i for i in range(len(mine)) if (i + 1 == len(mine) or scores[mine[i + 1]] < scores[mine[i]] - 1e-9) and g[i] and g[i] >= PRECISION * (g[i] + b[i])]
        if last:
            thresholds[k] = float(scores[mine[last[-1]]])
            measured[k] = float(g[last[-1]] / (g[last[-1]] + b[last[-1]])), float(g[last[-1]] / g[-1])
    return Model(start, tuple(grown), thresholds, measured)


def trained(spark: SparkSession, each: int = EXAMPLES) -> Model:
    """The model fitted to :func:`labelled_examples`; a third of them, by hash, is held out for the thresholds."""
    given = spark.createDataFrame([(n, t, [f"{k}:{a}:{b}" for k, a, b in spans]) for n, t, spans in labelled_examples(each)], "row long, text string, more array<string>")
    seen = described(placed(hits(given)).where("wide"))
    true = F.array_contains("more", F.concat_ws(":", "k", "start", "end"))
    counted = seen.groupBy(*FEATURES, (F.pmod(F.xxhash64("row", F.lit(3)), F.lit(3)) == 0).cast("int").alias("held")).agg(F.count_if(true).alias("good"), F.count_if(~true).alias("bad"))
    return boost([r.asDict() for r in counted.collect()])


def score(model: Model) -> Column:
    """The trees' score of a row with ``FEATURES``."""
    out = F.lit(model.start)
    for t in model.trees:
        a, b = F.col(t.first[0]) == t.first[1], F.col(t.second[0]) == t.second[1]
        out = out + F.when(a & b, t.steps[3]).when(a, t.steps[2]).when(b, t.steps[1]).otherwise(t.steps[0])
    return out


#: Characters of a block in which overlapping spans meet.
_BLOCK = 64


def _in_blocks(spans: DataFrame) -> DataFrame:
    return spans.select("row", F.explode(F.sequence(F.floor(F.col("start") / _BLOCK), F.floor((F.col("end") - 1) / _BLOCK))).alias("block"), F.struct("k", "start", "end", "score").alias("s"))


def select(candidates: DataFrame, base: DataFrame, model: Model) -> DataFrame:
    """(row, k, start, end) of the candidates to add: their score reaches their kind's threshold, and they meet no base
    span and no better candidate. Of two with equal scores the lower kind number is better, then the earlier.

    Spans meet in blocks of the text by an equi-join; those of one pattern don't overlap, so a block holds few.
    """
    least = F.create_map(*(F.lit(x) for k, v in sorted(model.thresholds.items()) for x in (k, v - 1e-9))) if model.thresholds else None
    wanted = candidates.withColumn("score", score(model))
    wanted = stored((wanted.where(F.col("score") >= F.element_at(least, F.col("k"))) if least is not None else wanted.limit(0)).select("row", "k", "start", "end", "score"), "pii-candidates")
    rivals = wanted.unionAll(base.select("row", "k", "start", "end", F.lit(float("inf")).alias("score")))
    pairs = _in_blocks(wanted).alias("a").join(_in_blocks(rivals).alias("b"), ["row", "block"]).select("row", F.col("a.s").alias("a"), F.col("b.s").alias("b"))
    order = lambda s: F.struct(-F.col(f"{s}.score"), F.col(f"{s}.k"), F.col(f"{s}.start"))
    beaten = pairs.where((F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")) & (order("b") < order("a"))).select("row", "a.k", "a.start", "a.end").distinct()
    return wanted.select("row", "k", "start", "end").join(beaten, ["row", "k", "start", "end"], "left_anti")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(id, base, spans): arrays of (kind number, start, end) by kind and start; ``spans`` holds the base ones too.

    The trees (``model``, by default :func:`trained`) see a candidate's format and context: they add forms that no base
    pattern has, such as spelled-out addresses, national phone numbers and secrets. Each row gives one row; repeated rows
    are each judged; a null text counts as empty; an empty table gives no rows; other columns are ignored. Matches are
    placed and compared as rows, so a long text of many numbers takes time in proportion to them.
    """
    spark = docs.sparkSession
    model = trained(spark) if model is None else model
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("more"))
    found = stored(hits(given), "pii-hits")
    places = stored(placed(found.select("row", F.lit(0).alias("more"), "found")), "pii-places")
    good = reduce(lambda a, b: a | b, ((F.col("k") == k) & CHECKS[kind](F.col("match")) for k, kind in enumerate(BASE_KINDS)))
    base = stored(places.where(~F.col("wide") & good).select("row", "k", "start", "end"), "pii-base")
    added = select(described(places.where("wide")), base, model)
    spans = base.select("*", F.lit(True).alias("base")).unionAll(added.select("*", F.lit(False).alias("base")))
    span = F.struct("k", "start", "end")
    per = stored(spans.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans")), "pii-spans")
    for table in (places, base):
        dropped(table)
    none = F.array().cast("array<struct<k:int,start:bigint,end:bigint>>")
    return found.select("row", F.col("more").alias(id_col)).join(small(per), "row", "left").select(id_col, F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added): counts and digest of the base spans, and all spans."""
    found = find(docs, id_col, text_col)

    def count(k: int) -> Column:  # a lambda of two arguments would be given the index
        return F.size(F.filter("base", lambda b: b["k"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    total, added = F.size("spans").cast("long"), (F.size("spans") - F.size("base")).cast("long")
    return found.select(id_col, *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"), total.alias("n_spans"), added.alias("n_added"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(id, redacted): each text with every found span replaced by its kind in brackets; overlapping ones become one."""
    found = find(docs.select(F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text")).alias("_r"), F.col(text_col).alias("_t")), "_r", "_t", model)
    text = F.coalesce(F.col("_r.text"), F.lit(""))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"))))
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(gap, F.get(names, s["k"]))).otherwise(F.lit(""))).alias("out"))

    done = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return found.select(F.col("_r.id").alias(id_col), done.alias("redacted"))
