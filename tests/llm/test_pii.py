"""Personal data: base spans against Python's patterns, and what the trees may add."""

import hashlib
import random
import re

import pytest

from tidemark.llm import pii

SCHEMA = "doc_id long, text string, base string, spans int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def corpus():
    rng = random.Random(6)
    alphabet = ["1", "2", "55", "4111111111111111", "4111 1111-1111 1111", ".", ".", "@", "a", "b.c", "-", " ", "+", "+1", "(", ")", "é", "😀", "\n", "_", "10.0.0.1", "x@y.org", "+49 30 1234567"]
    docs = [(i, "".join(rng.choices(alphabet, k=rng.randrange(1, 40)))) for i in range(400)]
    fixed = ["a@b.c_d@e.f", "x@y@z.com", "foo@bar_x@y.com", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.004", "+1 (2) 3", "+123456789-", "😀a@b.co 😀 4111111111111111", None, "", "@" * 50, "1" * 60, "1." * 60]
    return docs + [(1000 + i, t) for i, t in enumerate(fixed)] + [(None, "x@y.org"), (7, docs[7][1])]


def test_base_spans(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA).repartition(3)
    got = pii.summary(df).collect()
    want = []
    for key, text in docs:
        spans = base(text)
        spelled = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((key, *(sum(s[0] == k for s in spans) for k in PATTERNS), hashlib.sha256(spelled.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)


def side(c):
    if c == "":
        return 0
    return 1 if c in " \t\n\x0b\x0c\r" else 2 if re.fullmatch("[A-Za-z]", c) else 3 if c in "\"'`" else 4


def features(kind, text, a, b):
    """The codes of a candidate, written down anew."""
    m = text[a:b]
    digits = re.sub("[^0-9]", "", m)
    gap = text[:a]
    left = gap[-pii.CUE_REACH :]
    code = lambda x, bounds: sum(x >= y for y in bounds)
    address = re.fullmatch(r"0*\d{1,3}(\.0*\d{1,3}){3}", m) and all(int(x) < 256 for x in m.split("."))
    if kind == 2:
        check = int(luhn(digits))
    elif kind == 1 and ":" not in m:
        check = 0 if not address else 1 if all(len(x) < 3 and int(x) < 20 and (len(x) == 1 or x[0] == "1") for x in m.split(".")) else 2
    elif kind == 1:
        check = 2 if re.search("[A-Fa-f]", m) or len(m) > 12 else 0
    elif kind == 3:
        check = 0 if re.search(r"^[12][09]\d\d[./-]|[./-][12][09]\d\d$", m) else 1
    elif kind == 0:
        check = int(bool(re.search(r"\.[A-Za-z]{2,}$|(?i:dot)[\])}]? ?[A-Za-z]{2,}$", m)))
    else:
        check = 2 if re.match("AKIA|ghp_|sk-|xox[abp]-|eyJ", m) else int(bool(re.search(r"""[=:] ?["'`]?$""", left)))
    letters = 0 if digits == m else 1 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", m) else 3 if re.search("[a-z]", m) and re.search("[A-Z]", m) else 2 if re.search("[A-Za-z]", m) else 4
    cue = max([0, *(i + 1 for i, c in enumerate(pii.CUES) if re.search(rf"(?s)^.*(?<![a-z])(?:{c})(?![a-z])[^\n]{{0,14}}$", left.lower()))])
    marks = len(re.findall(r"[\x20()./\[\]{}-]", m))
    values = (kind, code(len(digits), (7, 9, 10, 11, 13, 16, 17, 20)), code(len(m), (10, 13, 16, 20, 32, 36, 41, 64)), int(m.startswith("+")), code(marks, (1, 2, 3, 4)), letters, check, side(left[-1:]), side(text[b : b + 1]), cue)
    return dict(zip(pii.FEATURES, values, strict=True))


def plain_score(row, model):
    return model.start + sum(t.steps[2 * (row[t.first[0]] == t.first[1]) + (row[t.second[0]] == t.second[1])] for t in model.trees)


def all_spans(text, model):
    """Base spans and added ones: all candidates scored, in Python, and each compared with every other."""
    text = text or ""
    spans = [(list(PATTERNS).index(k), a, b) for k, a, b in base(text)]
    scored = []
    for k, kind in enumerate(pii.KINDS):
        at = 0  # a cue is looked for behind the match before, as the operator does
        for m in re.finditer(pii.CANDIDATES[kind], text):
            row = features(k, text[at:], m.start() - at, m.end() - at)
            at = m.end()
            s = plain_score(row, model)
            if s >= model.thresholds.get(k, float("inf")) - 1e-9:
                scored.append((-s, k, m.start(), m.end()))
    meet = lambda x, y: x[-2] < y[-1] and y[-2] < x[-1]
    added = [x for x in scored if not any(meet(x, y) for y in spans) and not any(meet(x, y) and y < x for y in scored)]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans + [x[1:] for x in added]))


@pytest.fixture(scope="module")
def model(spark):
    return pii.trained(spark)


def test_held_out_precision_and_recall(model):
    assert set(model.held_out) == set(range(len(pii.KINDS)))
    for k, (precision, recall) in model.held_out.items():
        assert precision >= 0.95 and recall >= 0.85, (pii.KINDS[k], precision, recall)


def test_spans_as_by_brute_force(spark, model):
    docs = corpus() + [(5000 + n, t) for n, t, _ in pii.labelled_examples(8, seed=99)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA).repartition(3)
    got = sorted((str(r["doc_id"]), r["spans"]) for r in pii.summary(df).collect())
    assert got == sorted((str(i), all_spans(t, model)) for i, t in docs)


def test_precision_and_recall_on_fresh_examples(spark, model):
    """Texts made with another seed: what is added is nearly always true, and most of what is true is found."""
    given = pii.labelled_examples(40, seed=123)
    df = spark.createDataFrame([(n, t) for n, t, _ in given], "doc_id long, text string")
    got = {r["doc_id"]: {tuple(s) for s in r["spans"]} - {tuple(s) for s in r["base"]} for r in pii.find(df, model=model).collect()}
    true = {n: {tuple(s) for s in spans} for n, _, spans in given}
    added = sum(len(v) for v in got.values())
    right = sum(len(v & true[n]) for n, v in got.items())
    wanted = sum(len(v - {(list(PATTERNS).index(k), a, b) for k, a, b in base(t)}) for n, t, v in ((n, t, set(s)) for n, t, s in given))
    assert added > 100 and right >= 0.93 * added and right >= 0.8 * wanted


def test_planted_secrets_are_added(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = pii.summary(docs).where("n_added > 0").join(docs, "doc_id").select("text", "spans").collect()
    marked = docs.where("text rlike '(?i)token = \"[0-9a-f]{40}\"'").count()
    assert marked > 0 and sum("secret:" in r["spans"] for r in found) == marked


def test_redaction(spark):
    texts = [(1, "a x@y.org b 10.0.0.1"), (2, None), (3, "plain"), (4, "call +49 30 1234567, thanks")]
    got = dict(pii.redact(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == {1: "a [email] b [ip]", 2: "", 3: "plain", 4: "call [phone], thanks"}


def test_very_long_text_of_numbers(spark, model):
    """100,000 matches in one text: places and overlaps take time in proportion to them."""
    text = "tel 555-123-4567 " * 50_000 + "x@y.org"
    r = pii.summary(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["n_email"] == 1 and r["n_spans"] >= 50_000 and r["spans"].startswith(f"email:{len(text) - 7}:{len(text)},")


def test_empty_table(spark):
    assert pii.summary(spark.createDataFrame([], "doc_id long, text string")).collect() == []
