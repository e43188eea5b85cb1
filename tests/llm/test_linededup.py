"""Line dedup against all pairs of lines."""

import random
import re

from pyspark.sql import functions as F

from tidemark.llm import linededup, nearsets

SCHEMA = "doc_id long, text string, k1 string, line string"


def grams(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def corpus():
    rng = random.Random(3)
    vocabulary = [f"{rng.choice('bcdfgkl')}{rng.choice('aeiou')}{rng.choice('mnrst')}{i % 90}" for i in range(300)]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))

    def edited(text):
        words = text.split(" ")
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return " ".join(words)

    base, other = line(30), line(25)
    docs = [(i, "\n".join([line(12), edited(base) if i % 2 else base, line(8), edited(other)])) for i in range(40)]
    docs += [(100, "\n".join([docs[0][1].split("\n")[0], "", "  ", "one", "one", "one two"])), (101, "one\n\x0b\none two three"), (102, None), (103, ""), (None, base), (104, docs[5][1]), (104, docs[5][1])]
    common = " ".join(vocabulary[:6])
    return docs + [(200 + i, f"{common} {line(6)}") for i in range(60)]


def brute(docs):
    seen, lines = set(), []
    for key, text in docs:
        if (key, text) not in seen:
            seen.add((key, text))
            lines += [((key is not None, key or 0, i), text, x) for i, x in enumerate((text or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    sets = [grams(x) for *_, x in lines]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            if lines[i][2] == lines[j][2] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                if a != b:
                    root[a] = root[b] = min(a, b, key=lambda k: lines[k][0])
    first = {}
    for i, (place, *_) in enumerate(lines):
        first[find(i)] = min(first.get(find(i), place), place)
    return {(place[1] if place[0] else None, text, place[2]) for i, (place, text, _) in enumerate(lines) if first[find(i)] != place}, lines


def test_same_as_all_pairs(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, "k", "l") for d in docs], SCHEMA).repartition(3)
    found = linededup.repeated_lines(df)
    texts = df.select(*linededup.document_keys("doc_id", "text"), "text").distinct()
    got = {(r["id"], r["text"], i) for r in found.join(texts, ["k1", "k2"]).collect() for i in r["dropped"]}
    want, lines = brute(docs)
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 60
    sizes = {(r["id"], r["n_lines"]) for r in found.collect()}
    assert sizes == {(p[1] if p[0] else None, sum(x[0][:2] == p[:2] for x in lines)) for p, *_ in lines}


def test_lines_go_and_the_rest_stays(spark):
    docs = [(1, "a b c\n\nd"), (2, "x\na b c\ny"), (2, "x\na b c\ny"), (3, "a b c"), (4, None), (5, "")]
    df = spark.createDataFrame([(*d, "k", "l") for d in docs], SCHEMA)
    got = linededup.without_repeated_lines(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"], r["k1"]) for r in got.collect()), key=str) == sorted([(1, "a b c\n\nd", "k"), (2, "x\ny", "k"), (2, "x\ny", "k"), (3, "", "k"), (4, None, "k"), (5, "", "k")], key=str)


def test_empty_table(spark):
    assert linededup.repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert linededup.without_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).where(F.lit(True)).collect() == []


def test_shingles_start_at_every_character(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzäß", k=rng.randint(2, 9)))
    lines = [" ".join(word() for _ in range(rng.randint(9, 17))) for _ in range(120)]
    copies = []
    for x in lines:  # one letter of a word changed: few shingles of characters, many of a short line's words
        words = x.split(" ")
        at = rng.randrange(len(words))
        copies.append(" ".join([*words[:at], "Z" + words[at][1:], *words[at + 1 :]]))
    docs = [*enumerate(lines), *enumerate(copies, 1000), (2000, "abc"), (2001, "abd"), (2002, "abcd")]
    want = {1000 + i for i, (x, y) in enumerate(zip(lines, copies, strict=True)) if len(grams(x) & grams(y)) >= 0.8 * len(grams(x) | grams(y))}
    assert len(want) > 60
    got = {r["id"] for r in linededup.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r["dropped"]}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_similarity_is_that_of_all_character_shingles():
    rng = random.Random(6)
    one = ["".join(rng.choices("abc é", k=rng.randint(1, 60))) for _ in range(700)]
    two = [x[:20] + y[20:] for x, y in zip(one, reversed(one), strict=True)]
    for x, y, s in zip(one, two, nearsets.similarities(one, two, nearsets.of_characters), strict=True):
        assert abs(s - len(grams(x) & grams(y)) / len(grams(x) | grams(y))) < 1e-12


def test_lines_without_spaces(spark):
    rng = random.Random(9)
    base = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(60))
    url = "https://example.org/" + "".join(rng.choices("abcdef0123456789/", k=70))
    docs = [(1, base), (2, base[:-1] + "人"), (3, url + "1"), (4, url + "2"), (5, "=" * 9), (6, "=" * 40)]
    got = {r["id"] for r in linededup.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r["dropped"]}
    assert got == {2, 4, 6}


def test_hot_bucket(spark, monkeypatch):
    """Hundreds of copies of one line with edits of all sizes: the components are those of all pairs."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    base, docs = [word() for _ in range(40)], []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(40), rng.randint(0, 7)):
            words[at] = word()
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["id"], i) for r in linededup.repeated_lines(df).collect() for i in r["dropped"]}
    monkeypatch.setattr(nearsets, "SMALL", 400)  # the same buckets with every two of their lines
    assert got == {(r["id"], i) for r in linededup.repeated_lines(df).collect() for i in r["dropped"]}
    want = {(key, i) for key, _, i in brute(docs)[0]}
    assert got <= want and len(got) >= 0.97 * len(want) > 100


def test_template_lines(spark, monkeypatch):
    """Hundreds of lines of one template in one bucket, few of them similar: split by rare shingles or not, no link is lost."""
    rng = random.Random(14)
    free = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    template, docs = "this notice was posted by the member whose number follows: ", []
    for i in range(350):
        line = template + free(20)
        docs += [(2 * i, line), (2 * i + 1, line[:-2] + free(2) if i % 3 == 0 else template + free(20))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    dropped = lambda: {(r["id"], i) for r in linededup.repeated_lines(df).collect() for i in r["dropped"]}
    calls, rarest = [], nearsets.rarest
    monkeypatch.setattr(nearsets, "rarest", lambda *a: calls.append(1) or rarest(*a))
    monkeypatch.setattr(nearsets, "LARGE", 20)
    got = dropped()
    assert calls
    monkeypatch.setattr(nearsets, "LARGE", 10_000)
    assert got == dropped() and len(calls) == 1
    want = {(key, i) for key, _, i in brute(docs)[0]}
    assert got <= want and len(got) >= 0.97 * len(want) > 90


def test_large_buckets_join_a_text_once(spark, monkeypatch):
    """In the buckets of one head a text is one row, and so are its rarest shingles: no rows by bucket and shingle are joined."""
    rng = random.Random(16)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    base = [word() for _ in range(40)]
    lines = [" ".join(base)] * 3
    for i in range(90):
        words = list(base)
        for at in rng.sample(range(40), i % 8):
            words[at] = word()
        lines.append(" ".join(words))
    docs, rows, stored = list(enumerate(lines)), {}, nearsets.stored

    def kept(df, name):
        out = stored(df, name)
        if name in ("near-around", "near-split", "near-shared"):
            rows[name] = out.collect()
        return out

    monkeypatch.setattr(nearsets, "stored", kept)
    monkeypatch.setattr(nearsets, "LARGE", 20)
    got = {(r["id"], i) for r in linededup.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect() for i in r["dropped"]}
    want = {(key, i) for key, _, i in brute(docs)[0]}
    assert got <= want and len(got) >= 0.97 * len(want) > 40
    places = [(r["head"], r["uid"]) for r in rows["near-split"]]
    assert len(places) == len(set(places)) < len(rows["near-around"]) / 2
    assert len(rows["near-shared"]) == len({r["uid"] for r in rows["near-shared"]}) <= len({uid for _, uid in places})


def test_similar_texts_share_a_rarest_shingle(spark):
    rng = random.Random(15)
    lines = ["".join(rng.choices("abc", k=4)) + "-the-template-that-all-of-these-lines-have-" + "".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(150)] + ["", "x", "abc"]
    df = spark.createDataFrame(list(enumerate(lines)), "uid long, text string").repartition(3)
    found = {i: set() for i in range(len(lines))}
    for r in nearsets.rarest(df, nearsets.of_characters, 0.8).collect():
        found[r["uid"]].add(r["s"])
    near = [(i, j) for i in range(len(lines)) for j in range(i) if len(grams(lines[i]) & grams(lines[j])) >= 0.8 * len(grams(lines[i]) | grams(lines[j]))]
    assert len(near) > 20 and all(found[i] & found[j] for i, j in near)
    assert all(len(found[i]) == len(grams(x)) - -(-len(grams(x)) * 4 // 5) + 1 for i, x in enumerate(lines))


def test_parity_bits_bound_the_difference():
    rng = random.Random(12)
    lines = ["".join(rng.choices("abcdef ", k=rng.randint(5, 900))) for _ in range(60)]
    every, n = nearsets._sets(lines, nearsets.of_characters)
    bits = nearsets.parities(every, len(lines)).view("uint8").reshape(len(lines), -1)
    for i in range(len(lines)):
        for j in range(i):
            differ = sum(bin(x ^ y).count("1") for x, y in zip(bits[i], bits[j], strict=True))
            assert differ <= len(grams(lines[i]) ^ grams(lines[j]))


def test_no_python_on_the_executors(spark, monkeypatch):
    """Also where buckets are wide, or large and split: all pairs' components, with neither mapInArrow nor a UDF."""
    plans, stored = [], nearsets.stored

    def planned(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    for module in (linededup, nearsets):
        monkeypatch.setattr(module, "stored", planned)
    monkeypatch.setattr(nearsets, "LARGE", 20)
    docs = corpus()
    found = linededup.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 15 and not [x for x in plans if "Arrow" in x or "Python" in x or "Pandas" in x]
    rows = found.collect()
    want, _ = brute(docs)
    got = {(r["id"], i) for r in rows for i in r["dropped"]}
    assert got <= {(key, i) for key, _, i in want} and len(got) > 60


def test_built_in_sets_are_those_of_all_shingles(spark):
    """Sizes, similarities and parity bits of texts of any length and any characters, also beyond 16 bits."""
    rng = random.Random(17)
    lines = ["".join(rng.choices("ab é\U0001f600", k=rng.randint(0, 40))) for _ in range(80)] + ["", "abc", "abcd", "abcde", "\U0010ffff", "abc\U0010fffe"]
    df = spark.createDataFrame(list(enumerate(lines)), "uid long, text string").repartition(3)
    sized = {r["uid"]: r for r in nearsets._sizes(df, nearsets.of_characters).collect()}
    assert all(sized[i]["len"] == len(grams(x)) for i, x in enumerate(lines))
    one, two = df.selectExpr("uid as a", "text as text_a"), df.selectExpr("uid as b", "text as text_b")
    for a, b, similarity in nearsets._compared(one.join(two, F.col("a") < F.col("b")), nearsets.of_characters).collect():
        x, y = grams(lines[a]), grams(lines[b])
        assert similarity == len(x & y) / len(x | y)
        differ = sum(bin((sized[a][f"x{k}"] ^ sized[b][f"x{k}"]) & (2**64 - 1)).count("1") for k in range(nearsets.PARITY))
        assert differ <= len(x ^ y) and (len(x ^ y) - differ) % 2 == 0 and (differ > 0 or len(x ^ y) < 4)


def test_bands_meet_as_often_as_similar_sets_agree(spark):
    """Pairs of similarity 0.8 to 0.85 share a band with 93 % or more, unlike lines of the same letters hardly ever."""
    rng = random.Random(18)
    lines, near = [], []
    for i in range(400):
        x = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=200))
        y = list(x)
        for at in rng.sample(range(0, 200, 8), 4):
            y[at : at + 1] = "Z"
        lines += [x, "".join(y)]
        s = len(grams(x) & grams(lines[-1])) / len(grams(x) | grams(lines[-1]))
        near += [i] if 0.8 <= s < 0.85 else []
    df = spark.createDataFrame([(i, 0, 1, x) for i, x in enumerate(lines)], "h1 long, h2 long, n long, text string").repartition(3, "h1", "h2")
    bands = {r["h1"]: [r[f"b{k}"] for k in range(nearsets.BANDS)] for r in nearsets.with_character_bands(df).collect()}
    shared = lambda i, j: any(x == y for x, y in zip(bands[i], bands[j], strict=True))
    assert len(bands) == 800 and len(near) > 300 and sum(shared(2 * i, 2 * i + 1) for i in near) >= 0.93 * len(near)
    assert not any(shared(2 * i, 2 * j) for i in range(400) for j in range(i))


def test_very_long_line(spark):
    rng = random.Random(13)
    long = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60_000))
    docs = [(1, long), (2, long[:200_000] + "Z" + long[200_001:]), (3, "short line here")]
    got = {r["id"]: r["dropped"] for r in linededup.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0], 3: []}
