"""Fill-in-the-middle: texts cut at two unit boundaries, their parts reordered behind sentinels."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: A unit is a word with the space before it, or what space is left at the end: units cover a text without gaps.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def _ends(text: str, unit: regex.Pattern) -> array:
    """End offsets of the units, with 0 in front: four bytes a unit, and no copies of the text."""
    ends = array("I", (0,))
    ends.extend(m.end() for m in unit.finditer(text))
    return ends


def _seeds(key: str, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def rebuilt(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text behind an output: the parts between its sentinels, in their old order."""
    if form == "plain":
        return output
    first, second, third = sentinels if form == "psm" else (sentinels[1], sentinels[0], sentinels[2])
    if not output.startswith(first):
        raise ValueError(f"output doesn't begin with {first}")
    a, _, rest = output[len(first) :].partition(second)
    b, _, middle = rest.partition(third)
    return a + middle + b if form == "psm" else b + middle + a


def _transform(rate: int, spm_rate: int, seed: int, sentinels: tuple[str, str, str], digests: bool) -> Callable:
    """Over batches of (key, text): the columns of :func:`fill_in_middle`, or those of :func:`digests`."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        unit = regex.compile(UNIT)
        p, s, m = sentinels
        for keys, texts in batches:
            counts, forms, outputs, again = np.zeros(len(texts), np.int64), [], [], []
            prefixes, middles = [], []
            for row, (key, text) in enumerate(zip(keys, texts, strict=True)):
                h1, h2, h3, h4 = _seeds(key, seed)
                ends = _ends(text, unit)
                n = counts[row] = len(ends) - 1
                if not text or h3 % 100 >= rate or any(x in text for x in sentinels):
                    form, output, prefix, middle = "plain", text, None, None
                else:
                    one, two = h1 % (int(n) + 1), h2 % (int(n) + 1)
                    a, b = ends[min(one, two)], ends[max(one, two)]
                    prefix, middle = a, b - a
                    if h4 % 100 < spm_rate:
                        form, output = "spm", f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
                    else:
                        form, output = "psm", f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"
                forms.append(form)
                prefixes.append(prefix)
                middles.append(middle)
                if digests:
                    outputs.append(_sha256(output))
                    again.append(_sha256(rebuilt(output, form, sentinels)))
                else:
                    outputs.append(output)
            made = {"n": counts, "form": forms, "prefix_chars": pd.array(prefixes, "Int64"), "middle_chars": pd.array(middles, "Int64")}
            yield pd.DataFrame(made | ({"output_sha256": outputs, "restored_sha256": again} if digests else {"output": outputs}))

    return run


_CUTS = "n long, form string, prefix_chars long, middle_chars long"


def _applied(docs: DataFrame, id_col: str, text_col: str, rate: int, spm_rate: int, seed: int, sentinels: tuple[str, str, str], digests: bool) -> DataFrame:
    """Each row as a struct ``row``, beside the struct ``cut``."""
    if len({*sentinels}) != 3 or not all(sentinels) or any(a != b and a in b for a in sentinels for b in sentinels):
        raise ValueError(f"three different sentinels are needed, none inside another, not {sentinels}")
    if any(x[:k] == y[-k:] for x in sentinels for y in sentinels for k in range(1, min(len(x), len(y)))):
        raise ValueError(f"no sentinel may begin as one ends: {sentinels}")

    schema = f"{_CUTS}, output_sha256 string, restored_sha256 string" if digests else f"{_CUTS}, output string"
    made = _transform(rate, spm_rate, seed, sentinels, digests)

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return made(batches)

    udf = F.pandas_udf(cut, schema)
    key, text = F.coalesce(docs[f"`{id_col}`"].cast("string"), F.lit("")), F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))
    whole = F.struct(*(docs[f"`{c}`"] for c in ([id_col] if digests else docs.columns)))
    return docs.select(whole.alias("row"), udf(key, text).alias("cut"))


def fill_in_middle(docs: DataFrame, *, rate: int = 50, spm_rate: int = 80, seed: int = 42, sentinels: tuple[str, str, str] = SENTINELS, cut_col: str = "cut", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each text transformed, and a struct ``cut_col`` of n, form, prefix_chars and middle_chars.

    A text is cut at two of its units' ends, drawn from the SHA-256 of seed and id. Of 100 texts about ``rate`` are cut,
    and of these ``spm_rate`` become suffix, prefix, middle (``spm``), the rest prefix, suffix, middle (``psm``). Empty
    texts, and texts that hold a sentinel, stay ``plain``; lengths are code points, null if plain. A null text counts as
    empty and becomes the empty text; a null id has no digits; rows of one id are cut by the same draws. Texts of any
    length are taken whole: a task holds a batch of them (``spark.sql.execution.arrow.maxBytesPerBatch``) and four bytes
    for each unit of one. An empty table gives no rows; a column named ``cut_col`` is refused, all others stay.
    """
    if cut_col in docs.columns:
        raise ValueError(f"docs have a column {cut_col} already; name another cut_col")
    rows = _applied(docs, id_col, text_col, rate, spm_rate, seed, sentinels, digests=False)
    kept = [(F.col("cut.output") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return rows.select(*kept, F.col("cut").dropFields("output").alias(cut_col))


def digests(docs: DataFrame, *, rate: int = 50, spm_rate: int = 80, seed: int = 42, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): digests in place of the outputs of
    :func:`fill_in_middle`, and of the texts rebuilt from them (:func:`rebuilt`). Other columns are ignored."""
    rows = _applied(docs, id_col, text_col, rate, spm_rate, seed, sentinels, digests=True)
    return rows.select(F.col("row").getField(id_col).alias(id_col), "cut.*")


def restore(rows: DataFrame, *, sentinels: tuple[str, str, str] = SENTINELS, cut_col: str = "cut", text_col: str = "text") -> DataFrame:
    """The rows of :func:`fill_in_middle` with their texts as they were, without ``cut_col``."""
    p, s, m = (F.lit(x) for x in sentinels)

    def between(first, second):
        """(after ``first`` up to ``second``, after it up to the middle's mark, the middle)."""
        text = F.col(f"`{text_col}`")
        bare = F.substring(text, F.length(first) + 1, F.length(text))
        one = F.call_function("substring_index", bare, second, F.lit(1))
        rest = F.substring(bare, F.length(one) + F.length(second) + 1, F.length(bare))
        two = F.call_function("substring_index", rest, m, F.lit(1))
        return one, two, F.substring(rest, F.length(two) + F.length(m) + 1, F.length(rest))

    a, b, mid = between(p, s)
    c, d, centre = between(s, p)
    form = F.col(f"`{cut_col}`.form")
    old = F.when(form == "psm", F.concat(a, mid, b)).when(form == "spm", F.concat(d, centre, c)).otherwise(F.col(f"`{text_col}`"))
    return rows.withColumn(text_col, old).drop(cut_col)
