"""Quality rules: line-first cleaning, then rejection of documents that lose too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import five_word_hashes, let, words

# What sites repeat in English, German, French and Spanish; a line that is nothing else is boilerplate.
_PHRASES = (
    "home", "menu", "search", "login", "log in", "sign in", "sign up", "register", "subscribe", "share", "next", "previous", "back to top", "read more", "skip to content", "cookie policy", "privacy policy", "terms of (use|service)", "all rights reserved", "click here", "copyright",
    "startseite", "suche", "anmelden", "abmelden", "registrieren", "abonnieren", "teilen", "weiter", "nach oben", "mehr lesen", "weiterlesen", "impressum", "datenschutz", "nutzungsbedingungen", "alle rechte vorbehalten", "kontakt",
    "accueil", "recherche", "connexion", "inscription", "partager", "suivant", "haut de page", "lire la suite", "mentions l.gales", "tous droits r.serv.s", "politique de confidentialit.",
    "inicio", "buscar", "iniciar sesi.n", "registrarse", "suscribirse", "compartir", "siguiente", "anterior", "leer m.s", "aviso legal", "todos los derechos reservados", "pol.tica de privacidad",
)
BOILERPLATE = rf"(?i)^\W*({'|'.join(_PHRASES)})\W*$"
#: A document is rejected if it keeps less than this share of its words.
KEEP_SHARE = 0.5


def line_fails(line: Column) -> Column:
    """Whether a line with a word breaks a rule.

    Punctuation: over a tenth of its characters are ``#*$%&|<>``, or at least four words of which over half end in two
    or more exclamation or question marks. Navigation: three or more parts between bars, of four words a part at most.
    Boilerplate: the line is one of the fixed phrases. The rules count characters and words, never letters of a language.
    """
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    symbols = F.length(F.regexp_replace(line, r"[^#*$%&|<>]+", ""))
    shouted = F.regexp_count(line, F.lit(r"[!?]{2,}(?=[\x20\x09-\x0D]|$)"))
    bars = F.length(F.regexp_replace(line, r"[^|]+", ""))
    # a plain line fails the first test of each rule, so that little is counted
    marked = line.rlike(r"[#*$%&|<>]") & (symbols * 10 > F.length(line))
    loud = line.rlike(r"[!?]{2}") & (n_words >= 4) & (shouted * 2 > n_words)
    barred = F.contains(line, F.lit("|")) & (bars >= 2) & (n_words - bars <= 4 * (bars + 1))
    return marked | loud | barred | line.rlike(BOILERPLATE)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _repeat_words(tokens: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the text, the first included."""

    def covered(g: Column) -> Column:
        placed = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            twin = F.filter(p, lambda x, j: (F.get(p, j - 1)["h"] == x["h"]) | (F.get(p, j + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        def width(at: Column) -> Column:
            steps = F.zip_with(at, F.slice(at, 2, 1 << 30), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

        return let(placed, lambda p: let(places(p), width))

    hashes = let(tokens, lambda w: F.when(F.size(w) >= 6, five_word_hashes(w)).otherwise(F.array().cast("array<bigint>")))
    return let(hashes, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0).cast("bigint")))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (id and text) with counts, verdicts and the cleaned text.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_clean_words, clean_text and kept.
    A null text counts as empty: no words, base_failed, not kept. Each row is judged alone, so repeated rows get equal
    verdicts and nothing ties; a text of one very long line is one line. Lines without a word never fail. An empty table
    gives an empty result; other columns are left out, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(F.col(id_col), text.alias(text_col)).withColumn("_w", words(F.col(text_col))).withColumn("_lines", F.filter(F.split(text_col, "\n", -1), _has_word))
    second = first.select(
        id_col,
        text_col,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text_col, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text_col, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).cast("long").alias("n_repeat_words"),
        F.concat_ws("\n", F.filter(F.split(text_col, "\n", -1), lambda x: ~(_has_word(x) & line_fails(x)))).alias("clean_text"),
    )
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    third = second.withColumn("base_failed", failed).withColumn("n_clean_words", F.size(words(F.col("clean_text"))).cast("long"))
    return third.withColumn("kept", ~F.col("base_failed") & (F.col("n_clean_words") >= F.col("n_words") * F.lit(KEEP_SHARE)))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` that pass, with the lines that failed taken out of their texts; other columns stay, whatever their names.

    Null, empty and very short texts go; of repeated rows all stay or all go; an empty table gives an empty result.
    """
    packed = docs.select(F.struct(*(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("_row"), docs[f"`{text_col}`"].alias("_text"))
    # a filter isn't moved below a row number, so that the rules are evaluated once a row
    judged = assess(packed, "_row", "_text").withColumn("_at", F.monotonically_increasing_id()).where("kept and _at >= 0")
    return judged.select(*((F.col("clean_text") if c == text_col else F.col("_row")[f"c{i}"]).alias(c) for i, c in enumerate(docs.columns)))
