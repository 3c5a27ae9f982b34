"""Line-first quality rules, in DataFrame operations only.

Every line of a text is judged by itself: navigation (bars between short entries), punctuation (symbols or exclamation marks
where words should be, or a short stub without an end mark) and boilerplate (a standing phrase). Lines that fail go; a
document that loses more than LOST of its non-blank characters is rejected, as is one that fails the base rules (under 20 words, or
over 30 in 100 words inside repeated 8-word windows). All of it is computed per row: no shuffle, nothing to skew.

Repeated windows are found by 64-bit keys first. Texts whose keys are all different have none; the others are decided by the
windows themselves, so no digest decides.

Defined results: null text has no words, counts 0 and is rejected; an empty text too; null ids and repeated rows are kept as
they are; no rows give no rows; other columns are ignored (or kept, in clean).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.llm.common import packed, unpacked

WINDOW, LEAST_WORDS, REPEATED, LOST = 8, 20, 30, 0.5
SYMBOLS = "#*$%&|<>"
BLANK = r"[\x20\x09-\x0D]+"
#: Standing phrases of English, German, French and Spanish pages, in lower case; short lines with one of them go. A parameter of
#: what is measured: other languages bring their own.
PHRASES = (
    "all rights reserved", "accept cookies", "use of cookies", "enable javascript", "terms of use", "terms of service", "privacy policy",
    "click here", "sign up", "log in to", "subscribe to our", "lorem ipsum", "share on facebook", "back to top",
    "alle rechte vorbehalten", "cookies akzeptieren", "javascript aktivieren", "datenschutzerklärung", "nutzungsbedingungen", "hier klicken",
    "newsletter abonnieren", "jetzt anmelden", "zurück nach oben",
    "tous droits réservés", "accepter les cookies", "activer javascript", "politique de confidentialité", "conditions d'utilisation",
    "cliquez ici", "mentions légales", "haut de page",
    "todos los derechos reservados", "aceptar cookies", "activar javascript", "política de privacidad", "términos de uso", "haga clic aquí",
    "aviso legal", "volver arriba",
)
#: Marks that end a line of prose, of Latin, CJK, Arabic and Indic scripts.
END_MARKS = ".!?:;,…\"'”’)\\]。？！；：，、」』）؟۔।"


def _without(text: Column, char: str) -> Column:
    return F.replace(text, F.lit(char), F.lit(""))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def _letters(text: Column) -> Column:
    """Characters that aren't blank."""
    return F.length(F.regexp_replace(text, BLANK, ""))


def measures(line: Column) -> Column:
    """What the rules look at: the line, its words, bars, exclamation marks and symbols, each counted once."""
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    bars = F.octet_length(line) - F.octet_length(_without(line, "|"))
    marks = F.octet_length(line) - F.octet_length(_without(line, "!"))
    return F.struct(line.alias("line"), words.alias("words"), bars.alias("bars"), marks.alias("marks"), F.regexp_count(line, F.lit("[#*$%&<>]")).alias("symbols"))


def fails(m: Column, phrases=PHRASES) -> Column:
    """True for a line (measures) that is navigation, badly punctuated or boilerplate. Blank lines pass: they weigh nothing."""
    line, words, bars, marks, symbols = (m[x] for x in ("line", "words", "bars", "marks", "symbols"))
    navigation = (bars >= 2) & (bars * 5 >= words)
    noisy = ((symbols >= 3) & (symbols * 2 >= words)) | ((marks >= 3) & (marks * 3 >= words))
    stub = (words > 0) & (words < 4) & ~line.rlike(rf"[{END_MARKS}][\x20\x09-\x0D]*\z")
    boilerplate = (words <= 12) & (words > 0) & F.lower(line).rlike("|".join(phrases))
    return navigation | noisy | stub | boilerplate


def line_fails(line: Column) -> Column:
    return fails(measures(line))


def measured(docs: DataFrame) -> DataFrame:
    """docs with _words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = WINDOW
    out = docs.withColumn("_t", text).withColumn("_w", _words(F.col("_t"))).withColumn("n_words", F.size("_w").cast("long"))
    # One key a window; a text of too few words has none.
    at = F.sequence(F.lit(0), F.size("_w") - n)
    out = out.withColumn("_h", F.when(F.col("n_words") >= n, F.transform("_w", lambda w: F.xxhash64(w))))
    for step in (1, 2, 4):  # pairs, fours and eights of words
        size = F.size("_h") - step
        out = out.withColumn("_h", F.zip_with(F.slice("_h", F.lit(1), size), F.slice("_h", F.lit(1 + step), size), lambda a, b: F.xxhash64(a, b)))
    suspect = F.size(F.array_distinct("_h")) < F.size("_h")
    # The windows of a suspect text in order of content; those equal to a neighbour are repeated.
    pairs = F.transform(at, lambda i: F.struct(F.slice("_w", i + 1, n).alias("s"), i.alias("i")))
    out = out.withColumn("_s", F.when(suspect, F.array_sort(pairs)))
    last = F.size("_s") - 1
    same = lambda i, j: F.get(F.col("_s"), i)["s"] == F.get(F.col("_s"), j)["s"]
    twice = F.filter(F.sequence(F.lit(0), last), lambda i: F.coalesce(((i > 0) & same(i, i - 1)) | ((i < last) & same(i, i + 1)), F.lit(False)))
    out = out.withColumn("_r", F.when(F.col("_s").isNotNull(), F.array_sort(F.transform(twice, lambda i: F.get(F.col("_s"), i)["i"]))))
    # The words they cover: each adds its n words, less what the one before it covered.
    gaps = F.zip_with(F.slice("_r", F.lit(2), F.greatest(F.size("_r") - 1, F.lit(0))), F.slice("_r", F.lit(1), F.greatest(F.size("_r") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(n)))
    covered = F.when(F.size("_r") > 0, F.aggregate(gaps, F.lit(n), lambda s, g: s + g)).otherwise(F.lit(0))
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))

    out = out.withColumn("_lines", F.transform(F.split("_t", "\n"), measures))
    full = F.transform(F.filter("_lines", lambda m: m["words"] > 0), lambda m: m["line"])
    out = out.withColumn("_full", full)
    out = out.withColumn("n_dup_lines", (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"))
    out = out.withColumn("clean_text", F.array_join(F.transform(F.filter("_lines", lambda m: ~fails(m)), lambda m: m["line"]), "\n"))
    out = out.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long")).withColumn("n_symbols", F.regexp_count("_t", F.lit(f"[{SYMBOLS}]")).cast("long"))
    out = out.withColumn("clean_chars", _letters(F.col("clean_text")).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("clean_chars") >= (1 - LOST) * F.col("word_chars")))


def verdicts(docs: DataFrame) -> DataFrame:
    return measured(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_chars")


def clean(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with the columns of docs; their failed lines are gone from text, and n_chars follows where it exists."""
    # Rows are let through by a generator: a filter would be pushed below the columns it needs, and bring all their expressions along.
    out = measured(packed(docs, text=F.col("text"))).withColumn("_pass", F.explode(F.array_repeat(F.lit(1), F.col("kept").cast("int"))))
    new = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return unpacked(out, docs, **new)


def op6(spark, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
