"""Line-first cleaning: rules judge lines, failing lines go, documents that lose too much go.

A line fails
- for punctuation: symbols or exclamation marks on many of its words, or a stub of up to three
  words without a closing mark;
- as navigation: bars between the words, three or more items of up to three words on average
  between separators, bracketed items and little else, or capitalised words without a closing mark;
- as boilerplate: a notice phrase, in one of four languages, in a line of at most NOTICE_CHARS.

DataFrame functions only; one pass over the text, no shuffle.

Defined results: a null text counts as empty (no words, base_failed, not kept); repeated
rows each get their own row; an empty table gives an empty result; further columns pass through,
whatever their names, but in `clean` give way to the columns of ADDED, which `passed` does not add.
Long texts take time in proportion to words * log(words) and memory in proportion to words.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fresh, let, plain, table, words

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
SPACE, WORD = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"
NOTICE_CHARS = 160
#: Signs that stand alone between the items of a menu or path (fixed values).
SEPARATORS = "|/\\\\·•∙‣»«›‹>→⇒~–—"
MARKS = f"[#*$%&|<>!\\[{SEPARATORS}]"
CLOSED = f"[.!?:;\"'»”)…。！？]{SPACE}*$"
#: Phrases that only notices have, in English, French, German and Spanish (fixed values).
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "this work is licensed",
    "terms of use",
    "terms of service",
    "terms and conditions",
    "privacy policy",
    "cookie policy",
    "cookie settings",
    "we use cookies",
    "uses cookies",
    "accept cookies",
    "accept all cookies",
    "enable javascript",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "click here",
    "read more",
    "share on facebook",
    "share this article",
    "copyright (c)",
    "copyright ©",
    "skip to content",
    "tous droits réservés",
    "mentions légales",
    "politique de confidentialité",
    "conditions générales",
    "conditions d'utilisation",
    "utilise des cookies",
    "utilisons des cookies",
    "accepter les cookies",
    "cliquez ici",
    "lire la suite",
    "abonnez-vous à notre",
    "inscrivez-vous à notre",
    "alle rechte vorbehalten",
    "allgemeine geschäftsbedingungen",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "verwendet cookies",
    "verwenden cookies",
    "cookies akzeptieren",
    "klicken sie hier",
    "weiterlesen",
    "abonnieren sie",
    "todos los derechos reservados",
    "aviso legal",
    "política de privacidad",
    "política de cookies",
    "términos y condiciones",
    "condiciones de uso",
    "utiliza cookies",
    "utilizamos cookies",
    "aceptar cookies",
    "haga clic aquí",
    "leer más",
    "suscríbete a nuestro",
    "suscríbase a nuestro",
)
ADDED = ("clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "base_failed", "kept")


def repeat_words(w: Column) -> Column:
    """Words of w inside five-word windows that occur twice or more, the first included.

    Windows are compared by 64-bit hashes within one document. Most documents have no
    repeated hash and stop there; only the others sort (hash, place) pairs.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            last = F.size(p) - 1
            twin = lambda j: ((j > 0) & (p[F.greatest(j - 1, F.lit(0))]["h"] == p[j]["h"])) | ((j < last) & (p[F.least(j + 1, last)]["h"] == p[j]["h"]))
            return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), twin), lambda j: p[j]["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end"))
        return F.aggregate(let(pairs, places), start, step, lambda a: a["n"])

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(w[i + k] for k in range(WINDOW))))
    judged = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
    return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(let(hashes, judged))


def line_fails(line: Column, marked: Column, symbol_share: float = 0.25, bar_share: float = 0.25, shout_share: float = 0.25, item_words: int = 3, title_share: float = 0.8) -> Column:
    """Whether a line fails by the rules above. A line without words passes: it parts paragraphs.

    marked: whether the document holds any of MARKS; only then are marks sought by line.
    """

    def by_counts(n: Column) -> Column:
        bars = F.regexp_count(line, F.lit("\\|"))
        symbols = F.regexp_count(line, F.lit(SYMBOLS + "+"))
        shouts = F.regexp_count(line, F.lit("!{2,}"))
        parted = let(F.regexp_count(line, F.lit(f"(?<!{WORD})[{SEPARATORS}]+(?!{WORD})")), lambda k: (k >= 2) & (n - k <= item_words * (k + 1)))
        boxed = line.contains("[") & (F.regexp_count(line, F.lit("\\[[^\\[\\]]+\\]")) >= 3) & (4 * F.length(F.regexp_replace(line, "\\[[^\\[\\]]+\\]", "")) <= F.length(line))
        return (bars > bar_share * n) | (symbols > symbol_share * n) | (shouts > shout_share * n) | parted | boxed

    def unclosed(ws: Column) -> Column:
        titled = F.size(F.filter(ws, lambda w: w.rlike("^\\p{Lu}"))) >= title_share * F.size(ws)
        return (F.size(ws) > 0) & ((F.size(ws) <= 3) | titled)

    counted = line.rlike(MARKS) & let(F.size(words(line)), lambda n: (n > 0) & by_counts(n))
    short = F.length(line) <= NOTICE_CHARS
    stub = ~line.rlike(CLOSED) & let(words(line), unclosed)
    notice = let(F.lower(line), lambda low: reduce(or_, (low.contains(p) for p in BOILERPLATE)))
    return (marked & counted) | (short & (stub | notice))


def _judged(docs: DataFrame, text: str) -> tuple[DataFrame, str]:
    """docs with one more column, whose name is returned: counts of words (w) and lines (l), and n_symbols."""

    def by_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    def by_lines(t: Column, ls: Column, fails: Column) -> Column:
        full = F.filter(ls, lambda x: x.rlike(WORD))
        twins = F.when(F.size(ls) < 2, F.lit(0)).otherwise(let(full, lambda f: F.size(f) - F.size(F.array_distinct(f))))
        failing, passed = F.filter(ls, lambda x, i: fails[i]), F.filter(ls, lambda x, i: ~fails[i])
        lost = F.size(words(F.array_join(failing, " ")))
        return F.struct(
            twins.cast("long").alias("n_dup_lines"),
            F.when(F.exists(fails, lambda x: x), lost).otherwise(F.lit(0)).cast("long").alias("lost_words"),
            F.when(F.exists(fails, lambda x: x), F.array_join(passed, "\n")).otherwise(t).alias("clean_text"),
        )

    def judged(x: Column) -> Column:
        t, marked = x["t"], x["m"]
        lines = let(F.split(t, "\n"), lambda ls: let(F.transform(ls, lambda line: line_fails(line, marked)), lambda fails: by_lines(t, ls, fails)))
        symbols = F.when(marked, F.regexp_count(t, F.lit(SYMBOLS))).otherwise(F.lit(0))
        return F.struct(let(words(t), by_words).alias("w"), lines.alias("l"), symbols.cast("long").alias("n_symbols"))

    (name,) = fresh(docs, "judged")
    whole = F.coalesce(F.col(text), F.lit(""))
    judgement = let(F.struct(whole.alias("t"), whole.rlike(MARKS).alias("m")), judged)
    # exploding a one-element array keeps the optimizer from computing any of it twice
    return docs.select("*", F.explode(F.array(judgement)).alias(name)), name


def _verdicts(name: str, max_loss: float) -> tuple[Column, Column]:
    """(base_failed, kept)."""
    n = F.col(name)["w"]["n_words"]
    base = (n < 10) | (100 * F.col(name)["w"]["n_repeat_words"] > 20 * n)
    return base, ~base & (F.col(name)["l"]["lost_words"] <= max_loss * n)


def clean(docs: DataFrame, text: str = "text", max_loss: float = 0.5) -> DataFrame:
    """docs and the columns ADDED: the text that is left, the counts, and the verdict.

    kept: base rules passed, and failing lines held at most max_loss of the words.
    """
    docs, back = plain(docs, text=text)
    judged, name = _judged(docs, "text")
    base, kept = _verdicts(name, max_loss)
    w, lines = F.col(name)["w"], F.col(name)["l"]
    added = [lines["clean_text"], w["n_words"], w["word_chars"], F.col(name)["n_symbols"], lines["n_dup_lines"], w["n_repeat_words"], lines["lost_words"], base, kept]
    return back(judged.select(*docs.columns, *[c.alias(n) for n, c in zip(ADDED, added, strict=True)]), *ADDED)


def passed(docs: DataFrame, text: str = "text", max_loss: float = 0.5) -> DataFrame:
    """The documents that are kept, without their failing lines."""
    docs, back = plain(docs, text=text)
    judged, name = _judged(docs, "text")
    kept = judged.where(_verdicts(name, max_loss)[1])
    return back(kept.withColumn("text", F.when(F.col("text").isNotNull(), F.col(name)["l"]["clean_text"])))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "base_failed", "kept")


_NOTICE_SQL = " OR ".join("contains(low, '{}')".format(p.replace("'", "''")) for p in BOILERPLATE)
OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
part AS (SELECT doc_id, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS ws, lower(line) AS low, regexp_extract_all(line, '\\[[^\\[\\]]+\\]') AS boxes,
    len(regexp_extract_all(line, '\\|')) AS bars, len(regexp_extract_all(line, '[#*$%&|<>]+')) AS symbols, len(regexp_extract_all(line, '!!+')) AS shouts FROM line),
counted AS (SELECT *, len(ws) AS n, len(list_filter(ws, lambda x: regexp_full_match(x, '[{SEPARATORS}]+'))) AS parts, coalesce(list_sum(list_transform(boxes, lambda x: length(x))), 0) AS boxed,
    len(list_filter(ws, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) AS titled, regexp_matches(line, '[.!?:;"''»”)…。！？][\\x20\\x09-\\x0D]*$') AS closed FROM part),
judged AS (SELECT doc_id, n, line, n > 0 AND (bars > 0.25 * n OR symbols > 0.25 * n OR shouts > 0.25 * n OR (parts >= 2 AND n - parts <= 3 * (parts + 1))
    OR (len(boxes) >= 3 AND 4 * (length(line) - boxed) <= length(line)) OR (length(line) <= {NOTICE_CHARS} AND ((NOT closed AND (n <= 3 OR titled >= 0.8 * n)) OR {_NOTICE_SQL}))) AS fails FROM counted),
lost AS (SELECT doc_id, coalesce(sum(n) FILTER (WHERE fails), 0) AS lost_words, count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines FROM judged GROUP BY doc_id),
gram AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5))),
again AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM gram WHERE times > 1) GROUP BY doc_id),
whole AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, lost_words::BIGINT AS lost_words FROM d JOIN lost USING (doc_id) LEFT JOIN again USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_words <= 0.5 * n_words AS kept FROM whole
"""
