"""Line-first quality rules.

Every line with a word is judged alone, by rules on its punctuation, on navigation and on boilerplate; lines that fail
are removed, and a document that loses too much of its text by that is rejected as a whole.  Counts of the document's
words, symbols, repeated lines and repeated word windows are reported beside, and feed the base rule.

Most rules look at a line's form and so hold in any language: its end, its symbols, bars between items, links among its
words, digits among its characters, signs of ownership.  Two lists of phrases, in the four languages that the corpus is
in, are parameters for the rest.

A null or empty text has no words: its counts are 0, it fails the base rule, and its cleaned text is empty.
Equal texts get equal verdicts; rows are judged alone, so ties and repeated rows need no rule, and an empty
table gives an empty result.  ``clean`` reads the key and the text alone; ``cleaned_documents`` returns all other
columns, whatever their names and types, as they are.  A text is judged by one task, which holds its words and 3-word
windows, some 300 bytes per word.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import WORD, map_rows, rewrite_rows

SYMBOLS = "#*$%&|<>"
# notices and menu items in English, French, German and Spanish (fixed values)
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy",
    "subscribe to our newsletter", "terms of service", "terms of use",
    "accepter les cookies", "tous droits réservés", "cliquez ici", "politique de confidentialité", "abonnez-vous", "conditions d'utilisation", "mentions légales",
    "cookies akzeptieren", "alle rechte vorbehalten", "hier klicken", "datenschutzerklärung", "newsletter abonnieren", "nutzungsbedingungen",
    "aceptar cookies", "todos los derechos reservados", "haga clic aquí", "política de privacidad", "suscríbete", "términos de uso", "aviso legal",
)
NAVIGATION = (
    "back to top", "home", "log in", "login", "menu", "next page", "previous page", "share this", "sign in", "sign up", "skip to content",
    "accueil", "haut de page", "page suivante", "page précédente", "se connecter", "partager",
    "startseite", "nach oben", "nächste seite", "vorherige seite", "anmelden", "teilen", "zum inhalt",
    "inicio", "volver arriba", "página siguiente", "página anterior", "iniciar sesión", "compartir",
)
BARS = "|»›•·"
OWNED = "©®™"
LINK = r"://|^www\.|[^@]@[^@]+\.[^@]"
SENTENCE_END = r"""[.!?…:]["')\]]*([\x20\x09-\x0D]|$)"""
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class LineRules:
    symbols_per_100_words: int = 10
    shouts_per_100_words: int = 50
    bars: int = 3
    links_per_100_words: int = 50
    digits_per_100_chars: int = 40
    navigation_words: int = 6
    boilerplate_words: int = 12
    lost_percent: int = 30
    least_words: int = 50
    repeat_percent: int = 50
    boilerplate: tuple[str, ...] = BOILERPLATE
    navigation: tuple[str, ...] = NAVIGATION


def rule_broken(line: str, n_words: int, rules: LineRules) -> str | None:
    """The first rule that a line breaks.  The sentence end is searched last: most lines end with one."""
    if 100 * sum(map(line.count, SYMBOLS)) > rules.symbols_per_100_words * n_words or 100 * line.count("!!") > rules.shouts_per_100_words * n_words:
        return "punctuation"
    if sum(map(line.count, BARS)) >= rules.bars:
        return "navigation"
    raw = line.encode()
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    if 100 * digits > rules.digits_per_100_chars * (len(line) - sum(map(line.count, " \t\n\x0b\x0c\r"))):
        return "boilerplate"
    if ("@" in line or "://" in line or "www." in line) and 100 * sum(bool(_link(w)) for w in _words(line)) > rules.links_per_100_words * n_words:
        return "navigation"
    if n_words <= rules.boilerplate_words:
        low = line.translate(UPPER)
        if n_words <= rules.navigation_words and low.lstrip(" \t\n\x0b\x0c\r").startswith(rules.navigation):
            return "navigation"
        if any(x in low for x in rules.boilerplate) or any(x in line for x in OWNED):
            return "boilerplate"
    return None if _ended(line) else "punctuation"


_link, _words = re.compile(LINK).search, re.compile(WORD).findall
_ended = re.compile(SENTENCE_END).search


def repeated_words(words: list) -> int:
    """Words covered by 3-word windows that occur more than once in the list."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times, total, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def judge(raw: bytes | None, rules: LineRules) -> tuple:
    text = (raw or b"").decode()
    words = (raw or b"").split()  # of bytes: splits at ASCII white space alone
    lines = text.split("\n")
    n_dup, seen, kept = 0, set(), []
    line_chars = lost = removed = 0
    for line in lines:
        n = len(line.encode().split())
        if not n:
            kept.append(line)
            continue
        if line in seen:
            n_dup += 1
        seen.add(line)
        line_chars += len(line)
        if rule_broken(line, n, rules):
            lost += len(line)
            removed += 1
        else:
            kept.append(line)
    n_repeat = repeated_words(words)
    failed = len(words) < rules.least_words or 100 * n_repeat > rules.repeat_percent * len(words)
    ok = not failed and 100 * lost <= rules.lost_percent * line_chars
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    return len(words), chars, sum(map(text.count, SYMBOLS)), n_dup, n_repeat, failed, ok, removed, lost, "\n".join(kept)


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_removed_lines long, removed_chars long"
)


def clean(df: DataFrame, rules: LineRules = LineRules(), key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """Counts, verdict and, on request, the cleaned text of every document; no shuffle."""

    def make():
        def one(k, raw):
            *out, cleaned = judge(raw, rules)
            yield (k, *out, cleaned) if with_text else (k, *out)

        return one

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df, [key, text], f"{key} {kind}, {SCHEMA}" + ", cleaned string" * with_text, make)


def cleaned_documents(df: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """The rows that pass, with their texts cleaned and all other columns as they are."""

    def make():
        def some(raws):
            out = []
            for raw in raws:
                verdict = judge(raw, rules)
                out.append(verdict[6] and (verdict[-1] if verdict[7] else True))
            return out

        return some

    return rewrite_rows(df, text, make)


def sql(rules: LineRules = LineRules()) -> str:
    """The same, in DuckDB's SQL, over a view ``documents``."""
    lists = lambda xs, f: " OR ".join(f(x) for x in xs)
    symbols = "length(regexp_replace({0}, '[^#*$%&|<>]', '', 'g'))"
    shouts = "(length({0}) - length(replace({0}, '!!', ''))) / 2"
    quoted = lambda x: x.replace("'", "''")
    ended = quoted(SENTENCE_END)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), line AS (
  SELECT doc_id, ln, row_number() OVER (PARTITION BY doc_id, ln) AS nth, len(regexp_extract_all(ln, '[^\x20\x09-\x0D]+')) AS n,
         translate(ln, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln FROM d)
), judged AS (
  SELECT *, (100 * {symbols.format("ln")} > {rules.symbols_per_100_words} * n
    OR 100 * ({shouts.format("ln")}) > {rules.shouts_per_100_words} * n
    OR length(regexp_replace(ln, '[^{BARS}]', '', 'g')) >= {rules.bars}
    OR 100 * length(regexp_replace(ln, '[^0-9]', '', 'g')) > {rules.digits_per_100_chars} * length(regexp_replace(ln, '[\x20\x09-\x0D]', '', 'g'))
    OR 100 * len(list_filter(regexp_extract_all(ln, '[^\x20\x09-\x0D]+'), lambda x: regexp_matches(x, '{LINK}'))) > {rules.links_per_100_words} * n
    OR n <= {rules.navigation_words} AND ({lists(rules.navigation, lambda x: f"starts_with(ltrim(low, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{quoted(x)}')")})
    OR n <= {rules.boilerplate_words} AND ({lists(rules.boilerplate, lambda x: f"contains(low, '{quoted(x)}')")} OR regexp_matches(ln, '[{OWNED}]'))
    OR NOT regexp_matches(ln, '{ended}')) AS broken
  FROM line WHERE n > 0
), lines AS (
  SELECT doc_id, CAST(count(*) FILTER (nth > 1) AS BIGINT) AS n_dup_lines, CAST(count(*) FILTER (broken) AS BIGINT) AS n_removed_lines,
         CAST(sum(length(ln)) AS BIGINT) AS line_chars, CAST(coalesce(sum(length(ln)) FILTER (broken), 0) AS BIGINT) AS removed_chars
  FROM judged GROUP BY doc_id
), win AS (
  SELECT doc_id, i, w[i:i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n
  FROM (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1), range(3) r(j) GROUP BY doc_id
), base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST({symbols.format("text")} AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_removed_lines, 0) AS n_removed_lines,
         coalesce(removed_chars, 0) AS removed_chars, coalesce(line_chars, 0) AS line_chars
  FROM d LEFT JOIN lines ON d.doc_id = lines.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id
), failed AS (
  SELECT *, n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * removed_chars <= {rules.lost_percent} * line_chars AS kept, n_removed_lines, removed_chars
FROM failed"""
