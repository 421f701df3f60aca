"""Text expressions: folding, normalising, tokens, excerpts, names, secrets, citations."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD = "\ue000"  # stands for a character that becomes several


def _decompositions() -> tuple[str, str, list[str], list[str]]:
    """By compatibility decomposition without marks: (characters, what each becomes, marks last), and those that become several with these."""
    marked, plain, marks, many, parts = [], [], [], [], []
    for code in [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x30000)]:  # neither Hangul syllables nor private use
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if base == "":
            marks.append(char)
        elif base != char:
            marked.append(char)
            plain.append(base if len(base) == 1 else SPREAD)
            if len(base) > 1:
                many.append(char)
                parts.append(base)
    return "".join(marked + marks), "".join(plain), many, parts


MARKED, PLAIN, MANY, PARTS = _decompositions()

#: Hangul syllables and, by their arithmetic, the three letters of each (the last may be none: a space here).
HANGUL = "".join(map(chr, range(0xAC00, 0xD7A4)))
LETTERS = ["".join(chr(0x1100 + i // 588) for i in range(11172)), "".join(chr(0x1161 + i % 588 // 28) for i in range(11172)), "".join(chr(0x11A7 + i % 28) if i % 28 else " " for i in range(11172))]

# Words that carry no topic, in the four languages served.
STOP_WORDS = ["the", "and", "that", "for", "with", "this", "was", "les", "des", "une", "que", "qui", "der", "die", "und", "den", "los", "las", "del", "por"]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(text: Column) -> Column:
    """Lower case in whole compatibility decomposition, without marks: ligatures, wide forms, fractions and syllables come apart."""
    low = F.lower(text)
    several = F.map_from_arrays(F.split(F.lit("".join(MANY)), ""), F.split(F.lit("\x01".join(PARTS)), "\x01"))

    def apart(char: Column) -> Column:
        one = F.translate(char, MARKED, PLAIN)
        letters = F.concat(*[F.translate(char, HANGUL, part) for part in LETTERS])
        return F.when(one == SPREAD, F.coalesce(F.try_element_at(several, char), char)).when(char.between(HANGUL[0], HANGUL[-1]), F.rtrim(letters)).otherwise(one)

    # texts of single bytes hold no marks; few others hold what comes apart
    plain = bound(F.translate(low, MARKED, PLAIN), lambda p: F.when(F.contains(p, F.lit(SPREAD)) | p.rlike("[\uac00-\ud7a3]"), F.array_join(F.transform(F.split(low, ""), apart), "")).otherwise(p))
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(plain)


def squeeze(text: Column) -> Column:
    """Folded text with white space runs as single spaces."""
    return F.trim(F.regexp_replace(fold(text), r"\s+", " "))


def searchable(text: Column) -> Column:
    """Folded ASCII letters and digits, parted by single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(text), r"[^a-z0-9\s]", " "), r"\s+", " "))


def terms(text: Column) -> Column:
    """All search terms of a text, in order."""
    return F.array_remove(F.split(fold(text), "[^a-z0-9]+"), "")


def once(df: DataFrame, **values: Column) -> DataFrame:
    """df with columns worked out once a row, however often they are used further on."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def query_terms(text: Column, most: int = 40) -> Column:
    """Distinct terms of three letters or more that carry a topic, the first ``most``."""
    told = F.filter(terms(text), lambda t: (F.char_length(t) >= 3) & ~t.isin(STOP_WORDS))
    return F.slice(F.array_distinct(told), 1, most)


def case_variants(term: Column) -> Column:
    """The spellings a case-sensitive containment search tries."""
    return F.array_distinct(F.array(term, F.lower(term), F.initcap(term), F.upper(term)))


def clean_extracted(text: Column) -> Column:
    """Extracted page text: no NUL, words joined over line hyphens, single spaces, at most one blank line."""
    text = F.regexp_replace(F.regexp_replace(text, "\x00", ""), r"(\p{L})-\r?\n(\p{L})", "$1$2")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\r?\n ?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r" +([,.;:!?])", "$1"))


def excerpt(text: Column, limit: int, least_percent: int = 55) -> Column:
    """At most ``limit`` characters, cut after the last sentence mark past that percentage of it, else at a space."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(flat, 1, limit)
    sentence = F.regexp_extract(head, r"^(.*[.!?])", 1)
    word = F.regexp_replace(head, r"\s\S*\z", "")
    return F.when(F.char_length(flat) <= limit, flat).when(100 * F.char_length(sentence) >= least_percent * limit, sentence).otherwise(word)


def shorten(text: Column, limit: int, note: str = " …") -> Column:
    """Whole words up to limit, with a note where something is cut."""
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit), r"\s\S*\z", ""), F.lit(note)))


def best_sentence(text: Column, wanted: Column, least: int = 40) -> Column:
    """The first sentence of ``least`` characters or more with the most wanted terms."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.char_length(s) >= least)
    scored = F.transform(sentences, lambda s, i: F.struct(F.size(F.array_intersect(terms(s), wanted)).alias("score"), (-i).alias("place"), s.alias("text")))
    return F.array_max(scored)["text"]


def slug(text: Column, limit: int) -> Column:
    """Folded words joined by hyphens, cut at a word."""
    full = F.regexp_replace(searchable(text), " ", "-")
    return F.when(F.char_length(full) <= limit, full).otherwise(F.regexp_replace(F.substring(full, 1, limit + 1), r"-[^-]*\z", ""))


def mask_secrets(text: Column) -> Column:
    """Keys and assigned passwords with all but six characters hidden."""
    text = F.regexp_replace(text, r"(?i)\b((?:password|passwd|secret|token|api_key)\s*[=:]\s*)(\S{1,6})\S*", "$1$2***")
    text = F.regexp_replace(text, r"\b(AKIA[0-9A-Z]{2})[0-9A-Z]{10,}", "$1***")
    return F.regexp_replace(text, r"\b((?:sk|ghp|gsk)[-_][A-Za-z0-9]{3})[A-Za-z0-9_-]{10,}", "$1***")


def has_secret(text: Column) -> Column:
    return mask_secrets(text) != text


def page_ranges(pages: Column) -> Column:
    """Sorted distinct page numbers as runs: 3-5, 8."""
    ordered = F.array_sort(F.array_distinct(pages))
    tagged = F.transform(ordered, lambda p, i: F.struct((p - i).alias("run"), p.alias("page")))
    runs = F.array_sort(F.array_distinct(F.transform(tagged, lambda t: t["run"])))

    def show(run: Column) -> Column:
        own = F.transform(F.filter(tagged, lambda t: t["run"] == run), lambda t: t["page"])
        low, high = F.array_min(own).cast("string"), F.array_max(own).cast("string")
        return F.when(low == high, low).otherwise(F.concat(low, F.lit("-"), high))

    return F.array_join(F.transform(runs, show), ", ")


def markers(answer: Column, letter: str = "E") -> Column:
    """Evidence markers like [E1] in an answer, in order, once each."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(rf"\[({letter}\d+)\]"), F.lit(1)))


def safe_name(name: Column) -> Column:
    """A file name without path parts or characters that file systems refuse."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"[^\w.\- ]", "_"), r"^\.+", "")


def cited_name(file: Column) -> Column:
    """author_title_words_year.pdf as (author, title, year, citation)."""
    parts = F.split(F.regexp_replace(file, r"\.\w+$", ""), "_")
    year = F.regexp_extract(file, r"((?:19|20)\d\d)", 1)
    author = F.initcap(F.replace(parts[0], F.lit("-"), F.lit(" ")))
    middle = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~p.rlike(r"^(19|20)\d\d$"))
    return F.struct(author.alias("author"), F.array_join(middle, " ").alias("title"), F.nullif(year, F.lit("")).cast("int").alias("year"), F.concat(author, F.lit(" ("), F.when(year != "", year).otherwise("n.d."), F.lit(")")).alias("citation"))


def code_blocks(text: Column) -> Column:
    """(language, code) of fenced blocks: a fence has three or more backticks or tildes, at most three spaces before it, and ends at one of its kind and length."""
    fence = r"(?m)^ {0,3}(?<f>`{3,}|~{3,})[ \t]*(?<l>[^\s`]*)[^\n`]*\n(?<c>(?:(?! {0,3}\k<f>)[^\n]*\n)*?) {0,3}\k<f>[`~]*[ \t]*$"
    part = lambda k: F.regexp_extract_all(text, F.lit(fence), F.lit(k))
    return F.zip_with(part(2), part(3), lambda a, b: F.struct(a.alias("language"), b.alias("code")))


def wikilinks(text: Column) -> Column:
    """Targets of [[links]] without alias and anchor, once each."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda t: F.trim(F.regexp_replace(t, r"[|#].*$", ""))))


def trust_level(host: Column) -> Column:
    """A for public bodies and universities, B for organisations, C for companies, D for the rest."""
    return F.when(host.rlike(r"\.(gov|edu|int)(\.[a-z]{2})?$"), "A").when(host.rlike(r"\.org(\.[a-z]{2})?$"), "B").when(host.rlike(r"\.com(\.[a-z]{2})?$"), "C").otherwise("D")
