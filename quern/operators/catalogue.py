"""A catalogue of documents: trial and author names, tags, states, context lines, citations, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import fold
from quern.operators.library import stripped

# States of a note that no longer holds, in the two languages notes are kept in.
NOT_CURRENT = ["superado", "superseded", "rascunho", "draft", "obsoleto", "historico"]
# What a line of a session holds that only tells of a failed call.
NOISE = ["rate limit", "429", "resource_exhausted", "quota", "error code", "❌ erro"]
# Words that mean yes, and names that stand for no author.
YES = ["1", "true", "sim", "yes"]
NO_AUTHOR = ["autor-desconhecido", "desconhecido"]
UNKNOWN = "Autor desconhecido"


def trial_fault(name: Column) -> Column:
    """The fault number of a trial's name (a fault of 0 to 7, a mode, perhaps .csv); null for any other name."""
    return F.when(name.rlike(r"^F[0-7][LM](\.csv)?\z"), F.substring(name, 2, 1).cast("int"))


def trial_mode(name: Column) -> Column:
    return F.when(trial_fault(name).isNotNull(), F.substring(name, 3, 1))


def clean_field(value: Column, most: int = 500) -> Column:
    """A metadata value on one line without unreadable characters, cut at ``most``; null becomes empty. Marks stay as composed as they came."""
    line = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), "[\\s\\x00\\uFFFD]+", " "))
    return F.trim(F.substring(line, 1, most))


def authors_of(value: Column) -> Column:
    """Distinct authors of a list parted by semicolons, in order; one unknown author where it names none."""
    named = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ";"), lambda a: clean_field(a, 200)), lambda a: a != ""))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(UNKNOWN)))


def year_of(value: Column) -> Column:
    """A year of 1800 to 2099; null for anything else."""
    return F.when(clean_field(value, 20).rlike(r"^(18|19|20)[0-9]{2}$"), clean_field(value, 20).cast("int"))


def citation(authors: Column, year: Column, title: Column) -> Column:
    """The first author, et al. for more, the year or s.d. where there is none, and the title."""
    return F.concat(F.element_at(authors, 1), F.when(F.size(authors) > 1, " et al.").otherwise(""), F.lit(" ("), F.coalesce(year.cast("string"), F.lit("s.d.")), F.lit(") — "), title)


def author_index(files: DataFrame, file: str, authors: str) -> DataFrame:
    """(token, author, files): which canonical authors a word of three letters or more of a name stands for, and how many files each wrote."""
    each = files.select(file, F.explode(authors).alias("author")).distinct().groupBy("author").agg(F.count("*").alias("files"))
    return each.select(F.explode(F.array_distinct(F.filter(F.split(fold(F.col("author")), "[^a-z0-9]+"), lambda t: F.char_length(t) >= 3))).alias("token"), "author", "files")


def tag(value: Column) -> Column:
    """A tag in lower case without marks, its words joined by hyphens."""
    bare = F.regexp_replace(fold(F.trim(value)), "^#+", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9-]+", "-"), "^-+|-+$", "")


def note_title(value: Column) -> Column:
    """A title that can name a file, at most 120 characters."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r'[<>:"/\\|?*\n\r\t]', ""), r"^[ .]+|[ .]+$", "")
    return F.substring(F.when(bare == "", "Nota sem titulo").otherwise(bare), 1, 120)


def without_noise(text: Column) -> Column:
    """A session's text without the lines that only tell of failed calls."""
    told = lambda line: F.exists(F.array(*[F.lit(n) for n in NOISE]), lambda n: F.contains(F.lower(line), n))
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~told(line)), "\n")


def standing(status: Column) -> Column:
    """A note's state in lower case; a note without one is active."""
    known = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(known == "", "ativo").otherwise(known)


def truth(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(YES), F.lit(False))


def listed(value: Column) -> Column:
    """The items of a list parted by commas, empty ones left out; none for null."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def page_list(first: Column, last: Column) -> Column:
    """All pages from the first to the last; only the first if the last is missing or before it, none if the first is not positive."""
    return F.when(first > 0, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))


def context_lines(fields: list[tuple[str, Column, int]]) -> Column:
    """A line for each labelled value that is neither null nor empty, values cut at their limits."""
    lines = []
    for label, value, most in fields:
        short = clean_field(value.cast("string"), most)
        lines.append(F.when(short != "", F.concat(F.lit(f"{label}: "), short)))
    return F.concat_ws("\n", *lines)


def retrieval_text(context: Column, text: Column) -> Column:
    return F.when(context == "", text).otherwise(F.concat(F.lit("Contexto documental deterministico:\n"), context, F.lit("\n\nTrecho original:\n"), text))


def audited(citations: Column, usable: Column, insufficient: Column) -> Column:
    """The citations an audit let stand: those it names as F1 to Fn.

    If it names none they are dropped where the audit found them insufficient, else the first three
    stand; if none of its labels can be read, all stand.
    """
    places = F.filter(F.transform(usable, lambda u: F.regexp_extract(F.trim(u), "^[Ff]([0-9]+)$", 1).try_cast("int")), lambda k: k.between(1, F.size(citations)))
    named = F.filter(citations, lambda c, i: F.array_contains(places, (i + 1).cast("int")))
    none = F.slice(citations, 1, F.when(insufficient, 0).otherwise(3))
    return F.when(F.size(usable) == 0, none).when(F.size(places) == 0, citations).otherwise(named)


def shown_number(value: Column, places: int) -> Column:
    """A number with fixed places, a hyphen where there is none."""
    return F.when(value.isNull(), "-").otherwise(F.format_string(f"%.{places}f", value))


def shown_p(value: Column) -> Column:
    return F.when(value.isNull(), "-").when(value < 0.0001, "p<0.0001").otherwise(F.concat(F.lit("p="), F.format_string("%.4f", value)))


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("-")) for c in cells]), F.lit(" |"))


def found_year(text: Column) -> Column:
    """The first year of 1990 to 2039 in a text, 0000 where there is none."""
    year = F.regexp_extract(text, r"\b(199[0-9]|20[0-3][0-9])\b", 1)
    return F.when(F.coalesce(year, F.lit("")) == "", "0000").otherwise(year)


def found_title(text: Column, most: int = 120) -> Column:
    """The first line of more than 20 characters, cut at ``most``; empty where there is none."""
    long = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), stripped), lambda line: F.char_length(line) > 20)
    return F.substring(F.coalesce(F.get(long, 0), F.lit("")), 1, most)


def resolved(author: Column, title: Column, year: Column, no_year: Column) -> Column:
    """Whether a record names an author and a title, and a year or that there is none."""
    name = F.lower(F.trim(F.coalesce(author, F.lit(""))))
    dated = F.coalesce(F.trim(year), F.lit("")).rlike("^(19|20)[0-9]{2}$") | F.coalesce(no_year, F.lit(False))
    return (name != "") & ~name.isin(NO_AUTHOR) & (F.trim(F.coalesce(title, F.lit(""))) != "") & dated


def differences(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, with ``side``: missing or unexpected. Equal sets give no row."""
    return expected.subtract(found).withColumn("side", F.lit("missing")).unionByName(found.subtract(expected).withColumn("side", F.lit("unexpected")))


def cited(rows: DataFrame, group: list[str], source: str, order: str) -> DataFrame:
    """The distinct sources of each group, numbered by first mention, and the line of each in a list of references."""
    first = rows.groupBy(*group, source).agg(F.min(order).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_first", source))
    return first.select(*group, source, place.alias("place")).withColumn("line", F.concat(F.col("place").cast("string"), F.lit(". "), F.col(source).cast("string")))


def snippets(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """One row for each verbatim text: its key (16 hexadecimal digits), the first place it stands at and how often it is used."""
    key = F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 16).alias("key")
    first = F.min(F.struct(*order)).alias("first")
    return rows.where(F.col(text).isNotNull()).groupBy(key).agg(first, F.count("*").alias("uses")).select("key", "first.*", "uses")
