"""Text and line functions as column expressions; they stay in the JVM and are planned by Catalyst.

Patterns start with (?U), as white space, digits and word bounds mean Unicode's here.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words, phrases and patterns that tell kinds of lines and documents apart.
HEADING_WORDS = "Chapter|Part|Section|Rule|Schedule|Annexure|Appendix|Process|Procedure|Workflow|Steps"
BOILERPLATE_PHRASES = ["THE GAZETTE OF INDIA", "GAZETTE OF INDIA", "EXTRAORDINARY", "PUBLISHED BY AUTHORITY", "REGD. NO.", "REGISTERED NO.", "PART II", "SEC. 3"]
QUESTION_WORDS = "who|what|when|where|why|how|which|whether|is|are|can|could|should|does|do|did|will|would"
PROCEDURE_TITLE = "procedure|process|workflow|step-wise|stepwise"
PROCEDURE_START = "process|procedure|workflow|steps"
GAZETTE_ID = r"(?U)^CG-[A-Z]+-[A-Z]-\d{8}-\d+$"
GAZETTE_NUMBER = r"(?U)^\d+\s+GI/\d{4}\s*\(\d+\)$"
NUMBERED_HEADING = r"(?U)^\d+(\.\d+)*[\). -]+[A-Z]"
CAPITALS_HEADING = r"^[A-Z][A-Z0-9 &,()/-]{8,}$"
CLAUSE_START = r"(?U)^(\d+(\.\d+)*|[a-zA-Z]\)|\([a-zA-Z0-9ivx]+\)|[IVX]+\.)\s+"
NUMBERED_LINE = r"(?U)^\s*\d+\s*[\).]\s*\S+"
QUESTION_NUMBER = r"(?U)^\s*\d+\s*[\).]\s*"
ANSWER_START = r"(?Ui)^(ans|answer)\s*[:.：-]"
SENTENCE_GAP = r"(?U)(?<=[.!?;:])\s+"
SUBCLAUSE_GAP = r"(?U)\s+(?=(?:\([a-zA-Z0-9ivx]+\)|[a-zA-Z]\)|\d+\.)\s+)"
LINE_END = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85\u2028\u2029]"
BLANK_LINE = r"(?U)\n\s*\n"
#: Boilerplate as a whole line; white space inside is of any length.
_WHOLE_LINE = "(?U)^(?:" + "|".join(x.removeprefix("(?U)^").removesuffix("$") for x in (r"\d+", GAZETTE_ID, GAZETTE_NUMBER)) + ")$"
_PHRASES = "|".join(x.replace(".", r"\.") for x in BOILERPLATE_PHRASES)


#: White space of all kinds.
SPACES = "".join(chr(x) for x in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACES))


def one_space(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def normalize_text(c: Column) -> Column:
    """Line ends as \\n, runs of blanks as one, at most one empty line, no white space at the ends."""
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def clean_cell(c: Column) -> Column:
    return F.replace(normalize_text(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))


def lines_of(c: Column) -> Column:
    return F.split(c, LINE_END)


def blocks_of(c: Column) -> Column:
    """Stripped parts of a text between blank lines, without empty ones."""
    return F.filter(F.transform(F.split(c, BLANK_LINE), strip), lambda x: x != "")


#: A word of each phrase, and more characters than any other boilerplate line has: few lines need the patterns.
_PHRASE_WORDS = ("GAZETTE", "EXTRAORDINARY", "AUTHORITY", "REGD.", "REGISTERED", "PART", "SEC.")
_SHORT = 120


def is_boilerplate(line: Column) -> Column:
    return stripped_is_boilerplate(strip(line))


def stripped_is_boilerplate(line: Column) -> Column:
    """is_boilerplate of a line without white space at its ends."""

    def told(upper: Column) -> Column:
        named = reduce(or_, (upper.contains(word) for word in _PHRASE_WORDS))
        whole = upper.rlike(_WHOLE_LINE) & ((F.length(line) <= _SHORT) | named | upper.rlike(r"(?U)^\d+$"))
        return (upper == "") | whole | (named & F.regexp_replace(upper, r"(?U)\s+", " ").rlike(_PHRASES))

    return F.exists(F.array(F.upper(line)), told)


def is_heading(line: Column) -> Column:
    return F.exists(F.array(strip(line)), lambda x: has_heading_shape(x) & ~stripped_is_boilerplate(x))


def has_heading_shape(line: Column) -> Column:
    """is_heading of a line that is no boilerplate and has no white space at its ends."""
    shaped = line.rlike(rf"(?U)^({HEADING_WORDS})\b") | line.rlike(NUMBERED_HEADING) | line.rlike(CAPITALS_HEADING)
    return (F.length(line) <= 140) & (line != "") & shaped


def clean_heading(line: Column) -> Column:
    c = one_space(line)
    c = F.regexp_replace(c, r"(?Us)\s*\.?-\s*\(?\d+\)?.*$", "")
    c = F.regexp_replace(c, r"(?Us)\s+[–-]\s+.*$", "")
    return F.regexp_replace(F.substring(c, 1, 140), r"^[ .-]+|[ .-]+$", "")


def is_clause_start(line: Column) -> Column:
    """Judged on the line without white space at its ends; a marker needs white space after it."""
    return strip(line).rlike(CLAUSE_START)


def is_numbered_line(line: Column) -> Column:
    return strip(line).rlike(NUMBERED_LINE)


def is_question(line: Column) -> Column:
    return stripped_is_question(strip(line))


def stripped_is_question(line: Column) -> Column:
    """is_question of a line without white space at its ends."""
    begins = lambda x: x.endswith("?") | x.rlike(rf"(?Ui)^({QUESTION_WORDS})\b")
    return F.exists(F.array(F.regexp_replace(line, QUESTION_NUMBER, "")), lambda x: begins(x) & (x != "") & ~stripped_is_boilerplate(x))


def is_answer_start(line: Column) -> Column:
    return strip(line).rlike(ANSWER_START)


def split_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(strip(c), SENTENCE_GAP), strip), lambda x: x != "")


def split_subclauses(c: Column) -> Column:
    return F.filter(F.transform(F.split(strip(c), SUBCLAUSE_GAP), strip), lambda x: x != "")


def document_profile(source: Column, title: Column, sample: Column) -> Column:
    """faq, procedure or section; sample is the start of the first pages."""
    named, start = F.lower(F.concat_ws(" ", source, title)), F.lower(sample)
    whole = F.concat_ws(" ", named, start)
    return (
        F.when(whole.contains("frequently asked") | (whole.contains("faq") & whole.rlike(r"(?U)\bfaqs?\b")), "faq")
        .when(named.rlike(rf"(?U)\b({PROCEDURE_TITLE})\b") | start.rlike(rf"(?U)^\s*({PROCEDURE_START})\b"), "procedure")
        .otherwise("section")
    )


def profile_sample(pages: Column) -> Column:
    return F.array_join(F.transform(F.slice(pages, 1, 2), lambda p: F.substring(p["text"], 1, 1500)), " ")


def infer_title(source: Column, pages: Column) -> Column:
    """The first line of 8 to 180 characters, else the file's stem in title case."""
    long = lambda c: F.filter(lines_of(c), lambda x: F.length(x) >= 8)
    lines = F.flatten(F.transform(pages, lambda p: F.transform(long(p["text"]), strip)))
    fit = F.filter(lines, lambda x: (F.length(x) >= 8) & (F.length(x) <= 180))
    stem = F.translate(F.regexp_replace(source, r"(?<=.)\.[^.]*$", ""), "_-", "  ")
    return F.coalesce(F.get(fit, F.lit(0)), F.initcap(stem))


def safe_filename(c: Column) -> Column:
    """The base name with only plain characters; null where nothing usable is left."""
    base = strip(F.regexp_replace(F.regexp_replace(c, r"(?s)^.*/", ""), r"(?s)^.*\\", ""))
    name = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._ -]", "_"), r"\s+", " ")
    return F.when(~name.isin("", ".", ".."), name)


def citation_label(source: Column, first: Column, last: Column) -> Column:
    one = F.concat(source, F.lit(", page "), first.cast("string"))
    span = F.concat(source, F.lit(", pages "), first.cast("string"), F.lit("-"), last.cast("string"))
    return F.when(first.isNull(), source).when(first.eqNullSafe(last), one).otherwise(F.coalesce(span, source))


def source_payload(score: Column, source: Column, first: Column, last: Column, chunk_index: Column, text: Column) -> Column:
    """What an answer shows of a hit: label, pages, place, score to four places, text."""
    return F.struct(
        source.alias("source"), citation_label(source, first, last).alias("display_source"), first.alias("page_start"), last.alias("page_end"),
        chunk_index.alias("chunk_index"), F.round(score, 4).alias("score"), text.alias("text"),
    )


def table_block(rows: Column, index: Column) -> Column:
    """A table as a block: cleaned cells, rows without any text dropped, the first row as headers if others follow."""
    cleaned = F.filter(F.transform(rows, lambda r: F.transform(r, clean_cell)), lambda r: F.exists(r, lambda x: x != ""))
    text = normalize_text(F.array_join(F.transform(cleaned, lambda r: F.array_join(r, " | ")), "\n"))
    many = F.size(cleaned) > 1
    none = F.array().cast("array<string>")
    return F.when(
        F.size(cleaned) > 0,
        F.struct(
            F.lit("table").alias("type"), text.alias("text"), index.cast("int").alias("table_index"),
            F.when(many, F.get(cleaned, F.lit(0))).otherwise(none).alias("headers"),
            F.when(many, F.slice(cleaned, 2, F.greatest(F.size(cleaned) - 1, F.lit(0)))).otherwise(cleaned).alias("rows"),
        ),
    )


def table_row_text(headers: Column, row: Column, index: Column) -> Column:
    """Row n: header: cell; ... with empty cells left out."""
    named = F.transform(
        row, lambda x, i: F.when(x != "", F.concat(F.coalesce(F.nullif(strip(F.get(headers, i)), F.lit("")), F.concat(F.lit("Column "), (i + 1).cast("string"))), F.lit(": "), x))
    )
    joined = F.when(F.size(headers) > 0, F.array_join(F.filter(named, lambda x: x.isNotNull()), "; ")).otherwise(F.array_join(F.filter(row, lambda x: x != ""), " | "))
    return F.concat(F.lit("Row "), (index + 1).cast("string"), F.lit(": "), F.coalesce(F.nullif(joined, F.lit("")), F.lit("empty row")))


def table_context(heading: Column, index: Column, headers: Column) -> Column:
    """The lines that stand before every row of a table."""
    names = F.filter(F.transform(headers, strip), lambda x: x != "")
    return F.concat_ws(
        "\n", F.when(heading != "", F.concat(F.lit("Section: "), heading)), F.concat(F.lit("Table "), (index + 1).cast("string")),
        F.when(F.size(names) > 0, F.concat(F.lit("Columns: "), F.array_join(names, ", "))),
    )


def history_line(role: Column, content: Column) -> Column:
    return F.concat(F.initcap(role), F.lit(": "), content)
