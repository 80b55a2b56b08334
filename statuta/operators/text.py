"""Document text -> lines, blocks, sentences, units, passages, windows; one row's work stays in its row.

Blocks and sentences are cut inside the row: boundaries are marked by a control character that is
removed from the text first, and the marked text is split. Nothing is shuffled, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from statuta.functions import lexicon as L
from statuta.functions.columns import WHITE, let, literals, squeeze, strip, words

CUT, KIND, SECTION, HEAD, DOT = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"


def clean_text(c: Column) -> Column:
    """Plain newlines, no page-number lines, hyphenated line breaks re-joined, single spaces, at most one blank line."""
    t = F.translate(F.coalesce(c, F.lit("")), CUT + KIND + SECTION + HEAD + DOT, "")
    t = F.regexp_replace(F.regexp_replace(t, "\r\n", "\n"), "\r", "\n")
    t = F.regexp_replace(t, r"(?imdU)^\s*(?:page\s+)?\d+(?:\s+of\s+\d+)?\s*$", "")
    t = F.regexp_replace(t, r"(?U)(?=.-\n)(\w)-\n(\w)", "$1$2")
    t = F.regexp_replace(F.regexp_replace(t, r" [ \t]+|\t[ \t]*", " "), r"\n{3,}", "\n\n")
    return strip(t)


def is_heading_line(line: Column) -> Column:
    """Short, few words, no closing mark, and the shape of a heading."""
    return (F.length(line) <= 80) & (F.size(words(line)) <= 10) & ~line.rlike("[.;:]$") & line.rlike(L.HEADING_LINE)


def is_section_heading(line: Column) -> Column:
    """Numbered or roman, or all capitals of 2 to 10 words; salutations and the like never."""
    capitals = (line == F.upper(line)) & (line != F.lower(line)) & F.size(words(line)).between(2, 10)
    return ~strip(line).rlike("(?iU)" + L.NOT_A_SECTION) & (line.rlike("(?U)" + L.SECTION_HEADING) | capitals)


def segment_blocks(c: Column, cleaned: bool = False) -> Column:
    """array<struct<kind, text>> of a text: headings, numbered clauses and other text; ``cleaned`` if it has been through ``clean_text``."""

    def mark(raw: Column) -> Column:
        def with_line(line: Column) -> Column:
            return (
                F.when(line == "", F.lit(CUT))
                .when(is_heading_line(line), F.concat(F.lit(f"{CUT}heading{KIND}"), line, F.lit(CUT)))
                .when(line.rlike("(?U)" + L.CLAUSE_NUMBER), F.concat(F.lit(f"{CUT}clause{KIND}"), line))
                .otherwise(line)
            )

        return let(strip(raw), with_line)

    def block(piece: Column) -> Column:
        kind = F.when(piece.contains(KIND), F.substring_index(piece, KIND, 1)).otherwise("text")
        return F.struct(strip(kind).alias("kind"), squeeze(F.substring_index(piece, KIND, -1)).alias("text"))

    marked = F.array_join(F.transform(F.split(c if cleaned else clean_text(c), "\n"), mark), " ")
    return F.filter(F.transform(F.split(marked, CUT), block), lambda b: b["text"] != "")


def _fragments(body: Column) -> Column:
    safe = F.regexp_replace(body, r"(?<=\d)\.(?=\d)", DOT)
    pieces = F.split(safe, r"(?U)(?<=[.!?;])\s+")
    return F.filter(F.transform(pieces, lambda s: strip(F.replace(s, F.lit(DOT), F.lit(".")))), lambda s: s != "")


def _glue(fragments: Column, abbreviations: Sequence[str]) -> Column:
    """A fragment whose own last word is an abbreviation goes to the sentence before it."""
    short = literals(abbreviations)
    last = lambda s: F.lower(F.rtrim(F.substring_index(s, " ", -1), F.lit(".")))
    marked = F.transform(fragments, lambda s, i: F.concat(F.when((i > 0) & F.array_contains(short, last(s)), F.lit(" ")).otherwise(F.lit(CUT)), s))
    return F.filter(F.split(F.array_join(marked, ""), CUT), lambda s: F.length(s) > 2)


def split_sentences(c: Column, abbreviations: Sequence[str] = L.ABBREVIATIONS, cleaned: bool = False) -> Column:
    """array<string> of a text's sentences; blocks are boundaries, decimals and abbreviations are not."""
    return let(F.flatten(F.transform(segment_blocks(c, cleaned), lambda b: _fragments(b["text"]))), lambda f: _glue(f, abbreviations))


def block_sentences(body: Column, abbreviations: Sequence[str] = L.ABBREVIATIONS) -> Column:
    """Sentences of one block's text."""
    return let(_fragments(clean_text(body)), lambda f: _glue(f, abbreviations))


def line_sentences(line: Column, abbreviations: Sequence[str] = L.ABBREVIATIONS) -> Column:
    """``block_sentences`` of a line that was cleaned and squeezed before: only a bare page number is left to remove."""
    plain = let(line, lambda x: F.when(x.rlike(r"(?idU)^\s*(?:page\s+)?\d+(?:\s+of\s+\d+)?\s*$"), "").otherwise(x))
    return let(_fragments(plain), lambda f: _glue(f, abbreviations))


def clause_number(s: Column) -> Column:
    """The clause number at the beginning, '' where there is none."""
    return F.regexp_replace(strip(F.regexp_extract(s, "(?U)" + L.CLAUSE_NUMBER, 0)), r"[.)]+$", "")


def without_clause_number(s: Column) -> Column:
    return strip(F.regexp_replace(s, "(?U)" + L.CLAUSE_NUMBER, ""))


def is_boilerplate(s: Column) -> Column:
    """Too short, a salutation, letterhead, an annexure title, or mostly not letters."""

    def of(t: Column) -> Column:
        low = F.lower(t)
        letters = F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", ""))
        return (
            (F.length(t) < 25)
            | low.rlike("(?U)" + L.BOILERPLATE_START)
            | ((F.length(t) < 80) & low.contains(L.LETTERHEAD))
            | ((F.length(t) < 60) & low.rlike("(?U)" + L.ANNEX_START))
            | (letters < F.length(t) * 0.5)
        )

    return let(strip(s), of)


def blocks(docs: DataFrame, text: str = "document_text", key: str = "circular_id") -> DataFrame:
    """One row per block: the key, block_no from 0, kind, text."""
    return docs.select(key, F.posexplode(segment_blocks(F.col(text))).alias("block_no", "b")).select(key, "block_no", "b.kind", "b.text")


def units(docs: DataFrame, text: str = "document_text", key: str = "circular_id", default_section: str = "General", carry: Sequence[str] = ()) -> DataFrame:
    """One row per sentence: the key, order from 1, sentence, section (carried on), clause_number, and the columns to carry."""

    def mark(b: Column) -> Column:
        return (
            F.when((b["kind"] == "heading") & is_section_heading(b["text"]), F.concat(F.lit(SECTION), b["text"], F.lit(HEAD)))
            .when(b["kind"] == "heading", F.lit(""))
            .otherwise(F.concat(F.lit(CUT), b["text"]))
        )

    def of_section(part: Column) -> Column:
        section = F.when(part.contains(HEAD), strip(F.substring_index(part, HEAD, 1))).otherwise(F.lit(default_section))
        bodies = F.filter(F.split(F.substring_index(part, HEAD, -1), CUT), lambda x: x != "")

        def of_body(body: Column, name: Column) -> Column:
            sentences = line_sentences(without_clause_number(body))  # the number is taken once a body, not again for each sentence
            return let(clause_number(body), lambda number: F.transform(sentences, lambda s: F.struct(s.alias("sentence"), name.alias("section"), number.alias("clause_number"))))

        return let(section, lambda name: F.flatten(F.transform(bodies, lambda b: of_body(b, name))))

    parts = F.split(F.array_join(F.transform(segment_blocks(F.col(text)), mark), ""), SECTION)
    rows = docs.select(key, *carry, F.posexplode(F.flatten(F.transform(parts, of_section))).alias("pos", "u"))
    return rows.select(key, (F.col("pos") + 1).alias("order"), "u.sentence", "u.section", "u.clause_number", *carry)


def folded(docs: DataFrame, key: str, pieces: Column, fold: Callable[[list[dict]], Iterator[tuple[str, str]]]) -> DataFrame:
    """(key, place, text, section) of what ``fold`` makes of each row's array of structs, in one pass over it.

    A fold in a Column expression copies all that it holds at each step, which is quadratic in a long document; here a
    document takes time in proportion to its length. The pieces are cut by Column expressions before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, texts, sections = [], [], [], []
            for i in range(batch.num_rows):
                row = batch.column(1)[i].as_py()
                for place, (text, section) in enumerate(fold(row or [])):
                    keys.append(i), places.append(place), texts.append(text), sections.append(section)
            columns = [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(places, pa.int32()), pa.array(texts, pa.string()), pa.array(sections, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [key, "place", "text", "section"])

    schema = t.StructType([docs.schema[key], t.StructField("place", t.IntegerType()), t.StructField("text", t.StringType()), t.StructField("section", t.StringType())])
    return docs.select(key, pieces.alias("pieces")).mapInArrow(run, schema)


def passages(docs: DataFrame, text: str = "document_text", key: str = "circular_id", target: int = 900, least: int = 40) -> DataFrame:
    """Passages of about ``target`` characters inside clause boundaries: the key, passage_id, text, section, kind, place.

    Blocks are taken up until the next would pass the target; a heading ends a passage and names those after it.
    """

    def fold(blocks: list[dict]) -> Iterator[tuple[str, str]]:
        held, size, section = [], 0, "General"
        for b in blocks:
            heading = b["kind"] == "heading"
            if held and (heading or size + len(b["text"]) > target):
                yield " ".join(held), section
                held, size = [], 0
            if heading:
                section = b["text"]
            else:
                held.append(b["text"])
                size += len(b["text"])
        if held:
            yield " ".join(held), section

    packed = folded(docs, key, segment_blocks(F.col(text)), fold).filter(F.length("text") > least)
    return packed.select(key, F.format_string("p%03d", "place").alias("passage_id"), "text", "section", F.lit("document").alias("kind"), "place")


def obligation_passages(obligations: DataFrame, document_passages: DataFrame, key: str = "circular_id") -> DataFrame:
    """Obligations as passages, their ids going on after the document's."""
    from pyspark.sql.window import Window

    offset = document_passages.groupBy(key).agg(F.count(F.lit(1)).alias("offset"))
    place = F.coalesce("offset", F.lit(0)) + F.row_number().over(Window.partitionBy(key).orderBy("obligation_id")) - 1
    rendered = F.concat(
        F.lit("Obligation: "), F.col("title"), F.lit(". "), F.col("description"), F.lit(" Responsible: "), F.col("responsible_party"), F.lit(". Deadline: "),
        F.coalesce(F.nullif("deadline", F.lit("")), F.lit("not specified")), F.lit(". Severity: "), F.col("severity"), F.lit(". Evidence required: "), F.array_join("evidence_requirements", "; "), F.lit("."),
    )
    section = F.coalesce(F.nullif(F.substring("clause_reference", 1, 80), F.lit("")), F.lit("Obligation"))
    return obligations.join(offset, key, "left").select(key, F.format_string("o%03d", place).alias("passage_id"), rendered.alias("text"), section.alias("section"), F.lit("obligation").alias("kind"), place.alias("place"), "obligation_id")


def chunks(docs: DataFrame, text: str = "document_text", key: str = "circular_id", size: int = 6000, least: int = 200) -> DataFrame:
    """Heading-aware chunks: a heading closes a chunk once more than ``least`` characters are held, ``size`` always does."""

    def fold(lines: list[dict]) -> Iterator[tuple[str, str]]:
        held, n, section = [], 0, "General"
        for x in lines:
            if x["head"] and len("".join(held).strip(WHITE)) > least:
                yield "".join(held).strip(WHITE), section
                held, n, section = [x["line"]], len(x["line"]), x["head"]
                continue
            held.append(x["line"])
            n += len(x["line"])
            if n >= size:
                yield "".join(held).strip(WHITE), section
                held, n = [], 0
        if "".join(held).strip(WHITE):
            yield "".join(held).strip(WHITE), section

    lines = F.transform(F.split(F.col(text), r"(?<=\n)"), lambda x: F.struct(x.alias("line"), strip(F.regexp_extract(x, L.CHUNK_HEADING, 1)).alias("head")))
    return folded(docs, key, lines, fold).select(key, F.col("place").alias("chunk_no"), "text", F.col("section").alias("section_hint"))


def windows(docs: DataFrame, text: str = "document_text", key: str = "circular_id", width: int = 1200, least: int = 250, training: bool = False) -> DataFrame:
    """Sliding character windows over the squeezed text: the key, window_no, text.

    Scoring steps by half a width and keeps windows of ``least`` characters, or else the first; training steps
    by max(width/2, 200) and goes on to the end.
    """
    step = max(width // 2, 200) if training else width // 2

    def cut_up(flat: Column) -> Column:
        last = F.length(flat) - (1 if training else step + 1)
        starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))
        all_windows = F.transform(starts, lambda i: F.substring(flat, i + 1, F.lit(width)))
        long = F.filter(all_windows, lambda w: F.length(w) >= least)
        whole = F.when(flat == "", F.array().cast("array<string>")).otherwise(F.array(flat))
        if training:
            return F.when(F.length(flat) <= width, whole).otherwise(long)
        return F.when(F.length(flat) <= width, whole).when(F.size(long) > 0, long).otherwise(F.array(F.substring(flat, 1, width)))

    return docs.select(key, F.posexplode(let(squeeze(F.coalesce(F.col(text), F.lit(""))), cut_up)).alias("window_no", "text"))


def metadata(docs: DataFrame, text: str = "document_text", key: str = "circular_id", reference: str = L.REFERENCE) -> DataFrame:
    """Reference number in the first 15 lines (slug of at most 60), subject line in the first 25, or else the
    first substantive line that is not all capitals, or else the second line."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), strip), lambda s: s != "")

    def first(a: Column, n: int, test) -> Column:
        return F.get(F.filter(F.slice(a, 1, n), test), F.lit(0))

    def of(a: Column) -> Column:
        ref = F.regexp_extract(first(a, 15, lambda s: s.rlike("(?i)" + reference)), "(?i)" + reference, 0)
        subject = F.regexp_extract(first(a, 25, lambda s: s.rlike(r"(?i)^(?:sub(?:ject)?|re)\s*[:\-]")), r"(?i)^(?:sub(?:ject)?|re)\s*[:\-]\s*(.*)$", 1)
        plain = first(a, 25, lambda s: (F.length(s) > 20) & (s != F.upper(s)))
        return F.struct(ref.alias("reference"), F.coalesce(F.nullif(strip(subject), F.lit("")), plain, F.get(a, F.lit(1))).alias("subject"))

    from statuta.functions.fields import slug

    return docs.select(key, let(lines, of).alias("m")).select(key, "m.reference", F.nullif(slug(F.col("m.reference")), F.lit("")).alias("slug"), "m.subject")
