"""Readers: nested JSON, flat CSV, text files, links in pages; and the normalised flat dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from statuta.functions.columns import strip

FLAT = ("obligation_id", "circular_id", "title", "description", "responsible_party", "required_action", "deadline", "deadline_type", "intermediary_types", "evidence_requirements", "severity", "keywords")
FLAT_SCHEMA = t.StructType([t.StructField(c, t.StringType()) for c in FLAT])


def read_json_dataset(spark: SparkSession, path: str, row_schema: t.StructType = FLAT_SCHEMA) -> DataFrame:
    """Rows of a JSON file that is {metadata, obligations: [...]} or a plain list."""
    wrapped = t.StructType([*row_schema.fields, t.StructField("obligations", t.ArrayType(row_schema))])
    raw = spark.read.schema(wrapped).option("multiLine", True).json(path)
    one = F.struct(*[F.col(f.name) for f in row_schema.fields])
    return raw.select(F.inline(F.coalesce("obligations", F.array(one))))


def read_csv_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns text."""
    return spark.read.schema(FLAT_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files, UTF-8 where valid, else Latin-1."""
    files = spark.read.format("binaryFile").load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select("path", text.alias("text"))


def landing_records(texts: DataFrame, title: Column, kinds: list[str]) -> DataFrame:
    """Text records with id, title, length and types, ready to be written."""
    from statuta.functions.fields import slug

    return texts.select(slug(title).alias("circular_id"), title.alias("title"), F.col("text").alias("document_text"), F.length("text").alias("length"), F.array(*[F.lit(k) for k in kinds]).cast("array<string>").alias("intermediary_types"))


def absolute(href: Column, base: Column) -> Column:
    return F.when(href.rlike("^https?:"), href).otherwise(F.concat(base, F.when(F.startswith(href, F.lit("/")), F.lit("")).otherwise(F.lit("/")), href))


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, pos, href, title) of the anchors of each page; script links and blank titles are left out."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))).alias("pos", "a"))
    href = F.regexp_extract("a", r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1)
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("a", r"(?is)>(.*)</a>", 1), r"<[^>]+>", ""), r"\s+", " "))
    rows = found.select("page_id", "pos", href.alias("href"), title.alias("title"))
    return rows.filter(~F.lower("href").rlike("^javascript:") & (F.col("href") != "") & (F.col("title") != ""))


def listing(pages: DataFrame, kind: str, html: str = "html", base: str = "") -> DataFrame:
    """(page_id, pos, date, title, detail_url, circular_type): table rows of two cells and more, the link in the last."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("pos", "row"))
    cells = rows.withColumn("cells", F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))).filter(F.size("cells") >= 2)
    last = F.element_at("cells", -1)
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"\s+", " "))
    href = F.regexp_extract(last, r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']", 1)
    out = cells.select("page_id", "pos", plain(F.get("cells", F.lit(0))).alias("date"), plain(last).alias("title"), href.alias("href"))
    out = out.filter((F.col("href") != "") & ~F.lower("href").rlike("^javascript:") & (F.col("title") != ""))
    return out.select("page_id", "pos", "date", "title", absolute(F.col("href"), F.lit(base)).alias("detail_url"), F.lit(kind).alias("circular_type"))


def attachment_url(html: Column, primary: str, fallback: str = r"""(?i)href\s*=\s*["']([^"']+\.pdf)["']""") -> Column:
    """The first match of the primary pattern, else of the fallback, else null (group 1 of each)."""
    return F.coalesce(F.nullif(F.regexp_extract(html, primary, 1), F.lit("")), F.nullif(F.regexp_extract(html, fallback, 1), F.lit("")))


def newest_per_slug(entries: DataFrame, slug: Column, position: Column) -> DataFrame:
    """The first entry of each slug, a trailing _number of which does not count."""
    from pyspark.sql.window import Window

    rows = entries.withColumn("base_slug", F.regexp_replace(slug, r"_\d+$", ""))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("base_slug").orderBy(position))).filter("_n = 1").drop("_n")


def normalised(flat: DataFrame) -> DataFrame:
    """The flat dataset with lists split at ; and trimmed, a clause reference, and default states."""
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), strip), lambda x: x != "")
    lists = {c: split(F.col(c)) for c in ("intermediary_types", "evidence_requirements", "keywords")}
    return flat.withColumns(lists).withColumns({"clause_reference": F.concat_ws(" — ", "circular_id", "title"), "status": F.lit("active"), "evidence_status": F.lit("red"), "version": F.lit(1)})
