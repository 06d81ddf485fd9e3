"""File discovery, text extraction and JSON reports."""

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.arrays import let
from millrace.functions.text import strip

SUFFIXES = ("pdf", "txt", "html", "htm", "md")
#: Elements whose content is not text of the page, removed one name at a time.
EXCLUDED = ("script", "style", "nav", "footer", "header")
#: Named character references that are decoded: those of HTML 4, ``apos``, and a plain blank for the one that does not break.
ENTITIES = {name: chr(point) for name, point in name2codepoint.items()} | {"apos": "'", "nbsp": " "}
_REFERENCE = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def scan_files(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """``(path, name, type, size, modified[, content])`` of all documents below a folder.

    Listing is distributed by the ``binaryFile`` source; content is read only if asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(base, r"\.([A-Za-z]+)$", 1))
    out = files.where(suffix.isin(*SUFFIXES)).select(
        "path",
        F.regexp_replace(base, r"\.[A-Za-z]+$", "").alias("name"),
        F.upper(suffix).alias("type"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        *(["content"] if content else []),
    )
    return out


def file_metadata(files: DataFrame, requested: DataFrame) -> DataFrame:
    """Metadata of each requested ``path``; ``missing`` marks paths that the scan did not find."""
    return requested.join(files, "path", "left").withColumn("missing", F.col("name").isNull())


def detect_changes(files: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``files(path, content)`` that ``known(path, hash)`` lacks or has with another hash, as new or modified."""
    hashed = files.withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))
    old = known.select("path", F.col("hash").alias("old_hash"))
    joined = hashed.join(old, "path", "left").where("old_hash IS NULL OR old_hash <> hash")
    return joined.withColumn("change", F.when(F.col("old_hash").isNull(), "new").otherwise("modified")).drop("old_hash")


def read_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, text)``: whole files as UTF-8 text."""
    rows = spark.read.text(paths, wholetext=True, recursiveFileLookup=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


# The references that most pages have and no others, the ampersand last, so that what it makes is not read again.
_COMMON = {"&nbsp;": ENTITIES["nbsp"], "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&amp;": "&"}
_OTHER = rf"&(?!(?:{'|'.join(c[1:] for c in _COMMON)}))[A-Za-z#]"


def decode_references(text: Column) -> Column:
    """Named and numeric character references as the characters they stand for, each once; others stay as they are.

    Texts that have none but the most common ones take plain replacements.
    """
    plain = text
    for reference, character in _COMMON.items():
        plain = F.replace(plain, F.lit(reference), F.lit(character))
    return F.when(text.rlike(_OTHER), decode_all_references(text)).otherwise(plain)


def decode_all_references(text: Column) -> Column:
    """:func:`decode_references` of any text, reference by reference."""
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def character(ref: Column) -> Column:
        body = F.substring(ref, 3, F.length(ref) - 3)
        hexadecimal = F.substring(ref, 3, 1).isin("x", "X")
        point = F.conv(F.when(hexadecimal, F.substring(body, 2, 8)).otherwise(body), 10, 10).cast("long")
        point = F.when(hexadecimal, F.conv(F.substring(body, 2, 8), 16, 10).cast("long")).otherwise(point)
        valid = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
        name = F.try_element_at(named, F.substring(ref, 2, F.length(ref) - 2))
        return F.coalesce(F.when(F.substring(ref, 2, 1) == "#", number).otherwise(name), ref)

    def joined(x: Column) -> Column:
        return F.array_join(F.transform(x["p"], lambda p, i: F.concat(p, F.coalesce(character(F.get(x["r"], i)), F.lit("")))), "")

    parts = F.struct(F.split(text, _REFERENCE, -1).alias("p"), F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)).alias("r"))
    return F.when(text.contains("&"), let(parts, joined)).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Text nodes joined by blanks: comments, excluded elements and markup dropped, white space collapsed."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for name in EXCLUDED:
        out = F.regexp_replace(out, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    return strip(F.regexp_replace(decode_references(out), r"\s+", " "))


def extract_text(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text of ``docs(id, type, raw, pages)`` by type, and the rows of unknown type apart.

    TXT and MD are text as they are, HTML and HTM go through :func:`html_to_text`, PDF takes an array of page texts
    joined by blank lines.
    """
    kind = F.upper("type")
    text = (
        F.when(kind.isin("TXT", "MD"), F.col("raw"))
        .when(kind.isin("HTML", "HTM"), html_to_text(F.col("raw")))
        .when(kind == "PDF", F.array_join(F.col("pages"), "\n\n"))
    )
    known = F.coalesce(kind.isin("TXT", "MD", "HTML", "HTM", "PDF"), F.lit(False))
    return docs.where(known).select("id", "type", text.alias("text")), docs.where(~known)


def read_json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file holding one array of records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def list_reports(spark: SparkSession, folder: str, schema: str, pattern: str = r"^[A-Za-z0-9_.-]+\.json$") -> DataFrame:
    """All report files, newest first; a file that cannot be parsed is listed with ``corrupt`` set."""
    rows = (
        spark.read.schema(f"{schema}, _corrupt_record string")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .json(folder)
        .select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    )
    rows = rows.where(F.col("file").rlike(pattern)).withColumn("corrupt", F.col("_corrupt_record").isNotNull())
    return rows.drop("_corrupt_record").orderBy(F.desc("file"))


def write_report(report: DataFrame, path: str) -> None:
    """Write a nested report as JSON, one record a line."""
    report.write.mode("overwrite").json(path)
