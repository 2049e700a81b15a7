"""Format detection, hashing and admission of input documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.config import Limits

#: Input formats in declaration order.
FORMATS = (
    "docx", "pptx", "html", "image", "pdf", "asciidoc", "md", "csv", "xlsx", "xml_uspto", "xml_jats", "mets_gbs",
    "json_document", "audio", "vtt", "latex",
)
OUTPUT_FORMATS = ("md", "json", "yaml", "html", "html_split_page", "text", "doctags")
#: File extensions of each format.
EXTENSIONS = {
    "docx": ("docx", "dotx", "docm", "dotm"),
    "pptx": ("pptx", "potx", "ppsx", "pptm", "potm", "ppsm"),
    "pdf": ("pdf",),
    "md": ("md",),
    "html": ("html", "htm", "xhtml"),
    "xml_jats": ("xml", "nxml"),
    "image": ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp"),
    "asciidoc": ("adoc", "asciidoc", "asc"),
    "csv": ("csv",),
    "xlsx": ("xlsx", "xlsm"),
    "xml_uspto": ("xml", "txt"),
    "mets_gbs": ("tar.gz",),
    "json_document": ("json",),
    "audio": ("wav", "mp3", "m4a", "aac", "ogg", "flac", "mp4", "avi", "mov"),
    "vtt": ("vtt",),
    "latex": ("tex", "latex"),
}
#: MIME types of each format, in the order in which a MIME type's formats are tried.
MIME_TYPES = {
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.openxmlformats-officedocument.wordprocessingml.template"),
    "pptx": ("application/vnd.openxmlformats-officedocument.presentationml.template", "application/vnd.openxmlformats-officedocument.presentationml.slideshow", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    "html": ("text/html", "application/xhtml+xml"),
    "xml_jats": ("application/xml",),
    "image": ("image/png", "image/jpeg", "image/tiff", "image/gif", "image/bmp", "image/webp"),
    "pdf": ("application/pdf",),
    "asciidoc": ("text/asciidoc",),
    "md": ("text/markdown", "text/x-markdown"),
    "csv": ("text/csv",),
    "xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",),
    "xml_uspto": ("application/xml", "text/plain"),
    "mets_gbs": ("application/mets+xml",),
    "json_document": ("application/json",),
    "audio": ("audio/x-wav", "audio/mpeg", "audio/wav", "audio/mp3", "audio/mp4", "audio/m4a", "audio/aac", "audio/ogg", "audio/flac", "audio/x-flac", "video/mp4", "video/avi", "video/x-msvideo", "video/quicktime"),
    "vtt": ("text/vtt",),
    "latex": ("text/x-tex", "application/x-tex", "text/x-latex"),
}
#: Leading bytes (hex) of recognised content, and their MIME types.
MAGIC = (
    ("25504446", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"),
    ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("424D", "image/bmp"), ("1F8B08", "application/gzip"),
    ("664C6143", "audio/x-flac"), ("4F676753", "audio/ogg"), ("494433", "audio/mpeg"),
)
DEFAULT_MIME = "text/plain"


def mime_of_extension() -> dict[str, str]:
    """The first format that lists an extension gives its first MIME type."""
    out: dict[str, str] = {}
    for fmt in FORMATS:
        for ext in EXTENSIONS[fmt]:
            out.setdefault(ext, MIME_TYPES[fmt][0])
    return out


def format_of_mime() -> dict[str, str]:
    out: dict[str, str] = {}
    for fmt, types in MIME_TYPES.items():
        for mime in types:
            out.setdefault(mime, fmt)
    return out


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.element_at(pairs, F.coalesce(key, F.lit("")))


def extension(name: Column, stream: bool = False) -> Column:
    """The part after the last dot of a file name: case-sensitive for paths, lower-cased for streams."""
    ext = F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise("")
    return F.lower(ext) if stream else ext


def magic_mime(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(None).cast("string")
    for prefix, mime in reversed(MAGIC):
        out = F.when(head.startswith(prefix), mime).otherwise(out)
    riff = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    wave = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57415645"), "audio/x-wav")
    return F.coalesce(out, riff, wave)


def detect_format(name: Column, content: Column | None = None, stream: bool = False) -> tuple[Column, Column]:
    """MIME type and format (null: none is registered for it)."""
    mime = _looked_up(extension(name, stream), mime_of_extension())
    if content is not None:
        mime = F.coalesce(magic_mime(content), mime)
    mime = F.coalesce(mime, F.lit(DEFAULT_MIME))
    return mime, _looked_up(mime, format_of_mime())


def format_of_name(name: str) -> str | None:
    """The format of a file name, as ``detect_format`` has it for paths."""
    return format_of_mime().get(mime_of_extension().get(name.rpartition(".")[2] if "." in name else "", DEFAULT_MIME))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def admit(docs: DataFrame, limits: Limits) -> DataFrame:
    """Adds ``valid`` and ``reason`` from filesize and page_count (null page_count: the file could not be opened)."""
    start = limits.page_range[0]
    reason = F.when(F.col("page_count").isNull(), "unreadable").when(F.col("page_count") > limits.max_num_pages, "too many pages")
    reason = reason.when(F.col("page_count") < start, "page range beyond end")
    if limits.enforce_file_size:
        reason = reason.when(F.col("filesize") > limits.max_file_size, "file too large")
    return docs.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def gate(docs: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Adds ``status``: skipped unless the format is allowed, failure if not valid, else pending; and the error."""
    ok = F.coalesce(F.col("format").isin(*allowed), F.lit(False))
    status = F.when(~ok, "skipped").when(~F.col("valid"), "failure").otherwise("pending")
    error = F.when(~ok, F.concat(F.lit("File format not allowed: "), "file")).when(~F.col("valid"), F.concat(F.lit("Input document is not valid: "), "file"))
    return docs.withColumn("status", status).withColumn("error", error)


def expand_pages(docs: DataFrame, limits: Limits) -> DataFrame:
    """A row for each page in range."""
    start, end = limits.page_range
    last = F.least(F.lit(end), F.col("page_count")).cast("int")
    pages = F.when(F.col("page_count").isNotNull() & (last >= start), F.sequence(F.lit(start), last))
    return docs.select("*", F.explode(pages).alias("page_no"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as input documents: ``(path, file, filesize, content, mime, format, document_hash)``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    mime, fmt = detect_format(name, F.col("content"))
    return raw.select("path", name.alias("file"), F.col("length").alias("filesize"), "content", mime.alias("mime"), fmt.alias("format"), content_hash(F.col("content")).alias("document_hash"))


def from_streams(rows: DataFrame, content_col: str, name_col: str) -> DataFrame:
    """Rows of bytes as input documents: by their leading bytes, else by the extension in any case; null contents are empty."""
    content = F.coalesce(F.col(content_col), F.lit(b""))
    mime, fmt = detect_format(F.col(name_col), content, stream=True)
    own = {"file": F.col(name_col), "filesize": F.octet_length(content).cast("long"), "mime": mime, "format": fmt, "document_hash": content_hash(content)}
    return rows.select("*", *(v.alias(k) for k, v in own.items() if k != name_col))


def from_strings(rows: DataFrame, content_col: str, fmt: str, name_col: str | None = None) -> DataFrame:
    """Text rows as input documents; only Markdown and HTML can come as strings."""
    if fmt not in ("md", "html"):
        raise ValueError(f"format {fmt} cannot be converted from a string")
    base = F.col(name_col) if name_col else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH-mm-ss")
    name = F.when(base.endswith("." + fmt), base).otherwise(F.concat(base, F.lit("." + fmt)))
    return rows.select("*", name.alias("file"), F.octet_length(content_col).cast("long").alias("filesize"), F.lit(fmt).alias("format"), content_hash(F.col(content_col)).alias("document_hash"))
