"""Admission of uploads: predicates in a fixed order, the first that fails gives the code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: accepted content types, error codes and their statuses.
CONTENT_TYPES = ("application/pdf", "application/x-pdf", "application/octet-stream", "")
STATUS = {
    "INVALID_PDF": 400, "ENCRYPTED_PDF": 400, "INVALID_DOCUMENT_ID": 400, "INVALID_OPTIONS": 422, "FILE_TOO_LARGE": 413, "UNSUPPORTED_MEDIA_TYPE": 415, "TOO_MANY_PAGES": 422,
    "BACKEND_FAILURE": 500, "BACKEND_UNAVAILABLE": 503,
}
DOCUMENT_ID = r"\A[A-Za-z0-9_.-]{1,128}\z"
OPTIONS = ("backend", "force_ocr")


def content_type_ok(content_type: Column) -> Column:
    """Whether the type, without parameters and case, is one that may hold a document; none at all may."""
    return F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1))).isin(*CONTENT_TYPES)


def size_ok(content: Column, max_mb: int) -> Column:
    return F.octet_length(content) <= max_mb * 1024 * 1024


def magic_ok(content: Column) -> Column:
    """Whether the mark of the format stands in the first 1024 bytes."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return (F.octet_length(content) > 0) & (F.instr(head, "%PDF-") > 0)


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def document_id(given: Column, content: Column) -> Column:
    """The id given, else one made from the content's hash."""
    return F.coalesce(F.nullif(given, F.lit("")), F.concat(F.lit("doc_"), F.substring(content_sha256(content), 1, 16)))


def document_id_ok(resolved: Column) -> Column:
    return resolved.rlike(DOCUMENT_ID)


def options_ok(options: Column) -> Column:
    """Whether options are missing, or a JSON object of known keys, ``force_ocr`` a boolean and ``backend`` a string."""
    text = F.trim(F.coalesce(options, F.lit("")))
    kind = F.expr("schema_of_variant(try_parse_json(coalesce(nullif(trim(_options), ''), '{}')))")
    known = rf"^OBJECT<(?:(?:{'|'.join(OPTIONS)}): [A-Z0-9()]+(?:, )?)*>$"
    shape = F.coalesce(kind.rlike(known) & ~kind.rlike(r"force_ocr: (?!BOOLEAN)") & ~kind.rlike(r"backend: (?!STRING)"), F.lit(False))
    return (text == "") | shape


def page_count_code(count: Column, most: int) -> Column:
    return F.when(count <= 0, "INVALID_PDF").when(count > most, "TOO_MANY_PAGES")


def reject_code(uploads: DataFrame, max_mb: int = 25, max_pages: int = 500) -> DataFrame:
    """The uploads (content, content_type, given_id, options, page_count) with document_id, sha256, reject and status.

    ``reject`` is the code of the first predicate that fails, in the order
    content type, size, mark, id, options, pages; null if none does.
    """
    c = F.col("content")
    ready = uploads.withColumn("_options", F.col("options")).withColumn("document_id", document_id(F.col("given_id"), c)).withColumn("sha256", content_sha256(c))
    code = (
        F.when(~content_type_ok(F.col("content_type")), "UNSUPPORTED_MEDIA_TYPE")
        .when(~size_ok(c, max_mb), "FILE_TOO_LARGE")
        .when(~F.coalesce(magic_ok(c), F.lit(False)), "INVALID_PDF")
        .when(~document_id_ok(F.col("document_id")), "INVALID_DOCUMENT_ID")
        .when(~options_ok(F.col("options")), "INVALID_OPTIONS")
        .otherwise(page_count_code(F.col("page_count"), max_pages))
    )
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return ready.withColumn("reject", code).withColumn("status", F.coalesce(F.try_element_at(status, F.col("reject")), F.lit(200))).drop("_options")


def open_error(message: Column) -> Column:
    """The code of a reader's message: a document under a password, or one that cannot be opened."""
    said = F.lower(message)
    return F.when(said.contains("password") | said.contains("encrypt"), "ENCRYPTED_PDF").otherwise("INVALID_PDF")


#: Fixed: settings with the range or the words that each allows.
SETTINGS = {
    "port": (1, 65535), "max_upload_mb": (1, None), "max_pages": (1, None), "text_density_threshold": (0, None), "low_confidence_threshold": (0.0, 1.0), "render_dpi": (1, None), "threads": (1, None), "table_mode": ("accurate", "fast"),
}


def settings_errors(settings: DataFrame) -> DataFrame:
    """The rows with ``errors``: the names of settings beyond what they allow, in order; a null has the default."""
    wrong = []
    for name, allowed in SETTINGS.items():
        value = F.col(name)
        if isinstance(allowed[0], str):
            bad = ~value.isin(*allowed)
        else:
            bad = (value < allowed[0]) if allowed[1] is None else ~value.between(*allowed)
        wrong.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)))
    return settings.withColumn("errors", F.array_compact(F.array(*wrong)))


def error_bodies(rejected: DataFrame) -> DataFrame:
    """error_code, message, document_id and detail of rejected uploads; ``reason``, if there is one, goes to detail."""
    message = F.replace(F.lower("reject"), F.lit("_"), F.lit(" "))
    reason = F.when(F.col("reason").isNotNull(), F.to_json(F.struct("reason"))) if "reason" in rejected.columns else F.lit(None).cast("string")
    return rejected.filter("reject is not null").select(F.col("reject").alias("error_code"), message.alias("message"), "document_id", reason.alias("detail"))
