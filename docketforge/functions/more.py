"""Smaller functions: weekdays, error families, paths, delivery parameters, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

#: Days of the week by Spark's dayofweek, words of each family of errors, codes by status, parameters by extension.
WEEKDAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
ERROR_FAMILIES = {
    "validation": ["validation", "invalid", "required", "format", "length"], "file_upload": ["file", "upload", "extension", "size", "mime", "multipart"],
    "processing": ["processing", "extraction", "classification", "timeout", "pipeline"], "storage": ["storage", "s3", "bucket", "space", "disk", "write", "read"],
}
STATUS_CODES = {
    400: "bad_request", 401: "unauthorized", 403: "forbidden", 404: "not_found", 405: "method_not_allowed", 408: "request_timeout", 413: "request_too_large", 415: "unsupported_media_type", 429: "too_many_requests",
    500: "internal_server_error", 502: "bad_gateway", 503: "service_unavailable", 504: "gateway_timeout",
}
DELIVERY = [
    (["jpg", "jpeg", "png", "gif", "webp"], "auto=compress&fm=auto"), (["pdf"], "compress=true"), (["js", "css"], "minify=true&gzip=true"), (["mp4", "avi", "mov"], "quality=auto"),
]


def weekday(text: Column, as_of: Column) -> Column:
    """The date of the first weekday named as a whole word: next, last, or the one to come."""
    low = F.lower(text)
    out = F.lit(None).cast("date")
    for i, day in reversed(list(enumerate(WEEKDAYS, 1))):
        until = F.lit(i) - F.dayofweek(as_of)
        step = F.when(low.contains("next"), F.when(until <= 0, until + 7).otherwise(until)).when(low.contains("last"), F.when(until >= 0, until - 7).otherwise(until)).otherwise(F.when(until < 0, until + 7).otherwise(until))
        out = F.when(low.rlike(rf"(?<![a-z])(?:{day}|{day[:3]})(?![a-z])"), F.date_add(as_of, step)).otherwise(out)
    return out


def error_family(message: Column) -> Column:
    low = F.lower(message)
    out = F.lit("other")
    for name, words in reversed(ERROR_FAMILIES.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def status_code(status: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS_CODES.items() for x in kv])[status], F.lit("unknown_error"))


def delivery_parameters(extension: Column) -> Column:
    out = F.lit("gzip=true")
    for exts, params in DELIVERY:
        out = F.when(extension.isin(*exts), params).otherwise(out)
    return F.concat(out, F.lit("&cache=max"))


def storage_path(path: Column) -> Column:
    """Without slashes at the ends, double slashes made single once, below a known folder."""
    p = F.replace(F.regexp_replace(path, "^/+|/+$", ""), F.lit("//"), F.lit("/"))
    return F.when(p.startswith("documents/") | p.startswith("temp/") | p.startswith("uploads/"), p).otherwise(F.concat(F.lit("documents/"), p))


def public_url(base: str, path: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), path)


def basic_clean(text: Column) -> Column:
    """Line ends unified, lines trimmed, runs of empty lines shortened."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.array_join(F.transform(F.split(t, "\n"), trimmed), "\n")
    t = F.replace(F.replace(t, F.lit("\n\n\n\n"), F.lit("\n\n")), F.lit("\n\n\n"), F.lit("\n\n"))
    return trimmed(t)


def unescaped(text: Column) -> Column:
    """Escapes of PDF strings resolved, characters that do not print left out."""
    for a, b in (("\\n", " "), ("\\r", " "), ("\\t", " "), ("\\(", "("), ("\\)", ")"), ("\\\\", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return trimmed(F.regexp_replace(text, r"[\p{C}\p{Zl}\p{Zp}]", ""))


def document_id(path: Column) -> Column:
    """The same for the same path."""
    return F.concat(F.lit("doc_"), F.left(F.sha2(path, 256), F.lit(16)))


def strategy(has_text: Column, has_images: Column) -> Column:
    """How to extract a PDF: kind, method and confidence."""
    s = lambda k, m, c: F.struct(F.lit(k).alias("kind"), F.lit(m).alias("method"), F.lit(c).alias("confidence"))
    return F.when(has_text & ~has_images, s("text", "text", 0.9)).when(~has_text & has_images, s("scanned", "ocr", 0.8)).when(has_text & has_images, s("hybrid", "text", 0.7)).otherwise(s("unknown", "text", 0.3))


def provider_delay(attempt: Column) -> Column:
    """Seconds before a provider is asked again: growing by three, at most a minute."""
    return F.least(F.lit(2.0) * 1.5 * attempt, F.lit(60.0))
