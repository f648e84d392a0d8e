"""Validation and quality cascades: one reason column each, null for rows that pass. The first failing check wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

# Suffixes of script files, and the beginnings of binary files.
SUFFIXES = [".py", ".ps1", ".js", ".vbs", ".sh", ".bat", ".cmd", ".rb", ".pl"]
TEXT_MAGIC = [("MZ", "windows_executable"), ("\x7fELF", "linux_executable"), ("\xfe\xed\xfa", "macos_executable"), ("PK\x03\x04", "compressed_archive"), ("\x89PNG", "png_image"), ("\xff\xd8\xff", "jpeg_image"), ("GIF", "gif_image")]
BYTE_MAGIC = ["4D5A", "7F454C46", "FEEDFA", "504B0304", "89504E47", "FFD8FF", "47494638", "25504446"]


def _first(*checks: tuple[Column, str | Column]) -> Column:
    out = None
    for bad, reason in checks:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        out = F.when(bad, reason) if out is None else out.when(bad, reason)
    return out.otherwise(F.lit(None).cast("string"))


def schema_reason(content: Column, label: Column, source: Column) -> Column:
    return _first((F.coalesce(t.strip(content), F.lit("")) == "", "blank_content"), (~F.coalesce(label, F.lit("")).isin("malicious", "benign"), "label"), (source.isNull(), "source"))


def validation_reason(content: Column, label: Column, *, min_length: int = 50, max_length: int = 50_000, max_comments: float = 0.8, min_solid: int = 100, syntax: Column | None = None) -> Column:
    """label, encoding, length, comments, content, then (if a syntax column is given) syntax."""
    checks = [
        (~F.lower(F.coalesce(label, F.lit(""))).isin("malicious", "benign"), "label"),
        (content.isNull() | ~F.is_valid_utf8(content), "encoding"),
        (~F.length(content).between(min_length, max_length), "length"),
        (t.comment_share(content) > max_comments, "mostly_comments"),
        (t.solid_length(content) < min_solid, "insufficient_content"),
    ]
    if syntax is not None:
        checks.append((~syntax, "syntax"))
    return _first(*checks)


def quality_reason(content: Column, *, min_code: int = 5, max_comments: float = 0.5) -> Column:
    """Too few code lines, or too many comments among lines that aren't blank."""
    code = t.count_lines(content, lambda x: ~t.is_blank(x) & ~t.is_comment(x))
    comments = t.count_lines(content, lambda x: t.is_comment(x))
    return _first((code < min_code, "few_code_lines"), (F.try_divide(comments, code + comments) > max_comments, "comment_ratio"))


def source_reason(content: Column, suffix: Column | None = None) -> Column:
    """The early filter at the source: empty, short, NUL, control characters, magic beginnings, suffix, base64, ASCII."""
    checks = [
        (content.isNull() | (t.strip(content) == ""), "empty_content"),
        (F.length(content) < 10, "too_short"),
        (F.contains(content, F.lit("\x00")), "null_bytes_detected"),
        (t.share(content, t.CONTROL) > 0.05, "too_many_non_printable"),
        *((F.startswith(content, F.lit(magic)), reason) for magic, reason in TEXT_MAGIC),
    ]
    if suffix is not None:
        checks.append((suffix.isNotNull() & ~F.lower(suffix).isin(*SUFFIXES), "invalid_extension"))
    checks += [(t.matched_share(content, t.BASE64_40) > 0.6, "excessive_base64"), (t.ascii_share(content) < 0.5, "low_ascii_ratio")]
    return _first(*checks)


def binary_bytes(raw: Column) -> Column:
    """Short, with NUL in the first 512 bytes, or with the beginning of a binary format."""
    head = F.hex(F.substring(raw, 1, 512))
    nul = head.rlike("^(..)*00")
    magic = None
    for m in BYTE_MAGIC:
        hit = F.startswith(head, F.lit(m))
        magic = hit if magic is None else magic | hit
    return raw.isNull() | (F.octet_length(raw) < 10) | nul | magic


def archive_bytes(raw: Column) -> Column:
    """What looks like a ZIP, gzip, bzip2, xz, 7z or tar file."""
    head = F.hex(F.substring(raw, 1, 6))
    return F.startswith(head, F.lit("504B0304")) | F.startswith(head, F.lit("1F8B")) | F.startswith(head, F.lit("425A68")) | F.startswith(head, F.lit("FD377A585A00")) | F.startswith(head, F.lit("377ABCAF271C")) | (F.hex(F.substring(raw, 258, 5)) == "7573746172")


# Beginnings of files that are not scripts, as members of archives have them.
MEMBER_MAGIC = ["4D5A", "504B0304", "504B0506", "7F454C46", "CFFAEDFE", "52617221", "377ABCAF271C", "1F8B", "425A68"]


def member_binary(raw: Column) -> Column:
    """A member of an archive that begins like a binary file, or has more than ten NULs in its first 1,024 bytes."""
    head = F.decode(F.substring(raw, 1, 1024), "ISO-8859-1")
    out = F.length(head) - F.length(F.replace(head, F.lit("\x00"), F.lit(""))) > 10
    for m in MEMBER_MAGIC:
        out = out | F.startswith(F.hex(F.substring(raw, 1, 6)), F.lit(m))
    return out


def sanitizer_binary(content: Column) -> Column:
    return F.contains(content, F.lit("\x00")) | (t.share(content, t.CONTROL) > 0.1) | (t.matched_share(content, t.BASE64_40) > 0.4)


def sanitized(rows: DataFrame, content: str = "content", *, min_entropy: float = 3.5, hard_entropy: float = 1.5, long_line: int = 500, min_lines: int = 3, max_blank: float = 0.5, cleaner=None) -> DataFrame:
    """rows with clean (null if rejected), reason, entropy, line figures and warnings. cleaner: text column -> text column."""
    c = F.col(content)
    lengths = F.transform(t.lines(c), lambda x: F.length(x))
    rows = rows.withColumn("entropy", t.entropy(c)).withColumn("max_line", F.array_max(lengths)).withColumn("n_lines", F.size(lengths)).withColumn("avg_line", F.aggregate(lengths, F.lit(0), lambda a, x: a + x) / F.col("n_lines")).withColumn("filled_lines", t.count_lines(c, lambda x: ~t.is_blank(x)))
    rows = rows.withColumn("blank_share", 1 - F.col("filled_lines") / F.col("n_lines"))
    cleaned = t.normalise_space(cleaner(c) if cleaner else c)
    rows = rows.withColumn("clean", cleaned)
    # texts without filled lines are empty_content
    reason = _first((c.isNull() | t.is_blank(c), "empty_content"), (sanitizer_binary(c), "binary_data_detected"), (F.col("entropy") < hard_entropy, "extremely_low_entropy"), (F.length("clean") < 10, "content_too_short_after_cleaning"))
    warnings = t.present(F.when(F.col("entropy") < min_entropy, "low_entropy"), F.when(F.col("max_line") > long_line, "long_line"), F.when(F.col("filled_lines") < min_lines, "few_lines"), F.when(F.col("blank_share") > max_blank, "blank_lines"))
    return rows.withColumn("reason", reason).withColumn("warnings", warnings).withColumn("compression_ratio", F.try_divide(F.length("clean"), F.length(c))).withColumn("clean", F.when(F.col("reason").isNull(), F.col("clean")))


def reason_counts(rows: DataFrame, reason: str = "reason", top: int | None = None) -> DataFrame:
    counts = rows.filter(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), reason).limit(top) if top else counts
