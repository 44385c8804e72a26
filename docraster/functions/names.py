"""Names: extensions, natural order, page and export names, lists typed by a user."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The extensions that pages are read from.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".webp", ".bmp")
PDF_EXTENSIONS = (".pdf",)


def extension(name: Column | str) -> Column:
    """The last suffix in lower case; none for names that start with their only dot or end in one."""
    name = F.col(name) if isinstance(name, str) else name
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def supported(name: Column | str) -> Column:
    return extension(name).isin(*IMAGE_EXTENSIONS, *PDF_EXTENSIONS)


def natural_key(name: Column | str) -> Column:
    """Text and number parts in turn: numbers compare as numbers, text without case."""
    name = F.col(name) if isinstance(name, str) else name
    parts = F.filter(F.regexp_extract_all(name, F.lit(r"(\D*)(\d*)"), F.lit(0)), lambda t: t != "")
    text = lambda t: F.lower(F.regexp_extract(t, r"^(\D*)", 1))
    number = lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"(\d*)$", 1), F.lit("")).cast("decimal(38,0)"), F.lit(-1).cast("decimal(38,0)"))
    return F.transform(parts, lambda t: F.struct(text(t).alias("s"), number(t).alias("d")))


def page_name(file_name: Column | str, page_no: Column | str) -> Column:
    return F.format_string("%s [p%04d]", file_name, page_no)


def export_name(position: Column | str, base: str = "page", ext: str = "png") -> Column:
    """base_00001.ext, or 00001.ext without a base; the extension is taken without leading dots and in lower case, png if blank."""
    ext = ext.strip().lower().lstrip(".") or "png"
    return F.format_string(f"{base.replace('%', '%%') + '_' if base else ''}%05d.{ext}", position)


def list_label(position: Column | str, name: Column | str) -> Column:
    """A page's line in a list of pages."""
    return F.format_string("%04d  %s", position, name)


def file_list(raw: Column | str) -> Column:
    """Paths of a typed list: parts between semicolons or line ends, without blanks, quotes and empty ones."""
    parts = F.transform(F.split(raw, r"[;\n\r]+"), lambda p: F.trim(F.btrim(F.trim(p), F.lit('"'))))
    return F.filter(parts, lambda p: p != "")


def page_numbers(raw: Column | str) -> Column:
    """Numbers of a typed list, each once and in order; null if it is blank. An error tells of anything else (fixed values:
    its texts)."""
    tokens = F.filter(F.split(raw, r"[\s,;]+"), lambda t: t != "")
    bad = F.filter(tokens, lambda t: t.try_cast("bigint").isNull() | (t.try_cast("bigint") < 1))
    said = F.concat(F.lit("Invalid page value: "), F.get(bad, F.lit(0)), F.when(F.get(bad, F.lit(0)).try_cast("bigint") < 1, ". Page numbers must be >= 1.").otherwise(""))
    return F.when(F.size(tokens) == 0, F.lit(None)).when(F.size(bad) > 0, F.raise_error(said).cast("array<bigint>")).otherwise(F.array_distinct(F.transform(tokens, lambda t: t.try_cast("bigint"))))
