"""Column expressions on mailboxes, headers and attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.text import text_of

# File endings.
RISKY = ["bat", "cmd", "com", "exe", "hta", "js", "jse", "lnk", "msi", "ps1", "scr", "vbs", "wsf"]
OFFICE = ["doc", "docm", "xls", "xlsm", "ppt", "pptm", "pdf"]
ARCHIVES = ["7z", "rar", "zip"]
ADDRESS = r"^[^@\s<>]+@[^@\s<>]+\.[^@\s<>]+$"


def mailbox(c: Column | str) -> Column:
    """Struct display_name, address (lower case), domain, is_valid of `Name <address>` or a bare address."""
    t = F.trim(text_of(c))
    angled = t.contains("<")
    address = F.lower(F.trim(F.when(angled, F.regexp_extract(t, r"<([^>]*)>?", 1)).otherwise(t)))
    name = F.when(angled, F.trim(F.regexp_replace(F.regexp_extract(t, r"^([^<]*)<", 1), r"^\s*\"|\"\s*$", ""))).otherwise("")
    return F.struct(name.alias("display_name"), address.alias("address"), F.when(address.contains("@"), F.element_at(F.split(address, "@"), -1)).otherwise("").alias("domain"), address.rlike(ADDRESS).alias("is_valid"))


def mailboxes(c: Column | str) -> Column:
    """Array of mailboxes of a comma-separated list, without empty ones."""
    return F.filter(F.transform(F.split(text_of(c), ","), mailbox), lambda m: m["address"] != "")


def attachment_hints(filename: Column | str, mime: Column | str) -> Column:
    name = F.lower(F.regexp_replace(text_of(filename), r"^.*/", ""))
    parts = F.split(F.ltrim(name, F.lit(".")), r"\.")
    n = F.size(parts)
    last = F.when(n >= 2, F.element_at(parts, -1)).otherwise("")
    before = F.when(n >= 3, F.try_element_at(parts, F.lit(-2))).otherwise("")
    risky = last.isin(RISKY)
    return F.array_compact(
        F.array(
            F.when(risky, "risky_extension"),
            F.when(risky & before.isin(OFFICE), "double_extension"),
            F.when(last.isin(ARCHIVES), "archive_attachment"),
            F.when(risky & F.lower(text_of(mime)).contains("application/octet-stream"), "executable_like_content_type"),
        )
    )


def headers_by_key(headers: DataFrame, message: str, key: str, value: str, order: str) -> DataFrame:
    """message, headers: a map from lower-case key to the values in order, joined by newlines."""
    each = headers.groupBy(message, F.lower(key).alias("_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "\n").alias("_value"))
    return each.groupBy(message).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_key", "_value")))).alias("headers"))


def header_warnings(sender: Column, message_id: Column, date: Column) -> Column:
    missing = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    box = mailbox(sender)
    return F.array_compact(
        F.array(
            F.when(missing(sender), "missing_from"),
            F.when(~missing(sender) & ~box["is_valid"], "invalid_from"),
            F.when(missing(message_id), "missing_message_id"),
            F.when(missing(date), "missing_date"),
        )
    )


def distinct_links(links: Column) -> Column:
    """Ordered links, each (raw_url, display_text) once."""
    return F.array_distinct(F.transform(links, lambda u: F.struct(u["raw_url"].alias("raw_url"), u["display_text"].alias("display_text"))))
