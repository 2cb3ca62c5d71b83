"""Text expressions that stay in the JVM, and helpers for what the JVM has no function for."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The character references every HTML text may contain, in the order of decoding.
BASIC_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")]


def trim_all(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def cut(s: Column, n: int) -> Column:
    """At most ``n`` characters, and an ellipsis where something was cut."""
    return F.when(F.char_length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)


def html_to_text(s: Column) -> Column:
    """Paragraph tags to blank lines, other tags away, then the basic references decoded."""
    out = F.regexp_replace(F.regexp_replace(s, r"(?i)</?p>", "\n\n"), r"<[^>]+>", "")
    for name, char in BASIC_ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return trim_all(out)


def snippet(s: Column, n: int = 140) -> Column:
    return cut(html_to_text(s), n)


def text_or_title(text: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), title)


def utf8_cut(s: Column, n: int) -> Column:
    """At most ``n`` bytes, without cutting a character in two.

    The bytes are cut, then as many trailing bytes as belong to an unfinished character: the last
    lead byte (not 10xxxxxx) tells how long its character has to be.
    """
    raw = F.encode(s, "UTF-8")
    head = F.substring(raw, 1, n)

    def hex_at(back: int) -> Column:
        return F.conv(F.hex(F.substring(head, n - back, 1)), 16, 10).cast("int")

    keep = F.lit(n)
    for back in (3, 2, 1, 0):
        byte = hex_at(back)
        need = F.when(byte >= 240, 4).when(byte >= 224, 3).when(byte >= 192, 2).otherwise(0)
        keep = F.when(need > back + 1, F.lit(n - back - 1)).otherwise(keep)
    return F.when(F.octet_length(s) <= n, s).otherwise(F.decode(F.substr(raw, F.lit(1), keep), "UTF-8"))


def short_date(ts: Column) -> Column:
    """'9 Oct 2006'; '' where there is no positive time."""
    return F.when(ts > 0, F.date_format(F.timestamp_seconds(ts), "d MMM yyyy")).otherwise("")


def parse_id(s: Column) -> Column:
    return F.expr(f"try_cast(trim({s}) AS BIGINT)") if isinstance(s, str) else F.trim(s).try_cast("long")


def words(s: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def match_query(text: str) -> str:
    """Words of a query in quotes, any of which may match; '' matches nothing."""
    return " OR ".join('"' + w.replace('"', '""') + '"' for w in text.split())


def first_group(s: Column, pattern: str) -> Column:
    """The pattern's first group, null where it does not match or is empty."""
    return F.nullif(F.regexp_extract(s, pattern, 1), F.lit(""))


def page_title(page: Column) -> Column:
    """Title of a page: Open Graph, then the title element."""
    meta = r"""(?is)<meta\b(?=[^>]*\b(?:property|name)\s*=\s*["']?og:title\b)[^>]*\bcontent\s*=\s*["']([^"'>]*)["']"""
    return F.coalesce(first_group(page, meta), first_group(page, r"(?is)<title[^>]*>\s*(.*?)\s*</title>"))


def preview(page: str) -> dict[str, str]:
    """title, description, image and site_name of a page's head; the first that is not empty counts."""
    import html

    head = re.split(r"(?i)</head>", page, maxsplit=1)[0]
    names = {"og:title": "title", "og:description": "description", "og:image": "image", "og:image:url": "image", "og:image:secure_url": "image", "og:site_name": "site_name"}
    out = dict.fromkeys(("title", "description", "image", "site_name"), "")
    plain = ""
    for tag in re.findall(r"(?is)<meta\b([^>]*)>", head):
        attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in re.findall(r"""(?is)([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", tag)}
        name, content = (attrs.get("property") or attrs.get("name") or "").lower(), attrs.get("content", "").strip()
        if name in names and not out[names[name]]:
            out[names[name]] = content
        elif name == "description" and not plain:
            plain = content
    if not out["title"] and (m := re.search(r"(?is)<title[^>]*>(.*?)</title>", head)):
        out["title"] = html.unescape(m[1]).strip()
    out["description"] = out["description"] or plain
    return out


def parse_short_date(s: Column) -> Column:
    """The day that ``short_date`` wrote, null where it is none."""
    return F.try_to_timestamp(F.nullif(s, F.lit("")), F.lit("d MMM yyyy")).cast("date")


def item_url(key: Column, base: str) -> Column:
    return F.concat(F.lit(base), key.cast("string"))


def id_to_bytes(key: Column) -> Column:
    """Eight bytes, the lowest first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(key, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(8)]))


def bytes_to_id(raw: Column) -> Column:
    """The whole number of eight bytes, the lowest first; null for other lengths."""
    out = F.lit(0).cast("long")
    for i in range(8):
        byte = F.conv(F.hex(F.substring(raw, i + 1, 1)), 16, 10).cast("long")
        out = out.bitwiseOR(F.shiftleft(byte, 8 * i))
    return F.when(F.octet_length(raw) == 8, out)


#: Letters with marks that ``fold`` writes without, each beside its plain letter.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżžά έήίόύώ".replace(" ", "")
UNMARKED = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzzαεηιουω"


def fold(s: Column) -> Column:
    """Lower case without the marks of common letters."""
    return F.translate(F.lower(s), MARKED, UNMARKED)
