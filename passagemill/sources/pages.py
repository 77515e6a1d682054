"""HTML pages as passages, in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_whitespace

# The entities that are decoded, in order.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]
# Fixed value: titles of pages that stand for another.
PLACEHOLDER = r"^(404 |403 )|nem található|Tilos|^(?i:page not found)$"
MIN_IMAGE = 5 * 1024


def title(html: Column) -> Column:
    return collapse_whitespace(unescaped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def unescaped(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def body_text(html: Column) -> Column:
    """Text of the body without scripts, styles and toolbar; tags become spaces."""
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1)
    body = F.when(body == "", html).otherwise(body)
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?is)<div\s+id\s*=\s*[\"']?toolbar[\"']?[^>]*>.*?</div>", r"(?s)<!--.*?-->"):
        body = F.regexp_replace(body, pattern, " ")
    return collapse_whitespace(unescaped(F.regexp_replace(body, r"(?s)<[^>]+>", " ")))


def passages_of(pages: DataFrame, least: int = 40) -> DataFrame:
    """page_id, id (16 hex digits of the url's hash), title, text of pages that are long enough and no error page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", title(html).alias("title"), body_text(html).alias("text"))
    rows = rows.where((F.length("text") >= least) & ~F.col("title").rlike(PLACEHOLDER))
    return rows.select("page_id", F.substring(F.sha2(F.coalesce(F.col("url"), F.concat(F.lit("page:"), F.col("page_id").cast("string"))), 256), 1, 16).alias("passage_id"), "title", "text")


def largest_inline_image(html: Column) -> Column:
    """Decoded size of the largest base64 image of at least five kilobytes, no svg or gif; null: none."""
    data = F.regexp_extract_all(html, F.lit(r"data:image/(?!svg|gif)[a-zA-Z0-9.+-]+;base64,([A-Za-z0-9+/=\s]+)"), F.lit(1))
    sizes = F.filter(F.transform(data, lambda d: F.octet_length(F.try_to_binary(F.regexp_replace(d, r"\s+", ""), F.lit("base64")))), lambda n: n >= MIN_IMAGE)
    return F.array_max(sizes)
