"""HTML documents as tables: visible text, links, image references, forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgrisk.functions import hosts
from msgrisk.functions import text as tx
from msgrisk.functions.markup import html_facts
from msgrisk.session import bounded_batches

MIN_VISIBLE = 80

_MSO = r"(?is)<!--\s*\[if\s+([^\]]*\bmso\b[^\]]*)\]>(.*?)<!\[endif\]\s*--\s*>"
_NOT_MSO = r"(?is)<!--\s*\[if\s+\(*(?:!|not)\s*\(*\s*mso\s*\)*\s*\]>.*?<!\[endif\]\s*--\s*>"


def expand_conditionals(html: Column) -> Column:
    """Expose one layer of client-conditional markup; the excluded branch stays a comment."""
    return F.when(
        html.contains("[if"), F.regexp_replace(F.regexp_replace(html, _NOT_MSO, ""), _MSO, "$2")
    ).otherwise(html)


def unescape_css(css: Column) -> Column:
    """Drop comments and the escapes that commonly split keywords."""
    c = F.regexp_replace(css, r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(c, r"\\([^0-9a-fA-F\n\r\f])", "$1")


_HIDES = (
    r"(?i)\{[^}]*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|"
    r"opacity\s*:\s*(?:[+-]?0*\.?0+%?\s*[;!}]|-\d|calc\()|font-size\s*:\s*\+?0+(?:\.0+)?(?:[a-z]+|%)?\s*[;!}]|"
    r"color\s*:\s*(?:transparent|(?:rgba|hsla)\([^)]*,\s*0+(?:\.0+)?\s*\)))"
)


def page_facts(pages: DataFrame, key: list[str], html: str = "html") -> DataFrame:
    """One parse per document; every other page operator derives from this table.

    The parser runs in Arrow batches on the key and the markup only.
    """
    source = F.coalesce(F.col(html), F.lit(""))
    parsed = bounded_batches(pages).select(
        *key, source.rlike(_MSO).alias("mso_conditional"), html_facts(expand_conditionals(source)).alias("f")
    ).select(*key, "mso_conditional", "f.*")
    visible = tx.squeeze_space("text")
    return parsed.select(
        *key,
        visible.alias("text"),
        tx.nonspace_count(tx.strip_format_controls(visible)).alias("visible_chars"),
        "hidden_chars",
        "linked_images",
        "hidden_text",
        (F.concat("sheet", F.lit("}")).rlike("[{]") & unescape_css(F.concat("sheet", F.lit("}"))).rlike(_HIDES)).alias("style_hides"),
        "uncertain_style",
        "alt_fallback",
        "mso_conditional",
        "base_href",
        "links",
        "images",
        "styles",
        "sheet",
        "password_form",
        "recovered",
    )


def _warnings() -> dict[str, Column]:
    return {
        "hidden_text": F.col("hidden_text"),
        "stylesheet_visibility": F.col("style_hides"),
        "inline_visibility": F.col("uncertain_style"),
        "image_alt_fallback": F.col("alt_fallback"),
        "mso_conditional": F.col("mso_conditional"),
        "malformed_markup": F.col("recovered"),
    }


def rendering_warnings() -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in _warnings().items()]))


def html_visible_text(facts: DataFrame, key: list[str]) -> DataFrame:
    return facts.select(*key, "text", "visible_chars", "hidden_chars", "linked_images", rendering_warnings().alias("warnings"))


def hidden_padding_signal() -> Column:
    """A large concealed block beside an actionable image, with certain rendering."""
    certain = ~(F.col("style_hides") | F.col("uncertain_style") | F.col("mso_conditional") | F.col("recovered"))
    return (
        (F.col("hidden_chars") >= 500)
        & (F.col("visible_chars") < MIN_VISIBLE)
        & (F.col("hidden_chars") >= 10 * F.greatest(F.col("visible_chars"), F.lit(1)))
        & (F.col("linked_images") > 0)
        & certain
    )


def html_links(facts: DataFrame, key: list[str], page_url: str | None = None) -> DataFrame:
    """Anchors, form targets, Markdown and bare addresses, in document order.

    Relative targets resolve against the document's base, else against ``page_url``. When a
    style sheet may hide text, labels and bare addresses are unreliable and dropped.
    """
    scan = F.when(F.col("style_hides") | F.col("uncertain_style"), F.lit("")).otherwise(tx.strip_format_controls("text"))
    markdown = F.transform(
        F.regexp_extract_all(scan, F.lit(r"(?i)(\[[^\]]+\]\((?:https?|hxxps?)://[^)]+\))"), 1),
        lambda m: F.struct(
            F.regexp_extract(m, r"^\[([^\]]+)\]", 1).alias("visible"), F.regexp_extract(m, r"\(([^)]+)\)$", 1).alias("href")
        ),
    )
    bare = F.transform(
        F.regexp_extract_all(scan, F.lit(rf"(?i)((?:https?|hxxps?)://[^{tx.SPACE}<>\"']+)"), 1),
        lambda u: F.struct(F.lit("").alias("visible"), F.regexp_replace(u, r"[.,;:)]+$", "").alias("href")),
    )
    labeled = F.transform(
        "links",
        lambda x: F.struct(
            F.when(scan == "", F.lit("")).otherwise(tx.squeeze_space(x["visible"])).alias("visible"), x["href"].alias("href")
        ),
    )
    none = F.lit(None).cast("string")
    fallback = none if page_url is None else F.col(page_url)
    rows = facts.select(
        *key,
        F.coalesce(F.nullif(F.col("base_href"), F.lit("")), none).alias("_base"),
        fallback.alias("_page"),
        F.posexplode(F.concat(markdown, labeled, bare)).alias("link_ord", "l"),
    ).where("trim(l.href) <> ''")
    base = F.when(F.col("_base").rlike(r"(?i)^https?://[^/]"), F.col("_base")).otherwise(F.col("_page"))
    resolved = rows.withColumn("_p", hosts.parse_destination(F.col("l.href"), base))
    keep_raw = F.col("l.href").rlike(r"(?i)^\s*hxxps?:") | ~F.col("_p.valid") | base.isNull()
    return resolved.select(
        *key, "link_ord", F.col("l.visible").alias("visible"),
        F.when(keep_raw, tx.strip(F.col("l.href"))).otherwise(F.col("_p.url")).alias("destination"),
    )


def native_anchor_links(pages: DataFrame, key: list[str], html: str = "html") -> DataFrame:
    """Double-quoted anchor targets by pattern only: a cheap profile for simple pages."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r'(?i)<a\s+href="([^"]*)"'), 1)
    return pages.select(*key, F.posexplode(hrefs).alias("link_ord", "href"))


def html_image_refs(facts: DataFrame, key: list[str], cap: int = 20) -> DataFrame:
    """Embedded, remote and unresolved image references (each capped), from tags and CSS."""
    data, remote = r"(?i)^\s*data:image/[a-z0-9.+-]+", r"(?i)^\s*(?:https?:)?//"
    css = F.flatten(
        F.transform(
            F.concat("styles", F.array("sheet")),
            lambda s: F.regexp_extract_all(unescape_css(s), F.lit(r"(?i)url\(\s*['\"]?([^'\")\s]+)"), 1),
        )
    )
    refs = facts.select(*key, "base_href", F.concat("images", css).alias("_refs"))
    remote_base = F.coalesce(F.col("base_href"), F.lit("")).rlike(remote)

    def is_remote(r: Column) -> Column:
        return r.rlike(remote) | (remote_base & ~r.rlike(r"(?i)^\s*(?:data:|#|[a-z][a-z0-9+.-]*:)"))

    def is_unresolved(r: Column) -> Column:
        return (F.trim(r) != "") & ~r.rlike(r"(?i)^\s*(?:data:|#)") & ~is_remote(r)

    count = lambda p: F.least(F.size(F.filter("_refs", p)), F.lit(cap))
    return refs.select(
        *key,
        count(lambda r: r.rlike(data)).alias("data_images"),
        count(lambda r: ~r.rlike(data) & is_remote(r)).alias("remote_images"),
        count(is_unresolved).alias("unresolved_images"),
    )


def html_password_forms(facts: DataFrame, key: list[str]) -> DataFrame:
    return facts.where("password_form").select(*key)
