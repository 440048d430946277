"""Stored pages to listing rows, links and images."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from keystead import vocab
from keystead.functions import html, urls
from keystead.functions.text import blank_to_null, contains_any, explode_kept, let
from keystead.session import stage

# Labels: field -> labels, best first. A site may put labels of its own before these;
# see ``site_values``.
DEFAULT_ALIASES = {
    # --- fixed values: page labels per field, best first ---
    "property_name": vocab.NAME_LABELS,
    "price_text": ["価格", "販売価格"],
    "address": ["所在地", "住所"],
    "traffic": ["交通", "沿線・駅", "最寄り駅", "最寄駅"],
    "senyu_menseki_text": ["専有面積"],
    "tochi_menseki_text": ["土地面積", "敷地面積"],
    "tatemono_menseki_text": ["建物面積", "延床面積"],
    "built_text": ["築年月", "築年", "完成時期"],
    "kouzou": ["構造"],
    "madori": ["間取り"],
    "kenpei_text": ["建ぺい率", "建ペイ率"],
    "youseki_text": ["容積率"],
    "youto_chiiki": ["用途地域", "用途地域等"],
    "setsudou": ["接道状況", "接道", "前面道路"],
    "chimoku": ["地目"],
    "tochikenri": ["土地権利", "権利"],
    "kanrihi_text": ["管理費"],
    "syuzen_text": ["修繕積立金"],
    "annual_rent_text": ["想定年収", "年間想定賃料", "想定賃料", "想定年額", "想定賃料(年間)"],
    "gross_yield_text": ["利回り", "表面利回り", "想定利回り"],
    "current_status": ["現況", "建物現況"],
    "biko": ["備考"],
    "type_label": vocab.INVEST_TYPE_LABELS,
}


def field_values(fields: list[str]) -> Column:
    """Per field the first non-empty value under its labels, as one array in field order.

    A projection over the pairs of the page: no join and no shuffle.
    """
    def value(pairs: Column, names: Column) -> Column:
        found = F.transform(names, lambda label: html.spec(pairs, label))
        return F.get(F.filter(found, lambda v: v != ""), F.lit(0))

    names = [F.array(*[F.lit(x) for x in DEFAULT_ALIASES[field]]) for field in fields]
    # bound first: a column that only a lambda reads would be worked out there for every label
    return let(F.col("pairs"), lambda pairs: F.transform(F.array(*names), lambda x: value(pairs, x)))


LABEL_KEYS = 16  # keys a label of a site is spread over: one that every page has is no hot key


def site_values(rows: DataFrame, labels: DataFrame, fields: list[str]) -> DataFrame:
    """Per page and field the first non-empty value under the site's own labels, as columns ``own_<field>``.

    ``rows`` are pages with their ``pairs``, one row a page_id; ``labels`` is a stored table
    (site, property_type, field, label, rank) of any length, met by an equi-join.  The
    lowest rank wins, then the smaller label.  Pages without such a value have no row, so
    the caller joins outer; labels of unknown fields and rows with a NULL are left out.
    """
    page = ["page_id", "site", "property_type"]
    pairs = explode_kept(rows, page, F.filter("pairs", lambda p: p["value"] != ""), "p").select(
        *page, F.col("p.label").alias("label"), F.col("p.value").alias("value"),
        F.pmod(F.xxhash64("page_id"), F.lit(LABEL_KEYS)).alias("_key"),
    )
    names = (
        labels.filter(F.col("field").isin(fields))
        .groupBy("site", "property_type", "field", "label").agg(F.min("rank").alias("rank"))
        .withColumn("_key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(LABEL_KEYS - 1).cast("bigint"))))
    )
    met = pairs.join(names, ["site", "property_type", "label", "_key"]).filter(F.col("rank").isNotNull())
    best = lambda f: F.min_by("value", F.when(F.col("field") == f, F.struct("rank", "label")))
    return met.groupBy("page_id").agg(*[best(f).alias(f"own_{f}") for f in fields])


def page_status(body: Column | str, http_status: Column | None = None, head: Column | str | None = None) -> Column:
    """active, ended, busy or error by the page itself.

    An HTTP status other than 200, a telling title, or a telling phrase anywhere.
    ``head`` is the title, if it is a column already.
    """
    body = F.col(body) if isinstance(body, str) else body
    head = html.title(body) if head is None else head

    def by_title(t: Column) -> Column:
        return (
            F.when(F.contains(t, F.lit(vocab.SKIP_TITLE_WORDS["busy"])), "busy")
            .when(contains_any(t, vocab.ENDED_TITLE_WORDS), "ended")
        )

    status = F.coalesce(
        let(F.col(head) if isinstance(head, str) else head, by_title),
        F.when(contains_any(body, vocab.ENDED_PHRASES), "ended").otherwise("active"),
    )
    if http_status is not None:
        status = F.when(F.coalesce(http_status != 200, F.lit(True)), "error").otherwise(status)
    return status


def label_rows(pages: DataFrame, precedence: str = "first") -> DataFrame:
    """Adds ``markup`` and ``pairs``: the label/value pairs of each page."""
    pick = html.first_per_label if precedence == "first" else html.longest_table_value
    return (
        pages.withColumn("markup", html.visible_markup("html"))
        .withColumn("pairs", html.label_pairs("markup"))
        .withColumn("pairs", pick(F.col("pairs")))
    )


def property_name(pairs: Column | str = "pairs", markup: Column | str = "markup") -> Column:
    """Name cascade: spec label, breadcrumb, first heading; NULL when all fail."""
    names = F.array(*[F.lit(x) for x in vocab.NAME_LABELS])
    found = let(F.col(pairs) if isinstance(pairs, str) else pairs, lambda p: F.transform(names, lambda n: html.spec(p, n)))
    known = F.filter(found, lambda v: ~v.isin("", "-"))
    last = F.try_element_at(html.breadcrumb(markup), F.lit(-1))
    crumb = F.filter(F.array(last), lambda c: ~c.isin(vocab.BREADCRUMB_STOP) & (F.char_length(c) < 40))
    return F.coalesce(F.get(known, F.lit(0)), F.get(crumb, F.lit(0)), html.heading(markup))


def investment_kind(label: Column) -> Column:
    """apartment for a whole building, else kodate; NULL without a label."""
    return F.when(
        F.coalesce(label != "", F.lit(False)),
        F.when(contains_any(label, vocab.INVEST_APARTMENT_WORDS), "apartment").otherwise("kodate"),
    )


def extract_listings(pages: DataFrame, site_labels: DataFrame | None = None) -> DataFrame:
    """Pages (page_id, site, property_type, url, html) to raw listing rows.

    Ended and busy pages are left out.  One pass over the pages without a shuffle.  With a
    table of site labels (see ``site_values``) the labels of the site go first; the pairs of
    each page, not its text, are then written and joined by page_id.
    """
    live = pages.filter(page_status("html") == "active")
    fields = [f for f in DEFAULT_ALIASES if f != "property_name"]
    rows = label_rows(live).select(
        "page_id", "site", "property_type", "url", property_name().alias("property_name"),
        field_values(fields).alias("_values"), *([] if site_labels is None else ["pairs"]),
    )
    default = {f: F.get("_values", F.lit(i)) for i, f in enumerate(fields)}
    value = {"property_name": F.col("property_name"), **default}
    if site_labels is not None:
        rows = stage(rows, "pairs")
        rows = rows.join(site_values(rows, site_labels, list(value)), "page_id", "left")
        value = {f: F.coalesce(F.col(f"own_{f}"), v) for f, v in value.items()}
    return rows.select(
        "page_id", "site", "property_type", "url", *[v.alias(f) for f, v in value.items()],
    ).withColumn("invest_kind", investment_kind(F.col("type_label")))


def page_links(pages: DataFrame, path_pattern: str | None = None, canonical: bool = False) -> DataFrame:
    """Distinct (src_url, dst_url) edges; optionally only paths of a form.

    The pattern is checked before the shuffle of the distinct.
    """
    bases = pages.select(F.col("url").alias("src_url"), urls.base_parts("url").alias("base"), "html")
    found = explode_kept(bases, ["src_url", "base"], html.hrefs(html.visible_markup("html")), "href")
    edges = found.select("src_url", urls.resolve(F.col("href"), F.col("base")).alias("dst_url"))
    if path_pattern:
        edges = edges.filter(urls.url_part("dst_url", 3).rlike(path_pattern))
    if canonical:
        edges = edges.withColumn("dst_url", urls.canonical_url("dst_url"))
    return edges.filter(F.col("dst_url").isNotNull()).dropDuplicates(["src_url", "dst_url"])


DETAIL_PATHS = r"^/(mansion|kodate|toushi|tochi)/\d+/?$"


def script_ids(pages: DataFrame, pattern: str = r"'number':\s*'([^']+)'") -> DataFrame:
    """Distinct ids scraped from script text, per page, sorted."""
    ids = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))))
    return pages.select("page_id", "url", F.posexplode(ids).alias("pos", "item_id"))


def next_pages(pages: DataFrame) -> DataFrame:
    """Next list page: the link that says so, else the canonical URL one page on."""
    says_next = lambda x: F.contains(x["text"], F.lit("次")) | x["text"].isin(">", "»")
    found = (
        pages.select("page_id", "url", html.visible_markup("html").alias("markup"))
        .select(
            "page_id", "url", html.canonical_link("markup").alias("canonical"),
            F.get(F.filter(html.links("markup"), says_next), F.lit(0))["href"].alias("href"),
        )
    )
    return found.select(
        "page_id", "url",
        F.coalesce(urls.absolute_url("href", "url"), urls.next_page_url("canonical")).alias("next_url"),
    )


def page_images(markup: Column | str, base: Column | str) -> Column:
    """array<struct(url, label)>: absolute, of a picture type, first per URL."""
    suffix = r"(?i)^[^?]*\.(" + "|".join(vocab.IMAGE_SUFFIXES) + r")(\?.*)?$"
    found = let(
        F.struct(urls.base_parts(base).alias("base"), html.images(markup).alias("images")),
        lambda p: F.transform(
            p["images"], lambda i: F.struct(urls.resolve(i["src"], p["base"]).alias("url"), i["label"].alias("label"))
        ),
    )
    return html.first_by(F.filter(found, lambda i: i["url"].rlike(suffix)), "url")


def image_category(label: Column, url: Column) -> Column:
    """layout, exterior or interior; NULL for a picture of something else."""
    text = F.lower(F.concat(F.coalesce(label, F.lit("")), F.lit("\n"), F.coalesce(url, F.lit(""))))
    return let(text, lambda t: (
        F.when(contains_any(t, vocab.IMAGE_REJECT), None)
        .when(contains_any(t, vocab.IMAGE_LAYOUT), "layout")
        .when(contains_any(t, vocab.IMAGE_EXTERIOR), "exterior")
        .otherwise("interior")
    ))


def clean_images(images: Column) -> Column:
    """Pictures worth keeping, as array<struct(url, category)>."""
    marked = F.transform(
        images, lambda i: F.struct(i["url"].alias("url"), image_category(i["label"], i["url"]).alias("category"))
    )
    return F.filter(marked, lambda i: i["category"].isNotNull())


ANALYSIS = T.StructType([
    T.StructField("interior_score", T.DoubleType()), T.StructField("layout_score", T.DoubleType()),
    T.StructField("plot_shape_type", T.StringType()), T.StructField("plot_shape_description", T.StringType()),
    T.StructField("maintenance_score", T.DoubleType()), T.StructField("maintenance_comment", T.StringType()),
])


def analysis_reply(text: Column | str, schema: T.StructType = ANALYSIS, defaults: dict | None = None) -> Column:
    """The JSON object inside a free text, field by field with its default.

    Without an object the comments say that there was nothing to judge.
    """
    text = F.col(text) if isinstance(text, str) else text
    defaults = defaults or vocab.ANALYSIS_DEFAULTS
    found = blank_to_null(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    parsed = F.from_json(found, schema)
    out = []
    for f in schema.fields:
        default = F.lit(defaults[f.name])
        if f.name in ("plot_shape_description", "maintenance_comment"):
            default = F.when(found.isNull(), F.lit(vocab.NO_IMAGE_COMMENT)).otherwise(default)
        out.append(F.coalesce(parsed[f.name], default).alias(f.name))
    return F.struct(*out)


STATE_SCHEMA = (
    "props struct<pageProps:struct<"
    "propertyList:array<struct<detailUrl:string>>,"
    "summary:struct<tableItems:array<struct<title:string,data:struct<text:string,html:string>>>>>>"
)


def state_detail_urls(pages: DataFrame, base: str = "") -> DataFrame:
    """Detail URLs listed in the embedded page state."""
    state = F.from_json(html.state_json("html"), STATE_SCHEMA)
    return pages.select(
        "page_id", F.posexplode(state["props"]["pageProps"]["propertyList"]).alias("pos", "item")
    ).filter(F.col("item.detailUrl") != "").select("page_id", "pos", F.concat(F.lit(base), F.col("item.detailUrl")).alias("detail_url"))


def state_values(pages: DataFrame, titles: list[str] | None = None) -> DataFrame:
    """Values of the embedded page state by title, synonyms included."""
    state = F.from_json(html.state_json("html"), STATE_SCHEMA)
    items = state["props"]["pageProps"]["summary"]["tableItems"]

    def value(title: str) -> Column:
        names = vocab.STATE_SYNONYMS.get(title, [title])
        data = F.get(F.filter(F.col("_items"), lambda t: t["title"].isin(names)), F.lit(0))["data"]
        return F.coalesce(data["text"], html.plain_text(data["html"]), F.lit("")).alias(title)

    return pages.withColumn("_items", items).select("page_id", *map(value, titles or vocab.STATE_SYNONYMS))


def snake_case(c: Column | str) -> Column:
    """CamelCase to snake_case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, "(?<!^)(?=[A-Z])", "_"))


def error_rows(rejected: DataFrame, model: Column, ts: Column) -> DataFrame:
    """The errors table: one row per rejected page."""
    return rejected.select(
        snake_case(model).alias("company_type"), F.sha2("url", 256).alias("file"), "url",
        F.array_join("reasons", ", ").alias("reason"), ts.alias("ts"),
    )


def decode_page(content: Column | str, charset: Column | str, fallback: str = "utf-8") -> Column:
    """Page bytes to text by the charset of the site.

    UTF-8 pages are decoded in the JVM, which knows no Japanese charsets: only pages of
    other charsets pass an Arrow step.  Text that comes out broken (U+FFFD) is decoded
    by the fallback charset instead, unless that is broken as well.
    """
    raw, names = (F.col(content) if isinstance(content, str) else content), F.lower(F.lit(charset) if isinstance(charset, str) else charset)
    utf_8 = ("utf-8", "utf8", "")

    def plain() -> Column:
        return F.make_valid_utf8(raw.cast("string"))

    @F.pandas_udf("string")
    def by_name(pages: pd.Series, charsets: pd.Series) -> pd.Series:
        texts = [None if b is None else b.decode(n, errors="replace") for b, n in zip(pages, charsets)]
        return pd.Series(texts, dtype="object")

    other = names.isNotNull() & ~names.isin(*utf_8)
    declared = F.when(other, by_name(F.when(other, raw), names)).otherwise(plain())
    second = plain() if fallback.lower() in utf_8 else by_name(raw, F.lit(fallback))
    broken = lambda t: F.contains(t, F.lit("\ufffd"))
    return let(declared, lambda t: F.when(broken(t) & ~broken(second), second).otherwise(t))
