"""The engine's registered queries over ``pages``, with the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relations as R
from ..operators.selectors import attribute

QUERIES: dict = {}
ORACLES: dict = {}
ID = "page_id"
#: SQL: a page without the bodies of its script and style.
CLEAN = r"regexp_replace(html, '<(script|style)>[^<]*(<[^/][^<]*|</p>[^<]*)*</(script|style)>', '<\1></\1>', 'g')"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_LINKS = "unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))"


@query("SELECT page_id, cast(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS n_links FROM pages WHERE len(regexp_extract_all(html, '<a href=')) > 0")
def links_per_page(spark, sf_dir):
    return R.count_matches(pages(spark, sf_dir), "a[href]", ID).select(ID, F.col("n").alias("n_links"))


@query(f"SELECT page_id, {_LINKS} AS href FROM pages")
def link_targets(spark, sf_dir):
    return R.select(pages(spark, sf_dir), "a[href]", ID, columns=("attrs",)).select(ID, attribute("href").alias("href"))


@query(f"SELECT page_id, href FROM (SELECT page_id, {_LINKS} AS href FROM pages) WHERE starts_with(href, '/e')")
def links_by_prefix(spark, sf_dir):
    return R.select(pages(spark, sf_dir), 'a[href^="/e"]', ID, columns=("attrs",)).select(ID, attribute("href").alias("href"))


@query(f"SELECT page_id, href FROM (SELECT page_id, {_LINKS} AS href FROM pages) WHERE ends_with(href, 'er')")
def links_by_suffix(spark, sf_dir):
    return R.select(pages(spark, sf_dir), 'a[href$="er"]', ID, columns=("attrs",)).select(ID, attribute("href").alias("href"))


@query(f"SELECT page_id, href FROM (SELECT page_id, {_LINKS} AS href FROM pages) WHERE contains(href, 'th')")
def links_by_substring(spark, sf_dir):
    return R.select(pages(spark, sf_dir), "a[href*=th]", ID, columns=("attrs",)).select(ID, attribute("href").alias("href"))


def _texts(spark, sf_dir, selector, name):
    return R.select_content(pages(spark, sf_dir), selector, "text", ID, columns=("text",)).select(ID, F.col("text").alias(name))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages WHERE regexp_matches(html, '<title>[^<]')")
def page_title(spark, sf_dir):
    return _texts(spark, sf_dir, "title", "title")


@query("SELECT page_id, regexp_extract(html, '<h1>([^<]*)', 1) AS h1 FROM pages WHERE regexp_matches(html, '<h1>[^<]')")
def page_h1(spark, sf_dir):
    return _texts(spark, sf_dir, "h1", "h1")


@query("SELECT regexp_extract(html, '<title>([^<]*)', 1) AS title, count(*) AS n FROM pages WHERE regexp_matches(html, '<title>[^<]') GROUP BY 1")
def distinct_titles(spark, sf_dir):
    return _texts(spark, sf_dir, "title", "title").groupBy("title").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def page_lang(spark, sf_dir):
    return R.select(pages(spark, sf_dir), "html[lang]", ID, columns=("attrs",)).select(ID, attribute("lang").alias("lang"))


@query("SELECT regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, count(*) AS n FROM pages GROUP BY 1")
def lang_counts(spark, sf_dir):
    return page_lang(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT page_id FROM pages WHERE contains(html, '<html lang=\"de\"') OR contains(html, '<html lang=\"de-')")
def lang_dashmatch(spark, sf_dir):
    return R.select(pages(spark, sf_dir), "html[lang|=DE]", ID, columns=()).select(ID)


@query("SELECT page_id, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) AS charset FROM pages")
def meta_charset(spark, sf_dir):
    return R.select(pages(spark, sf_dir), "meta[charset]", ID, columns=("attrs",)).select(ID, attribute("charset").alias("charset"))


@query(f"SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all({CLEAN}, '<([a-z][a-z0-9]*)', 1)) AS name FROM pages) GROUP BY 1")
def tag_histogram(spark, sf_dir):
    return R.elements(pages(spark, sf_dir), ID, columns=("name",)).groupBy("name").agg(F.count("*").alias("n"))


@query(f"SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all({CLEAN}, '</([a-z][a-z0-9]*)', 1)) AS name FROM pages) GROUP BY 1")
def end_tag_histogram(spark, sf_dir):
    return R.tokens(pages(spark, sf_dir), ID, kinds=("end_tag",), columns=("name",)).groupBy("name").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, cast(len(regexp_extract_all({CLEAN}, '<[a-z]')) AS BIGINT) AS n FROM pages")
def start_tag_count_star(spark, sf_dir):
    return R.count_matches(pages(spark, sf_dir), "*", ID).select(ID, "n")


@query("SELECT page_id, unnest(regexp_extract_all(html, '<!--(.*?)-->', 1)) AS comment FROM pages")
def comment_text(spark, sf_dir):
    return R.tokens(pages(spark, sf_dir), ID, kinds=("comment",), columns=("text",)).withColumnRenamed("text", "comment")


@query("SELECT page_id, 'html' AS name, false AS force_quirks FROM pages WHERE starts_with(html, '<!DOCTYPE html>')")
def doctype_name(spark, sf_dir):
    found = R.tokens(pages(spark, sf_dir), ID, kinds=("doctype",), columns=("doctype",))
    return found.select(ID, "doctype.name", "doctype.force_quirks")


@query("SELECT page_id, regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1) AS ad FROM pages WHERE regexp_matches(html, '<div class=\"ad\">[^<]')")
def class_ad_text(spark, sf_dir):
    return _texts(spark, sf_dir, "div.ad", "ad")


@query(
    "SELECT page_id, name, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<(script|style)>.*?</(script|style)>', '', 'g'), '<(nav|ul|li|h1|footer)>', 1)) AS name FROM pages) GROUP BY ALL"
)
def not_ad_blocks(spark, sf_dir):
    found = R.select(pages(spark, sf_dir), ":not(.ad):not(a, p, b, br, html, head, body):not(meta, title, style, script, article)", ID, columns=("name",))
    return found.groupBy(ID, "name").agg(F.count("*").alias("n"))


@query("SELECT page_id, cast(1 AS BIGINT) AS n FROM pages WHERE contains(html, '<p>')")
def child_p(spark, sf_dir):
    return R.count_matches(pages(spark, sf_dir), "article > p", ID).select(ID, "n")


@query("SELECT page_id, cast(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n FROM pages WHERE contains(html, '<p>')")
def descendant_p(spark, sf_dir):
    return R.count_matches(pages(spark, sf_dir), "article p", ID).select(ID, "n")


_ITEMS = "regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)', 1)"


@query(f"SELECT page_id, unnest({_ITEMS}) AS item FROM pages")
def nav_items(spark, sf_dir):
    return _texts(spark, sf_dir, "nav > ul > li", "item")


@query(f"SELECT page_id, {_ITEMS}[1] AS item FROM pages WHERE len({_ITEMS}) > 0")
def first_item(spark, sf_dir):
    return _texts(spark, sf_dir, "li:first-child", "item")


_NUMBERED = f"SELECT page_id, unnest({_ITEMS}) AS item, unnest(generate_series(1, len({_ITEMS}))) AS k FROM pages"


@query(f"SELECT page_id, item FROM ({_NUMBERED}) WHERE k % 2 = 1")
def odd_items(spark, sf_dir):
    return _texts(spark, sf_dir, "li:nth-child(2n+1)", "item")


@query(f"SELECT page_id, item FROM ({_NUMBERED}) WHERE k <= 3")
def nth_of_type_li(spark, sf_dir):
    return _texts(spark, sf_dir, "li:nth-of-type(-n + 3)", "item")


@query("SELECT page_id, regexp_extract(html, '<script>(.*?)</script>', 1) AS body FROM pages WHERE regexp_matches(html, '<script>.')")
def script_bodies(spark, sf_dir):
    return _texts(spark, sf_dir, "script", "body")


@query("SELECT page_id, regexp_extract(html, '<style>(.*?)</style>', 1) AS body FROM pages WHERE regexp_matches(html, '<style>.')")
def style_bodies(spark, sf_dir):
    return _texts(spark, sf_dir, "style", "body")


@query(
    "SELECT page_id, text_type, cast(sum(n) AS BIGINT) AS chars FROM ("
    "SELECT page_id, 'RCData' AS text_type, length(regexp_extract(html, '<title>([^<]*)', 1)) AS n FROM pages"
    " UNION ALL SELECT page_id, 'RawText', length(regexp_extract(html, '<style>(.*?)</style>', 1)) FROM pages"
    " UNION ALL SELECT page_id, 'ScriptData', length(regexp_extract(html, '<script>(.*?)</script>', 1)) FROM pages"
    " UNION ALL SELECT page_id, 'Data', length(regexp_replace(regexp_replace(html, '<(title|style|script)>.*?</(title|style|script)>', '', 'g'), '<[^>]*>', '', 'g')) FROM pages"
    ") WHERE n > 0 GROUP BY ALL"
)
def text_by_type(spark, sf_dir):
    return R.text_sizes(pages(spark, sf_dir), ID)


@query("SELECT page_id, unnest(['html', 'body']) AS name FROM pages WHERE NOT contains(html, '</html>')")
def unclosed_elements(spark, sf_dir):
    return R.elements(pages(spark, sf_dir), ID, columns=("name", "close_tok")).filter("close_tok IS NULL AND name IN ('html', 'body')").select(ID, "name")


@query("SELECT page_id, cast(strlen(html) AS BIGINT) AS n_bytes, cast(NULL AS VARCHAR) AS error FROM pages")
def status(spark, sf_dir):
    return R.doc_status(pages(spark, sf_dir), ID).select(ID, "n_bytes", F.col("error.kind").alias("error"))


@query(f"SELECT page_id, 'href' AS name, href AS value FROM (SELECT page_id, {_LINKS} AS href FROM pages) UNION ALL SELECT page_id, 'lang', regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) FROM pages UNION ALL SELECT page_id, 'charset', 'utf-8' FROM pages UNION ALL SELECT page_id, 'class', 'ad' FROM pages")
def attribute_rows(spark, sf_dir):
    return R.attributes(pages(spark, sf_dir), ID).select(ID, "name", "value")


_SEVEN = ("ul", "ul > li", "table > tbody td dfn", "body table > tbody tr", "body [href]", "div img", "div.note span")


@query(
    "SELECT selector, cast(sum(n) AS BIGINT) AS n FROM (SELECT 'ul' AS selector, len(regexp_extract_all(html, '<ul>')) AS n FROM pages"
    " UNION ALL SELECT 'ul > li', len(regexp_extract_all(html, '<li>')) FROM pages UNION ALL SELECT 'body [href]', len(regexp_extract_all(html, '<a href=')) FROM pages) GROUP BY 1"
)
def multi_selector_matches(spark, sf_dir):
    found = R.select(pages(spark, sf_dir), list(_SEVEN), ID, columns=())
    names = F.element_at(F.array(*map(F.lit, _SEVEN)), F.col("match_id") + 1)
    return found.groupBy(names.alias("selector")).agg(F.count("*").alias("n"))


# -- rewrites

from ..operators.rewriter import Rewriting, Rule, rewrite  # noqa: E402


def _rewritten(*rules: Rule):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rewrite(pages(spark, sf_dir), list(rules), ID).select(ID, "html_out")

    return f


#: Name: rules, SQL of the output.
REWRITES = {
    "identity": ((), "html"),
    "rewrite_https": ((Rule("a", "set_attribute", "https://x/", name="href", replace_prefix="/"),), "regexp_replace(html, '<a href=\"/', '<a href=\"https://x/', 'g')"),
    "defer_scripts": ((Rule("script", "set_attribute", "", name="defer"),), "replace(html, '<script>', '<script defer=\"\">')"),
    "strip_scripts": ((Rule("script", "remove"),), "regexp_replace(html, '<script>.*?</script>', '')"),
    "strip_comments": ((Rule("*", "remove", target="comments"),), "regexp_replace(html, '<!--.*?-->', '', 'g')"),
    "strip_ads": ((Rule("div.ad", "remove"),), "regexp_replace(html, '<div class=\"ad\">[^<]*</div>', '')"),
    "unwrap_b": ((Rule("b", "remove_and_keep_content"),), "replace(replace(html, '<b>', ''), '</article>', '')"),
    "set_title": ((Rule("title", "set_inner_content", "A & B"),), "regexp_replace(html, '<title>[^<]*</title>', '<title>A &amp; B</title>')"),
    "append_footer": ((Rule("footer", "append", "<hr>", html=True),), "replace(html, '</footer>', '<hr></footer>')"),
    "prepend_nav": ((Rule("nav", "prepend", "x < y"),), "replace(html, '<nav>', '<nav>x &lt; y')"),
    "before_h1": ((Rule("h1", "before", "<hr>", html=True),), "replace(html, '<h1>', '<hr><h1>')"),
    "after_article": ((Rule("article", "after", "<hr>", html=True),), "replace(html, '</article>', '</article><hr>')"),
    "replace_ad": ((Rule("div.ad", "replace", "<i></i>", html=True),), "regexp_replace(html, '<div class=\"ad\">[^<]*</div>', '<i></i>')"),
    "set_attr_target": ((Rule("a[href]", "set_attribute", "_blank", name="target"),), "regexp_replace(html, '(<a href=\"[^\"]*\")', '\\1 target=\"_blank\"', 'g')"),
    "remove_attr_class": ((Rule("[class]", "remove_attribute", name="class"),), "replace(html, '<div class=\"ad\">', '<div>')"),
    "rename_h1": ((Rule("h1", "set_tag_name", "h2"),), "replace(replace(html, '<h1>', '<h2>'), '</h1>', '</h2>')"),
    "empty_ul": ((Rule("ul", "set_inner_content", ""),), "regexp_replace(html, '<ul>.*?</ul>', '<ul></ul>', 'g')"),
}
for _name, (_rules, _sql) in REWRITES.items():
    QUERIES[f"rewrite_{_name}".replace("rewrite_rewrite_", "rewrite_")] = _rewritten(*_rules)
    ORACLES[f"rewrite_{_name}".replace("rewrite_rewrite_", "rewrite_")] = f"SELECT page_id, {_sql} AS html_out FROM pages"


def _end_note() -> Rewriting:
    return Rewriting().on_document(end=lambda e: e.append("<!-- end -->", html=True))


@query("SELECT page_id, html || '<!-- end -->' AS html_out FROM pages")
def doc_end_append(spark, sf_dir):
    return rewrite(pages(spark, sf_dir), _end_note, ID).select(ID, "html_out")


def _numbered_links() -> Rewriting:
    n = 0

    def link(el) -> None:
        nonlocal n
        n += 1
        el.set_attribute("data-n", str(n))

    return Rewriting().on("nav a", element=link)


_PLAIN = "regexp_extract(html, '(?s)^(.*?)<nav>', 1)"
_NAV = "string_split(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href=')"


@query(
    f"SELECT page_id, {_PLAIN} || '<nav>' || {_NAV}[1] || array_to_string(list_transform({_NAV}[2:], lambda x, i: '<a href=' || regexp_replace(x, '^(\"[^\"]*\")', '\\1 data-n=\"' || i || '\"')), '')"
    " || '</nav>' || regexp_extract(html, '(?s)</nav>(.*)$', 1) AS html_out FROM pages"
)
def callback_numbered_links(spark, sf_dir):
    return rewrite(pages(spark, sf_dir), _numbered_links, ID).select(ID, "html_out")


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS body, replace(html, '\"', '&quot;') AS attribute FROM pages")
def escapes(spark, sf_dir):
    body = F.replace(F.replace(F.replace("html", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return pages(spark, sf_dir).select(ID, body.alias("body"), F.replace("html", F.lit('"'), F.lit("&quot;")).alias("attribute"))


from . import cases  # noqa: E402

QUERIES |= cases.QUERIES
ORACLES |= cases.ORACLES
