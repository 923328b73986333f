"""SQL table functions: ``SELECT ... FROM pages, LATERAL html_select(html, 'a[href]')``.

Spark calls a lateral function for each row and moves its rows in Arrow batches; a selector is parsed once a worker. Where a
whole table is the input, the operators of ``relations`` do the same in batches on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.relations import COLUMNS, Reader
from ..operators.selectors import Matcher, parse

#: Attributes keep their order and duplicates.
_ATTRS = "array<struct<name:string,name_raw:string,value:string,raw:string,name_start:long,value_start:long>>"


@lru_cache(256)
def parsed(selector: str):
    return parse(selector)


@udtf(returnType="tok int, kind string, name string, text string, text_type string, byte_start long, byte_end long", useArrow=True)
class HtmlTokens:
    def eval(self, html: str) -> Iterator[tuple]:
        for i, t in enumerate(Reader(html)):
            yield i, t.kind, t.name, t.said, t.text_type, t.start, t.end


@udtf(returnType=f"elem_id int, name string, ns string, parent_id int, depth int, nth_child int, nth_of_type int, attrs {_ATTRS}", useArrow=True)
class HtmlElements:
    def eval(self, html: str) -> Iterator[tuple]:
        for t in Reader(html):
            if t.kind == "start_tag":
                yield t.elem_id, t.name, t.ns, t.parent, t.depth, t.nth_child, t.nth_of_type, COLUMNS["attrs"][2](t)


@udtf(returnType=f"elem_id int, name string, attrs {_ATTRS}", useArrow=True)
class HtmlSelect:
    def eval(self, html: str, selector: str) -> Iterator[tuple]:
        m = Matcher([parsed(selector)])
        for t in Reader(html):
            if t.kind == "start_tag":
                if m.start_tag(t):
                    yield t.elem_id, t.name, COLUMNS["attrs"][2](t)
            elif t.kind == "end_tag":
                m.end_tag(t)


def register(spark: SparkSession) -> None:
    """Make ``html_tokens``, ``html_elements`` and ``html_select`` known to SQL."""
    spark.udtf.register("html_tokens", HtmlTokens)
    spark.udtf.register("html_elements", HtmlElements)
    spark.udtf.register("html_select", HtmlSelect)
