import pytest

from markloom.functions import tables
from markloom.functions.encodings import CODECS, encoding_for
from markloom.operators import relations as R
from markloom.operators.rewriter import Rewriting, Rule, rewrite, rewrite_bytes, rewrite_str, rewriting
from markloom.operators.selectors import predicate
from markloom.sources import pages
from markloom.streaming.chunked import assembled, rewrite_chunks

PAGE = "<ul class='a b'><li>1<li id=x TYPE=Q>2</ul><p>é<!--c--></p><p a=''>"


def test_encodings():
    assert len(CODECS) == 36 and encoding_for(" LATIN1 ") == "windows-1252" and encoding_for("utf-16le") is None
    for name in CODECS:
        data = b"<p a=b>x</p>"
        assert rewrite_bytes(data, rewriting([Rule("p", "append", "y")]), R.Options(encoding=name))[0] == b"<p a=b>xy</p>"
    how = rewriting([Rule("p", "append", "漢")])
    assert rewrite_bytes("<p>é</p>".encode("cp1252"), how, R.Options(encoding="latin1"))[0] == "<p>é&#28450;</p>".encode("cp1252")
    with pytest.raises(ValueError):
        rewrite_bytes(b"", how, R.Options(encoding="utf-16"))


def test_declared_charset():
    page = b"<meta charset=nope><meta http-equiv=Content-Type content='text/html; charset=windows-1251'>"
    assert R.declared_charset(page + b"<meta charset=utf-8>") == ("windows-1251", len(page))
    out, name, error = rewrite_bytes(page + "<p>ж</p>".encode("cp1251"), Rewriting().on("p", text=lambda t: t.text and t.before("я")), R.Options(adjust_charset=True))
    assert out == page + "<p>яж</p>".encode("cp1251") and name == "windows-1251" and error is None


def test_table_functions(spark):
    tables.register(spark)
    spark.createDataFrame([(1, PAGE)], "page_id long, html string").createOrReplaceTempView("t_pages")
    assert [r["name"] for r in spark.sql("SELECT s.name FROM t_pages, LATERAL html_select(html, 'ul > li') s").collect()] == ["li"]
    assert spark.sql("SELECT s.* FROM t_pages, LATERAL html_tokens(html) s").count() == len(list(R.Reader(PAGE)))
    assert spark.sql("SELECT s.attrs[1].value FROM t_pages, LATERAL html_elements(html) s WHERE s.name = 'li' AND get(s.attrs, 0).value = 'x'").first()[0] == "Q"


@pytest.mark.parametrize("selector", ["*", "li", ".b", "#x", "[type=q]", "[type=q s]", "[a^='']", "li:nth-child(2n+1)", "p:nth-of-type(2)", ":not(.a.b)", "ul, [id]", "[class~=a]", "[id|=x]", "p:first-child"])
def test_predicates_agree_with_the_matcher(spark, selector):
    df = spark.createDataFrame([(1, PAGE)], "doc_id long, html string")
    a = [r["elem_id"] for r in R.elements(df).filter(predicate(selector)).orderBy("elem_id").collect()]
    assert a == [r["elem_id"] for r in R.select(df, selector).orderBy("elem_id").collect()]


def test_status_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, PAGE), (2, "<select><title>"), (3, None)], "doc_id long, html string")
    got = {r["doc_id"]: r for r in R.doc_status(df).collect()}
    assert got[1]["error"] is None and got[2]["error"]["kind"] == "ParsingAmbiguity" and got[3]["n_bytes"] == 0
    (tmp_path / "a.html").write_text(PAGE)
    assert pages.text_files(spark, str(tmp_path)).first()["html"] == PAGE
    assert bytes(pages.binary_files(spark, str(tmp_path)).first()["html"]) == PAGE.encode()


def streamed(spark, where, parts, how, **more):
    schema = "doc_id long, seq int, chunk binary, is_last boolean"
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{where}/in")
    name = f"out_{abs(hash(str(where)))}"
    out = rewrite_chunks(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in"), how, **more)
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{where}/cp").trigger(availableNow=True).start()
    ended = q.awaitTermination(120)
    q.stop()
    assert ended
    return spark.table(name)


def test_chunks_in_any_order(spark, tmp_path):
    data, rules = PAGE.encode(), [Rule("li", "before", "-"), Rule("ul", "append", "!")]
    cut = [data[i : i + 7] for i in range(0, len(data), 7)]
    rows = [(1, k, c, k == len(cut) - 1) for k, c in enumerate(cut)] + [(2, 0, b"<p>" * 100, True)]
    parts = streamed(spark, tmp_path, [rows[:4], rows[4::2][::-1], rows[5::2], rows[2:5]], rules, options=R.Options(max_bytes=200))
    assert parts.filter("doc_id = 1").count() >= 2  # given out as it came
    got = {r["doc_id"]: r for r in assembled(parts).collect()}
    assert bytes(got[1]["html_out"]).decode() == rewrite_str(PAGE, rewriting(rules), esi=False)
    assert got[2]["error_kind"] == "MemoryLimitExceeded"


@pytest.fixture
def numbered():
    def make():
        n = 0

        def li(el):
            nonlocal n
            n += 1
            el.set_attribute("n", str(n))
            el.on_end_tag(lambda tag: tag.before(f"/{n}"))

        return Rewriting().on("li", element=li).on_document(end=lambda e: e.append(f"<!--{n}-->", html=True), bail_out=lambda e: e.append("<!--!-->", html=True))

    return make


def test_handlers_keep_their_state_between_chunks(spark, tmp_path, numbered):
    data = b"<ul>" + b"".join(b"<li>x%d</li>" % k for k in range(9)) + b"</ul>"
    cut = [data[i : i + 11] for i in range(0, len(data), 11)]
    rows = [(1, k, c, k == len(cut) - 1) for k, c in enumerate(cut)]
    parts = streamed(spark, tmp_path, [rows[:3], rows[3:5], rows[5:]], numbered)
    assert bytes(assembled(parts).first()["html_out"]) == rewrite_str(data.decode(), numbered()).encode()


def test_bail_out_in_streams(spark, tmp_path, numbered):
    data = b"<p>a</p><img alt='" + b"l" * 5000 + b"'><li>rest"
    cut = [data[i : i + 512] for i in range(0, len(data), 512)]
    for doc, graceful in ((1, True), (2, False), (3, "handlers")):
        rows = [(doc, k, c, k == len(cut) - 1) for k, c in enumerate(cut)]
        parts = streamed(spark, tmp_path / str(doc), [rows[:4], rows[4:7], rows[7:]], numbered, options=R.Options(max_memory=2000), graceful=graceful)
        got = assembled(parts).first()
        assert got["error_kind"] == "MemoryLimitExceeded"
        assert bytes(got["html_out"]) == (data.replace(b"<img", b"<!--!--><img") if graceful is True else b"<p>a</p>")


def test_streams_of_whole_pages(spark, tmp_path):
    spark.createDataFrame([(1, PAGE), (2, "<li>x")], "doc_id long, html string").write.parquet(f"{tmp_path}/in")
    docs = spark.readStream.schema("doc_id long, html string").parquet(f"{tmp_path}/in")
    for name, df in (("s1", R.select(docs, "li")), ("s2", rewrite(docs, [Rule("li", "remove")])), ("s3", R.doc_status(docs))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    assert spark.table("s1").count() == 3 and spark.table("s2").filter("html_out = ''").count() == 1 and spark.table("s3").count() == 2


def test_small_tables_are_dealt_and_large_ones_are_not(spark, tmp_path, monkeypatch):
    spark.range(10).selectExpr("id AS doc_id", "'<p>' AS html").coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = lambda: R.elements(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan()
    monkeypatch.setattr(R, "SMALL", 10)
    assert "Exchange" not in plan()
