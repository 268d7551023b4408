import pytest

from quillstone.sources import bundles, markup

HTML = """<html><body><nav><p>menu</p></nav><article><h1>Title one</h1><h2>Abstract</h2><p>Long-term physical activity, see <a href="#tbl2">Table 2</a>.</p>
<ul><li>item</li></ul><table><thead><tr><th>Fitting window component</th><th>n</th></tr></thead><tbody><tr><td rowspan=2>a</td><td>1</td></tr><tr><td>2</td></tr></tbody></table>
</article></body></html>"""
JATS = """<article><front><abstract><p>Global life expectancy.</p></abstract></front><body><sec><title>Introduction</title><p>It has increased
<xref ref-type="table" rid="T1">Table 1</xref>.</p><sec><title>Deep</title><p>More.</p></sec></sec>
<sec><title>Results</title><table-wrap id="T9"><label>Table 9</label><table><tr><th>Normal</th><th>MOAD</th></tr><tr><td>1|2</td><td>3</td></tr></table></table-wrap></sec></body></article>"""
ELSEVIER = """<full-text-retrieval-response xmlns:ce="http://x"><body><ce:sections><ce:section><ce:section-title>Introduction</ce:section-title>
<ce:para>The ventral stream <ce:cross-ref refid="tbl1">Table 1</ce:cross-ref>.</ce:para></ce:section></ce:sections></body></full-text-retrieval-response>"""
CALS = """<ce-table id="tbl1"><label>Table 1</label><table><tgroup><colspec colname="a"/><colspec colname="b"/><thead><row><entry>Region</entry><entry>x</entry></row></thead>
<tbody><row><entry morerows="1">V1</entry><entry>1</entry></row><row><entry>2</entry></row><row><entry namest="a" nameend="b">both</entry></row></tbody></tgroup></table></ce-table>"""


def test_html():
    text = markup.article_markdown("x.html", HTML, [("tables/t2.html", '<table id="tbl2"><tr><td>k</td></tr><tr><td>v</td></tr></table>'), ("tables/t3.html", "<table><tr><td>left</td></tr></table>")])
    assert "## Abstract" in text and "# Title one" in text and "menu" not in text and "- item" in text
    assert "| Fitting window component | n |\n| --- | --- |\n| a | 1 |\n| a | 2 |" in text
    assert text.index("physical activity") < text.index("| k |") < text.index("- item")
    assert text.index("## Tables (unreferenced)") < text.index("| left |") and text.count("| k |") == 1


def test_jats_and_generic_xml():
    text = markup.article_markdown("a.xml", JATS, [("tables/T1.xml", "<table-wrap id='T1'><table><tr><th>OOAD</th></tr></table></table-wrap>")])
    assert "## Abstract\n\nGlobal life expectancy." in text and "## Introduction" in text and "### Deep" in text
    assert "| Normal | MOAD |" in text and "1\\|2" in text and "| OOAD |" in text and "unreferenced" not in text
    assert markup.article_markdown("a.xml", "<other><b>x</b> y</other>") == "x y"
    assert markup.article_markdown("a.xml", "no xml  at all") == "no xml at all"
    with pytest.raises(ValueError):
        markup.article_markdown("a.doc", "")


def test_deep_markup():
    deep = "<div>" * 5000 + "<p>inside</p>" + "</div>" * 5000
    assert markup.html_markdown(deep) == ["inside"]
    sections = "<sec><title>s</title>" * 2000 + "<p>low</p>" + "</sec>" * 2000
    assert markup.xml_markdown(f"<article><body>{sections}</body></article>")[-1] == "low"
    assert markup.article_markdown("a.xml", "<x>" * 3000 + "t" + "</x>" * 3000) == "t"


def test_elsevier_and_cals():
    text = markup.article_markdown("content.xml", ELSEVIER, [("tables/tbl1.xml", CALS)])
    assert "## Introduction" in text and "| Region | x |" in text and "| V1 | 2 |" in text and "| both | both |" in text


def test_bundles(spark, tmp_path):
    base = tmp_path / "abc" / "source"
    for provider, name, data in (("ace", "1.html", HTML), ("pubget", "article.xml", JATS), ("pubget", "other.xml", JATS), ("elsevier", "content.xml", ELSEVIER)):
        (base / provider).mkdir(parents=True, exist_ok=True)
        (base / provider / name).write_text(data)
    (base / "elsevier" / "tables").mkdir()
    (base / "elsevier" / "tables" / "tbl1.xml").write_text(CALS)
    (tmp_path / "abc" / "identifiers.json").write_text('{"pmid": " 12 ", "doi": "10.1/x y", "pmcid": ""}')
    found = bundles.discover(spark, str(tmp_path))
    rows = {(r.provider, r.name): r for r in found.collect()}
    assert set(rows) == {("ace", "1.html"), ("pubget", "article.xml"), ("elsevier", "content.xml")}
    assert rows["ace", "1.html"].document_id == "12-10.1_x_y"
    text = {r.provider: r.markdown for r in bundles.extract(found).collect()}
    assert "| V1 | 1 |" in text["elsevier"]
    assert bundles.discover(spark, str(tmp_path), ["ACE"]).count() == 1


def test_text_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text("hello")
    (tmp_path / "b.json").write_text('{"doc_id": "B", "text": " ", "sections": ["one", {"text": "two"}, {"content": "three"}]}')
    (tmp_path / "c.metadata.json").write_text("{}")
    (tmp_path / "d.abbreviations.json").write_text("{}")
    rows = {r.document_id: r.text for r in bundles.text_documents(spark, str(tmp_path)).collect()}
    assert rows == {"a": "hello", "B": "one\n\ntwo\n\nthree"}
