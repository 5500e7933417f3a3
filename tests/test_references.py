"""Pages whose texts hold references without their semicolons, as where a title was cut, against the SQL of their queries."""

from __future__ import annotations

import duckdb
import pytest

from syllabary.functions import markup
from syllabary.jobs import catalogue, intake  # noqa: F401

TITLES = ("Cut &amp", "R&D &ampx; &notit; &copy &lt", "Done &amp;amp; &amp;lt; &lt;b&gt; &quot;q&quot; &copy; &amp;", "&&amp;&am & &#38 &;", "plain")
PAGE = '<html><head><title>{0}</title></head><body><nav><ul><li><a href="/a?x=1&copy=2&y=&lt">{0}</a></li></ul></nav><article><h1>{0}</h1><p>{0} and &amp more</p></article></body></html>'


def found_and_wanted(spark, folder, name):
    spark.createDataFrame([(i, f"https://x.invalid/{i}", PAGE.format(t)) for i, t in enumerate(TITLES)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    return sorted(tuple(r) for r in catalogue.QUERIES[name](spark, str(folder)).select(*columns).collect()), sorted(want.fetchall())


@pytest.mark.parametrize("name", ["h5_html_to_text", "h6_page_front", "h_title_and_links"])
def test_only_closed_references_are_decoded(spark, tmp_path, name):
    found, want = found_and_wanted(spark, tmp_path, name)
    assert found == want and len(found) == len(TITLES)


def test_an_ampersand_of_no_reference_is_text_everywhere():
    html = "<p>a &amp;lt; &eacute;&#233;&#xe9; &eacute &#233 & &x; &ampx; a&b</p><pre>&lt</pre><a href='?a&lt=1&amp;b&'>l</a><xmp>a & b</xmp><script>a && b</script>"
    assert markup.raw_markdown(html).split() == "a &lt; ééé &eacute &#233 & &x; &ampx; a&b ``` &lt ``` [l](?a&lt=1&b&)a & b".split()
