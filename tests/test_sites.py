"""Rewrites of generated pages on hand-made ones, and the agent's merge by a schema."""

import json

from pyspark.sql import functions as F

from webloom.dom import sites
from webloom.dom.markdown import convert
from webloom.dom.tree import parse, to_html
from webloom.operators import services


def rewritten(html):
    root = parse(html)
    return sites.prepare(root), to_html(root)


def test_documentation():
    page = """<div class="md-content"><h2>Use<a class="headerlink" href="#use">P</a></h2>
<div class="highlight language-python"><table class="highlighttable"><tr><td class="linenos">1 2</td><td class="code"><pre><code>a = 1
b = 2</code></pre></td></tr></table></div>
<div class="admonition warning"><p class="admonition-title">Take care</p><p>It is <b>hot</b>.</p> and wet</div><div class="admonition tip"><p>Drink.</p></div>
<div class="tabbed-set"><div class="tabbed-labels"><label>Linux</label></div><div class="tabbed-content"><div class="tabbed-block"><p>apt</p></div><div class="tabbed-block"><p>brew</p></div></div></div></div>"""
    names, html = rewritten(page)
    assert names == ["mkdocs"] and "headerlink" not in html and "1 2" not in html
    md = convert(page, only_main=False)
    assert "## Use\n" in md + "\n" and "```python\na = 1\nb = 2\n```" in md and "> **Take care:** It is hot. and wet" in md and "> **Tip:** Drink." in md
    assert md.index("#### Linux") < md.index("apt") < md.index("#### Tab 2") < md.index("brew")


def test_counter_lists():
    item = lambda level, text: f'<p data-list-level="{level}">{text}</p>'
    page = "<div>" + item(1, "one <b>b</b>") + item(2, "one a") + item(3, "deep") + item(2, "one b") + "<span>x</span>" + item(1, "two") + "</div>" + "<div>" + item(2, "other") + item("?", "up") + "</div>"
    names, html = rewritten(page)
    assert names == ["css_counters"] and "data-list-level" not in html
    assert html == (
        "<div><ol><li>one <b>b</b><ol><li>one a<ol><li>deep</li></ol></li><li>one b</li></ol></li><li>two</li></ol><span>x</span></div><div><ol><ol><li>other</li></ol><li>up</li></ol></div>"
    )
    far = "<div>" + item(1, "a") + "<i></i>" * 10 + item(1, "b") + "</div>"
    assert rewritten(far)[1].count("<ol>") == 2 and rewritten(far.replace("<i></i>", "", 1))[1].count("<ol>") == 1
    assert rewritten('<ul style="counter-reset: x"><li>1</li></ul>')[1].startswith("<ol")


def test_blogs():
    page = """<html><head><meta name="generator" content="WordPress 6"></head><body><header><h1>The title</h1></header><article><p>Text</p><img src="data:image/svg+xml;x"><div class="sharedaddy">share</div>
<div class="wp-block-group"><p>more</p></div></article><div class="post-navigation">next</div><div class="star-rating">5</div></body></html>"""
    names, html = rewritten(page)
    assert names == ["wordpress"] and "<article><h1>The title</h1><p>Text</p>" in html
    assert not any(x in html for x in ("share", "next", "svg", "star-rating")) and "more" in html
    inside = '<main class="hentry"><h1 class="entry-title">T</h1><p>x</p></main>'
    assert rewritten(inside)[1].count("T") == 1
    assert rewritten("<p>plain</p>") == ([], "<p>plain</p>")


def test_agent_merges_by_schema(spark):
    raw = spark.createDataFrame([("https://a.example/1", "<main><p>one fine day here</p></main>", 200), ("https://a.example/2", "<main><p>two more words here</p></main>", 200)], "url string, html string, status int")
    said = []

    def model(text):
        return F.when(text.startswith("Combine"), F.concat(F.lit('```json\n{"n": '), F.size(F.split(text, '"url"')).cast("string"), F.lit("}\n```"))).otherwise(
            F.concat(F.lit('{"schema": '), F.when(F.contains(text, F.lit("conform")), "true").otherwise("false"), F.lit("}"))
        )

    urls = ("https://a.example/1", "https://a.example/2")
    plain = json.loads(services.agent(None, raw, model, "Gather", urls=urls).first().compiled)
    assert [json.loads(i["data"]) for i in plain["items"]] == [{"schema": False}] * 2
    assert json.loads(services.agent(None, raw, model, "Gather", urls=urls, schema='{"n": "number"}').first().compiled) == {"n": 3}
    broken = lambda text: F.when(text.startswith("Combine"), "no json").otherwise('{"x": 1}')
    assert len(json.loads(services.agent(None, raw, broken, "Gather", urls=urls, schema="{}").first().compiled)["items"]) == 2
    assert services.agent(None, raw.limit(0), model, "Gather", urls=urls, schema="{}").first().compiled == "{}" and not said
