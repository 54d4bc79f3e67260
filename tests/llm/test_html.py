import html as entities
import re

from fieldglass.llm import htmltext
from fieldglass.llm.trainingpages import labelled_pages


def test_held_out_layouts():
    field = htmltext.trained()
    right = total = 0
    for blocks, labels in labelled_pages(120, seed=1234):
        got = field.decode(blocks)
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_is_the_best_of_all_labellings():
    import itertools

    field = htmltext.trained()
    for blocks, _ in labelled_pages(40, seed=5):
        if not 0 < len(blocks) <= 9:
            continue
        e = [sum(field.emission[k] for k in f) for f in htmltext.features(blocks)]

        def score(y, e=e):
            return field.start[y[0]] + sum(x * l for x, l in zip(e, y, strict=True)) + sum(field.transition[a][b] for a, b in zip(y, y[1:], strict=False))

        best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
        assert abs(score(best) - score(tuple(map(int, field.decode(blocks))))) < 1e-9


def test_pages(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in htmltext.extract(df).collect()}
    rows = df.collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id].text == "\n\n".join(p for p in parts if p)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_cases(spark):
    main = "<p>A first full sentence, long enough to be read as prose by anyone.</p><p>And &eacute; second one &amp; more,\n with   spaces.</p>"
    rows = [
        (1, "u", None, "mine"), (2, "u", "", None), (3, None, "<html><script>var a='</p>'</script></html>", None),
        (4, "u", f"<body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Title</h1>{main}<div class='ad'>Buy now</div></article><div class=comments><p>Great post, thanks a lot!</p></div><footer>&copy; x</footer>", None),
        (5, "u", "<article>" + "<p>Sentence number one, and more words here.</p>" * 5000, None), (6, "u", "<" * 5000 + "a \" b", None), (6, "u", "<p", None),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = htmltext.extract(df).collect()
    assert len(got) == 7
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == by[3].text == "" and by[1].n_chars == 0
    assert by[4].text == "Title\n\nA first full sentence, long enough to be read as prose by anyone.\n\nAnd é second one & more, with spaces."
    assert by[5].n_chars == 5000 * 41 + 4999 * 2 == len(by[5].text)
    assert htmltext.extract(df.limit(0)).count() == 0


def test_unclosed_elements_hide_nothing():
    field = htmltext.trained()
    main = "<article><h1>Title</h1><p>A first full sentence, long enough to be read as prose by anyone.</p><p>And a second one, with some more words, that ends here.</p></article>"
    want = "Title\n\nA first full sentence, long enough to be read as prose by anyone.\n\nAnd a second one, with some more words, that ends here."
    assert htmltext.main_text(f"<body>{main}</body>", field)[0] == want
    for head in ("<header><form><datalist><option value=a><option value=b></datalist></form></header>", "<header><svg></header>", "<div><svg><path d=x></div>", "<math>", "<canvas>", "<div><object></div>", "<nav><select><option>One<option>Two</nav>", "<select><option>One<option>Two"):
        assert htmltext.main_text(f"<body>{head}{main}</body>", field)[0] == want, head


def test_formulas_objects_and_drawings_stay_in_the_text():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <svg><path d=m /></svg> a number.</p><object data=a><p>Instead of a picture, words.</p></object><p>End.</p></article>"
    assert [b.text for b in htmltext.blocks(page)] == ["Let x=1 be a number.", "Instead of a picture, words.", "End."]
    assert [b.text for b in htmltext.blocks("<select><option>One<option>Two</select><p>Text")] == ["One", "Two", "Text"]


def test_deep_nesting_and_raw_elements_without_an_end():
    """Thousands of open elements hide nothing; what no end tag ends is raw text to the end of the page."""
    field = htmltext.trained()
    prose = "<p>A first full sentence, long enough to be read as prose by anyone.</p><p>And a second one, with some more words, that ends here.</p>"
    want = "Title\n\nA first full sentence, long enough to be read as prose by anyone.\n\nAnd a second one, with some more words, that ends here."
    article = f"<article><h1>Title</h1>{prose}</article>"
    for page in ("<div>" * 3000 + article + "</div>" * 3000, "<div>" * 3000 + article, article + "<script>var x='<p>", "<style>p{</style>" + article + "<textarea>no end <p>x"):
        assert htmltext.main_text(page, field)[0] == want
    deep = "<b>" * 3000 + "Deep words that are said in a sentence of prose." + "</b>" * 3000
    assert htmltext.main_text(f"<article><h1>Title</h1>{prose}<p>{deep}</p></article>", field)[0] == want + "\n\nDeep words that are said in a sentence of prose."


def texts(page):
    return [b.text for b in htmltext.blocks(page)]


def test_comments_end_as_in_a_browser():
    for comment in ("<!-->", "<!--->", "<!-- x --!>", "<!-- x -->", "<!---->", "<!-- <p>x</p> -- > -->", "<![CDATA[x>", "<?php x ?>", "<!doctype html>"):
        assert texts(f"<p>a</p>{comment}<p>b</p>") == ["a", "b"], comment
    assert texts("<p>a</p><!-- never ends <p>b</p>") == ["a"]


def test_only_empty_elements_end_themselves():
    assert texts("<script src=x/>code()</script><p>a</p>") == ["a"]
    assert texts("<p>a<br/>b<img src=x/>c</p><hr/><p>d</p>") == ["a bc", "d"]
    nav, main = htmltext.blocks("<section data-u=/a/b/><nav/><p>x</p></nav><p>y</p></section>")
    assert nav.zones & htmltext._BIT["nav"] and nav.zones & htmltext._BIT["section"] and not main.zones & htmltext._BIT["nav"] and main.zones & htmltext._BIT["section"]
    assert texts("<p title=it's>a</p><p title=it's>b</p>") == ["a", "b"]


def test_scripts_do_not_cut_and_hidden_markup_ends_with_its_parent():
    assert texts("<p>one <script>x()</script>two <style>p{}</style>three <noscript><div>no <p>script</p></div></noscript>four</p>") == ["one two three four"]
    assert texts("<article><p>a</p><noscript><p>x</p></article><p>b</p>") == ["a", "b"]
    assert texts("<div><template><p>x</div><p>b</p>") == ["b"]
    assert texts("<div>a<template><b>x</template>b</div>c") == ["ab", "c"]
    assert texts("<p>a</section>b</p>") == ["ab"] and texts("a</p>b") == ["a", "b"]
    assert texts("<p>a</p><textarea>x</textarea><p>b</p><script>y</script junk><p>c</p>") == ["a", "b", "c"]


def test_time_grows_with_the_page():
    import time

    for page in ("<div>" * 250_000 + "</section>" * 150_000, "<noscript>" * 150_000 + "</x>" * 150_000, "<a b=\"" * 200_000, "<p x='" * 200_001, "<!-" * 500_000, "</p>" * 500_000):
        began = time.process_time()
        htmltext.blocks(page)
        assert time.process_time() - began < 4, page[:20]
