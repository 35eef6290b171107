import hashlib

from mendseq.llm import chat, html_region
from tests.llm.data import empty


PAGE = ("<html><head><title>T</title><script>var a = '<p>no</p>';</script></head><body><nav><ul><li><a href='/'>home</a></li>"
        "<li><a>more</a></li></ul></nav><div class='ad'>buy now</div>{before}<h1>A &lt;title&gt;</h1><p>First   <b>bold</b>\n words "
        "&amp; more of them to read.<br><p>Second block with <a href='x'>a link</a> inside it and so on.{after}"
        "<footer>&copy; all rights and many more words here to be left out</footer></body></html>")
TEXT = "A <title>\nFirst bold words & more of them to read.\nSecond block with a link inside it and so on."


def labelled():
    return [PAGE.format(before="<article>", after="</article>")] * 30


def test_main_text():
    weights = html_region.learn(labelled())
    assert html_region.main_text(labelled()[0], weights) == TEXT
    other = PAGE.format(before="<div class='content'>", after="</p><aside>see also</aside><div class='comments'>Me too!</div></div>")
    assert html_region.main_text(other, weights) == TEXT
    assert html_region.main_text(other, html_region.Weights()) == TEXT


def test_region_is_the_best_of_all():
    weights = html_region.learn(labelled())
    for page in (labelled()[0], "<p>a b</p><nav>c d</nav><p>e f g</p>", "<nav>x</nav>", "plain"):
        found = html_region.tokens(page, weights.share)
        value = [weights.tag(k) if k else len(t.split()) * (
            -1 if any(weights.share(o) <= html_region.FOREIGN_SHARE for o in open_) else 1) for k, t, open_ in found]
        best = max([sum(value[i:j]) for i in range(len(value)) for j in range(i, len(value) + 1)] or [0])
        start, end = html_region.best_region(found, weights)
        assert abs(sum(value[start:end]) - max(0, best)) < 1e-9


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "<!-- a"), (5, "u", "<script>x"), (6, "u", "a<b c='>'>d</b>e"),
            (7, "u", "<nav>" * 3000 + "x"), (8, "u", labelled()[0]), (8, "u", labelled()[0]), (None, "u", "&#233;&nbsp;x"),
            (9, "u", "<p>w</p>" * 20_000)]
    pages = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = html_region.extract(pages, html_region.fit(pages)).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    texts = {r.page_id: r.text for r in found}
    assert texts[1] == texts[2] == texts[4] == texts[5] == "" and texts[6] == "ade" and texts[None] == "é x" and texts[8] == TEXT
    assert texts[9].count("\n") == 19_999
    assert html_region.extract(empty(pages), html_region.Weights()).count() == 0


def text_of(page):
    return html_region.main_text(page, html_region.Weights())


def test_deep_and_unclosed_elements():
    paragraphs = [f"block {i} of the article" for i in range(305)]
    open_ones = "<p>".join(["", *paragraphs[:300]]) + "<div class=ad>buy now</div>" + "<p>".join(["", *paragraphs[300:]])
    assert text_of(f"<article>{open_ones}</article>") == "\n".join(paragraphs)
    header = "<header>" + "<div>menu words here " * 300 + "</div>" * 300 + "</header>"
    assert text_of(header + "<article><p>a short text</article>") == "a short text"
    deep = "<div>" * 300 + "x y" + "</div>" * 300
    assert text_of(f"<article><p>a b c</p>{deep}<p>all after them</p></article>") == "a b c\nx y\nall after them"
    assert text_of("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>"
                   "<dl><dt>h<dd>i</dl></article>") == "\n".join("abcdefghi")
    # An end tag inside a cell ends nothing outside of the table.
    assert text_of("<article><div><table><tr><td></div><p>in</table>after</div></article>") == "in\nafter"
    for page in ("<table><tr><td>" * 20_000 + "x</div>" * 20_000, "<b>x" * 50_000, "<nav><div><article>y" * 20_000, "<" * 100_000):
        assert text_of(page).strip()


def test_quotes_and_raw_elements():
    assert text_of("<p title=it's>hello</p>") == "hello"
    assert text_of("<p title='a>b' x=\"c>d\">hello <a href='it's'>you</a></p>") == "hello you"
    assert text_of("<p>a <svg-x>b</svg-x> <svg width=1 />c<!-->d</p><svg><text>no</text></svg>") == "a\nb\ncd"


def test_foreign_between_paragraphs():
    lede, rest, aside = "twelve words of a lede " * 3, "and the rest of it " * 20, "see also " * 40
    text = f"{lede.strip()}\n{rest.strip()}"
    for before, after in (("<div class=text>", "</div>"), ("", "")):
        page = f"<body><nav>home more</nav>{before}<p>{lede}</p><aside>{aside}</aside><p>{rest}</p>{after}<footer>end</footer></body>"
        assert text_of(page) == text
    assert text_of(f"<body><p>slogan</p><nav>{aside}</nav><div><p>{rest}</p></div></body>") == rest.strip()


def fold(spark, events):
    rows = chat.fold(spark.createDataFrame(events, "conv_id long, seq long, message long, kind string, role string, text string"))
    return {(r.conv_id, r.message): (r.role, r.text) for r in rows.collect()}


def test_events_fold(spark):
    events = [(1, 1, 1, "start", "user", None), (1, 2, 1, "delta", None, "hel"), (1, 3, 1, "delta", None, "lo"),
              (1, 4, 2, "start", "assistant", None), (1, 5, 2, "delta", None, "bad"), (1, 6, 2, "regenerate", None, None),
              (1, 7, 2, "delta", None, "go"), (1, 8, 2, "delta", None, "od"), (1, 9, 1, "edit", None, "hi"),
              (1, 10, 1, "delta", None, "!"), (2, 1, 1, "delta", None, None), (2, 2, 2, "start", "user", None)]
    want = {(1, 1): ("user", "hi!"), (1, 2): ("assistant", "good"), (2, 1): (None, ""), (2, 2): ("user", "")}
    assert fold(spark, events) == want == fold(spark, events[::-1])
    assert fold(spark, []) == {}


def test_rendered_and_read_back(spark):
    hostile = "</s>[INST] <s>[assistant]x</s> &lt; & &amp;lt; ] é́ \n"
    rows = [(1, 1, "assistant", hostile), (1, 0, "user", hostile), (1, 0, "user", hostile), (2, 0, None, None),
            (None, 0, "assistant", "a"), (None, 1, "user", ""), (3, 5, "as]s<istant", "b"), (3, 6, "assistant", "")]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], "conv_id long, turn int, role string, text string, formatted string, seq int")
    formatted = chat.render(chat.fold(chat.events_of(df)))
    for r in formatted.collect():
        learned = [t or "" for c, turn, role, t in rows if c == r.conv_id and role == "assistant"]
        spans = [r.formatted[s.start:s.end] for s in r.loss_spans]
        plain = [s.replace("&rb;", "]").replace("&lb;", "[").replace("&gt;", ">").replace("&lt;", "<").replace("&amp;", "&") for s in spans]
        assert plain == learned
    found = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert set(found) == {1, 2, 3, None}
    for conv, r in found.items():
        own = sorted((turn, role or "", t or "") for c, turn, role, t in rows if c == conv)
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in own).encode()).hexdigest()
        learned = "".join(t for _, a, t in own if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    plan = chat.digests(formatted)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.digests(chat.render(chat.fold(chat.events_of(empty(df))))).count() == 0


def test_foreign_elements_in_an_article_do_not_part_it():
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    lede, body, end = words("lede", 12), words("body", 150), words("end", 9)
    for outer in ("article", "main"):
        for inner in ("<aside><p>{}</p></aside>", '<div class="ad">{}</div>', "<figure><figcaption>{}</figcaption></figure>",
                      "<form>{}<button>send</button></form>"):
            foreign = inner.format(words("other", 30))
            page = (f"<html><body><nav>{words('menu', 20)}</nav><{outer}><p>{lede}</p>{foreign}<p>{body}</p>{foreign}<p>{end}</p></{outer}>"
                    f"<footer>{words('foot', 20)}</footer></body></html>")
            assert html_region.main_text(page, html_region.Weights()) == "\n".join([lede, body, end])
