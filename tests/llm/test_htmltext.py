import random
import time

from pyspark.sql import Row

from tracewell.llm import htmltext as H
from tracewell.llm.htmltext import main_text
from tracewell.llm.queries import op4_html

P = "This is a long enough paragraph, with commas, and full stops. It goes on, as articles do; and on."


def test_article_without_furniture():
    page = f"""<!DOCTYPE html><html><head><title>T, t.</title><style>p{{x:"</p>"}}</style><script>var a="<p>no, no.</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/x">Home</a><li><a>News</a></ul></nav><div class="cookie-notice"><p>{P}</p></div>
    <!-- <p>hidden</p> --><article><h1>Head&amp;line</h1><p><b>First&nbsp;{P}<br><p>Second
       {P}</p><p>Short.</p><ul><li>one<li>two</ul><aside><p>{P}</p></aside><div class="ad">{P}</div><form>{P}<input></form><div hidden>{P}</div><p style="display: none">{P}</p></article>
    <section id="comments"><p>{P}</p></section><footer>&copy; {P}</footer>"""
    assert main_text(page) == "\n".join(["Head&line", f"First {P}", f"Second {P}", "Short.", "one", "two"])


def test_container_without_semantics():
    body = "".join(f"<p>{P} {k}</p>" for k in range(4))
    links = "".join(f'<li><a href="/{k}">Item {k}</a></li>' for k in range(9))
    page = f"<body><ul>{links}</ul><div id=x7><h1>Head</h1>{body}<p>Short.</p></div><div class=comments>{body}</div></body>"
    assert main_text(page) == "\n".join(["Head", *[f"{P} {k}" for k in range(4)], "Short."])


def test_table_layout_and_character_references():
    page = f"<table><tr><td><a>Menu</a><td><p>&lt;b&gt; {P} &#233;&eacute;<p>{P}</table>"
    assert main_text(page).split("\n")[-2:] == [f"<b> {P} éé", P]


def test_odd_pages():
    for page in (None, "", "<html><body></body></html>", "<nav><a>x</a></nav>", "<!-- open", "<script>x", "</p></div>"):
        assert main_text(page) == ""
    assert main_text("plain words, no markup.") == "plain words, no markup."
    assert main_text("<p>a < b, and <3 c.</p>") == "a < b, and <3 c."
    assert main_text("<p title='unclosed>text, more.</p>") in ("text, more.", "")
    assert len(main_text("<p>" + "word, " * 200_000)) == 6 * 200_000 - 1


def test_every_page_has_a_row(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op4_html(spark, sf).collect()
    assert {r.page_id: r.text for r in got} == {k: main_text(h) for k, h in pages.items()}
    assert all(r.n_chars == len(r.text) > 0 for r in got)


def test_content_outside_the_largest_container():
    body, end = [f"{P} {k}" for k in range(20)], f"End. {P}"
    paragraphs = "".join(f"<p>{x}</p>" for x in body)
    assert main_text(f"<body><div><p>{P}</p></div><div>{paragraphs}</div><div><p>{end}</p></div></body>") == "\n".join([P, *body, end])
    page = f"<body><article><h2>One</h2>{paragraphs}</article><article><h2>Two</h2><p>{P}</p><p>{P}</p><p>{end}</p></article></body>"
    assert main_text(page) == "\n".join(["One", *body, "Two", P, P, end])


def test_marks_around_the_article_are_not_furniture():
    body = "".join(f"<p>{P} {k}</p>" for k in range(6))
    want = "\n".join(f"{P} {k}" for k in range(6))
    rest = f"<div class='site-footer'><p>{P}</p></div><div class=comments><p>{P}</p><p>{P}</p></div>"
    for start, end in (("<div class='layout has-sidebar'>", "</div>"), ("<div id=page class='no-comments'>", "</div>"), ("<form action=x>", "</form>"), ("<div class=sidebar>", "</div>")):
        assert main_text(f"<body>{start}<article>{body}</article>{rest}{end}</body>") == want
        assert main_text(f"<body>{start}<div>{body}</div>{rest}{end}</body>") == want
    assert main_text(f"<body><section class='popular-science'>{body}</section>{rest}</body>") == want


def test_marks_are_weak_next_to_what_they_hold():
    body = "".join(f"<p>{P} {k}</p>" for k in range(6))
    want = "\n".join(f"{P} {k}" for k in range(6))
    assert main_text(f"<body><div class='popular-science'>{body}</div></body>") == want
    assert main_text(f"<body><article><div class='tags-list'>{body}</div></article></body>") == want
    assert main_text(f"<body><p>Stray.</p><div class='notice'>{body}</div><div class='ad'><p>{P}</p></div></body>").endswith(want)


def test_hostile_markup_takes_linear_time():
    for piece in ("<a ", "<div>", "<div>x", "<a \">\" ", "<a b='>", "<p><b>", "<div class=ad>x", "</x><y>", "<!--", "<script>", "<ul><li>x", "<", "&amp", "<b></i>"):
        page = piece * (1_000_000 // len(piece))
        began = time.perf_counter()
        main_text(page)
        main_text(page + "'>")
        assert time.perf_counter() - began < 20, piece


def plain_paths(blocks):
    """The paths of content by the definition, a block (path, text, linked, weight) at a time."""
    def ratio(path, measure):
        of = [b for b in blocks if b[0] == path]
        return sum(measure(b) for b in of if b[3]) / len(of)

    unlinked = lambda b: len(b[1]) - b[2]
    marks = lambda b: len(H.PUNCTUATION.findall(b[1])) * (1 - b[2] / len(b[1]))
    score = {}
    for path in {b[0] for b in blocks if b[3]}:
        values = []
        for i, b in enumerate(blocks):
            if b[0] == path and b[3]:
                near = [blocks[max(i - 1, 0)], b, blocks[min(i + 1, len(blocks) - 1)]]
                t, m = (sum(w * ratio(x[0], f) for w, x in zip(H.KERNEL, near, strict=True)) for f in (unlinked, marks))
                values.append(b[3] * (t * (1 + m)) ** 0.5)
        score[path] = sum(values) / sum(b[0] == path for b in blocks)
    top = max(score.values(), default=0)
    return {p for p, s in score.items() if s > 0 and s >= H.THRESHOLD * top}


def test_paths_are_those_of_the_definition():
    rng = random.Random(8)
    for _ in range(150):
        blocks = []
        for _ in range(rng.randint(1, 15)):
            text = "".join(rng.choices("ab ,.;", k=rng.randint(1, 60)))
            blocks.append((rng.randint(0, 4), text, rng.randint(0, len(text)), rng.choice([0.0, 0.02, 1.0, 1.0])))
        assert H.content_paths(*map(list, zip(*blocks, strict=True))) == plain_paths(blocks)


def test_rows_repeat_columns_clash_and_tables_are_empty(spark):
    rows = [(1, "u", f"<p>{P}</p>", "x"), (1, "u", f"<p>{P}</p>", "x"), (2, None, None, "y"), (None, "", "", "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted(map(str, H.extract(pages).collect()))
    assert got == sorted(map(str, [Row(page_id=a, url=b, text=main_text(h), n_chars=len(main_text(h))) for a, b, h, _ in rows]))
    assert H.extract(pages.limit(0)).count() == 0
