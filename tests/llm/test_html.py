"""Main text of pages: hand-made cases, and all given pages against a version by the library's parser."""

import collections
import time
from html.parser import HTMLParser

import pytest
from oracle import SF

from skytrace.llm.html_extract import BLOCK, blocks, classify, main_text

PROSE = "This is the first paragraph of the story, and it is long enough to be decided by the rules: it has many of the words that prose in this language has, and no links in it at all. So it goes on and on, to the end of the page."


class Articles(HTMLParser):
    """The text in article elements, cut at block-level tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.part, self.inside = [], "", 0

    def flush(self):
        if text := " ".join(self.part.split()):
            self.out.append(text)
        self.part = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.part += "\n"
        elif tag in BLOCK:
            self.flush()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.inside -= tag == "article"

    def handle_data(self, data):
        self.part += data if self.inside else ""


def test_given_pages(spark):
    """The given pages keep their main text in article elements; the rules find it."""
    for row in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").select("html").collect():
        plain = Articles()
        plain.feed(row["html"] or "")
        plain.close()
        plain.flush()
        assert main_text(row["html"]) == "\n".join(plain.out)


class Paragraphs(Articles):
    """The text of paragraphs and first headings, wherever they stand."""

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        self.inside += tag in ("p", "h1") and not self.inside

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.inside = 0 if tag in ("article", "footer", "nav") else self.inside


def test_given_pages_without_marks(spark):
    """With the article elements made divs, the passes alone tell main text from the rest: three quarters of it are kept (paragraphs without stop words are not), and hardly anything else."""
    kept = lost = more = 0
    for row in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").select("html").collect():
        page = (row["html"] or "").replace("<article>", "<div>").replace("</article>", "</div>")
        assert "article" not in page and "<main" not in page
        plain = Paragraphs()
        plain.feed(row["html"] or "")
        plain.close()
        expected, got = collections.Counter(plain.out), collections.Counter(main_text(page).split("\n"))
        size = lambda c: sum(len(x) * n for x, n in c.items())
        kept, lost, more = kept + size(expected & got), lost + size(expected - got), more + size(got - expected)
    assert kept > 0.75 * (kept + lost) and more < 0.01 * kept, (kept, lost, more)


JUNK = "Zqxv brrt klmp wrtz qpfj xnnd. " * 10
LINKS = "<ul>" + "".join(f"<li><a href={i}>Another page of this site</a>" for i in range(4)) + "</ul>"
MUTATIONS = {
    "stop words": {"stop_words": frozenset()},
    "length": {"short": 0, "long": 0},
    "links": {"some_links": 1.0, "most_links": 1.0},
    "second pass": {"inherit": False},
}
JUDGED = {
    "without marks": f"<div><p>{PROSE}<p>Short.<p>{PROSE}<p>{JUNK}</div><p>Tail<p>{LINKS}",
    "inside": f"<main><h1>Title</h1><p>{PROSE}<p>{PROSE}</p>{LINKS}<p>{JUNK}</p>{LINKS}</main>",
    "outside": f"<p>{PROSE}</p><main><h1>Title</h1><p>{PROSE}<p>Short.</main><p>{JUNK}</p>",
}
EXPECTED = {"without marks": f"{PROSE}\nShort.\n{PROSE}", "inside": f"Title\n{PROSE}\n{PROSE}", "outside": f"{PROSE}\nTitle\n{PROSE}\nShort."}


def judged(page, **options):
    found = blocks(page)
    return "\n".join(b.text for b, good in zip(found, classify(found, **options), strict=True) if good)


@pytest.mark.parametrize("name", JUDGED)
def test_each_rule_decides(name):
    """The passes reject inside of a main element and accept outside of it; without a rule pages come out differently."""
    assert judged(JUDGED[name]) == main_text(JUDGED[name]) == EXPECTED[name]
    changed = {m for m, options in MUTATIONS.items() if judged(JUDGED[name], **options) != EXPECTED[name]}
    assert changed >= {"without marks": {"stop words", "length", "second pass"}, "inside": {"links", "stop words", "second pass"}, "outside": {"stop words", "second pass"}}[name]


@pytest.mark.parametrize("name", "post-comments user-comment cookie-consent ad-slot sponsored-content signup-box legal-notice comment related-posts share-buttons".split())
def test_named_parts_of_main_text(name):
    for tag in ("div", "section"):
        assert main_text(f"<main><h1>T</h1><p>{PROSE}</p><{tag} class='x {name}'>{PROSE} {name}</{tag}><p>{PROSE}</p></main>") == f"T\n{PROSE}\n{PROSE}"


def test_adverts_and_headings_over_nothing():
    assert main_text(f"<main><p>{PROSE}</p><p class=advert>{PROSE} Buy</p></main>") == PROSE
    assert main_text(f"<main><h1>T</h1><p>{PROSE}</p><h2>Comments</h2><div class=comment-list><p>{PROSE} me</p></div></main>") == f"T\n{PROSE}"
    assert main_text(f"<main><h1>T</h1><div class=ad>{PROSE} Buy</div><p>{PROSE}</p><h2>A</h2><h3>B</h3><p>{PROSE}</p></main>") == f"T\n{PROSE}\nA\nB\n{PROSE}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # what names and signs inside the article don't decide
        (f"<article><p>{PROSE}<p>© 1920 by the heirs, and still read today.<p class='tags'>A word on tags.<h2 class=legal-history>History</h2><p class='share-of-votes'>Votes</article>",
         f"{PROSE}\n© 1920 by the heirs, and still read today.\nA word on tags.\nHistory\nVotes"),
        (f"<article><p>{PROSE}<p>See <a href=1>the whole decision of the court</a></p></article>", f"{PROSE}\nSee the whole decision of the court"),
        # reader comments
        (f"<main><p>{PROSE}</main><section id=comments><article class=comment><p>Great post</p></article></section>", PROSE),
        (f"<div class=comments><article><p>Great post, and it is one that I have read with joy</p></article></div><article><p>{PROSE}</article>", PROSE),
        # scripts, attributes
        ("<script>// i<n don't</script><p>A</p><p>It's B</p>", ""),
        (f"<article><script>// i<n don't</script><p>{PROSE}</p><p>It's B</p></article>", f"{PROSE}\nIt's B"),
        (f"<article><p title=it's>{PROSE}</p><p data-x='a>b' title=\"c>d\">1 < 2 <3</article>", f"{PROSE}\n1 < 2 <3"),
        (f"<article><p>{PROSE}<video><p>no</article><p>after", PROSE),
        # other scripts, lists of links, wrappers with names
        ("<article>" + "<p>Съешь же ещё этих мягких французских булок да выпей чаю.</p>" * 2 + "</article>", "\n".join(["Съешь же ещё этих мягких французских булок да выпей чаю."] * 2)),
        ("<div>" + "<p>" + "吾輩は猫である。名前はまだ無い。" * 20 + "</p></div><footer>x</footer>", "吾輩は猫である。名前はまだ無い。" * 20),
        (f"<div class='content has-sidebar'><p>{PROSE}</p><div class=sidebar>More of it</div></div>", PROSE),
        (f"<div class='sidebar-layout'><p>{PROSE}</p><p>{PROSE}</p></div><div class=ad>Buy</div>", f"{PROSE}\n{PROSE}"),
        (f"<article><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p>{PROSE}<ul><li>Item</ul><div class='ad'>Buy</div><form>Name</form></article>", f"{PROSE}\nItem"),
    ],
)
def test_cases(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("part", ["<p title='x ", "<a href=\"y ", "<", "<!-- ", "<p>&amp;", "<div class=a>", "<div>x", "<div class=ad>x", "<i class=ad>x", "</p>", "<b class=ad></b><i class=ad>", "</b", "<p a='1' b=", "<script>", "<![CDATA["])
def test_time_grows_with_length(part):
    def seconds(n):
        began = time.perf_counter()
        main_text(part * n)
        return time.perf_counter() - began

    assert seconds(80_000) < 40 * max(seconds(8_000), 0.01)
