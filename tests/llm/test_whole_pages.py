"""Pages without an article element, and host paths that hold a part of a page's article."""

from vecloom.llm import html_extract


def test_text_beside_the_largest_container_stays():
    body = " ".join(f"w{i}" for i in range(60))
    for tag in ("div", "section", "blockquote"):
        page = f"<html><body><nav><a href=x>Home</a></nav><div class=page><h1>Title</h1><p>An introduction of some words.</p><div><{tag}>{body}</{tag}></div><p>The end.</p></div><footer>f</footer></body></html>"
        assert html_extract.extract(page, None) == f"Title\nAn introduction of some words.\n{body}\nThe end."


def test_a_host_path_that_holds_half_is_passed_over():
    first, second = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    page = f"<html><body><article><div class=one>{first}</div><div class=two>{second}</div></article></body></html>"
    for path in (">html>body>article>div.one", ">html>body>article", None):
        assert html_extract.extract(page, path) == f"{first}\n{second}"
