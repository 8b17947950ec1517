"""The labelled table for the extraction tree: small made-up pages in parts, kept (1) or dropped (0)."""

_LONG = (
    "The river had risen during the night and the lower fields stood under water when the farmers came out to look. "
    "Nobody could remember a spring like it, and the old men said so at length."
)
_MIDDLE = "Two bridges were closed before noon and the school bus took the long way round."
_LINKS = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "Sport", "Weather", "Contact"))
_NAV = f"<nav><ul>{_LINKS}</ul></nav>"
_MENU = f'<div class="menu"><ul>{_LINKS}</ul></div>'
_BARE_MENU = f"<ul>{_LINKS}</ul>"
_FOOT = "<footer>&copy; Example Press &middot; All rights reserved by the owners of this site and their partners.</footer>"
_AD = '<div class="ad">Buy three and pay for two, only until the end of this week in every branch near you.</div>'
_COOKIE = '<div class="cookie-notice"><p>We use cookies to improve your visit and to measure how our pages are used.</p></div>'
_SIDE = f'<aside><h3>Most read</h3><p>{_MIDDLE}</p><p><a href="/1">Ten walks for a rainy week</a></p></aside>'
_SIDEBAR = f'<div id="sidebar"><h3>About us</h3><p>{_LONG}</p></div>'
_FORM = "<form><p>Leave your address and we will write to you every Friday with the news of the week.</p></form>"
_COMMENTS = f'<section class="comments"><h2>Comments</h2><div class="comment"><p>{_LONG}</p></div><p>I agree.</p></section>'
_HEADER = "<header><p>Example Press</p><p>News from the valley since a long time ago and still going.</p></header>"
_SHARE = '<div class="share"><a href="#">Tweet</a> <a href="#">Mail</a></div>'


def _article(*inner: tuple[int, str], tag: str = "article") -> list[tuple[int, str]]:
    """The parts of an article; opening and closing tags go with its first and last part."""
    name = tag.split(" ")[0]
    parts = list(inner)
    parts[0] = (parts[0][0], f"<{tag}>{parts[0][1]}")
    parts[-1] = (parts[-1][0], f"{parts[-1][1]}</{name}>")
    return parts


_TITLE, _TEXT, _MID, _SHORT = (1, "<h1>High water</h1>"), (1, f"<p>{_LONG}</p>"), (1, f"<p>{_MIDDLE}</p>"), (1, "<p>So it was.</p>")
_LIST = (1, "<ul><li>Boots</li><li>A lamp and some bread</li></ul>")
_QUOTE = (1, f"<blockquote>{_MIDDLE}</blockquote>")
_LINKED = (1, '<p>See <a href="/m">the map of the valley</a>.</p>')
_ALL_LINK = (1, '<p><a href="/r">The full report of the water board</a></p>')

_TINY_LINK = (1, '<p><a href="/r">Here</a></p>')

#: Each sample is a page in parts; the parts together are the page.
SAMPLES: list[list[tuple[int, str]]] = [
    [(0, _NAV), (0, _AD), *_article(_TITLE, _TEXT, _SHORT, _MID), (0, _FOOT)],
    [(0, _NAV), (0, _AD), *_article(_TITLE, _SHORT), (0, _FOOT)],
    [(0, _HEADER), (0, _NAV), *_article(_TITLE, _TEXT, _LIST, _TEXT, tag="main"), (0, _SIDE), (0, _FOOT)],
    [(0, _COOKIE), (0, _NAV), *_article(_SHORT, _SHORT, _LINKED, _TEXT), (0, _COMMENTS), (0, _FOOT)],
    [(0, _NAV), (0, _FORM), *_article(_TITLE, _ALL_LINK, _MID, _QUOTE), (0, _SHARE), (0, _SIDEBAR)],
    [(0, _BARE_MENU), (1, "<h1>High water</h1>"), _TEXT, _MID, _TEXT, (0, _FOOT)],
    [(0, _BARE_MENU), _TEXT, (1, "<p>So it was, they said.</p>"), _TEXT, (0, _BARE_MENU)],
    [(0, _MENU), *_article(_TITLE, _MID, _TEXT, tag='div class="content"'), (0, _SIDEBAR), (0, _FOOT)],
    [(0, _MENU), _TEXT, _MID, _TEXT, (0, _SHARE), (0, _COOKIE)],
    [(0, _NAV), (0, _SIDE), *_article(_SHORT, _LIST, _SHORT), (0, _COMMENTS), (0, _AD), (0, _FOOT)],
    [(0, _NAV), *_article(_TEXT, (0, _AD), _MID, (0, _COMMENTS)), (0, _FOOT)],
    [(0, _HEADER), (0, _COOKIE), (0, _SIDEBAR), *_article(_TITLE, _SHORT, _MID, _ALL_LINK, tag="main"), (0, _FOOT)],
    [(0, _NAV), *_article(_TINY_LINK, _TEXT, _TINY_LINK, _LINKED, _TINY_LINK), (0, _FOOT)],
    [(0, _AD), *_article(_SHORT, _TINY_LINK, tag="main"), (0, _BARE_MENU)],
    [_TITLE, _TEXT, _TEXT],
    [_SHORT],
    [(1, "High water in the valley")],
    [_MID, (0, '<p><a href="/a">Older</a> <a href="/b">Newer</a></p>')],
]
