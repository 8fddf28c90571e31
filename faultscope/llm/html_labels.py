"""The small labelled table of the HTML extractor: pages of our own, every block marked + (kept) or - (dropped)."""

_LINKS = "<ul>" + "".join(f"<li><a href='/{k}'>-item {k}</a></li>" for k in range(4)) + "</ul>"
_LONG = "+this paragraph tells the story at some length so that it has a good number of words in it and hardly any link at all, as articles do."



def _say(mark: str, n: int) -> str:
    return mark + " ".join(["word"] * n)


def _sized(n: int, m: int) -> list[str]:
    """The same kinds of blocks with n and m words: size alone tells nothing inside an article or a frame."""
    k, long_, d, e = _say("+", n), _say("+", m), _say("-", n), _say("-", m)
    return [
        f"<header>{d}</header><nav><a href=1>{d}</a></nav><div class='ad'>{e}</div><article><h1>{k}</h1><p>{long_}<p>{k}<p><a href=2>{k}</a><p>{k}<div class='notice'>{e}</div></article><footer>{e}</footer>",
        f"<div class='banner'>{e}</div><main><p>{k}</p><h2>{long_}</h2><section id='comments'><p>{d}<p>{e}</section></main><aside>{e}<p>{d}</aside><form>{e}</form>",
        f"<article><nav><a href=1>{d}</a><p><a href=2>{e}</a></nav><p>{k}<aside><a href=3>{d}</a></aside><p>{long_}<div class='related'><a href=4>{e}</a></div><p><a href=5>{k}</a><footer><a href=6>{d}</a></footer></article>",
        f"<article>{long_}<br>{k}<br><a href=1>{long_}</a></article><div class='menu'><a href=1>{d}</a></div><div>{d}</div><div>{e}</div><footer>{d}</footer>",
    ]


def _bare(n: int, m: int) -> list[str]:
    """Pages without article or main, of blocks with n and m words: links, frames and extras tell, size does not."""
    k, long_, d, e = _say("+", n), _say("+", m), _say("-", n), _say("-", m)
    links = f"<ul><li><a href=1>{d}</a><li><a href=2>{e}</a><li><a href=3>{d}</a> | <a href=4>{d}</a></ul>"
    return [
        k,
        f"<p>{k}</p><p>{long_}</p>",
        f"<h1>{k}</h1><p>{k}<p>{long_}<h2>{k}</h2><ul><li>{k}<li>{long_}<li>{k}</ul><p>{k}</p>",
        f"<div>{links}</div><h1>{k}</h1><p>{k}<p>{long_} <a href=1>there</a><h2>{long_}</h2><ul><li>{k}<li>{k} <a href=2>here</a></ul><p>{long_}</p><p>{k}</p><div>{links}</div>",
        f"<nav>{d}{links}</nav><div><p>{k}</p></div><div class='ad'>{e}</div><p>{k}</p><div class='sidebar'><h3>{d}</h3>{e}</div><aside>{d}</aside><ul><li>{k}</ul><footer>{e}<p>{d}</footer>",
        f"{links}<p>{k}</p>{links}<h2>{k}</h2>{links}<p>{long_}</p>",
    ]


def _weak(n: int) -> list[str]:
    """Weakly named elements: in an article sentences stay, labels of a few words go unless nothing else is there, links go; outside all go."""
    k, d, label, sentence, beside = _say("+", n), _say("-", n), _say("-", 1 + n % 4), _say("+", 9 + n), _say("-", 9 + n)
    return [
        f"<article><p>{k}</p><section class='social'><p>{sentence}<p>{sentence}</section><div class='share'>{label}</div><p>{k}</p><ul class='menu'><li><a href=1>{d}</a><li><a href=2>{label}</a></ul></article>",
        f"<main><h1>{k}</h1><div class='widget'><p>{sentence} <a href=1>there</a></p><span>{label}</span></div><p>{k}<div class='toolbar'>{label}</div><p class='search'>{sentence}</main>",
        f"<article><div class='navigation'><a href=1>{d}</a> | <a href=2>{d}</a></div><p>{k}<p class='footer-note'>{sentence}<p>{k}</article>",
        f"<article><ul class='menu'><li>{k}</li></ul></article>",
        f"<article><div class='share'>{label}</div><p>{k}</p></article>",
        f"<article><p>{k}</p><div class='share'>{label}</div></article>",
        f"<div class='widget'><p>{beside}<p>{beside}</div><article><p>{k}<p>{sentence}</article><div class='social'>{label}<p>{beside}</div><div class='menu'>{beside}</div>",
        f"<div class='menu'>{label}</div><p>{k}<p>{sentence}<div class='widget'><p>{beside}<p>{beside}</div><p>{sentence}<p>{k}<div class='social'>{d}</div>",
        f"<div class='navbar'>{beside}<p>{d}</div><h1>{k}</h1><p>{sentence}<p>{k}",
        f"<article><section class='social'><h1>{k}</h1><p>{sentence}</p><h2>{k}</h2><p>{sentence}</p></section></article>",
        f"<article><p>{k}<ul class='pagination'><li>{label}<li><a href=2>{label}</a><li><a href=3>{d}</a></ul><p>{k}</article>",
    ]


def _linked(n: int) -> list[str]:
    """Pages without article: a sentence may be mostly one long link, a row of links has next to no other words."""
    words, link = _say("+", 3 + n // 8), " ".join(["word"] * n)
    return [f"<p>{words} <a href=1>{link}</a></p>", f"<div><a href=1>{_say('-', n)}</a> | <a href=2>{link}</a></div><p>{words} <a href=1>{link}</a></p><p>+end</p>"]


PAGES = [page for n in (1, 2, 4, 8, 16, 30, 60, 120) for m in (3, 20, 200) for page in _sized(n, m) + _bare(n, m)] + [
    page for n in (1, 2, 4, 8, 16, 30, 60, 120) for page in _weak(n)] + [page for n in (10, 16, 24, 40, 80) for page in _linked(n)] + [
    # article element with everything around it
    f"<html><head><title>-t</title></head><body><header><h1>-site name</h1>{_LINKS}</header><nav>{_LINKS}</nav><div class='ad'>-buy this very good thing today</div>"
    f"<article><h1>+heading</h1><p>{_LONG}<p>{_LONG} <a href=x>see there</a></p><p>+short.</p><ul><li>+point</li><li><a href=y>+a linked point</a></li></ul><h2>+next</h2><p>+ok</p></article>"
    f"<aside><h3>-more</h3><p>-some long text about other things that stands beside the article and is not part of it</p></aside><footer>-copyright of the site, all rights</footer></body></html>",
    # extras inside the article
    f"<body><article><div class='article-body'><p>{_LONG}</p><div class='advert'>-an advert in the middle of the text with many words to make it look like text</div><p>{_LONG}</p>"
    f"<div class='share social'><a href=a>-share</a></div><p>+end</p></div><section class='comments'><h3>-comments</h3><p>-I do not agree at all with this article because it is far too long and says little</p></section>"
    f"<footer>-tags and author box</footer></article></body>",
    f"<main><h1>+title of it</h1><p>+one line</p><p>{_LONG}</p><form><p>-your name and your mail please</p><label>-mail</label></form><div id='comments'><p>-first! what a nice text you wrote here, thank you</p></div></main>",
    f"<div class='cookie-notice'><p>-we use cookies to make this site better for all of us, please accept them now or later</p></div><article><p>+a</p><p>{_LONG}</p></article><footer><p>-c</p></footer>",
    # no article element: text by words and links
    f"<body><div>{_LINKS}</div><div><h1>+a plain page with a title</h1><p>{_LONG}</p><p>{_LONG}</p></div><div><a href=1>-one</a> <a href=2>-two</a></div><div class='footer'>-imprint</div></body>",
    f"<table><tr><td><a href=1>-home</a></td><td><a href=2>-news</a></td></tr></table><p>{_LONG}</p><p>+a shorter one between two long ones.</p><p>{_LONG}</p><div class='sidebar'><p>-text beside the story that is long enough to be taken for the story itself if one looks at words alone</p></div>",
    f"<nav>{_LINKS}</nav><p>{_LONG}</p><aside>-a remark of many words beside the text, which nobody asked for and which is left out</aside><p>{_LONG}</p><footer>-made by us with many words and no links, to look like text, at the end of the page</footer>",
    f"<header><p>-the site has a slogan of quite a few words that comes first on each page</p></header><article><p>+x</p></article><div class='related'><a href=1>-other story</a></div><dialog>-a notice of some words</dialog>",
    # names of extras on what is or encloses the article; extras inside it and after it
    f"<div class='layout with-sidebar'><article><p>{_LONG}</p><p>+short</p></article><div class='sidebar'><p>-text at the side</p></div></div>",
    f"<div class='sidebar-layout'><header>-site</header><main id='page-no-nav'><h1>+title</h1><article class='post has-comments'><p>+one</p><p>{_LONG}</p><div class='share'>-tell others</div></article></main></div>",
    f"<main class='banner'><p>{_LONG}</p><p>+ok</p></main><section id='comments'><article class='comment'><p>-I have read all of this text and have a lot to say about it, as you see here</p></article></section>",
    f"<article class='teaser'><p>+the first</p><p>{_LONG}</p></article><section class='related-posts'><article><h3>-another</h3><p>-a text about another thing, of a good number of words</p></article></section>",
]
