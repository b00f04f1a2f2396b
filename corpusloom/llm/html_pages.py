"""Labelled pages to train the extraction of main text on: invented text in common layouts."""

from __future__ import annotations

import random

# Opens the text of every leaf block that is main text.
MARK = "\x01"

_SYLLABLES = "an be cor da el fi ga hu in jo ka lo mi no or pa qui ra so te un vi wo ya zu".split()


class _Writer:
    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def pick(self, text: str) -> str:
        return self.random.choice(text.split("|"))

    def maybe(self, share: float, text: str) -> str:
        return text if self.random.random() < share else ""

    def word(self) -> str:
        return "".join(self.random.choices(_SYLLABLES, k=self.random.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.random.randint(low, high)))

    def sentence(self, low: int = 1, high: int = 18) -> str:
        return self.words(low, high).capitalize() + self.random.choice([".", ".", ".", "!", "?"])

    def prose(self, most: int = 8) -> str:
        return " ".join(self.sentence() for _ in range(self.random.randint(1, most)))

    def link(self, text: str | None = None) -> str:
        return f'<a href="/{self.word()}">{text or self.words(1, 3)}</a>'

    def links(self, wrap: str = "li") -> str:
        return "".join(f"<{wrap}>{self.link()}</{wrap}>" for _ in range(self.random.randint(2, 7)))

    def inline(self, text: str) -> str:
        """A text with some inline markup in it."""
        words = text.split(" ")
        if len(words) > 3 and self.random.random() < 0.3:
            i = self.random.randrange(len(words) - 1)
            words[i] = self.random.choice([f"<b>{words[i]}</b>", f"<em>{words[i]}</em>", self.link(words[i]), f"{words[i]}<br>"])
        return " ".join(words)

    # Main text.

    def paragraph(self) -> str:
        text = MARK + self.inline(self.random.choice([self.sentence(), self.prose(), self.words(1, 10)]))
        shape = self.random.random()
        if shape < 0.12:
            # Unclosed tags.
            return f"<p><b>{text}<br>"
        if shape < 0.2:
            return f"<p>{text}"
        return f"<p>{text}</p>"

    def credit(self) -> str:
        """Who wrote an article, and when."""
        who = self.pick("By |Von |Par |Por |") + f"{self.word().capitalize()} {self.word().capitalize()}"
        when = f"{self.random.randint(1, 31)} {self.word().capitalize()} {self.random.randint(1995, 2030)}"
        text = self.random.choice([who, when, f"{who}, {when}", f"<span>{who}</span> <time>{when}</time>", self.link(who)])
        name = self.pick("author|date|dateline|published|writer|info|autor|fecha|auteur")
        tag = self.pick("div|div|p|address")
        return self.random.choice([f'<{tag} class="{name}">{MARK}{text}</{tag}>', f"<{tag}>{MARK}{text}</{tag}>"])

    def picture(self) -> str:
        text = f"{MARK}{self.random.choice([self.words(2, 9), self.sentence()])}"
        return self.random.choice(
            [
                f'<figure><img src="/{self.word()}"><figcaption>{text}</figcaption></figure>',
                f'<div class="{self.pick("caption|image|photo")}"><img src="/{self.word()}"><p>{text}</p></div>',
            ]
        )

    def definitions(self) -> str:
        one = "".join(f"<dt>{MARK}{self.words(1, 3)}</dt><dd>{MARK}{self.sentence()}</dd>" for _ in range(self.random.randint(2, 4)))
        return f"<dl>{one}</dl>"

    def made_up(self) -> str:
        """A name that says nothing."""
        return f"{self.word()}-{self.random.randint(0, 99)}{self.word()}"

    def block(self) -> str:
        shape = self.random.random()
        if shape < 0.05:
            return self.picture()
        if shape < 0.08:
            return self.definitions()
        if shape < 0.12:
            return f'<div class="{self.made_up()}">{self.paragraph()}{self.paragraph()}</div>'
        if shape < 0.72:
            return self.paragraph()
        if shape < 0.8:
            return f"<h2>{MARK}{self.words(1, 8)}</h2>" + self.paragraph()
        if shape < 0.87:
            items = "".join(f"<li>{MARK}{self.inline(self.sentence())}</li>" for _ in range(self.random.randint(2, 5)))
            return f"<ul>{items}</ul>"
        if shape < 0.92:
            return f"<blockquote>{MARK}{self.prose(3)}</blockquote>"
        if shape < 0.96:
            return f"<pre>{MARK}{self.words(2, 30)}</pre>"
        cells = "".join(f"<tr><td>{MARK}{self.words(1, 3)}</td><td>{MARK}{self.words(1, 6)}</td></tr>" for _ in range(2))
        return f"<table>{cells}</table>"

    def body(self) -> str:
        blocks = [self.block() for _ in range(self.random.choice([1, 2, 4, 7, 12, 18]))]
        # What stands inside articles without being their text.
        for share, extra in ((0.15, self.advert), (0.12, self.share_bar), (0.08, self.form), (0.08, self.sidebar)):
            if self.random.random() < share:
                blocks.insert(self.random.randint(0, len(blocks)), extra())
        return self.head() + "".join(blocks) + self.maybe(0.12, self.comments())

    def head(self) -> str:
        """The title of an article, with or without a line on its author."""
        title = f"<h1>{MARK}{self.words(1, 9)}{self.pick('|.|?')}</h1>"
        lead = self.maybe(0.3, f'<p class="{self.pick("lead|intro|summary|teaser")}">{MARK}{self.sentence()}</p>')
        shape = self.random.random()
        if shape < 0.1:
            return ""
        if shape < 0.6:
            return title
        if shape < 0.85:
            return title + lead + self.credit()
        return f"<header>{title}{lead}{self.maybe(0.6, self.credit())}</header>"

    def main(self) -> str:
        body = self.body()
        name = self.pick("content|post|entry-content|article-body|story|main|text|post-body|page-content|articleText")
        return self.random.choice(
            [
                f"<article>{body}</article>", f"<article>{body}</article>", f'<article class="{name}">{body}</article>',
                f"<main>{body}</main>", f"<main><article>{body}</article></main>",
                f'<div class="{name}">{body}</div>', f'<div id="{name}">{body}</div>',
                f'<section class="{name}">{body}</section>', f"<div>{body}</div>", body,
            ]
        )

    def columns(self) -> str:
        """An article beside menus and side columns, in a grid or a table, under names that say little."""
        body, side = self.body(), self.random.choice([self.cards, self.sidebar, self.menu])()
        wide, narrow = self.pick("col-8 col-4|col-lg-7 col-lg-5|left right|centre edge|big small").split()
        if self.random.random() < 0.3:
            links = self.random.choice([f"<ul>{self.links()}</ul>", self.links("p"), "<br>".join(self.link() for _ in range(self.random.randint(2, 7)))])
            cells = [f"<td>{links}</td>", f"<td valign=top>{body}</td>"]
            if self.random.random() < 0.3:
                self.random.shuffle(cells)
            return f"<table><tr>{''.join(cells)}</tr></table>"
        if self.random.random() < 0.5:
            wide, narrow = self.made_up(), self.made_up()
        cells = [f'<div class="{wide}">{body}</div>', f'<div class="{narrow}">{side}</div>']
        if self.random.random() < 0.4:
            cells.reverse()
        return f'<div class="{self.pick("row|grid|flex|columns")}">{"".join(cells)}</div>'

    # The rest of a page.

    def cards(self) -> str:
        out = ""
        for _ in range(self.random.randint(1, 3)):
            head = self.pick("h3|h4|h5|div")
            inner = self.random.choice([self.links("p"), f"<ul>{self.links()}</ul>", f"<p>{self.words(2, 8)}</p>", f"<div>{self.words(1, 6)}</div>"])
            name = self.random.choice(["card", "box", "panel", self.made_up()])
            out += f'<div class="{name}"><{head}>{self.words(1, 3)}</{head}>{inner}</div>'
        return out

    def unnamed(self) -> str:
        """Links or a closing line in a part of the page without a telling name."""
        rights = self.pick("All rights reserved|Alle Rechte vorbehalten|Tous droits réservés|Todos los derechos reservados|Impressum|Privacy policy|Mentions légales|Aviso legal")
        inner = self.random.choice(
            [
                "".join(self.link() for _ in range(self.random.randint(2, 6))), f"<ul>{self.links()}</ul>", self.link(),
                f"&copy; {self.random.randint(1995, 2030)} {self.words(1, 3)}", f"Copyright {self.words(1, 3)}. {rights}.", f"{self.link()} {rights}",
            ]
        )
        tag = self.pick("div|div|center|p|td")
        inner = self.random.choice([inner, f"<small>{inner}</small>", f"<div>{inner}</div>"])
        if tag == "td":
            return f"<table><tr><td>{inner}</td></tr></table>"
        return self.random.choice([f"<{tag}>{inner}</{tag}>", f'<{tag} class="{self.made_up()}">{inner}</{tag}>'])

    def menu(self) -> str:
        items = self.random.choice([f"<ul>{self.links()}</ul>", self.links("span"), f"<ol>{self.links()}</ol>", self.links("div")])
        name = self.pick("menu|nav|navbar|navigation|breadcrumbs|main-menu|topNav|links")
        return self.random.choice([f"<nav>{items}</nav>", f"<nav>{items}</nav>", f'<div class="{name}">{items}</div>', f'<div id="{name}" role="navigation">{items}</div>'])

    def header(self) -> str:
        inner = self.random.choice([self.words(1, 4), self.link(), f"<p>{self.sentence()}</p>", f"<h2>{self.words(1, 3)}</h2>"])
        name = self.pick("header|masthead|site-header|top|page-header|branding")
        return self.random.choice([f"<header>{inner}</header>", f'<div class="{name}">{inner}</div>', f'<div id="{name}">{inner}</div>'])

    def notice(self) -> str:
        text = self.random.choice(["We use cookies. ", "This site uses cookies, see our privacy policy. ", "Wir verwenden Cookies. ", "Nous utilisons des cookies. ", "Utilizamos cookies. ", ""]) + self.prose(2)
        name = self.pick("cookie-notice|cookie-banner|notice|consent|gdpr|alert|banner|popup|modal|notification")
        inner = self.random.choice([text, f"<p>{text}</p><button>Accept</button>", f"<p>{text}</p>"])
        return self.random.choice([f'<div class="{name}">{inner}</div>', f'<div id="{name}">{inner}</div>', f'<section class="{name}" role="alert">{inner}</section>', f"<noscript>{inner}</noscript>"])

    def advert(self) -> str:
        text = self.random.choice([self.sentence(), self.prose(4), self.words(2, 8)])
        name = self.pick("ad|ad|ads|advert|advertisement|ad-slot|sponsored|promo|promotion|adsbygoogle|banner-ad")
        inner = self.random.choice([text, f"<p>{text}</p>", f"<h3>{self.words(1, 4)}</h3><p>{text}</p>", self.link(text)])
        return self.random.choice([f'<div class="{name}">{inner}</div>', f'<div class="{name}">{inner}</div>', f'<aside class="{name}">{inner}</aside>', f'<div id="{name}">{inner}</div>'])

    def sidebar(self) -> str:
        inner = "".join(
            self.random.choice([f"<h3>{self.words(1, 4)}</h3>", f"<p>{self.prose(3)}</p>", f"<ul>{self.links()}</ul>", f"<div>{self.sentence()}</div>"])
            for _ in range(self.random.randint(1, 4))
        )
        name = self.pick("sidebar|side|rail|widget|related|right-col|trending|recommended|sideBar")
        return self.random.choice([f"<aside>{inner}</aside>", f"<aside>{inner}</aside>", f'<div class="{name}">{inner}</div>', f'<div id="{name}">{inner}</div>', f'<section class="{name}">{inner}</section>'])

    def form(self) -> str:
        inner = self.random.choice(
            [
                f"<p>{self.sentence()}</p><input name=q><button>{self.words(1, 2)}</button>",
                f"<label>{self.words(1, 3)}</label><input><label>{self.words(1, 3)}</label><select><option>{self.word()}<option>{self.word()}</select>",
                f"<h3>Subscribe</h3><p>{self.prose(2)}</p><input>", f"<fieldset><legend>{self.words(1, 2)}</legend>{self.sentence()}<input></fieldset>",
            ]
        )
        name = self.pick("search|newsletter|login|contact|subscribe|signup")
        return self.random.choice([f"<form>{inner}</form>", f'<form class="{name}">{inner}</form>', f'<div class="{name}"><form>{inner}</form></div>'])

    def share_bar(self) -> str:
        return f'<div class="{self.pick("share|social|share-buttons|tags|post-meta|pagination")}">{self.links("span")}</div>'

    def comments(self) -> str:
        tag = self.pick("div|li|article|section")
        one = "".join(
            f'<{tag} class="comment">' + self.maybe(0.5, f'<div class="author">{self.words(1, 2)}</div>')
            + self.random.choice([f"<p>{self.prose(4)}</p>", self.prose(3), f"<p>{self.sentence()}</p><p>{self.sentence()}</p>"])
            + self.maybe(0.4, self.link(self.pick("Reply|Reply|Antworten|Répondre|Responder"))) + f"</{tag}>"
            for _ in range(self.random.randint(1, 4))
        )
        name = self.pick("comments|comment-list|comments-area|responses|discussion|disqus|replies|user-comments")
        head = self.maybe(0.6, f"<h2>{self.random.choice(['Comments', 'Kommentare', 'Commentaires', 'Comentarios', self.words(1, 3)])}</h2>")
        wrap = self.pick("div|section|ol|aside")
        return f'<{wrap} {self.pick("id|class")}="{name}">{head}{one}</{wrap}>'

    def footer(self) -> str:
        text = self.maybe(0.6, "&copy; ") + self.random.choice([self.words(1, 6), self.prose(3), f"{self.word()}.example.com &middot; {self.prose(2)}"])
        inner = self.random.choice([text, f"<p>{text}</p>", f"<p>{text}</p><ul>{self.links()}</ul>"])
        name = self.pick("footer|site-footer|copyright|colophon|bottom|legal|site-info")
        return self.random.choice([f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f'<div class="{name}">{inner}</div>', f'<div id="{name}">{inner}</div>'])

    def page(self) -> str:
        before = [self.maybe(share, part()) for share, part in ((0.4, self.header), (0.8, self.menu), (0.3, self.notice), (0.4, self.advert), (0.2, self.sidebar), (0.1, self.form))]
        after = [self.maybe(share, part()) for share, part in ((0.3, self.comments), (0.3, self.sidebar), (0.2, self.advert), (0.15, self.form), (0.15, self.share_bar), (0.85, self.footer), (0.1, self.notice))]
        if self.random.random() < 0.3:
            before, after = [self.maybe(0.5, part) for part in before] + [self.unnamed()], [self.maybe(0.5, part) for part in after] + [self.unnamed()]
        self.random.shuffle(before)
        head = f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
        middle = self.columns() if self.random.random() < 0.25 else self.main()
        inside = "".join(before) + middle + "".join(after)
        return head + self.random.choice([inside, f'<div class="{self.pick("wrapper|page|container|site")}">{inside}</div>']) + self.maybe(0.9, "</body></html>")


def labelled_pages(count: int, seed: int = 5) -> list[str]:
    """``count`` pages, the same for the same seed."""
    return [_Writer(seed * 1_000_003 + i).page() for i in range(count)]
