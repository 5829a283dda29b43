"""Labelled pages: a corpus's texts as articles inside rendered layouts, in which `data-main` marks the elements of the article.

Layouts differ in what a reader of markup can go by: elements of HTML5 or plain divs, names of classes and ids or none, roles,
tables, missing end tags; menus, headers, sidebars, notices, adverts, forms, comments and footers stand around and inside the article,
with phrases or with prose. The random numbers are seeded, so the same texts give the same pages.
"""

from __future__ import annotations

import random
import re
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names that pages give to their parts.
NAMES = {
    "main": "content main article post entry story article-body post-content entry-content main-content page-content text body-text blog-post single-post storyBody articleContent post-body prose markdown-body inhalt artikel beitrag contenido articulo contenu texte",
    "nav": "nav menu navbar topnav navigation breadcrumb breadcrumbs main-menu sub-menu site-nav primary-nav pagination pager tabs toc skip-link lang-switch dropdown menue navigation-bar hauptmenu menu-principal navegacion",
    "header": "header site-header masthead banner top topbar top-bar logo branding hero-header pageHeader page-header kopfzeile kopf cabecera entete intro-bar",
    "footer": "footer site-footer page-footer bottom copyright legal colophon foot imprint footer-links credits fusszeile fuss pie pied pied-de-page impressum",
    "sidebar": "sidebar side aside widget rail right-col left-col sidebar-widget related related-posts recommended recommendations more-stories trending popular most-read teaser read-next also-like author-box seitenleiste barra-lateral barre-laterale relacionados mehr-zum-thema sidebox infobox-right",
    "notice": "cookie cookie-banner cookie-notice notice consent alert alert-info popup modal gdpr announcement privacy-notice overlay paywall message warning toast disclaimer subscribe-banner hinweis meldung aviso avis banner-cookies einwilligung",
    "ad": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion banner-ad ad-slot ad-container adbox advertising commercial partner-content affiliate werbung anzeige publicidad publicite pub reklame promo-box",
    "form": "form search search-form login signup newsletter subscribe contact-form comment-form newsletter-signup searchbox anmeldung suche buscador recherche-form kontaktformular",
    "comments": "comments comment comment-list comment-body comments-area replies reply discussion disqus respond thread user-comments commentlist reader-comments responses kommentare kommentar comentarios commentaires user-comments discussion-thread disqus-thread feedback-list",
    "share": "share social share-buttons social-links tags tag-list meta post-meta toolbar actions rating follow-us teilen compartir partager social-bar",
}
TAGS = {"main": ("article", "main", "section"), "nav": ("nav",), "header": ("header",), "footer": ("footer",), "sidebar": ("aside",), "notice": ("aside", "dialog", "section"), "ad": ("aside", "section"), "form": ("form",), "comments": ("section", "aside"), "share": ("aside", "ul")}
ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "notice": "alert", "form": "search", "main": "main"}
PHRASES = {
    "nav": "Home|News|Sport|About us|Contact|Products|Blog|Shop|Archive|Login|Next|Previous|Inicio|Noticias|Contacto|Accueil|Actualités|Startseite|Über uns|Kontakt|Skip to content|Sitemap|FAQ|Help|Menu|Categories",
    "header": "Daily Journal|The Weekly|Your source of news|Search|Sign in|Welcome back|Est. 1998|Open menu|Toggle navigation",
    "footer": "© 2024 All rights reserved.|Privacy policy|Terms of use|Imprint|Copyright © 2021|Powered by our CMS|Alle Rechte vorbehalten|Tous droits réservés|Todos los derechos reservados|Contact us · Careers · Press|Follow us on social media",
    "sidebar": "Related articles|Most read|Popular posts|Recommended for you|You may also like|Read more|Latest news|Trending now|About the author|Lesen Sie auch|À lire aussi|Más leídas",
    "notice": "We use cookies to improve your experience. By continuing you agree to our privacy policy.|Accept all cookies|This site uses cookies.|Subscribe to continue reading.|You have 2 free articles left this month.|Diese Website verwendet Cookies.|Ce site utilise des cookies.|Este sitio utiliza cookies.|Please enable JavaScript.|Breaking: updates follow.|Dismiss",
    "ad": "Advertisement|Sponsored|Buy now and save 50%!|Limited offer|Shop the sale today|Anzeige|Publicité|Publicidad|Click here for a free trial|Partner offer|Promoted content",
    "form": "Email address|Password|Subscribe to our newsletter|Sign up|Your name|Message|Search this site|Remember me|Leave a comment|Required fields are marked *|Submit",
    "comments": "Comments (12)|Leave a reply|Reply|Report|Show more comments|Kommentare|Commentaires|Comentarios|3 replies|Log in to comment|John says:|2 days ago|Like",
    "share": "Share|Tweet|Share on Facebook|Tags:|Filed under|Posted in|5 min read|Print|Email|Like 24|Follow",
}
_PHRASES = {k: v.split("|") for k, v in PHRASES.items()}
_NAMES = {k: v.split() for k, v in NAMES.items()}
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n+")


class _Page:
    def __init__(self, rng: random.Random, texts: list[str]) -> None:
        self.rng, self.texts = rng, texts
        self.semantic, self.named, self.messy = rng.random() < 0.55, rng.random() < 0.85, rng.random() < 0.25
        self.per_part = rng.random() < 0.7

    def sentences(self, most: int) -> list[str]:
        text = self.rng.choice(self.texts)
        parts = [s.strip() for s in _SENTENCE.split(text[:4000]) if s.strip()]
        start = self.rng.randrange(max(1, len(parts) - most))
        return parts[start : start + most] or ["–"]

    def prose(self, most: int) -> str:
        text = " ".join(self.sentences(self.rng.randint(1, most)))[:1500]
        return escape(text.rstrip(".!?…*#%$&") if self.rng.random() < 0.15 else text, quote=False)

    def words(self, most: int) -> str:
        return escape(" ".join(" ".join(self.sentences(3)).split()[: self.rng.randint(1, most)]), quote=False)

    def attributes(self, kind: str) -> str:
        rng, out = self.rng, []
        if self.named and rng.random() < 0.9:
            name = rng.choice(_NAMES[kind])
            if rng.random() < 0.3:
                name = re.sub(r"-(\w)", lambda m: m[1].upper(), name)
            if rng.random() < 0.25:
                name += rng.choice(("-wrapper", "-inner", " clearfix", " col-md-8", "_2", "Container", " block"))
            out.append(f'{rng.choice(("class", "class", "id"))}="{name}"')
        elif rng.random() < 0.3:
            out.append(f'class="{rng.choice("abcxyz")}{rng.randrange(99)}"')
        if kind in ROLES and rng.random() < 0.2:
            out.append(f'role="{ROLES[kind]}"')
        return "".join(" " + a for a in out)

    def wrapped(self, kind: str, inner: str) -> str:
        rng = self.rng
        semantic = self.semantic and rng.random() < 0.85
        tag = rng.choice(TAGS[kind]) if semantic and kind != "main" else "div"
        if kind == "form" and rng.random() < 0.8:
            tag = "form"
        attributes = self.attributes(kind)
        if kind not in ("nav", "footer", "form") and tag in ("div", "section") and not attributes:
            attributes = f' class="{rng.choice(_NAMES[kind])}"'  # prose by itself could not be told from an article
        if kind == "notice" and rng.random() < 0.1:
            attributes += rng.choice((" hidden", ' style="display: none"', ' aria-hidden="true"'))
        for _ in range(rng.randrange(2)):
            inner = f"<div>{inner}</div>"
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def phrase(self, kind: str) -> str:
        return escape(self.rng.choice(_PHRASES[kind]), quote=False) if self.rng.random() < 0.7 else self.words(6)

    def links(self, kind: str, n: int) -> str:
        items = [f'<a href="/{k}">{self.phrase(kind)}</a>' for k in range(n)]
        style = self.rng.randrange(4)
        if style < 2:
            return "<ul>" + "".join(f"<li>{x}{'' if self.messy else '</li>'}" for x in items) + "</ul>"
        return (" | " if style == 2 else " ").join(items) if self.rng.random() < 0.7 else "".join(f"<p>{x}</p>" for x in items)

    def part(self, kind: str) -> str:
        rng = self.rng
        if kind in ("nav", "share"):
            inner = self.links(kind, rng.randint(1, 9))
        elif kind == "header":
            inner = rng.choice(("<h1>{}</h1>", "<div>{}</div>", "<p>{}</p>", '<a href="/">{}</a>')).format(self.phrase(kind)) + (self.links("nav", rng.randint(2, 6)) if rng.random() < 0.5 else "")
        elif kind == "footer":
            inner = rng.choice(("<p>{}</p>", "{}", "<div>{}</div>")).format(self.phrase(kind) + (" &middot; " + self.prose(1) if rng.random() < 0.5 else "")) + (self.links(kind, rng.randint(1, 5)) if rng.random() < 0.5 else "")
            if rng.random() < 0.3:
                inner = f"&copy; {rng.choice(('example.org', 'site.example.net', '2023'))} &middot; " + inner
        elif kind == "sidebar":
            inner = rng.choice(("<h3>{}</h3>", "<h2>{}</h2>", "<b>{}</b>", "<h4>{}</h4>")).format(self.phrase(kind)) + (self.links(kind, rng.randint(2, 6)) if rng.random() < 0.6 else "".join(f"<p>{self.prose(3)}</p>" for _ in range(rng.randint(1, 3))))
        elif kind in ("notice", "ad"):
            text = self.phrase(kind) if rng.random() < 0.5 else self.prose(3)
            inner = rng.choice(("<p>{}</p>", "{}", "<span>{}</span>", "<div>{}</div>")).format(text)
            if rng.random() < 0.3:
                inner += f'<a href="#">{self.phrase(kind)}</a>' if rng.random() < 0.5 else "<button>OK</button>"
            if rng.random() < 0.2:
                inner = f"<h3>{self.phrase(kind)}</h3>" + inner
        elif kind == "form":
            inner = "".join(rng.choice(("<label>{}</label><input>", "<p>{}</p><input type=text>", "<div>{} <select><option>A<option>B</select></div>")).format(self.phrase(kind)) for _ in range(rng.randint(1, 4))) + "<button>Send</button>"
            if rng.random() < 0.4:
                inner = f"<h3>{self.phrase(kind)}</h3><p>{self.prose(2)}</p>" + inner
        else:  # comments
            each = [f"<{t}{self.attributes(kind)}><p>{self.prose(4)}</p></{t}>" if rng.random() < 0.6 else f"<p>{self.prose(4)}</p>" for t in [rng.choice(("div", "li", "article", "div"))] for _ in range(rng.randint(1, 5))]
            inner = rng.choice(("<h2>{}</h2>", "<h3>{}</h3>", "<p>{}</p>")).format(self.phrase(kind)) + "".join(each)
        return self.wrapped(kind, inner)

    def article(self) -> str:
        rng, out = self.rng, []
        mark = " data-main"

        def paragraph() -> str:
            shape = rng.random()
            if shape < 0.72:
                text = self.prose(8) if rng.random() < 0.85 else self.words(14) if rng.random() < 0.8 else escape(rng.choice(_PHRASES[rng.choice(("footer", "notice"))]), quote=False)
                if rng.random() < 0.15:
                    text = f'<b>{text}' if self.messy else f"<strong>{text}</strong>"
                if rng.random() < 0.2:
                    text += f' <a href="/x">{self.words(5)}</a> ' + self.prose(1)
                if rng.random() < 0.1:
                    text += "<br>" + self.prose(1)
                return f"<p{mark}>{text}" + ("" if self.messy else "</p>")
            if shape < 0.8:
                return f"<{(h := rng.choice(('h2', 'h3')))}{mark}>{self.words(9)}</{h}>"
            if shape < 0.87:
                tag = rng.choice(("ul", "ol"))
                return f"<{tag}{mark}>" + "".join(f"<li>{self.words(25)}" + ("" if self.messy else "</li>") for _ in range(rng.randint(2, 6))) + f"</{tag}>"
            if shape < 0.91:
                return f"<blockquote{mark}><p>{self.prose(3)}</p></blockquote>"
            if shape < 0.94:
                return f"<table{mark}>" + "".join(f"<tr><td>{self.words(3)}<td>{rng.randrange(1000)}" for _ in range(rng.randint(2, 4))) + "</table>"
            if shape < 0.96:
                return f"<pre{mark}>{self.words(12)}\n{self.words(9)}</pre>"
            return f"<div{mark}>{self.prose(4)}</div>"

        if rng.random() < 0.8:
            title = f"<h1{mark}>{self.words(12)}</h1>"
            out.append(f"<header>{title}</header>" if self.semantic and rng.random() < 0.15 else title)
        if rng.random() < 0.2:
            out.append(self.part("share"))
        inside = rng.random() < 0.5
        for _ in range(rng.choice((1, 2, 3, 4, 5, 6, 8, 12))):
            out.append(paragraph())
            if inside and rng.random() < 0.2:
                out.append(self.part(rng.choice(("ad", "notice", "sidebar", "form", "ad", "share", "nav"))))
        if rng.random() < 0.15:
            out.append(self.part("share"))
        if rng.random() < 0.2:
            out.append(self.part("comments"))
        tag = rng.choice(TAGS["main"]) if self.semantic else "div"
        if not self.semantic and self.per_part and rng.random() < 0.2:
            return "".join(out)
        if not self.semantic and rng.random() < 0.1:
            return "<table><tr><td>" + self.links("nav", 4) + f"<td{self.attributes('main')}>" + "".join(out) + "</table>"
        return f"<{tag}{self.attributes('main')}>" + "".join(out) + f"</{tag}>"

    def page(self) -> str:
        rng = self.rng
        before = [k for k, p in (("notice", 0.3), ("header", 0.6), ("nav", 0.8), ("form", 0.15), ("ad", 0.4), ("nav", 0.15), ("sidebar", 0.15)) if rng.random() < p]
        after = [k for k, p in (("comments", 0.3), ("sidebar", 0.45), ("form", 0.2), ("ad", 0.25), ("share", 0.15), ("nav", 0.1), ("notice", 0.15), ("footer", 0.85), ("notice", 0.08)) if rng.random() < p]
        body = "".join(map(self.part, before)) + self.article() + "".join(map(self.part, after))
        for _ in range(rng.randrange(3)):
            body = f'<div{rng.choice(("", " class=wrapper", " id=page", " class=container"))}>{body}</div>'
        if rng.random() < 0.03:
            body = f"<form method=post>{body}</form>"
        head = f"<head><title>{self.words(9)}</title><style>p{{margin:0}}</style><script>var a='<p>no text</p>';</script></head>"
        html = f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"
        return html[: rng.randint(len(html) * 2 // 3, len(html))] if rng.random() < 0.06 else html


def labelled_pages(texts: list[str], count: int = 1500, seed: int = 12) -> list[str]:
    """`count` pages around the texts; where there are none, around invented words."""
    rng = random.Random(seed)
    texts = [t for t in texts if t and t.strip()]
    if not texts:
        words = ["".join(rng.choices(["ba", "ne", "ti", "or", "lu", "ses"], k=rng.randint(1, 4))) for _ in range(500)]
        texts = [" ".join(" ".join(rng.choices(words, k=rng.randint(4, 20))).capitalize() + "." for _ in range(20)) for _ in range(50)]
    return [_Page(random.Random(rng.random()), texts).page() for _ in range(count)]


def rendered(docs: DataFrame, texts: int = 400, length: int = 4000, count: int = 1500) -> list[str]:
    """Labelled pages around the beginnings of at most `texts` documents; a bounded sample, by a hash of their ids, that only the fit reads. About twice as many
    come to the driver, whatever the table's size; of documents with one id one is taken."""
    own = docs.filter(F.length("text") > 0).select(F.substring("text", 1, length).alias("text"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    share = min(1.0, 2.0 * texts / max(1, docs.count()))
    some = own.filter(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40))).groupBy("h").agg(F.min("text").alias("text"))
    held = sorted((r["h"], r["text"]) for r in some.collect())
    return labelled_pages([text for _, text in held[:texts]], count)
