"""Training of the block labeller on generated pages: `python -m isohyet.llm.html_training` writes block_lstm.npz.

Pages are made of invented words in a random frame of menus, headers, adverts, notices, sidebars, forms, comments and footers
around and inside an article, under semantic tags or under class names, with some broken markup. The generator knows
which of its texts are main text. Gradients are back-propagated through time in numpy; the seed fixes everything.
"""

from __future__ import annotations

import os

import numpy as np

from .html_blocks import INPUTS, BlockLstm, features, leaf_blocks

SYLLABLES = "ba co di fe gu ha in jo ka lo mi ne or pu que ra si te un vo wa xi yo zu an er ing en tion és où ñga ß lich är con pro the of to et le der und las".split()
CLASSES = {
    "menu": "menu nav navbar navigation topnav main-menu breadcrumb breadcrumbs toc pager pagination tabs",
    "header": "header masthead site-header top-bar branding banner",
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion banner-ad adsbox teaser",
    "notice": "notice cookie cookie-notice consent gdpr alert popup modal newsletter subscribe paywall",
    "sidebar": "sidebar side aside widget related related-posts recommended trending popular tags share social",
    "form": "search login signup contact-form poll",
    "comments": "comment comments commentlist replies reply discussion disqus responses reader-comments",
    "footer": "footer site-footer bottom copyright legal disclaimer imprint colophon",
    "main": "content main main-content article article-body post post-body entry entry-content story text body-text page-content",
}


class Maker:
    """Generates one page; texts has (text, is main) in page order."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.texts = rng, []
        self.style = rng.choice(["plain", "plain", "plain", "marks", "loud", "table"])

    def one(self, options):
        return options[self.rng.integers(len(options))]

    def odds(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, n: int) -> list[str]:
        return ["".join(self.one(SYLLABLES) for _ in range(self.rng.integers(1, 5))) for _ in range(n)]

    def sentence(self, least: int = 1, most: int = 14, style: str = "plain") -> str:
        own = self.words(int(self.rng.integers(least, most + 1)))
        own[0] = own[0].capitalize()
        own = [w + "," if self.odds(0.06) else w for w in own]
        if style == "marks":
            own = [w + self.one(["***", "%%%", "$$$", "###", "&&&"]) for w in own]
        elif style == "loud":
            own = [w.upper() + "!!" for w in own]
        elif style == "table":
            return " | ".join(own) + self.one([" |", "."])
        return " ".join(own) + self.one([".", ".", ".", "?", ""])

    def put(self, text: str, main: bool) -> str:
        """Records a text and gives its markup."""
        self.texts.append((" ".join(text.split()), main))
        out = text.replace("&", "&amp;") if self.odds(0.8) else text.replace("&&&", "&amp;&amp;&")
        out = out.replace("<", "&lt;")
        if self.odds(0.05):
            out = out.replace("é", "&eacute;").replace("ß", "&#223;")
        if self.odds(0.15):
            parts = out.split(" ")
            i = self.rng.integers(len(parts))
            parts[i] = f"<{(t := self.one(['b', 'i', 'em', 'strong', 'span', 'math', 'object', 'svg']))}>{parts[i]}</{t}>"
            out = " ".join(parts)
        return out

    def attributes(self, kind: str) -> str:
        name = self.one(CLASSES[kind].split())
        return self.one([f' class="{name}"', f' class="{name}"', f' id="{name}"', f" class='{name} {self.words(1)[0]}'", f' class="{self.words(1)[0]} {name}-{self.rng.integers(9)}"'])

    def wrap(self, kind: str, tags: list[str], inside: str, bare: float = 0.35) -> str:
        tag = self.one(tags)
        plain = tag not in ("div", "section", "p", "ul", "td") and self.odds(bare)
        return f"<{tag}{'' if plain else self.attributes(kind)}>{inside}</{tag}>"

    def links(self, n: int) -> str:
        items = [f'<a href="/{i}">{self.put(" ".join(self.words(int(self.rng.integers(1, 4)))), False)}</a>' for i in range(n)]
        return "<ul>" + "".join(f"<li>{x}" + self.one(["</li>", "</li>", ""]) for x in items) + "</ul>"

    def boiler(self, kind: str) -> str:
        r = self.rng
        if kind == "menu":
            return self.wrap(kind, ["nav", "nav", "div", "ul"], self.links(int(r.integers(2, 9))))
        if kind == "form":
            return f"<form{self.attributes(kind) if self.odds(0.5) else ''}><label>{self.put(self.sentence(1, 4), False)}</label><input name=q><button>{self.put(self.sentence(1, 2), False)}</button></form>"
        tags = {"header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "sidebar": ["aside", "aside", "div", "section"], "comments": ["section", "div", "div", "ul"]}.get(kind, ["div", "div", "div", "section", "p"])
        inside, n = "", int(r.integers(1, 4)) if kind != "comments" else int(r.integers(1, 7))
        for _ in range(n):
            how = r.random()
            text = self.sentence(1, 25) if kind != "footer" or self.odds(0.5) else "© " + self.sentence(1, 8)
            if kind == "comments":
                body = f"<p>{self.put(text, False)}</p>"
                inside += f'<div class="{self.one(["comment", "reply", "comment-body"])}">{body}</div>' if how < 0.6 else f"<li>{body}</li>" if how < 0.8 else body
            elif n == 1 or how < 0.25 and not inside:
                inside += self.put(text, False)
            elif how < 0.5 and kind in ("sidebar", "header", "footer"):
                inside += f"<h{r.integers(1, 5)}>{self.put(self.sentence(1, 5), False)}</h{1}>" + (self.links(int(r.integers(1, 5))) if self.odds(0.5) else "")
            else:
                inside += f"<p>{self.put(text, False)}</p>"
        return self.wrap(kind, tags, inside)

    def article(self) -> str:
        r, out = self.rng, ""
        title = self.sentence(1, 12, self.style)
        if self.odds(0.85):
            head = f"<h1>{self.put(title, True)}</h1>"
            out += f"<header>{head}</header>" if self.odds(0.12) else head
        again = self.sentence(1, 3, self.style) if self.odds(0.04) else None  # an article that repeats one short line
        for _ in range(int(r.integers(10, 60)) if again else int(r.integers(0, 4)) if self.odds(0.35) else int(r.integers(1, 16))):
            how, text = r.random(), " ".join(self.sentence(1, 14, self.style) for _ in range(int(r.integers(1, 8)) if self.odds(0.8) else 1))
            if again or self.odds(0.08):
                text = again or self.sentence(1, 2, self.style)
            if again:
                how *= 0.68
            if how < 0.68:
                out += f"<p>{self.put(text, True)}" + self.one(["</p>", "</p>", "</p>", ""])
            elif how < 0.76:
                out += f"<p><b>{self.put(text, True)}<br>"
            elif how < 0.81:
                out += f"<h{r.integers(2, 5)}>{self.put(self.sentence(1, 8, self.style), True)}</h2>"
            elif how < 0.85:
                out += f"<blockquote>{self.put(text, True)}</blockquote>"
            elif how < 0.89:
                out += "<ul>" + "".join(f"<li>{self.put(self.sentence(2, 14, self.style), True)}</li>" for _ in range(int(r.integers(2, 6)))) + "</ul>"
            elif how < 0.91:
                out += f"<pre>{self.put(text, True)}</pre>"
            elif how < 0.94:
                out += f"<div>{self.put(text, True)}</div>"
            else:
                out += self.boiler(self.one(["ad", "ad", "sidebar", "notice", "form", "menu"]))
        return out

    def page(self) -> str:
        r = self.rng
        head = f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{self.put(self.sentence(1, 10, self.style), False)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>"
        above = "".join(self.boiler(k) for k in ("header", "menu", "notice", "form", "ad", "sidebar") if self.odds(0.45))
        if self.odds(0.3):
            above += "<!-- " + self.sentence() + " -->"
        tag = self.one(["article", "article", "article", "main", "div", "div", "section", "body"])
        inner = lambda: self.article()
        if tag == "body":
            body = inner()
        elif tag in ("article", "main") and self.odds(0.6):
            body = f"<{tag}>{inner()}</{tag}>"
        elif tag in ("article", "main"):
            body = f"<{tag}><div{self.attributes('main')}>{inner()}</div></{tag}>"
        else:
            body = f"<{tag}{self.attributes('main')}>{inner()}</{tag}>"
        if self.odds(0.25):
            body = f"<div{self.attributes('main') if self.odds(0.5) else ' class=' + self.words(1)[0]}>{body}"
            body += self.boiler("sidebar") if self.odds(0.4) else ""
            body += "</div>"
        below = "".join(self.boiler(k) for k in ("comments", "sidebar", "ad", "form", "menu", "notice") if self.odds(0.3))
        if self.odds(0.03):  # nothing but an article
            above, below = "", ""
        if self.odds(0.1):  # said instead of something else
            tag = self.one(["noscript", "iframe", "object", "video", "canvas"])
            above += f"<{tag}>{self.wrap('notice', ['div', 'p'], self.put(self.sentence(2, 14), False))}</{tag}>"
        foot = self.boiler("footer") if self.odds(0.85) else ""
        return head + above + body + below + foot + self.one(["</body></html>", "</body></html>", ""])


def sample(rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A page's block vectors and labels (1 main, 0 not, -1 where texts and blocks don't match)."""
    maker = Maker(rng)
    blocks = leaf_blocks(maker.page())
    labels, at = np.full(len(blocks), -1.0, np.float32), 0
    for i, b in enumerate(blocks):
        for k in range(at, min(len(maker.texts), at + 4)):
            if maker.texts[k][0] == b.text:
                labels[i], at = maker.texts[k][1], k + 1
                break
    return features(blocks), labels


def _direction(x, w, u, b):
    """Forward pass that keeps what the backward pass needs."""
    steps, pages, _ = x.shape
    n = u.shape[0]
    z = x @ w + b
    h, c = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
    kept, out = [], np.zeros((steps, pages, n), np.float32)
    for t in range(steps):
        g = z[t] + h @ u
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        cell, before_h, before_c = np.tanh(g[:, 2 * n : 3 * n]), h, c
        c = s[:, n : 2 * n] * c + s[:, :n] * cell
        tc = np.tanh(c)
        h = out[t] = s[:, 3 * n :] * tc
        kept.append((s, cell, tc, before_h, before_c))
    return out, kept


def _gradients(x, u, kept, dout):
    steps, n = len(kept), u.shape[0]
    dz = np.zeros((steps, x.shape[1], 4 * n), np.float32)
    du, dh, dc = np.zeros_like(u), 0.0, 0.0
    for t in range(steps - 1, -1, -1):
        s, cell, tc, before_h, before_c = kept[t]
        i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 3 * n :]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc**2)
        g = dz[t]
        g[:, :n] = dc * cell * i * (1 - i)
        g[:, n : 2 * n] = dc * before_c * f * (1 - f)
        g[:, 2 * n : 3 * n] = dc * i * (1 - cell**2)
        g[:, 3 * n :] = dh * tc * o * (1 - o)
        du += before_h.T @ g
        dh, dc = g @ u.T, dc * f
    return np.einsum("tpi,tpg->ig", x, dz, optimize=True), du, dz.sum(axis=(0, 1))


def train(hidden: int = 32, pages: int = 9000, steps: int = 2500, batch: int = 48, rate: float = 0.004, seed: int = 5, report=print) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    data = [sample(rng) for _ in range(pages)]
    held, data = data[: pages // 10], data[pages // 10 :]
    w = {k: rng.normal(0, (INPUTS + hidden) ** -0.5, s).astype(np.float32) for k, s in (("wf", (INPUTS, 4 * hidden)), ("uf", (hidden, 4 * hidden)), ("wb", (INPUTS, 4 * hidden)), ("ub", (hidden, 4 * hidden)), ("v", (2 * hidden,)))}
    w |= {"bf": np.zeros(4 * hidden, np.float32), "bb": np.zeros(4 * hidden, np.float32), "c": np.zeros((), np.float32)}
    w["bf"][hidden : 2 * hidden] = w["bb"][hidden : 2 * hidden] = 1
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def padded(rows):
        sizes = np.array([len(y) for _, y in rows])
        x, y = np.zeros((sizes.max(), len(rows), INPUTS), np.float32), np.full((sizes.max(), len(rows)), -1.0, np.float32)
        for i, (a, b) in enumerate(rows):
            x[: len(b), i], y[: len(b), i] = a, b
        return x, y, sizes

    for step in range(1, steps + 1):
        x, y, sizes = padded([data[i] for i in rng.choice(len(data), batch, replace=False)])
        back, cols = np.maximum(sizes[None] - 1 - np.arange(len(x))[:, None], 0), np.arange(x.shape[1])[None]
        inside = np.arange(len(x))[:, None] < sizes[None]
        xb = x[back, cols] * inside[:, :, None]
        hf, kf = _direction(x, w["wf"], w["uf"], w["bf"])
        hb, kb = _direction(xb, w["wb"], w["ub"], w["bb"])
        both = np.concatenate([hf, hb[back, cols]], axis=2)
        p = 1 / (1 + np.exp(-np.clip(both @ w["v"] + w["c"], -30, 30)))
        d = np.where(y >= 0, p - y, 0.0).astype(np.float32) / max(1, (y >= 0).sum())
        dboth = d[:, :, None] * w["v"]
        dhb = np.zeros_like(hb)
        np.add.at(dhb, (back[inside], np.broadcast_to(cols, back.shape)[inside]), dboth[:, :, hidden:][inside])
        g = {"v": np.einsum("tp,tph->h", d, both), "c": d.sum()}
        g["wf"], g["uf"], g["bf"] = _gradients(x, w["uf"], kf, dboth[:, :, :hidden])
        g["wb"], g["ub"], g["bb"] = _gradients(xb, w["ub"], kb, dhb)
        norm = np.sqrt(sum(float((a**2).sum()) for a in g.values()))
        lr = rate * min(1.0, 2 - 2 * step / steps)
        for k in w:
            a = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.999 * v[k] + 0.001 * a * a
            w[k] = (w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if step % 100 == 0 or step == steps:
            x, y, sizes = padded(held)
            s = BlockLstm(w).scores(x, sizes) > 0
            report(f"step {step}: held-out block accuracy {(s == (y > 0))[y >= 0].mean():.4f}")
    return w


if __name__ == "__main__":
    np.savez_compressed(os.path.join(os.path.dirname(__file__), "block_lstm.npz"), **{k: x.astype(np.float32) for k, x in train().items()})
