"""Pages without optional tags, hidden parts, and generated trees against what they were made of."""

import random

import pytest

from tidewater.llm.html_text import page_text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<html><head><title>t</title><body><p>hello", "hello"),
        ("<head><meta charset=x><link rel=y>hello", "hello"),
        ("<head><title>t</title><style>a{}</style><div>x</div>", "x"),
        ("<head><template><p>no</p></template><noscript><p>no</p></noscript>yes", "yes"),
        ("<head></br>x", "x"),
        ("a<!-->b<!--->c<!-- --!>d<!-- > -->e<!--", "abcde"),
        ("a</br>b", "a\nb"),
        ("<ruby>a<rp>(</rp><rt>b</rt><rp>)</rp></ruby>", "ab"),
        ("<dialog>no</dialog><dialog open>yes</dialog><dialog OPEN=''>too</dialog>", "yes\ntoo"),
        ('<p style="display&#58;none">no<p style="display: block">yes', "yes"),
        ("<div/>x</div>y", "x\ny"),
        ("<p>a<span/>b</p>c", "ab\n\nc"),
        ("<svg><g/><text>in</text></svg>after<math><mi/>x</math>", "in\nafterx"),
        ("<svg><foreignObject><div/>a</div>b</foreignObject></svg>", "a\nb"),
        ("<a href=x/>link</a> end", "link end"),
        (f"<table><tr><td>{'w' * 81}<td><td>z<tr><td>a<td>b", f"{'w' * 81}\t\tz\na\tb"),
        (f"<table><tr><td>a<td>{'w' * 300}<tr><td>bb<td>c", f"a   {'w' * 300}\nbb  c"),
        (f"<table><tr><td>{'w' * 81}<td>a<br>b<br>c<td>d<br>e<tr><td>f<td>g", f"{'w' * 81}\ta\nb\nc\td\ne\nf\tg"),
    ],
)
def test_found_pages(html, text):
    assert page_text(html) == text


class Made:
    """A random page, and its visible words with the block that each stands in."""

    def __init__(self, seed: int):
        self.r, self.words, self.n, self.block = random.Random(seed), [], 0, 0
        body = "".join(self.part(0, True) for _ in range(self.r.randint(1, 5)))
        head = self.r.choice(["", "<head>", "<head><title>hidden title</title>", "<html><head><meta name=a><script>var hidden;</script>", "<!DOCTYPE html><head><style>hidden{}</style></head>", "<head><title>hidden</title></head><body>", "<html><body>"])
        self.html = head + body

    def text(self, seen: bool) -> str:
        out = []
        for _ in range(self.r.randint(1, 3)):
            self.n += 1
            if seen:
                self.words.append((f"w{self.n}", self.block))
            out.append(f"w{self.n}" if seen else f"hidden{self.n}")
        return " " + self.r.choice([" ", "\n", "\t "]).join(out) + " "

    def inline(self, depth: int, seen: bool) -> str:
        kind = self.r.choice(["text", "text", "b", "void", "hidden", "comment", "slash"])
        if kind == "b" and depth < 6:
            name = self.r.choice(["b", "i", "span", "a href=x/", "em class='p>q'"])
            return f"<{name}>{self.inline(depth + 1, seen)}</{name.split()[0]}>"
        if kind == "void":
            return self.r.choice(["<img alt=hidden>", "<wbr>", "<input value=hidden>"]) + self.text(seen)
        if kind == "hidden":
            name = self.r.choice(["span hidden", "span style='display:none'", "template", "b style=\"color:red;DISPLAY : none\"", "rp"])
            return f"<{name}>{self.text(False)}</{name.split()[0]}>" + self.text(seen)
        if kind == "comment":
            return self.r.choice(["<!-- hidden -->", "<!-->", "<!--->", "<?hidden>"]) + self.text(seen)
        if kind == "slash":
            return f"<span/>{self.text(seen)}</span>"
        return self.text(seen)

    def line(self, depth: int, seen: bool) -> str:
        """Inline content that stands in a block of its own."""
        self.block += 1
        out = "".join(self.inline(depth, seen) for _ in range(self.r.randint(1, 2)))
        self.block += 1
        return out

    def part(self, depth: int, seen: bool) -> str:
        kind = self.r.choice(["p", "div", "list", "dl", "nest", "hidden"])
        if kind == "nest" and depth < 5:
            name = self.r.choice(["div", "section", "article", "blockquote", "main"])
            return f"<{name}>" + "".join(self.part(depth + 1, seen) for _ in range(self.r.randint(1, 3))) + f"</{name}>"
        if kind == "hidden":
            return f"<div hidden>{self.line(depth, False)}</div>"
        if kind == "list":
            return "<ul>" + "".join(f"<li>{self.line(depth, seen)}" + self.r.choice(["", "</li>"]) for _ in range(self.r.randint(1, 3))) + "</ul>"
        if kind == "dl":
            return "<dl>" + "".join(f"<{self.r.choice(['dt', 'dd'])}>{self.line(depth, seen)}" for _ in range(2)) + "</dl>"
        if kind == "p":
            # a paragraph's end may be left out before a block
            return f"<p>{self.line(depth, seen)}" + self.r.choice(["</p>", "", "<hr>"])
        return f"<div>{self.line(depth, seen)}</div>"


@pytest.mark.parametrize("seeds", [range(i, 4000, 8) for i in range(8)])
def test_generated_pages_show_every_visible_word_in_its_block(seeds):
    for seed in seeds:
        made = Made(seed)
        lines = [[w for w in line.split() if w != "-"] for line in page_text(made.html).split("\n")]
        assert [w for line in lines for w in line] == [w for w, _ in made.words], made.html
        block, of = dict(made.words), {}
        for i, line in enumerate(lines):
            assert len({block[w] for w in line}) <= 1, made.html
            for w in line:
                assert of.setdefault(block[w], i) == i, made.html
