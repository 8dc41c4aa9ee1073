"""A plain recursive renderer for small pages, by way of the standard parser and of text with marks for what is between words."""

import re
from html.parser import HTMLParser

VOID = ("br", "img", "meta", "hr", "input")
BLOCKS = ("div", "nav", "article", "footer", "li", "section", "body", "html")
SPACED = ("p", "h1", "h2", "ul", "ol", "table")
GONE = ("head", "title", "script", "style")


class Parser(HTMLParser):
    def __init__(self, html):
        super().__init__()
        self.top = ["", {}, []]
        self.open = [self.top]
        self.feed(html)
        self.close()

    def upto(self, tags, stops):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in tags:
                self.open = self.open[:k]
                return
            if self.open[k][0] in stops:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS + SPACED and tag not in ("li", "body", "html"):
            self.upto(["p"], ["td", "li", "div", "table", "article", "section"])
        if tag == "li":
            self.upto(["li"], ["ul", "ol"])
        if tag in ("td", "th"):
            self.upto(["td", "th"], ["tr", "table"])
        if tag == "tr":
            self.upto(["td", "th"], ["tr", "table"])
            self.upto(["tr"], ["table"])
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        self.upto([tag], ["table"] if tag in ("p", "li", "div", "span", "a", "b", "i") else [])

    def handle_data(self, data):
        self.open[-1][2].append(data)


def tables_text(node):
    """Every cell in a grid of characters wide enough for its column."""
    rows = [[c for c in r[2] if not isinstance(c, str)] for r in node[2] if not isinstance(r, str)]
    taken, cells = set(), []
    for r, row in enumerate(rows):
        at = 0
        for cell in row:
            while (r, at) in taken:
                at += 1
            wide, high = int(cell[1].get("colspan", 1)), int(cell[1].get("rowspan", 1))
            taken |= {(r + i, at + j) for i in range(high) for j in range(wide)}
            cells.append((r, at, at + wide, page_text(cell[2]).split("\n")))
    left = [0] * 99
    for c in range(1, 99):
        left[c] = max([left[c - 1]] + [left[a] + max(map(len, text)) + 2 for _, a, b, text in cells if b == c])
    lines = []
    for r in range(len(rows)):
        own = [c for c in cells if c[0] == r]
        if not any("".join(c[3]) for c in own):
            continue
        for k in range(max((len(c[3]) for c in own), default=0)):
            line = ""
            for _, a, _, text in own:
                if k < len(text):
                    line = line.ljust(max(left[a], len(line) + 2 if line else 0)) + text[k]
            lines.append(line.rstrip())
    return "\n".join(lines)


def marked(nodes, lists):
    """Text with \x01 for a break asked for, \x02 for a blank line asked for, \x03 for br; list items bring their marks."""
    out = ""
    for n in nodes:
        if isinstance(n, str):
            out += re.sub(r"[ \t\n\r\f]+", " ", n)
            continue
        tag, attrs, inside = n
        if tag in GONE or "hidden" in attrs:
            continue
        if tag == "br":
            out += "\x03"
        elif tag == "table":
            text = tables_text(n)
            out += "\x02" + (text.replace(" ", "\x04").replace("\n", "\x05") if text.strip() else "") + "\x02"
        elif tag in ("ul", "ol"):
            text, number, gap = "", 1, "\x01" if lists else "\x02"
            for li in inside:
                if not isinstance(li, str):
                    mark = f"{number}. " if tag == "ol" else "- "
                    number += 1
                    body = page_text(li[2], lists + 1)
                    if body:
                        body = mark + body.replace("\n", "\n" + " " * len(mark))
                    text += "\x01" + body.replace(" ", "\x04").replace("\n", "\x05") + "\x01"
            out += gap + text + gap
        else:
            mark = "\x02" if tag in SPACED else "\x01" if tag in BLOCKS else ""
            out += mark + marked(inside, lists) + mark
    return out


def page_text(nodes, lists=0):
    def gap(m):
        due = 0
        for c in m[0]:
            due = due + 1 if c == "\x03" else max(due, {"\x01": 1, "\x02": 2}.get(c, 0))
        return "\n" * due if due else " "

    text = re.sub("[ \x01\x02\x03]+", gap, marked(nodes, lists)).strip(" \n")
    return text.replace("\x04", " ").replace("\x05", "\n")


def html_text(html):
    return page_text(Parser(html).top[2])
