"""HTML to Markdown: a per-document state machine in one Arrow UDF, and native entity decoding."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from webstrata.functions.rows import row_udf

#: Named references that are decoded; all others stay as written.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®",
    "trade": "™", "mdash": "—", "ndash": "–", "bull": "•", "hellip": "…", "prime": "′", "Prime": "″",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "times": "×",
    "divide": "÷", "plusmn": "±", "deg": "°", "sect": "§", "para": "¶", "euro": "€", "pound": "£",
    "yen": "¥", "cent": "¢",
}

_SPACES = " \t\n\v\f\r"
_REFERENCE = re.compile(r"&(#[xX][0-9A-Fa-f]*|#[0-9]*|[^;]{1,11});")
_TOKEN = re.compile(r"<[^>]*>|&#?[A-Za-z0-9]{1,11};|[^<&]+|[<&]")
_NAME = re.compile(r"[ \t\n\v\f\r]*([^ \t\n\v\f\r>/]{0,31})")
_RUN = re.compile(r"[ \t\n\v\f\r]+")
_MAX_TAG = 1023


def decode_reference(ref: str) -> str | None:
    """The text of one `&…;`, None if it stays literal."""
    m = _REFERENCE.fullmatch(ref)
    if m is None or len(ref) > 13:
        return None
    body = m[1]
    if not body.startswith("#"):
        return ENTITIES.get(body)
    digits, base = (body[2:], 16) if body[1:2] in ("x", "X") else (body[1:], 10)
    point = int(digits, base) if digits else 0
    return chr(point) if 0 < point <= 0x10FFFF and not 0xD800 <= point < 0xE000 else None


def attribute(tag: str, name: str, limit: int) -> str:
    """First value of `name` in a tag, found by text: data-href counts as href."""
    m = re.search(name + r"[ \t\n\v\f\r]*=[ \t\n\v\f\r]*(?:\"([^\"]*)|'([^']*)|([^ \t\n\v\f\r>]*))", tag, re.I)
    return (m[1] or m[2] or m[3] or "")[:limit] if m else ""


class _Writer:
    """Output so far and what the next token depends on."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.last = ""
        self.pre = False
        self.lists: list[list[int]] = [[0, 0] for _ in range(16)]  # [ordered, next number]; slots outlive their list
        self.depth = 0
        self.columns, self.header = 0, False
        self.link, self.linked = "", False

    def put(self, text: str) -> None:
        if text:
            self.out.append(text)
            self.last = text[-1]

    def fresh(self, gap: str) -> None:
        if self.last not in ("", "\n"):
            self.put(gap)

    def text(self, s: str) -> None:
        if self.pre:
            self.put(s)
            return
        s = _RUN.sub(" ", s)
        if s[0] == " " and (self.last == "" or self.last in _SPACES):
            s = s[1:]
        self.put(s)

    def tag(self, tag: str) -> None:
        closing = tag.startswith("</")
        name = _NAME.match(tag, 2 if closing else 1)[1].lower()
        rule = _Writer.heading if name[:1] == "h" and name[1:2] in tuple("123456") else _RULES.get(name)
        if rule is not None:
            rule(self, tag, name, closing)

    def heading(self, tag: str, name: str, closing: bool) -> None:
        if closing:
            self.put("\n\n")
        else:
            self.fresh("\n\n")
            self.put("#" * int(name[1]) + " ")

    def block(self, tag: str, name: str, closing: bool) -> None:
        self.put("\n\n") if closing else self.fresh("\n\n")

    def mark(self, tag: str, name: str, closing: bool) -> None:
        self.put({"br": "\n", "strong": "**", "b": "**", "em": "*", "i": "*", "hr": "\n\n---\n\n"}[name])

    def fence(self, tag: str, name: str, closing: bool) -> None:
        self.pre = not closing
        if closing:
            self.put("\n```\n\n")
        else:
            self.fresh("\n\n")
            self.put("```\n")

    def code(self, tag: str, name: str, closing: bool) -> None:
        if not self.pre:
            self.put("`")

    def quote(self, tag: str, name: str, closing: bool) -> None:
        self.block(tag, name, closing)
        if not closing:
            self.put("> ")

    def listing(self, tag: str, name: str, closing: bool) -> None:
        if closing:
            self.depth = max(0, self.depth - 1)
            self.put("\n")
            return
        if self.depth < 15:
            self.lists[self.depth] = [1, 1] if name == "ol" else [0, 0]
            self.depth += 1
        self.fresh("\n")

    def item(self, tag: str, name: str, closing: bool) -> None:
        if closing:
            self.put("\n")
            return
        self.fresh("\n")
        slot = self.lists[max(self.depth - 1, 0)]
        self.put("  " * max(self.depth - 1, 0))
        if slot[0]:
            self.put(f"{slot[1]}. ")
            slot[1] += 1
        else:
            self.put("- ")

    def anchor(self, tag: str, name: str, closing: bool) -> None:
        if not closing:
            self.link = attribute(tag, "href", 511)
            if self.link:
                self.put("[")
                self.linked = True
        elif self.linked and self.link:
            self.put(f"]({self.link})")
            self.link, self.linked = "", False

    def image(self, tag: str, name: str, closing: bool) -> None:
        if src := attribute(tag, "src", 511):
            self.put(f"![{attribute(tag, 'alt', 255)}]({src})")

    def table(self, tag: str, name: str, closing: bool) -> None:
        self.block(tag, name, closing)
        if not closing:
            self.header = False

    def row(self, tag: str, name: str, closing: bool) -> None:
        if closing:
            self.put("|\n")
            if self.header:
                self.put("|---" * self.columns + "|\n")
            self.columns, self.header = 0, False

    def cell(self, tag: str, name: str, closing: bool) -> None:
        if closing:
            self.put(" ")
            return
        self.put("| ")
        self.columns += 1
        self.header = self.header or name == "th"


_RULES = (
    dict.fromkeys(("p", "div", "section", "article"), _Writer.block)
    | dict.fromkeys(("br", "strong", "b", "em", "i", "hr"), _Writer.mark)
    | dict.fromkeys(("ul", "ol"), _Writer.listing)
    | dict.fromkeys(("th", "td"), _Writer.cell)
    | {"pre": _Writer.fence, "code": _Writer.code, "blockquote": _Writer.quote, "li": _Writer.item, "a": _Writer.anchor}
    | {"img": _Writer.image, "table": _Writer.table, "tr": _Writer.row}
)


def to_markdown(html: str | None, trim_trailing: bool = False) -> str | None:
    """Markdown of one document; None stays None."""
    if html is None:
        return None
    w = _Writer()
    for token in _TOKEN.findall(html):
        if token[0] == "<" and len(token) > 1:
            if len(token.encode()) <= _MAX_TAG:
                w.tag(token)
        elif token[0] == "&" and not w.pre and (ref := decode_reference(token)) is not None:
            w.put(ref)
        else:
            w.text(token)
    out = "".join(w.out)
    return out.rstrip("\n") + "\n" if trim_trailing and out else out


html_to_markdown = row_udf(to_markdown, StringType())


def decode_entities(text: Column) -> Column:
    """Named and numeric references, each decoded once: the text is cut at references, which are then looked up. Others stay."""
    pattern = r"&(?:#[xX][0-9A-Fa-f]{1,8}|#[0-9]{1,9}|[A-Za-z]{1,11});"
    names = F.create_map(*(F.lit(x) for k, v in ENTITIES.items() for x in (f"&{k};", v)))

    def one(ref: Column) -> Column:
        digits = F.regexp_extract(ref, "^&#[xX]?([0-9A-Fa-f]*);$", 1)
        point = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        # UTF-8 of the code point, byte by byte.
        byte = lambda first, shift: F.lpad(F.hex(first + F.shiftright(point, shift).bitwiseAND(63 if first == 128 else 127)), 2, "0")
        coded = (
            F.when(point < 128, byte(0, 0)).when(point < 2048, F.concat(byte(192, 6), byte(128, 0)))
            .when(point < 65536, F.concat(byte(224, 12), byte(128, 6), byte(128, 0)))
            .otherwise(F.concat(byte(240, 18), byte(128, 12), byte(128, 6), byte(128, 0)))
        )
        valid = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        return F.when(F.startswith(ref, F.lit("&#")), F.when(valid, F.decode(F.unhex(coded), "UTF-8")).otherwise(ref)).otherwise(F.coalesce(F.try_element_at(names, ref), ref))

    gaps, refs = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(gaps, refs, lambda g, r: F.concat(g, F.when(r.isNull(), "").otherwise(one(r)))), "")
