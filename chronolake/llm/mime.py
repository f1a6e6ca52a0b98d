"""The reader's text of the text parts of a raw mail."""

from __future__ import annotations

import binascii
import codecs
import html
import re
from functools import lru_cache

_BLANK = re.compile(r"\r?\n[ \t]*\r?\n|\r?\n[ \t]*\Z")
_FOLD = re.compile(r"\r?\n[ \t]+")
_HEADER = re.compile(r"^content-(type|transfer-encoding)[ \t]*:[ \t]*([^\r\n]*)", re.I | re.M)
_ANY_HEADER = re.compile(r"\A(?:From [^\r\n]*\r?\n)?[!-9;-~]+[ \t]*:")
_BOUNDARY = re.compile(r"boundary[ \t]*=[ \t]*(?:\"([^\"\r\n]*)\"|([^\s;\"]+))", re.I)
_CHARSET = re.compile(r"charset[ \t]*=[ \t]*\"?([^\s;\"]+)", re.I)
_FIRST_MARK = re.compile(r"^--(\S[^\r\n]*?)[ \t]*\r?$", re.M)
_NOT_BASE64 = re.compile(rb"[^A-Za-z0-9+/]+")
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(style|script)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|caption|center|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>", re.I)
_INLINE = re.compile(r"</?[a-z!?][^>]*>", re.I)
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


@lru_cache(256)
def _codec(charset: str) -> str | None:
    try:
        name = codecs.lookup(charset).name
        "".encode(name)
        return None if name == "ascii" or b"".decode(name) != "" else name
    except (LookupError, TypeError, ValueError):
        return None


def _decoded(data: bytes, charset: str) -> str:
    """Bytes in a charset; with an unknown one or ASCII, UTF-8 if that fits, else Latin-1."""
    if name := _codec(charset):
        return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _bytes(text: str, charset: str) -> bytes:
    try:
        return text.encode("ascii")
    except UnicodeEncodeError:
        return text.encode(_codec(charset) or "utf-8", "replace")


def without_tags(text: str) -> str:
    """HTML as read: no tags, comments, styles or scripts, block tags as line ends, entities resolved."""
    if "<" in text:
        text = _INLINE.sub("", _BLOCK.sub("\n", _HIDDEN.sub("", text)))
    return html.unescape(text)


def _body(kind: str, coding: str, charset: str, body: str) -> str:
    if coding == "base64":
        data = _NOT_BASE64.sub(b"", body.encode("ascii", "ignore"))
        data = data[: len(data) - (len(data) % 4 == 1)]
        body = _decoded(binascii.a2b_base64(data + b"=" * (-len(data) % 4)), charset)
    elif coding == "quoted-printable":
        body = _decoded(binascii.a2b_qp(_bytes(body, charset)), charset)
    return without_tags(body) if kind == "text/html" else body


def text_parts(mail: str | None) -> list[str]:
    """The reader's text of every text part, text attachments included, in order; nothing for NULL.

    Parts in 7bit or 8bit are characters already. A part ends at the next line with its boundary or that of an enclosing
    part, or with the mail. Lines of a header that aren't fields are ignored; the first of several equal fields counts.
    A multipart without a boundary uses the first line like one; without any such line it is read as plain text. A mail
    that doesn't begin with a header is one plain text. Mails inside mails are read like parts, at any depth.
    """
    found: list[str] = []
    todo = [(mail, 0)] if mail else []
    while todo:
        part, depth = todo.pop()
        m = _BLANK.search(part)
        if part[:1] in "\r\n" and (lead := re.match(r"\r?\n", part)):
            head, body = "", part[lead.end() :]
        elif depth == 0 and not _ANY_HEADER.match(part):
            head, body = "", part
        elif m:
            head, body = part[: m.start()], part[m.end() :]
        else:
            head, body = part, ""
        kind, coding, charset, ctype = "text/plain", "", "", ""
        fields: dict[str, str] = {}
        for name, value in _HEADER.findall(_FOLD.sub(" ", head)):
            fields.setdefault(name.lower(), value)
        if "type" in fields:
            ctype = fields["type"]
            kind = ctype.split(";", 1)[0].strip().lower() or "text/plain"
            if c := _CHARSET.search(ctype):
                charset = c[1].lower()
        coding = fields.get("transfer-encoding", "").split(";", 1)[0].strip().lower()
        if kind.startswith("multipart/"):
            b = _BOUNDARY.search(ctype)
            mark = (b[1] if b[1] is not None else b[2]).rstrip() if b else None
            if mark is None and (first := _FIRST_MARK.search(body)):
                mark = first[1]
            if mark is not None:
                pieces, at, open_ = [], 0, False
                for line in re.finditer(rf"^--{re.escape(mark)}(--)?[ \t]*(?:\r?\n|\Z)", body, re.M):
                    if open_:
                        pieces.append(body[at : line.start()])
                    at, open_ = line.end(), not line[1]
                    if line[1]:
                        break
                if open_:
                    pieces.append(body[at:])
                if pieces or at:
                    todo += [(x, depth + 1) for x in reversed(pieces)]
                    continue
            found.append(body)
        elif kind == "message/rfc822":
            todo.append((body.lstrip("\r\n"), depth + 1))
        elif kind.startswith("text/"):
            found.append(_body(kind, coding, charset, body))
    return found
