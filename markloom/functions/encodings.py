"""Encodings of documents by their labels on the web.

A codec decodes names and texts of a document and encodes what is inserted; bytes that nothing touches are never decoded.
Encodings that aren't supersets of ASCII are rejected, since markup is found by its bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Names in the encoding standard with Python's codecs; others are named alike (fixed values).
CODECS = {
    "utf-8": "utf-8", "ibm866": "cp866", "koi8-r": "koi8-r", "koi8-u": "koi8-u", "macintosh": "mac-roman",
    "windows-874": "cp874", "x-mac-cyrillic": "mac-cyrillic", "gbk": "gbk", "gb18030": "gb18030", "big5": "big5hkscs",
    "euc-jp": "euc-jp", "shift_jis": "cp932", "euc-kr": "cp949", "x-user-defined": "x-user-defined",
}
CODECS |= {f"windows-{k}": f"cp{k}" for k in range(1250, 1259)}
CODECS |= {f"iso-8859-{k}": f"iso-8859-{k}" for k in (2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 15, 16)} | {"iso-8859-8-i": "iso-8859-8"}
ALIASES = {
    "utf8": "utf-8", "latin1": "windows-1252", "iso-8859-1": "windows-1252", "ascii": "windows-1252", "us-ascii": "windows-1252",
    "l1": "windows-1252", "cp1252": "windows-1252", "latin2": "iso-8859-2", "iso-8859-9": "windows-1254", "latin5": "windows-1254",
    "iso-8859-11": "windows-874", "tis-620": "windows-874", "sjis": "shift_jis", "windows-31j": "shift_jis", "gb2312": "gbk",
    "big5-hkscs": "big5", "ks_c_5601-1987": "euc-kr", "windows-949": "euc-kr", "koi8": "koi8-r", "cp866": "ibm866", "mac": "macintosh",
}
REJECTED = frozenset(("utf-16le", "utf-16be", "iso-2022-jp", "replacement", "utf-16"))


def encoding_for(label: str) -> str | None:
    """The encoding's name for a label; None for unknown labels and encodings that aren't supersets of ASCII."""
    s = label.strip(" \t\n\f\r").lower()
    s = ALIASES.get(s, s)
    return s if s in CODECS else None


@dataclass(frozen=True)
class Codec:
    """An encoding by its name in the encoding standard."""

    name: str = "utf-8"

    def decode(self, data: bytes) -> str:
        """Malformed bytes become U+FFFD."""
        if self.name == "x-user-defined":
            return "".join(chr(b) if b < 128 else chr(0xF700 + b) for b in data)
        return data.decode(CODECS[self.name], "replace")

    def encode(self, text: str) -> bytes:
        """What the encoding lacks becomes a numeric reference."""
        if self.name == "utf-8":
            return text.encode("utf-8", "replace")
        if self.name == "x-user-defined":
            return b"".join(bytes([ord(c)]) if ord(c) < 128 else bytes([ord(c) - 0xF700]) if 0xF780 <= ord(c) <= 0xF7FF else b"&#%d;" % ord(c) for c in text)
        return text.encode(CODECS[self.name], "xmlcharrefreplace")

    def has(self, text: str) -> bool:
        """Whether the encoding has all characters of a text."""
        if self.name == "x-user-defined":
            return all(ord(c) < 128 or 0xF780 <= ord(c) <= 0xF7FF for c in text)
        try:
            text.encode(CODECS[self.name])
        except UnicodeEncodeError:
            return False
        return True


UTF8 = Codec()


def codec_for(label: str) -> Codec:
    """The codec of a label; raises ValueError where :func:`encoding_for` finds none."""
    if label == "utf-8":
        return UTF8
    if (name := encoding_for(label)) is None:
        raise ValueError(f"{label!r} is unknown or isn't a superset of ASCII")
    return Codec(name)


_MIME_CHARSET = re.compile(r";\s*charset\s*=\s*\"?([^\s;\"]+)", re.I)


def declared_in(attributes: list[tuple[str, str]]) -> str | None:
    """The encoding that a ``<meta>`` with these attributes declares, by ``charset`` or ``http-equiv=content-type``."""
    values: dict[str, str] = {}
    for name, value in attributes:
        values.setdefault(name, value)
    label = values.get("charset")
    if label is None and values.get("http-equiv", "").lower() == "content-type":
        m = _MIME_CHARSET.search(values.get("content", ""))
        label = m[1] if m else None
    return encoding_for(label) if label is not None else None
