"""Pieces of SQL that say what the text functions say, for the comparison engine."""

from __future__ import annotations

from ..functions.text import PARTICLES

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def escape(x: str) -> str:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{plain}', '{entity}')"
    return x


_INLINE = ((r"\$\^\{([^{}$]+)\}\$", "sup"), (r"\$\^([^ \t\n\r\f\v${}]+)\$", "sup"), (r"\$_\{([^{}$]+)\}\$", "sub"), (r"\$([^$]+)\$", ""), (r"`([^`]+)`", "code"), (r"\*\*([^\n]+?)\*\*", "strong"), (r"\*([^\n]+?)\*", "em"))


def xhtml(x: str) -> str:
    x = escape(x)
    for pattern, tag in _INLINE:
        x = f"regexp_replace({x}, '{pattern}', '{f'<{tag}>' if tag else ''}\\1{f'</{tag}>' if tag else ''}', 'g')"
    return x


def plain(x: str) -> str:
    for pattern, _ in _INLINE:
        x = f"regexp_replace({x}, '{pattern}', '\\1', 'g')"
    return x


def particle(x: str) -> str:
    return f"regexp_matches({x}, '^[{PARTICLES}]( |$)')"


def merged(x: str) -> str:
    """Lines of x as one."""
    lines = f"list_filter(list_transform(string_split({x}, chr(10)), lambda s: {strip('s')}), lambda s: s <> '')"
    return f"array_to_string(list_transform({lines}, lambda s, i: CASE WHEN i = 1 OR {particle('s')} THEN s ELSE ' ' || s END), '')"


def clip(x: str) -> str:
    return f"CASE WHEN length({x}) > 100 THEN substring({x}, 1, 97) || '...' ELSE {x} END"
