"""One regular-expression dialect for the JVM and Python, with the meaning of a linear-time RE2 pattern.

Rules and user patterns are written for RE2. :func:`portable` rewrites one so that java.util.regex and Python's ``re`` find the
same spans: character classes are spelled out, ``$`` means the end of text only, ``.`` excludes only the newline, word
boundaries are ASCII, and case-insensitive parts are expanded letter by letter, among all letters of Unicode.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_WORD = "0-9A-Za-z_"
_SPACE = r"\t\n\f\r "
_CLASSES = {"d": "0-9", "w": _WORD, "s": _SPACE}
_BOUNDARY = rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
_INSIDE = rf"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))"
_END, _START = r"(?![\s\S])", r"(?<![\s\S])"
#: The named ASCII classes.
_NAMED = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": "\\x00-\\x7f", "blank": "\\t ", "cntrl": "\\x00-\\x1f\\x7f", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": "!-/:-@\\[-`{-~", "space": "\\t\\n\\x0b\\f\\r ", "upper": "A-Z", "word": _WORD, "xdigit": "0-9A-Fa-f",
}
_META = set("\\^$.|?*+()[]{}")
#: RE2's limit for a counted repetition.
MOST_REPEATS = 1000


def _ranges(codes: list[tuple[int, int]]) -> str:
    """The inside of a character class for sorted ranges of code points."""
    return "".join(_escape(chr(a), True) + (f"-{_escape(chr(b), True)}" if b > a else "") for a, b in codes)


@lru_cache(maxsize=512)
def _complement(inside: str) -> str:
    """What a character class does not hold, as the inside of another."""
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    return _ranges([(ord(m[0][0]), ord(m[0][-1])) for m in re.finditer(f"[^{inside}]+", every)])


@lru_cache(maxsize=256)
def _property(name: str) -> str:
    """The inside of a class for a Unicode category or script."""
    codes: list[tuple[int, int]] = []
    wanted = _members(name)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and wanted(chr(c)):
            if codes and codes[-1][1] == c - 1:
                codes[-1] = codes[-1][0], c
            else:
                codes.append((c, c))
    return _ranges(codes)


def _members(name: str):
    if name == "Any":
        return lambda c: True
    if re.fullmatch("[LMNPSZC][a-z]?", name):
        # A code point that is not assigned yet is of no category.
        return lambda c: (k := unicodedata.category(c)).startswith(name) and k != "Cn"
    try:
        import regex

        script = regex.compile(rf"\p{{Script={name}}}")
    except Exception as e:  # noqa: BLE001  whatever the module raises, the name is not known here
        raise re.error(f"character property {name!r} is not known") from e
    return lambda c: script.match(c) is not None


def _escape(c: str, in_class: bool = False) -> str:
    if c in _META or in_class and c in "-&~^[]\\":
        return "\\" + c
    return {"\n": r"\n", "\t": r"\t", "\r": r"\r", "\f": r"\f"}.get(c, c)


@lru_cache(maxsize=1)
def _orbits() -> dict[str, str]:
    """Per letter those that are it in another case: of all code points, as RE2 folds them."""
    groups: dict[str, list[str]] = {}
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x20000))):
        if len(c.casefold()) == 1:
            groups.setdefault(c.casefold(), []).append(c)
    return {c: "".join(g) for g in groups.values() if len(g) > 1 for c in g}


def _either_case(c: str) -> str:
    return _orbits().get(c, c)


@lru_cache(maxsize=512)
def _folded(inside: str) -> str:
    """The inside of a class with all letters in any case."""
    held = re.compile(f"[{inside}]")
    return inside + "".join(_escape(x, True) for x in sorted({x for c, g in _orbits().items() if held.match(c) for x in g if not held.match(x)}))


class _Reader:
    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def take(self, n: int = 1) -> str:
        out = self.text[self.at : self.at + n]
        self.at += n
        return out

    def sees(self, s: str) -> bool:
        return self.text.startswith(s, self.at)


def _literal_escape(r: _Reader) -> str:
    """The character of an escape that stands for one."""
    c = r.take()
    if c in "nrtfva":
        return {"n": "\n", "r": "\r", "t": "\t", "f": "\f", "v": "\v", "a": "\a"}[c]
    if c == "x":
        digits = r.take(2)
        if digits.startswith("{"):
            while not digits.endswith("}"):
                if r.at >= len(r.text):
                    raise re.error("missing }", r.text, r.at)
                digits += r.take()
            digits = digits[1:-1]
        return chr(int(digits, 16))
    if c in "01234567" and c and (c == "0" or r.text[r.at : r.at + 1] in tuple("01234567")):
        while len(c) < 3 and r.text[r.at : r.at + 1] in tuple("01234567"):
            c += r.take()
        return chr(int(c, 8))
    if not c or c.isalnum():
        raise re.error(f"escape \\{c} is not supported", r.text, r.at)
    return c


def _class_escape(r: _Reader, fold: bool) -> str | None:
    """The inside of a class for an escape that stands for one: \\d, \\pL, \\p{Greek} and their opposites; None for other escapes."""
    c = r.text[r.at : r.at + 1]
    if c and c.lower() in _CLASSES:
        r.take()
        inside = _folded(_CLASSES[c.lower()]) if fold else _CLASSES[c.lower()]
        return inside if c.islower() else _complement(inside)
    if c not in ("p", "P") or not c:
        return None
    r.take()
    name = r.take()
    if name == "{":
        end = r.text.find("}", r.at)
        if end < 0:
            raise re.error("missing }", r.text, r.at)
        name = r.take(end - r.at)
        r.take()
    negative = (c == "P") != name.startswith("^")
    inside = _property(name.removeprefix("^"))
    inside = _folded(inside) if fold else inside
    return _complement(inside) if negative else inside


def _read_class(r: _Reader, fold: bool) -> str:
    out = "[^" if r.sees("^") else "["
    if out == "[^":
        r.take()
    first = True
    while first or not r.sees("]"):
        if r.at >= len(r.text):
            raise re.error("missing ]", r.text, r.at)
        first = False
        c = r.take()
        if c == "[" and r.sees(":") and (named := re.match(r":(\^?)([a-z]+):\]", r.text[r.at :])):
            if named[2] not in _NAMED:
                raise re.error("unknown named class", r.text, r.at)
            r.at += named.end()
            inside = _folded(_NAMED[named[2]]) if fold else _NAMED[named[2]]
            out += _complement(inside) if named[1] else inside
            continue
        if c == "\\":
            if (inside := _class_escape(r, fold)) is not None:
                out += inside
                continue
            c = _literal_escape(r)
        if r.sees("-") and r.text[r.at + 1 : r.at + 2] not in ("]", ""):
            r.take()
            end = r.take()
            if end == "\\":
                end = _literal_escape(r)
            span = f"{_escape(c, True)}-{_escape(end, True)}"
            if c > end:
                raise re.error("invalid range", r.text, r.at)
            out += _folded(span) if fold else span
        else:
            out += "".join(_escape(x, True) for x in (_either_case(c) if fold else c))
    r.take()
    return out + "]"


def portable(pattern: str) -> str:
    """The pattern in the common dialect; raises ``re.error`` if it is not a valid RE2 pattern that the dialect covers."""
    return _translate(pattern)[0]


def group_numbers(pattern: str) -> dict[str, int]:
    """The numbers of a pattern's named groups, which have no names in the common dialect."""
    return dict(_translate(pattern)[1])


def _repeated(r: _Reader, quantifier: str, flags: dict) -> str:
    """A quantifier that takes as much as it can, or as little: the flag U exchanges the two."""
    lazy = r.sees("?")
    if lazy:
        r.take()
    return quantifier + ("?" if lazy != flags["U"] else "")


@lru_cache(maxsize=4096)
def _translate(pattern: str) -> tuple[str, tuple[tuple[str, int], ...]]:
    r, out = _Reader(pattern), []
    flags = {"i": False, "s": False, "m": False, "U": False}
    stack: list[dict] = []
    names: dict[str, int] = {}
    groups = 0
    while r.at < len(pattern):
        c = r.take()
        if c == "(":
            stack.append(dict(flags))
            if not r.sees("?"):
                groups += 1
                out.append("(")
                continue
            r.take()
            if r.sees(":"):
                r.take()
                out.append("(?:")
            elif r.sees("P<") or r.sees("<") and not (r.sees("<=") or r.sees("<!")):
                r.take(2 if r.sees("P") else 1)
                end = r.text.find(">", r.at)
                name = r.text[r.at : max(end, r.at)]
                if not re.fullmatch(r"\w+", name, re.A) or name in names:
                    raise re.error("invalid group name", pattern, r.at)
                r.take(end - r.at + 1)
                groups += 1
                names[name] = groups
                out.append("(")
            else:
                on, letters = True, ""
                while not (r.sees(":") or r.sees(")")):
                    letters = r.take() or " "
                    if letters == "-":
                        on = False
                    elif letters in flags:
                        flags[letters] = on
                    else:
                        raise re.error("unsupported group", pattern, r.at)
                if r.take() == ":":
                    out.append("(?:")
                else:
                    # Flags for the rest of the enclosing group: no group was opened.
                    stack.pop()
        elif c == ")":
            if not stack:
                raise re.error("unbalanced parenthesis", pattern, r.at)
            flags = stack.pop()
            out.append(")")
        elif c == "[":
            out.append(_read_class(r, flags["i"]))
        elif c == "\\":
            n = r.text[r.at : r.at + 1]
            if n and n.lower() in _CLASSES and not flags["i"]:
                out.append(f"[{'^' if n.isupper() else ''}{_CLASSES[r.take().lower()]}]")
            elif (inside := _class_escape(r, flags["i"])) is not None:
                out.append(f"[{inside}]")
            elif n == "Q":
                r.take()
                end = r.text.find("\\E", r.at)
                literal = r.take((end if end >= 0 else len(r.text)) - r.at)
                r.take(2)
                out += [_letter(x, flags["i"]) for x in literal]
            elif n in ("b", "B", "A", "z"):
                out.append({"b": _BOUNDARY, "B": _INSIDE, "A": _START, "z": _END}[r.take()])
            else:
                out.append(_letter(_literal_escape(r), flags["i"]))
        elif c == ".":
            out.append(r"[\s\S]" if flags["s"] else r"[^\n]")
        elif c == "^":
            out.append(_START if not flags["m"] else r"(?<![^\n])")
        elif c == "$":
            out.append(_END if not flags["m"] else r"(?![^\n])")
        elif c == "{":
            counted = re.match(r"(\d+)(,(\d*))?\}", pattern[r.at :])
            if counted is None:
                out.append(r"\{")
                continue
            if any(int(x) > MOST_REPEATS for x in (counted[1], counted[3] or "0")):
                raise re.error(f"repeat count over {MOST_REPEATS}", pattern, r.at)
            r.at += counted.end()
            out.append(_repeated(r, "{" + counted[0], flags))
        elif c in "*+?":
            if out and out[-1].rstrip("?") in ("*", "+", "") and out[-1]:
                raise re.error("invalid nested repetition", pattern, r.at)
            out.append(_repeated(r, c, flags))
        elif c == "|":
            out.append(c)
        else:
            out.append(_letter(c, flags["i"]))
    if stack:
        raise re.error("missing )", pattern, r.at)
    result = "".join(out)
    re.compile(result)
    return result, tuple(names.items())


def _letter(c: str, fold: bool) -> str:
    both = _either_case(c) if fold else c
    return _escape(c) if len(both) == 1 else f"[{both}]"


@lru_cache(maxsize=4096)
def compiled(pattern: str) -> re.Pattern:
    return re.compile(portable(pattern))
