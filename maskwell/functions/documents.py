"""JSON values, transcripts (JSON lines) and session metadata."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from maskwell.errors import ActionableError
from maskwell.plans.policy import ScannerConfig


class Number(str):
    """A JSON number as it was written, so that no precision is lost."""


def _hook(text: str) -> Number:
    return Number(text)


def _reject(text: str):
    raise ValueError(text)


_DECODER = json.JSONDecoder(parse_int=_hook, parse_float=_hook, parse_constant=_reject)


def decode(text: str):
    """The first JSON value of a text; what follows it is dropped. Numbers keep their digits; of repeated keys the last counts. Half of a
    surrogate pair, which UTF-8 can't hold, becomes U+FFFD."""
    text = text.lstrip(" \t\r\n")
    value = _DECODER.raw_decode(text)[0]
    return _whole(value) if "\\u" in text else value


def _whole(value):
    if isinstance(value, Number):
        return value
    if isinstance(value, str):
        return re.sub("[\ud800-\udfff]", "\ufffd", value)
    if isinstance(value, list):
        return [_whole(v) for v in value]
    if isinstance(value, dict):
        return {_whole(k): _whole(v) for k, v in value.items()}
    return value


_ESCAPES = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", " ": "\\u2028", " ": "\\u2029"}


def _string(s: str, compatible: bool) -> str:
    out = json.dumps(s, ensure_ascii=False)
    return re.sub("[<>&  ]", lambda m: _ESCAPES[m[0]], out) if compatible else out


def encode(value, compatible: bool = True) -> str:
    """Compact JSON. ``compatible``: keys sorted by code point and ``<``, ``>``, ``&`` escaped."""
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, str):
        return _string(value, compatible)
    if isinstance(value, list):
        return "[" + ",".join(encode(v, compatible) for v in value) + "]"
    if isinstance(value, dict):
        items = sorted(value.items()) if compatible else value.items()
        return "{" + ",".join(_string(k, compatible) + ":" + encode(v, compatible) for k, v in items) + "}"
    return {None: "null", True: "true", False: "false"}[value]


def map_strings(value, mask: Callable[[str], str]):
    """The value with every string masked. Keys, numbers, booleans and nulls stay, and so does the order of arrays."""
    if isinstance(value, Number):
        return value
    if isinstance(value, str):
        return mask(value)
    if isinstance(value, list):
        return [map_strings(v, mask) for v in value]
    if isinstance(value, dict):
        return {k: map_strings(v, mask) for k, v in value.items()}
    return value


def rewrite_line(line: str, mask: Callable[[str], str]) -> str:
    """One line of a transcript; a line that is no JSON comes back as it is."""
    if not line:
        return line
    try:
        value = decode(line)
    except (ValueError, RecursionError):
        return line
    return encode(map_strings(value, mask))


def rewrite_document(text: str, mask: Callable[[str], str]) -> str:
    """A whole JSON document; the original text where it is no JSON."""
    try:
        return encode(map_strings(decode(text), mask))
    except (ValueError, RecursionError):
        return text


def rewrite_transcript(data: str, mask: Callable[[str], str], config: ScannerConfig | None = None) -> str:
    """All lines of a transcript, each ended by a newline. A line of the largest size or more fails the whole: nothing is rewritten."""
    config = (config or ScannerConfig()).validate("maskwell.functions.documents.rewrite_transcript")
    lines = data.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    if any(len(x.encode("utf-8", "surrogatepass")) >= config.most for x in lines):
        raise ActionableError("a transcript line is too long", f"it has {config.most} bytes or more", "maskwell.functions.documents.rewrite_transcript", "lines were read", "nothing was rewritten; keep the original", "raise the largest line size")
    return "".join(rewrite_line(x.removesuffix("\r"), mask) + "\n" for x in lines)


def home_user(path: str) -> tuple[str, str]:
    """(user, prefix with its slash) of a path below /home or /Users; empty elsewhere."""
    m = re.match(r"(/home/|/Users/)([^/]+)/", path or "")
    return (m[2], m[0]) if m else ("", "")


def private_pairs(file_path: str, cwd: str) -> list[tuple[str, str]]:
    """What to replace in paths and slugs of a session: the user, and where known the folders between home and project, written with /, - or --."""
    user, prefix = home_user(file_path)
    if not user:
        return []
    home = prefix.split("/")[1]
    own = home_user(cwd)[1]
    between = "/".join(cwd[len(own) :].removesuffix("/").split("/")[:-1]) if own and cwd[len(own) :].removesuffix("/") else ""
    out = []
    for s in ("/", "-", "--"):
        if between:
            out.append((s.join(["", home, user, between.replace("/", s), ""]), s.join(["", home, "<USER>", "<PATH>", ""])))
        out.append((s.join(["", home, user, ""]), s.join(["", home, "<USER>", ""])))
    return out


def replace_pairs(text: str, pairs: list[tuple[str, str]]) -> str:
    """One pass from the left; at a place the earlier pair wins."""
    if not pairs or not text:
        return text
    new = dict(reversed(pairs))
    return re.sub("|".join(re.escape(old) for old, _ in pairs), lambda m: new[m[0]], text)


def mask_metadata(meta: dict | None, mask: Callable[[str], str]) -> dict | None:
    """A copy of session metadata with paths, slugs, names, git fields and the places and messages of warnings masked."""
    if meta is None:
        return None
    out = json.loads(json.dumps(meta))
    source, project, git = out.get("source") or {}, out.get("project") or {}, out.get("git") or {}
    pairs = private_pairs(source.get("file_path") or "", out.get("cwd") or "")

    def both(holder: dict, key: str, paths: bool) -> None:
        if holder.get(key) is not None:
            holder[key] = mask(replace_pairs(holder[key], pairs) if paths else holder[key])

    for holder, keys in ((source, ("file_path",)), (project, ("file_path", "name")), (out, ("host_slug", "cwd"))):
        for key in keys:
            both(holder, key, True)
    for key in ("remote", "branch", "worktree", "tracking"):
        both(git, key, False)
    for warning in (out.get("diagnostics") or {}).get("warnings") or []:
        for key in ("location", "message"):
            both(warning, key, False)
    return out


_CORE = r"(?:0|[1-9][0-9]*)\.(?:0|[1-9][0-9]*)\.(?:0|[1-9][0-9]*)"
#: Fixed patterns of release titles and tags.
TITLE_PATTERN = rf"^release\((v{_CORE}(?:-rc[1-9][0-9]*)?)\): [^\r\n]+$"
TAG_PATTERN = rf"^v({_CORE})(-rc[1-9][0-9]*)?$"
