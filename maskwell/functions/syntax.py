"""Identifier names by syntax tree, where a parser is installed, and the choice between two anonymizers."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from maskwell.functions.engine import Anonymizer

#: Per language the grammar's module and which nodes are names. A pair is a parent type and the field that holds the name.
GRAMMARS = {"go": "tree_sitter_go", "python": "tree_sitter_python", "typescript": "tree_sitter_typescript", "javascript": "tree_sitter_javascript", "bash": "tree_sitter_bash"}
BASH_NAMES = frozenset({("function_definition", "name"), ("variable_assignment", "name")})
BASH_EXPANSIONS = frozenset({"simple_expansion", "expansion"})


def available() -> bool:
    """Are the parser and all grammars installed?"""
    return all(importlib.util.find_spec(m) is not None for m in ("tree_sitter", *GRAMMARS.values()))


def load_parser(language: str):
    tree_sitter, grammar = importlib.import_module("tree_sitter"), importlib.import_module(GRAMMARS[language])
    make = getattr(grammar, "language_typescript", None) or grammar.language
    return tree_sitter.Parser(tree_sitter.Language(make()))


class SyntaxAnonymizer(Anonymizer):
    """Like :class:`Anonymizer`, but only nodes that are identifiers are renamed, each at its own place."""

    def __init__(self, names: dict[str, str] | None = None, parser: Callable = load_parser):
        super().__init__(names)
        self._load, self._parsers = parser, {}

    def code(self, language: str, code: str) -> str:
        if language not in GRAMMARS:
            return code
        if language not in self._parsers:
            self._parsers[language] = self._load(language)
        data = code.encode()
        found = sorted({(n.start_byte, n.end_byte) for n in self._identifiers(language, self._parsers[language].parse(data).root_node)}, reverse=True)
        for name in sorted({data[b:e].decode() for b, e in found}):
            self.names.setdefault(name, f"id{len(self.names) + 1}")
        for b, e in found:
            data = data[:b] + self.names[data[b:e].decode()].encode() + data[e:]
        return data.decode()

    @staticmethod
    def _identifiers(language: str, root):
        stack = [root]
        while stack:
            node = stack.pop()
            if language != "bash":
                if node.type == "identifier":
                    yield node
            else:
                for kind, name in BASH_NAMES:
                    if node.type == kind and (child := node.child_by_field_name(name)) is not None:
                        yield child
                if node.type in BASH_EXPANSIONS:
                    yield from (c for c in node.children if c.type == "variable_name")
            stack.extend(node.children)


class FallbackAnonymizer(Anonymizer):
    """The first anonymizer, or the second where the first raises."""

    def __init__(self, first: Anonymizer, second: Anonymizer):
        if first is None or second is None:
            raise ValueError("both anonymizers are needed")
        super().__init__()
        self.first, self.second = first, second

    def code(self, language: str, code: str) -> str:
        try:
            return self.first.code(language, code)
        except Exception:  # noqa: BLE001
            return self.second.code(language, code)
