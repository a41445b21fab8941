"""Levels, categories, rules and the validated policy that a plan is built from.

All of this runs on the driver, before any plan exists: a policy is a frozen value whose active rules are
fixed, so that a plan only holds the rules it applies.
"""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field

from maskwell.errors import ActionableError
from maskwell.functions.dialect import compiled, portable
from maskwell.functions.rules import LINE_INITIAL_BYTES, LINE_MOST_BYTES, PRIMARY

LEVELS = ("minimal", "standard", "maximum")
CATEGORIES = ("secrets", "pii", "paths", "project")
#: How a category is shown.
RENDERED = {"secrets": "CREDENTIAL", "pii": "PII", "paths": "PATH", "project": "INTERNAL"}
RENDERED_ORDER = ("CREDENTIAL", "PII", "PATH", "INTERNAL")
DEFAULT_LEVEL = {"secrets": "minimal", "paths": "minimal", "pii": "standard", "project": "standard"}
#: Fixed output values.
UNKNOWN_MASK, CODE_MASK, ENTROPY_MASK = "<REDACTED>", "<CODE_BLOCK>", "<HIGH_ENTROPY>"


def level_ordinal(level: str) -> int:
    """0, 1 or 2; -1 for anything that is no level."""
    return LEVELS.index(level) if level in LEVELS else -1


def max_level(a: str, b: str) -> str:
    """The stronger level; the first of equals."""
    return b if level_ordinal(b) > level_ordinal(a) else a


def render_category(category: str) -> str:
    """CREDENTIAL, PII, PATH or INTERNAL; empty for anything that is no category."""
    return RENDERED.get(category, "")


def validate_category(category: str) -> None:
    if category not in CATEGORIES:
        raise ActionableError(f"category {category!r} is invalid", "categories form a closed set", "maskwell.plans.policy.validate_category", "a category was checked", "nothing was classified under it", f"use one of {', '.join(CATEGORIES)}")


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    pattern: str
    replacement: str
    minimum: str = ""
    filter: str = ""
    anchors: tuple[str, ...] = ()

    @property
    def effective_minimum(self) -> str | None:
        """The level from which the rule is active; None where its metadata are invalid."""
        if self.category not in CATEGORIES or self.minimum and self.minimum not in LEVELS:
            return None
        return self.minimum or DEFAULT_LEVEL[self.category]

    def active_at(self, level: str) -> bool:
        """Invalid metadata never switch a rule off."""
        minimum = self.effective_minimum
        return minimum is None or level_ordinal(level) >= level_ordinal(minimum)

    @property
    def has_groups(self) -> bool:
        """Does the replacement refer to a group?"""
        return re.search(r"\$(?:\{|\d)", self.replacement) is not None


BUILT_IN = tuple(Rule(i, c, p, r, m, f, a) for i, c, m, p, r, f, a in PRIMARY)
MAXIMUM_ONLY = tuple(r for r in BUILT_IN if r.minimum == "maximum")


@dataclass(frozen=True)
class UserPattern:
    id: str
    category: str
    pattern: str
    replacement: str


@dataclass(frozen=True)
class XdgPaths:
    data_home: str = ""
    config_home: str = ""
    state_home: str = ""


@dataclass(frozen=True)
class ScannerConfig:
    """Line buffers of a transcript: initial and largest size in bytes."""

    initial: int = LINE_INITIAL_BYTES
    most: int = LINE_MOST_BYTES

    def validate(self, where: str) -> ScannerConfig:
        if self.initial <= 0 or self.most <= 0 or self.initial > self.most:
            raise ActionableError(f"line buffer sizes {self.initial} and {self.most} are invalid", "both must be positive and the initial one at most the largest", where, "scanner options were checked before any line was read", "no content was processed", "pass positive sizes with initial <= most")
        return self


def validate_rules(rules: tuple[Rule, ...]) -> None:
    """A rule's category must be known, and its own minimum a level no weaker than the category's."""
    for rule in rules:
        if rule.category not in CATEGORIES:
            problem = f"category {rule.category!r} is unknown"
        elif rule.minimum and rule.minimum not in LEVELS:
            problem = f"minimum level {rule.minimum!r} is unknown"
        elif rule.minimum and level_ordinal(rule.minimum) < level_ordinal(DEFAULT_LEVEL[rule.category]):
            problem = f"minimum level {rule.minimum!r} is weaker than that of category {rule.category!r}"
        else:
            continue
        raise ActionableError(f"rule {rule.id!r} has invalid activation metadata", problem, "maskwell.plans.policy.validate_rules", "a policy was built", "no policy was created", "correct the rule's category or minimum level")


def compile_user_patterns(patterns: tuple[UserPattern, ...]) -> tuple[Rule, ...]:
    where, when = "maskwell.plans.policy.compile_user_patterns", "a policy compiled user patterns before scanning content"
    out = []
    for i, p in enumerate(patterns):
        if not p.id:
            raise ActionableError(f"user pattern at index {i} has an empty id", "every pattern needs a stable id", where, when, "no policy was created", "give the pattern a unique non-empty id")
        if p.category not in CATEGORIES:
            raise ActionableError(f"user pattern {p.id!r} has invalid category {p.category!r}", "user patterns use the closed set of categories", where, when, "no policy was created", f"set the category to one of {', '.join(CATEGORIES)}")
        try:
            portable(p.pattern)
        except (re.error, OverflowError, ValueError) as e:
            raise ActionableError(f"user pattern {p.id!r} has an invalid regular expression", "the pattern is not a valid RE2 expression", where, when, "no policy was created", f"correct the expression of pattern {p.id!r}", e) from e
        out.append(Rule(p.id, p.category, p.pattern, p.replacement))
    return tuple(out)


def _quote(literal: str) -> str:
    return re.sub(r"([\\.+*?()|\[\]{}^$])", r"\\\1", literal)


def xdg_rules(xdg: XdgPaths) -> tuple[Rule, ...]:
    """Rules for base directories outside the home folders: the second segment is taken for the user."""
    out = []
    for path, name in ((xdg.data_home, "xdg_data_home"), (xdg.config_home, "xdg_config_home"), (xdg.state_home, "xdg_state_home")):
        if not path or path.startswith(("/home/", "/Users/")):
            continue
        segments = [s for s in posixpath.normpath(path).split("/") if s]
        if len(segments) < 2:
            continue
        prefix = f"/{segments[0]}/"
        out.append(Rule(name, "paths", _quote(prefix + segments[1]), prefix + "<USER>"))
    return tuple(out)


@dataclass(frozen=True)
class Policy:
    """What to mask. ``code_mode``: code anonymization at level maximum needs syntax trees; where no parser is installed building such a policy fails,
    unless 'regex' asks for the identifier patterns instead. Below maximum code is scanned like any other text."""

    level: str = "standard"
    user_patterns: tuple[UserPattern, ...] = ()
    xdg: XdgPaths = field(default_factory=XdgPaths)
    scanner: ScannerConfig = field(default_factory=ScannerConfig)
    code_mode: str = "syntax"

    def __post_init__(self):
        where = "maskwell.plans.policy.Policy"
        self.scanner.validate(where)
        if self.level not in LEVELS:
            raise ActionableError(f"masking level {self.level!r} is invalid", "only minimal, standard and maximum exist", where, "a policy was built before any content was scanned", "no policy was created, so nothing can be masked with it", "pass minimal, standard or maximum")
        validate_rules(BUILT_IN)
        user = compile_user_patterns(tuple(self.user_patterns))
        if self.code_mode not in ("syntax", "regex"):
            raise ActionableError(f"code mode {self.code_mode!r} is invalid", "only syntax and regex exist", where, "a policy was built", "no policy was created", "pass syntax or regex")
        if self.level == "maximum" and self.code_mode == "syntax" and not syntax_available():
            raise ActionableError("level maximum is unavailable here", "it anonymizes code by its syntax tree, and no parser is installed", where, "a policy checked what is installed", "no policy was created, because masking less could leak identifiers", "use level standard, install tree_sitter, or pass code_mode='regex' to accept identifier patterns")
        object.__setattr__(self, "_user_rules", user + xdg_rules(self.xdg))

    @property
    def user_rules(self) -> tuple[Rule, ...]:
        return self._user_rules

    @property
    def all_rules(self) -> tuple[Rule, ...]:
        """Built-in rules, then user and path rules: the order that breaks ties."""
        return BUILT_IN + self.user_rules

    @property
    def active_rules(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.all_rules if r.active_at(self.level))


def syntax_available() -> bool:
    from maskwell.functions.syntax import available

    return available()


def pattern_of(rule: Rule) -> re.Pattern:
    return compiled(rule.pattern)
