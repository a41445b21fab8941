"""SQL texts for the oracle, built from the rule tables."""

from __future__ import annotations

import re

from maskwell.functions import rules as R
from maskwell.plans.policy import RENDERED, Rule


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _keep(rule: Rule) -> str:
    """The rule's filter on x: matched m, text t, character offset b and byte offset o."""
    suffix = "substr(t, b + length(m) + 1)"
    access = next(p for i, _, _, p, *_ in R.PRIMARY if i == "aws_access_key")
    ssh = next(p for i, _, _, p, *_ in R.PRIMARY if i == "git_remote_ssh")
    if rule.filter == "no_dash":
        return "NOT contains(m, '-')"
    if rule.filter == "not_git_remote":
        return f"NOT (starts_with(lower(m), 'git@') AND regexp_matches(substr(t, b + 1), {lit('^(?:' + ssh + ')')}))"
    if rule.filter == "not_spaced_unix":
        return f"NOT regexp_matches({suffix}, '^ [^ /]*/')"
    if rule.filter == "not_spaced_windows":
        return rf"NOT regexp_matches({suffix}, '^ [^ \\]*\\')"
    if rule.filter == "aws_context":
        # Texts are ASCII here, so characters are bytes.
        window = f"substr(t, greatest(b - {R.AWS_WINDOW}, 0) + 1, length(m) + least(b, {R.AWS_WINDOW}) + {R.AWS_WINDOW})"
        words = " OR ".join(f"contains(lower({window}), {lit(k)})" for k in R.AWS_KEYWORDS)
        return f"({words} OR regexp_matches({window}, {lit(access)}))"
    return "true"


def matches(rules: tuple[Rule, ...], source: str, key: str, extra: str = "") -> str:
    """SELECT of the key, rule, rule_ord, category, m (matched), b (characters before), o (bytes before), n (bytes); ``source`` selects the key and ``t``."""
    parts = []
    for i, r in enumerate(rules):
        p = lit(r.pattern)
        split = f"SELECT {key}{extra}, t, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS gs FROM src WHERE regexp_matches(t, {p})"
        each = f"SELECT {key}{extra}, t, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM ({split})"
        placed = f"SELECT {key}{extra}, t, ms[i] AS m, array_to_string(gs[1:i], '') || array_to_string(ms[1:i - 1], '') AS pre FROM ({each})"
        full = f"SELECT {key}{extra}, t, m, length(pre) AS b, strlen(pre) AS o, strlen(m) AS n FROM ({placed})"
        parts.append(f"SELECT {key}{extra}, {lit(r.id)} AS rule, {i} AS rule_ord, {lit(r.category)} AS category, m, b, o, n FROM ({full}) WHERE {_keep(r)}")
    return f"WITH src AS ({source}) " + " UNION ALL ".join(parts)


def _template(rule: Rule) -> str:
    return re.sub(r"\$\{(\d)\}", r"\\\1", rule.replacement.replace("\\", "\\\\"))


def chain(rules: tuple[Rule, ...], text: str) -> str:
    """SQL of a text with every match of the rules replaced, rule by rule."""
    for r in rules:
        text = f"regexp_replace({text}, {lit(r.pattern)}, {lit(_template(r))}, 'g')"
    return text


def mask_value(rules: tuple[Rule, ...]) -> str:
    cases = []
    for r in rules:
        if r.has_groups:
            cases.append(f"WHEN {lit(r.id)} THEN regexp_replace(m, {lit(r.pattern)}, {lit(_template(r))})")
        else:
            cases.append(f"WHEN {lit(r.id)} THEN {lit(r.replacement)}")
    return f"CASE rule {' '.join(cases)} END"


def masked(rules: tuple[Rule, ...], source: str, key: str) -> str:
    """SELECT of the key, a, n (matches) and t of every row of ``source``: a.r is the text masked up to character a.b, a.c the matches that changed it."""
    found = matches(rules, source, key)
    return (
        f"WITH s AS ({source}), f AS ({found}), v AS (SELECT {key}, rule_ord, b, length(m) AS c, {mask_value(rules)} AS r FROM f), "
        f"l AS (SELECT {key}, list({{'b': b, 'c': c, 'r': r}} ORDER BY b, rule_ord) AS ms FROM v GROUP BY {key}), "
        f"j AS (SELECT s.{key}, t, coalesce(ms, []) AS ms FROM s LEFT JOIN l ON s.{key} = l.{key}) "
        f"SELECT {key}, list_reduce(list_prepend({{'b': 0, 'c': 0, 'r': ''}}, ms), lambda a, x: CASE WHEN x.b < a.b THEN a ELSE "
        f"{{'b': x.b + x.c, 'c': a.c + CASE WHEN x.r <> substr(t, x.b + 1, x.c) THEN 1 ELSE 0 END, 'r': a.r || substr(t, a.b + 1, x.b - a.b) || x.r}} END) AS a, len(ms) AS n, t FROM j"
    )


def rendered(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in RENDERED.items()) + " ELSE '' END"
