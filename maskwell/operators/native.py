"""Detection and masking as JVM expressions: no Python on the executors.

Right for few rules (each is two regular-expression passes in the plan); the full rule set runs faster in
:mod:`maskwell.operators.arrow`, which skips rules whose literals are absent. Both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwell.functions import rules as R
from maskwell.functions.dialect import portable
from maskwell.plans.policy import BUILT_IN, RENDERED, UNKNOWN_MASK, Rule

#: Filters that have an expression here. ``end`` is the number of characters before and in the match.
_SSH = next(r.pattern for r in BUILT_IN if r.id == "git_remote_ssh")


def _suffix(text: Column, end: Column) -> Column:
    return text.substr(end + 1, F.length(text))


def _filter(name: str, text: Column, m: Column) -> Column | None:
    if not name:
        return None
    if name == "no_dash":
        return ~F.contains(m["matched"], F.lit("-"))
    if name == "not_git_remote":
        return ~(F.lower(m["matched"]).startswith("git@") & F.regexp_like(_suffix(text, m["begin"]), F.lit("^(?:" + portable(_SSH) + ")")))
    if name in ("not_spaced_unix", "not_spaced_windows"):
        sep = "/" if name.endswith("unix") else r"\\"
        return ~F.regexp_like(_suffix(text, m["begin"] + F.length(m["matched"])), F.lit(f"^ [^ {sep}]*{sep}"))
    if name == "aws_context":
        return _aws_context(text, m)
    raise ValueError(f"filter {name!r} has no expression")


def _aws_context(text: Column, m: Column) -> Column:
    body = F.regexp_replace(m["matched"], r"[^A-Za-z0-9+/=](?![\s\S])", "")
    data, length = F.encode(text, "UTF-8"), m["length"]
    first = F.greatest(m["offset"] - R.AWS_WINDOW, F.lit(0))
    window = F.make_valid_utf8(data.substr(first + 1, m["offset"] + length + R.AWS_WINDOW - first).cast("string"))
    access = next(r.pattern for r in BUILT_IN if r.id == "aws_access_key")
    near = F.regexp_like(window, F.lit(portable(access)))
    for k in R.AWS_KEYWORDS:
        near = near | F.contains(F.lower(window), F.lit(k))
    return ~sequential(body) & ~F.regexp_like(body, F.lit(R.UUID_PATTERN)) & near


def sequential(s: Column) -> Column:
    """Is the sorted lower-case text a prefix of a sorted alphabet?"""
    ordered = F.array_join(F.array_sort(F.split(F.lower(s), "")), "")
    known = ["".join(sorted(set(x))) for x in ("abcdefghijklmnopqrstuvwxyz", "0123456789", R.HEX_SET.lower(), R.BASE64_SET.lower())]
    out = F.lit(False)
    for k in known:
        out = out | F.startswith(F.lit(k), ordered)
    return out


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: what a lambda closes over is worked out anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


MATCH = "struct<offset:int,rule_ord:int,length:int,rule:string,category:string,matched:string,begin:int>"
#: Matches whose places are added up in one step.
_STRIDE = 64


def _places(gaps: Column, found: Column) -> Column:
    """Per match the bytes and characters before it, packed into one number as bytes * 2**32 + characters.

    They are sums over the gaps and matches before; sums of whole strides are taken first, so that many matches in one text cost little more
    than their number.
    """
    size = lambda s: F.shiftleft(F.octet_length(s).cast("long"), 32) + F.length(s)
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    steps = F.transform(found, lambda _, i: size(F.get(gaps, i)) + F.when(i > 0, size(F.get(found, i - 1))).otherwise(F.lit(0).cast("long")))

    def add(s: Column) -> Column:
        strides = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _STRIDE).cast("int")), lambda b: total(F.slice(s, b * _STRIDE + 1, _STRIDE)))

        def place(sums: Column) -> Column:
            whole = lambda i: F.floor(i / _STRIDE).cast("int")
            return F.transform(s, lambda _, i: total(F.slice(sums, F.lit(1), whole(i))) + total(F.slice(s, whole(i) * _STRIDE + 1, i % _STRIDE + 1)))

        return let(strides, place)

    return let(steps, add)


def rule_matches(text: Column, rule: Rule, ordinal: int) -> Column:
    """Array of (offset, rule_ord, length, rule, category, matched, begin) of one rule; empty for a null text.

    There is no expression for the place of a match, so it is added up from the matches and the gaps between them.
    """
    t, p = F.coalesce(text, F.lit("")), portable(rule.pattern)
    none = F.array().cast(f"array<{MATCH}>")

    def build(found: Column) -> Column:
        def rows(places: Column) -> Column:
            return F.transform(found, lambda m, i: F.struct(
                F.shiftright(F.get(places, i), 32).cast("int").alias("offset"), F.lit(ordinal).alias("rule_ord"), F.octet_length(m).alias("length"),
                F.lit(rule.id).alias("rule"), F.lit(rule.category).alias("category"), m.alias("matched"), F.get(places, i).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("begin"),
            ))

        out = let(let(F.split(t, p, -1), lambda gaps: _places(gaps, found)), rows)
        if rule.filter:
            out = F.filter(out, lambda m: _filter(rule.filter, t, m))
        return F.when(F.size(found) > 0, out).otherwise(none)

    out = let(F.regexp_extract_all(t, F.lit(p), F.lit(0)), build)
    if not rule.anchors:
        return out
    hit = F.lit(False)
    for a in rule.anchors:
        hit = hit | F.contains(t, F.lit(a))
    return F.when(hit, out).otherwise(none)


def matches(text: Column, rules: tuple[Rule, ...]) -> Column:
    """All matches of the rules ordered by (offset, ordinal)."""
    return F.array_sort(F.flatten(F.array(*[rule_matches(text, r, i) for i, r in enumerate(rules)])))


def _mask(m: Column, rules: tuple[Rule, ...]) -> Column:
    out = F.lit(UNKNOWN_MASK)
    for r in {r.id: r for r in rules}.values():
        value = F.lit(r.replacement)
        if r.has_groups:
            value = F.regexp_replace(m["matched"], portable(r.pattern), r.replacement.replace("\\", "\\\\").replace("${", "$").replace("}", ""))
        out = F.when(m["rule"] == r.id, value).otherwise(out)
    return out


def masked(text: Column, found: Column, rules: tuple[Rule, ...]) -> Column:
    """The text with its matches masked, from the left, passing over those that begin inside an earlier one."""
    state = F.struct(F.lit(0).alias("cursor"), F.lit("").alias("out"))

    def step(a: Column, m: Column) -> Column:
        kept = text.substr(a["cursor"] + 1, m["begin"] - a["cursor"])
        taken = F.struct((m["begin"] + F.length(m["matched"])).alias("cursor"), F.concat(a["out"], kept, _mask(m, rules)).alias("out"))
        return F.when(m["begin"] < a["cursor"], a).otherwise(taken)

    return F.aggregate(found, state, step, lambda a: F.concat(a["out"], _suffix(text, a["cursor"])))


def rendered(category: Column) -> Column:
    """CREDENTIAL, PII, PATH, INTERNAL or empty."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RENDERED.items() for x in kv]), category), F.lit(""))


def charset_entropy(s: Column, charset: str) -> Column:
    """Shannon bits over the characters of the charset."""
    escaped = "".join("\\" + c if c in "-^]\\[&" else c for c in charset)

    def bits(kept: Column) -> Column:
        share = lambda c: F.size(F.filter(kept, lambda x: x == c)) / F.size(kept).cast("double")
        return F.aggregate(F.array_sort(F.array_distinct(kept)), F.lit(0.0), lambda a, c: a - let(share(c), lambda p: p * F.log2(p)))

    return let(F.filter(F.split(F.regexp_replace(s, f"[^{escaped}]", ""), ""), lambda c: c != ""), bits)


def high_entropy(word: Column) -> Column:
    """Would the entropy pass mask this word?"""
    n = F.octet_length(word)
    digits = F.regexp_like(word, F.lit(r"^[0-9]+(?![\s\S])"))
    bits = charset_entropy(word, R.HEX_SET) - F.when(digits, F.lit(1.2) / F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    skip = word.startswith("$") | F.regexp_like(word, F.lit(R.UUID_PATTERN)) | sequential(word)
    # Most words are short, and the branch keeps them from everything else.
    return F.when(n > R.ENTROPY_OVER_BYTES, ~skip & ((bits > R.HEX_LIMIT) | (charset_entropy(word, R.BASE64_SET) > R.BASE64_LIMIT))).otherwise(F.lit(False))
