"""Queries of the engine's less common operators, over texts made from the tables' keys, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.errors import ActionableError
from maskwell.functions import engine
from maskwell.functions import rules as R
from maskwell.operators import arrow, native, report, sql
from maskwell.plans import oracle as O
from maskwell.plans.derived import derived, derived_sql
from maskwell.plans.policy import BUILT_IN, LEVELS, MAXIMUM_ONLY, Policy, Rule, ScannerConfig, UserPattern, XdgPaths, validate_category, validate_rules
from maskwell.sources import fixtures, transcripts
from maskwell.sources.tables import read_table

MAXIMUM = Policy("maximum", code_mode="regex")
STANDARD, MINIMAL = Policy("standard"), Policy("minimal")
USER = {
    level: Policy(level, (UserPattern("entry_number", "project", r"entry (?P<n>[[:digit:]]+) is", "entry <N> is"), UserPattern("plain_word", "secrets", r"(?i)\bPLAIN\b", "<WORD>"), UserPattern("swap", "pii", r"(end) (of)", "${2} ${1}")), XdgPaths(data_home="/data/alice/share", state_home="/srv"), code_mode="regex")
    for level in LEVELS
}
_FENCE = "concat(chr(96), chr(96), chr(96))"


def masked_maximum(spark, sf_dir):
    """The derived texts masked at level maximum: rules, then words of high entropy."""
    return derived(spark, sf_dir).select("k", arrow.masker(spark, MAXIMUM)("text").alias("masked"))


def user_rules(spark, sf_dir):
    """User patterns (of three categories, with a named class and groups) and a rule for a base directory, at two levels."""
    texts = derived(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" of /data/alice/share/"), F.col("k").cast("string")))
    return texts.select("k", *(arrow.masker(spark, USER[level])("text").alias(level) for level in ("minimal", "standard")))


def applied_matches(spark, sf_dir):
    """Matches of each derived text, and how many changed it: overlapping ones are counted but not applied."""
    c = derived(spark, sf_dir).select("k", arrow.applied_counter(spark, STANDARD)("text").alias("c"))
    return c.select("k", F.col("c.matches").cast("long").alias("n_matches"), F.col("c.applied").cast("long").alias("n_applied"))


def residue_previews(spark, sf_dir):
    """All warnings of all residue rules as they are shown, with their masked previews."""
    w = derived(spark, sf_dir, "customer", "c_custkey").select("k", F.explode(arrow.residue_scanner(spark)("text")).alias("w"))
    shown = F.concat(F.lit("[residue:"), "w.rule_id", F.lit(" at "), F.col("w.location").cast("string"), F.lit("] "), "w.preview")
    return w.select("k", shown.alias("warning"))


def residue_after_masking(spark, sf_dir):
    """Warnings with previews that remain after masking at level standard."""
    r = derived(spark, sf_dir, "customer", "c_custkey").select("k", arrow.pipeline(spark, STANDARD)("text").alias("r"))
    return r.select("k", F.explode("r.warnings").alias("w")).select("k", "w.rule_id", F.col("w.location").cast("long").alias("location"), "w.preview")


def fallback_masked(spark, sf_dir):
    """Texts with a code fence as the fallback masks them: no filters, all levels, code hidden."""
    fenced = F.expr(f"concat(text, chr(10), {_FENCE}, 'py', chr(10), 'secret = ', CAST(k AS string), chr(10), {_FENCE}, chr(10), 'tail ', CAST(k AS string))")
    return derived(spark, sf_dir, "customer", "c_custkey").select("k", arrow.fallback_masker(spark, USER["minimal"])(fenced).alias("masked"))


_LINES = {
    0: r"""concat('{"m": "u', CAST(user_id AS string), '@example.org", "n": 12345678901234567890}', chr(13))""",
    1: "''",
    2: "concat('not json u', CAST(user_id AS string), '@example.org')",
    3: r"""concat('["u', CAST(user_id AS string), '@example.org", {"k@example.org": "10.0.0.1"}] tail u2@example.org')""",
    4: r"""concat('{"b": 1.50, "a": "', chr(92), 'ud800 ', chr(92), 'u00e9 u', CAST(user_id AS string), '@example.org", "b": null}')""",
    5: r"""concat('"<b> & u', CAST(user_id AS string), '@example.org"')""",
    6: "concat('{\"open\": \"u', CAST(user_id AS string), '@example.org')",
    7: "CASE WHEN event_id % 176 = 7 THEN concat('\"', repeat('x', 150), '\"') ELSE '[true, 1e400]' END",
}


def transcript_lines(spark, sf_dir):
    """Lines of transcripts of a line size below 120 bytes: returns, blank and broken lines, trailing text, half surrogates, repeated keys. A file with a longer line stays as it is."""
    case = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {text}" for i, text in _LINES.items()) + " END"
    raw = read_table(spark, sf_dir, "events").select(F.expr("concat('f', CAST(event_id % 11 AS string))").alias("file"), F.col("event_id").alias("line_no"), F.expr(case).alias("value"))
    lines = raw.select("file", "line_no", transcripts.without_return(F.col("value")).alias("line"))
    return transcripts.mask_lines(lines, STANDARD, most=120).select("line_no", "line", "too_long")


def json_documents(spark, sf_dir):
    """Whole JSON documents over several lines; one that is no JSON stays as it is."""
    text = F.expr("""concat(CASE WHEN event_id % 5 = 0 THEN '{broken ' ELSE '' END, '{', chr(10), '  "user": "u', CAST(user_id AS string), '@example.org",', chr(10), '  "ids": [', CAST(event_id AS string), ', 1.0]', chr(10), '}', chr(10))""")
    docs = read_table(spark, sf_dir, "events").select("event_id", text.alias("document"))
    return transcripts.mask_documents(docs, STANDARD)


_TURNS = {
    0: "concat('<system-reminder>hidden ', k, '</system-reminder> <user_query>mail u', k, '@example.org</user_query>')",
    1: "concat('<user_query>open ', k)",
    2: "concat('<user_query>a <system-reminder>', k, '</system-reminder></user_query>')",
    3: "concat('<user_query>a <system-reminder>', k, '</user_query></system-reminder>')",
    4: "concat('Fix /home/ann/dev/app/src/f', k, '.py (and /home/ann/dev/app) now')",
    5: "concat('See C:', chr(92), 'Users', chr(92), 'ann', chr(92), 'x', k, '.txt and /Users/Ann Lee/y', k)",
    6: "concat('  plain ', k, '  ')",
    7: "concat('read /home/ann/dev/application/', k, ' or /home/ann/priv/', k, ', then mail u', k, '@example.org about module github.com/acme/x', k)",
}


def title_cases(spark, sf_dir):
    """Titles generated, sanitized and simple from eight shapes of turns, with their categories and the first line of the error of malformed ones."""
    case = "CASE CAST(k AS bigint) % 8 " + " ".join(f"WHEN {i} THEN {text}" for i, text in _TURNS.items()) + " END"
    turns = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k")).withColumn("turn", F.expr(case))
    project = "/home/ann/dev/app"
    made = {mode: arrow.title_maker(spark, mode, "claude-code", project)("turn") for mode in ("generate", "sanitize", "simple")}
    out = turns.select("k", *(c.alias(mode) for mode, c in made.items()))
    shown = [F.coalesce(F.concat(F.col(f"{m}.text"), F.lit("|"), F.array_join(f"{m}.categories", ",")), F.regexp_extract(f"{m}.error", "wrapper (.*)", 1)).alias(m) for m in made]
    return out.select("k", *shown)


_CODE = {
    0: ("golang", "go", "func total() { var a = helper(total, x1) }", "func id2() { var a = id1(id2, x1) }"),
    1: ("ts", "typescript", "const total = helper(total) as string", "const id2 = id1(id2) as string"),
    2: ("js", "javascript", "function total() { return helper.map(total) }", "function id2() { return id1.map(id2) }"),
    3: ("zsh", "bash", "export total=$helper; echo $total", "export id2=$id1; echo $id2"),
    4: ("py3", "", "total = helper(total)", ""),
    5: ("", "", "total = helper(total)", ""),
    6: ("python3", "python", "def total(self): return helper(total)", "def id2(self): return id1(id2)"),
}


def code_languages(spark, sf_dir):
    """Code in fences of all languages anonymized, each text by itself; languages that are not known stay."""
    case = "CASE k % 7 " + " ".join(f"WHEN {i} THEN concat({_FENCE}, '{hint}', chr(10), replace({O.lit(code)}, 'total', concat('total_', CAST(k % 50 AS string))), chr(10), {_FENCE})" for i, (hint, _, code, _) in _CODE.items()) + " END"
    texts = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).withColumn("text", F.expr(f"concat('see ', {case}, ' done ', CAST(k AS string))"))
    return texts.select("k", arrow.code_anonymizer(spark)("text").alias("text"))


def entropy_prefilters(spark, sf_dir):
    """Long words of six shapes and whether each would be masked: runs of an alphabet, variables, identifiers, digits, hexadecimal, mixed."""
    shapes = ["substr('abcdefghijklmnopqrstuvwxyz', 1, CAST(20 + k % 7 AS int))", "concat('$', h, upper(g))", "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(g, 1, 4), '-', substr(g, 5, 4), '-', substr(g, 9, 12))", "concat(CAST(k * 7919 AS string), '00000000000000000001', CAST(k AS string))", "h", "concat(substr(h, 1, 10), upper(substr(g, 1, 12)), 'XyZ+/')", "repeat('ab', 15)"]
    word = "CASE k % 7 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(shapes)) + " END"
    keys = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.expr("md5(CAST(c_custkey AS string))").alias("h"), F.expr("md5(concat('x', CAST(c_custkey AS string)))").alias("g"))
    return keys.select("k", F.expr(word).alias("word")).select("k", "word", native.high_entropy(F.col("word")).alias("high"), (arrow.entropy_masker(spark)("word") == "<HIGH_ENTROPY>").alias("masked"))


#: White space as the entropy pass sees it.
_WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def documents_detected(spark, sf_dir):
    """Matches of all rules in all whole documents."""
    found = arrow.match_table(read_table(spark, sf_dir, "documents"), "text", ["doc_id"], MAXIMUM)
    return found.select("doc_id", "rule", F.col("offset").cast("long").alias("byte_offset"), F.col("length").cast("long").alias("byte_length"))


def documents_masked_standard(spark, sf_dir):
    """All whole documents masked at level standard."""
    return read_table(spark, sf_dir, "documents").select("doc_id", arrow.masker(spark, STANDARD)("text").alias("masked"))


def documents_masked_maximum(spark, sf_dir):
    """All whole documents masked at level maximum. No SQL: the words of high entropy are replaced where they stand, between any white space."""
    return read_table(spark, sf_dir, "documents").select("doc_id", arrow.masker(spark, MAXIMUM)("text").alias("masked"))


def documents_residue(spark, sf_dir):
    """Warnings per residue rule over all whole documents."""
    return report.warning_counts(read_table(spark, sf_dir, "documents").select(arrow.residue_scanner(spark, previews=False)("text").alias("warnings")))


def documents_entropy(spark, sf_dir):
    """Words of all whole documents that the entropy pass would mask; expressions only."""
    words = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", native.portable(_WHITE))).alias("word"))
    return words.filter(native.high_entropy(F.col("word")))


def fixture_cases(spark, sf_dir):
    """The package's own cases with what each expects and whether its rule fires."""
    fired = F.exists(arrow.detector(spark, MAXIMUM)("input"), lambda m: m["rule"] == F.col("rule"))
    return fixtures.built_in_cases(spark).select("name", "expect", fired.alias("fired"))


def detect_table_function(spark, sf_dir):
    """Matches from the table function, called laterally."""
    name = sql.register_table_function(spark, STANDARD)
    return spark.sql(f"SELECT k, d.rule, d.category, d.byte_offset, d.byte_length FROM {{t}}, LATERAL {name}(text) AS d", t=derived(spark, sf_dir, "customer", "c_custkey"))


def unknown_rules(spark, sf_dir):
    """Counts by rule and category of matches of which every third is of a rule that is not known: it counts as a secret."""
    found = arrow.match_table(derived(spark, sf_dir), "text", ["k"], STANDARD)
    odd = F.col("k") % 3 == 0
    return report.rule_counts(found.withColumn("category", F.when(~odd, F.col("category"))).withColumn("rule", F.when(odd, "other").otherwise(F.col("rule"))))


def _refused(make) -> str:
    try:
        make()
    except ActionableError as e:
        lines = str(e).split("\n")
        return ",".join(x.partition(":")[0] for x in lines)
    return "accepted"


_CHECKS = {
    "level": (lambda: Policy("strict"), False), "maximum_without_parser": (lambda: engine.new_anonymizer(MAXIMUM), True),
    "empty_id": (lambda: Policy("minimal", (UserPattern("", "pii", "a", "b"),)), False), "bad_category": (lambda: Policy("minimal", (UserPattern("x", "people", "a", "b"),)), False),
    "bad_pattern": (lambda: Policy("minimal", (UserPattern("x", "pii", "a(", "b"),)), False), "look_ahead": (lambda: Policy("minimal", (UserPattern("x", "pii", "a(?=b)", "b"),)), False),
    "properties": (lambda: Policy("minimal", (UserPattern("x", "pii", r"\p{Greek}+[[:alpha:]]\Q*\E(?U)a+", "b"),)), True), "repeated_ids": (lambda: Policy("minimal", (UserPattern("x", "pii", "a", "b"), UserPattern("x", "pii", "c", "d"))), True),
    "buffer_zero": (lambda: ScannerConfig(0, 10).validate("x"), False), "buffer_negative": (lambda: ScannerConfig(10, -1).validate("x"), False), "buffer_order": (lambda: ScannerConfig(11, 10).validate("x"), False), "buffer": (lambda: ScannerConfig(10, 10).validate("x"), True),
    "weak_rule": (lambda: validate_rules((Rule("x", "pii", "a", "b", "minimal"),)), False), "strict_rule": (lambda: validate_rules((Rule("x", "pii", "a", "b", "maximum"),)), True), "rule_category": (lambda: validate_rules((Rule("x", "people", "a", "b"),)), False),
    "category": (lambda: validate_category("people"), False), "known_category": (lambda: validate_category("pii"), True),
}


def policy_checks(spark, sf_dir):
    """What a policy refuses, and the parts that its error tells."""
    rows = [(name, _refused(make)) for name, (make, _) in _CHECKS.items()]
    return spark.createDataFrame(rows, "name string, parts string")


QUERIES = {f.__name__: f for f in (masked_maximum, user_rules, applied_matches, residue_previews, residue_after_masking, fallback_masked, transcript_lines, json_documents, title_cases, code_languages, entropy_prefilters, fixture_cases, detect_table_function, unknown_rules, policy_checks, documents_detected, documents_masked_standard, documents_masked_maximum, documents_residue, documents_entropy)}


def sql_texts(high: str, space: str) -> dict[str, str]:
    """SQL of the queries; ``high`` is the test of a column ``word``, ``space`` a class of white space."""
    of_orders, customers = (f"SELECT k, text AS t FROM ({x})" for x in (derived_sql(), derived_sql("customer", "c_custkey")))
    of = lambda rules, source: f"SELECT k, a.r || substr(t, a.b + 1) AS masked, a.c AS n_applied, n FROM ({O.masked(rules, source, 'k')})"
    split = lambda source: f"SELECT k, string_agg(CASE WHEN {high} THEN '<HIGH_ENTROPY>' ELSE word END, ' ' ORDER BY i) AS masked FROM (SELECT k, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM (SELECT k, string_split(masked, ' ') AS w FROM ({source}))) GROUP BY k"
    every = (*MAXIMUM_ONLY, *(r for r in BUILT_IN if r.minimum != "maximum"))
    more = f"SELECT k, text || ' of /data/alice/share/' || CAST(k AS VARCHAR) AS t FROM ({derived_sql()})"
    users = {level: tuple(Rule(r.id, r.category, r.pattern.replace("(?P<n>", "("), r.replacement) if r.id == "entry_number" else r for r in USER[level].active_rules) for level in LEVELS}

    residue = tuple(Rule(i, "secrets", p, "") for i, p in R.RESIDUE)
    # The texts are ASCII, so bytes are characters.
    wide = "greatest(0, least(greatest(0, o - 80), strlen(t) - 160))"
    shown = f"SELECT k, rule, o, {O.chain(every, f'substr(t, {wide} + 1, 160)')} AS x, o - {wide} AS place FROM"
    preview = "substr(x, greatest(0, least(greatest(0, place - 20), length(x) - 40)) + 1, 40)"
    warnings = lambda source: f"SELECT k, rule, o, {preview} AS preview FROM ({shown} (SELECT f.*, s.t FROM ({O.matches(residue, source, 'k')}) f JOIN ({source}) s ON f.k = s.k))"
    user_chain = O.chain(tuple(USER["minimal"].user_rules[1:]), "x").replace("(?P<n>", "(")
    hidden = O.chain(every, "regexp_replace(t, '(?s)\\n[ \\t]*`{3,}[^\\n]*\\n.*?\\n[ \\t]*`{3,}[ \\t]*(?:\\n|$)', '<CODE_BLOCK>', 'g')")
    first_user = O.chain((Rule("n", "project", "entry ([[:digit:]]+) is", "entry <N> is"),), "x")
    fenced = f"SELECT k, text || chr(10) || {_FENCE} || 'py' || chr(10) || 'secret = ' || CAST(k AS VARCHAR) || chr(10) || {_FENCE} || chr(10) || 'tail ' || CAST(k AS VARCHAR) AS t FROM ({derived_sql('customer', 'c_custkey')})"
    spent = f"SELECT k, {user_chain} AS masked FROM (SELECT k, {first_user} AS x FROM (SELECT k, {hidden} AS x FROM ({fenced})))"

    mail = "'\\u003cEMAIL\\u003e'"
    line = {
        0: f"""'{{"m":"' || {mail} || '","n":12345678901234567890}}'""", 1: "''", 2: "v", 3: f"""'["' || {mail} || '",{{"k@example.org":"\\u003cIP_ADDRESS\\u003e"}}]'""",
        4: f"""'{{"a":"' || chr(65533) || ' ' || chr(233) || ' ' || {mail} || '","b":null}}'""", 5: f"""'"\\u003cb\\u003e \\u0026 ' || {mail} || '"'""", 6: "v", 7: "CASE WHEN contains(v, 'x') THEN v ELSE '[true,1e400]' END",
    }
    raw = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in _LINES.items()) + " END"
    lines = f"SELECT event_id, event_id % 11 AS f, regexp_replace({raw}, '\\r$', '') AS v FROM events"

    turn = "CASE CAST(k AS BIGINT) % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in _TURNS.items()) + " END"
    mails = lambda x: f"regexp_replace({x}, '[a-z0-9]+@example[.]org', '<EMAIL>', 'g')"
    paths = "regexp_replace(regexp_replace(regexp_replace(turn, '/home/ann/dev/app([) /])', '/home/<USER>/<PATH>/app\\1', 'g'), '/home/ann/[^ ]*', '/home/<USER>/<PATH>', 'g'), '(Users.)(?:ann|Ann Lee)[\\\\/][^ ]*', '\\1<USER>' || CASE WHEN true THEN '|' END || '<PATH>', 'g')"
    paths = f"replace(regexp_replace({paths}, '(\\\\Users.<USER>)[|]', '\\1' || chr(92) || chr(92), 'g'), '>|<', '>/<')"
    capped = lambda x: f"(SELECT CASE WHEN length(y) <= 80 THEN rtrim(y) WHEN regexp_matches(substr(y, 1, 80), '{space}') THEN rtrim(regexp_extract(substr(y, 1, 80), '(?s)^(.*){space}', 1)) ELSE substr(y, 1, 80) END FROM (SELECT {x} AS y))"
    clean = "regexp_replace(regexp_replace(turn, '<system-reminder>.*</system-reminder>', ''), '</?user_query>', '', 'g')"
    module = "regexp_replace({x}, 'module github[.]com/acme/[a-z0-9]+', 'module <GO_MODULE>')"
    both = module.format(x=mails(paths))
    kinds = f"SELECT k, CAST(k AS BIGINT) % 8 AS kind, {turn} AS turn FROM (SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer)"
    wrong = """CASE kind WHEN 1 THEN '"user_query" is unbalanced' WHEN 2 THEN '"system-reminder" is nested' ELSE '"user_query" is crossed' END"""
    categories = "CASE WHEN kind IN (0) THEN 'PII' WHEN kind IN (4, 5) THEN 'PATH' WHEN kind = 7 THEN 'PII,PATH,INTERNAL' ELSE '' END"
    sanitized = f"CASE WHEN kind = 6 THEN turn ELSE {capped(both)} END || '|' || {categories}"

    code = "CASE k % 7 " + " ".join(
        f"WHEN {i} THEN " + (f"{_FENCE} || '{lang}' || chr(10) || {O.lit(new)}" if lang else f"{_FENCE} || '{hint}' || chr(10) || replace({O.lit(text)}, 'total', 'total_' || CAST(k % 50 AS VARCHAR))")
        for i, (hint, lang, text, new) in _CODE.items()
    ) + " END"
    shapes = ["substr('abcdefghijklmnopqrstuvwxyz', 1, CAST(20 + k % 7 AS INT))", "'$' || h || upper(g)", "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(g, 1, 4) || '-' || substr(g, 5, 4) || '-' || substr(g, 9, 12)", "CAST(k * 7919 AS VARCHAR) || '00000000000000000001' || CAST(k AS VARCHAR)", "h", "substr(h, 1, 10) || upper(substr(g, 1, 12)) || 'XyZ+/'", "repeat('ab', 15)"]
    word = "CASE k % 7 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(shapes)) + " END"
    # One line of the YAML is one case.
    parts = re.findall(r"^- \{name: (\w+), input: '((?:[^']|'')*)', rule: (\w+), expect: (\w+),", fixtures.built_in_text(), re.M)
    listed = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{t}', '{r}', '{e}')" for n, t, r, e in parts) + ") AS c(name, t, rule, expect)"
    found = f"({O.matches(STANDARD.active_rules, of_orders, 'k')})"
    docs = "SELECT doc_id, text AS t FROM documents"
    return {
        "documents_detected": f"SELECT doc_id, rule, o AS byte_offset, n AS byte_length FROM ({O.matches(MAXIMUM.active_rules, docs, 'doc_id')})",
        "documents_masked_standard": f"SELECT doc_id, a.r || substr(t, a.b + 1) AS masked FROM ({O.masked(STANDARD.active_rules, docs, 'doc_id')})",
        "documents_residue": "SELECT rule_id, n FROM (" + " UNION ALL ".join(f"SELECT {O.lit(i)} AS rule_id, CAST(sum(len(regexp_extract_all(text, {O.lit(p)}))) AS BIGINT) AS n FROM documents" for i, p in R.RESIDUE) + ") WHERE n > 0",
        "documents_entropy": f"SELECT doc_id, word FROM (SELECT doc_id, unnest(string_split_regex(text, {O.lit(_WHITE)})) AS word FROM documents) WHERE {high}",
        "masked_maximum": split(of(MAXIMUM.active_rules, of_orders)),
        "user_rules": f"SELECT a.k, a.masked AS minimal, b.masked AS standard FROM ({of(users['minimal'], more)}) a JOIN ({of(users['standard'], more)}) b ON a.k = b.k",
        "applied_matches": f"SELECT k, n AS n_matches, CAST(n_applied AS BIGINT) AS n_applied FROM ({of(STANDARD.active_rules, of_orders)})",
        "residue_previews": f"SELECT k, '[residue:' || rule || ' at ' || CAST(o AS VARCHAR) || '] ' || preview AS warning FROM ({warnings(customers)})",
        "residue_after_masking": f"SELECT k, rule AS rule_id, o AS location, preview FROM ({warnings(f'SELECT k, masked AS t FROM ({of(STANDARD.active_rules, customers)})')})",
        "fallback_masked": split(spent),
        "transcript_lines": f"SELECT event_id AS line_no, CASE WHEN too_long THEN v ELSE CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in line.items()) + f" END END AS line, too_long FROM (SELECT *, bool_or(strlen(v) >= 120) OVER (PARTITION BY f) AS too_long FROM ({lines}))",
        "json_documents": """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{broken {' || chr(10) || '  "user": "u' || CAST(user_id AS VARCHAR) || '@example.org",' || chr(10) || '  "ids": [' || CAST(event_id AS VARCHAR) || ', 1.0]' || chr(10) || '}' || chr(10) ELSE '{"ids":[' || CAST(event_id AS VARCHAR) || ',1.0],"user":"\\u003cEMAIL\\u003e"}' END AS document FROM events""",
        "title_cases": f"SELECT k, CASE WHEN kind IN (1, 2, 3) THEN {wrong} WHEN kind = 0 THEN {mails(f'trim({clean})')} || '|PII' WHEN kind = 6 THEN trim(turn) || '|' ELSE {capped(both)} || '|' || {categories} END AS generate, {sanitized} AS sanitize, CASE WHEN kind IN (1, 2, 3) THEN {wrong} WHEN kind = 0 THEN trim({clean}) || '|' ELSE {capped('trim(turn)')} || '|' END AS simple FROM ({kinds})",
        "code_languages": f"SELECT k, 'see ' || {code} || chr(10) || {_FENCE} || ' done ' || CAST(k AS VARCHAR) AS text FROM (SELECT o_orderkey AS k FROM orders)",
        "entropy_prefilters": f"SELECT k, word, {high} AS high, {high} AS masked FROM (SELECT k, {word} AS word FROM (SELECT c_custkey AS k, md5(CAST(c_custkey AS VARCHAR)) AS h, md5('x' || CAST(c_custkey AS VARCHAR)) AS g FROM customer))",
        "fixture_cases": f"SELECT c.name, c.expect, EXISTS (SELECT 1 FROM ({O.matches(BUILT_IN, listed, 'name')}) m WHERE m.name = c.name AND m.rule = c.rule) AS fired FROM ({listed}) c",
        "detect_table_function": f"SELECT k, rule, category, o AS byte_offset, n AS byte_length FROM ({O.matches(STANDARD.active_rules, customers, 'k')})",
        "unknown_rules": f"SELECT CASE WHEN k % 3 = 0 THEN 'other' ELSE rule END AS rule, CASE WHEN k % 3 = 0 THEN 'secrets' ELSE category END AS category, count(*) AS n FROM {found} GROUP BY ALL",
        "policy_checks": " UNION ALL ".join(f"SELECT '{name}' AS name, '{'accepted' if good else 'what,why,where,when,means,fix' + ',cause' * (name in ('bad_pattern', 'look_ahead'))}' AS parts" for name, (_, good) in _CHECKS.items()),
    }
