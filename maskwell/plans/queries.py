"""The engine's queries over the driver's tables, each with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions import rules as R
from maskwell.functions.documents import TAG_PATTERN, TITLE_PATTERN
from maskwell.operators import arrow, metadata, native, report
from maskwell.plans import cases
from maskwell.plans import oracle as O
from maskwell.plans.derived import derived, derived_sql
from maskwell.plans.policy import BUILT_IN, CATEGORIES, LEVELS, Policy, level_ordinal
from maskwell.sources.tables import read_table, stream_table
from maskwell.streaming import streams

PII = tuple(r for r in BUILT_IN if r.category == "pii")
STANDARD = Policy("standard").active_rules
_P = {"minimal": Policy("minimal"), "standard": Policy("standard"), "maximum": Policy("maximum", code_mode="regex")}
_DOCS = "SELECT doc_id, text AS t FROM documents"
_DERIVED = f"SELECT k, text AS t FROM ({derived_sql()})"


def masked_documents(spark, sf_dir):
    """PII masked in all documents by expressions alone, and how many matches each had."""
    docs = read_table(spark, sf_dir, "documents").withColumn("m", native.matches(F.col("text"), PII))
    return docs.select("doc_id", native.masked(F.col("text"), F.col("m"), PII).alias("masked"), F.size("m").cast("long").alias("n_matches"))


def pii_match_table(spark, sf_dir):
    """Every PII match of the documents with its byte offset and length; expressions only."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(native.matches(F.col("text"), PII)).alias("m"))
    return docs.select("doc_id", F.col("m.rule").alias("rule"), F.col("m.offset").cast("long").alias("byte_offset"), F.col("m.length").cast("long").alias("byte_length"))


def detect_all_rules(spark, sf_dir):
    """All 56 rules over the derived texts through Arrow batches."""
    found = arrow.match_table(derived(spark, sf_dir), "text", ["k"], _P["maximum"])
    return found.select("k", "rule", F.col("offset").cast("long").alias("byte_offset"), F.col("length").cast("long").alias("byte_length"))


def detect_all_rules_native(spark, sf_dir):
    """The same rows from expressions."""
    found = derived(spark, sf_dir).select("k", F.explode(native.matches(F.col("text"), BUILT_IN)).alias("m"))
    return found.select("k", F.col("m.rule").alias("rule"), F.col("m.offset").cast("long").alias("byte_offset"), F.col("m.length").cast("long").alias("byte_length"))


def _masked_at(level):
    def query(spark, sf_dir):
        texts = derived(spark, sf_dir)
        return texts.select("k", arrow.masker(spark, _P[level])(F.col("text")).alias("masked"))

    query.__doc__ = f"The derived texts masked at level {level}."
    return query


def report_by_rule(spark, sf_dir):
    """Matches per rule and category of the derived texts at level standard."""
    found = arrow.match_table(derived(spark, sf_dir), "text", ["k"], _P["standard"])
    return report.rule_counts(found).select("rule", native.rendered(F.col("category")).alias("category"), "n")


def report_totals(spark, sf_dir):
    """One row: total, number of rules that fired, rendered categories."""
    out = report.report(arrow.match_table(derived(spark, sf_dir), "text", ["k"], _P["standard"]))
    return out.select("total", F.size("counts").cast("long").alias("n_rules"), F.array_join("categories", ",").alias("categories"))


def level_matrix(spark, sf_dir):
    """Matches per level and category: one detection at level maximum, each rule counted for the levels it is active at."""
    counts = report.rule_counts(arrow.match_table(derived(spark, sf_dir), "text", ["k"], _P["maximum"]))
    levels = F.lit(None).cast("array<string>")
    for level in LEVELS:
        active = [r.id for r in BUILT_IN if r.effective_minimum == level]
        levels = F.when(F.col("rule").isin(active), F.array(*[F.lit(x) for x in LEVELS[LEVELS.index(level) :]])).otherwise(levels)
    return counts.withColumn("level", F.explode(levels)).groupBy("level", "category").agg(F.sum("n").alias("n"))


def hits_by_lang(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("lang", F.explode(native.matches(F.col("text"), PII)).alias("m"))
    return docs.groupBy("lang", F.col("m.rule").alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def top_sources_by_hits(spark, sf_dir):
    """The five sources with the most PII matches."""
    docs = read_table(spark, sf_dir, "documents").select("source", F.size(native.matches(F.col("text"), PII)).alias("n"))
    return docs.groupBy("source").agg(F.sum("n").cast("long").alias("hits")).orderBy(F.desc("hits"), "source").limit(5)


def documents_without_hits(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.filter(F.size(native.matches(F.col("text"), PII)) == 0).select("doc_id")


def credit_card_filter(spark, sf_dir):
    """Card matches before and after the dash filter."""
    rule = next(r for r in PII if r.id == "credit_card")
    raw = F.size(F.regexp_extract_all("text", F.lit(native.portable(rule.pattern)), F.lit(0)))
    kept = F.size(native.matches(F.col("text"), (rule,)))
    return derived(spark, sf_dir).agg(F.sum(raw).cast("long").alias("raw"), F.sum(kept).cast("long").alias("kept"))


def aws_context_filter(spark, sf_dir):
    """40-character keys that have AWS context within 200 bytes."""
    rule = next(r for r in BUILT_IN if r.id == "aws_secret_key")
    return derived(spark, sf_dir).select("k", F.explode(native.matches(F.col("text"), (rule,))).alias("m")).select("k", F.col("m.offset").cast("long").alias("byte_offset"))


def home_path_filter(spark, sf_dir):
    """Home paths, single and spaced, with the filter that leaves the first words of spaced names to the other rule."""
    rules = tuple(r for r in BUILT_IN if r.id.endswith(("home_path", "home_path_spaced")))
    return derived(spark, sf_dir).select("k", F.explode(native.matches(F.col("text"), rules)).alias("m")).select("k", F.col("m.rule").alias("rule"), F.col("m.matched").alias("matched"))


def residue_counts(spark, sf_dir):
    """Warnings per residue rule over the unmasked derived texts."""
    scanned = derived(spark, sf_dir).select(arrow.residue_scanner(spark, previews=False)(F.col("text")).alias("warnings"))
    return report.warning_counts(scanned)


def residue_locations(spark, sf_dir):
    """Place of each warning of all residue rules."""
    scanned = derived(spark, sf_dir).select("k", F.explode(arrow.residue_scanner(spark, previews=False)(F.col("text"))).alias("w"))
    return scanned.select("k", F.col("w.rule_id").alias("rule_id"), F.col("w.location").cast("long").alias("location"))


def entropy_words(spark, sf_dir):
    """Words of the derived texts that the entropy pass would mask; expressions only."""
    word = derived(spark, sf_dir).select("k", F.explode(F.split("text", " ")).alias("word"))
    return word.filter(native.high_entropy(F.col("word")))


def entropy_masked(spark, sf_dir):
    return derived(spark, sf_dir).select("k", arrow.entropy_masker(spark)(F.col("text")).alias("masked"))


def rule_activation(spark, sf_dir):
    """Rules active per level and category."""
    rows = [(level, c, sum(r.category == c and r.active_at(level) for r in BUILT_IN)) for level in LEVELS for c in CATEGORIES]
    return spark.createDataFrame(rows, "level string, category string, n long")


def rule_set_version(spark, sf_dir):
    return spark.createDataFrame([(R.RULE_SET_VERSION, len(BUILT_IN), len(R.RESIDUE))], "version string, n_rules long, n_residue long")


def json_values(spark, sf_dir):
    """String values of JSON masked, keys and numbers untouched, keys sorted."""
    mail = "concat('{\"zeta\": ', CAST(event_id AS string), ', \"user\": \"u', CAST(user_id AS string), '@example.org\", \"props\": ', props, '}')"
    events = read_table(spark, sf_dir, "events").select("event_id", F.expr(mail).alias("j"))
    return events.select("event_id", arrow.json_masker(spark, _P["standard"])(F.col("j")).alias("line"))


def titles(spark, sf_dir):
    """Titles of first user turns, from texts without anything to mask: cut at the last space within 80 code points."""
    first = read_table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", arrow.title_maker(spark)(F.col("text")).alias("t"))
    return first.select("conv_id", "turn", F.col("t.text").alias("title"), F.size("t.categories").cast("long").alias("n_categories"))


def title_paths(spark, sf_dir):
    """Home paths in titles collapse below the user."""
    texts = read_table(spark, sf_dir, "customer").select("c_custkey", F.expr("concat('open /home/u', CAST(c_custkey AS string), '/dev/app', CAST(c_custkey % 9 AS string), '/main.py now')").alias("text"))
    return texts.select("c_custkey", arrow.title_maker(spark)(F.col("text")).alias("t")).select("c_custkey", F.col("t.text").alias("title"), F.array_join("t.categories", ",").alias("categories"))


def metadata_paths(spark, sf_dir):
    """Session metadata with the user and the folders above the project replaced in paths and slugs."""
    c = read_table(spark, sf_dir, "customer")
    user = F.concat(F.lit("u"), F.col("c_custkey").cast("string"))
    home = F.concat(F.lit("/home/"), user)
    null = F.lit(None).cast("string")
    meta = F.struct(
        F.struct(F.concat(home, F.lit("/.claude/projects/-home-"), user, F.lit("-dev-app/s.jsonl")).alias("file_path")).alias("source"),
        F.concat(home, F.lit("/dev/app")).alias("cwd"), F.concat(F.lit("--home--"), user, F.lit("--dev--app")).alias("host_slug"),
        F.struct(null.alias("remote"), F.lit("main").alias("branch"), null.alias("worktree"), null.alias("tracking")).alias("git"),
        F.struct(F.concat(home, F.lit("/dev/app")).alias("file_path"), F.lit("app").alias("name")).alias("project"),
        F.struct(F.array(F.struct(F.lit("io").alias("error_type"), F.lit("x").alias("location"), F.concat(F.lit("mail a@"), user, F.lit(".org")).alias("message"), F.lit("none").alias("remediation"))).alias("warnings")).alias("diagnostics"),
        F.array().cast("array<struct<id:string>>").alias("subagents"),
    )
    out = c.select("c_custkey", metadata.mask_metadata(spark, _P["standard"], meta).alias("m"))
    return out.select("c_custkey", "m.source.file_path", "m.cwd", "m.host_slug", F.col("m.git.remote").alias("remote"), F.col("m.git.branch").alias("branch"), F.col("m.diagnostics.warnings")[0]["message"].alias("message"))


_FENCED = "concat('see ', chr(96), chr(96), chr(96), 'py', chr(10), 'total_', CAST(k % 50 AS string), ' = compute(total_', CAST(k % 50 AS string), ')', chr(10), chr(96), chr(96), chr(96), ' done')"


def code_blocks(spark, sf_dir):
    """Fenced blocks with their language and byte range."""
    texts = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).withColumn("text", F.expr(_FENCED))
    b = texts.select("k", F.explode(arrow.code_extractor(spark)(F.col("text"))).alias("b"))
    return b.select("k", "b.lang", "b.content", F.col("b.start_byte").cast("long").alias("start_byte"), F.col("b.end_byte").cast("long").alias("end_byte"))


def code_anonymized(spark, sf_dir):
    texts = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).withColumn("text", F.expr(_FENCED))
    return texts.select("k", arrow.code_anonymizer(spark)(F.col("text")).alias("text"))


def session_code_names(spark, sf_dir):
    """Names that all turns of a conversation share."""
    code = F.concat(F.lit("```go\nfunc "), F.concat(F.lit("name"), (F.col("turn") % 3).cast("string")), F.lit("() { call"), F.col("turn").cast("string"), F.lit("() }\n```"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", code.alias("text"))
    return arrow.anonymize_sessions(turns, "conv_id", "turn", "text")


def release_tags(spark, sf_dir):
    """Kind and version of release tags, null for what is no tag."""
    tag = "concat('v', CAST(p_partkey % 4 AS string), '.', CAST(p_size AS string), '.0', CASE WHEN p_partkey % 3 = 0 THEN concat('-rc', CAST(p_partkey % 5 AS string)) ELSE '' END)"
    t = read_table(spark, sf_dir, "part").select("p_partkey", F.expr(tag).alias("tag"))
    ok = F.regexp_like("tag", F.lit(native.portable(TAG_PATTERN)))
    rc = F.regexp_extract("tag", native.portable(TAG_PATTERN), 2)
    return t.select("p_partkey", "tag", F.when(ok, F.when(rc != "", "prerelease").otherwise("final")).alias("kind"), F.when(ok, F.concat(F.lit("v"), F.regexp_extract("tag", native.portable(TAG_PATTERN), 1))).alias("version"))


def release_titles(spark, sf_dir):
    title = "concat('release(v', CAST(p_partkey % 4 AS string), '.', CAST(p_size AS string), CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '.1' END, '): ', p_name)"
    t = read_table(spark, sf_dir, "part").select("p_partkey", F.expr(title).alias("title"))
    p = native.portable(TITLE_PATTERN)
    return t.select("p_partkey", F.when(F.regexp_like("title", F.lit(p)), F.regexp_extract("title", p, 1)).alias("version"))


def hit_windows(spark, sf_dir):
    """Matches per rule and day of event texts in a stream with a watermark (an addition of this engine); the last day is there as well."""
    root = _scratch(spark)
    texts = stream_table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.expr("concat('u', CAST(user_id AS string), '@example.org from 10.0.0.', CAST(event_id % 250 AS string))").alias("text"))
    rates = streams.hit_rates(texts, "text", "ts", _P["standard"], "1 day", "1 hour")
    found = streams.run_latest(rates, ["window_start", "rule"], f"{root}/out", f"{root}/state")
    return found.select((F.unix_seconds("window_start") / 86400).cast("long").alias("day"), "rule", "n")


def masked_stream(spark, sf_dir):
    """Conversations masked as a stream."""
    root = _scratch(spark)
    stream = stream_table(spark, sf_dir, "conversations")
    return streams.run_available(streams.mask_stream(stream, "text", _P["standard"]), f"{root}/out", f"{root}/state").select("conv_id", "turn", "text")


def _scratch(spark: SparkSession) -> str:
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="maskwell-")
    return f"{root.rstrip('/')}/maskwell-streams/{uuid.uuid4().hex}"


QUERIES = {
    f.__name__: f
    for f in (
        masked_documents, pii_match_table, detect_all_rules, detect_all_rules_native, report_by_rule, report_totals, level_matrix, hits_by_lang, top_sources_by_hits,
        documents_without_hits, credit_card_filter, aws_context_filter, home_path_filter, residue_counts, residue_locations, entropy_words, entropy_masked,
        rule_activation, rule_set_version, json_values, titles, title_paths, metadata_paths, code_blocks, code_anonymized, session_code_names, release_tags, release_titles, hit_windows, masked_stream,
    )
} | {f"masked_{level}": _masked_at(level) for level in ("minimal", "standard")} | cases.QUERIES


def _sql() -> dict[str, str]:
    def found(rules, source=_DERIVED, key="k", extra=""):
        return f"({O.matches(rules, source, key, extra)})"

    at = {level: _P[level].active_rules for level in LEVELS}
    all_rules = at["maximum"]
    card = next(r for r in PII if r.id == "credit_card")
    aws = next(r for r in BUILT_IN if r.id == "aws_secret_key")
    homes = tuple(r for r in BUILT_IN if r.id.endswith(("home_path", "home_path_spaced")))
    sets = {R.HEX_SET: "[^0-9a-fA-F]", R.BASE64_SET: "[^A-Za-z0-9+/_=-]"}

    def bits(charset: str) -> str:
        kept = f"regexp_replace(word, '{sets[charset]}', '', 'g')"
        chars = f"string_split({kept}, '')"
        return f"CASE WHEN {kept} = '' THEN 0.0 ELSE coalesce(list_sum(list_transform(list_sort(list_distinct({chars})), lambda c: -(len(list_filter({chars}, lambda y: y = c)) / length({kept})) * log2(len(list_filter({chars}, lambda y: y = c)) / length({kept})))), 0.0) END"

    ordered = "array_to_string(list_sort(string_split(lower(word), '')), '')"
    known = ["".join(sorted(set(x))) for x in ("abcdefghijklmnopqrstuvwxyz", "0123456789", R.HEX_SET.lower(), R.BASE64_SET.lower())]
    sequential = " OR ".join(f"starts_with({O.lit(k)}, {ordered})" for k in known)
    high = (
        f"strlen(word) > {R.ENTROPY_OVER_BYTES} AND NOT regexp_matches(word, '{R.UUID_PATTERN}') AND NOT starts_with(word, '$') AND NOT ({sequential}) AND "
        f"(({bits(R.HEX_SET)}) - CASE WHEN regexp_matches(word, '^[0-9]+$') THEN 1.2 / log2(strlen(word)) ELSE 0.0 END > {R.HEX_LIMIT} OR ({bits(R.BASE64_SET)}) > {R.BASE64_LIMIT})"
    )
    words = "SELECT k, i, word FROM (SELECT k, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM (SELECT k, string_split(t, ' ') AS w FROM (" + _DERIVED + ")))"
    space = r"[\t-\r \x{85}\x{a0}]"
    fence, fenced = "repeat(chr(96), 3)", f"SELECT k, {_FENCED} AS t FROM (SELECT o_orderkey AS k FROM orders)"
    core = "(?:0|[1-9][0-9]*)[.](?:0|[1-9][0-9]*)[.](?:0|[1-9][0-9]*)"
    out = {
        "masked_documents": f"SELECT x.doc_id, a.r || substr(x.t, a.b + 1) AS masked, x.n AS n_matches FROM ({O.masked(PII, _DOCS, 'doc_id')}) x",
        "pii_match_table": f"SELECT doc_id, rule, o AS byte_offset, n AS byte_length FROM {found(PII, _DOCS, 'doc_id')}",
        "detect_all_rules": f"SELECT k, rule, o AS byte_offset, n AS byte_length FROM {found(all_rules)}",
        "detect_all_rules_native": f"SELECT k, rule, o AS byte_offset, n AS byte_length FROM {found(all_rules)}",
        "report_by_rule": f"SELECT rule, {O.rendered('category')} AS category, count(*) AS n FROM {found(at['standard'])} GROUP BY rule, category",
        "report_totals": f"SELECT count(*) AS total, count(DISTINCT rule) AS n_rules, array_to_string(list_filter(['CREDENTIAL', 'PII', 'PATH', 'INTERNAL'], lambda c: list_contains(list(DISTINCT {O.rendered('category')}), c)), ',') AS categories FROM {found(at['standard'])}",
        "level_matrix": " UNION ALL ".join(f"SELECT '{level}' AS level, category, count(*) AS n FROM {found(at[level])} GROUP BY category" for level in LEVELS),
        "hits_by_lang": f"SELECT lang, rule, count(*) AS n FROM {found(PII, 'SELECT doc_id, lang, text AS t FROM documents', 'doc_id', ', lang')} GROUP BY lang, rule",
        "top_sources_by_hits": f"SELECT d.source, CAST(sum(coalesce(n, 0)) AS BIGINT) AS hits FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM {found(PII, _DOCS, 'doc_id')} GROUP BY doc_id) x ON d.doc_id = x.doc_id GROUP BY d.source ORDER BY hits DESC, source LIMIT 5",
        "documents_without_hits": f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM {found(PII, _DOCS, 'doc_id')})",
        "credit_card_filter": f"SELECT CAST(sum(len(regexp_extract_all(t, {O.lit(card.pattern)}))) AS BIGINT) AS raw, (SELECT count(*) FROM {found((card,))}) AS kept FROM ({_DERIVED})",
        "aws_context_filter": f"SELECT k, o AS byte_offset FROM {found((aws,))}",
        "home_path_filter": f"SELECT k, rule, m AS matched FROM {found(homes)}",
        "residue_counts": f"SELECT rule_id, n FROM (" + " UNION ALL ".join(f"SELECT {O.lit(i)} AS rule_id, CAST(sum(len(regexp_extract_all(t, {O.lit(p)}))) AS BIGINT) AS n FROM ({_DERIVED})" for i, p in R.RESIDUE) + ") WHERE n > 0",
        "residue_locations": "SELECT k, rule AS rule_id, o AS location FROM ("
        + O.matches(tuple(type(BUILT_IN[0])(i, "secrets", p, "") for i, p in R.RESIDUE), _DERIVED, "k") + ")",
        "entropy_words": f"SELECT k, word FROM ({words}) WHERE {high}",
        "entropy_masked": f"SELECT k, string_agg(CASE WHEN {high} THEN '<HIGH_ENTROPY>' ELSE word END, ' ' ORDER BY i) AS masked FROM ({words}) GROUP BY k",
        "rule_activation": "SELECT * FROM (VALUES " + ", ".join(
            f"('{level}', '{c}', CAST({sum(x[1] == c and level_ordinal(level) >= level_ordinal(x[2] or {'secrets': 'minimal', 'paths': 'minimal', 'pii': 'standard', 'project': 'standard'}[c]) for x in R.PRIMARY)} AS BIGINT))" for level in LEVELS for c in CATEGORIES
        ) + ") AS t(level, category, n)",
        "rule_set_version": "SELECT '3.0.0' AS version, CAST(56 AS BIGINT) AS n_rules, CAST(50 AS BIGINT) AS n_residue",
        "json_values": r"""SELECT event_id, '{"props":' || regexp_replace(props, '\s', '', 'g') || ',"user":"\u003cEMAIL\u003e","zeta":' || CAST(event_id AS VARCHAR) || '}' AS line FROM events""",
        "titles": f"SELECT conv_id, turn, CASE WHEN length(text) <= 80 THEN rtrim(text, chr(32) || chr(9) || chr(10) || chr(13)) WHEN regexp_matches(substr(text, 1, 80), '{space}') THEN rtrim(regexp_extract(substr(text, 1, 80), '(?s)^(.*){space}', 1), chr(32) || chr(9) || chr(10) || chr(13)) ELSE substr(text, 1, 80) END AS title, CAST(0 AS BIGINT) AS n_categories FROM conversations WHERE role = 'user'",
        "title_paths": "SELECT c_custkey, regexp_replace(t, '/home/[^/ ]+(/[^ ]+)*', '/home/<USER>/<PATH>') AS title, CASE WHEN contains(t, '/home/') THEN 'PATH' ELSE '' END AS categories FROM (SELECT c_custkey, concat('open /home/u', CAST(c_custkey AS VARCHAR), '/dev/app', CAST(c_custkey % 9 AS VARCHAR), '/main.py now') AS t FROM customer)",
        "metadata_paths": "SELECT c_custkey, replace(replace(f, '-home-' || u || '-dev-', '-home-<USER>-<PATH>-'), '/home/' || u || '/', '/home/<USER>/') AS file_path, replace('/home/' || u || '/dev/app', '/home/' || u || '/dev/', '/home/<USER>/<PATH>/') AS cwd, replace('--home--' || u || '--dev--app', u || '--dev', '<USER>--<PATH>') AS host_slug, CAST(NULL AS VARCHAR) AS remote, 'main' AS branch, regexp_replace('mail a@' || u || '.org', '[a-z]@[a-z0-9]+[.]org', '<EMAIL>') AS message FROM (SELECT c_custkey, u, '/home/' || u || '/.claude/projects/-home-' || u || '-dev-app/s.jsonl' AS f FROM (SELECT c_custkey, 'u' || CAST(c_custkey AS VARCHAR) AS u FROM customer))",
        "code_blocks": f"SELECT k, 'python' AS lang, regexp_extract(t, '(?s)`{{3}}[a-z]*\n(.*?)\n`{{3}}', 1) AS content, CAST(strpos(t, {fence}) - 1 AS BIGINT) AS start_byte, CAST(strlen(t) - strlen(' done') AS BIGINT) AS end_byte FROM ({fenced})",
        "code_anonymized": f"SELECT k, replace(replace(replace(t, 'py' || chr(10), 'python' || chr(10)), 'total_' || CAST(k % 50 AS VARCHAR), 'id2'), 'compute', 'id1') AS text FROM ({fenced})",
        "release_tags": f"SELECT p_partkey, tag, CASE WHEN NOT ok THEN NULL WHEN contains(tag, '-rc') THEN 'prerelease' ELSE 'final' END AS kind, CASE WHEN ok THEN 'v' || regexp_extract(tag, '^v({core})', 1) END AS version FROM (SELECT *, regexp_matches(tag, '^v{core}(-rc[1-9][0-9]*)?$') AS ok FROM (SELECT p_partkey, concat('v', CAST(p_partkey % 4 AS VARCHAR), '.', CAST(p_size AS VARCHAR), '.0', CASE WHEN p_partkey % 3 = 0 THEN concat('-rc', CAST(p_partkey % 5 AS VARCHAR)) ELSE '' END) AS tag FROM part))",
        "release_titles": f"SELECT p_partkey, nullif(regexp_extract(title, '^release[(](v{core}(?:-rc[1-9][0-9]*)?)[)]: [^\r\n]+$', 1), '') AS version FROM (SELECT p_partkey, concat('release(v', CAST(p_partkey % 4 AS VARCHAR), '.', CAST(p_size AS VARCHAR), CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '.1' END, '): ', p_name) AS title FROM part)",
        "session_code_names": f"WITH t AS (SELECT conv_id, turn, turn % 3 AS m, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM conversations), f AS (SELECT conv_id, m, min(r) AS r0 FROM t GROUP BY conv_id, m), g AS (SELECT t.conv_id, t.turn, t.m, t.r, f.r0, (SELECT count(*) FROM f x WHERE x.conv_id = t.conv_id AND x.r0 < t.r) AS d, (SELECT count(*) FROM f x WHERE x.conv_id = t.conv_id AND x.r0 < f.r0) AS d0 FROM t JOIN f ON t.conv_id = f.conv_id AND t.m = f.m) SELECT conv_id, turn, {fence} || 'go' || chr(10) || 'func id' || CAST(r0 + d0 + 2 AS VARCHAR) || '() {{ id' || CAST(r + d + 1 AS VARCHAR) || '() }}' || chr(10) || {fence} AS text FROM g",
    }
    mails = "SELECT event_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, concat('u', CAST(user_id AS VARCHAR), '@example.org from 10.0.0.', CAST(event_id % 250 AS VARCHAR)) AS t FROM events"
    out["hit_windows"] = f"SELECT day, rule, count(*) AS n FROM {found(at['standard'], mails, 'event_id', ', day')} GROUP BY day, rule"
    turns = "SELECT conv_id * 100000 + turn AS k, text AS t FROM conversations"
    out["masked_stream"] = f"SELECT k // 100000 AS conv_id, k % 100000 AS turn, a.r || substr(t, a.b + 1) AS text FROM ({O.masked(at['standard'], turns, 'k')})"
    for level in ("minimal", "standard"):
        out[f"masked_{level}"] = f"SELECT k, a.r || substr(t, a.b + 1) AS masked FROM ({O.masked(at[level], _DERIVED, 'k')})"
    out |= cases.sql_texts(high, space)
    return {k: v.replace(" AS string)", " AS VARCHAR)") for k, v in out.items()}


SQL = _sql()
