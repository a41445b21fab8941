"""Texts with made-up secrets, derived from order keys by one SQL text that Spark and DuckDB both run.

The tables hold only a few kinds of sensitive text, so most rules are shown on these. Nothing in them is a real credential.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwell.sources.tables import read_table

#: Per template: the SQL of a token, from h and g (two md5 texts of the key) and their upper-case forms u and v.
TOKENS = (
    "concat('sk-ant-api03-', h)",
    "concat('sk-proj-', substr(h, 1, 20), 'T3BlbkFJ', substr(g, 1, 20))",
    "concat('ghp_', h, substr(g, 1, 4))",
    "concat('AKIA', substr(u, 1, 16))",
    "concat('aws_secret_access_key = ', h, substr(v, 1, 8), ' next')",
    "concat('sk_live_', substr(h, 1, 24))",
    "concat('AC', h)",
    "concat('SK', g)",
    "concat('SG.', substr(h, 1, 22), '.', h, substr(g, 1, 11))",
    "concat('xoxb-12345-67890-', h)",
    "concat('https://hooks.slack.com/services/T', substr(u, 1, 8), '/B', substr(v, 1, 8), '/', h)",
    "concat('eyJ', substr(h, 1, 14), '.eyJ', substr(g, 1, 14), '.', h)",
    "concat('-----BEGIN RSA PRIVATE KEY----- ', h)",
    "concat('api_key = ', chr(34), h, chr(34))",
    "concat('Bearer ', h)",
    "concat('Authorization: Basic ', substr(h, 1, 20))",
    "concat('https://user', substr(h, 1, 4), ':', substr(g, 1, 8), '@host.example')",
    "concat('verification code: ', substr(u, 1, 8))",
    "concat('AKC', substr(h, 1, 14))",
    "concat('AP', substr('0123456789ABCDEF', 1 + CAST(k % 16 AS int), 1), substr(h, 1, 12))",
    "concat('AccountKey=', h, g, substr(h, 1, 24))",
    "concat('M', substr(h, 1, 23), '.', substr(g, 1, 6), '.', substr(h, 1, 27))",
    "concat('glpat-', substr(h, 1, 20))",
    "concat('GR1348941', substr(h, 1, 20))",
    "concat('glcbt-', substr(h, 1, 2), '_', substr(g, 1, 20))",
    "concat('glimt-', substr(h, 1, 25))",
    "concat('glptt-', h, substr(g, 1, 8))",
    "concat('glagent-', h, g)",
    "concat('gloas-', h, g)",
    "concat(h, '-us', CAST(k % 20 AS string))",
    "concat('//registry.example/:_authToken=npm_', h)",
    "concat('pypi-AgEIcHlwaS5vcmc', h, g, h)",
    "concat('pypi-AgENdGVzdC5weXBpLm9yZw', h, g, h)",
    "concat('sq0csp-', h, substr(g, 1, 11))",
    "concat('123456789:', h, substr(g, 1, 3))",
    "concat('user.', substr(h, 1, 6), '@mail', CAST(k % 7 AS string), '.example.org')",
    "concat('+1-', CAST(200 + k % 700 AS string), '-555-', CAST(1000 + k % 9000 AS string))",
    "concat('ssn ', CAST(100 + k % 800 AS string), '-12-', CAST(1000 + k % 9000 AS string))",
    "concat('4111 1111 1111 ', CAST(1000 + k % 9000 AS string))",
    "concat('10.', CAST(k % 256 AS string), '.3.', CAST(k % 300 AS string))",
    "concat('/home/u', substr(h, 1, 5), '/src')",
    "concat('/Users/Ann Lee', substr(h, 1, 3), '/src')",
    "concat('C:', chr(92), 'Users', chr(92), 'u', substr(h, 1, 5), chr(92), 'src')",
    "concat('C:', chr(92), 'Users', chr(92), 'Ann Lee', chr(92), 'src')",
    "concat('projects/-home-u', substr(h, 1, 5), '-dev')",
    "concat('slug/--Users--u', substr(h, 1, 5), '--dev')",
    "concat('https://github.com/org', substr(h, 1, 4), '/repo.git')",
    "concat('git@github.com:org', substr(h, 1, 4), '/repo.git')",
    "concat('import ', chr(34), 'github.com/org/', substr(h, 1, 6), '/pkg', chr(34))",
    "concat('module github.com/org/', substr(h, 1, 6))",
    "concat(chr(34), 'homepage', chr(34), ': ', chr(34), 'https://github.com/org/', substr(h, 1, 6), chr(34))",
    "concat('FROM myorg/', substr(h, 1, 6), ':1.0')",
    "concat('ghcr.io/org/', substr(h, 1, 6), ':2')",
    "concat('* feature/', substr(h, 1, 6))",
    "concat('CI_PROJECT_PATH=org/', substr(h, 1, 6))",
    "concat('GITHUB_REPOSITORY=org/', substr(h, 1, 6))",
    "concat('api_key = ghp_', h, substr(g, 1, 4))",
    "concat('order 4111-1111-1111-', CAST(1000 + k % 9000 AS string))",
    "concat('value ', h, substr(v, 1, 8), ' plain')",
    "concat('clean words only ', CAST(k AS string))",
)


def derived_sql(table: str = "orders", key: str = "o_orderkey") -> str:
    """SELECT of k (the key) and text: one token between plain words, and every fifth text with a second one."""
    cases = " ".join(f"WHEN {i} THEN {token}" for i, token in enumerate(TOKENS))
    again = " ".join(f"WHEN {i} THEN {TOKENS[(i * 7 + 3) % len(TOKENS)]}" for i in range(len(TOKENS)))
    n = len(TOKENS)
    return (
        f"SELECT k, concat('entry ', CAST(k AS string), ' is ', CASE k % {n} {cases} END, CASE WHEN k % 5 = 0 THEN concat(' and ', CASE k % {n} {again} END) ELSE '' END, ' end') AS text "
        f"FROM (SELECT {key} AS k, md5(CAST({key} AS string)) AS h, md5(concat('x', CAST({key} AS string))) AS g, upper(md5(CAST({key} AS string))) AS u, upper(md5(concat('x', CAST({key} AS string)))) AS v FROM {table}) d"
    )


def derived(spark: SparkSession, sf_dir: str, table: str = "orders", key: str = "o_orderkey") -> DataFrame:
    """The texts of a table's keys. The SQL names its table through a parameter, so no view stays in the session's catalog."""
    return spark.sql(derived_sql("{source}", key), source=read_table(spark, sf_dir, table).select(key))
