"""The engine over Arrow batches: one Python call per batch, the scalar code of :mod:`maskwell.functions` inside.

Each function returns a Column function made for a policy. A null text gives a null result (an empty array for matches).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.errors import ActionableError
from maskwell.functions import documents, engine, titles
from maskwell.plans.policy import Policy
from maskwell.shipping import map_arrow, ship

MATCHES = "array<struct<offset:int,rule_ord:int,length:int,rule:string,category:string>>"
WARNINGS = "array<struct<rule_id:string,location:int,preview:string>>"
PIPELINE = f"struct<text:string,matches:{MATCHES},warnings:{WARNINGS},failed:boolean>"
BLOCKS = "array<struct<lang:string,content:string,start_byte:int,end_byte:int>>"
TITLE = "struct<text:string,categories:array<string>,error:string>"


def _udf(spark: SparkSession, schema: str, function: Callable) -> Callable[..., Column]:
    ship(spark)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([function(t) for t in texts], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, schema)


def _match_rows(found) -> list[dict]:
    return [{"offset": m.offset, "rule_ord": m.ordinal, "length": m.length, "rule": m.rule.id, "category": m.rule.category} for m in found]


def detector(spark: SparkSession, policy: Policy) -> Callable[[Column], Column]:
    """Matches of a text, without the matched strings: those are the secrets."""
    rules = policy.active_rules
    return _udf(spark, MATCHES, lambda t: [] if t is None else _match_rows(engine.detect(t, rules)))


def masker(spark: SparkSession, policy: Policy) -> Callable[[Column], Column]:
    """Only the masked text."""

    def run(t):
        return None if t is None else engine.mask_text(t, policy, warn=False).text

    return _udf(spark, "string", run)


def pipeline(spark: SparkSession, policy: Policy) -> Callable[[Column], Column]:
    """The whole pipeline as a struct: text, matches, warnings, failed. ``failed`` marks rows that the fallback masked."""

    def rows(texts: pd.Series) -> pd.DataFrame:
        out = [(None, None, None, None) if t is None else (r := engine.mask_text(t, policy)) and (r.text, _match_rows(r.matches), [w._asdict() for w in r.warnings], r.failed) for t in texts]
        return pd.DataFrame(out, columns=["text", "matches", "warnings", "failed"])

    ship(spark)
    rows.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(rows, PIPELINE)


def fallback_masker(spark: SparkSession, policy: Policy) -> Callable[[Column], Column]:
    """What a text becomes if the engine fails on it: code hidden, every rule applied without filters, high-entropy words masked."""
    return _udf(spark, "string", lambda t: None if t is None else engine.fallback(t, policy))


def applied_counter(spark: SparkSession, policy: Policy) -> Callable[[Column], Column]:
    """Matches of a text and how many of them changed it; the others begin inside an earlier one."""
    rules = policy.active_rules

    def rows(texts: pd.Series) -> pd.DataFrame:
        found = [None if t is None else engine.detect(t, rules) for t in texts]
        return pd.DataFrame([(None, None) if f is None else (len(f), len(engine.apply_masks(t, f, rules)[1])) for t, f in zip(texts, found, strict=True)], columns=["matches", "applied"])

    ship(spark)
    rows.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(rows, "struct<matches:int,applied:int>")


def residue_scanner(spark: SparkSession, previews: bool = True) -> Callable[[Column], Column]:
    return _udf(spark, WARNINGS, lambda t: [] if t is None else [w._asdict() for w in engine.scan_residue(t, previews)])


def entropy_masker(spark: SparkSession) -> Callable[[Column], Column]:
    return _udf(spark, "string", lambda t: None if t is None else engine.mask_entropy(t))


def code_extractor(spark: SparkSession) -> Callable[[Column], Column]:
    return _udf(spark, BLOCKS, lambda t: [] if t is None else [dict(zip(("lang", "content", "start_byte", "end_byte"), b, strict=True)) for b in engine.code_blocks(t)])


def code_anonymizer(spark: SparkSession) -> Callable[[Column], Column]:
    """Names are given anew in each row; see :func:`anonymize_sessions` for names that a session shares."""
    return _udf(spark, "string", lambda t: None if t is None else engine.Anonymizer().text(t))


def title_maker(spark: SparkSession, mode: str = "generate", harness: str = "", project: str = "") -> Callable[[Column], Column]:
    """Titles as a struct. A malformed turn has a null text and its error, and fails no job."""
    make = {"generate": lambda t: titles.generate(t, harness, project), "sanitize": lambda t: titles.sanitize(t, project), "simple": lambda t: titles.Title(titles.simple_title(t, harness), [])}[mode]

    def rows(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                out.append((None, None, None) if t is None else (*make(t), None))
            except ActionableError as e:
                out.append((None, None, str(e)))
        return pd.DataFrame(out, columns=["text", "categories", "error"])

    ship(spark)
    rows.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(rows, TITLE)


def json_masker(spark: SparkSession, policy: Policy) -> Callable[[Column], Column]:
    """A JSON text with all its string values masked; a text that is no JSON stays as it is."""
    return _udf(spark, "string", lambda t: None if t is None else documents.rewrite_line(t, lambda s: engine.mask_text(s, policy, warn=False).text))


def metadata_masker(spark: SparkSession, policy: Policy) -> Callable[[Column], Column]:
    """Session metadata given and returned as JSON (see maskwell.operators.metadata for structs)."""
    import json

    def run(t):
        return None if t is None else json.dumps(documents.mask_metadata(json.loads(t), lambda s: engine.mask_text(s, policy, warn=False).text), ensure_ascii=False)

    return _udf(spark, "string", run)


def match_table(df: DataFrame, text: str, keys: list[str], policy: Policy) -> DataFrame:
    """One row per match: the keys, offset, rule_ord, length, rule, category."""
    found = detector(df.sparkSession, policy)(F.col(text))
    return df.select(*keys, F.explode(found).alias("m")).select(*keys, "m.*")


def anonymize_sessions(df: DataFrame, session: str, order: str, text: str) -> DataFrame:
    """Code anonymized with names that each session shares, in the order of its turns.

    Sessions are dealt out and sorted by Spark; a task then streams its rows and holds the names of one session, never its texts. A row without a
    session is a session of its own.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, names_of = None, engine.Anonymizer()
        for batch in batches:
            out = []
            for key, t in zip(batch.column(session).to_pylist(), batch.column(text).to_pylist(), strict=True):
                if key is None or key != current:
                    current, names_of = key, engine.Anonymizer()
                out.append(None if t is None else names_of.text(t))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == text else batch.column(n) for n in names], names)

    known = df.filter(F.col(session).isNotNull()).repartition(session).sortWithinPartitions(session, order)
    return map_arrow(known, run, schema).unionByName(map_arrow(df.filter(F.col(session).isNull()), run, schema))
