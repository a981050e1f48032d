"""Problem 1: source files that do not parse.

Every file goes through memoised parsing with derivatives (see
:mod:`weirstone.llm.derivatives`): the token at which the derivative becomes
empty is the failing one; a derivative that is not nullable at the end means
truncation.  Null contents give no row in the result, empty ones are valid,
unknown endings give no row; repeated deliveries of one artifact give one row.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .languages import KINDS, NAMES, language

SUFFIX = r"\.(py|js|mjs|jsx|ts|java|go|c|cc|rb)$"
_SCHEMA = "artifact_id bigint, repo_id string, path string, language string, valid boolean, verdict string, fail_line bigint, fail_token string"


def judge_text(path, text):
    """(language, valid, verdict, failing line, failing token) of one file; None for other endings."""
    m = re.search(SUFFIX, path or "")
    if m is None or text is None:
        return None
    lang = language(m[0])
    found = lang.check(text)
    if found is None:
        return NAMES[m[0]], True, "valid", None, None
    at, token = found
    if token is None or not token.strip():
        return NAMES[m[0]], False, "truncated" if token is None else "error", text.count("\n") + 1 if token is None else _line(lang, text, at), None
    return NAMES[m[0]], False, "error", _line(lang, text, at), token[:80]


def _line(lang, text, at):
    for i, m in enumerate(lang.regex.finditer(text)):
        if i == at:
            return text.count("\n", 0, m.start(1)) + 1
    return text.count("\n") + 1


def _judge(batches):
    for batch in batches:
        rows = []
        for key, repo, path, text in zip(batch.artifact_id, batch.repo_id, batch.path, batch.content):
            found = judge_text(path, text)
            if found:
                rows.append((key, repo, path, *found))
        yield pd.DataFrame(rows, columns=["artifact_id", "repo_id", "path", "language", "valid", "verdict", "fail_line", "fail_token"]).astype(
            {"fail_line": "Int64", "artifact_id": "Int64", "valid": "boolean"}
        )


def syntax(artifacts: DataFrame) -> DataFrame:
    """One row per source artifact: language, valid, verdict (valid, error or truncated), fail_line, fail_token.

    Reads artifact_id, repo_id, path and content; other columns are ignored. Rows
    without an artifact_id, path or content give none."""
    some = artifacts.select("artifact_id", "repo_id", "path", "content").where(
        F.col("content").isNotNull() & F.col("artifact_id").isNotNull() & F.col("path").rlike(SUFFIX)
    )
    return some.mapInPandas(_judge, _SCHEMA).dropDuplicates(["artifact_id"])


def rates(judged: DataFrame) -> DataFrame:
    """Files, invalid and truncated files and the invalid share by repo_id (null is one group) and language."""
    return judged.groupBy("repo_id", "language").agg(
        F.count("*").alias("files"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.count_if(F.col("verdict") == "truncated").alias("truncated"),
        F.round(F.avg(F.when(F.col("valid"), 0.0).otherwise(1.0)), 6).alias("invalid_rate"),
    )


assert set(KINDS) == set(NAMES)
