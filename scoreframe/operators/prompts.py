"""Prompt columns. The wording is fixed: other words would be another benchmark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip

# Prompt texts, with the places the columns fill.
MCQ_PROMPT = """
PostGIS Multiple Choice Question:
{question}

Options:
{options}

Answer with ONLY the correct letter (A/B/C/D):
"""

TF_PROMPT = """
Judge whether the following statement about PostGIS is correct. 
Respond ONLY with 'True' or 'False', nothing else.

Statement:
{question}
"""

SQL_PROMPT = """
Please write a valid PostGIS SQL query to solve the following task.
Respond ONLY with a complete SQL query, no explanation, no formatting.

Task:
{question}
"""

SCHEMA_SQL_PROMPT = """
You are a PostGIS expert.

Below is the database schema and a few sample rows. Learn it and answer the task with ONE valid SQL query.

Database schema & samples:
{schema}

Task:
{question}

Rules:
- Return ONLY a complete executable SQL query (no explanation, no Markdown fences).
- Use PostGIS functions where appropriate.
- Do NOT create tables or insert data unless the task explicitly requires.
- Assume SRIDs exactly as in the schema; cast when needed.
"""

ERROR_PROMPT = """You are a strict database execution error classifier.
Based on the error message, classify it into exactly one of the following categories,
and output only the label itself (do not output any other text or punctuation).

Classification guidelines (for your understanding only, do not output them):
1. SQL Syntax Errors: syntax issues, misplaced keywords, unclosed quotes/parentheses, messages like "syntax error at or near ..."
2. PostGIS Function Errors: PostGIS-related functions, such as "function ... does not exist", "operator/function argument count or type mismatch", "missing required parameter or clause"
3. Missing Objects: missing table/view/column/alias/relation or FROM-clause, such as "relation ... does not exist", "column ... does not exist", "missing FROM-clause entry for table ..."
4. Geometry Parsing Errors: geometry text/binary parsing failures or invalid geometries, such as "parse error - invalid geometry", "cannot mix dimensionality in a geometry", "geometry requires more points"
5. Environment/Connection Errors: connection failures, timeouts, permission/role/database connection or environment issues
6. SRID/Dimension Mismatch: inconsistent SRID or mismatched dimensions, such as "Operation on mixed SRID", "Coordinate dimension mismatch"
7. Result Mismatch Errors: mismatches with expected results, such as "row count mismatch: model returned xx rows, expected xx rows", "expected 1 row, got N rows"

Error message:
{error}
"""



def _fill(template: str, trim: bool = True, **columns: Column) -> Column:
    """The template with its places replaced by columns."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), columns[name]]
    text = F.concat(*parts, F.lit(rest))
    return strip(text) if trim else text


def options_text(options: Column) -> Column:
    """``K. text`` per line, in the given order of the options."""
    return F.array_join(
        F.transform(F.map_entries(options), lambda e: F.concat(e["key"], F.lit(". "), e["value"])),
        "\n",
    )


def prompt_mcq(question: Column, options: Column) -> Column:
    return _fill(MCQ_PROMPT, question=question, options=options_text(options))


def prompt_tf(question: Column) -> Column:
    return _fill(TF_PROMPT, question=question)


def prompt_sql(question: Column) -> Column:
    return _fill(SQL_PROMPT, question=question)


def prompt_schema_sql(schema: Column, question_en: Column, question: Column) -> Column:
    """English question if there is one, else the other; missing schema is empty."""
    blank = F.lit("")
    return _fill(
        SCHEMA_SQL_PROMPT,
        schema=F.coalesce(schema, blank),
        question=F.coalesce(F.nullif(question_en, blank), F.nullif(question, blank), blank),
    )


def prompt_error(message: Column, max_chars: int | None = None) -> Column:
    """The prompt for a message, whole or cut to ``max_chars`` characters."""
    shown = message if max_chars is None else F.left(message, F.lit(max_chars))
    return _fill(ERROR_PROMPT, trim=False, error=shown)
