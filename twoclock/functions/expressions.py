"""Arithmetic over sibling columns, written `{name}`, turned into Spark columns.

Spark's own parser reads the arithmetic; what is checked here is only that the
text is nothing but arithmetic over known columns.
"""

import re

from pyspark.sql import functions as F

# A reference to a sibling column, and all that may stand between.
REFERENCE = re.compile(r"\{([^{}]+)\}")
BETWEEN = re.compile(r"[-+*/(). 0-9]*")


class ExpressionError(ValueError):
    """A derived column that cannot be computed from its siblings."""


def references(text):
    return [name.strip() for name in REFERENCE.findall(text)]


def arithmetic(text, types=None):
    """One expression as a Column. With `types`, a quotient of two whole-number
    columns truncates, as it does in SQL databases with integer division."""
    rest = REFERENCE.sub(" ", text)
    if not BETWEEN.fullmatch(rest) or "--" in text:
        raise ExpressionError(f"{text!r} is more than arithmetic over sibling columns")
    sql = REFERENCE.sub(lambda m: "`" + m.group(1).strip().replace("`", "``") + "`", text)
    whole = {"tinyint", "smallint", "int", "bigint"}
    names = references(text)
    if types and names and all(types.get(n) in whole for n in names) and "." not in rest:
        sql = sql.replace("/", " div ")
    return F.expr(sql)


def evaluation_order(expressions, known):
    """Names of `expressions`, each after the ones it reads; refuses unknown
    references and cycles."""
    for name, text in expressions.items():
        strangers = [r for r in references(text) if r not in known]
        if strangers:
            raise ExpressionError(f"{name} reads {strangers}, which the table has no column for")
    waiting, ordered = dict(expressions), []
    while waiting:
        ready = [n for n, text in waiting.items()
                 if not any(r in waiting for r in references(text))]
        if not ready:
            raise ExpressionError(f"{sorted(waiting)} are written in terms of themselves")
        ordered += ready
        for name in ready:
            del waiting[name]
    return ordered
