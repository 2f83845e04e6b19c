"""Tables that pass through an operator with columns added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_text(docs: DataFrame, text_col: str, added: list[str]) -> tuple[DataFrame, list[T.StructField], int]:
    """``docs`` without columns named as ``added``, the fields that stay, and the place of the text.

    The text follows the other columns only where its own column is one that goes.

    An operator's own columns replace those of one name (in any case, as SQL compares
    names), so no result has two columns of a name.  Numbers stand for the names on the
    way in, as the Python operators of Spark take no name with a dot.
    """
    taken = {a.lower() for a in added}
    fields = [f for f in docs.schema.fields if f.name.lower() not in taken]
    quoted = ["`" + f.name.replace("`", "``") + "`" for f in fields]
    columns = [F.col(q).alias(f"c{i}") for i, q in enumerate(quoted)]
    names = [f.name.lower() for f in fields]
    if text_col.lower() in names:
        return docs.select(*columns), fields, names.index(text_col.lower())
    return docs.select(*columns, F.col(text_col).alias("text")), fields, len(fields)
