"""What counts as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths without limit and the numbers of the usual JSON writers; text in single quotes is no JSON.
JSON_OPTIONS = {
    "maxStringLen": "2147483647", "maxNumLen": "2147483647", "allowNonNumericNumbers": "true", "allowSingleQuotes": "false",
}


def is_valid_json(line: Column) -> Column:
    """Whether the line is exactly one JSON value; repeated keys are allowed.

    The parser ends with the first value, so the line is read as the first element of an array that a hash
    of the line closes: with anything behind its value the second element is no longer that hash.
    """
    mark = F.xxhash64(line).cast("string")
    values = F.from_json(F.concat(F.lit("["), line, F.lit(","), mark, F.lit("]")), "array<string>", JSON_OPTIONS)
    return F.coalesce((F.size(values) == 2) & (F.get(values, F.lit(1)) == mark), F.lit(False))
