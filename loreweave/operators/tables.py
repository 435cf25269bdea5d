"""The engine in SQL: table functions that read a query's rows and hand each to the extractor of its language.

    SELECT * FROM symbols(TABLE(SELECT path, body FROM files) PARTITION BY path)
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import code

Adapter = Callable[[str, str], list[tuple]]
_KINDS = {"string": StringType(), "int": IntegerType(), "boolean": BooleanType()}


def _columns() -> list[tuple[str, str]]:
    return [tuple(f.strip().split(" ")) for f in code.SYMBOL.split(",")]


def symbols_function(adapters: dict[str, Adapter] | None = None, extensions: dict[str, str] | None = None):
    """A table function over rows with path and body: the symbols of each file by the adapter of its extension. adapters by language add to the
    engine's own or replace them, extensions (".x": language) likewise; files of other extensions give none, nor do null paths."""
    own = {**code.ADAPTERS, **(adapters or {})}
    by_end = {e: lang for lang, (ends, _) in code.CAPABILITIES.items() for e in ends} | (extensions or {})
    columns, kinds = _columns(), _KINDS

    class Symbols:
        @staticmethod
        def analyze(files: AnalyzeArgument) -> AnalyzeResult:
            names = files.dataType.fieldNames() if files.isTable else []
            missing = {"path", "body"} - set(names)
            if missing:
                raise ValueError(f"symbols reads a table with path and body; {', '.join(sorted(missing))} not found")
            return AnalyzeResult(schema=StructType([StructField(n, kinds[k]) for n, k in columns]))

        def eval(self, files: Row) -> Iterator[tuple]:
            path = files["path"]
            language = by_end.get("." + path.rsplit(".", 1)[-1].lower()) if path and "." in path else None
            if language in own:
                yield from own[language](path, files["body"] or "")

    return Symbols


def register(spark: SparkSession, adapters: dict[str, Adapter] | None = None, extensions: dict[str, str] | None = None, name: str = "symbols") -> None:
    """Makes symbols_function known to SQL under a name. The process that works out its columns is started apart and may not find this package, so the
    extractors go there whole."""
    cloudpickle.register_pickle_by_value(sys.modules[code.__name__])
    spark.udtf.register(name, udtf(symbols_function(adapters, extensions)))
