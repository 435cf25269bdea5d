"""Which files a repository's ignore rules leave: rules as rows, joined to every folder above a path, the last match wins.

A rule file's lines hold below its folder. A rule without a slash, or with one at its end alone, meets names at any depth; others are anchored at the
folder. `!` takes a path back, but nothing below an ignored folder comes back. Rules of deeper folders come after those above them.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULE_FILE = ".gitignore"


def rule(line: str) -> tuple[str, bool, bool] | None:
    """(regex over the path below the rule's folder, takes back, folders only) of a line; None for blanks and comments."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line
    folder = line.endswith("/")
    line = line[:-1] if folder else line
    if not line:
        return None
    anchored = "/" in line
    line = line.removeprefix("/")
    out, i = "", 0
    if line.startswith("**/"):
        out, i = "(?:.*/)?", 3
    elif not anchored:
        out = "(?:.*/)?"
    while i < len(line):
        c = line[i]
        if line[i:] == "/**":
            out, i = out + "/.+", len(line)
        elif line[i : i + 4] == "/**/":
            out, i = out + "/(?:.*/)?", i + 4
        elif c == "*":
            while line[i : i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := re.match(r"\[[!^]?\]?(?:\[:\w+:\]|\\.|[^\]\\])*\]", line[i:])):
            inside = end[0][1:-1]
            negated = inside[:1] in ("!", "^")
            inside = re.sub(r"\[:(\w+):\]", lambda m: {"digit": "0-9", "alpha": "a-zA-Z", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\\s"}.get(m[1], ""), inside[negated:])
            inside = re.sub(r"^\]", r"\\]", re.sub(r"\[", r"\\[", inside)).replace("&&", "&\\&")
            out, i = out + f"(?!/)[{'^' if negated else ''}{inside}]", i + len(end[0])
        elif c == "\\" and i + 1 < len(line):
            out, i = out + re.escape(line[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$", back, folder


def rules(files: DataFrame) -> DataFrame:
    """(folder, ordinal, regex, back, only_folders) of rule files (path, body)."""

    @F.pandas_udf("struct<regex:string,back:boolean,only_folders:boolean>")
    def parsed(lines: pd.Series) -> pd.DataFrame:
        rows = [rule(x) or (None, None, None) for x in lines]
        return pd.DataFrame(rows, columns=["regex", "back", "only_folders"])

    own = files.where(F.substring_index("path", "/", -1) == RULE_FILE)
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    lines = own.select(folder.alias("folder"), F.posexplode(F.split("body", "\n")).alias("ordinal", "line"))
    return lines.select("folder", "ordinal", parsed("line").alias("r")).where("r.regex is not null").select("folder", "ordinal", "r.regex", "r.back", "r.only_folders")


def _above(path: str) -> F.Column:
    """A path's folders, from the first name to the one that holds it."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def kept(paths: DataFrame, ignore: DataFrame) -> DataFrame:
    """The distinct paths (path: files) that no rule takes out. Folders are judged once each, however many files they hold; a rule meets only what
    lies below its folder, by an equi-join."""
    each = paths.select("path").distinct()
    folders = each.select(F.explode(_above("path")).alias("item")).distinct().withColumn("is_folder", F.lit(True))
    items = folders.unionByName(each.select(F.col("path").alias("item"), F.lit(False).alias("is_folder")))
    held = items.select("item", "is_folder", F.explode(F.concat(F.array(F.lit("")), _above("item"))).alias("folder"))
    below = F.when(F.col("folder") == "", F.col("item")).otherwise(F.expr("substring(item, length(folder) + 2)"))
    met = held.join(ignore, "folder").withColumn("below", below).where(F.expr("below rlike regex") & (F.col("is_folder") | ~F.col("only_folders")))
    last = met.groupBy("item", "is_folder").agg(F.max_by("back", F.struct(F.length("folder"), "ordinal")).alias("back"))
    out = last.where(~F.col("back")).select("item", "is_folder")
    gone = each.select("path", F.explode(_above("path")).alias("item")).join(out.where("is_folder").select("item"), "item", "left_semi").select("path")
    return each.join(gone, "path", "left_anti").join(out.where(~F.col("is_folder")).select(F.col("item").alias("path")), "path", "left_anti")
