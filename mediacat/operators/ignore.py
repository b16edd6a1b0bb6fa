"""Ignore rules on paths: globs and regular expressions on a path and on its parents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default rules, and rules for folders only.
RULES = [".*", "*/.*", "*.tmp", "*.temp", "*.bak", "*.backup", "Thumbs.db", "desktop.ini", ".DS_Store", "*.lnk", "*.url", "~*", "*.swp", "*.swo", "*.cache", "*.thumb", "thumb*.db", "._*", ".Spotlight-*", ".Trashes", ".fseventsd", ".dropbox", ".dropbox.cache", ".git", ".svn", ".hg", ".gvfs", ".mtp", ".mtp+"]
FOLDER_RULES = ["@eaDir", ".thumbnails", ".thumbnail", ".trash", ".Trash", ".Trash-*", ".stfolder", ".syncthing", ".syncthing.*", "lost+found", "System Volume Information", "$RECYCLE.BIN", ".TemporaryItems", ".DocumentRevisions-V100"]


def to_regex(rule: str) -> str:
    """A rule with any of ^$()[]{}|?+\\ is a regular expression, searched anywhere; others are globs on the whole path. Case never counts."""
    if not any(c in rule for c in "^$()[]{}|?+\\"):
        return "(?s:^" + ".*".join(map(re.escape, rule.lower().split("*"))) + "$)"
    try:
        re.compile(rule)
    except re.error:  # such a rule never fits
        return "(?!)"
    return f"(?:{rule})"


def _any(rules: list[str]) -> str:
    return "(?i)(?:" + "|".join(map(to_regex, rules)) + ")"


def parents(path: Column) -> Column:
    """All folders above a path, nearest last."""
    parts = F.split(path, "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/")), lambda p: (p != "") & (p != path))


def is_ignored(path: Column, is_dir: Column, rules: list[str] | None = None, dir_rules: list[str] | None = None) -> Column:
    """A rule fits the path (folder rules only folders), or any rule fits a folder above it."""
    files, folders = _any(RULES if rules is None else rules), _any((RULES if rules is None else rules) + (FOLDER_RULES if dir_rules is None else dir_rules))
    own = F.when(is_dir, F.lower(path).rlike(folders)).otherwise(F.lower(path).rlike(files))
    return own | F.exists(parents(path), lambda p: F.lower(p).rlike(folders))


def filter_ignored(df: DataFrame, path: str = "path", is_dir: str = "is_dir", rules: list[str] | None = None, dir_rules: list[str] | None = None) -> DataFrame:
    return df.where(~is_ignored(F.col(path), F.col(is_dir), rules, dir_rules))


def matching_rules(df: DataFrame, path: str = "path", rules: list[str] | None = None) -> DataFrame:
    """df with rules: all that fit the path itself, in order."""
    rules = RULES if rules is None else rules
    pairs = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(f"(?i){to_regex(r)}").alias("re")) for r in rules))
    return df.withColumn("rules", F.transform(F.filter(pairs, lambda r: F.rlike(F.lower(path), r["re"])), lambda r: r["rule"]))
