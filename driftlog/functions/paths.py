"""Path predicates: ignore globs, exclusions, safe names."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Directories every recording ignores.
ALWAYS_IGNORED = (".git", ".jj")


def ignore_list(extra: Sequence[str] = ()) -> list[str]:
    """The given ignores plus the fixed ones, sorted and unique."""
    return sorted({*ALWAYS_IGNORED, *extra})


def glob_regex(pattern: str) -> str:
    """A whole-path regular expression for an ignore glob.

    ``*`` and ``?`` also match ``/``; ``**`` between separators spans any
    number of directories.
    """
    out, depth, at = [], 0, 0
    text = pattern
    while at < len(text):
        char = text[at]
        if text.startswith("**/", at) and at == 0:
            out.append("(?:.*/)?")
            at += 3
            continue
        if text.startswith("/**/", at):
            out.append("/(?:.*/)?")
            at += 4
            continue
        if text.startswith("/**", at) and at + 3 == len(text):
            out.append("/.*")
            break
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[":
            end = text.find("]", at + 2)
            if end < 0:
                raise ValueError(f"unclosed character class in glob {pattern!r}")
            body = text[at + 1 : end]
            negate = body[:1] in ("!", "^")
            body = body[1:] if negate else body
            out.append("[" + ("^" if negate else "") + body.replace("\\", "\\\\").replace("[", "\\[") + "]")
            at = end
        elif char == "{":
            depth += 1
            out.append("(?:")
        elif char == "}" and depth:
            depth -= 1
            out.append(")")
        elif char == "," and depth:
            out.append("|")
        elif char == "\\" and at + 1 < len(text):
            at += 1
            out.append(re.escape(text[at]))
        else:
            out.append(re.escape(char))
        at += 1
    if depth:
        raise ValueError(f"unclosed alternative in glob {pattern!r}")
    return "".join(out)


def ignore_rule(ignores: Sequence[str]) -> tuple[str, list[str]]:
    """An ignore list as one regular expression for whole paths and subtrees,
    and the names that no path component may equal."""
    globs = [pattern.lstrip("/") for pattern in ignores]
    alternatives = "|".join(f"{glob_regex(g)}|{glob_regex(g + '/**')}" for g in globs)
    return f"(?s)^(?:{alternatives})$", sorted({pattern.strip("/") for pattern in ignores})


def ignored(relative: Column, ignores: Sequence[str] | tuple[Column, Column]) -> Column:
    """Does an ignore glob, its subtree or an equal path component match?  A
    rule may also be given as columns, its expression and its names."""
    if not len(ignores):
        return F.lit(False)
    if isinstance(ignores[0], Column):
        expression, names = ignores
        return F.rlike(relative, expression) | F.arrays_overlap(F.split(relative, "/"), names)
    text, literals = ignore_rule(ignores)
    return relative.rlike(text) | F.arrays_overlap(
        F.split(relative, "/"), F.array(*[F.lit(name) for name in literals])
    )


def session_filters(lists: DataFrame) -> DataFrame:
    """What each session records, from (session_id, root, excluded, ignores):
    the lists as columns that ``recorded_paths`` takes, session_id, root,
    excluded, expression, names; and error, NULL unless a glob is malformed.

    Globs are compiled here, once per session; paths are then matched by Spark
    with the joined columns.  A NULL list is empty.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for patterns in frame["ignores"]:
                try:
                    rows.append((*ignore_rule(ignore_list(() if patterns is None else list(patterns))), None))
                except ValueError as error:
                    rows.append((None, None, str(error)))
            made = pd.DataFrame(rows, columns=["expression", "names", "error"], index=frame.index)
            yield pd.concat([frame[["session_id", "root", "excluded"]], made], axis=1)

    none = F.array().cast("array<string>")
    return lists.select(
        "session_id", F.regexp_replace("root", r"(?<=.)/+$", "").alias("root"),
        F.transform(F.coalesce("excluded", none), lambda x: F.regexp_replace(x, r"/+$", "")).alias("excluded"), "ignores",
    ).mapInPandas(run, "session_id string, root string, excluded array<string>, expression string, names array<string>, error string")


def below(path: Column, prefix: Column) -> Column:
    """Is ``path`` the prefix itself or inside it, compared by component?"""
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def recorded_paths(
    paths: Column,
    root: str | Column,
    excluded: Sequence[str] | Column = (),
    ignores: Sequence[str] | tuple[Column, Column] = (),
) -> Column:
    """Paths of an array relative to ``root`` with ``/`` separators; those the
    recording does not cover are left out.  Relative input is taken below
    ``root``.  ``ignores`` are added to the fixed ones; all three may be columns
    of ``session_filters``.

    The steps are chained so that each one binds its result once: inside a
    lambda Spark does not share repeated subexpressions.
    """
    top = F.lit(root.rstrip("/") or "/") if isinstance(root, str) else root
    start = F.when(top == "/", top).otherwise(F.concat(top, F.lit("/")))

    def absolute(path: Column) -> Column:
        return F.when(path.startswith("/"), path).otherwise(F.concat(start, path))

    def normal(path: Column) -> Column:
        # Only unusual paths hold empty or "." components.
        tidy = F.regexp_replace(F.regexp_replace(path, r"(/\.)+(?=/|$)", ""), r"/+", "/")
        return F.when(path.rlike(r"//|/\.(/|$)|./$"), F.regexp_replace(tidy, r"(?<=.)/$", "")).otherwise(path)

    def covered(path: Column) -> Column:
        inside = path.startswith(start)
        if isinstance(excluded, Column):
            return inside & ~F.exists(excluded, lambda prefix: below(path, prefix))
        for prefix in excluded:
            inside = inside & ~below(path, F.lit(prefix.rstrip("/")))
        return inside

    clean = F.filter(F.transform(F.transform(paths, absolute), normal), covered)
    relative = F.transform(clean, lambda path: F.substr(path, F.length(start) + 1))
    by_column = len(ignores) and isinstance(ignores[0], Column)
    rule = ignores if by_column else ignore_list(ignores)
    kept = F.filter(relative, lambda path: (path != "") & ~ignored(path, rule))
    return F.transform(kept, lambda path: F.replace(path, F.lit("\\"), F.lit("/")))


def recorded_path(
    path: Column,
    root: str | Column,
    excluded: Sequence[str] = (),
    ignores: Sequence[str] = (),
) -> Column:
    """``recorded_paths`` for one path: NULL when it is not covered."""
    return F.get(recorded_paths(F.array(path), root, excluded, ignores), F.lit(0))


def bad_segment(key: Column) -> Column:
    """Does a ``/``-separated key hold an empty, ``.`` or ``..`` segment?"""
    return F.arrays_overlap(F.split(key, "/"), F.array(F.lit(""), F.lit("."), F.lit("..")))
