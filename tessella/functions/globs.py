"""Globs as regular expressions. A list of patterns is a setting of some hundred entries, so this runs on the driver."""

from __future__ import annotations

import re

_TOKENS = re.compile(r"\*\*/|/\*\*$|/\*\*(?=/)|\*\*|\*|\?|\{|\}|,|\[[!^]?\]?[^\]/]*\]|\[|[^*?{},/\[]+|/")


def literal(text: str) -> str:
    """The text as a Java regular expression that matches just it."""
    return re.sub(r"([\\.^$|()\[\]{}+?*&~#-])", r"\\\1", text)


def glob_to_regex(glob: str, tree: bool = False, root: str = "") -> str:
    """A Java regular expression for the whole path.

    ``**/`` is any number of directories, ``/**`` everything below, ``*`` and
    ``?`` stay inside a part and match dots, ``{a,b}`` are alternatives, ``[a-c]``
    is one character of a class and ``[!a-c]`` one outside it. tree: what lies
    below a match matches too. root: a folder, taken literally, that the glob is
    relative to.
    """
    out, depth = [], 0
    for token in _TOKENS.findall(glob):
        if token == "**/":
            out.append("(?:.*/)?")
        elif token.startswith("/**"):
            out.append("/.*" if glob.endswith("/**") and token == "/**" else "(?:/.*)?")
        elif token == "**":
            out.append(".*")
        elif token in "*?":
            out.append("[^/]*" if token == "*" else "[^/]")
        elif token == "{":
            depth += 1
            out.append("(?:")
        elif token == "}" and depth:
            depth -= 1
            out.append(")")
        elif token == "," and depth:
            out.append("|")
        elif len(token) > 2 and token[0] == "[":
            inside = re.sub(r"([\\\[\]&^])", r"\\\1", token[2:-1] if token[1] in "!^" else token[1:-1])
            out.append(f"[^/{inside}]" if token[1] in "!^" else f"(?!/)[{inside}]")
        else:
            out.append(literal(token))
    return "^" + (literal(root) + "/" if root else "") + "".join(out) + ")" * depth + ("(?:/.*)?" if tree else "") + "$"


def any_regex(globs: list[str], tree: bool = True, root: str = "") -> str:
    """One alternation for all globs; matches nothing if there are none."""
    return "|".join(f"(?:{glob_to_regex(g, tree, root)})" for g in sorted(set(globs))) or "(?!)"


_MAGIC = re.compile(r"[*?{}\[\]]")


def literal_key(glob: str) -> str | None:
    """What every path that the glob matches has among its ``path_keys``: a part's name after ``=``, or the end of a part's name from a dot on. None if the glob names nothing such."""
    if re.search(r"\{[^}]*/", glob):  # a slash inside alternatives
        return None
    parts = glob.split("/")
    names, ends = [], []
    for before, part in zip(["", *parts], parts, strict=False):
        if "**" in before and before != "**":
            continue  # it may stand in the middle of a part
        if part and not _MAGIC.search(part):
            names.append("=" + part)
        elif re.fullmatch(r"\*\.[^*?{}\[\]]+", part):
            ends.append(part[1:])
    return max(names, key=len) if names else max(ends, key=len) if ends else None


def path_keys(path: str) -> set[str]:
    parts = [p for p in path.split("/") if p]
    return {"=" + p for p in parts} | {p[i:] for p in parts for i, c in enumerate(p) if c == "."}
