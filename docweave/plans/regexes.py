"""Regular expressions of Python for the JVM."""

from __future__ import annotations

import re
import warnings

from docweave.errors import OperationFailure
from docweave.functions.bsontypes import Regex

_REPLACED = ((r"(?P<", "(?<"), (r"(?#", None))


def to_java(regex: Regex) -> str:
    """A Java pattern that finds what Python's ``re.search`` finds.

    Raises OperationFailure for what has no counterpart.
    """
    try:
        with warnings.catch_warnings():  # a bracket in a class is one here, whatever Python may make of it later
            warnings.simplefilter("ignore", FutureWarning)
            re.compile(regex.pattern)
    except re.error as e:
        raise OperationFailure(f"bad regular expression: {e}", 51091) from e
    out, at, in_class = [], 0, False
    text = regex.pattern
    while at < len(text):
        c, rest = text[at], text[at:]
        if c == "\\":
            if rest[:2] == "\\Z" and not in_class:
                out.append("\\z")
            elif rest[:2] == "\\A" or rest[1:2] != "":
                out.append(rest[:2])
            at += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
                out.append(c)
            elif c == "[" or rest[:2] == "&&":
                out.append("\\" + c)
            else:
                out.append(c)
            at += 1
            continue
        if c == "[":
            in_class = True
            start = 2 if rest[1:2] == "^" else 1
            out.append(rest[:start])
            at += start
            if text[at : at + 1] == "]":  # a bracket that comes first is a member
                out.append("\\]")
                at += 1
            continue
        if rest.startswith("(?P<"):
            out.append("(?<")
            at += 4
        elif rest.startswith("(?P="):
            end = rest.index(")")
            out.append(f"\\k<{rest[4:end]}>")
            at += end + 1
        elif rest.startswith("(?#"):
            at += rest.index(")") + 1
        elif rest.startswith("(?("):
            raise OperationFailure("conditional groups are not supported in $regex", 51091)
        else:
            out.append(c)
            at += 1
    java = "".join(out)
    flags = "".join(f for f in "imsx" if f in regex.flags)
    if re.search(r"\\[wWdDsSbB]", java) or "i" in flags:
        flags += "U"
    # only \n ends a line in Python
    return f"(?d{flags}){java}"
