"""A check of generated markup: brackets in order, strings, raw text and comments closed.

Markup is text until `#` begins an expression: a name, then calls in parentheses and contents in brackets that follow it
without a space. Parentheses and braces hold code, brackets hold text again.
"""

from __future__ import annotations

import re

CLOSING = {"(": ")", "[": "]", "{": "}"}
_NAME = re.compile(r"[\w-]+(?:\.[\w-]+)*")
_RAW = re.compile("`+")


def syntax_errors(text: str) -> list[tuple[int, str]]:
    """Places (character offsets) and messages; empty if the markup holds together."""
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    at, calls = 0, False  # calls: an expression stands just before, so a bracket belongs to it
    while at < len(text):
        c = text[at]
        code = bool(stack) and stack[-1][0] != "["
        if c == "\\" and not code:
            at, calls = at + 2, False
        elif c == "`":
            fence = _RAW.match(text, at).group()
            end = text.find(fence, at + len(fence)) if len(fence) != 2 else at
            if end < 0:
                return [*found, (at, "raw text isn't closed")]
            at, calls = end + len(fence), False
        elif c == '"' and code:
            end = at + 1
            while end < len(text) and text[end] != '"':
                end += 2 if text[end] == "\\" else 1
            if end >= len(text):
                return [*found, (at, "string isn't closed")]
            at, calls = end + 1, False
        elif text.startswith("/*", at):
            end = text.find("*/", at + 2)
            if end < 0:
                return [*found, (at, "comment isn't closed")]
            at = end + 2
        elif text.startswith("//", at) and (code or at == 0 or text[at - 1].isspace()):
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
        elif c == "#" and not code:
            name = _NAME.match(text, at + 1)
            at, calls = (name.end() if name else at + 1), True
        elif c in "([{" and (code or calls or c == "["):
            stack.append((c, at))
            at, calls = at + 1, False
        elif c == "]" or c in ")}" and code:
            if not stack:
                found.append((at, f"{c} closes nothing"))
            elif CLOSING[stack[-1][0]] != c:
                found.append((at, f"{c} closes {stack[-1][0]} of {stack[-1][1]}"))
                stack.pop()
            else:
                stack.pop()
            at, calls = at + 1, not (stack and stack[-1][0] != "[")
        else:
            at, calls = at + 1, False
    return found + [(place, f"{c} isn't closed") for c, place in stack]
