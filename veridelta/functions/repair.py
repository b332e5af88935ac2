"""Reading JSON that was cut off or loosely written."""

from __future__ import annotations

import json
import re


def repair_json(text: str) -> str | None:
    """A text made into JSON: fences and comments removed, single quotes and commas at ends mended, open brackets closed; None if that isn't enough."""
    t = re.sub(r"^```\w*\s*|\s*```$", "", (text or "").strip())
    out, stack, i, quote = [], [], 0, ""
    while i < len(t):
        c = t[i]
        if quote:
            if c == "\\" and i + 1 < len(t):
                out.append(c + t[i + 1])
                i += 2
                continue
            if c == quote:
                quote, c = "", '"'
            elif c == '"':
                c = '\\"'
            elif c == "\n":
                c = "\\n"
            out.append(c)
        elif c in "\"'":
            quote = c
            out.append('"')
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            out.append(c)
        elif c in "}]":
            while stack and stack[-1] != c:
                out.append(stack.pop())
            if stack:
                out.append(stack.pop())
        else:
            out.append(c)
        i += 1
    if quote:
        out.append('"')
    mended = re.sub(r",(\s*[}\]])", r"\1", "".join(out).rstrip().rstrip(",") + "".join(reversed(stack)))
    mended = re.sub(r":\s*([}\]])", r":null\1", mended)
    try:
        return json.dumps(json.loads(mended), sort_keys=True, separators=(",", ":"))
    except ValueError:
        return None
