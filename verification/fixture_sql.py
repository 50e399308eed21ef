"""The derived input views as SQL, for the oracle side only.

The text lives in FIXTURES.md (part B). An oracle statement names the views it
needs; :func:`with_views` puts them, and the views those need, in front of it.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

from .extra_views import VIEWS

_DOC = Path(__file__).resolve().parent.parent / "FIXTURES.md"


@lru_cache(maxsize=1)
def views() -> dict[str, str]:
    text = _DOC.read_text()
    block = text.split("<!-- fixture-sql -->")[1].split("<!-- /fixture-sql -->")[0]
    out = {}
    for chunk in block.split("-- name: ")[1:]:
        name, body = chunk.split("\n", 1)
        out[name.strip()] = body.replace("```", "").strip().rstrip(";")
    out.update(VIEWS)
    return out


def with_views(sql: str) -> str:
    """Prefix ``sql`` (which may start with WITH [RECURSIVE]) with the views it uses."""
    known = views()
    needed: list[str] = []

    def need(body: str) -> None:
        for name in re.findall(r"\bfx_\w+", body):
            if name in known and name not in needed:
                need(known[name])
                if name not in needed:
                    needed.append(name)

    need(sql)
    body = sql.strip()
    ctes = [f"{n} AS (\n{known[n]}\n)" for n in needed]
    if re.match(r"(?is)with\b", body):
        body = re.sub(r"(?is)^with\s+(recursive\s+)?", "", body)
        return "WITH RECURSIVE " + ",\n".join(ctes + [body]) if ctes else sql
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body
