"""Graph patterns to SQL: the read-only shapes ``MATCH … [WHERE …] RETURN … [ORDER BY …] [LIMIT n]`` over facts and links."""

from __future__ import annotations

import re

WRITES = "ALTER CALL COPY CREATE DELETE DETACH DROP INSERT LOAD MERGE REMOVE SET UPDATE".split()
_NAME = r"[A-Za-z_]\w*"
_PROPS = r"(?:\s*\{([^{}]*)\})?"
NODE = re.compile(rf"\(\s*({_NAME})?(?:\s*:\s*({_NAME}))?{_PROPS}\s*\)")
LINK = re.compile(rf"(<)?-\s*(?:\[\s*({_NAME})?(?:\s*:\s*({_NAME}))?{_PROPS}\s*\])?\s*-(>)?")
_STRING = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"")


def hide(text: str) -> tuple[str, list[str]]:
    """The text with every string literal as a mark, and the literals as SQL."""
    found: list[str] = []

    def keep(m: re.Match) -> str:
        body = re.sub(r"\\(.)", r"\1", m[0][1:-1].replace("''", "'") if m[0][0] == "'" else m[0][1:-1])
        found.append("'" + body.replace("\\", "\\\\").replace("'", "\\'") + "'")
        return f"\x00{len(found) - 1}\x00"

    return _STRING.sub(keep, text), found


def show(text: str, literals: list[str]) -> str:
    return re.sub(r"\x00(\d+)\x00", lambda m: literals[int(m[1])], text)


def expression(text: str) -> str:
    """Functions and operators of patterns as SQL ones; literals are hidden."""
    out = re.sub(r"\btoLower\s*\(", "lower(", text, flags=re.I)
    out = re.sub(r"\btoUpper\s*\(", "upper(", out, flags=re.I)
    operand = rf"((?:{_NAME}\s*\()?(?:{_NAME}\.{_NAME}|\x00\d+\x00|{_NAME})\)?)"
    for words, name in ((r"CONTAINS", "contains"), (r"STARTS\s+WITH", "startswith"), (r"ENDS\s+WITH", "endswith")):
        out = re.sub(rf"{operand}\s+{words}\s+{operand}", rf"{name}(\1, \2)", out, flags=re.I)
    out = re.sub(r"\bIN\s*\[([^\]]*)\]", r"IN (\1)", out, flags=re.I)
    return re.sub(rf"\bid\s*\(\s*({_NAME})\s*\)", r"\1.block_id", out, flags=re.I)


def properties(owner: str, text: str | None) -> list[str]:
    if not text or not text.strip():
        return []
    pairs = [p.split(":", 1) for p in text.split(",")]
    if any(len(p) != 2 or not re.fullmatch(_NAME, p[0].strip()) for p in pairs):
        raise ValueError("properties are name: value, …")
    return [f"{owner}.{k.strip()} = {expression(v.strip())}" for k, v in pairs]


def translate(query: str) -> str:
    """SQL over the views ``Fact`` and ``RELATED``; a ValueError says what isn't understood."""
    text, literals = hide(query.strip().rstrip(";").strip())
    if found := re.search(rf"\b(?:{'|'.join(WRITES)})\b", text, re.I):
        raise ValueError(f"{found[0].upper()} is not allowed: patterns are only read")
    shape = re.fullmatch(r"MATCH\s+(.*?)(?:\s+WHERE\s+(.*?))?\s+RETURN\s+(DISTINCT\s+)?(.*?)(?:\s+ORDER\s+BY\s+(.*?))?(?:\s+LIMIT\s+(\d+))?", text, re.I | re.S)
    if not shape:
        raise ValueError("a pattern reads MATCH … [WHERE …] RETURN … [ORDER BY …] [LIMIT n]")
    pattern, where, distinct, items, order, limit = shape.groups()
    sources, conditions, nodes = [], [], {}
    for path in re.split(r",(?![^(\[{]*[)\]}])", pattern):
        at, before, path = 0, None, path.strip()
        while at < len(path):
            node = NODE.match(path, at)
            if not node:
                raise ValueError(f"not a node: {path[at:]!r}")
            name = node[1] or f"_n{len(nodes)}"
            if node[2] and node[2].lower() != "fact":
                raise ValueError(f"unknown kind of node {node[2]!r}; there is Fact")
            if name not in nodes:
                nodes[name] = True
                sources.append(f"Fact {name}")
            conditions += properties(name, node[3])
            if before:
                back, link, left, right = before
                fore = f"{link}.src = {left}.block_id AND {link}.dst = {name}.block_id"
                rear = f"{link}.dst = {left}.block_id AND {link}.src = {name}.block_id"
                conditions.append(rear if back else fore if right else f"({fore} OR {rear})")
            at = node.end()
            while at < len(path) and path[at].isspace():
                at += 1
            if at == len(path):
                break
            edge = LINK.match(path, at)
            if not edge or edge[1] and edge[5]:
                raise ValueError(f"not a link: {path[at:]!r}")
            if edge[3] and edge[3].lower() != "related":
                raise ValueError(f"unknown kind of link {edge[3]!r}; there is RELATED")
            link = edge[2] or f"_e{len(sources)}"
            sources.append(f"RELATED {link}")
            conditions += properties(link, edge[4])
            before, at = (edge[1], link, name, edge[5]), edge.end()
            while at < len(path) and path[at].isspace():
                at += 1
    if where:
        conditions.append(f"({expression(where)})")
    chosen = []
    for item in re.split(r",(?![^(\[]*[)\]])", items):
        item = item.strip()
        name = re.fullmatch(rf"(.*?)\s+AS\s+({_NAME})", item, re.I | re.S)
        body = name[1] if name else item
        body = re.sub(rf"\bcount\s*\(\s*(distinct\s+)?({_NAME})\s*\)", lambda m: f"count({m[1] or ''}{m[2]}.block_id)" if m[2] in nodes else m[0], body, flags=re.I)
        if body in nodes:
            chosen.append(f"{body}.*")
        elif name:
            chosen.append(f"{expression(body)} AS {name[2]}")
        else:
            chosen.append(f"{expression(body)} AS `{show(item, literals).replace('`', '')}`")
    sql = f"SELECT {distinct or ''}{', '.join(chosen)} FROM {' CROSS JOIN '.join(sources)}"
    sql += f" WHERE {' AND '.join(conditions)}" if conditions else ""
    sql += f" ORDER BY {expression(order)}" if order else ""
    sql += f" LIMIT {limit}" if limit else ""
    return show(sql, literals)
