"""Secret scans with one combined deterministic automaton.

All rules are compiled together: regular expression -> nondeterministic automaton ->
subset construction -> minimised transition array over byte classes. One pass over the
bytes of a text notes where a match of any rule ends; a small reversed automaton of the
rule then walks back from that end to the leftmost start.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_column


@dataclass(frozen=True)
class Rule:
    """``head`` then ``tail``; a rule's tail ends in a repeated class, so that a match goes
    as far as the class does. ``least`` is the least length of a match that is kept,
    ``least_tail`` that of its part behind the head."""
    kind: str
    head: str
    tail: str
    least: int = 0
    least_tail: int = 0


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# The base rules as they are given, in their order.
BASE = (
    Rule("assign", "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", least_tail=6),
    Rule("access", "AKIA", "[A-Z0-9]+", least=20),
    Rule("hex", "", "[0-9a-f]{6,}", least=24),  # shorter runs never count; few states suffice to skip most
)
MORE = (
    Rule("forge", "gh[pousr]_", "[A-Za-z0-9]+", least=40),
    Rule("payment", "[sr]k_live_", "[A-Za-z0-9]+", least=24),
    Rule("chat", "xox[abeprs]-", "[A-Za-z0-9-]+", least=20),
    Rule("web_token", "eyJ", "[A-Za-z0-9_.-]+", least=60),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY", "-+", least_tail=5),
)
RULES = BASE + MORE


# --- regular expressions to automata ---------------------------------------------------

class _Reader:
    """Literals, escapes, classes, groups, ``|``, ``? * +`` and ``{n,}``."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def either(self):
        options = [self.chain()]
        while self.peek() == "|":
            self.take()
            options.append(self.chain())
        return options[0] if len(options) == 1 else ("or", options)

    def chain(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("then", parts)

    def repeated(self, node):
        c = self.peek()
        if c and c in "?*+":
            self.take()
            return {"?": ("or", [node, ("then", [])]), "*": ("many", node), "+": ("then", [node, ("many", node)])}[c]
        if c == "{":
            n = int(self.p[self.i + 1:self.p.index(",}", self.i)])
            self.i = self.p.index("}", self.i) + 1
            return ("then", [node] * n + [("many", node)])
        return node

    def byte(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2:self.i], 16)
        return ord(c)

    def atom(self):
        c = self.peek()
        if c == "(":
            self.take()
            node = self.either()
            self.take()
            return node
        if c == "[":
            self.take()
            held = set()
            while self.peek() != "]":
                low = self.byte()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.take()
                    held.update(range(low, self.byte() + 1))
                else:
                    held.add(low)
            self.take()
            return ("set", frozenset(held))
        return ("set", frozenset([self.byte()]))


def _turned(node):
    """The expression of the reversed words."""
    if node[0] == "then":
        return ("then", [_turned(x) for x in reversed(node[1])])
    if node[0] == "or":
        return ("or", [_turned(x) for x in node[1]])
    return ("many", _turned(node[1])) if node[0] == "many" else node


class _Net:
    """A nondeterministic automaton: free moves and byte moves."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.move: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.move.append(None)
        return len(self.free) - 1

    def add(self, node, start: int) -> int:
        """Lay ``node`` behind ``start``; the state behind it."""
        if node[0] == "set":
            end = self.state()
            mid = self.state()
            self.free[start].append(mid)
            self.move[mid] = (node[1], end)
            return end
        if node[0] == "then":
            for x in node[1]:
                start = self.add(x, start)
            return start
        end = self.state()
        if node[0] == "or":
            for x in node[1]:
                self.free[self.add(x, start)].append(end)
            return end
        loop = self.state()
        self.free[start].append(loop)
        self.free[self.add(node[1], loop)].append(loop)
        self.free[loop].append(end)
        return end

    def closed(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if self.move[x] or not self.free[x])


@dataclass(frozen=True)
class Automaton:
    """``classes`` maps a byte to its class, ``step[state * width + class]`` is the next
    state, already times ``width``; accepting states come last, from ``first`` on.
    ``marks[state / width]`` has a bit for each rule that ends there. State 0 starts."""
    classes: bytes
    width: int
    step: tuple[int, ...]
    first: int
    marks: tuple[int, ...]
    dead: int


def automaton(trees: list, anywhere: bool) -> Automaton:
    """The minimal automaton of all ``trees``; ``anywhere``: a match may start at any byte."""
    net = _Net()
    starts, ends = [], {}
    for k, tree in enumerate(trees):
        starts.append(net.state())
        ends[net.add(tree, starts[-1])] = k
    sets = {m[0] for m in net.move if m}
    signature = [tuple(b in s for s in sets) for b in range(256)]
    names = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    classes = bytes(names[s] for s in signature)
    sample = [signature.index(s) for s in names]
    width = len(names)
    begin = net.closed(starts)
    index, table, queue = {begin: 0}, [], [begin]
    for now in queue:
        row = []
        for b in sample:
            to = {net.move[x][1] for x in now if net.move[x] and b in net.move[x][0]}
            to = net.closed(to | set(starts) if anywhere else to)
            if to not in index:
                index[to] = len(index)
                queue.append(to)
            row.append(index[to])
        table.append(row)
    marks = [sum(1 << ends[x] for x in s if x in ends) for s in queue]
    # minimisation: split blocks until all states of a block move alike
    block, n = marks, -1
    while True:
        keys: dict = {}
        block = [keys.setdefault((block[s], *(block[t] for t in table[s])), len(keys)) for s in range(len(table))]
        if len(keys) == n:
            break
        n = len(keys)
    head = [block.index(k) for k in range(n)]
    order = sorted(range(n), key=lambda k: (marks[head[k]] > 0, k != block[0], k))
    place = {k: i for i, k in enumerate(order)}
    step = tuple(place[block[t]] * width for k in order for t in table[head[k]])
    own = tuple(marks[head[k]] for k in order)
    dead = next((i * width for i in range(n) if not own[i] and all(step[i * width + c] == i * width for c in range(width))), -1)
    return Automaton(classes, width, step, sum(m == 0 for m in own) * width, own, dead)


class Scanner:
    """All rules in one automaton, and each rule's way back to its start."""

    def __init__(self, rules=RULES):
        self.rules = tuple(rules)
        trees = [_Reader(r.head + r.tail).either() for r in self.rules]
        self.all = automaton(trees, anywhere=True)
        self.back = [automaton([_turned(t)], anywhere=False) for t in trees]
        self.heads = [automaton([_Reader(r.head).either()], anywhere=False) for r in self.rules]

    def ends(self, data: bytes) -> list[list[int]]:
        """Where matches of each rule end: one pass over the bytes."""
        step, first, width, marks = self.all.step, self.all.first, self.all.width, self.all.marks
        found: list[list[int]] = [[] for _ in self.rules]
        s = 0
        for i, c in enumerate(data.translate(self.all.classes)):
            s = step[s + c]
            if s >= first:
                mark, k = marks[s // width], 0
                while mark:
                    if mark & 1:
                        own = found[k]
                        if own and own[-1] == i:  # the match goes on
                            own[-1] = i + 1
                        else:
                            own.append(i + 1)
                    mark >>= 1
                    k += 1
        return found

    @staticmethod
    def _longest(a: Automaton, data, least: int = 0) -> int:
        """The length of the longest prefix of ``data`` that ``a`` accepts."""
        s, best = 0, 0
        for i, b in enumerate(data):
            s = a.step[s + a.classes[b]]
            if s == a.dead:
                break
            if s >= a.first:
                best = i + 1
        return best

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in code points, sorted: leftmost matches of each rule
        that don't overlap one another, without those that are too short."""
        data = text.encode("utf-8", "surrogatepass")
        raw = []
        for k, ends in enumerate(self.ends(data)):
            rule, since = self.rules[k], 0
            for end in ends:
                size = self._longest(self.back[k], memoryview(data)[since:end][::-1])
                if not size:
                    continue
                start, since = end - size, end
                if size >= rule.least and (not rule.least_tail or size - self._longest(self.heads[k], memoryview(data)[start:end]) >= rule.least_tail):
                    raw.append((start, k, end))
        if len(data) == len(text) or not raw:
            return sorted(raw)
        at, points, last = {}, 0, 0
        for b in sorted({x for s, _, e in raw for x in (s, e)}):
            points += len(data[last:b].decode("utf-8", "surrogatepass"))
            at[b] = points
            last = b
        return sorted((at[s], k, at[e]) for s, k, e in raw)


def joined(rules, spans) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans)


def digest_column(spark, rules=RULES, n_base: int = len(BASE)):
    """text -> struct of counts of the base rules, their digest, and all spans."""
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules[:n_base]]
    fields = [(f"n_{k}", pa.int64()) for k in kinds] + [("base_sha256", pa.string()), ("spans", pa.string())]

    def run(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n, _ in fields}
        for t in texts:
            spans = scanner.spans(t)
            base = [x for x in spans if x[1] < n_base]
            for k, kind in enumerate(kinds):
                out[f"n_{kind}"].append(sum(x[1] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(joined(rules, base).encode()).hexdigest())
            out["spans"].append(joined(rules, spans))
        return out

    return text_column(run, fields, spark, ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in fields))


def scan(documents: DataFrame, rules=RULES, n_base: int = len(BASE)) -> DataFrame:
    """doc_id, counts per base kind, digest of the base spans and all spans, for every row.

    Null and empty texts have no span (the digest is that of empty text). Repeated rows
    and null ids give one row each; other columns are not read.
    """
    found = documents.select("doc_id", digest_column(documents.sparkSession, rules, n_base)("text").alias("_r"))
    return found.select("doc_id", "_r.*")


def redacted(documents: DataFrame, mark: str = "[SECRET]", rules=RULES) -> DataFrame:
    """The same rows and columns with every span's text replaced by ``mark`` (spans that
    overlap share one mark) and ``n_chars``, where there is one, counted anew."""
    scanner = Scanner(rules)

    def run(texts: list[str]) -> dict[str, list]:
        out = []
        for t in texts:
            parts, at = [], 0
            for s, _, e in scanner.spans(t):
                if s >= at:
                    parts += [t[at:s], mark]
                at = max(at, e)
            out.append("".join(parts) + t[at:] if parts else t)
        return {"text": out}

    clean = text_column(run, [("text", pa.string())], documents.sparkSession, "text string")
    out = documents.withColumn("text", F.when(F.col("text").isNotNull(), clean("text")["text"]))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out


def oracle(rules=RULES, n_base: int = len(BASE)) -> str:
    """The same rows in SQL: each rule's matches by its expression, their places from the
    lengths of the matches and of the gaps between them."""
    parts, names = [], []
    for k, r in enumerate(rules):
        full, head = (x.replace("'", "''") for x in (f"({r.head})({r.tail})", r.head))
        kept = f"length(m[i]) >= {r.least}"
        if r.least_tail:
            kept += f" AND length(regexp_extract(m[i], '{full}', {2 if '(' not in r.head else 3})) >= {r.least_tail}"
        parts.append(f"""k{k} AS (SELECT rid, [{{'s': CAST(coalesce(list_sum([length(x) FOR x IN g[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN m[1:i-1]]), 0) AS BIGINT),
 'k': {k}, 'e': CAST(coalesce(list_sum([length(x) FOR x IN g[1:i]]), 0) + list_sum([length(x) FOR x IN m[1:i]]) AS BIGINT)}} FOR i IN range(1, len(m) + 1) IF {kept}] AS f
 FROM (SELECT rid, regexp_extract_all(t, '{full}') AS m, regexp_split_to_array(t, '{full}') AS g FROM d))""")
        names.append(r.kind)
    kinds = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    text = lambda x: f"coalesce(array_to_string([{kinds}[v.k + 1] || ':' || v.s || ':' || v.e FOR v IN {x}], ','), '')"
    base = "list_sort(list_concat(" + ", ".join(f"k{k}.f" for k in range(n_base)) + "))"
    every = "list_sort(list_concat(" + ", ".join(f"k{k}.f" for k in range(len(rules))) + "))"
    joins = " ".join(f"JOIN k{k} USING (rid)" for k in range(len(rules)))
    counts = ", ".join(f"CAST(len(k{k}.f) AS BIGINT) AS n_{names[k]}" for k in range(n_base))
    return (f"WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), {', '.join(parts)} "
            f"SELECT doc_id, {counts}, sha256({text(base)}) AS base_sha256, {text(every)} AS spans FROM d {joins}")
