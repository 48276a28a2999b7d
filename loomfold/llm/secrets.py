"""Secret scans by assignment-aware lexing.

Three base patterns find key-like spans anywhere.  The lexer reads source and configuration syntax
into name-literal pairs (``name = "..."``, ``"name": ...``, ``name => ...``, ``name := ...``, typed and
exported forms, parts joined by ``+`` or ``.``), follows constants from name to name, and scores each
literal by how sensitive the names are that it reaches.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from loomfold.llm.common import as_bytes, free_name, map_columns

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "literal")

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_STEMS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_IS_HEX = bytes(49 if chr(i) in "0123456789abcdef" else 48 for i in range(256))


@dataclass(frozen=True)
class SecretRules:
    """Lengths of the base patterns, and how the lexer scores.

    ``names``: weight of a word in a target's name; ``harmless`` words take that much away.
    A literal counts from ``least`` on: the weight of its name plus what its own letters say.
    """
    assign_chars: int = 6
    access_chars: int = 20
    hex_chars: int = 24
    literal_chars: int = 8
    least: float = 4.0
    names: dict = field(default_factory=lambda: {
        "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "credential": 3.0, "credentials": 3.0, "apikey": 3.0,
        "token": 2.5, "bearer": 2.0, "auth": 2.0, "private": 1.5, "access": 1.0, "api": 1.0, "key": 1.5, "signing": 1.0, "encryption": 1.0, "client": 0.5})
    harmless: dict = field(default_factory=lambda: {
        "public": 2.0, "path": 2.0, "file": 2.0, "url": 2.0, "uri": 2.0, "name": 1.5, "field": 1.5, "label": 2.0, "count": 2.0, "length": 2.0, "hint": 2.0,
        "type": 1.5, "id": 1.0, "regex": 2.0, "pattern": 2.0, "primary": 2.0, "foreign": 2.0, "sort": 2.0, "format": 2.0})


def base_spans(text: bytes, rules: SecretRules) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, in bytes."""
    found = []
    low = text.lower()
    if any(stem in low for stem in _STEMS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= rules.assign_chars]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= rules.access_chars]
    marks, run = text.translate(_IS_HEX), b"1" * rules.hex_chars
    at = marks.find(run)
    while at >= 0:
        end = marks.find(b"0", at)
        end = len(marks) if end < 0 else end
        found.append((at, end, 2))
        at = marks.find(run, end)
    return found


_NAME = rb"[A-Za-z_$][A-Za-z0-9_$]*+(?:[.-][A-Za-z_$][A-Za-z0-9_$]*+)*"
#: ``name [: type] op``, where the name may be quoted or an element of a table (``x["name"]``).  A name
#: starts where no word is before it, so a long run of letters is read once.
_TARGET = re.compile(rb"""(?<![A-Za-z0-9_$])(?<![A-Za-z0-9_$][.-])(?:[0-9]++[.-]?)*+([A-Za-z_$][A-Za-z0-9_$]*+(?:[.-][0-9]*+[A-Za-z_$][A-Za-z0-9_$]*+)*+)["']?\]?[ \t]*+(?::[ \t]*+[A-Za-z_][\w.\[\]<>]*+[ \t]*+(?==[^=>])|)(:=|=>|=(?!=)|:(?!:|//))[ \t]*+""")
_PART = re.compile(rb"""(?:[rbfuRBFU]{0,2})(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)|\$\{?(""" + _NAME + rb""")\}?|(""" + _NAME + rb""")(?![\w(\[])|([A-Za-z0-9+/_.=~!@%^&*-]+)""")
_JOIN = re.compile(rb"""[ \t]*(?:\+|\.\.|\.|[ \t](?=["']))[ \t]*""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: How keys of a cloud's accounts start, in either case.
_KEY_FORM = re.compile(rb"(?i)^(?:AKIA|ASIA)[A-Z0-9]{8,}$")
#: Literals that stand for a secret and are none.
_STAND_INS = re.compile(rb"(?i)^(?:true|false|null|none|undefined|nil|test|todo|change[-_ ]?me|example.*|sample.*|dummy.*|placeholder.*|your[-_ ].*|x{3,}|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s)$")


def name_weight(name: str, rules: SecretRules) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    return sum(rules.names.get(w, 0.0) - rules.harmless.get(w, 0.0) for w in words)


def literal_weight(value: bytes, rules: SecretRules) -> float:
    """What a literal's own letters say: the form of an access key, mixed classes and high entropy speak for a secret, spaces and stand-ins against."""
    if len(value) < rules.literal_chars or _STAND_INS.match(value) or any(c in value for c in b" \t") or b"://" in value:
        return -math.inf
    counts = Counter(value).values() if len(value) <= 4096 else [n for n in np.bincount(np.frombuffer(value, np.uint8)).tolist() if n]
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in counts)
    classes = sum(bool(re.search(p, value)) for p in (rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[^A-Za-z0-9]"))
    known = 1.5 if _KEY_FORM.match(value) else 0.0
    return known + (0.5 if classes >= 2 else -0.5) + (0.5 if classes >= 3 else 0.0) + (1.0 if entropy >= 3.0 else 0.0 if entropy >= 2.5 else -1.0)


def lexed_pairs(text: bytes) -> list[tuple[str, list]]:
    """Assignments in order: a name and the parts it gets, each ("text", start, end) or ("name", name)."""
    pairs, at = [], 0
    while m := _TARGET.search(text, at):
        parts, at = [], m.end()
        while part := _PART.match(text, at):
            quoted = next((g for g in (1, 2, 3) if part.group(g) is not None), 0)
            if quoted:
                parts.append(("text", part.start(quoted), part.end(quoted)))
            elif part.group(4) or part.group(5):
                g = 4 if part.group(4) else 5
                parts.append(("name", part.group(g).decode("latin-1"), part.start(g), part.end(g)))
            else:
                parts.append(("text", part.start(6), part.end(6)))
            at = part.end()
            join = _JOIN.match(text, at)
            if not join or not quoted and b"+" not in join.group() and b".." not in join.group():
                break
            at = join.end()
        if parts:
            pairs.append((m.group(1).decode("latin-1"), parts))
        at = max(at, m.end())
    return pairs


def _resolved(pairs: list[tuple[str, list]]) -> list[tuple[list[list], list[bool]]]:
    """What each pair is made of: spans, and numbers of the pairs that its names stand for.

    A name stands for its last value before.  Where there is none, it is a bare word in the first
    reading and its next value after in the second, which comes with the pairs that it changes.
    """
    known, missing, first = {}, [], []
    for i, (name, parts) in enumerate(pairs):
        made = []
        for part in parts:
            if part[0] == "text":
                made.append(part[1:])
            elif part[1] in known:
                made.append(known[part[1]])
            else:
                missing.append((i, len(made), part[1]))
                made.append(part[2:] if len(parts) == 1 else None)            # a bare word of a configuration file
        first.append([x for x in made if x is not None])
        if first[i]:
            known[name] = i
    after, later, at = {}, {}, len(pairs)
    for i, k, name in reversed(missing):
        while at > i + 1:
            at -= 1
            after[pairs[at][0]] = at
        if name in after and name != pairs[i][0]:
            later[i, k] = after[name]
    if not later:
        return [(first, [])]
    known, second, changed = {}, [], []
    for i, (name, parts) in enumerate(pairs):
        made = []
        for k, part in enumerate(parts):
            if part[0] == "text":
                made.append(part[1:])
            elif part[1] in known:
                made.append(known[part[1]])
            elif (i, k) in later:
                made.append(later[i, k])
            elif len(parts) == 1:
                made.append(part[2:])
        second.append(made)
        changed.append(any((i, k) in later for k in range(len(parts))) or any(changed[x] for x in made if isinstance(x, int) and x < i) or made != first[i])
        if made:
            known[name] = i
    return [(first, []), (second, changed)]


def _reached(some: list[int], made: list[list]) -> list[tuple[int, int]]:
    """The different spans that pairs are made of, in order; each pair on the way is opened once."""
    spans, seen, todo = {}, set(), some[::-1]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            spans[x] = None
        elif x not in seen:
            seen.add(x)
            todo += reversed(made[x])
    return list(spans)


def literal_spans(text: bytes, rules: SecretRules) -> list[tuple[int, int, int]]:
    """Literals that reach a sensitive name, directly or through constants (byte offsets)."""
    if b"=" not in text and b":" not in text:
        return []
    pairs = lexed_pairs(text)
    weights = [name_weight(name, rules) for name, _ in pairs]
    found = set()
    if any(w > 0 for w in weights):
        for made, changed in _resolved(pairs):
            held, sure = {}, []
            for i, weight in enumerate(weights):
                if weight <= 0 or changed and not changed[i]:
                    continue
                ref = made[i][0] if made[i] and not changed else None
                if isinstance(ref, int) and ref in held and all(isinstance(x, tuple) for x in made[i][1:]):
                    value = held.pop(ref) + b"".join(text[a:b] for a, b in made[i][1:])   # longer by its own literals
                else:
                    value = b"".join(text[a:b] for a, b in _reached([i], made))
                held[i] = value
                if len(held) > 64:
                    held.pop(next(iter(held)))                                # joined again when it is needed
                if weight + literal_weight(value, rules) >= rules.least:
                    sure.append(i)
            found.update(s for s in _reached(sure, made) if s[1] > s[0])
    return [(a, b, 3) for a, b in found]


def spans_of(text: bytes, rules: SecretRules) -> list[tuple[int, int, int]]:
    """All spans in code points by start, then kind; a literal inside a base span is not told again."""
    base = base_spans(text, rules)
    starts, ends = [], []
    for a, b, _ in sorted(base):                                              # the furthest end of the spans up to each start
        starts.append(a)
        ends.append(max(b, ends[-1] if ends else 0))
    inside = lambda a, b: (k := bisect_right(starts, a)) > 0 and b <= ends[k - 1]
    more = [s for s in literal_spans(text, rules) if not inside(s[0], s[1])]
    spans = sorted(base + more, key=lambda s: (s[0], s[2], s[1]))
    if not spans or text.isascii():
        return spans
    cuts = sorted({x for a, b, _ in spans for x in (a, b)})
    chars, at, n = {}, 0, 0
    for cut in cuts:
        n += sum((c & 0xC0) != 0x80 for c in text[at:cut])
        chars[cut], at = n, cut
    return [(chars[a], chars[b], k) for a, b, k in spans]


SPANS = "array<struct<kind: string, start: int, end: int>>"


def scan(docs: DataFrame, rules: SecretRules = SecretRules(), text: str = "text", keep: list[str] | None = None, out: str = "secrets") -> DataFrame:
    """The columns in ``keep`` (all by default) and ``out``: every span found in the whole text.

    Null and empty texts have no spans.  Repeated rows are scanned each; spans of different kinds
    may overlap and start together, and are then listed in the order of KINDS.  An empty table
    gives an empty one; other columns pass through whatever their names.
    """
    wanted = docs.columns if keep is None else keep
    names = {c: f"_c{i}" for i, c in enumerate(wanted)}
    source = docs.select(*[docs[c].alias(n) for c, n in names.items()], as_bytes(docs, text).alias("_bytes"))

    def make():
        def step(batch):
            return {"_spans": [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans_of(t, rules)] for t in batch.column("_bytes").to_pylist()]}
        return step

    found = map_columns(source, f"_spans {SPANS}", make, list(names.values()))
    return found.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("_spans").alias(out if keep is not None else free_name(docs, out)))


def redact(docs: DataFrame, rules: SecretRules = SecretRules(), text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced; overlapping spans are replaced as one.  Null texts stay null."""
    out = free_name(docs, "_secrets")
    found = scan(docs, rules, text, out=out)
    merged = F.aggregate(F.col(out), F.array().cast("array<struct<a: int, b: int>>"), lambda seen, s: F.when(
        (F.size(seen) > 0) & (F.element_at(seen, -1)["b"] > s["start"]),
        F.concat(F.slice(seen, F.lit(1), F.size(seen) - 1), F.array(F.struct(F.element_at(seen, -1)["a"].alias("a"), F.greatest(F.element_at(seen, -1)["b"], s["end"]).alias("b")))),
    ).otherwise(F.concat(seen, F.array(F.struct(s["start"].alias("a"), s["end"].alias("b"))))))
    spans = F.sort_array(merged, asc=False)                                    # from the end, so earlier offsets stay right
    clean = F.aggregate(spans, F.col(text), lambda t, s: F.concat(F.substring(t, F.lit(1), s["a"]), F.lit(mask), F.substring(t, s["b"] + 1, F.length(t))))
    return found.withColumn(text, F.when(F.size(out) > 0, clean).otherwise(F.col(text))).drop(out)
