"""Assignment-aware secret scan.

Three fixed patterns give the base spans.  On top, a text is lexed (strings of all kinds,
comments, names, brackets, operators) and read into name-literal pairs in source or configuration
syntax: ``name = "x" + other``, ``name: type = "x"``, ``"name": "x"``, ``name: x``, ``name := x``,
``name => x``, ``obj["name"] = x``, ``f(name="x")``, ``name = f("x")``, ``<name>x</name>``, and YAML
block scalars.  Constants are carried to the names assigned from them until they are assigned something
else; a literal is reported as kind ``lex`` when a sensitive name receives it and it looks like a
credential.  Comparisons and comments assign nothing.

A statement ends with its line, unless a bracket is open or a ``+``, ``..`` or backslash goes on; a blank
line ends everything.  Lexing is one pass, linear in the text, and holds the literals of one text.

Defined results: a null or empty text has no spans; very long texts, names and literals are read whole;
repeated rows give equal rows; spans at one start are ordered assign, access, hex, lex; a literal that
overlaps a base span is not reported again; an empty table gives an empty result; other
columns are not read, whatever their names.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame

from siltstone.llm.common import per_document

KINDS = ("assign", "access", "hex", "lex")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: One of these is in every sensitive name, and in every base assignment.
_HINTS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "private", "signature", "salt")
_ANY_OPERATOR = re.compile(r"[=:]|</")
_TOKEN = re.compile(
    r"""(?P<comment>(?<!\S)\#[^\n]*|(?<!:)//[^\n]*|(?<!\w)/\*|<!--|(?:(?<=\n)|\A)[ \t]*+(?:--|;)[^\n]*)
    |(?P<skip>[ \t\r\f\v]+|\\\r?\n)
    |(?P<line>\n)
    |(?P<quote>(?<!\w)(?:[rRbBuUfF]{1,2}|[@$])?(?:\"{3}|'{3}|["'`]))
    |(?P<name>(?:[^\W\d]|\$)[\w$]*(?:[.\-][\w$]+)*)
    |(?P<number>[0-9][\w.]*)
    |(?P<compare>===?|!==?|<=|>=|=~|!~|<>)
    |(?P<assign>:=|\+=|=>|=|:(?![:/]))
    |(?P<open>[(\[{])|(?P<close>[)\]}])
    |(?P<plus>\+|\.\.)
    |(?P<end>[,;])
    |(?P<other>::|&'\w+(?!')|.)""",
    re.X | re.S,
)
#: What closes a string of each kind; the first four end with their line.
_BODY = {
    '"': re.compile(r'((?:[^"\\\n]|\\.)*)"', re.S), "'": re.compile(r"((?:[^'\\\n]|\\.)*)'", re.S),
    "`": re.compile(r"((?:[^`\\]|\\.)*)`", re.S), '"""': re.compile(r'((?:[^"\\]|\\.|"(?!""))*)"""', re.S),
    "'''": re.compile(r"((?:[^'\\]|\\.|'(?!''))*)'{3}", re.S),
}
_BARE = re.compile(r"[ \t]*+([A-Za-z0-9_+/.=@$%&*!~^\-]++)(?![(\[{:])")
#: Words alone in a call's argument name something; they are no credential.
_PLAIN = re.compile(r"[^\W\d_]+(?:[_\-. /:]+[^\W\d_]+)*[_\-. /:]*")
_BLANK = re.compile(r"[ \t\r]*(?:\n|\Z)")
_GOES_ON = re.compile(r"[ \t]*(?:\+|\.\.)(?!=)[ \t]*(?![ \t]|[A-Za-z_][A-Za-z0-9_.\-]*[\"']?[ \t]*[:=])")
_QUOTED = re.compile(r"[ \t]*[rRbBuUfF@$]{0,2}[\"'`]")
_TYPE = re.compile(r"[ \t]*+(?:&'\w+[ \t]+)?([^\n\"'`=;{}()]*+)(=(?![=>]))?")
_SCALAR = re.compile(r"[ \t]*[|>][+-]?[0-9]?[ \t]*(?:\#[^\n]*)?\r?\n")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:\-]*)(?:\s[^<>]*)?>([^<>]*)</\1\s*>")
#: Words (fixed values): statements whose colon assigns nothing, and comparisons spelled out.
_CONTROL = {"if", "else", "elif", "for", "while", "with", "def", "class", "try", "except", "finally", "case", "switch", "default", "lambda", "match"}
_COMPARES = {"is", "in", "eq", "ne"}
_SEGMENT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME = re.compile(r"[A-Za-z_][A-Za-z_.]*$")
#: Share of a full score that a part of a target's name gives (fixed values).
_SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.8, "secret": 1.0, "token": 1.0,
    "apikey": 1.0, "credential": 1.0, "credentials": 1.0, "cred": 0.8, "auth": 0.7, "bearer": 0.8,
    "private": 0.6, "signature": 0.6, "salt": 0.6, "key": 0.6,
}
_PLACEHOLDER = re.compile(r"(?i)example|changeme|placeholder|dummy|redacted|your|x{4,}|\*{3,}|<.*>|\$\{.*\}|%\(.*\)")
_PAIRS = (("<", ">"), ("${", "}"), ("%(", ")"))


def target_score(name: str) -> float:
    """How sensitive a target's name is, 0 to 1; two weak parts add up."""
    parts = [x.lower() for x in _SEGMENT.findall(name)]
    return min(1.0, sum(_SENSITIVE.get(x, 0.0) for x in parts))


def hinted(text: str) -> bool:
    """Whether a sensitive name may occur at all; most texts have none and need no lexing."""
    low = text.lower()
    return any(x in low for x in _HINTS)


class Value:
    """A literal, or a concatenation of values, with what scoring needs of its text; parts are shared, not copied."""

    def __init__(self, text: str = "", span: tuple[int, int] | None = None, parts: tuple[Value, ...] = ()) -> None:
        self.span, self.parts = span, parts
        self.counts = Counter(text)
        self.head, self.tail = text[:16], text[-16:]
        self.opens = {i for i, (a, _) in enumerate(_PAIRS) if a in text}
        self.closes = {i for i, (_, b) in enumerate(_PAIRS) if b in text}
        self.barred = _PLACEHOLDER.search(text) is not None
        self.pem = "-----BEGIN" in text
        for x in parts:
            seam = self.tail + x.head
            self.barred |= x.barred or bool(self.opens & x.closes) or _PLACEHOLDER.search(seam) is not None
            self.pem |= x.pem or "-----BEGIN" in seam
            self.opens |= x.opens | {i for i, (a, _) in enumerate(_PAIRS) if a in seam}
            self.closes |= x.closes
            self.counts.update(x.counts)
            self.head, self.tail = (self.head + x.head)[:16], (self.tail + x.tail)[-16:]

    def score(self, weight: float) -> float:
        """How much the value looks like a credential, 0 to 1; one with blanks needs a plainly sensitive name or a PEM mark."""
        counts, size = self.counts, sum(self.counts.values())
        if size < 8 or self.barred or " " in counts and weight < 1 and not self.pem:
            return 0.0
        bits = -sum(n / size * math.log2(n / size) for n in counts.values())
        classes = len({"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "-" for c in counts})
        return min(1.0, bits / 4) * (1.0 if classes >= 2 else 0.5)


class _Frame:
    """An open assignment: its target's names, the bracket depth it began at, and its values (concatenations) so far."""

    def __init__(self, names: list[str], pair: bool, depth: int, grows: bool) -> None:
        self.names, self.pair, self.depth, self.grows = names, pair, depth, grows
        self.units: list[list[Value]] = [[]]
        self.asked = self.compared = False

    def add(self, value: Value) -> None:
        self.units[-1].append(value)

    def next_unit(self) -> None:
        if self.units[-1]:
            self.units.append([])


class _Reader:
    """One pass over ``text[low:high]``; ``found`` gets spans, ``inner`` strings that hold assignments of their own."""

    def __init__(self, text: str, low: int, high: int, threshold: float, found: set[tuple[int, int]], inner: list[tuple[int, int]]) -> None:
        self.text, self.at, self.high, self.threshold, self.found, self.inner = text, low, high, threshold, found, inner
        self.known: dict[str, Value] = {}
        self.reported: set[Value] = set()
        self.frames: list[_Frame] = []
        self.brackets: list[tuple[str, bool, str]] = []  # sign, whether a call's, the name before it
        self.unclosed: dict[str, int] = {}
        self.untyped = -1
        self.restart()

    def restart(self) -> None:
        """A statement begins."""
        self.first = ""
        self.names: list[str] = []  # the names in a row just read, or the key
        self.run = 0  # how many of them are names in a row
        self.added: Value | None = None
        self.plus = False

    def read(self) -> None:
        while self.at < self.high:
            match = _TOKEN.match(self.text, self.at, self.high)
            self.at = match.end()
            if match.lastgroup != "skip":
                getattr(self, "on_" + match.lastgroup)(match[0])
        self.close(-1)

    def close(self, depth: int) -> None:
        """Close the assignments that began at more than ``depth`` brackets."""
        while self.frames and self.frames[-1].depth > depth:
            frame = self.frames.pop()
            name, weight = frame.names[0], max(map(target_score, frame.names))
            units = [u[0] if len(u) == 1 else Value(parts=tuple(u)) for u in frame.units if u]
            whole = None if not units else units[0] if len(units) == 1 else Value(parts=tuple(units))
            if whole and frame.grows and name in self.known:
                whole = Value(parts=(self.known[name], whole))
                units = [whole]
            for value in units:
                if weight and weight * value.score(weight) >= self.threshold:
                    self.report(value)
            if whole:
                self.known[name] = whole
            elif not frame.grows:
                self.known.pop(name, None)
            # an argument or a chained assignment reaches the outer target; an entry of a map has a name of its own
            if whole and self.frames and not frame.pair:
                self.frames[-1].add(whole)

    def report(self, value: Value) -> None:
        todo = [value]
        while todo:
            value = todo.pop()
            if value not in self.reported:
                self.reported.add(value)
                todo.extend(value.parts)
                if value.span:
                    self.found.add(value.span)

    def term(self, value: Value) -> None:
        """A literal or a constant, for the open assignment if there is one."""
        self.added = None
        if self.frames:
            frame = self.frames[-1]
            if frame.compared:
                frame.compared = False
            else:
                frame.add(value)
                self.added = value

    def on_line(self, _: str) -> None:
        depth = len(self.brackets)
        if _BLANK.match(self.text, self.at, self.high):
            self.close(-1)
            self.brackets.clear()
        elif self.frames:
            frame = self.frames[-1]
            if frame.depth < depth or depth and self.brackets[-1][0] != "{" or self.plus or _GOES_ON.match(self.text, self.at, self.high):
                return
            if not frame.pair and not any(frame.units) and _QUOTED.match(self.text, self.at, self.high):
                return
            self.close(depth - 1)
        self.restart()

    def on_comment(self, token: str) -> None:
        if token in ("/*", "<!--"):
            mark = "*/" if token == "/*" else "-->"
            end = self.text.find(mark, self.at, self.high) if self.unclosed.get(token) is None else -1
            if end < 0:
                self.unclosed[token] = self.high
            else:
                self.at = end + len(mark)

    def on_quote(self, token: str) -> None:
        mark = token.lstrip("rRbBuUfF@$")
        if mark == "`" and not self.frames or self.at <= self.unclosed.get(mark, -1):
            return
        body = _BODY[mark].match(self.text, self.at, self.high)
        if not body:
            # nothing closes it: no string, and none of its kind before this line's (or the text's) end
            end = self.text.find("\n", self.at, self.high) if len(mark) == 1 and mark != "`" else -1
            self.unclosed[mark] = self.high if end < 0 else end
            return
        self.at = body.end()
        text = body[1]
        if _ANY_OPERATOR.search(text) and hinted(text):
            self.inner.append(body.span(1))
        self.names, self.run, self.plus = [text], 0, False
        if self.frames and self.frames[-1].depth < len(self.brackets) and self.brackets[-1][1] and _PLAIN.fullmatch(text):
            self.added = None
        else:
            self.term(Value(text, body.span(1)))

    def on_name(self, token: str) -> None:
        if token in _COMPARES and self.frames:
            self.on_compare(token)
            return
        self.first = self.first or token
        self.names = [*self.names, token][-3:] if self.run else [token]
        self.run += 1
        self.plus, self.added = False, None
        if token in self.known:
            self.term(self.known[token])

    def on_number(self, _: str) -> None:
        self.names, self.run, self.plus, self.added = [], 0, False, None

    def on_compare(self, _: str) -> None:
        if self.frames:
            frame = self.frames[-1]
            if self.added is not None and frame.units[-1] and frame.units[-1][-1] is self.added:
                frame.units[-1].pop()
            frame.compared = True
        self.on_number("")

    def on_plus(self, _: str) -> None:
        self.names, self.run, self.added = [], 0, None
        self.plus = True

    def on_other(self, token: str) -> None:
        if token == "?" and self.frames and not self.text.startswith((":", ",", ")", " ="), self.at):
            self.frames[-1].asked = True
        if token not in "?!\\\"'":
            self.on_number("")

    def on_end(self, token: str) -> None:
        depth = len(self.brackets)
        if token == ";" or self.frames and self.frames[-1].depth == depth:
            self.close(depth - 1)
        elif self.frames:
            self.frames[-1].next_unit()
        self.restart()

    def on_open(self, token: str) -> None:
        self.brackets.append((token, token == "(" and self.run > 0, self.names[-1] if self.run else ""))
        self.names, self.run, self.plus, self.added = [], 0, False, None

    def on_close(self, token: str) -> None:
        key = self.names[-1:]
        if not self.brackets:
            self.close(-1)
            self.restart()
            return
        sign, _, owner = self.brackets.pop()
        self.close(len(self.brackets))
        self.names, self.run, self.plus, self.added = [], 0, False, None
        if sign == "[" and token == "]":
            self.names = [*key, *([owner] if owner else [])]

    def on_assign(self, token: str) -> None:
        depth = len(self.brackets)
        top = self.frames[-1] if self.frames and self.frames[-1].depth == depth else None
        names = self.names[::-1] if not self.run else self.names[-1:]
        if self.run == 3 and self.names[0] in ("var", "const"):
            names = self.names[1:]
        if token == ":" and top and top.asked:
            top.asked = False
            top.next_unit()
            self.on_number("")
            return
        if token == ":" and self.first in _CONTROL and not top and not (depth and self.brackets[-1][0] == "("):
            self.restart()
            return
        if self.frames and self.added is not None and self.frames[-1].units[-1] and self.frames[-1].units[-1][-1] is self.added:
            self.frames[-1].units[-1].pop()  # a key or a target, no value
        self.restart()
        if token == "=" and top and top.pair and not any(top.units):
            # ``name: type = value``
            top.names += names
            top.pair = False
        elif names:
            self.frames.append(_Frame(names, token in (":", "=>"), depth, token == "+="))
        else:
            return
        self.value(token)

    def value(self, token: str) -> None:
        """Unquoted values just behind an assignment's sign, and block scalars."""
        if token == ":" and (block := _SCALAR.match(self.text, self.at, self.high)):
            line = self.text.rfind("\n", 0, self.at) + 1
            indent = len(self.text[line : self.at]) - len(self.text[line : self.at].lstrip(" \t"))
            low = end = block.end()
            while end < self.high:
                stop = self.text.find("\n", end, self.high)
                stop = self.high if stop < 0 else stop
                body = self.text[end:stop]
                if body.strip() and len(body) - len(body.lstrip(" \t")) <= indent:
                    break
                end = min(stop + 1, self.high)
            body = self.text[low:end]
            if body.strip():
                low += len(body) - len(body.lstrip())
                self.term(Value(body.strip(), (low, low + len(body.strip()))))
            self.at = end
            self.close(len(self.brackets) - 1)
            self.restart()
            return
        bare = _BARE.match(self.text, self.at, self.high)
        if not bare:
            return
        if token == ":" and bare.end() > self.untyped:
            kind = _TYPE.match(self.text, self.at, self.high)
            if kind[2]:
                return
            self.untyped = kind.end()  # no sign up to there, for later colons either
        if bare[1] in self.known:
            self.at = bare.end()
            self.term(self.known[bare[1]])
        elif not _NAME.match(bare[1]):
            self.at = bare.end()
            self.term(Value(bare[1], bare.span(1)))


def _elements(text: str, threshold: float, found: set[tuple[int, int]]) -> None:
    """``<name>literal</name>``, and ``<key>name</key><string>literal</string>``."""
    key, after = "", -1
    for m in _ELEMENT.finditer(text):
        name, body = m[1], m[2].strip()
        if key and text[after : m.start()].strip():
            key = ""
        names = [name, key] if key else [name]
        weight = max(map(target_score, names))
        low = m.start(2) + len(m[2]) - len(m[2].lstrip())
        if weight and name != "key" and weight * Value(body).score(weight) >= threshold:
            found.add((low, low + len(body)))
        key, after = (body, m.end()) if name in ("key", "name") else ("", -1)


def lexed(text: str, threshold: float = 0.5) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly or through constants."""
    if not hinted(text) or not _ANY_OPERATOR.search(text):
        return []
    found: set[tuple[int, int]] = set()
    todo = [(0, len(text))]
    while todo:
        low, high = todo.pop()
        _Reader(text, low, high, threshold, found, todo).read()
    _elements(text, threshold, found)
    return sorted(found)


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, kind number, end), in order."""
    named = hinted(text)
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if named else []
    spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base = sorted(spans)
    starts = [x[0] for x in base]
    reach = list(accumulate((x[2] for x in base), max))
    for a, b in lexed(text) if named else ():
        i = bisect_left(starts, b)
        if not i or reach[i - 1] <= a:
            spans.append((a, 3, b))
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per record: id, counts by kind, base_sha256, spans and the matched texts."""

    def run(texts: list[str]) -> dict[str, list]:
        all_spans = [find_secrets(t) for t in texts]
        out: dict[str, list] = {
            f"n_{name}": [sum(k == i for _, k, _ in s) for s in all_spans] for i, name in enumerate(KINDS)
        }
        base = [[x for x in s if x[1] < 3] for s in all_spans]
        out["base_sha256"] = [hashlib.sha256(joined(s).encode()).hexdigest() for s in base]
        out["spans"] = [joined(s) for s in all_spans]
        out["secrets"] = [[t[a:b] for a, _, b in s] for t, s in zip(texts, all_spans, strict=True)]
        return out

    schema = "n_assign long, n_access long, n_hex long, n_lex long, base_sha256 string, spans string, secrets array<string>"
    return per_document(df, id_col, text_col, schema, run)
