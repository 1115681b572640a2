"""Secret scans: three fixed patterns, and an assignment-aware reading of code and configuration.

The reading goes from every ``:``, ``=`` or closing tag to the name on its left and
the literal on its right (quoted, joined by ``+``, in triple quotes, an indented
block after ``|`` or ``>``, or bare), keeps literals as constants of the text, and
follows a bare name or ``${NAME}`` on the right to the constant that it stands for:
the nearest one before, or all that come later if there is none before.  A literal
is a secret when its name and its form together score ``THRESHOLD`` or more; of
several lines the one that scores most counts, and blanks are allowed in phrases.

Spans are ``kind:start:end`` in code points, end exclusive, over the whole match
(``assign``, ``access``, ``hex``) or the literal (``literal``), sorted by start and
then kind in this order.  A literal inside a base span is not listed again.

Edge cases: null and empty texts have no spans.  Ids are only carried.  Repeated
rows are scanned alike.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MASK = "[SECRET]"
THRESHOLD = 3.0

# Parts of names, with their weight; those of names whose values may hold blanks;
# parts that say the value is about a secret, not one; stand-ins.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.0, "apikey": 2.5, "credential": 2.5,
    "credentials": 2.5, "auth": 1.5, "bearer": 2.0, "private": 1.0, "access": 1.0, "signing": 1.0, "encryption": 1.0, "api": 1.0, "key": 1.0,
}
PHRASES = {"passphrase"}
ABOUT = {"count", "length", "len", "size", "max", "min", "num", "limit", "type", "name", "url", "path", "file", "field", "label", "hint", "ttl", "expiry"}
STAND_INS = re.compile(r"(?i)change_?me|example|placeholder|redacted|none|null|true|false|undefined|your[-_ ].*|x+|\*+|<.*>|\.+")

_MARK = re.compile(r"[:=]")
_LEFT = re.compile(r"""([A-Za-z_][A-Za-z0-9_.\-]*)["']?[ \t]*$""", re.A)
_QUOTED = re.compile(r"""(["'])((?:(?!\1)[^\\\n]|\\.)*)\1""")
_TRIPLE = re.compile(r"""(\"{3}|'{3})((?:[^\\]|\\.)*?)\1""", re.S)
_BLOCK = re.compile(r"[|>][-+0-9]{0,2}[ \t]*(?:#[^\n]*)?\r?\n")
_INDENT = re.compile(r"[ \t]*")
_PLUS = re.compile(r"[ \t]*\+[ \t]*(?=[\"'])")
_BARE = re.compile(r"""\$\{\w+\}|%\(\w+\)s|[^\s"'<>,;(){}\[\]#`]+""", re.A)
_REFERENCE = re.compile(r"(?:\$\{|\$|%\()?([A-Za-z_][A-Za-z0-9_]*)(?:\}|\)s)?", re.A)
_TAG = re.compile(r"<([A-Za-z_][\w.\-]*)>([^<>\n]+)</\1>", re.A)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

Span = tuple[int, int, int]
Literal = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the three patterns; matches that fail their length are dropped after matching."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _trimmed(text: str, start: int, end: int) -> Literal:
    """The literal between two places without the blanks at its ends."""
    value = text[start:end]
    start += len(value) - len(value.lstrip())
    return value.strip(), start, start + len(value.strip())


def _block(text: str, mark: int, at: int) -> Literal:
    """The lines from ``at`` on that are empty or further in than the line of ``mark``."""
    line, end = text.rfind("\n", 0, mark) + 1, at
    own = _INDENT.match(text, line).end() - line
    while end < len(text):
        stop = text.find("\n", end) + 1 or len(text)
        if text[end:stop].strip() and _INDENT.match(text, end).end() - end <= own:
            break
        end = stop
    return _trimmed(text, at, end)


def _literal(text: str, at: int, mark: int) -> tuple[Literal, bool] | None:
    """The literal at ``at``, right of ``mark``, and whether it is quoted; quoted parts joined by ``+`` are one."""
    while at < len(text) and text[at] in " \t":
        at += 1
    if m := _TRIPLE.match(text, at):
        return _trimmed(text, m.start(2), m.end(2)), True
    if text[mark] == ":" and (m := _BLOCK.match(text, at)):
        return _block(text, mark, m.end()), True
    if m := _QUOTED.match(text, at):
        value, start, end = m[2], m.start(2), m.end(2)
        while (plus := _PLUS.match(text, m.end())) and (m := _QUOTED.match(text, plus.end())):
            value, end = value + m[2], m.end(2)
        return (value, start, end), True
    m = _BARE.match(text, at)
    return ((m[0].rstrip(".:!?"), m.start(), m.start() + len(m[0].rstrip(".:!?"))), False) if m else None


def pairs(text: str) -> list[tuple[str, Literal, bool]]:
    """(name, literal, quoted) of every assignment in ``text``, in order."""
    found = []
    for m in _MARK.finditer(text):
        at, end = m.start(), m.end()
        if text[end:end + 1] in ("=", ">"):
            if m[0] == "=" and text[end] == "=":
                continue
            end += 1
        elif at and text[at - 1] in "=!<>:":
            continue
        left = _LEFT.search(text, max(0, at - 130), at)
        if left and (right := _literal(text, end, at)):
            found.append((left[1], *right))
    if "</" in text:
        found += [(m[1], (m[2].strip(), m.start(2), m.end(2)), True) for m in _TAG.finditer(text)]
    return sorted(found, key=lambda pair: pair[1][1])


def _parts(name: str) -> list[str]:
    return [p.lower() for p in _PARTS.findall(name)]


def name_score(name: str) -> float:
    parts = _parts(name)
    return 0.0 if ABOUT & {*parts} else sum({p: SENSITIVE.get(p, 0.0) for p in parts}.values())


def literal_score(value: str, blanks: bool = False) -> float:
    """How much a literal looks made by chance: length, spread of characters, kinds of characters; ``blanks`` may be in it."""
    if "\n" in value:
        return max(literal_score(line.strip(), blanks) for line in value.split("\n"))
    if len(value) < 6 or STAND_INS.fullmatch(value) or not blanks and " " in value.strip():
        return -9.0
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    kinds = sum(any(f(c) for c in value) for f in (str.isdigit, str.islower, str.isupper, lambda c: not c.isalnum()))
    return min(len(value), 32) / 32 + bits / 4 + (kinds - 1) / 2 - 1.0


def literal_spans(text: str) -> list[Span]:
    """Literals that a sensitive name is given, directly or by way of constants."""
    if not (":" in text or "=" in text or "</" in text):
        return []
    every, values = pairs(text), defaultdict(list)
    for at, (name, _, _) in enumerate(every):
        values[name].append(at)
    roots = sorted(((score, at) for at, (name, _, _) in enumerate(every) if (score := name_score(name))), reverse=True)

    def target(value: str, quoted: bool) -> str | None:
        """The name that a value stands for."""
        m = _REFERENCE.fullmatch(value)
        return m[1] if m and (value[0] in "$%" or not quoted and m[1] in values) else None

    found = set()
    for blanks in (False, True):
        # what is reached first is reached with the highest score, so each assignment is looked at once
        seen, spread = set(), set()
        for score, root in roots:
            if blanks and not PHRASES & {*_parts(every[root][0])}:
                continue
            live = [root]
            while live:
                at = live.pop()
                if at in seen:
                    continue
                seen.add(at)
                _, literal, quoted = every[at]
                if name := target(literal[0], quoted):
                    places = values.get(name, [])
                    if before := bisect_left(places, at):
                        live.append(places[before - 1])
                    elif name not in spread:
                        spread.add(name)
                        live += places
                elif score + literal_score(literal[0], blanks) >= THRESHOLD:
                    found.add((literal[1], 3, literal[2]))
    return list(found)


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """Sorted base spans and sorted spans of both kinds."""
    base = sorted(base_spans(text))
    more = [s for s in literal_spans(text) if not any(b[0] <= s[0] and s[2] <= b[2] for b in base)]
    return base, sorted(base + more)


def masked(text: str) -> str:
    """``text`` with each secret value replaced by ``MASK``; the names of assignments stay."""
    cuts = sorted((s, e) if kind else (ASSIGN.match(text, s).start(2), e) for s, kind, e in spans(text)[1])
    out, at = [], 0
    for s, e in cuts:
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _told(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex", "n_literal")]
                           + [T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())]))
def scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        base, every = spans(text or "")
        kinds = Counter(k for _, k, _ in every)
        rows.append((*(kinds[k] for k in range(4)), _told(base), _told(every)))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_literal", "base", "spans"])


@F.pandas_udf(T.StringType())
def mask(texts: pd.Series) -> pd.Series:
    return texts.map(masked, na_action="ignore")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, counts by kind, the hash of the base spans, and all spans."""
    found = docs.select(docs[id_col].alias("id"), scan(docs[text]).alias("s"))
    return found.select(
        F.col("id").alias(id_col), "s.n_assign", "s.n_access", "s.n_hex", F.sha2("s.base", 256).alias("base_sha256"), "s.spans", "s.n_literal")


def without_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the secrets in ``text`` masked; a column ``n_chars`` follows the text."""
    done = docs.withColumn(text, mask(docs[text]))
    return done.withColumn("n_chars", F.length(text).cast(done.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
