"""Secret scan by assignment-aware lexing.

Every whole text is read twice inside one Arrow task, without a shuffle:

* Base patterns find assigned values, access keys and long hex runs.
* A lexer reads the text once, from left to right, and pairs names with literals.  It knows
  assignments (``=``, ``:``, ``:=``, ``=>``) with the name before and the literal, or the other
  name, after the operator; quoted subscripts (``config["password"] = ...``); types
  (``token: str = ...``); prefixed literals (``b"..."``); literals that go on in further quotes
  (``"ab" + "cd"``); markup elements (``<password>...</password>``); command line options
  (``--password ...``); setters (``set_password("...")``) and fields without a telling name of
  their own inside a block with one (``credentials: {value: ...}``).  Constants are propagated in
  text order: ``a = "..."; password = a`` traces back to the literal of ``a``.  A literal is
  reported when the score of its most sensitive target name times the score of its own form
  reaches ``threshold``.

Spans are code points, end exclusive.  The kind of added spans is ``literal``; a literal that a
base span covers is not reported again.

Results for odd input: null or empty text has no spans; nulls in other columns are kept; repeated
rows are each scanned; extra columns of any name pass through ``redact_secrets``; texts of any
length are scanned whole, in time linear in the text, and names have any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import drop_kept, slices, text_or_empty

Span = tuple[str, int, int]

#: The base kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_VALUE_LENGTH = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 characters or more
HEX = re.compile(r"[0-9a-f]{32,}")

#: How sensitive a part of a name, or two neighbouring parts, are.
SENSITIVE_PARTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9,
    "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "bearer": 0.8,
}
SENSITIVE_PAIRS = {
    ("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("signing", "key"): 0.9,
    ("encryption", "key"): 0.9, ("auth", "key"): 0.9, ("pass", "phrase"): 1.0,
    ("db", "pass"): 0.9, ("user", "pass"): 0.9, ("admin", "pass"): 0.9, ("root", "pass"): 0.9,
    ("smtp", "pass"): 0.9,
}
#: Names that say nothing of what they hold; the name of their block counts.
PLAIN_NAMES = frozenset(("value", "val", "data", "key", "raw", "content", "string"))
PLACEHOLDERS = ("changeme", "example", "placeholder", "redacted", "your", "xxxx", "****", "todo")

#: What the lexer stops at: a named operator, an element, an option, a call, a brace.
TOKEN = re.compile(
    r"""(?<![A-Za-z0-9_.-])(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)(?:["'][ \t]*+\]|["'])?[ \t]*+(?:[?!](?=:))?(?P<operator>:=|=>|[:=])
    |<(?P<element>[A-Za-z_][A-Za-z0-9_.-]*+)>(?=[^<\s])
    |(?<![^\s"'(\[,])--?(?P<option>[A-Za-z][A-Za-z0-9_-]++)[ \t]++(?=[^\s-])
    |(?<![A-Za-z0-9_])(?P<call>[A-Za-z_][A-Za-z0-9_]*+)\([ \t]*+(?=["'])
    |(?P<brace>[{}])""",
    re.VERBOSE,
)
TYPE_AFTER = re.compile(r"""[ \t]*+(?:[A-Za-z_&*(\[{](?:[^\n=;"\#:]|::)*+)=(?![=>])""")
VALUE_AFTER = re.compile(
    r"""[ \t]*(?:(?:[bru]|f|br|rb|fr|rf)?\#*"((?:[^"\\\n]|\\.)*+)"|(?:[bru]|f|br|rb|fr|rf)?'((?:[^'\\\n]|\\.)*+)'|([^\s"'#;,:=]+))""",
    re.IGNORECASE,
)
CONTINUED = re.compile(
    r"""[ \t]*+(?:[+.\\][ \t]*+(?:\n[ \t]*+)?|\n[ \t]*+[+.][ \t]*+)(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)')"""
)
ELEMENT_VALUE = re.compile(r"([^<>\s]++)</")
HINT = re.compile(r"[=:(<]|(?<!\S)-")  # no token without one of these
BLOCK_AFTER = re.compile(r"\s*+\{")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
SETTER = re.compile(r"(?:set|with|use|put|add)(?![a-z])")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[Span]:
    spans: list[Span] = []
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        spans += [
            ("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE_LENGTH
        ]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def name_score(name: str) -> float:
    parts = [p.lower() for p in NAME_PART.findall(name)]
    alone = [SENSITIVE_PARTS.get(p, 0.0) for p in parts]
    paired = [SENSITIVE_PAIRS.get(p, 0.0) for p in zip(parts, parts[1:])]
    return max([0.0, *alone, *paired])


def literal_score(value: str) -> float:
    """0 for placeholders, references and short or plain values, up to 1 for random ones."""
    lowered = value.lower()
    if len(value) < 8 or any(c.isspace() for c in value) or any(p in lowered for p in PLACEHOLDERS):
        return 0.0
    if value.startswith(("$", "<", "{", "%")) or len(set(value)) < 5:
        return 0.0
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit))
    classes += any(not c.isalnum() for c in value)
    return min(1.0, 0.25 + 0.25 * classes + 0.01 * len(value))


def literal_at(text: str, at: int) -> tuple[list[tuple[int, int]], bool]:
    """The spans of the literal at ``at``, one for each pair of quotes, and whether it is quoted."""
    value = VALUE_AFTER.match(text, at)
    if value is None:
        return [], False
    spans = [value.span(value.lastindex)]
    if value.lastindex == 3:
        return spans, False
    more = CONTINUED.match(text, value.end())
    while more:
        spans.append(more.span(more.lastindex))
        more = CONTINUED.match(text, more.end())
    return spans, True


def literal_spans(text: str, threshold: float) -> list[Span]:
    """Literals that reach a sensitive name, directly or through other names."""
    known: dict[str, list[tuple[int, int]]] = {}  # name -> the literal that it stands for
    found: dict[int, int] = {}  # start -> end
    blocks: list[str] = []  # the names of the open blocks
    pending: tuple[int, str] | None = None  # where the next block with a name opens, and its name
    done = 0  # the end of the last literal of several quotes

    def judge(names: list[str], spans: list[tuple[int, int]]) -> None:
        score = max(map(name_score, names))
        if score and score * literal_score("".join(text[a:b] for a, b in spans)) >= threshold:
            found.update(spans)

    for token in TOKEN.finditer(text):
        if token.start() < done:
            continue
        kind = token.lastgroup
        if kind == "brace":
            if token[0] == "{":
                blocks.append(pending[1] if pending and pending[0] == token.start() else "")
            elif blocks:
                blocks.pop()
        elif kind == "element":
            value = ELEMENT_VALUE.match(text, token.end())
            if value:
                judge([token["element"]], [value.span(1)])
        elif kind in ("option", "call"):
            if kind == "option" or SETTER.match(token["call"]):
                spans, _ = literal_at(text, token.end())
                if spans:
                    judge([token[kind]], spans)
        else:
            name, end = token["name"], token.end()
            typed = TYPE_AFTER.match(text, end) if token["operator"] == ":" else None
            if typed:
                end = typed.end()
            block = BLOCK_AFTER.match(text, end)
            if block:
                pending = (block.end() - 1, name)
                continue
            spans, quoted = literal_at(text, end)
            if not spans:
                continue
            if not quoted:
                raw = text[spans[0][0] : spans[0][1]]
                if IDENTIFIER.match(raw) and raw in known:
                    spans = known[raw]
            elif len(spans) > 1:
                done = spans[-1][1]
            known[name] = spans
            named = [name, blocks[-1]] if blocks and blocks[-1] and name.lower() in PLAIN_NAMES else [name]
            judge(named, spans)
    return [("literal", *at) for at in sorted(found.items())]


def uncovered(spans: list[Span], base: list[Span]) -> list[Span]:
    """The spans that lie in no base span; both are sorted by their starts."""
    out, k, reach = [], 0, 0
    for span in spans:
        while k < len(base) and base[k][1] <= span[1]:
            reach = max(reach, base[k][2])
            k += 1
        if span[2] > reach:
            out.append(span)
    return out


def secret_spans(text: str, threshold: float = 0.6) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), both by start and then kind."""
    base = base_spans(text)
    added = []
    if HINT.search(text):
        added = uncovered(literal_spans(text, threshold), base)
    order = {k: i for i, k in enumerate((*KINDS, "literal"))}
    return base, sorted(base + added, key=lambda s: (s[1], order[s[0]]))


def spans_text(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, spans: Iterable[Span], mark: str) -> str:
    """The text with every run of overlapping spans replaced by ``mark``."""
    out, done = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])


def scan_secrets(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """One row per document: ``doc_id``, counts per base kind, the base digest, all spans."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                base, spans = secret_spans(text, threshold)
                counts = [sum(s[0] == kind for s in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(spans)))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            arrays = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, threshold: float = 0.6, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``mark``; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            cleaned = []
            for text in batch.column(at).to_pylist():
                spans = secret_spans(text, threshold)[1] if text else []
                cleaned.append(redacted(text, spans, mark) if spans else text)
            arrays = list(batch.columns)
            arrays[at] = pa.array(cleaned, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
