"""Secret scan with one combined deterministic automaton over the bytes of each text.

Every rule is compiled by subset construction, the product of all rules is minimised into
one transition array, and each text is read once, byte by byte, for all rules together.

Defined results: a null text counts as empty; an empty text has no spans; repeated rows are
scanned each by itself; extra columns are dropped by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Combined, Rule
from .common import id_and_text, slices

# The base kinds, in their listed order. Runs of digits or letters with a least
# length are written with that length, since a shorter run can hold no match of its own.
BASE_RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", r"[A-Za-z0-9+/_.=\-]+", 6, True),
    Rule("access", r"AKIA", r"[A-Z0-9]{16,}"),
    Rule("hex", r"", r"[0-9a-f]{24,}"),
)
# The header of private key files.
MORE_RULES = (
    Rule("pem", r"-----BEGIN ", r"(RSA |EC |OPENSSH |PGP )?PRIVATE KEY( BLOCK)?-----"),
)
RULES = BASE_RULES + MORE_RULES

_SCHEMA = "doc_id {id}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
_COMPILED: dict[tuple, Combined] = {}


def compiled(rules: tuple[Rule, ...] = RULES) -> Combined:
    key = tuple((r.kind, r.head, r.body, r.least, r.any_case) for r in rules)
    if key not in _COMPILED:
        _COMPILED[key] = Combined(list(rules))
    return _COMPILED[key]


def text_spans(machine: Combined, text: str) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points."""
    data = text.encode("utf-8", "surrogatepass")
    spans = machine.spans(data)
    if len(data) == len(text) or not spans:
        return spans
    leads = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80  # the first byte of each code point
    place, seen, last = {}, 0, 0
    for at in sorted({at for a, _, b in spans for at in (a, b)}):  # one walk over the text for all spans
        seen += int(np.count_nonzero(leads[last:at]))
        place[at], last = seen, at
    return [(place[a], r, place[b]) for a, r, b in spans]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: counts of the base kinds, a digest of base spans, all spans as text."""
    kind = docs.schema["doc_id"].dataType
    machine = compiled(rules)  # built once by the driver; the tasks get the finished arrays

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                found = [(a, r, b) for a, r, b in text_spans(machine, text)]
                names = [(f"{rules[r].kind}:{a}:{b}", r) for a, r, b in found]
                base = ",".join(n for n, r in names if r < len(BASE_RULES))
                count = lambda k: sum(rules[r].kind == k for _, r in names)
                digest = hashlib.sha256(base.encode()).hexdigest()
                rows.append((count("assign"), count("access"), count("hex"), digest, ",".join(n for n, _ in names)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return id_and_text(docs).mapInArrow(work, _SCHEMA.format(id=kind.simpleString()))


def redact(docs: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same documents with every secret replaced by ``mark``; overlapping spans are one.

    A null text stays null. ``n_chars``, if there, is the new length of changed texts."""
    machine = compiled(rules)

    @F.arrow_udf(T.StringType())
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 256):
            for text in texts.slice(at, 256).to_pylist():
                spans = text_spans(machine, text) if text else []
                if spans:
                    pieces, end = [], 0
                    for a, _, b in spans:
                        if a >= end:
                            pieces += [text[end:a], mark]
                        end = max(end, b)
                    text = "".join(pieces) + text[end:]
                out.append(text)
        return pa.array(out, pa.string())

    changed = docs.withColumn("text", clean(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return changed.select(*docs.columns)


