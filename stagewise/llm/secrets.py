"""Secret scans of whole texts: fixed patterns, and candidates scored by inferred format automata."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise import scratch

from .automata import Automaton, best_format, default_automata

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")  # a run is taken whole from its first AKIA, so a short one has no longer rest
HEX = re.compile(rb"[0-9a-f]{24,}")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
LEAST = 16
JOINTS = b"+/_=-"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of (start, end) spans as disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def open_parts(start: int, end: int, taken: list[tuple[int, int]], raw: bytes):
    """The parts of a run that none of the disjoint ``taken`` spans covers; where one was cut off, joining characters go too."""
    cut = False
    for a, z in taken:
        part = raw[start:a] if a > start else b""
        yield start + (len(part) - len(part.lstrip(JOINTS)) if cut else 0), start + len(part.rstrip(JOINTS))
        start, cut = max(start, z), True
    part = raw[start:end]
    yield start + (len(part) - len(part.lstrip(JOINTS)) if cut else 0), end


def code_points(raw: bytes, at: list[int]) -> dict[int, int]:
    """How many code points stand before each of the byte places, in one pass over the text."""
    heads = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    out, before, last = {}, 0, 0
    for place in sorted(set(at)):
        before += int(np.count_nonzero(heads[last:place]))
        out[place] = before
        last = place
    return out


def find_spans(raw: bytes, automata: dict[str, Automaton], least_bits: float) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points, in order; format spans lie outside the base ones.

    The time is linear in the text: base spans and candidates are walked in order, side by side.
    """
    found = []
    lower = raw.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(raw)]
    taken, at = merged([(a, z) for a, _, z in found]), 0
    for m in CANDIDATE.finditer(raw):
        start, end = m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        upto = at
        while upto < len(taken) and taken[upto][0] < end:
            upto += 1
        for a, z in open_parts(start, end, taken[at:upto], raw) if upto > at else [(start, end)]:
            if z - a >= LEAST and best_format(raw[a:z].decode(), automata)[1] >= least_bits:
                found.append((a, 3, z))
    found.sort()
    if raw.isascii():
        return found
    points = code_points(raw, [x for a, _, z in found for x in (a, z)])
    return [(points[a], kind, points[z]) for a, kind, z in found]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def secret_spans(
    df: DataFrame, key: str = "doc_id", text: str = "text", automata: dict[str, Automaton] | None = None,
    least_bits: float = 12.0,
) -> DataFrame:
    """One row per document: key, n_assign, n_access, n_hex, base_sha256, spans, n_format, found.

    ``spans`` joins kind:start:end by start; ``found`` has the same as structs. Candidates are the
    runs of 16 or more credential characters, cut at the base spans; one is a
    secret if its likeliest format beats plain strings by ``least_bits``; shorter ones say too little.
    Of spans with one start the kinds go in the order of KINDS. Null and empty texts have no spans,
    repeated rows a result each, an empty table no rows. The automata (a few hundred states, by default inferred
    from :func:`automata.labelled_credentials`) go to the workers with the function.
    """
    scratch.not_among(key, ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format", "found"])
    kind = df.schema[key].dataType.simpleString()
    automata = default_automata() if automata is None else automata

    def run(batches):
        for batch in batches:
            counts, digests, joined, structs = [[], [], [], []], [], [], []
            for value in batch.column(1).to_pylist():
                spans = find_spans(value, automata, least_bits) if value else []
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in spans))
                digests.append(hashlib.sha256(listed([s for s in spans if s[1] < 3]).encode()).hexdigest())
                joined.append(listed(spans))
                structs.append([{"kind": KINDS[k], "start": a, "end": z} for a, k, z in spans])
            a, c, h, f = (pa.array(x, pa.int64()) for x in counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), a, c, h, pa.array(digests, pa.string()), pa.array(joined, pa.string()), f, pa.array(structs, span_type)], names)

    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    names = [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format", "found"]
    ddl = f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long, found array<struct<kind:string,start:long,end:long>>"
    return df.select(F.col(key), F.col(text).cast("string").cast("binary")).mapInArrow(run, ddl)


def redactor(automata: dict[str, Automaton] | None = None, least_bits: float = 12.0):
    """A function of a text column: the text with each secret, overlaps joined, as ``[kind]``; null stays null."""
    automata = default_automata() if automata is None else automata

    @F.arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            spans = find_spans(text.encode(), automata, least_bits) if text else []
            if spans:
                parts, at = [], 0
                for start, kind, end in spans:
                    if start >= at:
                        parts += [text[at:start], f"[{KINDS[kind]}]"]
                    at = max(at, end)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pa.array(out, pa.string())

    return redact


def redact(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """The same rows and columns with secrets replaced in ``text``."""
    hidden: Column = redactor(**options)(F.col(text))
    return df.withColumn(text, hidden)
