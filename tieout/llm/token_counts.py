"""Token counts by offset-mapped attribution (operator 9).

A document (its fields, joined by newlines) is encoded once, as a whole. The
byte lengths of its tokens give their spans; an interval join of the sorted
token spans with the sorted section spans (both of one document, so the join is
a merge inside the row) attributes every token. Sections are the lines of each
field; a line's newline belongs to it.

A token that crosses a border is allocated by ``rule``:
``first``: to the section of its first byte (default), ``last``: to that of its
last byte, ``share``: to each section it touches by its share of the token's bytes.
Under each rule a document's counts add up to its number of tokens.

Defined results: null fields are empty; an empty field has one empty section
without tokens; a null doc_id is an ordinary row; repeated rows give their
sections each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .kernels import before, starts_code_point
from .tokenizers import VOCABULARY, encode, load

SCHEMA = ("doc_id long, field array<int>, section array<int>, start array<long>, stop array<long>, "
          "tokens array<double>, n_crossing array<long>, n_doc_tokens long")


def attribute(sizes: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens that start here) of each section; ``sizes`` are the tokens'
    bytes in order, ``borders`` the n + 1 byte borders of the sections."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = len(borders) - 1

    def section(at):  # empty sections hold no byte
        return np.searchsorted(borders, at, side="right") - 1
    first, last = section(starts), section(ends - 1)
    crossing = np.bincount(first[first != last], minlength=n)
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float), crossing
    if rule == "last":
        return np.bincount(last, minlength=n).astype(float), crossing
    # share: cut the tokens at all borders, weigh each part by its bytes
    cuts = np.unique(np.concatenate([starts, ends, borders]))
    token = np.searchsorted(starts, cuts[:-1], side="right") - 1
    part = np.diff(cuts) / sizes[token]
    return np.bincount(section(cuts[:-1]), weights=part, minlength=n), crossing


def _attribute(fields: int, rule: str, path: str):
    def run(batches):
        encoding, token_bytes = load(path)
        for batch in batches:
            texts = [batch.column(1 + i).to_pylist() for i in range(fields)]
            out = {k: [] for k in ("field", "section", "start", "stop", "tokens", "n_crossing", "n")}
            for row in range(batch.num_rows):
                parts = [(t[row] or "") for t in texts]
                raw = "\n".join(parts).encode()
                data = np.frombuffer(raw, np.uint8)
                ids = np.asarray(encode(encoding, raw.decode()), np.int64)
                field, section, borders, at = [], [], [0], 0
                for f, part in enumerate(parts):
                    lines = part.encode().split(b"\n")
                    for i, line in enumerate(lines):
                        at = min(at + len(line) + 1, len(raw))
                        borders.append(at)
                        field.append(f)
                        section.append(i)
                borders = np.array(borders)
                tokens, crossing = attribute(token_bytes[ids], borders, rule)
                chars = before(starts_code_point(data))[borders]
                for k, v in (("field", field), ("section", section), ("start", chars[:-1].tolist()),
                             ("stop", chars[1:].tolist()), ("tokens", tokens.tolist()),
                             ("n_crossing", crossing.tolist()), ("n", len(ids))):
                    out[k].append(v)
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(out[k], pa.list_(t)) for k, t in zip(out, types)),
                 pa.array(out["n"], pa.int64())],
                names=["doc_id", *list(out)[:-1], "n_doc_tokens"])
    return run


def attribute_tokens(docs: DataFrame, fields: tuple[str, ...] = ("text",), rule: str = "first",
                     vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row and section: doc_id, field, section, start, stop (code points of the
    document), tokens, n_crossing (tokens that start in it and end beyond), n_doc_tokens."""
    if rule not in ("first", "last", "share"):
        raise ValueError(f"unknown rule {rule!r}")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      *(F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)))
    rows = arrow_map(src, _attribute(len(fields), rule, vocabulary), SCHEMA)
    names = ("field", "section", "start", "stop", "tokens", "n_crossing")
    rows = rows.select("doc_id", "n_doc_tokens", F.explode(F.arrays_zip(*names)).alias("of"))
    name = F.element_at(F.array(*(F.lit(f) for f in fields)), F.col("of.field") + 1)
    return rows.select("doc_id", name.alias("field"), *(F.col(f"of.{c}").alias(c) for c in names[1:]),
                       "n_doc_tokens")
