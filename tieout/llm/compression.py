"""Quality rules by compression bands (operator 8).

zstandard ratios (raw bytes / compressed bytes) are taken over the whole text
and over fixed chunks of it. A text whose whole ratio leaves the band of its
length class, or of which more than ``max_bad_chunks`` of the chunks
leave the chunk band, is rejected: too high means repetitive, too low means
incompressible. Base word rules run beside the bands.

Defined results: a null text has no words and counts as empty; an empty text
fails the base rule (fewer than 20 words); repeated rows are judged row by row
(one output row per input row); an empty table gives an empty table; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .kernels import (NOT_WHITESPACE, WordHasher, before, pieces, repeated_words, split_words, starts_code_point,
                      text_buffers, word_docs)

#: (bytes from, lowest ratio, highest ratio) of a whole text. Short texts
#: carry the frame's fixed cost, so their ratios are lower, and a short text
#: cannot reach the ratios that a long repetitive one does. The lowest ratios
#: lie between random base64 and clean text of the length; under 128 bytes the
#: two cannot be told apart, and hex digits reach the ratios of text.
WHOLE_BANDS = ((0, 0.0, 3.0), (128, 1.0, 3.0), (192, 1.085, 3.0), (256, 1.22, 3.6), (512, 1.3, 3.6),
               (1024, 1.45, 4.5), (4096, 1.6, 5.5), (16384, 1.7, 7.0), (65536, 1.7, 9.0))
#: Bytes of a chunk, and its band. A shorter last chunk of a longer text is
#: judged by the band of a whole text of its length.
CHUNK_BYTES = 4096
CHUNK_BAND = (1.6, 5.0)
MAX_BAD_CHUNKS = 0.3
LEVEL = 3
WINDOW = 8

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_bytes long, whole_ratio double, n_chunks long, n_bad_chunks long")


def _measure(level: int, chunk: int, band: tuple[float, float], whole_bands: tuple, window: int):
    symbols = np.zeros(256, bool)
    symbols[list(b"#*$%&|<>")] = True

    def run(batches):
        pack = zstandard.ZstdCompressor(level=level)
        hasher = WordHasher()
        for batch in batches:
            all_data, all_off = text_buffers(batch.column(1))
            out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes",
                                   "whole_ratio", "n_chunks", "n_bad_chunks")}
            for first, last in pieces(all_off):
                data = all_data[all_off[first]:all_off[last]]
                off = all_off[first:last + 1] - all_off[first]
                starts, ends, doc_words = split_words(data, off, NOT_WHITESPACE)
                docs = word_docs(doc_words)
                h = hasher(data, starts, ends)
                chars = before(NOT_WHITESPACE[data] & starts_code_point(data))
                out["n_words"].append(np.diff(doc_words))
                out["word_chars"].append(np.diff(chars[off]))
                out["n_symbols"].append(np.diff(before(symbols[data])[off]))
                out["n_repeat_words"].append(np.diff(before(repeated_words(h, docs, window))[doc_words]))
                out["n_bytes"].append(np.diff(off))
                dup, ratios, n_chunks, n_bad = [], [], [], []
                for a, b in zip(off[:-1], off[1:]):
                    raw = data[a:b].tobytes()
                    lines = [x for x in raw.split(b"\n") if x.strip()]
                    dup.append(len(lines) - len(set(lines)))
                    ratios.append(len(raw) / len(pack.compress(raw)) if raw else 0.0)
                    whole = len(raw) // chunk
                    got = [chunk / len(pack.compress(raw[i * chunk:(i + 1) * chunk])) for i in range(whole)]
                    bad = sum(not band[0] <= x <= band[1] for x in got)
                    rest = raw[whole * chunk:] if whole else b""
                    if rest:
                        low, high = ([(0.0, float("inf"))] + [x[1:] for x in whole_bands if x[0] <= len(rest)])[-1]
                        bad += not low <= len(rest) / len(pack.compress(rest)) <= high
                    n_chunks.append(whole + bool(rest))
                    n_bad.append(bad)
                out["n_dup_lines"].append(dup)
                out["whole_ratio"].append(ratios)
                out["n_chunks"].append(n_chunks)
                out["n_bad_chunks"].append(n_bad)
            cols = [np.concatenate(v) if v else np.empty(0) for v in out.values()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c.astype(np.float64 if k == "whole_ratio" else np.int64))
                                    for k, c in zip(out, cols))], names=["doc_id", *out])

    return run


def compression_rules(docs: DataFrame, *, whole_bands=WHOLE_BANDS, chunk_bytes: int = CHUNK_BYTES,
                      chunk_band=CHUNK_BAND, max_bad_chunks: float = MAX_BAD_CHUNKS, level: int = LEVEL,
                      min_words: int = 20, max_repeat_pct: int = 30) -> DataFrame:
    """One row per input row: the base counts, the ratios, ``base_failed`` and ``kept``."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    m = arrow_map(src, _measure(level, chunk_bytes, tuple(chunk_band), tuple(whole_bands), WINDOW), SCHEMA)
    low = high = F.lit(None).cast("double")
    for size, lo, hi in whole_bands:
        low = F.when(F.col("n_bytes") >= size, F.lit(float(lo))).otherwise(low)
        high = F.when(F.col("n_bytes") >= size, F.lit(float(hi))).otherwise(high)
    return (
        m.withColumn("base_failed", (F.col("n_words") < min_words)
                     | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))
        .withColumn("repetitive", F.col("whole_ratio") > high)
        .withColumn("incompressible", F.col("whole_ratio") < low)
        .withColumn("bad_chunks", F.col("n_bad_chunks") > max_bad_chunks * F.col("n_chunks"))
        .withColumn("kept", ~(F.col("base_failed") | F.col("repetitive") | F.col("incompressible")
                              | F.col("bad_chunks")))
    )
