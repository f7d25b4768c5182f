"""License scan by diagonal voting (operator 10).

Every rolling word k-gram hash of every text is joined (broadcast: the
template table is bounded by the template texts) to template positions. A hit
votes for the diagonal ``text word - template word`` it lies on; votes are
aggregated per text, template and diagonal, neighbouring diagonals (an
insertion or deletion shifts the diagonal) are merged into spans, and a span
is verified by the share of template words that its hits cover.

Short phrases use 2-grams and must be covered whole on one diagonal, which is
exactly "the words stand consecutively". Long templates use 5-grams and
``min_cover`` of their words.

Words are runs of ASCII letters and digits and of any non-ASCII code points,
after A-Z are lower-cased. Word hashes have 64 bits and a k-gram hash mixes k
of them. Defined results: a null text is empty and has no words; every input
row gives one output row, repeated rows one each; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map
from .kernels import ALNUM, LOWER, WordHasher, kgrams, pieces, split_words, text_buffers, word_docs

#: The base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Sentences of public license texts, and their labels.
TEMPLATES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License", "apache-2.0"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met", "bsd"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation", "gpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted", "isc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("Licensed under CC BY 4.0", "cc-by"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
)

SHORT_K, LONG_K = 2, 5
MIN_COVER = 0.8
#: Diagonals at most this far apart belong to one place.
MERGE = 3


def _word_hashes(texts: list[str]) -> list[np.ndarray]:
    data, off = text_buffers(pa.array(texts, pa.string()))
    data = LOWER[data]
    starts, ends, doc_words = split_words(data, off, ALNUM)
    h = WordHasher()(data, starts, ends)
    return [h[a:b] for a, b in zip(doc_words[:-1], doc_words[1:])]


def template_rows(phrases=PHRASES, templates=TEMPLATES) -> list[tuple]:
    """(k, hash, template, position, words, base, label) of every k-gram of every template."""
    out, number = [], 0
    for base, items in ((True, phrases), (False, templates)):
        for text, label in items:
            (h,) = _word_hashes([text])
            k = SHORT_K if base else min(LONG_K, len(h))
            if len(h) < SHORT_K:
                raise ValueError(f"a template needs two words: {text!r}")
            g, at = kgrams(h, np.zeros(len(h), np.int64), k)
            out += [(k, int(x), number, int(p), len(h), base, label) for x, p in zip(g.view(np.int64), at)]
            number += 1
    return out


def _emit(ks: tuple[int, ...]):
    """Per text: its words and, for each k, the rolling hashes from word 0 on."""
    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            all_data, all_off = text_buffers(batch.column(1))
            words, lists = [], {k: ([], [0]) for k in ks}
            for first, last in pieces(all_off):
                data = LOWER[all_data[all_off[first]:all_off[last]]]
                off = all_off[first:last + 1] - all_off[first]
                starts, ends, doc_words = split_words(data, off, ALNUM)
                h, docs, n = hasher(data, starts, ends), word_docs(doc_words), np.diff(doc_words)
                words.append(n)
                for k in ks:
                    values, ends_at = lists[k]
                    values.append(kgrams(h, docs, k)[0].view(np.int64))
                    ends_at.extend((ends_at[-1] + np.cumsum(np.maximum(n - k + 1, 0))).tolist())
            cols = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(np.concatenate([*v, np.empty(0, np.int64)])))
                    for v, e in lists.values()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate([*words, np.empty(0, np.int64)])), *cols],
                names=["doc_id", "n_words", *(f"g{k}" for k in ks)])

    return run


def license_spans(docs: DataFrame, *, phrases=PHRASES, templates=TEMPLATES, min_cover: float = MIN_COVER,
                  merge: int = MERGE) -> DataFrame:
    """Per verified span: row_key, doc_id, n_words, template, base, label,
    first_word, last_word (of the text), cover. Per input row also one row
    with template -1 and no span, so that rows without spans stay."""
    spark = docs.sparkSession
    rows = template_rows(phrases, templates)
    table = spark.createDataFrame(
        rows, "k int, gram long, template int, t_pos int, t_words int, base boolean, label string")
    ks = tuple(sorted({r[0] for r in rows}))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    grams = arrow_map(src, _emit(ks), "doc_id long, n_words long, " + ", ".join(f"g{k} array<long>" for k in ks))
    # a row's key is only used inside the one shuffle that follows, so it may be assigned on the fly
    grams = grams.withColumn("row_key", F.monotonically_increasing_id())
    # the rolling grams of all k in one pass; the gram 0, which joins template -1, keeps rows without any hit
    each = grams.select(
        "row_key", "doc_id", "n_words",
        F.explode(F.array(F.array(F.lit(0).cast("long")), *(F.col(f"g{k}") for k in ks))).alias("of"))
    each = each.select("row_key", "doc_id", "n_words", F.posexplode("of").alias("pos", "gram"))
    marker = spark.createDataFrame([(0, 0, -1, 0, 0, False, None)], table.schema)
    hits = each.join(F.broadcast(table.unionByName(marker)), "gram")
    # votes by diagonal: the template positions seen on it, bounded by the template's length
    votes = hits.groupBy("row_key", "doc_id", "n_words", "template", "t_words", "base", "label", "k",
                         (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.collect_set("t_pos").alias("at"))
    # neighbouring diagonals of one text and template make one place
    w = Window.partitionBy("row_key", "template").orderBy("diagonal")
    near = votes.withColumn("gap", F.col("diagonal") - F.lag("diagonal").over(w))
    near = near.withColumn("place", F.sum(F.when(F.col("base") | F.col("gap").isNull() | (F.col("gap") > merge), 1)
                                          .otherwise(0)).over(w))
    places = near.groupBy("row_key", "doc_id", "n_words", "template", "t_words", "base", "label", "k", "place").agg(
        F.flatten(F.collect_list(F.transform("at", lambda p: F.col("diagonal") + p))).alias("text_at"),
        F.flatten(F.collect_list("at")).alias("at"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        "at", lambda p: F.sequence(p, p + F.col("k") - 1)))))
    spans = places.withColumn("cover", F.when(F.col("template") >= 0, covered / F.col("t_words")))
    return spans.where((F.col("template") < 0) | F.when(F.col("base"), F.col("cover") >= 1)
                       .otherwise(F.col("cover") >= min_cover)).select(
        "row_key", "doc_id", "n_words", "template", "base", "label",
        F.array_min("text_at").cast("long").alias("first_word"),
        (F.array_max("text_at") + F.col("k") - 1).cast("long").alias("last_word"), "cover")


def license_scan(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: places of base phrases, labels and a score
    (the largest cover of a span, 0 without any)."""
    real = F.col("template") >= 0
    base = real & F.col("base")
    return license_spans(docs, **options).groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(real, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(real, F.col("cover"))), F.lit(0.0)).alias("score"),
    ).drop("row_key")
