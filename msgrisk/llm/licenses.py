"""License scans by diagonal voting.

Texts and templates become words; a word that occurs in no template cannot be part of a match. Every run of three
template words in a text is joined with the places where the templates hold that run. A hit votes for the diagonal
(place in the text less place in the template); neighbouring diagonals of one template are merged, which absorbs
inserted or dropped words, and a merged span is verified by the share of the template's runs it covers. A base
phrase stands where one diagonal holds all runs of the phrase.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgrisk.llm.common import arrow_map, slices
from msgrisk.session import materialize

RUN = 3

# Phrases whose every place counts, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Public license notices, matched as a whole or with small changes.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "this work is licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("apache-2", "this work is licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
]

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text after A-Z became a-z; letters beyond ASCII stay as they are."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Templates:
    """Numbered templates over one vocabulary; a run of three words is one number, exact and free of collisions."""

    def __init__(self, phrases: dict[str, str], notices: list[tuple[str, str]]):
        listed = [(label, text, True) for text, label in phrases.items()] + [(label, text, False) for label, text in notices]
        self.words: dict[bytes, int] = {}
        self.rows: list[tuple[int, str, bool, int, int, int]] = []  # template, label, base, runs, place, run
        for number, (label, text, base) in enumerate(listed):
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words_of(text)]
            if len(ids) < RUN:
                raise ValueError(f"a template needs at least {RUN} words: {text}")
            for place in range(len(ids) - RUN + 1):
                self.rows.append((number, label, base, len(ids) - RUN + 1, place, self._code(ids[place : place + RUN])))

    @staticmethod
    def _code(ids) -> int:
        return (ids[0] << 40) | (ids[1] << 20) | ids[2]

    def runs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of all runs that consist of template words."""
        get = self.words.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        known = ids > 0
        at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:]) if len(ids) >= RUN else np.zeros(0, dtype=np.int64)
        return at, (ids[at] << 40) | (ids[at + 1] << 20) | ids[at + 2] if len(at) else at


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None,
    band: int = 2, coverage: float = 0.75, whole_below: int = 12, spans: bool = False,
) -> DataFrame:
    """License labels of every text, one row for each row of ``docs`` (doc_id and text; other columns are ignored).

    n_words; n_base, the places where a base phrase stands; first_word and last_word, their smallest and largest start
    (null without one); base_labels; labels, which adds every notice of whose runs merged diagonals (at most ``band``
    apart) cover at least ``coverage`` (notices of under ``whole_below`` runs: all, as one word may name the version);
    score, the largest share covered, 1 for a base place, 0 without a kept span.
    A null or empty text has no words and no labels; repeated rows are counted once each; with ``spans`` one row for
    each kept span is returned instead (first word, words, label, share).
    """
    spark = docs.sparkSession
    templates = Templates(BASE_PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    # A few hundred rows: fixed lists of the caller, never data.
    places = F.broadcast(spark.createDataFrame(templates.rows, "template int, label string, base boolean, runs int, tpos int, run long"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        row = TaskContext.get().partitionId() << 40  # a key for rows whose doc_id may repeat or be null
        for part in slices(batches, "text"):
            out: dict[str, list] = {"row": [], "doc_id": [], "n_words": [], "places": [], "numbers": []}
            for doc, text in zip(part["doc_id"], part["text"]):
                words = words_of(text)
                at, run = templates.runs(words)
                out["row"].append(row)
                out["doc_id"].append(doc)
                out["n_words"].append(len(words))
                out["places"].append(at.tolist())
                out["numbers"].append(run.tolist())
                row += 1
            yield out

    doc_type = dict(docs.select("doc_id").dtypes)["doc_id"]
    # Written once: several branches read it, and row numbers stay the same if a task is lost.
    found = materialize(
        arrow_map(docs.select("doc_id", "text"), work, f"row long, doc_id {doc_type}, n_words long, places array<long>, numbers array<long>")
    )
    hits = found.select("row", F.explode(F.arrays_zip("places", "numbers")).alias("h")).select(
        "row", F.col("h.places").alias("pos"), F.col("h.numbers").alias("run")
    )
    votes = hits.join(places, "run").groupBy("row", "template", "label", "base", "runs", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("covered"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    base = votes.where(F.col("base") & (F.size("covered") == F.col("runs")))
    base_rows = base.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"),
        F.collect_set("label").alias("base_set"),
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > band).cast("int"), F.lit(0))
    merged = (
        votes.where(~F.col("base")).withColumn("_gap", gap).withColumn("_group", F.sum("_gap").over(order))
        .groupBy("row", "template", "label", "runs", "_group")
        .agg(F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"), F.min("first").alias("first"), F.max("last").alias("last"))
        .withColumn("share", F.size("covered") / F.col("runs"))
        .where(F.col("share") >= F.when(F.col("runs") < whole_below, 1.0).otherwise(coverage))
    )
    if spans:
        kept = merged.select("row", "first", (F.col("last") + RUN - F.col("first")).alias("words"), "label", "share").unionByName(
            base.select("row", "first", (F.col("last") + RUN - F.col("first")).alias("words"), "label", F.lit(1.0).alias("share"))
        )
        return found.select("row", "doc_id").join(kept, "row").drop("row")
    more = merged.groupBy("row").agg(F.collect_set("label").alias("more_set"), F.max("share").alias("best"))
    none = F.array().cast("array<string>")
    base_set, more_set = F.coalesce("base_set", none), F.coalesce("more_set", none)
    return found.select("row", "doc_id", "n_words").join(base_rows, "row", "left").join(more, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, more_set)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
