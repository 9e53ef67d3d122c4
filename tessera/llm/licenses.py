"""Licence scans by a trained paragraph classifier (DataFrame functions only).

A paragraph is a run of lines with a letter or digit, its lines stripped of comment marks. Paragraphs that hold a cue
(``CUES``: every template and every unnamed notice holds one) are read as candidates: each of their lines with a cue, the
whole paragraph, and of long lines and paragraphs windows of ``WINDOWS`` words, half a window apart. A sparse logistic
regression on hashed word n-grams (one and two words) scores each candidate for being a licence notice, and one regression
a family names it; calibrated probabilities decide. A family stands only if the candidate also shares enough words with one
of its templates. A notice that no family explains is of the ``unknown`` class if it shares enough words with some notice.
A paragraph has the families of its lines, or else that of its best candidate.

The regressions are fitted on the driver from a bounded table of n-grams: variants of the templates below, sentences that
hold cues but are no notices, and at most ``MOST_BACKGROUND`` lines of about ``BACKGROUND_DOCS`` documents that a hash of
their ids picks, without those that hold a cue. Other frames and other sentences, unseen by the fit, calibrate each
regression by a logistic curve. Weights are a table of the n-grams of notices and sentences, a bound that does not grow
with the corpus; it is broadcast to the n-grams of the candidates, which only paragraphs with cues have.

Defined results: a null text has no paragraphs; a document without notices has family null and 0 notices; of several
families the one with the most notices is named, then the first by name; rows with equal doc_ids are judged together; an
empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import json


import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.calibration import logistic
from tessera.llm.store import bounded_batches, saved

#: Notices of the licence families.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Distributed under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related rights. Dedicated to the public domain under CC0 1.0",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "all-rights-reserved": ("All rights reserved", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission"),
}
#: Notices that name no family; they teach the first regression only.
UNNAMED = ("Licensed under the terms of the license in the accompanying file", "This software is provided under its own license agreement", "See LICENSE for the license of this work", "Use of this file is governed by the license agreement that comes with it")
FAMILIES = tuple(TEMPLATES)
#: What a candidate must hold to be scored; every notice above does.
CUES = r"(?i)licen[cs]|copyright|rights reserved|redistribut|permission (?:is|to)|hereby granted|deal in the software|public domain|spdx|\bcc0\b|\bcc[ -]by\b|creative commons|applicable law"
#: A word or part of one, in lower case, of every cue: texts without any are passed over without a pattern being tried.
STEMS = ("licens", "licenc", "copyright", "reserved", "redistribut", "permission", "granted", "software", "domain", "spdx", "cc0", "cc by", "cc-by", "creative", "applicable")
DIMENSIONS, STEPS, RATE, PENALTY = 1 << 18, 300, 2.0, 1e-4
MOST_BACKGROUND, BACKGROUND_DOCS = 1500, 400
#: Probabilities from which a candidate may be a notice, is one of no known family, and a family is named; the share of a
#: template's words that it must have, and the words of the shortest template that confirms an unknown notice.
NOTICE, UNKNOWN, NAMED, TEMPLATE_SHARE, TELLING = 0.3, 0.75, 0.5, 0.6, 8
#: Words of windows, of the longest line and of the longest paragraph that are candidates as they are.
WINDOWS, LONGEST_LINE, LONGEST = (12, 40), 24, 140
_COMMENT = r"^[\x20\t]*(?:/{2,}|#+|/?\*+/?|-{2,}|;+|%+|<!--|\|)?[\x20\t]*"
#: Sentences with cues that are no notices: (frame, fillers of its places), the first ones to fit and the others to calibrate.
NEGATIVES = (
    ("the license plate of the {0} was {1}", ("car", "truck", "bus", "trailer"), ("reserved", "lost", "stolen", "changed")),
    ("he lost his {0} licence in {1}", ("driving", "fishing", "hunting", "pilot"), ("may", "town", "the snow", "spring")),
    ("{0} rights reserved for members of the {1} are few", ("water", "fishing", "parking", "hunting"), ("club", "village", "guild", "court")),
    ("permission is {0} from the {1} before you enter", ("needed", "asked", "given", "expected"), ("guard", "owner", "teacher", "office")),
    ("the book on copyright law was {0} by a {1}", ("read", "sold", "found", "kept"), ("student", "judge", "clerk", "printer")),
    ("the public domain of the {0} was once {1}", ("king", "city", "church", "state"), ("forest", "pasture", "marsh", "meadow")),
    ("a dog license costs {0} in {1}", ("ten dollars", "little", "more", "nothing"), ("winter", "the county", "june", "this town")),
    ("all {0} of the {1} were reserved", ("seats", "rooms", "tables", "rights"), ("hotel", "train", "theatre", "boat")),
    ("the software was {0} in the {1} without charge", ("copied", "tested", "used", "installed"), ("office", "school", "lab", "library")),
    ("the {0} applicable law is that of the {1}", ("only", "old", "new", "strict"), ("land", "sea", "state", "market")),
)
OTHER_NEGATIVES = (
    ("the teacher gave her {0} a poetic licence to {1}", ("class", "son", "choir", "friend"), ("sing", "dream", "write", "wander")),
    ("our {0} renewed a liquor license at the {1}", ("aunt", "neighbour", "tavern", "host"), ("court", "bank", "town hall", "harbour")),
    ("questions of copyright {0} the {1} for years", ("divided", "troubled", "amused", "bored"), ("band", "heirs", "court", "press")),
    ("the {0} redistributed grain to {1}", ("king", "council", "abbey", "army"), ("farmers", "the poor", "soldiers", "widows")),
    ("children need permission to {0} the {1}", ("leave", "cross", "climb", "visit"), ("yard", "river", "tower", "barn")),
)


def _words(text: str) -> list[str]:
    return [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() if w]


def clean_words(text: Column) -> Column:
    """Words of a text: runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda x: x != "")


def grams(words: Column) -> Column:
    """Buckets of the one- and two-word grams of a candidate."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    hashes = F.concat(F.transform(words, lambda x: F.xxhash64(x)), F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b)))
    return F.transform(hashes, lambda h: F.pmod(h, F.lit(DIMENSIONS)).cast("int"))


def examples() -> list[tuple[str, str | None, bool]]:
    """(text, family, held out): notices in frames, '' being no family, and sentences that are none (null)."""
    frames = ("{0}", "Copyright 2021 the authors. {0}.", "{0} - see the file for details", "Note: {0}", "before it {0} and after it", "{0} All other terms apply.")
    others = ("# {0}", "(c) 2019 Somebody and others. {0}.", "{0} Please read on.", "as said there {0} which ends this part")
    out: list[tuple[str, str | None, bool]] = []
    for family, texts in [*TEMPLATES.items(), ("", UNNAMED)]:
        for t in texts:
            out += [(f.format(t), family, held) for fs, held in ((frames, False), (others, True)) for f in fs]
            if len(w := t.split()) > 8:
                out += [(" ".join(w[: len(w) * 3 // 4]), family, False), (" ".join(w[len(w) // 4 :]), family, False), (" ".join(w[len(w) // 8 :]), family, True)]
        if len(texts) > 1:
            out += [(" ".join(texts), family, False), (" ".join(reversed(texts)), family, True)]
    for rules, held in ((NEGATIVES, False), (OTHER_NEGATIVES, True)):
        out += [(f.format(a, b), None, held) for f, xs, ys in rules for a in xs for b in ys]
    return out


class Model:
    """For the notice regression (key '') and each family's: weights of n-grams, a bias, and the curve to a probability."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: np.ndarray, curves: list[tuple[float, float]]) -> None:
        self.buckets, self.weights, self.bias, self.curves = buckets, weights, bias, curves

    def table(self, spark: SparkSession) -> DataFrame:
        """(bucket, weights): a row for each n-gram that has weights."""
        return spark.createDataFrame([(int(b), [float(x) for x in w]) for b, w in zip(self.buckets, self.weights, strict=True)], "bucket int, weights array<double>")


def fitted(spark: SparkSession, background: DataFrame) -> Model:
    """The regressions, from the examples and at most ``MOST_BACKGROUND`` lines of ``background`` (line)."""
    made = examples()
    notices = spark.createDataFrame(made, "line string, family string, held boolean")
    lines = background.select("line").where(~F.col("line").rlike(CUES)).orderBy(F.xxhash64("line"), "line").limit(MOST_BACKGROUND)
    lines = lines.select("line", F.lit(None).cast("string").alias("family"), (F.pmod(F.xxhash64("line"), F.lit(4)) == 0).alias("held"))
    rows = notices.unionByName(lines).select(grams(clean_words(F.col("line"))).alias("idx"), "family", "held").where(F.size("idx") > 0).collect()
    taught = len(made)
    buckets = np.unique(np.concatenate([r["idx"] for r in rows[:taught]]))
    x = np.zeros((len(rows), len(buckets)), np.float32)
    for i, r in enumerate(rows):
        at = np.searchsorted(buckets, r["idx"])
        hit = buckets[np.minimum(at, len(buckets) - 1)] == r["idx"]
        np.add.at(x[i], at[hit], np.float32(1 / len(r["idx"]) ** 0.5))
    held = np.array([r["held"] for r in rows])
    truth = np.array([[r["family"] is not None, *(r["family"] == f for f in FAMILIES)] for r in rows], np.float32)
    xf, y = x[~held], truth[~held]
    balance = np.where(y > 0, 0.5 / np.maximum(y.sum(axis=0), 1), 0.5 / np.maximum((1 - y).sum(axis=0), 1)).astype(np.float32)
    w, bias = np.zeros((len(buckets), y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    v, vb = w, bias
    for t in range(STEPS):
        error = (1 / (1 + np.exp(-np.clip(xf @ v + vb, -30, 30))) - y) * balance
        new, new_bias = v - RATE * (xf.T @ error + PENALTY * v), vb - RATE * error.sum(axis=0)
        v, vb = new + t / (t + 3) * (new - w), new_bias + t / (t + 3) * (new_bias - bias)
        w, bias = new, new_bias
    z = x[held] @ w + bias
    curves = [logistic(z[:, k].astype(float), truth[held][:, k].astype(float)) for k in range(y.shape[1])]
    return Model(buckets, w.astype(float).round(9), bias.astype(float), curves)


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, lines: array of (place, line)): runs of lines with a letter or digit, stripped of comment marks; places count from 0.

    Every step is linear in the text: lines carry their places through a join and a split at blank lines.
    """
    stems = F.array(*map(F.lit, STEMS))
    maybe = F.get(F.transform(F.array(F.lower(F.col(text))), lambda t: F.exists(stems, lambda c: F.contains(t, c))), F.lit(0))
    mark = F.lit("\x01")
    placed = F.transform(F.split(F.col(text), "\n"), lambda x, i: F.when(x.rlike(r"[\p{L}\p{N}]"), F.concat(i.cast("string"), mark, F.regexp_replace(x, _COMMENT, ""))).otherwise(""))
    runs = F.filter(F.split(F.array_join(placed, "\n"), r"\n{2,}"), lambda x: x.rlike(CUES))
    rows = docs.where(maybe).select("doc_id", F.explode(runs).alias("run"))
    line = lambda x: F.struct(F.substring_index(x, "\x01", 1).cast("int").alias("place"), F.regexp_replace(x, "^[0-9]+\x01", "").alias("line"))
    return rows.select("doc_id", F.transform(F.filter(F.split("run", "\n"), lambda x: x != ""), line).alias("lines"))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, part, place, kind, words) of what is scored: kind 0 lines, 1 whole paragraphs, 2 windows; part numbers paragraphs."""
    held = lambda place, kind, words: F.struct(place.alias("place"), F.lit(kind).alias("kind"), words.alias("words"))
    parts = paragraphs(docs, text).withColumn("whole", F.array_join(F.col("lines.line"), " ")).where(F.col("whole").rlike(CUES))
    parts = parts.select("doc_id", F.monotonically_increasing_id().alias("part"), "lines", clean_words(F.col("whole")).alias("words"), F.get("lines", F.lit(0))["place"].alias("place"))
    lines = F.filter(F.transform("lines", lambda x: held(x["place"], 0, F.when(x["line"].rlike(CUES), clean_words(x["line"])))), lambda c: (F.size(c["words"]) > 0) & (F.size(c["words"]) <= LONGEST_LINE))
    whole = F.filter(F.array(held(F.col("place"), 1, F.col("words"))), lambda c: ((F.size("lines") > 1) | (F.size("words") > LONGEST_LINE)) & (F.size("words") <= LONGEST))

    def windows(size: int) -> Column:
        """Pairs of neighbouring halves; a slice for each window would read the whole array each time."""
        halves = F.regexp_extract_all(F.when(F.size("words") > LONGEST_LINE, F.array_join("words", " ")).otherwise(""), F.lit(rf"(?:[^ ]+ ){{0,{size // 2 - 1}}}[^ ]+"), F.lit(0))
        paired = F.get(F.transform(F.array(halves), lambda h: F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))), F.lit(0))
        return F.transform(F.filter(paired, lambda x: x.rlike(CUES)), lambda x: held(F.col("place"), 2, F.split(x, " ")))

    rows = parts.select("doc_id", "part", F.explode(F.concat(lines, whole, *map(windows, WINDOWS))).alias("c"))
    return rows.select("doc_id", "part", "c.*")


def _share(words: Column, texts: tuple[str, ...]) -> Column:
    """The largest share of the words of one of ``texts`` that a candidate has."""
    sets = [sorted(set(_words(t))) for t in texts]
    found = [F.size(F.array_intersect(words, F.from_json(F.lit(json.dumps(s)), "array<string>"))) / len(s) for s in sets]
    return F.greatest(*found) if len(found) > 1 else found[0]


def scored(found: DataFrame, model: Model) -> DataFrame:
    """``found`` (with a column id) and of each candidate notice, share (of a telling notice's words), family (null without one), strength."""
    idx = found.select("id", F.explode(grams(F.col("words"))).alias("bucket"), F.sqrt(F.greatest(2 * F.size("words") - 1, F.lit(1))).alias("by"))
    sums = idx.join(F.broadcast(model.table(found.sparkSession)), "bucket").groupBy("id").agg(*(F.sum(F.get("weights", F.lit(k)) / F.col("by")).alias(f"z{k}") for k in range(1 + len(FAMILIES))))
    both = found.join(sums, "id", "left")

    def probability(k: int) -> Column:
        slope, offset = model.curves[k]
        return 1 / (1 + F.exp(-(F.lit(slope) * (F.coalesce(f"z{k}", F.lit(0.0)) + float(model.bias[k])) + F.lit(offset))))

    telling = tuple(t for ts in (UNNAMED, *TEMPLATES.values()) for t in ts if len(set(_words(t))) >= TELLING)
    shares = [_share(F.col("words"), ts) for ts in (telling, *TEMPLATES.values())]
    wide = both.withColumns({"p": F.array(*(probability(k) for k in range(1 + len(FAMILIES)))), "share": F.array(*shares)})
    likes = F.array(*(F.struct((F.get("p", F.lit(k)) * F.get("share", F.lit(k))).alias("s"), F.lit(f).alias("family"), F.get("p", F.lit(k)).alias("p"), F.get("share", F.lit(k)).alias("share")) for k, f in enumerate(FAMILIES, 1)))
    best = F.array_max(F.filter(likes, lambda x: (x["p"] >= NAMED) & (x["share"] >= TEMPLATE_SHARE)))
    return wide.withColumn("best", best).select("id", "doc_id", "part", "place", "kind", "words", F.get("p", F.lit(0)).alias("notice"), F.get("share", F.lit(0)).alias("share"), F.col("best.family").alias("family"), F.coalesce("best.s", F.get("p", F.lit(0)) * 0.0).alias("strength"))


def notices(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, place, family, notice): the notices of each paragraph."""
    bounded_batches(docs.sparkSession)
    every = max(1, docs.count() // BACKGROUND_DOCS)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    model = fitted(docs.sparkSession, some.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line")).where(F.col("line").rlike(r"[\p{L}\p{N}]")))
    found = saved(candidates(docs, text).withColumn("id", F.monotonically_increasing_id()), "licence-candidates")
    all_ = scored(found, model).where(((F.col("notice") >= NOTICE) & F.col("family").isNotNull()) | ((F.col("notice") >= UNKNOWN) & (F.col("share") >= TEMPLATE_SHARE)))
    line = F.struct((F.col("kind") == 0).alias("line"), "strength", "notice", (-F.col("place")).alias("after"), "family", "place")
    parts = all_.groupBy("doc_id", "part").agg(
        F.collect_set(F.when((F.col("kind") == 0) & F.col("family").isNotNull(), F.col("family"))).alias("named"),
        F.max(F.when(F.col("family").isNotNull(), line)).alias("best"),
        F.min(F.when((F.col("kind") == 0) & F.col("family").isNotNull(), F.col("place"))).alias("first"),
        F.max("notice").alias("notice"),
        F.min("place").alias("place"),
    )
    families = F.when(F.size("named") > 0, F.col("named")).when(F.col("best").isNotNull(), F.array("best.family")).otherwise(F.array(F.lit("unknown")))
    return parts.select("doc_id", F.coalesce("first", "best.place", "place").alias("place"), F.explode(families).alias("family"), "notice")


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_notices, family, families, first_line: a row for each distinct doc_id."""
    found = notices(docs, text).groupBy("doc_id", "family").agg(F.count("*").alias("n"), F.min("place").alias("first_line"))
    none = docs.select("doc_id", F.lit(None).cast("string").alias("family"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("first_line"))
    out = none.unionByName(found).groupBy("doc_id").agg(
        F.sum("n").alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.min("first_line").alias("first_line"),
        F.collect_set(F.when(F.col("family").isNotNull(), F.struct((-F.col("n")).alias("n"), "family"))).alias("ranked"),
    )
    return out.select("doc_id", "n_notices", F.array_min("ranked")["family"].alias("family"), "families", "first_line")
