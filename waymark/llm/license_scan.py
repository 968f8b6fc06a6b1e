"""License scans with MinHash bands over overlapping text windows. DataFrame operations only.

Templates are license notices, headers and the whole texts of short licenses. For each length of template, documents are read in
overlapping windows of that many words, one every eighth of a window (every word where that is
less). Each gets a MinHash signature of BANDS one-row bands. A band of a window equals that of a
template only if one shingle is the least of both, so a window without a shingle of any template
matches no band: such windows are passed over before hashing, which changes nothing of what the bands
retrieve. The window nearest
to a notice is off by a sixteenth at most; where 0.8 of the template is there its Jaccard similarity
J is over 0.5, and it misses every band with probability (1 - J) ** BANDS, under one in four
thousand. Windows and templates that share a band meet; exact containment of the template's
shingles in the window, widened by a fifth on both sides, verifies the match at 0.8 or more.

Defined results: null, empty and short texts match nothing; repeated rows and null ids give rows as
their ids do; templates shorter than a shingle are refused; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import hinted, materialize, shingle_hashes, small_enough, words
from waymark.llm.license_texts import WHOLE

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
BANDS = 12
#: Windows begin at every n // STEPS words, at least at every word.
STEPS = 8
#: Rows up to which a table made from the templates is broadcast; beyond it Spark shuffles.
BROADCAST_ROWS = 500_000

# Short public license notices and the leading text of common licenses, by SPDX name.
TEMPLATES = {
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT (notice)": "Released under the MIT License",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 (notice)": "Licensed under CC BY 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    **WHOLE,
}


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((texts or TEMPLATES).items()), "license string, text string")


def signature(hashes: Column) -> Column:
    """BANDS (band, MinHash) structs of an array of shingle hashes; each band permutes by its own rehash."""

    def least(band: int) -> Column:  # transform() would take a second parameter of its lambda for the index
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band))))

    return F.array(*[F.struct(F.lit(b).alias("band"), least(b).alias("least")) for b in range(BANDS)])


def scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, license, containment, first_word, n_windows): each license found in each document.

    containment is the largest share of the template's distinct shingles within one window widened by
    a fifth on both sides; first_word is the position of the first such window.
    """
    known = licenses.select("license", words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    known = materialize(known.withColumn("shingles", F.array_distinct(shingle_hashes(F.col("words"), SHINGLE_WORDS))), "templates")
    if known.where(F.col("n") < SHINGLE_WORDS).take(1):
        raise ValueError(f"a template has fewer than {SHINGLE_WORDS} words")
    small = small_enough(known.select(F.explode("shingles")), BROADCAST_ROWS)
    lengths = known.select(F.explode("shingles").alias("shingle"), "n").distinct()

    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_t"), F.col(text_col).alias("text"))
    hashed = texts.select("doc_id", "_t", shingle_hashes(words(F.col("text")), SHINGLE_WORDS).alias("all"))
    # Windows of n words, one every `step` words, that hold the shingle at word `at`.
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / STEPS))
    lowest = F.greatest(F.lit(0), F.col("at") + SHINGLE_WORDS - F.col("n"))
    starts = F.explode(F.sequence(F.ceil(lowest / step) * step, F.floor(F.col("at") / step) * step, step)).alias("start")
    start, slack = F.col("start").cast("int"), F.ceil(F.col("n") / 5).cast("int")
    begin = F.greatest(F.lit(0), start - slack)
    inside = F.slice("all", start + 1, F.col("n") - SHINGLE_WORDS + 1).alias("inside")
    wide = F.slice("all", begin + 1, start - begin + F.col("n") - SHINGLE_WORDS + 1 + slack).alias("wide")
    keys = ["doc_id", "_t", start.alias("start"), "n"]
    if small:
        # The templates' shingles go to every task, so windows are cut where the text is: only they are shuffled.
        met = hashed.select("doc_id", "_t", "all", F.posexplode("all").alias("at", "shingle")).join(F.broadcast(lengths), "shingle")
        cut = met.select("doc_id", "_t", "all", "n", starts).select(*keys, inside, wide)
    else:
        met = hashed.select("doc_id", "_t", F.posexplode("all").alias("at", "shingle")).join(lengths, "shingle")
        laid = materialize(met.select("doc_id", "_t", "n", starts).distinct(), "license-windows")
        grouped = laid.groupBy("doc_id", "_t").agg(F.collect_list(F.struct("start", "n")).alias("windows"))
        held = hashed.join(grouped, [hashed["doc_id"].eqNullSafe(grouped["doc_id"]), hashed["_t"].eqNullSafe(grouped["_t"])])
        each = held.select(hashed["doc_id"], hashed["_t"], "all", F.explode("windows").alias("w"))
        cut = each.select("doc_id", "_t", "all", "w.start", "w.n").select(*keys, inside, wide)
    cut = cut.groupBy("doc_id", "_t", "start", "n").agg(F.first("inside").alias("inside"), F.first("wide").alias("wide"))
    # Equal windows, as of a notice that a third of all documents hold, are compared once.
    cut = materialize(cut.withColumn("window", F.sha2(F.concat_ws(",", F.col("n").cast("string"), F.col("inside").cast("array<string>"), F.lit("|"), F.col("wide").cast("array<string>")), 256)), "license-cuts")
    distinct = cut.groupBy("window").agg(F.first("n").alias("n"), F.first("inside").alias("inside"), F.first("wide").alias("wide"))
    a = distinct.select("window", "n", "wide", F.explode(signature(F.col("inside"))).alias("b")).select("window", "n", "wide", "b.band", "b.least")
    b = known.select("license", "n", "shingles", F.explode(signature(F.col("shingles"))).alias("b")).select("license", F.col("n").alias("t"), "shingles", "b.band", "b.least")
    pairs = a.join(hinted(b, small), [a["band"] == b["band"], a["least"] == b["least"], a["n"] == b["t"]])
    share = F.size(F.array_intersect("wide", "shingles")) / F.size("shingles")
    found = pairs.select("window", "license", share.alias("containment")).where(F.col("containment") >= CONTAINMENT).distinct()
    return cut.select("doc_id", "window", "start").join(found, "window").groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("start").alias("first_word"), F.count("*").alias("n_windows"))
