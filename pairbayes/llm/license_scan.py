"""Licence scan, with DataFrame functions only.

Every text is cut into passages: its lines (lines over ``LONG`` terms as
overlapping windows), and wherever a key of a template stands, the stretch of the
template's own length that has the key in the template's place, across line ends,
so that a statement inside prose is compared without the words around it.  A
passage's sparse TF-IDF vector is compared by cosine with the templates whose key
it holds.  Inverse document frequencies of the templates' terms are counted over
all files and end at a share of 1 in ``RARE`` files; a term that no template has
weighs as the template's terms do (their root mean square).  So shares, not the
number of files, settle a score.

The key of a template is the term that names its licence (``KEYS``), without which
a statement is no evidence of it.  A template without such a term has as keys its
heaviest terms, those without which the rest of its norm falls short of the
threshold.  Texts without any key are passed over exactly.

A file is a licence file by its name, or if the matched passage is at least
``COVER`` of its terms.  A file without a licence of its own takes that of the
licence file in the nearest directory above it: directories (not files) are
joined with their ancestors, and files then with their directory.

Null and blank texts have no licence of their own; a null path has no directory
and inherits none.  Repeated rows are judged alike.  Among equal scores the
first licence name wins.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairbayes.llm.common import stash

THRESHOLD, COVER, LONG, WINDOW, RARE = 0.55, 0.1, 48, 24, 1000

SPDX = ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "ISC", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "Unlicense", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
_FREE = "is free software: you can redistribute it and/or modify it under the terms of the GNU"
_LATER = "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: Templates: SPDX lines, statements in headers and first sentences of licence files (fixed values).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("MIT", "MIT License Copyright (c)"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", f"This program {_FREE} General Public License {_LATER.format(3)}"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", f"This program {_FREE} General Public License {_LATER.format(2)}"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    *(("LGPL-2.1", f"This {what} {_FREE} Lesser General Public License {_LATER.format(2.1)}") for what in ("library", "program")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    *(("LGPL-3.0", f"This {what} {_FREE} Lesser General Public License {_LATER.format(3)}") for what in ("library", "program")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", f"This program {_FREE} Affero General Public License {_LATER.format(3)}"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "ISC License Copyright (c)"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    *((name, f"SPDX-License-Identifier: {name}") for name in SPDX),
)
#: Terms that name a licence: the first of them that a template has is its key.
KEYS = ("mit", "apache", "affero", "agpl", "lesser", "lgpl", "gnu", "gpl", "nc", "noncommercial", "sa", "sharealike", "cc", "commons", "mozilla", "mpl", "isc", "bsd", "unencumbered", "unlicense")
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"


def terms_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _terms(text: str) -> list[str]:
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()


def weights(templates, frequency: dict[str, int], n: int) -> tuple[dict[str, float], list[tuple[str, dict[str, float]]]]:
    """Inverse frequencies of the templates' terms, and each template's unit vector."""
    idf = {t: min(math.log((n + 1) / (frequency.get(t, 0) + 1)), math.log(RARE)) + 1 for _, text in templates for t in _terms(text)}
    out = []
    for name, text in templates:
        words = _terms(text)
        raw = {t: (1 + math.log(words.count(t))) * idf[t] for t in sorted(set(words))}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        out.append((name, {t: w / norm for t, w in raw.items()}))
    return idf, out


def anchors(vector: dict[str, float], threshold: float) -> list[str]:
    """A template's heaviest terms, until the rest weighs below the threshold: a match must hold one."""
    out, rest = [], 1.0
    for t, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
        if rest < threshold**2:
            break
        out.append(t)
        rest -= w * w
    return out


def keys_of(vector: dict[str, float], threshold: float) -> list[str]:
    """Terms of which a passage must hold one to be compared with a template."""
    return [k for k in KEYS if k in vector][:1] or anchors(vector, threshold)


def passages(text: Column) -> Column:
    """Term arrays of the lines; a long line as windows that overlap by half, the last ending at its last term."""
    lines = F.transform(F.split(text, "[\\n\\r]+"), terms_of)
    last = lambda t: F.size(t) - (WINDOW - 1)
    starts = lambda t: F.array_append(F.sequence(F.lit(1), F.greatest(last(t) - 1, F.lit(1)), F.lit(WINDOW // 2)), last(t))
    cut = F.transform(lines, lambda t: F.when(F.size(t) > LONG, F.transform(starts(t), lambda i: F.slice(t, i, WINDOW))).otherwise(F.array(t)))
    return F.flatten(cut)


def candidates(text: Column, templates, keys: list[list[str]]) -> Column:
    """(k, p): the template k and a passage p to compare with it."""
    words = [_terms(t) for _, t in templates]
    field = lambda *v: F.struct(*[F.lit(x).alias(n) for n, x in zip(("key", "k", "back", "size"), v, strict=True)])
    places = F.array(*[field(t, k, i, len(w)) for k, w in enumerate(words) for i, t in enumerate(w) if t in keys[k]])
    holders = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, ts)).alias("keys")) for k, ts in enumerate(keys)])
    need = F.array(*[F.lit(t) for t in sorted({t for ts in keys for t in ts})])
    pair = lambda k, p: F.struct(k.alias("k"), p.alias("p"))
    lines = F.filter(passages(text), lambda p: F.arrays_overlap(p, need))
    whole = F.transform(lines, lambda p: F.transform(F.filter(holders, lambda h: F.arrays_overlap(p, h["keys"])), lambda h: pair(h["k"], p)))
    # an array of one, so that the terms of a text are made once
    start = lambda t, i, e: F.greatest(F.least(i - e["back"], F.size(t) - e["size"]) + 1, F.lit(1))
    around = lambda t, x: F.transform(F.filter(places, lambda e: e["key"] == x["t"]), lambda e: pair(e["k"], F.slice(t, start(t, x["i"], e), e["size"])))
    found = lambda t: F.filter(F.transform(t, lambda x, i: F.struct(x.alias("t"), i.alias("i"))), lambda x: F.array_contains(need, x["t"]))
    near = F.flatten(F.transform(F.array(terms_of(text)), lambda t: F.flatten(F.transform(found(t), lambda x: around(t, x)))))
    return F.array_distinct(F.concat(F.flatten(whole), near))


def matched(found: Column, idf: dict[str, float], vectors: list) -> Column:
    """(score, name, terms) of a candidate."""
    table = F.create_map(*[F.lit(x) for t in sorted(idf) for x in (t, idf[t])])
    units = F.array(*[F.create_map(*[F.lit(x) for t, w in v.items() for x in (t, w)]) for _, v in vectors])
    others = F.array(*[F.lit(math.sqrt(sum(idf[t] ** 2 for t in v) / len(v))) for _, v in vectors])
    at = lambda values: F.element_at(values, found["k"] + 1)
    times = lambda t: F.size(F.filter(found["p"], lambda x: x == t)).cast("double")
    weight = lambda t: F.coalesce((1 + F.log(times(t))) * F.try_element_at(table, t), at(others))
    weighed = F.transform(F.array_distinct(found["p"]), lambda t: F.struct(weight(t).alias("w"), F.coalesce(F.try_element_at(at(units), t), F.lit(0.0)).alias("u")))
    sums = F.aggregate(
        weighed, F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("square")),
        lambda s, x: F.struct((s["dot"] + x["w"] * x["u"]).alias("dot"), (s["square"] + x["w"] * x["w"]).alias("square")),
        lambda s: F.coalesce(F.round(F.try_divide(s["dot"], F.sqrt(s["square"])), 9), F.lit(0.0)),
    )
    return F.struct(sums.alias("score"), at(F.array(*[F.lit(name) for name, _ in vectors])).alias("name"), F.size(found["p"]).alias("terms"))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` with ``own_license``, ``own_score`` and ``license_file``."""
    vocabulary = sorted({t for _, text in templates for t in _terms(text)})
    body = F.coalesce(F.col(text_col), F.lit(""))
    present = files.select(F.explode(F.array_append(F.array_intersect(terms_of(body), F.array(*[F.lit(t) for t in vocabulary])), F.lit(""))).alias("term"))
    counts = {r["term"]: r["count"] for r in present.groupBy("term").count().collect()}  # at most the vocabulary
    idf, vectors = weights(templates, counts, counts.get("", 0))
    keys = [keys_of(v, threshold) for _, v in vectors]
    maybe = F.lower(body).rlike("(?<![a-z0-9])(?:" + "|".join(sorted({t for ts in keys for t in ts})) + ")(?![a-z0-9])")
    rows = files.withColumn("_p", F.when(maybe, candidates(body, templates, keys)).otherwise(F.array().cast("array<struct<k:int,p:array<string>>>")))
    rows = rows.withColumn("_s", F.transform("_p", lambda c: matched(c, idf, vectors)))
    best = F.aggregate("_s", F.struct(F.lit(0.0).alias("score"), F.lit("").alias("name"), F.lit(0).alias("terms")), lambda a, b: F.when(b["score"] > a["score"], b).when((b["score"] == a["score"]) & (b["name"] < a["name"]), b).otherwise(a))
    rows = rows.withColumn("_b", F.when(F.size("_s") > 0, best))
    sure = F.col("_b.score") >= threshold
    name = F.element_at(F.split(F.col(path_col), "/"), -1)
    covers = F.when(sure, F.col("_b.terms") >= COVER * F.size(terms_of(body))).otherwise(False)
    rows = rows.withColumns({"own_license": F.when(sure, F.col("_b.name")), "own_score": F.when(sure, F.round("_b.score", 6)), "license_file": F.coalesce(sure & (covers | F.coalesce(name.rlike(LICENSE_NAME), F.lit(False))), F.lit(False))})
    return rows.drop("_p", "_s", "_b")


def inherit(scanned: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``license`` and ``inherited_from``: a file's own, or that of the nearest directory above."""
    parts = F.split(F.col(path_col), "/")
    # the scan is read by three branches: written once, without the texts
    rows = stash(scanned).withColumn("_dir", F.concat_ws("/", F.slice(parts, 1, F.size(parts) - 1)))
    rows = rows.withColumn("_dir", F.when(F.col(path_col).isNotNull(), F.col("_dir")))
    held = rows.where("license_file and _dir is not null")
    held = held.groupBy(F.col("_dir").alias("above")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("license"), F.col(path_col).alias("from"))).alias("best"))
    dirs = rows.where("_dir is not null").select("_dir").distinct()
    steps = F.split("_dir", "/")
    chain = dirs.select("_dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.concat_ws("/", F.slice(steps, 1, k)))).alias("depth", "above"))
    near = chain.join(held, "above").groupBy("_dir").agg(F.max(F.struct("depth", "best")).alias("m"))
    near = near.select("_dir", F.col("m.best.license").alias("_license"), F.col("m.best.from").alias("_from"))
    out = rows.join(near, "_dir", "left")
    return out.withColumns({"license": F.coalesce("own_license", "_license"), "inherited_from": F.when(F.col("own_license").isNull(), F.col("_from"))}).drop("_dir", "_license", "_from")
