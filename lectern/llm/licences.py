"""Licence notices in texts: a trained paragraph classifier, confirmed by templates.

A paragraph (a line of the text, or with `wrapped` a window of lines, below) that holds one of ANCHORS is reduced to lower-case words; its distinct word n-grams
(one to three words) are the features of a softmax regression with an L1 penalty, trained on the driver from the
templates below, variants of them, and paragraphs of other kinds. Each family is a class and so is `unknown`. The
probability from which a family counts is placed between what held-out variants and held-out other paragraphs
reach. A prediction holds only if a template of its family is confirmed: of a template of more than SHORT words CONFIRM are
in the paragraph; of a shorter one all pairs of neighbours are, where a full stop that a template ends with must
be the end of a clause or of the paragraph. Short templates are made from FRAMES and the NAMES of each family.

With `wrapped`, notices broken over lines are found too: lines up to a blank one are a block, and the windows of
consecutive lines of a block are paragraphs of their own, up to SPAN words between first and last line (lines without
words don't count). A window is a notice if it's the shortest: no window inside it is one, nor one of the same family that
overlaps it from before. So each line that is a notice stays one, and lines are joined where none is.

All work on the texts is built-in column functions, row by row: no exchange, no Python on executors. The
model is a few hundred n-grams, a literal in the plan.

Defined cases: null and empty texts have no notice; a paragraph (line or window) counts once, whatever it repeats; a text may have notices
of several families; rows that repeat an id are scanned one by one; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a paragraph must hold to be looked at, and notices of each family. No choice of CONFIRM of a template's
#: words is without an anchor (`uncovered` is empty, or there is no model), so the anchors save work and lose nothing.
ANCHORS = ("licen", "copyright", "reserved", "permission", "distribut", "spdx", "cc", "gnu", "creative", "released", "mozilla", "subject", "hereby", "granted", "obtaining", "permitted", "binary", "modif", "foundation", "published", "software", "domain", "dedicated", "available", "gpl", "noncommercial")
TEMPLATES = {
    "AGPL": ("This program is licensed under the GNU Affero General Public License, version 3", "Licensed under the AGPL version 3 license", "SPDX-License-Identifier: AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Released under the Apache 2.0 License", "SPDX-License-Identifier: Apache-2.0"),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License", "Licensed under the BSD License", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-ND": ("Licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA": ("Licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-ND": ("Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0": ("Licensed under CC0 1.0 Universal", "This work is dedicated to the public domain under CC0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "Licensed under the GPL version 2 license", "SPDX-License-Identifier: GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "Licensed under the GPL version 3 license", "SPDX-License-Identifier: GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "ISC": ("Released under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License", "Licensed under the LGPL license", "SPDX-License-Identifier: LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License"),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License", "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part may be reproduced without permission"),
}
#: How families are named in short notices, and what stands around a name.
NAMES = {
    "AGPL": ("AGPL", "AGPL-3.0", "AGPLv3", "GNU AGPL"),
    "Apache-2.0": ("Apache-2.0", "Apache 2.0", "Apache License 2.0"),
    "BSD": ("BSD", "BSD-3-Clause", "BSD-2-Clause", "3-Clause BSD", "2-Clause BSD"),
    "CC-BY": ("CC BY", "CC BY 4.0", "CC BY 3.0"),
    "CC-BY-NC": ("CC BY-NC", "CC BY-NC 4.0"),
    "CC-BY-NC-ND": ("CC BY-NC-ND", "CC BY-NC-ND 4.0"),
    "CC-BY-NC-SA": ("CC BY-NC-SA", "CC BY-NC-SA 4.0"),
    "CC-BY-ND": ("CC BY-ND", "CC BY-ND 4.0"),
    "CC-BY-SA": ("CC BY-SA", "CC BY-SA 4.0", "CC BY-SA 3.0"),
    "CC0": ("CC0", "CC0 1.0", "CC0 1.0 Universal"),
    "GPL-2.0": ("GPL-2.0", "GPLv2", "GPL version 2", "GNU GPL v2"),
    "GPL-3.0": ("GPL-3.0", "GPLv3", "GPL version 3", "GNU GPL v3"),
    "ISC": ("ISC",),
    "LGPL": ("LGPL", "LGPL-2.1", "LGPL-3.0", "GNU LGPL"),
    "MIT": ("MIT", "Expat"),
    "MPL-2.0": ("MPL-2.0", "MPL 2.0"),
}
FRAMES = ("License: {}.", "{} license", "licensed under {}.", "licensed under the {}.", "released under {}.", "released under the {}.", "available under {}.", "available under the {}.", "distributed under the {}.", "under the {} license", "SPDX-License-Identifier: {}.")
OTHER = (
    "He lost his driving license on the way home", "The license plate of the car was covered in mud", "Ask for permission before you enter the house",
    "Copyright law is older than most people think", "The old copyright office moved to a new building", "Redistributing wealth was the plan of the new government",
    "A fishing licence costs nine dollars in this state", "The licensed premises close at eleven at night", "They granted him permission to leave early",
    "The public domain has many old books and films", "Her poetic license went a little too far this time", "Licensing fees for the stadium went up again last year",
    "The version of the story that the public knew was general and free", "No license was needed for the small boat", "Without permission of the owner nobody may camp here",
    "The company was licensed to sell wine and beer under the new law", "MIT and other schools asked for permission to build a reactor license office",
    "All rights reserved seating at the theatre was sold", "All rights reserved for members of the club are listed below", "The museum reserved all the seats on the right", "They came under the MIT dome at noon", "The letter was sent under CC to the board by him",
    "The film was released under another name in 2.0 million homes", "Water was distributed under the bridge to people", "The house is available under the usual terms", "The new version 3 of the public plan was released under pressure",
    "She was licensed under an old law to sell fish", "The BSD team won the cup under its new coach", "Our driver license: valid until May", "Boots are available under the stairs", "The ISC office grants a license to fishermen",
    "The Apache pilot had a license to fly", "A general with a public license to print money", "Software licenses were discussed at the meeting on open source",
)
#: Words of a template, as a share, that a paragraph must hold, if it has more than SHORT of them; of a shorter one it must hold all pairs of neighbours.
CONFIRM, SHORT = 0.8, 7
UNKNOWN = "unknown"
#: Words that the lines between the first and the last one of a window hold at most; the longest template has 30.
SPAN = 40


#: Where a block ends: before a blank line, and nothing is cut out.
_BLOCK = r"(?<=\n)(?=[ \t\r\f\x0B]*\n)"


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def ngrams_of(ws: list[str]) -> set[str]:
    return {" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)}


def short_notices(name: str) -> list[str]:
    return [f.format(n) for n in NAMES.get(name, ()) for f in FRAMES]


#: What ends a clause (white space follows), and what no word holds.
_ENDS, _NO_WORD = r"[.!?;,)]+(?=[ \t\n\r\f\x0B])", "[^a-z0-9|]+"


def words_with_ends(text: str) -> list[str]:
    """Words, and a bar where a clause or the text ends."""
    return re.sub(_NO_WORD, " ", re.sub(_ENDS, " | ", text.lower().replace("|", " ") + ".\n")).split()


def pairs_of(text: str) -> set[str]:
    """Pairs of neighbouring words and ends."""
    ws = words_with_ends(text)
    return {f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)}


def _template_pairs(t: str) -> set[str]:
    """The pairs that a short template asks for: its end counts only where it's spelt."""
    ws = words_with_ends(t.removesuffix("."))
    return {f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False) if a != "|" and (b != "|" or t.endswith("."))}


def demands(name: str) -> list[tuple[bool, list[str]]]:
    """What each template of a family asks for: whether pairs or words, and them."""
    out = []
    for t in (*TEMPLATES[name], *short_notices(name)):
        ws = set(words_of(t))
        out.append((False, sorted(ws)) if len(ws) > SHORT else (True, sorted(_template_pairs(t))))
    return out


def uncovered(anchors: tuple[str, ...]) -> list[str]:
    """What templates ask for that a paragraph could confirm without holding an anchor."""
    return [" ".join(asked) for name in TEMPLATES for pairs, asked in demands(name) if sum(not any(a in w for a in anchors for w in x.split()) for x in asked) >= (len(asked) if pairs else CONFIRM * len(asked))]


@functools.lru_cache(1)
def model() -> tuple[list[str], dict[str, list[float]], list[float], float]:
    """Classes, weights of each n-gram, biases, and the probability from which a family counts."""
    if lost := uncovered(ANCHORS):
        raise ValueError(f"no anchor for {lost}")
    classes = [*sorted(TEMPLATES), UNKNOWN]
    before = ("", "Note", "This file is part of the project", "Copyright 2019 the authors")
    after = ("", "See the file for details", "you may not use this work except in compliance")
    rows: list[tuple[set[str], int, bool]] = []
    for k, name in enumerate(classes[:-1]):
        for n, (t, (a, b)) in enumerate(itertools.product(TEMPLATES[name], itertools.product(before, after))):
            rows.append((ngrams_of(words_of(f"{a} {t} {b}")), k, n % 5 == 4))
        for n, (t, (a, b)) in enumerate(itertools.product(short_notices(name), ((before[0], after[0]), (before[1], after[0]), (before[0], after[1])))):
            rows.append((ngrams_of(words_of(f"{a} {t} {b}")), k, n % 5 == 4))
    for n, (t, (a, b)) in enumerate(itertools.product(OTHER, itertools.product(before[:3], after[:2]))):
        rows.append((ngrams_of(words_of(f"{a} {t} {b}")), len(classes) - 1, n % 5 == 4))
    seen = Counter(g for grams, _, held in rows if not held for g in grams)
    names = sorted(g for g, n in seen.items() if n > 1)
    at = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, (grams, _, _) in enumerate(rows):
        x[i, [at[g] for g in grams if g in at]] = 1 / math.sqrt(len(grams))
    y, held = np.array([k for _, k, _ in rows]), np.array([h for _, _, h in rows])
    share = np.bincount(y[~held], minlength=len(classes))[y]
    w, b = np.zeros((len(names), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    target, weight = np.eye(len(classes), dtype=np.float32)[y], ((~held / share)[:, None] / len(classes)).astype(np.float32)
    for _ in range(400):  # proximal gradient steps
        p = _softmax(x @ w + b)
        g = (p - target) * weight
        w -= 30 * (x.T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - 30 * 2e-5, 0)
        b -= 3 * g.sum(axis=0)
    p = _softmax(x @ w + b)
    top = p[:, :-1].max(axis=1)
    known = y < len(classes) - 1
    right = p.argmax(axis=1) == y
    low = top[held & ~known].max()
    high = np.quantile(top[held & known & right], 0.02)
    w, b = w.astype(float).round(4), b.astype(float)
    return classes, {n: w[i].tolist() for n, i in at.items() if w[i].any()}, b.round(4).tolist(), round(float((low + high) / 2 if low < high else low), 4)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def classify(text: str) -> str:
    """The family of one paragraph, by the definitions above in plain Python; what the columns below must equal."""
    if not any(a in text.lower() for a in ANCHORS):
        return UNKNOWN
    classes, weights, biases, least = model()
    ws = words_of(text)
    grams = ngrams_of(ws)
    if not grams:
        return UNKNOWN
    z = np.array(biases) + sum((np.array(weights[g]) for g in grams if g in weights), np.zeros(len(classes))) / math.sqrt(len(grams))
    p = _softmax(z[None])[0]
    k = int(p.argmax())
    if classes[k] == UNKNOWN or p[k] < least:
        return UNKNOWN
    held = set(ws), pairs_of(text)
    return classes[k] if any(len(held[pairs] & set(asked)) >= (len(asked) if pairs else CONFIRM * len(asked)) for pairs, asked in demands(classes[k])) else UNKNOWN


def notices(text: str) -> list[tuple[int, int, str]]:
    """First line, last line and family of the notices of a text with `wrapped`, in plain Python; what `scan` must equal."""
    found: list[tuple[int, int, str]] = []
    at = 1
    for block in re.split(_BLOCK, text):
        lines = [(k, x) for k, x in enumerate(block.split("\n"), at) if words_of(x)]
        hits = []
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if sum(len(words_of(x)) for _, x in lines[i + 1 : j]) > SPAN:
                    break
                kind = classify("\n".join(x for _, x in lines[i : j + 1]))
                if kind != UNKNOWN:
                    hits.append((lines[i][0], lines[j][0], kind))
        found += [h for h in hits if not any(o != h and (o[0] >= h[0] and o[1] <= h[1] or o[2] == h[2] and o[0] < h[0] <= o[1] < h[1]) for o in hits)]
        at += block.count("\n")
    return found


def _doubles(xs: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in xs])


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def _pairs(text: Column) -> Column:
    """`pairs_of` as a column."""
    plain = F.concat(F.replace(F.lower(text), F.lit("|"), F.lit(" ")), F.lit(".\n"))
    ws = F.split(F.trim(F.regexp_replace(F.regexp_replace(plain, _ENDS, " | "), _NO_WORD, " ")), " ")
    return F.element_at(F.transform(F.array(ws), lambda ws: F.zip_with(F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, 2, F.size(ws)), lambda a, b: F.concat(a, F.lit(" "), b))), 1)


def family(paragraph: Column) -> Column:
    """The family of a paragraph, `unknown` if none."""
    classes, weights, biases, least = model()
    # the tables are one literal each once constants are folded: thousands of literals would slow planning
    table = F.from_json(F.lit(json.dumps(weights)), "map<string,array<double>>")
    asked = {c: demands(c) for c in classes[:-1]}
    by_words, by_pairs = (F.from_json(F.lit(json.dumps({c: [x for pairs, x in ds if pairs == kind] for c, ds in asked.items()})), "map<string,array<array<string>>>") for kind in (False, True))

    def of(ws: Column) -> Column:
        def runs(n: int) -> Column:
            last = F.size(ws) - (n - 1)
            return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, n), " "))).otherwise(F.array().cast("array<string>"))

        all_ = F.array_distinct(F.concat(runs(1), runs(2), runs(3)))
        zero = _doubles([0.0] * len(classes))
        total = F.aggregate(F.filter(F.transform(all_, lambda g: F.try_element_at(table, g)), lambda v: v.isNotNull()), zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
        z = F.zip_with(total, _doubles(biases), lambda a, b: a / F.sqrt(F.size(all_).cast("double")) + b)

        def decide(z: Column) -> Column:
            top = F.array_max(z)
            p = 1 / F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
            name = F.element_at(F.array(*map(F.lit, classes)), F.array_position(z, top).cast("int"))
            fit = lambda table, held, share: F.coalesce(F.exists(F.try_element_at(table, name), lambda t: F.size(F.array_intersect(held, t)) >= share * F.size(t)), F.lit(False))
            fits = fit(by_words, ws, CONFIRM) | fit(by_pairs, _pairs(paragraph), 1.0)
            return F.when((p >= least) & (name != UNKNOWN) & fits, name).otherwise(F.lit(UNKNOWN))

        return F.element_at(F.transform(F.array(z), decide), 1)

    return F.element_at(F.transform(F.array(_words(paragraph)), of), 1)


def _windows(block: Column, first: Column) -> Column:
    """first, last, family of the windows of a block's lines that are notices; the block's first line is line `first`."""
    anchored = _anchored
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x, i: F.struct((i + first).alias("line"), x.alias("text"), _words(x).alias("ws"))), lambda x: F.element_at(x["ws"], 1) != "")

    def of(lines: Column) -> Column:
        n = F.size(lines)

        def at(k: Column) -> Column:
            part = F.slice(lines, k, SPAN + 2)  # each line between holds a word at least

            def to(part: Column) -> Column:
                ends = F.filter(F.sequence(F.lit(1), F.size(part)), lambda j: (j < 3) | (F.aggregate(F.slice(part, 2, F.greatest(j - 2, F.lit(0))), F.lit(0), lambda acc, x: acc + F.size(x["ws"])) <= SPAN))
                made = F.transform(ends, lambda j: F.struct(F.element_at(part, 1)["line"].alias("first"), F.element_at(part, j)["line"].alias("last"), F.array_join(F.transform(F.slice(part, 1, j), lambda x: x["text"]), "\n").alias("text")))
                return F.filter(made, lambda w: anchored(F.lower(w["text"])))

            return F.element_at(F.transform(F.array(part), to), 1)

        return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), n), at)))

    windows = F.element_at(F.transform(F.array(lines), of), 1)
    said = F.filter(F.transform(windows, lambda w: F.struct(w["first"].alias("first"), w["last"].alias("last"), family(w["text"]).alias("family"))), lambda w: w["family"] != UNKNOWN)

    def shortest(said: Column) -> Column:
        inside = lambda o, h: ((o["first"] != h["first"]) | (o["last"] != h["last"])) & (o["first"] >= h["first"]) & (o["last"] <= h["last"])
        before = lambda o, h: (o["family"] == h["family"]) & (o["first"] < h["first"]) & (h["first"] <= o["last"]) & (o["last"] < h["last"])
        return F.filter(said, lambda h: ~F.exists(said, lambda o: inside(o, h) | before(o, h)))

    return F.coalesce(F.element_at(F.transform(F.array(said), shortest), 1), F.array().cast("array<struct<first:int,last:int,family:string>>"))


def _anchored(text: Column) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(a)) for a in ANCHORS])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wrapped: bool = False) -> DataFrame:
    """Per row: id_col, families (sorted, distinct), n_notices, candidates (lines with an anchor), first_line (from 1; null without a notice)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    anchored = _anchored
    lines = F.filter(F.transform(F.split(text, "\n"), lambda p, i: F.struct((i + 1).alias("line"), p.alias("text"))), lambda p: anchored(F.lower(p["text"])))
    if wrapped:
        empty = F.array().cast("array<struct<line:int,text:string>>")
        start = F.struct(F.lit(1).alias("at"), empty.alias("blocks"))
        count = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
        # blocks without an anchor are left out before any is kept, and only line numbers go on
        add = lambda acc, x: F.struct((acc["at"] + count(x)).alias("at"), F.when(anchored(F.lower(x)), F.concat(acc["blocks"], F.array(F.struct(acc["at"].alias("line"), x.alias("text"))))).otherwise(acc["blocks"]).alias("blocks"))
        blocks = F.aggregate(F.split(text, _BLOCK), start, add)["blocks"]
        hits = F.flatten(F.transform(blocks, lambda p: _windows(p["text"], p["line"])))
        notices = F.transform(hits, lambda h: F.struct(h["first"].alias("line"), h["family"].alias("family")))
        made = F.struct(F.size(lines).alias("candidates"), notices.alias("notices"))
        none = F.struct(F.lit(0).alias("candidates"), F.array().cast("array<struct<line:int,family:string>>").alias("notices"))
        d = docs.select(F.col(id_col), F.when(anchored(F.lower(text)), made).otherwise(none).alias("made")).select(id_col, F.col("made.notices").alias("notices"), F.col("made.candidates").alias("candidates"))
    else:
        said = F.transform(lines, lambda p: F.struct(p["line"].alias("line"), family(p["text"]).alias("family")))
        empty = F.array().cast("array<struct<line:int,family:string>>")
        # texts without an anchor anywhere never reach the branch that splits them
        d = docs.select(F.col(id_col), F.when(anchored(F.lower(text)), said).otherwise(empty).alias("said"))
        d = d.select(id_col, F.filter("said", lambda p: p["family"] != UNKNOWN).alias("notices"), F.size("said").alias("candidates"))
    return d.select(id_col, F.array_sort(F.array_distinct(F.col("notices.family"))).alias("families"), F.size("notices").cast("long").alias("n_notices"), F.col("candidates").cast("long").alias("candidates"), F.array_min(F.col("notices.line")).cast("long").alias("first_line"))
