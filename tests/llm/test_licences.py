from lectern.llm import licences

NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "licensed under cc by-sa 4.0": "CC-BY-SA",
    "All rights reserved.": "proprietary",
    "// SPDX-License-Identifier: BSD-3-Clause": "BSD",
    "The text before it. Released under the MIT License. The text after it goes on.": "MIT",
}
OTHERS = ["My driving license is in the car.", "You need permission from your mother to go", "Copyright is a right.", "the license of the MIT museum shop was renewed in May", "nothing at all", "", "licence"]


def test_paragraphs():
    assert {t: licences.classify(t) for t in NOTICES} == NOTICES
    assert {licences.classify(t) for t in OTHERS} == {"unknown"}


def test_columns_equal_plain_python(spark):
    texts = [*NOTICES, *OTHERS, *licences.OTHER, *(t for ts in licences.TEMPLATES.values() for t in ts), None, "\n".join([*NOTICES, *OTHERS, *NOTICES]), "x\n" * 50_000 + "All rights reserved", "word " * 100_000 + "license", "LICENSED UNDER\nthe Apache License, Version 2.0", "!!!\nlicen$e\n\n"]
    df = spark.createDataFrame([(i, t, ["x"]) for i, t in enumerate(texts)] + [(0, texts[0], []), (None, texts[1], None)], "doc_id long, text string, families array<string>").repartition(2)
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        found = [(k, licences.classify(p)) for k, p in enumerate(lines, 1)]
        hits = [(k, f) for k, f in found if f != "unknown"]
        r = got[i]
        assert (r.families, r.n_notices, r.first_line) == (sorted({f for _, f in hits}), len(hits), hits[0][0] if hits else None), t
        assert r.candidates == sum(any(a in p.lower() for a in licences.ANCHORS) for p in lines)
    assert got[None].families == ["MIT"]
    assert licences.scan(df.limit(0)).count() == 0


def test_plan_is_native(spark):
    plan = licences.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "BSD": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:""",
    "GPL-2.0": """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "LGPL": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


def test_wrapped_notices(spark):
    import random

    r = random.Random(4)
    cases = [(name, f"{before}{t}{after}") for name, t in WRAPPED.items() for before, after in (("", ""), ("Some words of a file.\n\n", "\n\nMore of it."), ("Plain prose goes before it\n", "\nand after it"))]
    pool = [*(x for t in WRAPPED.values() for x in t.split("\n")), *NOTICES, *OTHERS, "", " ", "//"]
    texts = [t for _, t in cases] + ["\n".join(r.choice(pool) for _ in range(r.choice([1, 4, 12]))) for _ in range(40)] + [None, "\n\n", "LICENSED UNDER\nthe Apache License, Version 2.0", "LICENSED UNDER\n\nthe Apache License, Version 2.0", "x\n" * 20_000 + "All rights reserved"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in licences.scan(df, wrapped=True).collect()}
    for i, (name, t) in enumerate(cases):
        assert got[i].families == [name], t
    for i, t in enumerate(texts[:-1]):
        want = licences.notices(t or "")
        assert (got[i].families, got[i].n_notices, got[i].first_line) == (sorted({f for *_, f in want}), len(want), min((a for a, *_ in want), default=None)), t
    assert (got[len(texts) - 1].families, got[len(texts) - 1].first_line) == (["proprietary"], 20_001)


def test_anchors_lose_nothing(spark, monkeypatch):
    named = {"Released under CC0 1.0 Universal": "CC0", "Available under CC BY-SA 4.0": "CC-BY-SA", "Available under CC BY 4.0": "CC-BY"}
    assert {t: licences.classify(t) for t in named} == named
    rows = licences.scan(spark.createDataFrame(list(enumerate(named)), "doc_id long, text string"), wrapped=True).collect()
    assert {r.doc_id: r.families for r in rows} == {i: [f] for i, f in enumerate(named.values())}
    assert licences.uncovered(licences.ANCHORS) == []
    assert licences.uncovered(("licen", "copyright", "rights reserved", "permission", "redistribut", "public domain", "spdx"))
    texts = [" ".join(w for k, w in enumerate(licences.words_of(t)) if k != out) for ts in licences.TEMPLATES.values() for t in ts for out in range(30)]
    some = [licences.classify(t) for t in texts]
    monkeypatch.setattr(licences, "ANCHORS", ("",))
    assert some == [licences.classify(t) for t in texts]


#: Notices and other lines whose wording isn't the module's.
UNSEEN = {
    "License: MIT": "MIT",
    "Released under GPL-3.0": "GPL-3.0",
    "Apache-2.0 license": "Apache-2.0",
    "The photos are under the CC BY-SA 4.0": "CC-BY-SA",
    "Our code is licensed under the MIT License, see LICENSE.": "MIT",
    "This package is distributed under the MPL-2.0.": "MPL-2.0",
    "(c) 2021 the team. License: ISC": "ISC",
    "You may use it; it is available under the LGPL-2.1.": "LGPL",
    "Licensed under GPLv2, see COPYING": "GPL-2.0",
    "The data are released under CC0.": "CC0",
    "BSD 2-Clause license": "BSD",
    "All text is available under CC BY 4.0.": "CC-BY",
    "Drawings: licensed under CC BY-ND.": "CC-BY-ND",
    "We publish under the AGPLv3 license": "AGPL",
    "Copyright 2020 Some Person. All rights reserved.": "proprietary",
    "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 3": "GPL-3.0",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file": "Apache-2.0",
    "Lizenz: licensed under CC BY-NC 4.0. Alle Rechte": "CC-BY-NC",
}
UNSEEN_OTHER = (
    "All rights reserved seating at the theatre was sold", "His boat license ran out in June", "The public was generally free to enter under the new law", "She released the birds under a clear sky",
    "Version 2.0 of the plan is available under the old name", "MIT students asked for a license to dig", "The Apache tribe was granted land", "Permission to land was granted at noon", "The copyright office is closed on Monday",
    "A creative common room for all", "The foundation published a list of members", "Distributed under the tree were many gifts", "It is subject to change", "Redistribution of wealth is a topic of this book",
    "Driving license: MIT students only", "He came under the MIT dome", "Software for the source of the river", "The general reserved his right to speak", "The binary forms of the word are listed here",
)


def test_unseen_wording():
    said = {t: licences.classify(t) for t in (*UNSEEN, *UNSEEN_OTHER)}
    found = [t for t, k in said.items() if k != "unknown"]
    right = [t for t in found if UNSEEN.get(t) == said[t]]
    assert len(right) / len(found) >= 0.95 and len(right) / len(UNSEEN) >= 0.95, {t: said[t] for t in said if said[t] != UNSEEN.get(t, "unknown")}
    assert said["All rights reserved seating at the theatre was sold"] == "unknown"


def test_unseen_wording_in_columns(spark):
    texts = [*UNSEEN, *UNSEEN_OTHER, "a|b license mit", "License: MIT|GPL", "all rights reserved", "All rights reserved\u00a0", "license: mit)\nx"]
    got = {r.doc_id: r.families for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), wrapped=True).collect()}
    assert got == {i: sorted({f for *_, f in licences.notices(t)}) for i, t in enumerate(texts)}


def test_combined_creative_commons_terms():
    for terms, name in (("NonCommercial-ShareAlike", "CC-BY-NC-SA"), ("NonCommercial-NoDerivatives", "CC-BY-NC-ND"), ("NonCommercial", "CC-BY-NC"), ("ShareAlike", "CC-BY-SA"), ("NoDerivatives", "CC-BY-ND")):
        assert licences.classify(f"This work is licensed under a Creative Commons Attribution-{terms} 4.0 International License.") == name
        assert licences.classify(f"Licensed under {name.replace('CC-', 'CC ')} 4.0.") == name
