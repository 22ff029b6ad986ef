"""Rules fire on all they name, gates let them through, and suppression equals a plain version over all intervals."""

import re
from itertools import product
from re import _parser

from tessera.llm import licenses


def texts(parsed):
    """Strings of a pattern: every alternative, and what may be there or not both ways."""
    out = [""]
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            some = [chr(value)]
        elif name == "ANY":
            some = ["x"]
        elif name == "IN":
            some = [chr(c) for k, v in value for c in ([v] if str(k) == "LITERAL" else v)]
        elif name == "BRANCH":
            some = [t for p in value[1] for t in texts(p)]
        elif name == "SUBPATTERN":
            some = texts(value[3])
        else:
            assert name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] in (0, 1)
            some = [""] * (value[0] == 0) + texts(value[2])
        out = [a + b for a, b in product(out, some)]
    return out


def test_keywords_and_gates_pass_all_alternatives():
    for label, keywords, pattern, *_ in licenses.rules():
        for form in texts(_parser.parse(pattern)):
            plain = f" {' '.join(form.split())} "
            assert keywords and set(keywords) <= set(plain.split()) and any(g in plain for g in licenses.GATES), (label, plain)
            assert re.fullmatch(pattern, form), (label, plain)


def test_there_are_hundreds_of_rules():
    rules = licenses.rules()
    assert len(rules) > 300 and len({r[2] for r in rules}) > 300 and len({r[0] for r in rules}) > 100


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
NAMED = {
    "the FreeBSD license": "bsd-2-clause", "GPL v2": "gpl-2.0", "GPLv2": "gpl-2.0", "GPLv3": "gpl-3.0", "GPL-2.0-only": "gpl-2.0-only", "GPL-2.0-or-later": "gpl-2.0-or-later", "AGPLv3": "agpl-3.0",
    "LGPLv2.1": "lgpl-2.1", "under the GPL": "gpl", "SPDX-License-Identifier: MPL-2.0": "mpl-2.0", "SPDX-License-Identifier: EPL-2.0": "epl-2.0", "Apache License v2.0": "apache-2.0",
    "GNU General Public License v3": "gpl,gpl-3.0", MIT: "mit", BSD: "bsd,bsd-3-clause", GPL: "gpl,gpl-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": "gpl-2.0-only,gpl-classpath-exception",
    "Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "no license here, mit freundlichen": "",
    "http://creativecommons.org/licenses/by/4.0": "creative-commons", "Copyright (c) 2020 A. Author. All rights reserved.": "copyright-notice,reserved",
}


def plain(text):
    """Labels and score from all matches of all rules, without keywords, gates or normal-form tricks but the form itself."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    form = "".join(f" {w} " for w in words)
    found = sorted((m.start(), -m.end(), -priority, label, confidence) for label, _, pattern, priority, confidence in licenses.rules() for m in re.finditer(pattern, form))
    kept, labels, score = [], set(), 0.0
    for start, back, rank, label, confidence in found:
        if not any(-b >= -back and r <= rank for _, b, r, *_ in kept):
            labels.add(label)
            score = max(score, confidence)
        kept.append((start, back, rank))
    base = {label for phrase, label in licenses.BASE.items() if any(words[k : k + len(phrase.split())] == phrase.split() for k in range(len(words)))}
    return ",".join(sorted(labels | base)), max(score, 0.5 * bool(base))


def test_labels_equal_the_plain_version(spark):
    rules = licenses.rules()
    made = [" ".join(texts(_parser.parse(r[2]))[k % 3 if k % 3 < len(texts(_parser.parse(r[2]))) else 0].split()) for k, r in enumerate(rules)]
    mixed = [f"{made[k]}. {made[(k * 7 + 3) % len(made)]} or later {made[(k * 13 + 5) % len(made)]}, mit" for k in range(len(made))]
    all_texts = [*NAMED, *made, *mixed, None, "", " ".join(made)]
    found = licenses.scan(spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")).collect()
    assert len(found) == len(all_texts)
    for r in found:
        assert (r.labels, r.score) == plain(all_texts[r.doc_id]), all_texts[r.doc_id]
        if all_texts[r.doc_id] in NAMED:
            assert r.labels == NAMED[all_texts[r.doc_id]], all_texts[r.doc_id]
