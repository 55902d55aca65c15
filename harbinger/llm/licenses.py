"""Licence scans by sentences and ordered rules.

A text is cut into sentences, each is normalised to lower-case words, and known licence
sentences become identifiers.  The identifiers of a text, in order, are then matched
against rules: a rule is a sequence of identifiers that names a licence.  Rules are
ordered, the more specific first; a matched sequence is used up.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.llm.common import free_name

# Licence sentences as they stand in notices, by identifier.
SENTENCES: dict[str, list[str]] = {
    "apache2-short": [
        "Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0",
        "Licensed under the Apache License 2.0", "Licensed under Apache 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\")",
        "This work is licensed under the Apache License, Version 2.0",
    ],
    "apache2-comply": ["you may not use this file except in compliance with the License"],
    "apache2-copy": ["You may obtain a copy of the License at"],
    "apache2-asis": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "mit-short": [
        "Released under the MIT License", "Licensed under the MIT License", "MIT License", "The MIT License",
        "The MIT License (MIT)", "This project is licensed under the MIT License",
        "This work is licensed under the MIT License",
    ],
    "mit-permission": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ],
    "mit-notice": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software",
    ],
    "isc-permission": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "bsd-head": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ],
    "bsd-source": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer",
    ],
    "bsd-binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution",
    ],
    "bsd-endorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
    ],
    "bsd3-short": ["Licensed under the BSD 3-Clause License", "BSD 3-Clause License", "Released under the BSD 3-Clause License"],
    "bsd2-short": ["Licensed under the BSD 2-Clause License", "BSD 2-Clause License", "Released under the BSD 2-Clause License"],
    "gpl3-short": [
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 3", "Licensed under the GNU GPL v3", "Licensed under GPLv3",
        "Released under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0",
    ],
    "gpl2-short": [
        "This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU GPL v2",
        "Licensed under the GNU General Public License, version 2", "Licensed under GPLv2",
    ],
    "gpl-free": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
    ],
    "gpl2-free": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version",
    ],
    "lgpl-short": ["Licensed under the GNU Lesser General Public License, version 3", "Licensed under the LGPL v3"],
    "agpl-short": ["Licensed under the GNU Affero General Public License, version 3", "Licensed under the AGPL v3"],
    "mpl2-terms": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0", "Licensed under the Mozilla Public License 2.0",
    ],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0",
              "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0", "This work is licensed under CC BY-ND 4.0"],
    "cc0": ["Licensed under CC0 1.0", "This work is licensed under CC0 1.0 Universal",
            "To the extent possible under law, the author has waived all copyright and related rights to this work"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "reserved": ["All rights reserved"],
}

# Ordered rules, licence name and its sequence of sentences.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache2-short", "apache2-comply", "apache2-copy", "apache2-asis"]),
    ("Apache-2.0", ["apache2-short", "apache2-comply", "apache2-copy"]),
    ("Apache-2.0", ["apache2-short", "apache2-comply"]),
    ("Apache-2.0", ["apache2-short"]),
    ("MIT", ["mit-short", "mit-permission", "mit-notice"]),
    ("MIT", ["mit-permission", "mit-notice"]),
    ("MIT", ["mit-short"]),
    ("ISC", ["isc-permission"]),
    ("BSD-3-Clause", ["bsd3-short", "bsd-head", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd2-short", "bsd-head", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", ["bsd-head", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd3-short"]),
    ("BSD-2-Clause", ["bsd2-short"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("GPL-2.0-only", ["gpl2-short"]),
    ("LGPL-3.0-only", ["lgpl-short"]),
    ("AGPL-3.0-only", ["agpl-short"]),
    ("MPL-2.0", ["mpl2-terms"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-ND-4.0", ["cc-by-nd"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("All-Rights-Reserved", ["reserved"]),
]

# A sentence that may state terms holds one of these.  Every known one does, so texts
# without any of them need no cutting; a sentence that holds one and is not known counts as unknown.
CUE = "(?i)licen[cs]e|rights|copyright|permission|redistribut|warrant|unencumbered|free software"

# The three patterns below read alike in Java and in RE2.
WRAPPED = r"([^.!?:;\s])[ \t]*\r?\n[ \t]*([a-z(\"])"
ENDING = r"([.!?:;])[ \t]+"
DROPPED = "[^a-z0-9]+"


def cut(text: str) -> list[str]:
    """Normalised sentences: wrapped lines are joined, a sentence ends at its mark or its line."""
    joined = re.sub(WRAPPED, r"\1 \2", text)
    lines = re.sub(ENDING, "\\1\n", joined).split("\n")
    return [x for x in (re.sub(DROPPED, " ", s.lower()).strip() for s in lines) if x]


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier; where a listed text has marks inside, its longest part."""
    return {max(cut(v), key=len): name for name, variants in SENTENCES.items() for v in variants}


def rule_sequences() -> list[tuple[str, str]]:
    """Licence and its sequence as ``|id||id|``."""
    return [(name, "".join(f"|{i}|" for i in ids)) for name, ids in RULES]


def normalised(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), DROPPED, " "))


def scan(texts: DataFrame, text: str = "text") -> DataFrame:
    """Input columns and ``sentence_ids array<string>`` (known sentences in text order),
    ``licenses array<string>`` (one per matched rule, in rule order), ``n_unknown long`` (sentences that
    speak of terms and are not known).

    Null and empty texts have none.  Repeated rows come out alike; an input column of an
    output's name gives way to it.  All in one projection, without a shuffle.
    """
    fields = ["sentence_ids", "licenses", "n_unknown"]
    known = F.create_map(*[F.lit(x) for pair in sorted(known_sentences().items()) for x in pair])
    held, state = free_name(texts, "_sentences"), free_name(texts, "_matched")
    joined = F.regexp_replace(F.col(text), WRAPPED, "$1 $2")
    pieces = F.filter(
        F.transform(F.split(F.regexp_replace(joined, ENDING, "$1\n"), "\n"), normalised), lambda s: s != ""
    )
    speaking = F.filter(pieces, lambda s: s.rlike(CUE) | known[s].isNotNull())
    nothing = F.array().cast("array<string>")
    cued = texts.withColumn(held, F.when(F.col(text).rlike(CUE), speaking).otherwise(nothing))
    ids = F.filter(F.transform(held, lambda s: known[s]), lambda x: x.isNotNull())
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("ids")) for n, s in rule_sequences()])
    start = F.struct(F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit("|"), x, F.lit("|"))), "").alias("rest"),
                     nothing.alias("found"))

    def apply(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["rest"], rule["ids"])
        return F.struct(
            F.when(hit, F.replace(acc["rest"], rule["ids"], F.lit("#"))).otherwise(acc["rest"]).alias("rest"),
            F.when(hit, F.concat(acc["found"], F.array(rule["name"]))).otherwise(acc["found"]).alias("found"),
        )

    carried = [c for c in texts.columns if c.lower() not in fields]
    numbered = cued.withColumn("sentence_ids", ids)
    matched = numbered.withColumn(
        state, F.when(F.size("sentence_ids") > 0, F.aggregate(rules, start, apply)["found"]).otherwise(nothing)
    )
    return matched.select(
        *[F.col(f"`{c}`") for c in carried], "sentence_ids", F.array_distinct(state).alias("licenses"),
        (F.size(held) - F.size("sentence_ids")).cast("long").alias("n_unknown"),
    )
