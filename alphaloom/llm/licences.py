"""Licence recognition by sentence rules, with DataFrame functions only.

A text is normalised (lower case, letters and digits, single spaces) and cut where a sentence
may end. Stops and blank lines end every sentence; a single line end, a colon or a semicolon may stand within one,
since notices are wrapped and commented out. Runs of parts that make up a known licence sentence are looked
up, the longest first; the identifiers found, in text order,
form a sequence that ordered rules then match: earlier rules are the more specific ones and
use up the identifiers that they match. All of this happens within a row, so nothing is moved.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names that sentences call licences by, and their short identifiers.
NAMES = {
    "MIT": ["mit license"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0"],
    "GPL-2.0": ["gnu general public license version 2", "gnu gpl version 2"],
    "GPL-3.0": ["gnu general public license version 3", "gnu gpl version 3"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "gnu lgpl version 2 1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "gnu lgpl version 3"],
    "AGPL-3.0": ["gnu affero general public license version 3", "gnu agpl version 3"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "ISC": ["isc license"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0"],
    "CC0-1.0": ["cc0 1 0 universal license", "creative commons zero v1 0 universal license"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
    "Unlicense": ["unlicense"],
    "Zlib": ["zlib license"],
    "WTFPL": ["wtfpl", "do what the fuck you want to public license"],
    "Artistic-2.0": ["artistic license 2 0"],
    "PostgreSQL": ["postgresql license"],
    "CDDL-1.0": ["common development and distribution license version 1 0"],
    "OFL-1.1": ["sil open font license version 1 1"],
}
#: The sentences that name a licence.
NAMING = ["licensed under {}", "licensed under the {}", "released under the {}", "distributed under the {}", "available under the {}", "this project is licensed under the {}", "this software is licensed under the {}", "this work is licensed under {}", "this work is licensed under a {}", "this work is licensed under the {}", "this file is licensed under the {}", "the {}", "{}"]


def name_id(licence: str) -> str:
    return re.sub("[^A-Z0-9]+", "_", licence.upper()) + "_NAME"


def naming_sentences() -> dict[str, str]:
    """Every sentence that names a licence, and its identifier."""
    out = {}
    for licence, names in NAMES.items():
        for name in names:
            # a name alone is a sentence only where it cannot be an ordinary word
            out |= {f.format(name): name_id(licence) for f in NAMING if " " in name or "licensed" in f or "released" in f}
        short = re.sub("[^a-z0-9]+", " ", licence.lower())
        for ending in ("", " only") if "GPL" in licence else ("",):
            out["spdx license identifier " + short + ending] = name_id(licence)
    return out


# Normalised sentences of the texts of public licences and their identifiers.
SENTENCES = naming_sentences() | {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT_GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT_NOTICE",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MIT_AS_IS",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MIT_LIABILITY",
    "licensed under the apache license version 2 0 the license": "APACHE_2_HEAD",
    "you may not use this file except in compliance with the license": "APACHE_COMPLY",
    "you may obtain a copy of the license at": "APACHE_OBTAIN",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APACHE_AS_IS",
    "see the license for the specific language governing permissions and limitations under the license": "APACHE_SEE",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL_2_PLUS",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL_3_PLUS",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPL_HOPE",
    "see the gnu general public license for more details": "GPL_DETAILS",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD_GRANT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD_SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD_BINARY",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD_NAMES",
    "all rights reserved": "RESERVED",
    "spdx license identifier gpl 2 0 or later": "GPL_2_PLUS",
    "spdx license identifier gpl 3 0 or later": "GPL_3_PLUS",
    "spdx license identifier lgpl 2 1 or later": "LGPL_2_1_PLUS",
    "spdx license identifier lgpl 3 0 or later": "LGPL_3_PLUS",
    "spdx license identifier agpl 3 0 or later": "AGPL_3_PLUS",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "LGPL_2_1_PLUS",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL_3_PLUS",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL_3_PLUS",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL_3_PLUS",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPL_HOPE",
    "see the gnu lesser general public license for more details": "GPL_DETAILS",
    "see the gnu affero general public license for more details": "GPL_DETAILS",
    "you should have received a copy of the gnu general public license along with this program": "GPL_COPY",
    "you should have received a copy of the gnu affero general public license along with this program": "GPL_COPY",
    "you should have received a copy of the gnu lesser general public license along with this library": "GPL_COPY",
    "you should have received a copy of the gnu lesser general public license along with this program": "GPL_COPY",
    "this source code form is subject to the terms of the mozilla public license v": "MPL_2_SUBJECT",
    "this source code form is subject to the terms of the mozilla public license version 2 0": "MPL_2_SUBJECT",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MPL_2_OBTAIN",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MPL_2_OBTAIN",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_GRANT",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_GRANT",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISC_AS_IS",
    "this is free and unencumbered software released into the public domain": "UNLICENSE_FREE",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UNLICENSE_ANYONE",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BSL_GRANT",
    "distributed under the boost software license version 1 0": "BSL_1_0_NAME",
    "see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt": "BSL_SEE",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "EPL_2_MADE",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which accompanies this distribution": "EPL_2_MADE",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "CC0_WAIVED",
    "this software is provided as is without any express or implied warranty": "ZLIB_AS_IS",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZLIB_LIABILITY",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZLIB_GRANT",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "WTFPL_COPY",
    "redistributions of source code must retain the copyright notice this list of conditions and the following disclaimer": "BSD_SOURCE",
    "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD_NAMES",
}

# Ordered rules, each a licence and the identifiers in a row that show it; after them, one a name.
RULES = [
    ("MIT", ["MIT_NAME", "MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS", "MIT_LIABILITY"]),
    ("MIT", ["MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS", "MIT_LIABILITY"]),
    ("MIT", ["MIT_GRANT", "MIT_NOTICE"]),
    ("Apache-2.0", ["APACHE_2_HEAD", "APACHE_COMPLY", "APACHE_OBTAIN", "APACHE_AS_IS", "APACHE_SEE"]),
    ("Apache-2.0", ["APACHE_2_HEAD", "APACHE_COMPLY", "APACHE_OBTAIN"]),
    ("BSD-3-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAMES"]),
    ("BSD-2-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY"]),
    *[(licence, [start, "GPL_HOPE", "GPL_DETAILS", *end]) for end in (["GPL_COPY"], []) for licence, start in (
        ("GPL-3.0-or-later", "GPL_3_PLUS"),
        ("GPL-2.0-or-later", "GPL_2_PLUS"),
        ("LGPL-3.0-or-later", "LGPL_3_PLUS"),
        ("LGPL-2.1-or-later", "LGPL_2_1_PLUS"),
        ("AGPL-3.0-or-later", "AGPL_3_PLUS"),
    )],
    ("GPL-3.0-or-later", ["GPL_3_PLUS"]),
    ("GPL-2.0-or-later", ["GPL_2_PLUS"]),
    ("LGPL-3.0-or-later", ["LGPL_3_PLUS"]),
    ("LGPL-2.1-or-later", ["LGPL_2_1_PLUS"]),
    ("AGPL-3.0-or-later", ["AGPL_3_PLUS"]),
    ("MPL-2.0", ["MPL_2_SUBJECT", "MPL_2_OBTAIN"]),
    ("MPL-2.0", ["MPL_2_SUBJECT"]),
    ("ISC", ["ISC_NAME", "ISC_GRANT", "ISC_AS_IS"]),
    ("ISC", ["ISC_GRANT", "ISC_AS_IS"]),
    ("Unlicense", ["UNLICENSE_FREE", "UNLICENSE_ANYONE"]),
    ("BSL-1.0", ["BSL_1_0_NAME", "BSL_SEE"]),
    ("BSL-1.0", ["BSL_GRANT"]),
    ("EPL-2.0", ["EPL_2_MADE"]),
    ("CC0-1.0", ["CC0_WAIVED"]),
    ("Zlib", ["ZLIB_AS_IS", "ZLIB_LIABILITY", "ZLIB_GRANT"]),
    ("WTFPL", ["WTFPL_COPY"]),
    ("Apache-2.0", ["APACHE_2_HEAD"]),
    *[(licence, [name_id(licence)]) for licence in NAMES],
]

#: Cuts, in order; X ends a sentence, Y may stand within one (texts are in lower case, so neither is a letter of theirs).
#: A line without letters and digits, bare comment marks too, is blank.
CUTS = [
    (r"\n[^a-z0-9\n]*(?=\n)", "X"),
    (r"(?<![.!?:;])[:;]++(?:\s+|$)", "Y"),
    (r"(?<![.!?:;])[.!?:;]++(?:\s+|$)", "X"),
    (r"\n", "Y"),
    (r"[^a-z0-9XY]+", " "),
]


def _alternatives(sentences: list[str]) -> str:
    """A pattern of the sentences, the longest first, with those of one first word together."""
    first: dict[str, list[str]] = {}
    for s in sorted(sentences, key=len, reverse=True):
        first.setdefault(s.split()[0], []).append("".join(f"[ Y]+{w}" for w in s.split()[1:]))
    return "|".join(f"{word}(?:{'|'.join(rest)})" for word, rest in first.items())


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of a text's known sentences, in order."""
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    cut = F.lower(F.coalesce(text, F.lit("")))
    for pattern, mark in CUTS:
        cut = F.regexp_replace(cut, pattern, mark)
    cut = F.regexp_replace(F.concat(F.lit("Y"), cut, F.lit("Y")), " ?([XY]) ?", "$1")
    found = F.regexp_extract_all(cut, F.lit(f"(?<=[XY])(?:{_alternatives(list(sentences))})(?=[XY])"), F.lit(0))
    return F.transform(found, lambda s: F.element_at(known, F.regexp_replace(s, "[ Y]+", " ")))


def match_rules(ids: Column, rules: list[tuple[str, list[str]]] = RULES) -> tuple[Column, Column]:
    """(licences found, identifiers that no rule used), both arrays in text order.

    The sequence is a text of ``;ID`` items. A rule replaces each run of its identifiers by
    ``;=licence``, which later rules cannot match.
    """
    rest = F.concat(F.lit(";"), F.concat_ws(";", ids), F.lit(";"))
    for licence, run in rules:
        rest = F.replace(F.replace(rest, F.lit(";"), F.lit(";;")), F.lit(";" + ";;".join(run) + ";"), F.lit(f";={licence};"))
        rest = F.replace(rest, F.lit(";;"), F.lit(";"))
    items = F.filter(F.split(rest, ";"), lambda x: x != "")
    found = F.transform(F.filter(items, lambda x: x.startswith("=")), lambda x: F.substr(x, F.lit(2)))
    return found, F.filter(items, lambda x: ~x.startswith("="))


def scan_licences(docs: DataFrame, *, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """Rows of ``docs`` with at least one known sentence: doc_id, sentence_ids, licences, unmatched (arrays
    in text order, licences without repeats in order of first sight).

    A null or empty text has no sentences and gives no row, and so does an empty table; a null doc_id stays null;
    repeated rows give repeated rows; whole texts are read, of any length; of rules that could use one sentence the first
    in order does; other columns, whatever their names, are ignored.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sentence_ids(F.col("text"), sentences).alias("sentence_ids")).where("size(sentence_ids) > 0")
    licences, unmatched = match_rules(F.col("sentence_ids"), rules)
    return found.select("doc_id", "sentence_ids", F.array_distinct(licences).alias("licences"), unmatched.alias("unmatched"))
