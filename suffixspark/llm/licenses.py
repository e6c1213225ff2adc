"""License scans by sentences: known sentences become identifiers, and rules name the licenses of sequences of identifiers.

A text is normalised: A-Z lower-cased, every run of other characters than letters a-z and digits made one mark. The mark is a hard break
if the run has . ! ? or ; before white space; else a soft break if it has a line end, a colon before white space, or closes a list mark such as
"b)" at a line's start; else a space. So the marks of comments and lists drop out. A known sentence is found wherever it stands between two breaks
(or the text's ends), soft ones inside it read as spaces: wrapped lines and paragraphs without a full stop are read in one pass, in the order of
the text. At a place the longest known sentence is taken, and what it covers is not read again. The rules
are tried in order at each place of the sequence of identifiers, from left to right, and what one has matched is not matched again.
A null or empty text has no sentence. Nothing is shuffled: a row is scanned by itself."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public license notices -> identifier. A sentence here is normalised as those of the texts are.
SENTENCES = {
    "MitRef": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "This software is released under the MIT License.", "License: MIT", "SPDX-License-Identifier: MIT", "MIT License", "The MIT License (MIT)"],
    "MitGrant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "MitNotice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "AsIsMit": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "LiableMit": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "ApacheRef2": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "Released under the Apache License, Version 2.0.", "This project is licensed under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License, Version 2.0"],
    "ApacheComply": ["you may not use this file except in compliance with the License."],
    "ApacheObtain": ["You may obtain a copy of the License at"],
    "ApacheAsIs": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "ApacheSee": ["See the License for the specific language governing permissions and limitations under the License."],
    "BsdRef": ["Licensed under the BSD License.", "Released under the BSD License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "Bsd2Ref": ["SPDX-License-Identifier: BSD-2-Clause", "BSD 2-Clause License"],
    "Bsd3Ref": ["SPDX-License-Identifier: BSD-3-Clause", "BSD 3-Clause License", "Licensed under the 3-Clause BSD License."],
    "BsdGrant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BsdSource": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "BsdBinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BsdEndorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BsdAsIs": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "IscGrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "IscRef": ["ISC License", "SPDX-License-Identifier: ISC", "Licensed under the ISC License."],
    "Gpl2Ref": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the GNU General Public License, version 2."],
    "Gpl3Ref": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "GplFree": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GplModify": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"],
    "Later2": ["either version 2 of the License, or (at your option) any later version."],
    "GplHope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "GplSee": ["See the GNU General Public License for more details."],
    "Lgpl21Ref": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "Lgpl3Ref": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "AgplRef3": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "MplRef2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "EplRef2": ["Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "UnlicenseRef": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "Cc0Ref": ["SPDX-License-Identifier: CC0-1.0", "Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "CcBy4": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CcBySa4": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CcByNc4": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CcByNd4": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "AllRights": ["All rights reserved."],
}

#: In order: the identifiers of a rule, and the license they stand for. A longer notice comes before the shorter ones it holds.
RULES = [
    ("MitGrant MitNotice AsIsMit LiableMit", "MIT"), ("MitGrant MitNotice AsIsMit", "MIT"), ("MitGrant MitNotice", "MIT"),
    ("ApacheRef2 ApacheComply ApacheObtain ApacheAsIs ApacheSee", "Apache-2.0"), ("ApacheRef2 ApacheComply ApacheObtain", "Apache-2.0"), ("ApacheRef2 ApacheComply", "Apache-2.0"), ("ApacheRef2", "Apache-2.0"),
    ("BsdGrant BsdSource BsdBinary BsdEndorse BsdAsIs", "BSD-3-Clause"), ("BsdGrant BsdSource BsdBinary BsdEndorse", "BSD-3-Clause"), ("BsdGrant BsdSource BsdBinary BsdAsIs", "BSD-2-Clause"), ("BsdGrant BsdSource BsdBinary", "BSD-2-Clause"),
    ("Bsd2Ref", "BSD-2-Clause"), ("Bsd3Ref", "BSD-3-Clause"), ("BsdRef", "BSD"), ("IscGrant", "ISC"), ("IscRef", "ISC"),
    ("GplFree GplHope GplSee", "GPL-3.0-or-later"), ("GplFree", "GPL-3.0-or-later"), ("GplModify Later2 GplHope GplSee", "GPL-2.0-or-later"), ("GplModify Later2", "GPL-2.0-or-later"),
    ("Gpl2Ref", "GPL-2.0-only"), ("Gpl3Ref", "GPL-3.0-only"), ("Lgpl21Ref", "LGPL-2.1-only"), ("Lgpl3Ref", "LGPL-3.0-only"), ("AgplRef3", "AGPL-3.0-only"),
    ("MplRef2", "MPL-2.0"), ("EplRef2", "EPL-2.0"), ("UnlicenseRef", "Unlicense"), ("Cc0Ref", "CC0-1.0"), ("CcByNc4", "CC-BY-NC-4.0"), ("CcBySa4", "CC-BY-SA-4.0"), ("CcByNd4", "CC-BY-ND-4.0"), ("CcBy4", "CC-BY-4.0"), ("MitRef", "MIT"),
]

BREAK = r"([.!?;])[ \t]+"
OTHER = r"[^a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalise(sentence: str) -> str:
    return re.sub(OTHER, " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier. A known text of several sentences is known by the parts that a text would be cut into, the first of them named."""
    out = {}
    for name, forms in SENTENCES.items():
        for form in forms:
            first, *_ = [p for p in re.sub(BREAK, r"\1\n", form).split("\n")]
            out.setdefault(normalise(form), name)
            if form.endswith(":"):  # a list's first mark may stand on the same line
                out.setdefault(f"{normalise(form)} 1", name)
            out.setdefault(normalise(first), name) if len(first.split()) > 6 else None
    return out


def triggers() -> list[str]:
    """Words of which every known sentence has one: a text with none of them has no known sentence."""
    words = ["licen", "copyright", "redistribut", "version", "permission", "software", "rights", "warrant", "may "]
    assert all(any(w in s for w in words) for s in known_sentences())
    return words


#: A list mark such as "(1)" or "b)" at a line's start, which ends in no break of its own.
LIST_MARK = r"(?m)^([^a-z0-9\n\r\x85\u2028\u2029]*(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})\))[ \t]"


def _marked(low: Column) -> Column:
    """Words with a space, \\r (soft break) or \\n (hard break) between them. Each pattern takes time in proportion to the text."""
    out = F.regexp_replace(F.translate(low, "\x01\x02", "  "), LIST_MARK, "$1\x01")
    out = F.regexp_replace(F.regexp_replace(out, "[.!?;][ \\t\\r\\n]", "\x02"), ":[ \\t]", "\x01")
    out = F.regexp_replace(out, "[^a-z0-9\\x01\\x02\\r\\n]+", " ")
    out = F.regexp_replace(out, " ?[\\x01\\r\\n][ \\x01\\r\\n]*", "\r")
    return F.trim(F.regexp_replace(out, "[ \r]?\\x02[ \r\\x02]*", "\n"))


def sentence_pattern() -> str:
    """The known sentences between breaks as alternatives, the longer first."""
    longest = sorted(known_sentences(), key=lambda s: (-len(s), s))
    return r"(?<![^\r\n])(?:" + "|".join(s.replace(" ", r"[ \r]") for s in longest) + r")(?![^\r\n])"


def _identifiers(low: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in known_sentences().items() for x in pair])
    found = F.regexp_extract_all(_marked(low), F.lit(sentence_pattern()), F.lit(0))
    return F.transform(found, lambda s: known[F.translate(s, "\r", " ")])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (a struct with the columns of docs), sentences (identifiers in order), licenses (of the matched rules, in order)."""
    low = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    has = F.lit(False)
    for w in triggers():
        has = has | F.contains("low", F.lit(w))
    rows = docs.select(F.struct("*").alias("row"), low.alias("low")).select("row", F.when(has, F.col("low")).alias("low"))
    best = F.coalesce(F.when(F.col("low").isNotNull(), _identifiers(F.col("low"))), F.array().cast("array<string>"))
    names = F.create_map(*[F.lit(x) for pair in RULES for x in pair])
    matched = F.regexp_extract_all(F.array_join("sentences", " "), F.lit(rule_pattern()), F.lit(0))
    return rows.select("row", best.alias("sentences")).withColumn("licenses", F.transform(matched, lambda m: names[m]))


def rule_pattern() -> str:
    """The rules as alternatives, so that the first that fits at a place is taken."""
    return r"\b(?:" + "|".join(seq for seq, _ in RULES) + r")\b"
