"""License scans: normalized sentences become identifiers of known license sentences, and rules match their sequences.

Everything is built-in string and array functions in one pass over the texts; nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before white space or the end, which end a sentence. A dot inside a version number ends none. A known sentence
#: may begin and end at a line end too, but it may as well be wrapped over several lines, with comment marks or blank ones.
END = r"[.!?]+(?:[ \t\n\f\r\x0B]+|\z)"

#: A sentence of so many words is known wherever it stands; a shorter one may say something else inside another sentence.
LONG_WORDS = 13
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_MIT_COPIES = "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
#: Known sentences, normalized (lower case; only a-z, 0-9 and inner dots; single spaces), with their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0": "APACHE2_GRANT",
    "licensed under the apache license version 2.0 the license": "APACHE2_GRANT",
    "you may not use this file except in compliance with the license": "APACHE2_COMPLY",
    "you may obtain a copy of the license at https www.apache.org licenses license 2.0": "APACHE2_COPY",
    "you may obtain a copy of the license at http www.apache.org licenses license 2.0": "APACHE2_COPY",
    "released under the mit license": "MIT_GRANT",
    "licensed under the mit license": "MIT_GRANT",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software": "MIT_PERMISSION",
    "the software is provided as is without warranty of any kind": "AS_IS",
    "this work is licensed under the gnu general public license version 3": "GPL3_GRANT",
    "this work is licensed under the gnu general public license version 2": "GPL2_GRANT",
    "this program is free software": "FREE_SOFTWARE",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPL_TERMS",
    "either version 3 of the license or at your option any later version": "GPL3_OR_LATER",
    "either version 2 of the license or at your option any later version": "GPL2_OR_LATER",
    "licensed under cc by 4.0": "CC_BY_GRANT",
    "licensed under cc by sa 4.0": "CC_BY_SA_GRANT",
    "licensed under cc by nc 4.0": "CC_BY_NC_GRANT",
    "licensed under cc by nd 4.0": "CC_BY_ND_GRANT",
    "this work is licensed under a creative commons attribution 4.0 international license": "CC_BY_GRANT",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD_GRANT",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": "BSD_NAMES",
    "all rights reserved": "RESERVED",
    # The sentences of standard notices as published.
    "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license": "APACHE2_NOTICE",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APACHE2_AS_IS",
    "see the license for the specific language governing permissions and limitations under the license": "APACHE2_SEE",
    _MIT: "MIT_PERMISSION",
    f"{_MIT} {_MIT_COPIES}": "MIT_PERMISSION",
    _MIT_COPIES: "MIT_COPIES",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "AS_IS",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MIT_LIABILITY",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_PERMISSION",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_PERMISSION",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "BSD0_PERMISSION",
    **{
        f"this {what} is free software you can redistribute it and or modify it under the terms of the gnu {kind}general public license as published by the free software foundation either version {version} of the license or at your option any later version": f"{name}{version.replace('.', '_')}_NOTICE"
        for what in ("program", "library", "software")
        for kind, name, versions in (("", "GPL", "23"), ("lesser ", "LGPL", ("2.1", "3")), ("library ", "LGPL", "2"), ("affero ", "AGPL", "3"))
        for version in versions
    },
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD_SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD_BINARY",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD_NAMES",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "MPL2_NOTICE",
    "this is free and unencumbered software released into the public domain": "UNLICENSE_GRANT",
    "distributed under the boost software license version 1.0": "BSL_GRANT",
    **{
        f"this work is licensed under a creative commons attribution {terms}4.0 international license": f"CC_BY_{name}_GRANT"
        for terms, name in (("sharealike ", "SA"), ("noncommercial ", "NC"), ("noderivatives ", "ND"), ("noderivs ", "ND"), ("noncommercial sharealike ", "NC_SA"), ("noncommercial noderivatives ", "NC_ND"), ("noncommercial noderivs ", "NC_ND"))
    },
}
#: Rules in the order in which they are tried: a license, and the identifiers that must follow each other, other known
#: sentences not between them. Sentences that a rule has used are gone for the later ones.
RULES = [
    ("GPL-3.0-or-later", ["GPL_TERMS", "GPL3_OR_LATER"]),
    ("GPL-2.0-or-later", ["GPL_TERMS", "GPL2_OR_LATER"]),
    ("AGPL-3.0-or-later", ["AGPL3_NOTICE"]),
    ("LGPL-3.0-or-later", ["LGPL3_NOTICE"]),
    ("LGPL-2.1-or-later", ["LGPL2_1_NOTICE"]),
    ("LGPL-2.0-or-later", ["LGPL2_NOTICE"]),
    ("GPL-3.0-or-later", ["GPL3_NOTICE"]),
    ("GPL-2.0-or-later", ["GPL2_NOTICE"]),
    # In these notices the sentence on rights belongs to the copyright line.
    ("BSD-3-Clause", ["RESERVED", "BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAMES"]),
    ("BSD-2-Clause", ["RESERVED", "BSD_GRANT", "BSD_SOURCE", "BSD_BINARY"]),
    ("BSD-3-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAMES"]),
    ("BSD-2-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY"]),
    ("BSD-3-Clause", ["BSD_GRANT", "BSD_NAMES"]),
    ("BSD-2-Clause", ["BSD_GRANT"]),
    ("Apache-2.0", ["APACHE2_NOTICE", "APACHE2_COPY", "APACHE2_AS_IS", "APACHE2_SEE"]),
    ("Apache-2.0", ["APACHE2_NOTICE", "APACHE2_COPY"]),
    ("Apache-2.0", ["APACHE2_NOTICE"]),
    ("Apache-2.0", ["APACHE2_GRANT", "APACHE2_COMPLY", "APACHE2_COPY"]),
    ("Apache-2.0", ["APACHE2_GRANT"]),
    ("MIT", ["MIT_PERMISSION", "MIT_COPIES", "AS_IS", "MIT_LIABILITY"]),
    ("MIT", ["MIT_PERMISSION", "AS_IS", "MIT_LIABILITY"]),
    ("MIT", ["MIT_PERMISSION", "MIT_COPIES", "AS_IS"]),
    ("MIT", ["MIT_PERMISSION", "AS_IS"]),
    ("MIT", ["MIT_GRANT"]),
    ("GPL-3.0-only", ["GPL3_GRANT"]),
    ("GPL-2.0-only", ["GPL2_GRANT"]),
    ("ISC", ["ISC_PERMISSION"]),
    ("0BSD", ["BSD0_PERMISSION"]),
    ("MPL-2.0", ["MPL2_NOTICE"]),
    ("Unlicense", ["UNLICENSE_GRANT"]),
    ("BSL-1.0", ["BSL_GRANT"]),
    ("CC-BY-NC-SA-4.0", ["CC_BY_NC_SA_GRANT"]),
    ("CC-BY-NC-ND-4.0", ["CC_BY_NC_ND_GRANT"]),
    ("CC-BY-NC-4.0", ["CC_BY_NC_GRANT"]),
    ("CC-BY-SA-4.0", ["CC_BY_SA_GRANT"]),
    ("CC-BY-ND-4.0", ["CC_BY_ND_GRANT"]),
    ("CC-BY-4.0", ["CC_BY_GRANT"]),
    ("Proprietary", ["RESERVED"]),
]
#: Licenses that allow use for training with or without conditions; a document whose licenses all are is open.
OPEN = ["Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "ISC", "0BSD", "Unlicense", "BSL-1.0"]


def _pattern(sentences: dict[str, str]) -> str:
    """Finds known sentences, wrapped or not: long ones between any words, the others as whole sentences or lines."""
    longest = sorted(sentences, key=len, reverse=True)

    def any_of(keys: list[str]) -> str:
        first = {k.partition(" ")[0]: [] for k in keys}
        for k in keys:
            first[k.partition(" ")[0]].append(re.escape("".join(k.partition(" ")[1:])).replace(r"\ ", r"[ \n]"))
        return "|".join(rf"{re.escape(w)}(?:{'|'.join(rest)})" for w, rest in first.items())

    long = [k for k in longest if len(k.split()) >= LONG_WORDS]
    short = [k for k in longest if len(k.split()) < LONG_WORDS]
    shapes = [rf"(?<![^{space}])(?:{any_of(keys)})(?![^{space}])" for keys, space in ((long, r" \n"), (short, r"\n")) if keys]
    return "|".join(shapes)


def sentence_ids(text: Column, sentences: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order; where one begins with another, the longer one counts."""
    known = F.create_map(*[F.lit(x) for kv in sentences.items() for x in kv])
    # A mark leaves a dot on a line of its own, which no known sentence passes; between words is one space or line end.
    marked = F.regexp_replace(F.lower(text), END, "\n.\n")
    plain = F.regexp_replace(F.regexp_replace(marked, r"[^a-z0-9.\n\r]+", " "), r" ?[\n\r][ \n\r]*", "\n")
    found = F.regexp_extract_all(F.trim(plain), F.lit(_pattern(sentences)), F.lit(0))
    return F.transform(found, lambda s: F.try_element_at(known, F.translate(s, "\n", " ")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """One row per row of docs: doc_id, n_known (known sentences), sentence_ids (joined by spaces), licenses (joined by
    spaces, each once, in the rules' order; empty without one), n_unmatched (known sentences that no rule used), is_open.

    Null and empty texts have no sentences, no license and are not open. Repeated rows give repeated results; only the
    two named columns are read.
    """
    ids = F.coalesce(F.concat_ws(" ", sentence_ids(F.col(text_col), sentences)), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), ids.alias("sentence_ids"))
    # Each identifier ends with a semicolon; a used one leaves a gap, so that its neighbours don't become neighbours.
    left = F.when(F.col("sentence_ids") != "", F.concat(F.lit(";"), F.replace(F.col("sentence_ids"), F.lit(" "), F.lit(";;")), F.lit(";"))).otherwise(F.lit(""))
    out = out.withColumns({"left0": left, "found0": F.lit("")})
    for k, (name, sequence) in enumerate(rules):
        needle, last, found = F.lit("".join(f";{x};" for x in sequence)), F.col(f"left{k}"), F.col(f"found{k}")
        hit = (last != "") & F.contains(last, needle)
        new = F.when(hit & ~F.contains(F.concat(found, F.lit(" ")), F.lit(f" {name} ")), F.concat(found, F.lit(f" {name}"))).otherwise(found)
        out = out.withColumns({f"left{k + 1}": F.when(hit, F.replace(last, needle, F.lit("_"))).otherwise(last), f"found{k + 1}": new}).drop(f"left{k}", f"found{k}")
    licenses, rest = F.ltrim(f"found{len(rules)}"), F.col(f"left{len(rules)}")
    count = lambda x, sep: F.when(x == "", 0).otherwise(F.size(F.split(x, sep))).cast("bigint")
    open_ = (licenses != "") & (F.size(F.array_except(F.split(licenses, " "), F.array(*map(F.lit, OPEN)))) == 0)
    return out.select("doc_id", count(F.col("sentence_ids"), " ").alias("n_known"), "sentence_ids", licenses.alias("licenses"), (F.length(F.regexp_replace(rest, "[^;]", "")) / 2).cast("bigint").alias("n_unmatched"), open_.alias("is_open"))
