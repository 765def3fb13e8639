"""License scan: known sentences, and rules that are ordered sequences of them.

A text is cut into sentences. Runs of their lines, longest first, are joined and
normalised, and the known ones give a sequence of identifiers. A rule is found where its identifiers follow each other
in that sequence; longer rules are tried first, and what they cover is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.llm.common import let

#: Normalised sentences of public licenses and notices, by identifier.
SENTENCES = {
    "mit-ref": "released under the mit license",
    "mit-ref-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "mpl-2-form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "boost-ref": "distributed under the boost software license version 1 0",
    "epl-2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "apache-2-ref": "licensed under the apache license version 2 0",
    "apache-2-header": "licensed under the apache license version 2 0 the license",
    "apache-2-comply": "you may not use this file except in compliance with the license",
    "apache-2-copy": "you may obtain a copy of the license at",
    "apache-2-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2-limits": "see the license for the specific language governing permissions and limitations under the license",
    "gpl-3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl-program": "this program is free software",
    "gpl-2-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-3-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-library": "this library is free software",
    "lgpl-2-1-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-3-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl-details": "see the gnu affero general public license for more details",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "gpl-details": "see the gnu general public license for more details",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-ref": "licensed under cc by 4 0",
    "cc-by-sa-ref": "licensed under cc by sa 4 0",
    "cc-by-nc-ref": "licensed under cc by nc 4 0",
    "cc0-ref": "released under cc0 1 0",
    "rights-reserved": "all rights reserved",
    "proprietary-ref": "this document is confidential and proprietary",
}
#: Fixed values: (license, identifiers in order); a rule is found before all that come after it here.
RULES = [
    ("Apache-2.0", ["apache-2-header", "apache-2-comply", "apache-2-copy", "apache-2-as-is", "apache-2-limits"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("GPL-3.0-or-later", ["gpl-program", "gpl-3-terms", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl-program", "gpl-2-terms", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("AGPL-3.0-or-later", ["gpl-program", "agpl-3-terms", "gpl-hope", "gpl-implied", "agpl-details"]),
    ("LGPL-3.0-or-later", ["lgpl-library", "lgpl-3-terms", "lgpl-hope", "gpl-implied", "lgpl-details"]),
    ("LGPL-2.1-or-later", ["lgpl-library", "lgpl-2-1-terms", "lgpl-hope", "gpl-implied", "lgpl-details"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("Unlicense", ["unlicense-domain", "unlicense-anyone"]),
    ("MPL-2.0", ["mpl-2-form", "mpl-2-copy"]),
    ("Apache-2.0", ["apache-2-header", "apache-2-comply"]),
    ("ISC", ["isc-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("Unlicense", ["unlicense-domain"]),
    ("MPL-2.0", ["mpl-2-form"]),
    ("MIT", ["mit-ref"]),
    ("MIT", ["mit-ref-licensed"]),
    ("Apache-2.0", ["apache-2-ref"]),
    ("Apache-2.0", ["apache-2-header"]),
    ("GPL-3.0-only", ["gpl-3-ref"]),
    ("GPL-3.0-or-later", ["gpl-3-terms"]),
    ("GPL-2.0-or-later", ["gpl-2-terms"]),
    ("AGPL-3.0-or-later", ["agpl-3-terms"]),
    ("LGPL-3.0-or-later", ["lgpl-3-terms"]),
    ("LGPL-2.1-or-later", ["lgpl-2-1-terms"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source"]),
    ("CC-BY-4.0", ["cc-by-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-work"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("BSL-1.0", ["boost-ref"]),
    ("EPL-2.0", ["epl-2-terms"]),
    ("CC-BY-4.0", ["cc-by-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"]),
    ("CC0-1.0", ["cc0-ref"]),
    ("LicenseRef-Proprietary", ["proprietary-ref"]),
    ("LicenseRef-Rights-Reserved", ["rights-reserved"]),
]
#: Ends of sentences: lines without letters and digits, and marks before white space or the end of the text.
BREAK = r"(?>\r\n|[\n\r])[^a-zA-Z0-9\n\r]*[\n\r]+|[.;:!?]+(?:[\x20\t]+|(?=[\n\r])|$)"
#: Every known sentence has one of these words, so a text without any needs no cutting.
TRIGGER = r"(?i)licen|permission|reserved|redistribut|warrant|software|confidential|mozilla|cc0"


def _identifiers(text: Column) -> Column:
    likely = F.filter(F.split(text, BREAK), lambda s: s.rlike("(?i)" + "|".join(sorted({_rare(v) for v in SENTENCES.values()}))))
    return F.flatten(F.transform(likely, _known_runs))


def _known_runs(sentence: Column) -> Column:
    """Identifiers of the known runs of whole lines of a sentence; of two that overlap, the first, and of its runs the longest."""
    normal = lambda s: F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", F.lit(" ")))
    known = F.create_map(*[F.lit(x) for pair in ((v, k) for k, v in SENTENCES.items()) for x in pair])
    all_known = F.array(*map(F.lit, SENTENCES.values()))
    most = max(len(v.split()) for v in SENTENCES.values())  # every line has a word, so no known run has more lines

    def longest(lines: Column, line: Column, i: Column) -> Column:
        lengths = F.sequence(F.least(F.lit(most), F.size(lines) - i), F.lit(1), F.lit(-1))
        runs = F.transform(lengths, lambda n: F.struct(i.alias("at"), n.alias("n"), F.try_element_at(known, F.array_join(F.slice(lines, i + 1, n), " ")).alias("id")))
        return F.when(F.exists(all_known, lambda v: F.startswith(v, line)), F.get(F.filter(runs, lambda r: r["id"].isNotNull()), F.lit(0)))

    def step(acc: Column, r: Column) -> Column:
        taken = F.struct((r["at"] + r["n"]).alias("next"), F.concat(acc["out"], F.array(r["id"])).alias("out"))
        return F.when(r["at"] >= acc["next"], taken).otherwise(acc)

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("out"))
    lines = F.filter(F.transform(F.split(sentence, r"[\n\r]+"), normal), lambda x: x != "")
    found = lambda ls: F.filter(F.transform(ls, lambda x, i: longest(ls, x, i)), lambda r: r.isNotNull())
    return let(lines, lambda ls: F.aggregate(found(ls), start, step, lambda acc: acc["out"]))


def _rare(sentence: str) -> str:
    """The longest word of a sentence, which any text of it holds."""
    return max(sentence.split(), key=len)


def license_scan(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with ``sentences``, the identifiers in order, and ``licenses``, sorted and distinct.

    A sentence may run over lines, which may begin with comment marks; blank lines,
    and such of marks alone, end it. Null and empty texts have neither. Rows are judged one by one; other
    columns play no role.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = F.when(F.rlike(text, F.lit(TRIGGER)), _identifiers(text)).otherwise(F.array().cast("array<string>"))
    found = docs.select("doc_id", ids.alias("sentences"))
    state = let(F.concat(F.lit("|"), F.array_join("sentences", "||"), F.lit("|")), lambda s: F.struct(s.alias("left"), F.array().cast("array<string>").alias("out")))
    for name, sequence in RULES:
        rule = "|" + "||".join(sequence) + "|"
        state = _take(state, rule, name)
    licenses = F.array_sort(F.array_distinct(state["out"]))
    empty = F.array().cast("array<string>")
    return found.select("doc_id", "sentences", F.when(F.size("sentences") > 0, licenses).otherwise(empty).alias("licenses"))


def _take(state: Column, rule: str, name: str) -> Column:
    """The state after one rule: what it covers becomes a gap, over which no later rule reaches."""
    return let(
        state,
        lambda s: F.struct(
            F.replace(s["left"], F.lit(rule), F.lit("|#|")).alias("left"),
            F.when(F.contains(s["left"], F.lit(rule)), F.concat(s["out"], F.array(F.lit(name)))).otherwise(s["out"]).alias("out"),
        ),
    )


def license_digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", F.size("sentences").cast("bigint").alias("n_sentences"),
        F.array_join("sentences", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"),
    )
