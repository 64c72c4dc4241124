"""Licence scans by sentence rules (operator 1): sentences to identifiers, identifier sequences to licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import let

#: Licence names as they stand in a normalised sentence, and their identifiers; longer names first.
GNU = [(f"{short}{v.replace(' 0', '').replace(' ', '.')}", name, abbreviation, v) for short, name, abbreviation, versions in (
    ("AGPL", "gnu affero general public license", "agpl", ("3 0",)), ("LGPL", "gnu (?:lesser|library) general public license", "lgpl", ("2 1", "2 0", "3 0")), ("GPL", "gnu general public license", "gpl", ("2 0", "3 0")),
) for v in versions]


def gnu_names() -> list[tuple[str, str]]:
    found = []
    for identifier, name, abbreviation, v in GNU:
        number = v.replace(" 0", "(?: 0)?")
        full = rf"(?:{name}(?: {abbreviation})?|(?:gnu )?{abbreviation})(?: version| v)? ?v?{number}"
        notice = rf"{name} as published by the free software foundation (?:either )?version {number}(?: of the license)?"
        found += [(f"{identifier}+", rf"(?:{notice}(?: or| or at your option) any later version|{full}(?: or later| or any later version| or at your option any later version))"), (identifier, rf"(?:{notice}|{full}(?: only)?)")]
    return found


CC_KINDS = (("BY-NC-SA", "(?:by nc sa|attribution non ?commercial share ?alike)"), ("BY-NC-ND", "(?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s(?: works)?)"), ("BY-NC", "(?:by nc|attribution non ?commercial)"),
            ("BY-SA", "(?:by sa|attribution share ?alike)"), ("BY-ND", "(?:by nd|attribution no ?deriv(?:ative)?s(?: works)?)"), ("BY", "(?:by|attribution)"))
CC = [(f"CC-{kind}{v}", rf"(?:cc|creative commons) {words}(?: (?:international|unported|public|license))* {'4 0' if v == '4' else v.replace('.', ' ')}(?: (?:international|unported|generic|public))*") for kind, words in CC_KINDS for v in ("4", "3.0", "2.5", "2.0")]
NAMES = [
    *gnu_names(), *CC, ("CC0", r"(?:cc0|creative commons (?:zero|cc0))(?: (?:v ?)?1 0)?(?: universal)?"), ("APACHE2", r"apache(?: software)?(?: license)?(?: version| v)? ?v?2(?: 0)?"), ("MPL2", r"(?:mozilla public license|mpl)(?: version| v)? ?v?2 0"),
    ("BSD-3", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"), ("BSD-2", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"), ("BSL1", r"(?:boost software license|bsl)(?: version)? 1 0"),
    ("ISC-RELEASE", "isc"), ("ZLIB-RELEASE", "zlib"), ("UNLICENSE", "unlicense"), ("MIT-RELEASE", "(?:mit|expat)"),
]
#: Whole licence sentences, normalised, as regular expressions, and their identifiers.
HOLDER = "(?:[a-z0-9]+ ){1,12}?"
DISCLAIMED = "any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
DAMAGES = "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
SENTENCES = [
    ("MIT-GRANT", "permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions)?"),
    ("MIT-NOTICE", "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("AS-IS", "the software is provided as is without warranty of any kind(?: express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non ?infringement)?"),
    ("MIT-LIABILITY", "in no event shall the (?:authors or copyright holders|copyright holders or authors|authors) be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("BSD-GRANT", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSD-SOURCE", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSD-BINARY", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BSD-ADS", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("BSD-NAME", f"neither the names? of {HOLDER}nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-NAME", f"the names? of {HOLDER}may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-AS-IS", f"this software is provided by {HOLDER}as is and {DISCLAIMED}"),
    ("BSD-LIABILITY", f"in no event shall {HOLDER}{DAMAGES}"),
    ("ISC-GRANT", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted(?: provided that the above copyright notice and this permission notice appear in all copies)?"),
    ("ISC-AS-IS", f"the software is provided as is and {HOLDER}disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("ZLIB-GRANT", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("BSL1-GRANT", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("MPL2-NOTICE", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("APACHE2-NOTICE", "licensed under the apache license version 2 0 the license you may not use this (?:file|software|work|project) except in compliance with the license"),
    ("UNLICENSE-GRANT", "this is free and unencumbered software released into the public domain"),
    ("WTFPL-GRANT", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("CC0-WAIVER", f"to the extent possible under law {HOLDER}(?:has|have) waived all copyright and related or neighbou?ring rights to [a-z0-9]+(?: [a-z0-9]+){{0,11}}"),
    ("APACHE2-TEXT", "apache license version 2 0 january 2004(?: http www apache org licenses)?"),
    ("GPL2-TEXT", "gnu general public license version 2 june 1991"),
    ("GPL3-TEXT", "gnu general public license version 3 29 june 2007"),
    ("LGPL2.1-TEXT", "gnu lesser general public license version 2 1 february 1999"),
    ("LGPL3-TEXT", "gnu lesser general public license version 3 29 june 2007"),
    ("AGPL3-TEXT", "gnu affero general public license version 3 19 november 2007"),
    ("MPL2-TEXT", "mozilla public license version 2 0"),
    ("ARR", "all rights reserved|copyright (?:c )?(?:[a-z0-9]+ ){1,12}?all rights reserved"),
]
BSD = ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY"]
BY_NAME = {"MIT-RELEASE": "MIT", "APACHE2": "Apache-2.0", "MPL2": "MPL-2.0", "BSD-3": "BSD-3-Clause", "BSD-2": "BSD-2-Clause", "BSL1": "BSL-1.0", "ISC-RELEASE": "ISC", "ZLIB-RELEASE": "Zlib", "UNLICENSE": "Unlicense", "CC0": "CC0-1.0"}
BY_NAME |= {f"CC-{kind}{v}": f"CC-{kind}-{'4.0' if v == '4' else v}" for kind, _ in CC_KINDS for v in ("4", "3.0", "2.5", "2.0")}
BY_NAME |= {f"{short}{later}": f"{short.rstrip('0123456789.')}-{v.replace(' ', '.')}{'-or-later' if later else ''}" for short, _, _, v in GNU for later in ("+", "")}
#: Ordered rules; the identifiers must follow one another among the text's known sentences.
RULES = [
    ("MIT", ["MIT-GRANT", "MIT-NOTICE", "AS-IS"]), ("MIT", ["MIT-GRANT", "AS-IS"]), ("MIT", ["MIT-RELEASE"]),
    ("GPL-3.0", ["GPL3"]), ("Apache-2.0", ["APACHE2"]), ("CC-BY-NC-4.0", ["CC-BY-NC4"]), ("CC-BY-SA-4.0", ["CC-BY-SA4"]), ("CC-BY-4.0", ["CC-BY4"]),
    ("BSD-4-Clause", [*BSD[:2], "BSD-BINARY", "BSD-ADS"]), ("BSD-3-Clause", [*BSD, "BSD-NAME", "BSD-AS-IS"]), ("BSD-2-Clause", [*BSD, "BSD-AS-IS"]), ("ISC", ["ISC-GRANT", "ISC-AS-IS"]),
    ("Zlib", ["ZLIB-GRANT"]), ("BSL-1.0", ["BSL1-GRANT"]), ("MPL-2.0", ["MPL2-NOTICE"]), ("MPL-2.0", ["MPL2-TEXT"]), ("Apache-2.0", ["APACHE2-NOTICE"]), ("Apache-2.0", ["APACHE2-TEXT"]), ("Unlicense", ["UNLICENSE-GRANT"]), ("WTFPL", ["WTFPL-GRANT"]), ("CC0-1.0", ["CC0-WAIVER"]),
    ("GPL-2.0", ["GPL2-TEXT"]), ("GPL-3.0", ["GPL3-TEXT"]), ("LGPL-2.1", ["LGPL2.1-TEXT"]), ("LGPL-3.0", ["LGPL3-TEXT"]), ("AGPL-3.0", ["AGPL3-TEXT"]),
    *((name, [i]) for i, name in BY_NAME.items() if i not in ("MIT-RELEASE", "GPL3", "APACHE2", "CC-BY-NC4", "CC-BY-SA4", "CC-BY4")),
    ("Proprietary", ["ARR"]),
]
NAME = "|".join(pattern for _, pattern in NAMES)
ONE = f"(?:the |an? )?(?:{NAME})(?: licen[sc]e)?"
#: A sentence that says by name what holds: no word before it turns it round.
SUBJECT = "(?:(?!(?:not|never|no|nor|neither|without|if|unless|whether|than|formerly|previously|isn|aren|wasn|cannot) )[a-z0-9]+ ){0,12}?"
UNDER = r"(?:licensed|released|distributed|available|provided|published|redistribute it and or modify it|dual licensed) under (?:(?:either|both) (?:of )?)?(?:the )?(?:terms (?:and conditions )?of )?(?:either )?"
TAIL = r"(?: (?:see|as found in|which can be found in|at your option|https?|file|for details|for more|found in|in the)(?: [a-z0-9]+){0,16})?"
DECLARED = f"{SUBJECT}{UNDER}{ONE}(?: (?:or|and) (?:the )?(?:terms of )?{ONE}){{0,3}}{TAIL}|spdx license identifier (?:{NAME})(?: (?:or|and) (?:{NAME})){{0,3}}|licen[sc]e (?:{NAME})(?: licen[sc]e)?"
WHOLE = "|".join(f"(?:{p})" for _, p in SENTENCES)


def spaced(pattern: str) -> str:
    """A pattern in which a space stands for a line's end too."""
    return pattern.replace(" ", r"[ \n]")


def plain(text: Column) -> Column:
    """Lower-case words; a full stop for each sentence end and empty line, a line feed for other lines' ends and colons."""
    t = F.regexp_replace(F.lower(text), r"\.(?=[a-z0-9])|(?<=\bv)\.", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[!?]", "."), r":(?=\s)", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9.\n]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(t, r"(?:\n\n| ?\.)[ .\n]*", "."))


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order.

    A sentence starts and ends at a sentence's or a line's end and may run over lines; an empty line ends it.
    """
    said = F.regexp_extract_all(plain(text), F.lit(rf"(?<![a-z0-9 ])(?:{spaced(WHOLE)}|{spaced(DECLARED)})(?![a-z0-9 ])"), F.lit(0))

    def of(m: Column) -> Column:
        name = lambda n: F.coalesce(*(F.when(n.rlike(f"^(?:{p})$"), F.lit(i)) for i, p in NAMES))
        names = F.transform(F.regexp_extract_all(m, F.lit(rf"\b(?:{NAME})\b"), F.lit(0)), name)
        return F.coalesce(*(F.when(m.rlike(f"^(?:{p})$"), F.array(F.lit(i))) for i, p in SENTENCES), names)

    return F.flatten(F.transform(said, lambda m: let(F.trim(F.regexp_replace(m, r"\s+", " ")), of)))


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, ids, the licence of the first fitting rule (null without one) and all fitting licences in the rules' order.

    A narrow pass of DataFrame functions over whole texts. Null and empty texts have no identifiers; a null doc_id is
    carried through; rows with one doc_id are each judged; other columns are ignored.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit(","), F.array_join(identifiers(F.coalesce("text", F.lit(""))), ","), F.lit(",")).alias("said"))
    fits = F.array_distinct(F.array_compact(F.array(*(F.when(F.col("said").contains("," + ",".join(sequence) + ","), F.lit(name)) for name, sequence in RULES))))
    every = F.when(F.col("said") == ",,", F.array().cast("array<string>")).otherwise(fits)
    judged = found.withColumn("every", every)
    return judged.select("doc_id", F.trim(F.col("said"), F.lit(",")).alias("ids"), F.get("every", F.lit(0)).alias("licence"), F.array_join("every", ",").alias("licences"))
