"""License signature rules over normalised words (lower case, one space between words).

``TEXTS`` are sentences of the licences themselves: grants, conditions, notices and headers. The other rules are built from families: every family has names written by hand, versions, and the words by which it is
cited. The forms below turn each family into ordered signatures, from an explicit identifier tag (priority 4) over
grants and titles to bare mentions (priority 1). Licence names and identifiers are public fixed values.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    keyword: str  # a rule is only tried where its keyword occurs
    pattern: str  # of whole words
    priority: int


# The places that every scan reports whatever the rules say: words in a row and the label.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Labels that name a family and not a licence.
FAMILY_NAMES = ("apache", "artistic", "bsd", "epl", "gpl", "lgpl", "mpl")

# label, names, words of the identifier
FAMILIES = [
    ("mit", "mit|expat|mit x11|x11", "mit|expat|x11"),
    ("mit-0", "mit no attribution|mit 0", "mit 0"),
    ("isc", "isc|internet systems consortium", "isc"),
    ("bsd-2", "bsd 2 clause|2 clause bsd|simplified bsd|freebsd|two clause bsd", "bsd 2 clause"),
    ("bsd-3", "bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd|three clause bsd", "bsd 3 clause"),
    ("bsd-4", "bsd 4 clause|4 clause bsd|original bsd|old bsd", "bsd 4 clause"),
    ("bsd-0", "zero clause bsd|bsd zero clause|0bsd", "0bsd"),
    ("bsd", "bsd|berkeley software distribution", "bsd"),
    ("zlib", "zlib|zlib libpng", "zlib"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl|do what the fuck you want to public", "wtfpl"),
    ("boost-1", "boost software|boost", "bsl 1 0"),
    ("artistic-1", "artistic 1(?: 0)?", "artistic 1 0"),
    ("artistic-2", "artistic 2(?: 0)?|artistic version 2", "artistic 2 0"),
    ("artistic", "artistic|perl artistic", "artistic"),
    ("python", "python software foundation|psf|python", "psf 2 0|python 2 0"),
    ("ruby", "ruby", "ruby"),
    ("php-3", "php", "php 3 0(?:1)?"),
    ("openssl", "openssl|ssleay", "openssl"),
    ("curl", "curl", "curl"),
    ("ncsa", "university of illinois(?: ncsa)?(?: open source)?|ncsa", "ncsa"),
    ("postgresql", "postgresql", "postgresql"),
    ("w3c", "w3c software(?: notice)?(?: and)?|w3c", "w3c"),
    ("ofl-1", "sil open font|open font", "ofl 1 [01]"),
    ("vim", "vim", "vim"),
    ("json", "json", "json"),
    ("sleepycat", "sleepycat", "sleepycat"),
    ("qpl-1", "q public|qt public", "qpl 1 0"),
    ("zope-2", "zope public", "zpl 2 [01]"),
    ("apache-1", "apache software version 1(?: [01])?|apache 1(?: [01])?", "apache 1 [01]"),
    ("apache-2", "apache license(?: version| v)? 2(?: 0)?|apache 2(?: 0)?|apache software version 2(?: 0)?|apache v2|asl 2(?: 0)?", "apache 2 0"),
    ("apache", "apache(?: software(?: foundation)?)?", "apache"),
    ("mpl-1", "mozilla public license version 1(?: [01])?|mpl 1(?: [01])?|mpl v1", "mpl 1 [01]"),
    ("mpl-2", "mozilla public license version 2(?: 0)?|mozilla public license v 2(?: 0)?|mpl 2(?: 0)?|mpl v2", "mpl 2 0"),
    ("mpl", "mozilla public|mpl", "mpl"),
    ("epl-1", "eclipse public license version 1(?: 0)?|epl 1(?: 0)?|epl v1(?:0)?", "epl 1 0"),
    ("epl-2", "eclipse public license version 2(?: 0)?|eclipse public license v 2(?: 0)?|epl 2(?: 0)?", "epl 2 0"),
    ("epl", "eclipse public", "epl"),
    ("cddl-1", "common development and distribution|cddl", "cddl 1 [01]"),
    ("cpl-1", "common public", "cpl 1 0"),
    ("ipl-1", "ibm public", "ipl 1 0"),
    ("eupl-1", "european union public|eupl", "eupl 1 [012]"),
    ("cecill-2", "cecill", "cecill 2 [01]"),
    ("ms-pl", "microsoft public|ms pl", "ms pl"),
    ("ms-rl", "microsoft reciprocal|ms rl", "ms rl"),
    ("afl-3", "academic free", "afl 3 0"),
    ("osl-3", "open software", "osl 3 0"),
    ("gpl-1", "gnu general public license version 1|gpl version 1|gpl v1|gplv1|gpl 1", "gpl 1 0"),
    ("gpl-2", "gnu general public license(?: as published by the free software foundation)?(?: either)? version 2|gnu gpl (?:version |v)?2|gpl version 2|gpl v2|gplv2|gpl 2", "gpl 2 0"),
    ("gpl-3", "gnu general public license(?: as published by the free software foundation)?(?: either)? version 3|gnu gpl (?:version |v)?3|gpl version 3|gpl v3|gplv3|gpl 3", "gpl 3 0"),
    ("gpl", "gnu general public|gnu gpl|gpl", "gpl"),
    ("lgpl-2", "gnu l(?:esser|ibrary) general public license version 2(?: 1)?|lgpl version 2(?: 1)?|lgpl v2(?: 1)?|lgplv2(?: 1)?|lgpl 2(?: 1)?", "lgpl 2 [01]"),
    ("lgpl-3", "gnu lesser general public license version 3|lgpl version 3|lgpl v3|lgplv3|lgpl 3", "lgpl 3 0"),
    ("lgpl", "gnu l(?:esser|ibrary) general public|lgpl", "lgpl"),
    ("agpl-3", "gnu affero general public(?: license version 3)?|agpl version 3|agpl v3|agplv3|agpl 3|agpl", "agpl 3 0"),
    ("gfdl-1", "gnu free documentation|gfdl", "gfdl 1 [123]"),
    ("sspl-1", "server side public|sspl", "sspl 1 0"),
    ("bsl-1", "business source|busl", "busl 1 1"),
    ("elastic-2", "elastic", "elastic 2 0"),
    ("cc0-1", "cc0|creative commons zero|cc zero|cc0 1 0 universal", "cc0 1 0"),
    ("cc-by-nc-nd", "cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?", "cc by nc nd(?: \\d)?(?: \\d)?"),
    ("cc-by-nc-sa", "cc by nc sa|creative commons attribution non ?commercial share ?alike", "cc by nc sa(?: \\d)?(?: \\d)?"),
    ("cc-by-nc", "cc by nc|creative commons attribution non ?commercial", "cc by nc(?: \\d)?(?: \\d)?"),
    ("cc-by-nd", "cc by nd|creative commons attribution no ?deriv(?:ative)?s?", "cc by nd(?: \\d)?(?: \\d)?"),
    ("cc-by-sa", "cc by sa|creative commons attribution share ?alike", "cc by sa(?: \\d)?(?: \\d)?"),
    ("cc-by", "cc by|creative commons attribution", "cc by(?: \\d)?(?: \\d)?"),
    ("odbl-1", "open database|odbl", "odbl 1 0"),
    ("odc-by-1", "open data commons attribution|odc by", "odc by 1 0"),
    ("pddl-1", "public domain dedication and|pddl", "pddl 1 0"),
    ("ogl-3", "open government", "ogl uk 3 0"),
    ("etalab-2", "etalab|licence ouverte", "etalab 2 0"),
    ("llama", "llama(?: \\d)?(?: \\d)? community|meta llama(?: \\d)? community", "llama\\S*"),
    ("openrail-m", "open ?rail m?|bigscience (?:bloom )?rail(?: 1 0)?|creativeml open ?rail m", "openrail\\S*"),
]

# Sentences of the public texts of licences, as words. Bullets and numbers may stand before a condition.
_ITEM = r"(?: \w{1,3})?"
_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
    "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
    "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
)
_BSD_TWO = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    + _ITEM + " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    + _ITEM + " redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
    "the documentation and or other materials provided with the distribution"
)
_GNU = "{} general public license as published by the free software foundation either version {} of the license"
_FREE = "free software (?:foundation )?you can redistribute it and or modify it under the terms of(?: version {})? (?:of )?the gnu {}general public license"
TEXTS = [
    ("mit", _MIT_GRANT + " subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit-0", _MIT_GRANT + " the software is provided as is"),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("json", "the software shall be used for good not evil"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("bsd-0", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("bsd-2", _BSD_TWO + " this software is provided by"),
    ("bsd-3", _BSD_TWO + _ITEM + " (?:neither|the) names? of"),
    ("bsd-3", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4", _BSD_TWO + _ITEM + " all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-1", "are permitted provided that the following conditions are met" + _ITEM + " redistributions of source code must retain the above copyright notice "
              "this list of conditions and the following disclaimer this software is provided"),
    ("bsd-protection", "redistribution and use in source and binary forms with or without modification are permitted only as provided herein"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", "to deal with the software without restriction including without limitation the rights to use"),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and "
             "this permission notice appear in all copies the software is provided as is without warranty of any kind express or implied including but not limited to the "
             "warranties of merchantability fitness for a particular purpose and noninfringement of third party rights"),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng-2", "permission is hereby granted to use copy modify and distribute this software or portions hereof for any purpose without fee subject to the following restrictions"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("blessing", "may you do good and not evil may you find forgiveness for yourself and forgive others"),
    ("cc0-1", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights"),
    ("cc0-1", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright"),
    ("pddl-1", "the rightsholder dedicates the work to the public domain for the benefit of the public"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-1", "this product includes software developed by the apache (?:group|software foundation)"),
    ("gpl-1", _FREE.format("1", "") + " as published by the free software foundation either version 1"),
    ("gpl-2", _FREE.format("2", "") + " as published by the free software foundation(?: either)? version 2"),
    ("gpl-2", _GNU.format("gnu", "2")),
    ("gpl-2", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended"),
    ("gpl-3", _FREE.format("3", "") + " as published by the free software foundation(?: either)? version 3"),
    ("gpl-3", _GNU.format("gnu", "3")),
    ("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl-2", _GNU.format("gnu (?:lesser|library)", "2(?: 1)?")),
    ("lgpl-2", _FREE.format("2 1", "(?:lesser|library) ") + " as published by the free software foundation(?: either)? version 2(?: 1)?"),
    ("lgpl-2", "this license the lesser general public license applies to some specially designated software packages"),
    ("lgpl-3", _GNU.format("gnu lesser", "3")),
    ("lgpl-3", _FREE.format("3", "lesser ") + " as published by the free software foundation(?: either)? version 3"),
    ("lgpl-3", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl-3", _GNU.format("gnu affero", "3")),
    ("agpl-3", _FREE.format("3", "affero ") + " as published by the free software foundation(?: either)? version 3"),
    ("agpl-3", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community"),
    ("gfdl-1", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1", "the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0"),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1", "the accompanying program is provided under the terms of this common public license"),
    ("epl-1", "the accompanying program is provided under the terms of this eclipse public license"),
    ("eupl-1", "licensed under the eupl version 1 [012]"),
    ("cecill-2", "this software is governed by the cecill license under french law and abiding by the rules of distribution of free software"),
    ("cecill-b", "this software is governed by the cecill b license under french law"),
    ("cecill-c", "this software is governed by the cecill c license under french law"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license if you do not accept the license do not use the software"),
    ("artistic-1", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("python", "psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "this product includes cryptographic software written by eric young"),
    ("php-3", "this source file is subject to version 3 0(?:1)? of the php license"),
    ("vim", "there are no restrictions on distributing unmodified copies of vim except that they must include this license text"),
    ("w3c", "permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("ofl-1", "this font software is licensed under the sil open font license version 1 [01]"),
    ("ofl-1", "permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy merge embed modify redistribute and sell modified and unmodified copies"),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files and any associated documentation"),
    ("icu", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
            "without restriction including without limitation the rights to use copy modify merge publish distribute and or sell copies of the software and to permit persons"),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("qpl-1", "the intent of this license is to establish freedom to share and change the software regulated by this license under the open source model"),
    ("afl-3", "this academic free license the license applies to any original work of authorship"),
    ("osl-3", "this open software license the license applies to any original work of authorship"),
    ("bsl-1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2", "the licensor grants you a non exclusive royalty free worldwide non sublicensable non transferable license to use copy distribute make available and prepare derivative works"),
    ("sspl-1", "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    ("commons-clause", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("polyform-nc", "the licensor grants you a copyright license for the software to do everything you might do with the software that would otherwise infringe the licensor s copyright in it for any permitted purpose"),
    ("odbl-1", "this database is made available under the open database license"),
    ("odbl-1", "any rights in individual contents of the database are licensed under the database contents license"),
    ("odc-by-1", "this data is made available under the open data commons attribution license"),
    ("ogl-3", "contains public sector information licensed under the open government licence v3 0"),
    ("cc-by-4", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd-4", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc-sa-4", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd-4", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("llama", "you will not use the llama materials or any output or results of the llama materials to improve any other large language model"),
    ("openrail-m", "use based restrictions as referenced in paragraph 5 must be included as an enforceable provision"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "this software is the confidential and proprietary information of"),
    ("proprietary", "no part of this (?:publication|work|book|document) may be reproduced(?: distributed)?(?: stored in a retrieval system)? or transmitted in any form or by any means"),
]

VERSION = r"(?: (?:version|v))?(?: v?\d(?: \d)?)?(?: (?:or|and) (?:any )?later(?: version)?| only)?"
GRANT = (
    r"(?:(?:dual |re)?licen[cs]ed|released|distributed|available|provided|published|shared|covered|redistributed|offered|governed)"
    r"(?: (?:to you|as is|for use))? (?:under|by|with|according to)(?: the)?(?: terms(?: and conditions)? of(?: the)?)?"
)
LICENCE = r"(?: (?:public )?licen[cs]e)"
# Every signature contains one of these (or "cc" and "by"), so that most texts are done after a few substring tests.
GATES = (
    "licen", "spdx", "copyleft", "reserved", "domain", "confidential", "creative", "cc0", "gpl", "cddl", "eupl", "cecill",
    "wtfpl", "sspl", "busl", "gfdl", "odbl", "pddl", "openrail", "bigscience", "permission", "permitted", "redistribut",
    "unencumbered", "noninfringement", "misrepresented", "forgive", "affirmer", "rightsholder", "openssl", "evil", "retain this notice",
    "consortium", "restriction", "implied", "apache", "semblance", "cryptographic", "enforceable", "llama", "unauthorized", "reproduced",
    "functionality",
)

GENERAL = [
    Rule("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|in to|into|to) the public domain", 3),
    Rule("public-domain", "rights reserved", r"no rights reserved", 2),
    Rule("proprietary", "rights reserved", r"all rights reserved", 2),
    Rule("proprietary", "confidential", r"proprietary and confidential", 3),
    Rule("proprietary", "license", r"end user licen[cs]e agreement", 2),
    Rule("copyleft", "copyleft", r"copyleft(?: all wrongs reserved)?", 1),
    Rule("unknown", "license", r"licensed under the terms (?:found|described) in", 1),
    Rule("unknown", "license", r"see (?:the )?(?:accompanying )?licen[cs]e (?:file|txt|md)(?: for (?:details|more information))?", 1),
]


def required(pattern: str) -> str:
    """The pattern without its optional parts and choices."""
    return re.sub(r"\(\?:[^()]*\)\??|\S\?|\\S\*", " ", re.sub(r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)\?", " ", pattern))


def keyword_of(pattern: str) -> str:
    """The longest plain word that every match contains."""
    return max((w for w in required(pattern).split() if w.isalnum()), key=len, default="license")


def passes_gate(pattern: str) -> bool:
    text = required(pattern)
    return any(g in text for g in GATES) or ("cc" in text and "by" in text)


def build_rules() -> list[Rule]:
    """Signatures in the order of families and forms. A name that isn't telling by itself needs the word licence."""
    rules = list(GENERAL) + [Rule(label, keyword_of(pattern), pattern, 4) for label, pattern in TEXTS]
    for label, names, identifiers in FAMILIES:
        for words in identifiers.split("|"):
            rules.append(Rule(label, "spdx", rf"spdx licen[cs]e identifier {words}(?: or later| only)?", 4))
        for name in _alternatives(names):
            keyword, telling = keyword_of(name), passes_gate(name)
            optional = "?" if telling else ""
            rules.append(Rule(label, keyword, rf"{GRANT} (?:the )?{name}{LICENCE}{optional}{VERSION}", 3))
            rules.append(Rule(label, keyword, rf"(?:the )?{name}{LICENCE}{VERSION}", 2))
            if telling:
                rules.append(Rule(label, keyword, rf"{name}{VERSION}", 1))
    return rules


def _alternatives(names: str) -> list[str]:
    """Split at the bars that aren't inside brackets."""
    parts, depth = [""], 0
    for char in names:
        depth += (char == "(") - (char == ")")
        if char == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += char
    return parts


RULES = build_rules()
