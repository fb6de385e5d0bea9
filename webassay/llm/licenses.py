"""License scans by ordered signature rules, in DataFrame functions only.

Texts are lower-cased (A-Z) and normalised to words with one space between.
Hundreds of regular expressions look for license statements. A text is first
searched for a few stems, then each rule's keyword decides whether the rule
runs at all. Hits are intervals; in the order of start, length, priority and
rule, a hit that lies inside an earlier one of the same or a higher priority
is suppressed. Base phrases are counted apart, at all places.

Nulls and edges: a null text is empty: no words, no places, empty labels,
score 0. Repeated rows are scanned alike, long texts whole, other columns not
at all; an empty table gives an empty result. Hits that tie in place, length and
priority are all kept, the first rule's first. The score is a
noisy-or over the labels that stay: 0.9 for base labels and full statements,
0.6 for a family without version, 0.3 for a mere hint.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webassay.llm import common
from webassay.llm.common import let

#: Anything but ASCII letters, digits and what isn't ASCII separates words.
NOT_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: Phrases and labels of the base scan.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
WEIGHTS = {1: 0.3, 2: 0.6, 3: 0.9}


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: tuple[str, ...]  # one of them is in every text that the pattern matches
    pattern: str


def _version(v: str) -> str:
    """A version with or without its .0, however it is introduced."""
    main = v.removesuffix(".0").replace(".", " ")
    tail = "(?: 0)?(?! [0-9])" if v.endswith(".0") else "(?! [0-9])"
    return f"(?: version| ver| v| revision)? v?{main}{tail}"


_LATER = "(?: only| or (?:any )?later(?: version)?| or newer)?"

def literals(names: str) -> tuple[str, ...]:
    """For each alternative of a family's names the longest text that its matches have."""
    names = re.sub(r"\(\?:[^()|]*\)\?|\[[^]]*\]|.\?(?!:)", "~", names)
    inner = re.search(r"\(\?:([^()]*\|[^()]*)\)", names)
    rest = max(re.split("[~()|?:]", names[: inner.start()] + "~" + names[inner.end() :]), key=len) if inner else ""
    if len(rest.strip()) > 3:
        return (rest.strip(),)
    return tuple(dict.fromkeys(max(x.split("~"), key=len).strip() for x in (inner[1] if inner else names).split("|")))


#: family label: (names in normalised words, versions)
FAMILIES: dict[str, tuple[str, tuple[str, ...]]] = {
    "gpl": ("(?:gnu )?(?:general public licen[sc]e|gpl)", ("1.0", "2.0", "3.0")),
    "lgpl": ("(?:gnu )?(?:lesser general public licen[sc]e|library general public licen[sc]e|lgpl)", ("2.0", "2.1", "3.0")),
    "agpl": ("(?:gnu )?(?:affero general public licen[sc]e|agpl)", ("1.0", "3.0")),
    "gfdl": ("(?:gnu )?(?:free documentation licen[sc]e|gfdl|fdl)", ("1.1", "1.2", "1.3")),
    "apache": ("apache(?: software)?(?: licen[sc]e)?", ("1.0", "1.1", "2.0")),
    "mpl": ("(?:mozilla public licen[sc]e|mpl)", ("1.0", "1.1", "2.0")),
    "epl": ("(?:eclipse public licen[sc]e|epl)", ("1.0", "2.0")),
    "cddl": ("(?:common development and distribution licen[sc]e|cddl)", ("1.0", "1.1")),
    "cpl": ("(?:common public licen[sc]e|cpl)", ("1.0",)),
    "eupl": ("(?:european union public licen[sc]e|eupl)", ("1.0", "1.1", "1.2")),
    "osl": ("(?:open software licen[sc]e|osl)", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    "afl": ("(?:academic free licen[sc]e|afl)", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    "artistic": ("(?:perl )?artistic(?: licen[sc]e)?", ("1.0", "2.0")),
    "ofl": ("(?:sil )?(?:open font licen[sc]e|ofl)", ("1.0", "1.1")),
    "lppl": ("(?:latex project public licen[sc]e|lppl)", ("1.0", "1.1", "1.2", "1.3")),
    "ecl": ("(?:educational community licen[sc]e|ecl)", ("1.0", "2.0")),
    "apsl": ("(?:apple public source licen[sc]e|apsl)", ("1.0", "1.1", "1.2", "2.0")),
    "zpl": ("(?:zope public licen[sc]e|zpl)", ("1.1", "2.0", "2.1")),
    "php": ("php licen[sc]e", ("3.0", "3.01")),
    "psf": ("(?:python(?: software foundation)? licen[sc]e|psf licen[sc]e)", ("2.0",)),
    "cecill": ("cecill(?: [bc])?(?: licen[sc]e)?", ("1.0", "1.1", "2.0", "2.1")),
    "boost": ("(?:boost software licen[sc]e|bsl)", ("1.0",)),
    "odbl": ("(?:open database licen[sc]e|odbl|odc odbl)", ("1.0",)),
    "odc-by": ("(?:open data commons attribution licen[sc]e|odc by)", ("1.0",)),
    "pddl": ("(?:public domain dedication and licen[sc]e|pddl)", ("1.0",)),
    "ogl": ("(?:open government licen[sc]e|ogl)", ("1.0", "2.0", "3.0")),
    "ncsa": ("(?:university of illinois )?ncsa(?: open source)? licen[sc]e", ()),
    "mulan": ("mulan (?:psl|permissive software licen[sc]e)", ("1.0", "2.0")),
    "ms-pl": ("microsoft public licen[sc]e", ()),
    "ms-rl": ("microsoft reciprocal licen[sc]e", ()),
    "upl": ("(?:universal permissive licen[sc]e|upl)", ("1.0",)),
    "cpal": ("(?:common public attribution licen[sc]e|cpal)", ("1.0",)),
    "ipl": ("(?:ibm public licen[sc]e|ipl)", ("1.0",)),
    "npl": ("(?:netscape public licen[sc]e|npl)", ("1.0", "1.1")),
    "qpl": ("(?:q public licen[sc]e|qpl)", ("1.0",)),
    "rpl": ("(?:reciprocal public licen[sc]e|rpl)", ("1.1", "1.5")),
    "sspl": ("(?:server side public licen[sc]e|sspl)", ("1.0",)),
    "busl": ("(?:business source licen[sc]e|busl)", ("1.0", "1.1")),
    "elastic": ("elastic licen[sc]e", ("1.0", "2.0")),
    "polyform": ("polyform (?:noncommercial|small business|shield|strict|perimeter|internal use)(?: licen[sc]e)?", ("1.0",)),
    "rail": ("(?:open ?rail|creativeml open rail)(?: m)?(?: licen[sc]e)?", ("1.0",)),
    "unicode": ("unicode(?: data files and software)? licen[sc]e", ("3.0",)),
    "openssl": ("openssl licen[sc]e", ()),
    "ruby": ("ruby licen[sc]e", ()),
    "vim": ("vim licen[sc]e", ()),
    "zlib": ("zlib(?: libpng)? licen[sc]e", ()),
    "libpng": ("libpng licen[sc]e", ("2.0",)),
    "x11": ("x11 licen[sc]e", ()),
    "sleepycat": ("sleepycat licen[sc]e", ()),
    "beerware": ("beer ?ware(?: licen[sc]e)?", ()),
    "jsr": ("json licen[sc]e", ()),
    "postgresql": ("postgresql licen[sc]e", ()),
    "curl": ("curl licen[sc]e", ()),
}

#: Creative Commons: parts in short and in words.
CC_PARTS = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s?", "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}

#: Single statements: (label, priority, keyword or several with | between, pattern).
STATEMENTS = (
    ("mit", 3, "mit", "(?:released |licensed |distributed )?(?:under )?(?:the )?(?:terms of the )?mit licen[sc]e"),
    ("mit", 3, "mit", "mit licensed"),
    ("mit", 2, "mit", "licen[sc]e mit"),
    ("mit", 3, "free of charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 3, "implied", "the software is provided as is without warranty of any kind express or implied"),
    ("mit", 3, "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("isc", 3, "isc", "isc licen[sc]e"),
    ("isc", 3, "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", 2, "bsd", "bsd(?: style)? licen[sc]ed?"),
    ("bsd", 2, "bsd", "licen[sc]ed? under (?:the )?bsd"),
    ("bsd", 3, "binary", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 3, "binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 3, "source code", "redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", 3, "endorse", "may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 3, "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("bsd-0-clause", 3, "0bsd", "0bsd(?: licen[sc]e)?"),
    ("unlicense", 3, "unlicense", "(?:the )?unlicense"),
    ("unlicense", 3, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", 3, "wtfpl", "wtfpl"),
    ("wtfpl", 3, "want to", "do what the fuck you want to public licen[sc]e"),
    ("cc0-1.0", 3, "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", 3, "zero", "creative commons zero"),
    ("public-domain", 2, "public domain", "(?:released |dedicated |placed )?(?:in |in to |into |to )?(?:the )?public domain"),
    ("public-domain", 2, "gemeinfrei", "gemeinfrei(?:e[snmr]?)?"),
    ("public-domain", 2, "domaine public", "domaine public"),
    ("public-domain", 2, "dominio", "dominio publico"),
    ("creative-commons", 2, "creative commons", "creative commons(?: licen[sc]e)?"),
    ("apache-2.0", 3, "in compliance", "you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", 3, "apache org", "http www apache org licenses licen[sc]e 2 0"),
    ("gpl", 3, "gnu", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl", 3, "free software foundation", "free software foundation either version [0-9] of the licen[sc]e"),
    ("gpl", 2, "gnu org", "www gnu org licenses"),
    ("copyleft", 2, "copyleft", "copyleft"),
    ("spdx", 2, "spdx", "spdx licen[sc]e identifier"),
    ("reserved", 3, "reserved", "(?:all|alle|some|no) rights? reserved"),
    ("reserved", 3, "vorbehalten", "alle rechte vorbehalten"),
    ("reserved", 3, "droits", "tous droits r[eé]serv[eé]s"),
    ("reserved", 3, "derechos", "todos los derechos reservados"),
    ("copyright", 2, "copyright", "copyright(?: c)?(?: [0-9]{4})+"),
    ("copyright", 1, "copyright", "copyright(?:ed)?(?: material| notice| holder| owner)?"),
    ("copyright", 1, "urheberrecht", "urheberrecht(?:lich gesch[uü]tzt)?"),
    ("proprietary", 2, "proprietary", "proprietary(?: and confidential| licen[sc]e| software)"),
    ("proprietary", 2, "confidential", "confidential and proprietary"),
    ("no-redistribution", 3, "prohibited", "(?:unauthorized |unauthorised )?(?:copying|reproduction|distribution|redistribution)(?: [a-z]+){0,8} (?:is )?(?:strictly )?prohibited"),
    ("no-redistribution", 3, "reproduced", "no part of this [a-z]+ may be reproduced"),
    ("no-redistribution", 2, "permission", "(?:without|with) (?:the )?(?:prior |express )?(?:written )?permission of the (?:copyright )?(?:owner|holder|author|publisher)s?"),
    ("non-commercial", 2, "commercial", "(?:for )?non ?commercial (?:use|purposes|purpose)(?: only)?"),
    ("non-commercial", 2, "commercial", "not for commercial use"),
    ("no-derivatives", 2, "deriv", "no deriv(?:ative)?s?(?: works?)?"),
    ("share-alike", 2, "share", "share ?alike"),
    ("research-only", 2, "research", "(?:for )?research (?:use|purposes) only"),
    ("personal-use", 2, "personal", "(?:for )?personal use only"),
    ("evaluation-only", 2, "evaluation", "evaluation (?:use|purposes) only"),
    ("eula", 2, "end user", "end user licen[sc]e agreement"),
    ("eula", 2, "eula", "eula"),
    ("terms", 1, "terms of", "terms of (?:use|service)"),
    ("terms", 1, "terms and", "terms and conditions"),
    ("trademark", 1, "trademark", "(?:registered )?trademarks?(?: of)?"),
    ("patent", 1, "patent", "patents? (?:pending|granted|licen[sc]e)"),
    ("warranty-disclaimer", 2, "warrant", "without (?:any )?warrant(?:y|ies)(?: of any kind)?"),
    ("warranty-disclaimer", 2, "as is", "provided as is"),
    ("warranty-disclaimer", 2, "merchantab", "merchantability (?:and|or) fitness for a particular purpose"),
    ("dual-license", 2, "dual", "dual licen[sc]ed"),
    ("open-source", 1, "open source", "open source(?: software| licen[sc]e)?"),
    ("license", 1, "is licensed|is distributed|is released|is made available", "(?:this|the) (?:work|software|program|file|document|text) is (?:licensed|distributed|released|made available)"),
    ("license", 1, "licensed under|released under|distributed under|available under", "(?:licensed|released|distributed|available) under(?: the)?(?: terms of)?(?: the)?"),
    ("license", 1, "licen", "see (?:the )?licen[sc]e(?: file)?(?: for details)?"),
    ("license", 1, "lizenz", "lizenziert unter(?: der)?"),
    ("license", 1, "licence", "sous (?:la )?licence"),
    ("license", 1, "licencia", "bajo (?:la )?licencia"),
    ("apache-2.0", 3, "contributor licen", "licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("apache-2.0", 3, "basis without", "distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", 3, "limitations under", "see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e"),
    ("gpl", 3, "hope that it", "this program is distributed in the hope that it will be useful"),
    ("gpl", 3, "copy of the gnu", "you should have received a copy of the gnu general public licen[sc]e"),
    ("lgpl", 3, "gnu lesser", "gnu lesser general public licen[sc]e as published by the free software foundation"),
    ("agpl", 3, "gnu affero", "gnu affero general public licen[sc]e as published by the free software foundation"),
    ("gfdl", 3, "gnu free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("mpl", 3, "source code form", "this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl-2.0", 3, "mozilla org mpl", "mozilla org mpl 2 0"),
    ("epl", 3, "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("cddl", 3, "common development", "subject to the terms of the common development and distribution licen[sc]e"),
    ("boost-1.0", 3, "boost org", "www boost org licen[sc]e 1 0 txt"),
    ("zlib", 3, "express or implied", "this software is provided as is without any express or implied warranty"),
    ("zlib", 3, "altered source", "altered source versions must be plainly marked as such"),
    ("zlib", 3, "misrepresented", "the origin of this software must not be misrepresented"),
    ("mit", 3, "mit x11", "mit x11 licen[sc]e"),
    ("bsd", 3, "nor the names", "nor the names of its contributors may be used to endorse or promote products derived"),
    ("bsd", 3, "regents", "the regents of the university of california all rights reserved"),
    ("bsd-2-clause", 3, "simplified bsd", "simplified bsd(?: licen[sc]e)?"),
    ("bsd-3-clause", 3, "bsd", "(?:new|modified|revised) bsd(?: licen[sc]e)?"),
    ("bsd-4-clause", 3, "original bsd", "original bsd(?: licen[sc]e)?"),
    ("bsd-0-clause", 3, "zero clause bsd", "zero clause bsd(?: licen[sc]e)?"),
    ("cc0-1.0", 3, "waived", "waived all copyright and related or neighbou?ring rights"),
    ("cc-by", 2, "creative commons attribution", "licensed under a creative commons attribution(?! (?:share|non|no))"),
    ("public-domain", 3, "public domain", "this work (?:is|has been) (?:released |placed |dedicated )?(?:in|into|to) the public domain"),
    ("public-domain", 3, "public domain mark", "public domain mark(?: 1 0)?"),
    ("ogl", 3, "public sector", "contains public sector information licensed under the open government licen[sc]e"),
    ("odbl", 3, "openstreetmap", "openstreetmap contributors (?:available under |licensed under )?(?:the )?open database licen[sc]e"),
    ("ofl", 3, "reserved font", "with reserved font names?"),
    ("artistic", 3, "terms as perl", "under the same terms as perl(?: itself)?"),
    ("ruby", 2, "terms as ruby", "under the same terms as ruby"),
    ("psf", 3, "python software foundation", "copyright (?:c )?(?:[0-9]{4} )*python software foundation"),
    ("unicode", 3, "unicode inc", "copyright (?:c )?(?:[0-9]{4} )*unicode inc"),
    ("beerware", 3, "buy me a beer", "you can buy me a beer in return"),
    ("jsr", 3, "good not evil", "the software shall be used for good not evil"),
    ("hippocratic", 3, "hippocratic licen", "hippocratic licen[sc]e(?: version)?(?: [0-9](?: [0-9])?)?"),
    ("anti-996", 3, "anti 996", "anti 996 licen[sc]e"),
    ("commons-clause", 3, "commons clause", "commons clause licen[sc]e condition"),
    ("confluent", 3, "confluent community", "confluent community licen[sc]e(?: agreement)?"),
    ("redis", 3, "redis source", "redis source available licen[sc]e"),
    ("cockroachdb", 3, "cockroachdb community", "cockroachdb community licen[sc]e"),
    ("timescale", 3, "timescale licen", "timescale licen[sc]e(?: agreement)?"),
    ("llama", 3, "llama", "llama (?:[0-9] )*community licen[sc]e(?: agreement)?"),
    ("gemma", 3, "gemma terms", "gemma terms of use"),
    ("falcon", 3, "falcon", "(?:tii )?falcon (?:[a-z0-9]+ )?licen[sc]e"),
    ("rail", 3, "bigcode", "bigcode open ?rail m(?: licen[sc]e)?"),
    ("cdla-permissive", 3, "community data licen", "community data licen[sc]e agreement permissive(?: version)?(?: [0-9] [0-9])?"),
    ("cdla-sharing", 3, "community data licen", "community data licen[sc]e agreement sharing(?: version)?(?: [0-9] [0-9])?"),
    ("etalab", 3, "licence ouverte|etalab", "(?:licence ouverte|etalab open licen[sc]e)"),
    ("dl-de", 3, "datenlizenz", "datenlizenz deutschland(?: namensnennung| zero)?(?: version)?(?: 2 0)?"),
    ("crown-copyright", 2, "crown copyright", "crown copyright"),
    ("oracle-bcl", 3, "binary code licen", "oracle binary code licen[sc]e(?: agreement)?"),
    ("ms-eula", 3, "microsoft software", "microsoft software licen[sc]e terms"),
    ("apple-eula", 3, "apple", "apple (?:inc )?software licen[sc]e agreement"),
    ("nvidia", 3, "nvidia", "nvidia (?:software |deep learning container )?licen[sc]e(?: agreement)?"),
    ("intel-simplified", 3, "intel simplified", "intel simplified software licen[sc]e"),
    ("amazon", 3, "amazon software", "amazon software licen[sc]e"),
    ("unsplash", 3, "unsplash", "unsplash licen[sc]e"),
    ("pexels", 3, "pexels", "pexels licen[sc]e"),
    ("pixabay", 3, "pixabay", "pixabay (?:content )?licen[sc]e"),
    ("royalty-free", 2, "royalty free", "royalty free(?: non exclusive| worldwide)? licen[sc]e"),
    ("license", 2, "non exclusive", "(?:perpetual |worldwide |irrevocable ){0,3}non exclusive(?: perpetual| worldwide| irrevocable| royalty free| transferable| sublicen[sc]able){0,4} licen[sc]e"),
    ("reserved", 3, "nachdruck", "nachdruck(?: auch auszugsweise)? (?:nur mit genehmigung|verboten)"),
    ("reserved", 3, "reproduction interdite", "reproduction interdite"),
    ("reserved", 3, "prohibida", "prohibida (?:la |su )reproducci[oó]n"),
    ("reserved", 3, "direitos", "todos os direitos reservados"),
    ("reserved", 3, "diritti", "tutti i diritti riservati"),
    ("trade-secret", 2, "trade secret", "trade secrets? (?:and )?(?:proprietary|confidential) information"),
    ("educational-use", 2, "educational", "(?:for )?educational (?:use|purposes) only"),
    ("academic-use", 2, "academic", "(?:for )?academic (?:use|research|purposes) only"),
    ("warranty-disclaimer", 2, "expressly disclaim", "expressly disclaims? (?:any|all) warrant(?:y|ies)"),
    ("warranty-disclaimer", 2, "no warranty", "(?:comes with|there is|with) (?:absolutely )?no warranty"),
    ("liability-disclaimer", 2, "be liable", "in no event shall (?:the )?(?:authors?|copyright holders?|contributors?)(?: or [a-z]+){0,4} be liable for any"),
    ("redistribution", 1, "distributed", "(?:may|can) be (?:freely )?(?:re)?distributed(?: and or modified)?"),
    ("attribution", 1, "attribution required", "attribution required"),
    ("cla", 1, "contributor licen", "contributor licen[sc]e agreement"),
    ("copyleft-next", 3, "copyleft next", "copyleft next(?: [0-9]){0,3}"),
    ("free-art", 3, "free art|art libre", "(?:free art licen[sc]e|licence art libre)(?: 1 3)?"),
    ("open-content", 3, "open content", "open content licen[sc]e"),
    ("opl", 3, "open publication", "open publication licen[sc]e"),
    ("dsl", 3, "design science", "design science licen[sc]e"),
    ("miros", 3, "miros", "miros licen[sc]e"),
    ("blue-oak", 3, "blue oak", "blue oak model licen[sc]e(?: 1 0 0)?"),
    ("parity", 3, "parity public", "parity public licen[sc]e(?: [0-9] 0 0)?"),
    ("prosperity", 3, "prosperity public", "prosperity public licen[sc]e(?: [0-9] 0 0)?"),
    ("openldap", 3, "openldap", "openldap public licen[sc]e(?: v?[0-9](?: [0-9])?)?"),
    ("imagemagick", 3, "imagemagick", "imagemagick licen[sc]e"),
    ("freetype", 3, "freetype", "freetype (?:project )?licen[sc]e"),
    ("tcl", 3, "tcl tk", "tcl tk licen[sc]e"),
    ("w3c", 3, "w3c", "w3c software (?:and document )?(?:notice and )?licen[sc]e"),
    ("cern-ohl", 3, "cern open hardware", "cern open hardware licen[sc]e(?: version)?(?: [12](?: [0-9])?)?(?: strongly reciprocal| weakly reciprocal| permissive)?"),
    ("tapr-ohl", 3, "tapr", "tapr open hardware licen[sc]e"),
    ("solderpad", 3, "solderpad", "solderpad hardware licen[sc]e"),
    ("watcom", 3, "watcom", "(?:sybase )?open watcom public licen[sc]e"),
    ("sun-public", 3, "sun public", "sun public licen[sc]e"),
    ("sissl", 3, "sun industry", "sun industry standards source licen[sc]e"),
    ("nokia", 3, "nokia open", "nokia open source licen[sc]e"),
    ("realnetworks", 3, "realnetworks", "realnetworks public source licen[sc]e"),
    ("lucent", 3, "lucent public", "lucent public licen[sc]e"),
    ("intel-osl", 3, "intel open", "intel open source licen[sc]e"),
    ("naumen", 3, "naumen", "naumen public licen[sc]e"),
    ("frameworx", 3, "frameworx", "frameworx open licen[sc]e"),
    ("fair", 3, "fair licen", "(?:the )?fair licen[sc]e"),
    ("ntp", 3, "ntp licen", "ntp licen[sc]e"),
    ("simple-pl", 3, "simple public", "simple public licen[sc]e"),
    ("ricoh", 3, "ricoh source", "ricoh source code public licen[sc]e"),
    ("vovida", 3, "vovida", "vovida software licen[sc]e"),
    ("x-net", 3, "x net", "x net licen[sc]e"),
    ("entessa", 3, "entessa", "entessa public licen[sc]e"),
    ("cua-opl", 3, "cua office", "cua office public licen[sc]e"),
    ("ecos", 3, "ecos licen", "ecos licen[sc]e"),
    ("eiffel", 3, "eiffel forum", "eiffel forum licen[sc]e"),
    ("nethack", 3, "nethack", "nethack general public licen[sc]e"),
    ("oclc", 3, "oclc", "oclc research public licen[sc]e"),
    ("historical", 3, "historical permission", "historical permission notice and disclaimer"),
    ("license", 1, "lizenz", "(?:unter|mit) (?:der|einer) lizenz"),
    ("license", 1, "licencia", "licencia (?:de uso|p[uú]blica|libre)"),
    ("license", 1, "licence", "licence (?:libre|publique|propri[eé]taire)"),
)


def _rules() -> list[Rule]:
    rules = [Rule(label, priority, tuple(keyword.split("|")), pattern) for label, priority, keyword, pattern in STATEMENTS]
    for label, (names, versions) in FAMILIES.items():
        keyword = literals(names)
        rules += [Rule(f"{label}-{v}", 3, keyword, f"{names}{_version(v)}{_LATER}") for v in versions]
        rules += [Rule(f"{label}-{v}", 3, ("identifier",), f"licen[sc]e identifier {label.replace('-', ' ')}(?: v)? {v.replace('.', ' ')}{_LATER}") for v in versions]
        rules.append(Rule(label, 2, keyword, names))
    for (short, words), v in product(CC_PARTS.items(), ("1.0", "2.0", "2.5", "3.0", "4.0")):
        rules.append(Rule(f"cc-{short}-{v}", 3, (f"cc {short[:2]}",), f"cc {short.replace('-', ' ')}{_version(v)}(?: international| unported| generic)?"))
        rules.append(Rule(f"cc-{short}-{v}", 3, ("creative commons",), f"creative commons (?:{words}|{short.replace('-', ' ')})(?: licen[sc]e)?{_version(v)}(?: international| unported| generic)?(?: licen[sc]e)?"))
        rules.append(Rule(f"cc-{short}-{v}", 3, ("creativecommons",), f"creativecommons org licenses {short.replace('-', ' ')} {v.replace('.', ' ')}"))
        if v == "4.0":
            rules.append(Rule(f"cc-{short}", 2, ("cc", "creative commons"), f"(?:creative commons |cc ){short.replace('-', ' ')}(?! (?:sa|nd|nc))"))
            rules.append(Rule(f"cc-{short}", 2, ("creative commons",), f"creative commons {words}"))
    for n in (1, 2, 3, 4):
        word = ("one", "two", "three", "four")[n - 1]
        rules.append(Rule(f"bsd-{n}-clause", 3, ("bsd",), f"(?:bsd {n} clause|{n} clause bsd|{word} clause bsd|bsd {word} clause)(?: licen[sc]e)?"))
        rules.append(Rule(f"bsd-{n}-clause", 3, ("bsd",), f"bsd licen[sc]e {n} clause"))
    return rules


RULES = _rules()
#: A text without any of these stems or whole acronyms has no hit of any rule and no base phrase. Stems are single words, as
#: the gate sees the raw text; a test holds each rule against it.
STEMS = ("licen", "lizenz", "public", "right", "rechte", "droits", "derechos", "gemeinfrei", "dominio", "source", "binary", "software", "apache", "artistic", "cecill", "mulan", "polyform", "wtfpl", "copyleft", "spdx", "urheber", "proprietary", "prohibited", "reproduced", "permission", "commercial", "deriv", "share", "research", "personal", "evaluation", "eula", "terms", "trademark", "patent", "warrant", "provided", "merchantab", "bsd", "creative", "rail", "beer", "released", "distributed", "available", "mozilla", "reserv", "nachdruck", "interdite", "prohibida", "direitos", "diritti", "confidential", "educational", "academic", "liable", "attribution", "plainly")
ACRONYMS = ("gpl", "lgpl", "agpl", "gfdl", "fdl", "mpl", "epl", "cddl", "cpl", "eupl", "osl", "afl", "ofl", "lppl", "ecl", "apsl", "zpl", "bsl", "odbl", "odc", "pddl", "ogl", "upl", "cpal", "ipl", "npl", "qpl", "rpl", "sspl", "busl", "cc", "cc0")
KEYWORDS = tuple(dict.fromkeys(k for r in RULES for k in r.keywords))


def gate(text: Column) -> Column:
    """Whether any rule or base phrase can match: stems anywhere, acronyms as words by one pass over the text."""
    low = F.lower(text)
    stems = reduce(lambda a, b: a | b, [low.contains(s) for s in STEMS])
    return stems | low.rlike(r"(?<![a-z0-9])(?:" + "|".join(ACRONYMS) + r")(?![a-z0-9])")


def normalised(text: Column) -> Column:
    """' w1 w2 ... ' with A-Z lower-cased."""
    low = F.translate(text, common.UPPER, common.LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, f"[{NOT_WORD}]+", " ")), F.lit(" "))


def places(words: Column, phrase: str) -> Column:
    """Starts, in words from 0, at which the words of the phrase follow each other."""
    parts = phrase.split()
    fits = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(parts)])
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0))), fits)


def rule_array() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.array(*[F.lit(k) for k in r.keywords]).alias("keywords"), F.lit(f" {r.pattern}(?= )").alias("pattern")) for i, r in enumerate(RULES)])


def hits(text: Column) -> Column:
    """Structs (start, minus_end, minus_priority, id, label) of every rule's matches, sorted."""

    def of_rule(r: Column) -> Column:
        found = F.regexp_extract_all(text, r["pattern"], F.lit(0))

        def place(found: Column) -> Column:
            gaps = F.split(text, r["pattern"], -1)
            step = lambda acc, x: F.struct((acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("start"), (-(acc["at"] + F.length(x["gap"]) + F.length(x["hit"]))).alias("minus_end"), (-r["priority"]).alias("minus_priority"), r["id"].alias("id"), r["label"].alias("label")))).alias("out"))
            pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
            start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,minus_end:int,minus_priority:int,id:int,label:string>>").alias("out"))
            return F.aggregate(pairs, start, step, lambda acc: acc["out"])

        return let(found, lambda f: F.when(F.size(f) > 0, place(f)))

    def run(present: Column) -> Column:
        wanted = F.filter(rule_array(), lambda r: F.arrays_overlap(r["keywords"], present))
        return F.sort_array(F.flatten(F.array_compact(F.transform(wanted, of_rule))))

    return let(F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: text.contains(k)), run)


def kept_labels(found: Column) -> Column:
    """Distinct structs (label, priority) of hits that no earlier hit of at least their priority contains."""
    none = F.lit(-1)

    def step(acc: Column, h: Column) -> Column:
        end, p = -h["minus_end"], -h["minus_priority"]
        inside = (acc["p3"] >= end) | ((p <= 2) & (acc["p2"] >= end)) | ((p <= 1) & (acc["p1"] >= end))
        high = lambda k: F.when(~inside & (p == k), F.greatest(acc[f"p{k}"], end)).otherwise(acc[f"p{k}"])
        return F.struct(high(1).alias("p1"), high(2).alias("p2"), high(3).alias("p3"), F.when(inside, acc["out"]).otherwise(F.array_union(acc["out"], F.array(F.struct(h["label"].alias("label"), p.alias("priority"))))).alias("out"))

    start = F.struct(none.alias("p1"), none.alias("p2"), none.alias("p3"), F.array().cast("array<struct<label:string,priority:int>>").alias("out"))
    return F.aggregate(found, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places and labels, score."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.regexp_count(text, F.lit(r"[\p{Alnum}\x{80}-\x{10FFFF}]++")), F.lit(0)).cast("long").alias("n_words"), F.when(gate(text), normalised(text)).alias("norm"))
    phrases = list(BASE)
    found = rows.select("doc_id", "n_words", "norm", F.when(reduce(lambda a, b: a | b, [F.col("norm").contains(f" {p} ") for p in phrases]), let(F.split(F.trim("norm"), " "), lambda w: F.array(*[places(w, p) for p in phrases]))).alias("places"), F.when(F.col("norm").isNotNull(), let(hits(F.col("norm")), kept_labels)).alias("kept"))
    at = F.flatten(F.coalesce("places", F.array().cast("array<array<int>>")))
    base = F.array_compact(F.array(*[F.when(F.coalesce(F.size(F.get("places", i)), F.lit(0)) > 0, F.lit(BASE[p])) for i, p in enumerate(phrases)]))
    named = found.select("doc_id", "n_words", at.alias("at"), base.alias("base"), F.coalesce("kept", F.array().cast("array<struct<label:string,priority:int>>")).alias("kept"))
    labels = F.array_sort(F.array_union("base", F.transform("kept", lambda x: x["label"])))
    miss = F.when(F.size("base") > 0, F.lit(1 - WEIGHTS[3])).otherwise(F.lit(1.0))
    weight = lambda p: F.when(p == 3, 1 - WEIGHTS[3]).when(p == 2, 1 - WEIGHTS[2]).otherwise(1 - WEIGHTS[1])
    score = 1 - F.aggregate("kept", miss, lambda acc, x: acc * weight(x["priority"]))
    return named.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.round(score, 6).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.read(spark, sf_dir, "documents"))
