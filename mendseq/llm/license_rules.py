"""The rules of the license scan: regexes over normalised text, in order of priority.

Normalised text is lower-case words of ASCII letters, digits and anything beyond ASCII, with one
blank between them, so "Apache License, Version 2.0" reads "apache license version 2 0".
A rule is looked for only where all of its keywords, whole words, occur.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

# Priorities: a detection inside another one of the same or a smaller number is dropped.
TEXT, TAG, GRANT, LINK, NAME, HINT = range(6)
WEIGHT = {TEXT: 1.0, TAG: 1.0, GRANT: 0.95, LINK: 0.9, NAME: 0.7, HINT: 0.3}

# Phrases whose places are always reported, whatever lies around them.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Licenses, specific ones first: label, keywords, name, SPDX identifier.
LICENSES = [
    ("agpl-3-or-later", "affero", r"(?:gnu )?affero general public license(?: \S+){0,3} v?(?:ersion )?3(?: 0)? or (?:any )?(?:later|newer)", r"agpl 3 0 or later"),
    ("agpl-3", "affero", r"(?:gnu )?affero (?:general public license|gpl)(?: \S+){0,2} v?(?:ersion )?3(?: 0)?", r"agpl 3 0(?: only)?"),
    ("agpl-1", "affero", r"affero general public license(?: v| version)? 1(?: 0)?", r"agpl 1 0(?: only| or later)?"),
    ("agpl", "affero", r"(?:gnu )?affero (?:general public license|gpl)", r"agpl"),
    ("lgpl-3-or-later", "lesser", r"(?:gnu )?lesser general public license(?: \S+){0,3} v?(?:ersion )?3(?: 0)? or (?:any )?(?:later|newer)", r"lgpl 3 0 or later"),
    ("lgpl-3", "lesser", r"(?:gnu )?lesser (?:general public license|gpl)(?: \S+){0,2} v?(?:ersion )?3(?: 0)?", r"lgpl 3 0(?: only)?"),
    ("lgpl-2-1-or-later", "lesser", r"(?:gnu )?lesser general public license(?: \S+){0,3} v?(?:ersion )?2 1 or (?:any )?(?:later|newer)", r"lgpl 2 1 or later"),
    ("lgpl-2-1", "lesser", r"(?:gnu )?lesser (?:general public license|gpl)(?: \S+){0,2} v?(?:ersion )?2 1", r"lgpl 2 1(?: only)?"),
    ("lgpl-2", "library", r"(?:gnu )?library general public license(?:(?: v| version)? 2(?: 0)?)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser (?:general public license|gpl)", r"lgpl"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation license(?: v?(?:ersion )?1 [0-3])?", r"gfdl(?: 1 [1-3])?(?: invariants| no invariants)?(?: only| or later)?"),
    ("gpl-3-or-later", "public", r"(?:gnu )?general public license(?: \S+){0,3} v?(?:ersion )?3(?: 0)? or (?:any )?(?:later|newer)", r"gpl 3 0 or later"),
    ("gpl-3", "public", r"(?:gnu )?general public license(?: \S+){0,2} v?(?:ersion )?3(?: 0)?", r"gpl 3 0(?: only)?"),
    ("gpl-2-or-later", "public", r"(?:gnu )?general public license(?: \S+){0,3} v?(?:ersion )?2(?: 0)? or (?:any )?(?:later|newer)", r"gpl 2 0 or later"),
    ("gpl-2", "public", r"(?:gnu )?general public license(?: \S+){0,2} v?(?:ersion )?2(?: 0)?", r"gpl 2 0(?: only)?"),
    ("gpl-1", "public", r"(?:gnu )?general public license(?: v| version)? 1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl", "public", r"(?:gnu )?general public license", r"gpl"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: v| version| v)? ?2(?: 0)?", r"apache 2 0"),
    ("apache-1-1", "apache", r"apache(?: software)? license(?: v| version)? 1 1", r"apache 1 1"),
    ("apache-1", "apache", r"apache(?: software)? license(?: v| version)? 1 0", r"apache 1 0"),
    ("apache", "apache", r"apache(?: software)? license", r"apache"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?", r"bsd 4 clause(?: \S+)?"),
    ("bsd-3-clause-clear", "bsd", r"(?:bsd 3 clause clear|clear bsd)(?: license)?", r"bsd 3 clause clear"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: license)?", r"bsd 3 clause(?: lbnl| attribution)?"),
    ("bsd-2-clause-patent", "bsd", r"bsd 2 clause plus patent(?: license)?", r"bsd 2 clause patent"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: license)?", r"bsd 2 clause(?: views)?"),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause)(?: license)?", r"0bsd"),
    ("bsd", "bsd", r"bsd(?: style)? license", r"bsd"),
    ("mit-0", "mit", r"mit no attribution(?: license)?", r"mit 0"),
    ("mit-modern", "mit", r"modern (?:mit )?variant(?: license)?", r"mit modern variant"),
    ("mit", "mit", r"mit(?: style| x11)? licen[cs]e", r"mit"),
    ("x11", "x11", r"x11 (?:style )?license", r"x11"),
    ("isc", "isc", r"isc license", r"isc"),
    ("mpl-2", "mozilla", r"mozilla public license(?: \S+)? (?:v|version )?2(?: 0)?", r"mpl 2 0(?: no copyleft exception)?"),
    ("mpl-1-1", "mozilla", r"mozilla public license(?: \S+)? (?:v|version )?1 1", r"mpl 1 1"),
    ("mpl-1", "mozilla", r"mozilla public license(?: \S+)? (?:v|version )?1 0", r"mpl 1 0"),
    ("mpl", "mozilla", r"mozilla public license", r"mpl"),
    ("epl-2", "eclipse", r"eclipse public license(?: \S+)? (?:v|version )?2(?: 0)?", r"epl 2 0"),
    ("epl-1", "eclipse", r"eclipse public license(?: \S+)? (?:v|version )?1(?: 0)?", r"epl 1 0"),
    ("epl", "eclipse", r"eclipse public license", r"epl"),
    ("edl-1", "eclipse", r"eclipse distribution license(?: v| version)?(?: 1 0)?", r"edl 1 0"),
    ("cddl-1-1", "cddl", r"cddl (?:v|version )?1 1", r"cddl 1 1"),
    ("cddl-1", "distribution", r"common development and distribution license(?: (?:v|version )?1 0)?", r"cddl 1 0"),
    ("cpl-1", "common", r"common public license(?: (?:v|version )?1(?: 0)?)?", r"cpl 1 0"),
    ("cpal-1", "attribution", r"common public attribution license(?: (?:v|version )?1(?: 0)?)?", r"cpal 1 0"),
    ("eupl-1-2", "union", r"european union public licen[cs]e(?: \S+)? (?:v|version )?1 2", r"eupl 1 2"),
    ("eupl", "union", r"european union public licen[cs]e(?: (?:v|version )?1 [01])?", r"eupl(?: 1 [01])?"),
    ("cecill-b", "cecill", r"cecill b(?: licen[cs]e)?", r"cecill b"),
    ("cecill-c", "cecill", r"cecill c(?: licen[cs]e)?", r"cecill c"),
    ("cecill", "cecill", r"cecill(?: (?:v|version )?[12](?: [01])?)?(?: licen[cs]e)?", r"cecill(?: [12] [01])?"),
    ("osl-3", "open", r"open software license(?: (?:v|version )?3(?: 0)?)?", r"osl 3 0"),
    ("afl-3", "academic", r"academic free license(?: (?:v|version )?3(?: 0)?)?", r"afl 3 0"),
    ("artistic-2", "artistic", r"artistic license (?:v|version )?2(?: 0)?", r"artistic 2 0"),
    ("artistic-1", "artistic", r"artistic license (?:v|version )?1(?: 0)?", r"artistic 1 0(?: perl| cl8)?"),
    ("artistic", "artistic", r"artistic license", r"artistic"),
    ("boost-1", "boost", r"boost software license(?: (?:v|version )?1(?: 0)?)?", r"bsl 1 0"),
    ("busl-1-1", "business", r"business source license(?: (?:v|version )?1 1)?", r"busl 1 1"),
    ("sspl-1", "server", r"server side public license(?: (?:v|version )?1)?", r"sspl 1 0"),
    ("elastic-2", "elastic", r"elastic license(?: (?:v|version )?2(?: 0)?)?", r"elastic 2 0"),
    ("polyform-noncommercial", "polyform", r"polyform noncommercial license(?: 1 0 0)?", r"polyform noncommercial 1 0 0"),
    ("polyform", "polyform", r"polyform \S+ license(?: 1 0 0)?", r"polyform \S+(?: \S+)? 1 0 0"),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: (?:v|version )?2)?", r"wtfpl"),
    ("zlib", "zlib", r"zlib(?: libpng)? license", r"zlib"),
    ("libpng", "libpng", r"libpng license(?: version 2)?", r"libpng(?: 2 0)?"),
    ("python-2", "python", r"(?:python software foundation|psf) license(?: (?:v|version )?2(?: 0)?)?", r"(?:python|psf) 2 0"),
    ("postgresql", "postgresql", r"postgresql license", r"postgresql"),
    ("php-3-01", "php", r"php license(?: (?:v|version )?3 01)?", r"php 3 01"),
    ("ruby", "ruby", r"ruby license", r"ruby"),
    ("openssl", "openssl", r"openssl license", r"openssl"),
    ("ofl-1-1", "sil", r"sil open font license(?: (?:v|version )?1 1)?", r"ofl 1 1(?: rfn| no rfn)?"),
    ("ms-pl", "microsoft", r"microsoft public license", r"ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", r"ms rl"),
    ("upl-1", "universal", r"universal permissive license(?: (?:v|version )?1(?: 0)?)?", r"upl 1 0"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source license", r"ncsa"),
    ("odbl-1", "database", r"open database license(?: (?:v|version )?1(?: 0)?)?", r"odbl 1 0"),
    ("odc-by-1", "attribution", r"open data commons attribution license(?: (?:v|version )?1(?: 0)?)?", r"odc by 1 0"),
    ("pddl-1", "dedication", r"public domain dedication and license(?: (?:v|version )?1(?: 0)?)?", r"pddl 1 0"),
    ("cdla-permissive", "community", r"community data license agreement permissive(?: (?:v|version )?[12](?: 0)?)?", r"cdla permissive [12] 0"),
    ("cdla-sharing", "community", r"community data license agreement sharing(?: (?:v|version )?1(?: 0)?)?", r"cdla sharing 1 0"),
    ("ogl", "government", r"open government licen[cs]e(?: (?:v|version )?[123](?: 0)?)?", r"ogl uk [123] 0"),
    ("openrail", "rail", r"(?:creativeml )?open rail(?: (?:m|\+\+))*(?: license)?", r"openrail(?: m)?"),
    ("cc0-1", "cc0", r"(?:creative commons )?cc0(?: 1 0(?: universal)?)?", r"cc0 1 0"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?", r"cc by nc nd [1-4] [05](?: \S+)?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?", r"cc by nc sa [1-4] [05](?: \S+)?"),
    ("cc-by-nc-4", "cc", r"cc by nc 4(?: 0)?", r"cc by nc 4 0"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?", r"cc by nd [1-4] [05](?: \S+)?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?", r"cc by sa [1-4] [05](?: \S+)?"),
    ("cc-by-4", "cc", r"cc by 4(?: 0)?", r"cc by 4 0"),
    ("cc-by", "cc", r"cc by(?! n[cd]| sa)(?: [123] [05])?", r"cc by [123] [05](?: \S+)?"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?", r"cc nc nd"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", r"cc nc sa"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4] [05])?", r"cc nc"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?", r"cc nd"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] [05])?", r"cc sa"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] [05])?", r"cc attribution"),
    ("cc", "creative", r"creative commons licen[cs]e", r"cc"),
]

# Frames around a name ({name}) or an SPDX identifier ({id}): keyword, priority, regex.
FRAMES = [
    ("spdx", TAG, r"spdx license identifier (?:\S+ (?:and|or) )?{id}"),
    ("under", GRANT, r"(?:licensed|released|distributed|published|provided|covered|issued|offered|shared|available|redistribute it and or modify it|use this \S+)"
                     r"(?: \S+){{0,3}} under (?:the |an? )?(?:terms (?:and conditions )?of )?(?:the |an? )?{name}"),
    ("license", GRANT, r"license(?: name| type)?(?: is)? (?:the )?{name}"),
    ("subject", GRANT, r"subject to (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}"),
    ("see", LINK, r"(?:see|read) (?:also )?(?:the )?{name}(?: \S+){{0,3}} for (?:more )?details"),
    ("copy", LINK, r"(?:received|obtain|find|get) a copy of (?:the )?{name}"),
    ("", NAME, r"{name}"),
]

# Sentences of license texts and notices: label, keywords, priority, regex.
SENTENCES = [
    ("mit", "permission merchantability sublicense", TEXT, r"permission is hereby granted free of charge to any person obtaining a copy of this software(?: \S+){0,60} sublicense and or sell copies"),
    ("mit", "permission charge", TEXT, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission fee", TEXT, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("ntp", "permission fee", TEXT, r"permission to use copy modify and distribute this software and its documentation for any purpose(?: \S+){0,5} fee"),
    ("bsd-3-clause", "redistribution endorse", TEXT, r"neither the name of(?: \S+){1,20} nor the names of its contributors may be used to endorse"),
    ("bsd-4-clause", "advertising acknowledgement", TEXT, r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", "redistribution binary", TEXT, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache-2", "perpetual worldwide", TEXT, r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2", "compliance except", TEXT, r"you may not use this file except in compliance with the license"),
    ("apache-2", "org licenses", LINK, r"(?:www )?apache org licenses license 2 0"),
    ("apache-2", "warranties conditions", TEXT, r"distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl-3", "everyone verbatim", TEXT, r"gnu general public license version 3 29 june 2007"),
    ("gpl-2", "everyone verbatim", TEXT, r"gnu general public license version 2 june 1991"),
    ("gpl", "hope useful", TEXT, r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "redistribute foundation", TEXT, r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "redistribute lesser", TEXT, r"you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "redistribute affero", TEXT, r"you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gpl", "received copy", TEXT, r"you should have received a copy of the gnu general public license along with"),
    ("gpl", "gnu licenses", LINK, r"(?:www )?gnu org (?:licenses|copyleft)(?: gpl)?"),
    ("classpath-exception", "linking exception", TEXT, r"linking this library statically or dynamically with other modules"),
    ("mpl-2", "source mozilla", TEXT, r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "mozilla org", LINK, r"(?:www )?mozilla org mpl(?: \d 0)?"),
    ("epl", "accompanying eclipse", TEXT, r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("boost-1", "boost org", LINK, r"(?:www )?boost org license 1 0(?: txt)?"),
    ("boost-1", "permission organization", TEXT, r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("unlicense", "unencumbered domain", TEXT, r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "just what want", TEXT, r"you just do what the \S+ you want to"),
    ("zlib", "altered misrepresented", TEXT, r"altered source versions must be plainly marked as such"),
    ("zlib", "implied warranty damages", TEXT, r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("ofl-1-1", "font fonts", TEXT, r"the fonts and derivatives however cannot be released under any other type of license"),
    ("public-domain", "public domain", GRANT, r"(?:released|placed|dedicated|put|is|are) (?:in|into|to) the public domain"),
    ("cc0-1", "dedicate waive", TEXT, r"to the extent possible under law(?: \S+){1,12} waived all copyright"),
    ("cc0-1", "creativecommons publicdomain", LINK, r"creativecommons org publicdomain zero 1 0"),
    ("cc-by-nc-nd", "creativecommons licenses", LINK, r"creativecommons org licenses by nc nd(?: \d \d)?"),
    ("cc-by-nc-sa", "creativecommons licenses", LINK, r"creativecommons org licenses by nc sa(?: \d \d)?"),
    ("cc-by-nc", "creativecommons licenses", LINK, r"creativecommons org licenses by nc(?! n?[ds]a?)(?: \d \d)?"),
    ("cc-by-nd", "creativecommons licenses", LINK, r"creativecommons org licenses by nd(?: \d \d)?"),
    ("cc-by-sa", "creativecommons licenses", LINK, r"creativecommons org licenses by sa(?: \d \d)?"),
    ("cc-by", "creativecommons licenses", LINK, r"creativecommons org licenses by(?! n[cd]| sa)(?: \d \d)?"),
    ("mit", "opensource mit", LINK, r"opensource org licenses mit(?: license)?(?: php)?"),
    ("bsd", "opensource bsd", LINK, r"opensource org licenses bsd(?: license| \d clause)?(?: php)?"),
    ("apache-2", "opensource apache", LINK, r"opensource org licenses apache 2 0"),
    ("gpl", "opensource gpl", LINK, r"opensource org licenses gpl(?: \d 0)?(?: php)?"),
    ("commercial", "commercial license", GRANT, r"(?:requires|under|purchase|obtain|buy) an? commercial license"),
    ("proprietary", "proprietary confidential", GRANT, r"proprietary and confidential"),
    ("proprietary", "unauthorized copying", GRANT, r"unauthorized copying of this (?:file|software|work|document)"),
    ("proprietary", "express permission", GRANT, r"may not be (?:copied|reproduced|distributed|used)(?: \S+){0,8} without (?:the )?(?:prior |express |written |explicit ){1,3}(?:permission|consent)"),
    ("all-rights-reserved", "rights reserved", HINT, r"all rights reserved"),
    ("research-only", "research purposes", GRANT, r"for (?:academic |non commercial )?research purposes only"),
    ("non-commercial", "commercial use", HINT, r"(?:for )?non commercial use only"),
    ("unknown", "license file", HINT, r"(?:see|read) (?:the )?(?:accompanying )?licen[cs]e(?: txt| md)? (?:file )?(?:for|in)"),
    ("unknown", "licensed", HINT, r"licensed under"),
    ("copyright", "copyright", HINT, r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?"),
]

# What a name needs besides its own keyword, so that single common words open no rule.
NAME_NEEDS = {"mit": "", "public": "general", "bsd": "", "common": "public", "open": "software", "python": "", "library": "general",
              "lesser": "", "union": "european", "distribution": "development", "community": "data", "server": "side",
              "business": "source", "attribution": "license", "database": "open", "government": "open", "php": "license",
              "ruby": "license", "microsoft": "license", "elastic": "license", "artistic": "license", "academic": "free",
              "creative": "commons", "cc": "by", "x11": "license", "isc": "license", "apache": ""}


@dataclass(frozen=True)
class Rule:
    """``base`` rules are never suppressed. Keywords are whole words that must all occur."""
    name: str
    label: str
    keywords: frozenset[bytes]
    priority: int
    pattern: re.Pattern[bytes]
    base: bool = False


def _rule(name: str, label: str, keywords: str, priority: int, regex: str, base: bool = False) -> Rule:
    """The regex matches whole words only."""
    return Rule(name, label, frozenset(keywords.encode().split()), priority, re.compile(rf"(?<!\S)(?:{regex})(?!\S)".encode()), base)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, smaller priorities first and as listed."""
    out = [_rule(f"base:{label}", label, phrase, GRANT, phrase, True) for phrase, label in BASE]
    out += [_rule(f"sentence:{i}", *s) for i, s in enumerate(SENTENCES)]
    for i, (label, keyword, name, identifier) in enumerate(LICENSES):
        for frame, priority, regex in FRAMES:
            # The names of a tag are in its identifier.
            needs = frame if "{id}" in regex else f"{keyword} {NAME_NEEDS.get(keyword, '')} {frame}"
            out.append(_rule(f"{frame or 'name'}:{i}", label, needs, priority, regex.format(name=f"(?:{name})", id=f"(?:{identifier})")))
    return tuple(sorted(out, key=lambda r: r.priority))
