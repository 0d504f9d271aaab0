"""Signature rules of the licence scan, hand-written, in order of priority.

A rule is a regular expression over words in lower case with one space between them; it
matches whole words. Rules that name a licence in full come before short forms, those before
bare mentions: of two detections of the same words the earlier rule's counts.
Each line of a block is one rule: ``keyword | expression``. Every text that the expression
matches has the keyword as a word; with a star it is the beginning of a word.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    number: int         # priority: smaller first
    label: str
    confidence: float
    keyword: str
    pattern: str
    base: bool


# The phrases that are always looked for, with their labels and keywords.
BASE = [("mit", "license | under the mit license"), ("apache-2", "apache | apache license version 2"),
        ("cc-by-nc", "cc | cc by nc")]

# Texts of the licences themselves: sentences that only they have.
TEXTS = {
    "mit": """
permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
warranty | the software is provided as is without warranty of any kind express or implied including but not limited to
portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
restriction | to deal in the software without restriction including without limitation the rights
""",
    "isc": """
permission | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
disclaims | the author disclaims all warranties with regard to this software
""",
    "0bsd": """
permission | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is
""",
    "bsd-3-clause": """
endorse | neither the name of(?: the)?(?: [^ ]+){1,12} nor the names of its contributors may be used to endorse or promote products
endorse | may be used to endorse or promote products derived from this software without specific prior written permission
""",
    "bsd-4-clause": """
advertising | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
""",
    "bsd-2-clause": """
redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions
""",
    "apache-2": """
licensed | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache | you may obtain a copy of the license at https? www apache org licenses license 2 0
limitations | see the license for the specific language governing permissions and limitations under the license
""",
    "apache-1.1": """
redistribution | the end user documentation included with the redistribution if any must include the following acknowledg(?:e)?ment
""",
    "gpl-3": """
gnu | gnu general public license as published by the free software foundation either version 3 of the license
gnu | under the terms of the gnu general public license version 3
copyleft | the gnu general public license is a free copyleft license for software and other kinds of works
""",
    "gpl-2": """
gnu | gnu general public license as published by the free software foundation either version 2 of the license
gnu | under the terms of the gnu general public license version 2
franklin | free software foundation inc 51 franklin st(?:reet)? fifth floor boston ma 02110 1301 usa
temple | free software foundation inc 59 temple place suite 330 boston ma 02111 1307 usa
""",
    "lgpl-3": """
gnu | gnu lesser general public license as published by the free software foundation either version 3 of the license
""",
    "lgpl-2.1": """
gnu | gnu lesser general public license as published by the free software foundation either version 2 1 of the license
""",
    "lgpl-2": """
gnu | gnu library general public license as published by the free software foundation either version 2 of the license
""",
    "agpl-3": """
affero | gnu affero general public license as published by the free software foundation either version 3 of the license
remotely | all users interacting with it remotely through a computer network
""",
    "mpl-2": """
mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl | if a copy of the mpl was not distributed with this file you can obtain one at
""",
    "mpl-1.1": """
mozilla | the contents of this file are subject to the mozilla public license version 1 1
""",
    "epl-1": """
eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
""",
    "epl-2": """
eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0
""",
    "cddl-1": """
development | the contents of this file are subject to the terms of the common development and distribution license
""",
    "unlicense": """
unencumbered | this is free and unencumbered software released into the public domain
jurisdictions | in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest
unlicense | for more information please refer to https? unlicense org
""",
    "cc0-1": """
waived | to the extent possible under law(?: [^ ]+){1,12} has waived all copyright and related or neighbo(?:u)?ring rights
universal | cc0 1 0 universal(?: public domain dedication)?
""",
    "wtfpl": """
verbatim | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed
""",
    "zlib": """
misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
altered | altered source versions must be plainly marked as such
liable | in no event will the authors be held liable for any damages arising from the use of this software
""",
    "bsl-1": """
boost | distributed under the boost software license version 1 0
machine | solely in the form of machine executable object code generated by a source language processor
""",
    "artistic-2": """
artistic | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed artistic
""",
    "postgresql": """
fee | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
""",
    "psf-2": """
psf | psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test
""",
    "ofl-1.1": """
sil | this font software is licensed under the sil open font license version 1 1
reserved | no modified version of the font software may use the reserved font name
""",
    "openssl": """
openssl | this product includes software developed by the openssl project for use in the openssl toolkit
""",
    "curl": """
holder | except as contained in this notice the name of a copyright holder shall not be used in advertising
""",
    "ms-pl": """
contributor | each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution
""",
    "proprietary": """
reserved | all rights reserved no part of this(?: [^ ]+){1,4} may be reproduced
confidential | this(?: [^ ]+){1,3} contains confidential and proprietary information
""",
}

# Machine-readable tags: the identifier after the SPDX mark.
TAGS = {
    "mit": "spdx | spdx license identifier mit",
    "mit-0": "spdx | spdx license identifier mit 0",
    "apache-2": "spdx | spdx license identifier apache 2 0",
    "apache-1.1": "spdx | spdx license identifier apache 1 1",
    "gpl-2": "spdx | spdx license identifier gpl 2 0(?: only| or later)?",
    "gpl-3": "spdx | spdx license identifier gpl 3 0(?: only| or later)?",
    "lgpl-2": "spdx | spdx license identifier lgpl 2 0(?: only| or later)?",
    "lgpl-2.1": "spdx | spdx license identifier lgpl 2 1(?: only| or later)?",
    "lgpl-3": "spdx | spdx license identifier lgpl 3 0(?: only| or later)?",
    "agpl-3": "spdx | spdx license identifier agpl 3 0(?: only| or later)?",
    "bsd-2-clause": "spdx | spdx license identifier bsd 2 clause",
    "bsd-3-clause": "spdx | spdx license identifier bsd 3 clause",
    "bsd-4-clause": "spdx | spdx license identifier bsd 4 clause",
    "0bsd": "spdx | spdx license identifier 0bsd",
    "isc": "spdx | spdx license identifier isc",
    "mpl-1.1": "spdx | spdx license identifier mpl 1 1",
    "mpl-2": "spdx | spdx license identifier mpl 2 0",
    "epl-1": "spdx | spdx license identifier epl 1 0",
    "epl-2": "spdx | spdx license identifier epl 2 0",
    "cddl-1": "spdx | spdx license identifier cddl 1 [01]",
    "unlicense": "spdx | spdx license identifier unlicense",
    "cc0-1": "spdx | spdx license identifier cc0 1 0",
    "cc-by": "spdx | spdx license identifier cc by [1234] [05]",
    "cc-by-sa": "spdx | spdx license identifier cc by sa [1234] [05]",
    "cc-by-nd": "spdx | spdx license identifier cc by nd [1234] [05]",
    "cc-by-nc": "spdx | spdx license identifier cc by nc [1234] [05]",
    "cc-by-nc-sa": "spdx | spdx license identifier cc by nc sa [1234] [05]",
    "cc-by-nc-nd": "spdx | spdx license identifier cc by nc nd [1234] [05]",
    "wtfpl": "spdx | spdx license identifier wtfpl",
    "zlib": "spdx | spdx license identifier zlib",
    "bsl-1": "spdx | spdx license identifier bsl 1 0",
    "artistic-2": "spdx | spdx license identifier artistic 2 0",
    "postgresql": "spdx | spdx license identifier postgresql",
    "psf-2": "spdx | spdx license identifier (?:psf|python) 2 0",
    "ofl-1.1": "spdx | spdx license identifier ofl 1 1",
    "openssl": "spdx | spdx license identifier openssl",
    "curl": "spdx | spdx license identifier curl",
    "ms-pl": "spdx | spdx license identifier ms pl",
    "ms-rl": "spdx | spdx license identifier ms rl",
    "eupl-1.2": "spdx | spdx license identifier eupl 1 2",
    "eupl-1.1": "spdx | spdx license identifier eupl 1 1",
    "gfdl-1.3": "spdx | spdx license identifier gfdl 1 3(?: only| or later)?",
    "afl-3": "spdx | spdx license identifier afl 3 0",
    "osl-3": "spdx | spdx license identifier osl 3 0",
    "odbl-1": "spdx | spdx license identifier odbl 1 0",
    "pddl-1": "spdx | spdx license identifier pddl 1 0",
    "ncsa": "spdx | spdx license identifier ncsa",
    "cecill-2.1": "spdx | spdx license identifier cecill 2 1",
    "vim": "spdx | spdx license identifier vim",
    "ruby": "spdx | spdx license identifier ruby",
    "php-3": "spdx | spdx license identifier php 3 01?",
    "bsl-1.1-source": "spdx | spdx license identifier busl 1 1",
    "sspl-1": "spdx | spdx license identifier sspl 1 0",
    "elastic-2": "spdx | spdx license identifier elastic 2 0",
}

# Statements and names, the longer ones first.
NAMES = {
    "mit": """
licen* | (?:is |are )?(?:released|licensed|distributed|published|available) under the(?: terms of the)? mit license
licen* | under(?: the)?(?: terms of)?(?: the)? mit licen[cs]e
licen* | the mit license
licen* | mit(?: x11)?(?: style)? licen[cs]ed?
expat | expat licen[cs]e
opensource | opensource org licenses mit
""",
    "mit-0": """
attribution | mit no attribution(?: license)?
""",
    "x11": """
x11 | x11 licen[cs]e
""",
    "isc": """
isc | (?:under )?the isc licen[cs]e
isc | isc licen[cs]ed?
consortium | internet systems consortium license
""",
    "0bsd": """
bsd | (?:zero|0) clause bsd(?: license)?
0bsd | 0bsd(?: license)?
""",
    "bsd-2-clause": """
bsd | (?:the )?(?:2|two) clause bsd(?: license)?
bsd | (?:the )?bsd (?:2|two) clause(?: license)?
bsd | (?:simplified|freebsd) bsd(?: license)?
freebsd | freebsd licen[cs]e
""",
    "bsd-3-clause": """
bsd | (?:the )?(?:3|three) clause bsd(?: license)?
bsd | (?:the )?bsd (?:3|three) clause(?: license)?
bsd | (?:new|revised|modified) bsd(?: license)?
""",
    "bsd-4-clause": """
bsd | (?:the )?(?:4|four) clause bsd(?: license)?
bsd | (?:the )?bsd (?:4|four) clause(?: license)?
bsd | (?:original|old) bsd license
""",
    "bsd": """
bsd | (?:released|licensed|distributed) under(?: the)?(?: terms of the)? bsd licen[cs]e
bsd | bsd(?: style)? licen[cs]ed?
""",
    "apache-2": """
apache | (?:released|licensed|distributed|published|available) under the(?: terms of the)? apache license(?: version)? 2(?: 0)?
apache | under the(?: terms of the)? apache (?:software )?license(?: version)? v?2(?: 0)?
apache | apache (?:software )?licen[cs]e(?: version)? v?2(?: 0)?
apache | apache 2(?: 0)? licen[cs]ed?
apache | apache v?2(?: 0)?
asl | asl 2 0
""",
    "apache-1.1": """
apache | apache (?:software )?license(?: version)? v?1 1
""",
    "apache-1": """
apache | apache (?:software )?license(?: version)? v?1 0
""",
    "apache": """
apache | under the apache (?:software )?licen[cs]e
apache | apache (?:software )?licen[cs]ed?
""",
    "agpl-3": """
affero | (?:gnu )?affero general public licen[cs]e(?: version)? v?3(?: 0)?(?: or (?:any )?later(?: version)?)?
agpl | (?:gnu )?agpl(?: version)? ?v?3(?: 0)?
agplv3 | agplv3
affero | (?:gnu )?affero general public licen[cs]e
agpl | (?:gnu )?agpl
""",
    "lgpl-3": """
lesser | (?:gnu )?lesser general public licen[cs]e(?: version)? v?3(?: 0)?(?: or (?:any )?later(?: version)?)?
lgpl | (?:gnu )?lgpl(?: version)? v?3(?: 0)?
lgplv3 | lgplv3
""",
    "lgpl-2.1": """
lesser | (?:gnu )?lesser general public licen[cs]e(?: version)? v?2 1(?: or (?:any )?later(?: version)?)?
lgpl | (?:gnu )?lgpl(?: version)? v?2 1
lgplv2 | lgplv2 1
""",
    "lgpl-2": """
licen* | (?:gnu )?library general public licen[cs]e(?:(?: version)? v?2(?: 0)?)?
lgpl | (?:gnu )?lgpl(?: version)? v?2(?: 0)
""",
    "lgpl": """
lesser | (?:gnu )?lesser general public licen[cs]e
lgpl | (?:gnu )?lgpl
""",
    "gpl-3": """
gnu | licensed under the(?: terms of the)? gnu general public licen[cs]e(?: version)? v?3(?: 0)?
gnu | gnu general public licen[cs]e(?: version)? v?3(?: 0)?(?: or (?:any )?later(?: version)?)?
gpl | (?:gnu )?gpl(?: version)? v?3(?: 0)?
gplv3 | gplv3
""",
    "gpl-2": """
gnu | licensed under the(?: terms of the)? gnu general public licen[cs]e(?: version)? v?2(?: 0)?
gnu | gnu general public licen[cs]e(?: version)? v?2(?: 0)?(?: or (?:any )?later(?: version)?)?
gpl | (?:gnu )?gpl(?: version)? v?2(?: 0)?
gplv2 | gplv2
""",
    "gpl-1": """
gnu | gnu general public licen[cs]e(?: version)? v?1(?: 0)?
""",
    "gpl": """
gnu | (?:under the )?(?:terms of the )?gnu general public licen[cs]e
gnu | gnu gpl
gpl | gpl(?: compatible)? licen[cs]ed?
copyleft | copyleft licen[cs]e
""",
    "gfdl-1.3": """
gnu | gnu free documentation licen[cs]e(?: version)? v?1 3
gfdl | gfdl(?: version)? v?1 3
""",
    "gfdl": """
gnu | gnu free documentation licen[cs]e
gfdl | gfdl
""",
    "mpl-2": """
mozilla | mozilla public licen[cs]e(?: version)? v?2(?: 0)?
mpl | mpl(?: version)? v?2(?: 0)?
""",
    "mpl-1.1": """
mozilla | mozilla public licen[cs]e(?: version)? v?1 1
mpl | mpl(?: version)? v?1 1
""",
    "mpl": """
mozilla | mozilla public licen[cs]e
""",
    "epl-2": """
eclipse | eclipse public licen[cs]e(?: version)? v?2(?: 0)?
epl | epl(?: version)? v?2 0
""",
    "epl-1": """
eclipse | eclipse public licen[cs]e(?: version)? v?1(?: 0)?
epl | epl(?: version)? v?1 0
""",
    "epl": """
eclipse | eclipse public licen[cs]e
""",
    "eupl-1.2": """
licen* | european union public licen[cs]e(?: version)? v?1 2
eupl | eupl(?: version)? v?1 2
""",
    "eupl-1.1": """
licen* | european union public licen[cs]e(?: version)? v?1 1
eupl | eupl(?: version)? v?1 1
""",
    "cddl-1": """
licen* | common development and distribution licen[cs]e(?:(?: version)? v?1 [01])?
cddl | cddl(?: version| v)?(?: 1 [01])?
""",
    "cpl-1": """
licen* | common public licen[cs]e(?:(?: version)? v?1 0)?
""",
    "cpal-1": """
licen* | common public attribution licen[cs]e(?:(?: version)? v?1 0)?
""",
    "cecill-2.1": """
cecill | cecill(?: free software license agreement)?(?: version)? v?2 1
""",
    "cecill": """
cecill | cecill(?: [abc])? licen[cs]e
""",
    "cc-by-nc-nd": """
creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?
cc | cc by nc nd(?: [1234] [05])?
""",
    "cc-by-nc-sa": """
creative | creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?
cc | cc by nc sa(?: [1234] [05])?
""",
    "cc-by-nc": """
licensed | licensed under cc by nc(?: [1234] [05])?
creative | creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?
cc | cc by nc(?: [1234] [05])?
""",
    "cc-by-nd": """
creative | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?
cc | cc by nd(?: [1234] [05])?
""",
    "cc-by-sa": """
creative | creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?
cc | cc by sa(?: [1234] [05])?
""",
    "cc-by": """
creative | creative commons attribution(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?
cc | cc by(?: [1234] [05])?
creativecommons | creativecommons org licenses by [1234] [05]
""",
    "cc0-1": """
creative | creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?
cc0 | cc0(?: 1 0)?
creativecommons | creativecommons org publicdomain zero 1 0
""",
    "cc": """
creative | (?:under a )?creative commons licen[cs]e
creativecommons | creativecommons org licenses
""",
    "public-domain": """
domain | (?:released|placed|dedicated) (?:into|in|to) the public domain
domain | public domain(?: dedication| mark)
""",
    "unlicense": """
unlicense | (?:released )?under the unlicense
unlicense | the unlicense
""",
    "wtfpl": """
wtfpl | wtfpl
""",
    "zlib": """
zlib | (?:the )?zlib(?: libpng)? licen[cs]e
""",
    "libpng": """
libpng | libpng licen[cs]e
""",
    "bsl-1": """
licen* | boost software licen[cs]e(?:(?: version)? v?1 0)?
""",
    "artistic-2": """
artistic | artistic licen[cs]e(?: version)? v?2(?: 0)?
""",
    "artistic": """
artistic | (?:the )?(?:perl )?artistic licen[cs]e
""",
    "afl-3": """
licen* | academic free licen[cs]e(?:(?: version)? v?3 0)?
""",
    "osl-3": """
licen* | open software licen[cs]e(?:(?: version)? v?3 0)?
""",
    "ofl-1.1": """
licen* | (?:sil )?open font licen[cs]e(?:(?: version)? v?1 1)?
""",
    "odbl-1": """
licen* | open database licen[cs]e(?:(?: version)? v?1 0)?
odbl | odbl(?: 1 0)?
""",
    "odc-by-1": """
licen* | open data commons attribution licen[cs]e
odc | odc by(?: 1 0)?
""",
    "pddl-1": """
licen* | public domain dedication and licen[cs]e
""",
    "ogl-3": """
licen* | open government licen[cs]e(?:(?: version)? v?[123](?: 0)?)?
""",
    "postgresql": """
postgresql | (?:the )?postgresql licen[cs]e
""",
    "psf-2": """
python | python software foundation licen[cs]e(?:(?: version)? 2)?
psf | psf licen[cs]e
""",
    "php-3": """
php | (?:the )?php licen[cs]e(?:(?: version)? 3 01?)?
""",
    "ruby": """
ruby | (?:the )?ruby licen[cs]e
""",
    "vim": """
vim | (?:the )?vim licen[cs]e
""",
    "ncsa": """
illinois | university of illinois(?: ncsa)?(?: open source)? licen[cs]e
""",
    "openssl": """
openssl | openssl licen[cs]e
""",
    "ms-pl": """
licen* | microsoft public licen[cs]e
""",
    "ms-rl": """
licen* | microsoft reciprocal licen[cs]e
""",
    "llama-2": """
llama | llama 2 community licen[cs]e(?: agreement)?
""",
    "llama-3": """
llama | llama 3(?: [123])? community licen[cs]e(?: agreement)?
""",
    "openrail": """
openrail | (?:creativeml |bigscience )?openrail(?: [ms])?(?: licen[cs]e)?
rail | (?:creativeml |bigscience )?open rail(?: [ms])?(?: licen[cs]e)?
responsible | responsible ai licen[cs]e
""",
    "sspl-1": """
licen* | server side public licen[cs]e(?:(?: version)? v?1)?
sspl | sspl
""",
    "busl-1.1": """
licen* | business source licen[cs]e(?:(?: version)? v?1 1)?
""",
    "elastic-2": """
elastic | elastic licen[cs]e(?:(?: version)? v?2(?: 0)?)?
""",
    "beerware": """
licen* | beer ?ware licen[cs]e
""",
    "jsr": """
evil | the software shall be used for good not evil
""",
    "proprietary": """
proprietary | proprietary licen[cs]e
reserved | all rights reserved
licen* | commercial licen[cs]e(?: agreement)?
licen* | end user licen[cs]e agreement
""",
    "non-commercial": """
commercial | for non commercial (?:use|purposes) only
noncommercial | for noncommercial (?:use|purposes) only
research | for research (?:use|purposes) only
""",
}

# Bare mentions, last of all.
MENTIONS = {
    "unknown-license": """
licensed | (?:is |are )?licensed under(?: the)?
licen* | licen[cs]e(?:d)? (?:agreement|terms|notice|file)
licen* | see(?: the)? license(?: file)?(?: for details)?
licen* | open source licen[cs]e
licen* | free software licen[cs]e
licen* | permissive licen[cs]e
licen* | dual licen[cs]ed
""",
}


def rules() -> list[Rule]:
    """All rules in order of priority; the base phrases come right after the licences' own texts and tags."""
    out: list[Rule] = []

    def add(label: str, confidence: float, lines: str, base: bool = False) -> None:
        for line in filter(None, map(str.strip, lines.splitlines())):
            keyword, _, pattern = line.partition(" | ")
            out.append(Rule(len(out), label, confidence, keyword, pattern, base))

    for label, lines in TEXTS.items():
        add(label, 1.0, lines)
    for label, line in TAGS.items():
        add(label, 1.0, line)
    for label, line in BASE:
        add(label, 0.9, line, base=True)
    for label, lines in NAMES.items():
        add(label, 0.8, lines)
    for label, lines in MENTIONS.items():
        add(label, 0.3, lines)
    return out
